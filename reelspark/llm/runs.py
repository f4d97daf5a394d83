"""Runs of bytes of a class in texts, as arrays, and the CRC-32 of runs joined by one space.

Texts are UTF-8; bytes of 0x80 and above belong to characters outside ASCII, so a class of ASCII
characters with all others is a class of bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: A-Z as a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Runs whose n-grams are made at a time, and the longest run whose shift has a table of its own.
STRETCH = 1 << 19
TABLED = 64


class Runs(NamedTuple):
    """Runs of several texts: their bytes one after the other (A-Z lower-cased), where each begins
    in them (with the end of the last), and by text the number of its first run (with the end)."""

    data: np.ndarray
    places: np.ndarray
    first: np.ndarray

    def strings(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(self.places) - 1, [None, pa.py_buffer(self.places), pa.py_buffer(self.data)])

    def texts(self) -> np.ndarray:
        """The number of each run's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in one of the spans, both ends included."""
    out = np.zeros(256, bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return out


def runs_in(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> Runs:
    """The maximal runs of ``member`` bytes in the texts ``data[offsets[k]:offsets[k + 1]]``."""
    inside = member[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(ends) + 1 - starts, out=places[1:])
    return Runs(LOWER[data[inside]], places, np.searchsorted(starts, offsets))


def _zero_byte(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[crc & np.uint32(255)] ^ (crc >> np.uint32(8))


def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Tables of what a CRC-32 becomes when n zero bytes follow, for n up to TABLED, and for
    n = 2^k: by the place of one of its bytes and that byte's value."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    small = np.empty((TABLED + 1, 4, 256), np.uint32)
    small[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(TABLED):
        small[n + 1] = _zero_byte(small[n], table)
    powers = np.empty((32, 4, 256), np.uint32)
    powers[0] = small[1]
    for k in range(31):
        powers[k + 1] = _apply(powers[k].reshape(-1), powers[k], 0)
    return small.reshape(-1), powers.reshape(32, -1)


def _apply(flat: np.ndarray, crc: np.ndarray, at) -> np.ndarray:
    low = np.uint32(255)
    out = flat[at + (crc & low)]
    for place in (1, 2, 3):
        out ^= flat[at + 256 * place + (crc >> np.uint32(8 * place) & low)]
    return out


_SMALL, _POWERS = _shifts()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 values as they enter that of a string which ``n`` bytes follow."""
    out = _apply(_SMALL, crc, np.minimum(n, TABLED) * 1024)
    if len(far := np.flatnonzero(n > TABLED)):
        rest = n[far] - TABLED
        for k in range(int(rest.max()).bit_length()):
            on = far[rest >> k & 1 == 1]
            out[on] = _apply(_POWERS[k], out[on], 0)
    return out


def ngram_crcs(runs: Runs, most: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, CRC-32) of all runs of 1 to ``most`` consecutive words, joined by one
    space, stretch by stretch. Words are told apart by their bytes, not by a hash."""
    if len(runs.places) == 1:
        return
    coded = runs.strings().dictionary_encode()
    code = coded.indices.to_numpy()
    distinct = coded.dictionary.to_pylist()
    alone = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    after = np.fromiter((zlib.crc32(b" " + w) for w in distinct), np.uint32, len(distinct))
    size = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 1
    text = runs.texts()
    for a in range(0, len(code), STRETCH):
        b = min(len(code), a + STRETCH)
        crc, own = alone[code[a:b]], text[a:b]
        yield own, crc
        for step in range(1, most):
            n = min(b, len(code) - step) - a
            if n <= 0:
                break
            more = code[a + step : a + step + n]
            crc = shifted(crc[:n], size[more]) ^ after[more]
            same = text[a + step : a + step + n] == own[:n]
            yield own[:n][same], crc[same]
