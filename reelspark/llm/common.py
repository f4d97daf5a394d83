"""What the operators share: tables, the shared folder, words, hashes and per-task copies.

Words are the runs of ``[^\\x20\\x09-\\x0D]+``, which is what ``bytes.split()`` yields on UTF-8.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: dict[str, str] = {}

#: Bits of the fixed-size map of document ids that prunes a later scan of the texts (1 MB).
ID_BITS = 1 << 23
#: Logarithm of the bits of the largest such map (16 MB).
MOST_BITS = 27
#: Odd multiplier of the polynomial over word hashes, and a second one for wider keys.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIER_2 = np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent on a local master (as in tests), a temporary folder serves; on a
    cluster, whose machines do not share one, its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        key = spark.sparkContext.applicationId
        root = _OWN_FOLDER.setdefault(key, "") or tempfile.mkdtemp(prefix="reelspark-")
        _OWN_FOLDER[key] = root
        root = f"file://{root}"
    return f"{root.rstrip('/')}/reelspark-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, units: int, per_partition: int) -> int:
    """Partitions for ``units`` of work, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(units) // per_partition))


def dealt(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``df`` by its bucket column: where there are more buckets than shuffle partitions, in as many
    partitions as buckets."""
    return df.repartition(buckets, name) if buckets > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


class Words(NamedTuple):
    """The words of several texts: a hash of each, its bytes in ``data``, and by text the index of
    its first word (with the end of the last)."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.first[k] : self.first[k + 1]]

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_VALUES = _BYTE_VALUES.copy()
_LOWER_VALUES[0x41:0x5B] = _BYTE_VALUES[0x61:0x7B]
_CHUNK = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MULTIPLIER and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = []
        for base in (int(MULTIPLIER), pow(int(MULTIPLIER), -1, 1 << 64)):
            out = np.full(max(n, 2 * _CHUNK), base, np.uint64)
            out[0] = 1
            _POWERS.append(np.multiply.accumulate(out))
    return _POWERS[0], _POWERS[1]


#: 1: ASCII letter, 2: punctuation that tokenizers' rules always part from letters, 16: digit.
_PART = np.full(256, 4, np.uint8)
_PART[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_PART[list(b".,;:!?|#*$%&<>()[]{}\"/-_=+")] = 2
_PART[0x30:0x3A] = 16


def words_in(data: np.ndarray, offsets: np.ndarray, lower: bool = False, parted: bool = False) -> Words:
    """Words of the texts ``data[offsets[k]:offsets[k + 1]]``; with ``lower``, A-Z hash as a-z;
    ``parted``, words are also cut between ASCII letters and punctuation, and on both sides of a digit.

    A word's hash is a polynomial over its bytes, got from running sums over a stretch of text.
    """
    space = _SPACE[data]
    inside = np.flatnonzero(np.diff(offsets) > 0)
    before = np.concatenate([[True], space[:-1]])[: len(data)]
    before[offsets[inside]] = True
    after = np.concatenate([space[1:], [True]])[: len(data)]
    after[offsets[inside + 1] - 1] = True
    if parted and len(data):
        kind = _PART[data]
        both = kind[1:] + kind[:-1]
        apart = (both == 3) | (both >= 16)
        before[1:] |= apart
        after[:-1] |= apart
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    hashes = np.empty(len(starts), np.uint64)
    values = _LOWER_VALUES if lower else _BYTE_VALUES
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        lo, hi = starts[i], ends[j - 1]
        power, inverse = _powers(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.multiply(values[data[lo:hi]], power[: hi - lo], out=sums[1:])
        np.cumsum(sums, out=sums)
        hashes[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * inverse[starts[i:j] - lo]
        i = j
    return Words(mix(hashes), starts, ends, np.searchsorted(starts, offsets), data, offsets)


def word_table(batch: pa.RecordBatch, name: str = "text", lower: bool = False, parted: bool = False) -> Words:
    data, offsets = text_buffer(batch, name)
    return words_in(data, offsets, lower, parted)


def text_buffer(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's texts one after the other, and where each begins (null: empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, places, data = col.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of a 64-bit hash (a finaliser, one to one)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(h: np.ndarray, size: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """Hash of each run of ``size`` words; ``h`` are the word hashes of one document."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):
            out *= multiplier
            out += h[k : k + n]
        return mix(out)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The column's UTF-8 bytes, null as None."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = 2 << 20, most_rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text and ``most_rows`` rows each at most, so
    that memory is bounded by either."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(name))
        sizes = np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(float))
        slots = (np.cumsum(sizes) // limit).astype(np.int64)
        ends = np.union1d(np.flatnonzero(np.diff(slots)) + 1, np.arange(most_rows, batch.num_rows, most_rows))
        cuts = [0, *ends.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def id_bitmap(ids: DataFrame, name: str, bits: int = ID_BITS) -> bytes:
    """Map of ``ids`` modulo ``bits`` as bits: a set that may hold more, never less, of fixed size."""
    place = ids.select(F.pmod(F.col(name), F.lit(bits)).cast("bigint").alias("p"))
    rows = place.groupBy(F.expr("cast(p div 32768 as int)").alias("b")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("bits"))
    out = bytearray(bits // 8)
    for b, bits in rows.collect():
        out[b * 4096 : (b + 1) * 4096] = bytes(bits)
    return bytes(out)


def hash_below(n: int, size: int) -> int:
    """Bound of a 62-bit hash below which about ``n`` of ``size`` rows lie: never 0, whatever the size."""
    return max(1, min(1 << 62, (n << 62) // max(1, size)))


def hashed(name: str):
    """A column's hash of 62 bits."""
    return F.shiftrightunsigned(F.xxhash64(name), 2)


def give_back() -> None:
    """Returns freed memory to the system: Spark uses a Python worker for many tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_bitmap(bits: bytes, ids: list[int]) -> np.ndarray:
    place = np.asarray(ids, np.int64) % (8 * len(bits))
    return (np.frombuffer(bits, np.uint8)[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def kept_by(bits: bytes, name: str = "doc_id", inside: bool = True) -> Callable:
    """A mapInArrow function: the rows whose id is in the map, or with ``inside`` false the others;
    null ids are not in it."""

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(name))
            mask = np.zeros(batch.num_rows, bool)
            there = ids.is_valid().to_numpy(zero_copy_only=False)
            mask[there] = in_bitmap(bits, ids.drop_null().to_pylist())
            yield batch.filter(pa.array(mask == inside))

    return run


def without(rows: DataFrame, ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """``rows`` less those whose id ``ids`` (one column, ``name``) holds; a null id stays.

    Only rows whose id is in a map of bits of the ids meet them in a join, so texts that surely stay
    are not shuffled. The map has 16 bits for each id, MOST_BITS at most.
    """
    ids = cut(ids.select(F.col(name).cast("bigint").alias(name)).where(f"`{name}` is not null").distinct())
    bits = 1 << min(MOST_BITS, max(20, (16 * ids.count()).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(id_bitmap(ids, name, bits))
    stay = rows.mapInArrow(lambda b: kept_by(shared.value, name, False)(b), rows.schema)
    perhaps = rows.mapInArrow(lambda b: kept_by(shared.value, name)(b), rows.schema)
    return stay.unionByName(perhaps.join(ids, name, "left_anti").select(*(f"`{c}`" for c in rows.columns)))


def digest(hashes: np.ndarray) -> bytes:
    """128 bits of a sequence of word hashes."""
    return hashlib.blake2b(np.ascontiguousarray(hashes), digest_size=16).digest()

