"""Best-fit packing (operator 12) by exact-complement hashing.

Only lengths matter for packing, and there are no more than TOKENS of them: the number of pieces by
length is all that the driver sees, at any size of the corpus. From these numbers a plan is made: for
the longest pieces left, singles, pairs and triples whose lengths fill the gap exactly are looked
up by their sum and consumed as often as all their lengths are available; what finds no complement is
placed by best fit. Short pieces fill what best fit leaves, so plans that spare them are made too, and
the one with the fewest sequences is taken. A plan is a list of patterns with their number of copies,
bounded by the lengths.
Pieces of a length are numbered through, and a piece's number tells its pattern, copy and place.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import column, cut, give_back, small_batches, table, text_buffer
from reelspark.llm.runs import byte_class

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Appended to each text's ids.
END_ID = 2
TOKENS = 1024
#: Plans that are tried: most pieces of an exact complement, and the shortest piece it may have.
TRIED = ((3, 1), (3, 32), (3, 64), (3, 128), (1, 1))
#: Distinct chunks, and bytes of them, whose ids a task remembers.
KNOWN_CHUNKS = 400_000
KNOWN_BYTES = 16 << 20
#: Plain chunks that the tokenizer gets in one string.
CHUNKS_AT_ONCE = 256
#: Bytes of text that are encoded at a time.
BATCH_BYTES = 4 << 20

_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
_MARK = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_APOSTROPHE = 0x27
#: Last bytes of the white space beyond ASCII, whose characters begin with C2 or E1 to E3.
_WIDE_SPACE_END = byte_class((0x80, 0x8A), (0x9F, 0xA0), (0xA8, 0xA9), (0xAF, 0xAF))
#: Chunks without white space but for one leading space; a line break parts them in one text.
_PLAIN = r"^ ?(?:[\x21-\x7e]|[\xc3-\xdf][\x80-\xbf])+$"


def chunk_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the texts may be cut without a change of their ids: the tokenizer's rules part text
    before white space that follows something else, and between ASCII letters and marks (but for
    letters after an apostrophe). Ends of texts are among the places."""
    if not len(data):
        return np.zeros(1, np.int64)
    before, after = data[:-1], data[1:]
    wide = _WIDE_SPACE_END[before]
    if wide.any():
        lead = np.zeros(len(before), bool)
        lead[1:] |= data[:-2] == 0xC2
        lead[2:] |= (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3)
        wide &= lead
    parted = np.zeros(len(data) + 1, bool)
    parted[1:-1] = _SPACE[after] & ~_SPACE[before] & ~wide
    parted[1:-1] |= _LETTER[before] & _MARK[after]
    parted[1:-1] |= _MARK[before] & (before != _APOSTROPHE) & _LETTER[after]
    parted[offsets] = True
    return np.flatnonzero(parted)


class ChunkIds:
    """Ids of texts by the tokenizer, chunk by chunk. Chunks are told apart by their bytes. A text
    with the literal of an added token goes through the tokenizer whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        """Forgets all chunks."""
        self.slots: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.bytes = np.empty(0, np.uint32), 0

    def keep(self, chunks: list[bytes]) -> None:
        """Forgets all chunks but these."""
        kept = [c for c in chunks if c in self.slots]
        old = np.fromiter(map(self.slots.__getitem__, kept), np.int64, len(kept))
        ids, size = self.ids_of(old)
        self.clear()
        self.add(kept, ids, size)

    def add(self, chunks: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        self.at = np.append(self.at, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.append(self.flat, ids)
        self.slots.update(zip(chunks, range(len(self.slots), len(self.slots) + len(chunks)), strict=True))
        self.bytes += sum(map(len, chunks))

    def ids_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known chunks one after the other, and how many each has."""
        size = self.size[slots]
        return self.flat[np.repeat(self.at[slots] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after the other, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for own in found for i in own), np.uint32, int(size.sum())), size

    def encode_plain(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain chunks, as the lines of a few texts: a line break is an id of its own there."""
        if len(self.line_break) != 1:
            return self.encode(chunks)
        lines = [b"\n".join(chunks[k : k + CHUNKS_AT_ONCE]).decode() + "\n" for k in range(0, len(chunks), CHUNKS_AT_ONCE)]
        found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in found), np.uint32)
        breaks = np.flatnonzero(ids == self.line_break[0])
        if len(breaks) != len(chunks):
            return self.encode(chunks)
        return np.delete(ids, breaks), np.diff(breaks, prepend=-1) - 1

    def learn(self, chunks: list[bytes]) -> None:
        plain = pc.match_substring_regex(pa.array(chunks, pa.large_binary()), _PLAIN).to_numpy(zero_copy_only=False)
        for chosen, encode in ((plain, self.encode_plain), (~plain, self.encode)):
            own = list(itertools.compress(chunks, chosen.tolist()))
            self.add(own, *encode(own))

    def of(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and where each begins."""
        places = chunk_places(data, offsets)
        coded = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.slots) > KNOWN_CHUNKS or self.bytes > KNOWN_BYTES:
            self.keep(chunks)
        if new := [c for c in chunks if c not in self.slots]:
            self.learn(new)
        slots = np.fromiter(map(self.slots.__getitem__, chunks), np.int64, len(chunks))[coded.indices.to_numpy()]
        ids, size = self.ids_of(slots)
        edges = np.append(0, np.cumsum(size))[np.searchsorted(places, offsets)]
        if self.added and self.added.search(raw := data.tobytes()):
            own = np.split(ids, edges[1:-1])
            for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                if self.added.search(text := raw[a:b]):
                    own[k] = np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            ids, edges = np.concatenate(own), np.cumsum([0, *map(len, own)])
        if end_id is not None:
            ids = np.insert(ids, edges[1:], end_id)
            edges = edges + np.arange(len(edges))
        return ids, edges


_ENCODERS: dict[str, ChunkIds] = {}


def encoder_of(path: str) -> ChunkIds:
    """The encoder of this Python worker, which serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkIds(path)
    return _ENCODERS[path]


class Complements:
    """Singles, pairs and triples of available lengths by their sum. A combination found for a sum is
    kept until one of its lengths runs out."""

    def __init__(self, counts: np.ndarray, parts: int = 3, least: int = 1) -> None:
        self.left, self.parts, self.least = counts.copy(), parts, least
        self.index: dict[tuple[int, int], tuple[int, ...]] = {}

    def available(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[x] >= k for x, k in Counter(lengths).items())

    def find(self, parts: int, total: int, most: int) -> tuple[int, ...] | None:
        """Available lengths, ``parts`` of them and none above ``most``, that sum to ``total``; the
        longest first length is taken."""
        if total < parts * self.least:
            return None
        if parts == 1:
            return (total,) if total <= most and self.left[total] else None
        known = self.index.get((parts, total))
        if known and known[0] <= most and self.available(known):
            return known
        first = np.flatnonzero(self.left[: min(most, total - (parts - 1) * self.least) + 1])[::-1]
        if parts == 2:
            first = first[self.left[total - first] > (first == total - first)]
        for a in first.tolist():
            self.left[a] -= 1
            rest = self.find(parts - 1, total - a, a)
            self.left[a] += 1
            if rest:
                self.index[parts, total] = (a, *rest)
                return (a, *rest)
        return None

    def exact(self, length: int, gap: int) -> tuple[int, ...] | None:
        """What fills the gap beside one piece of ``length``, the fewest pieces first."""
        self.left[length] -= 1
        found = next((c for parts in range(1, self.parts + 1) if (c := self.find(parts, gap, gap))), None)
        self.left[length] += 1
        return found


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of the pieces of a sequence) and how often each is used, so that all pieces
    are placed: ``counts[n]`` pieces have length n, and sequences hold ``len(counts) - 1``."""
    return min((one_plan(counts, *how) for how in TRIED), key=lambda p: sum(copies for _, copies in p))


def one_plan(counts: np.ndarray, parts: int, least: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan with complements of at most ``parts`` pieces, none shorter than ``least``."""
    size = len(counts) - 1
    sums = Complements(counts, parts, least)
    out: list[tuple[tuple[int, ...], int]] = []
    for length in range(size, 0, -1):
        while sums.left[length]:
            found = () if length == size else sums.exact(length, size - length)
            if found is None:
                break
            uses = Counter((length, *found))
            copies = int(min(sums.left[x] // k for x, k in uses.items()))
            for x, k in uses.items():
                sums.left[x] -= k * copies
            out.append(((length, *found), copies))
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by gap
    has = np.zeros(size + 1, bool)
    for length in np.flatnonzero(sums.left)[::-1].tolist():
        n = int(sums.left[length])
        while n:
            fits = np.flatnonzero(has[length:])
            gap = length + int(fits[0]) if len(fits) else size
            pattern, copies = open_[gap].pop() if len(fits) else ((), n)
            each = min(n, gap // length)
            used = min(copies, n // each)
            if len(fits) and copies > used:
                open_[gap].append((pattern, copies - used))
            has[gap] = bool(open_[gap])
            if rest := gap - each * length:
                open_[rest].append((pattern + (length,) * each, used))
                has[rest] = True
            else:
                out.append((pattern + (length,) * each, used))
            n -= each * used
    return out + [p for own in open_.values() for p in own]


class Places:
    """By length and number of a piece: its sequence and its place there."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]) -> None:
        used: Counter = Counter()
        rows, offsets, sequence = [], [], 0
        for pattern, copies in patterns:
            begin = np.concatenate([[0], np.cumsum(pattern)[:-1]]).tolist()
            for length, k in Counter(pattern).items():
                rows.append((length, used[length], k, sequence, len(offsets)))
                offsets += [b for b, x in zip(begin, pattern, strict=True) if x == length]
                used[length] += k * copies
            sequence += copies
        length, start, k, first, at = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else [np.empty(0, np.int64)] * 5
        self.key, self.start, self.each, self.first, self.at, self.offsets = (length << 48) + start, start, k, first, at, np.array(offsets, np.int64)

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.key, (length << 48) + number, "right") - 1
        place = number - self.start[row]
        return self.first[row] + place // self.each[row], self.offsets[self.at[row] + place % self.each[row]]


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(docs: DataFrame, tokenizer: str, tokens: int, with_ids: bool) -> DataFrame:
    """The pieces of each row's ids, with the task's number ``part`` and the piece's number ``nth``
    among those of its length in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(tokens + 1, np.int64)
        for batch in small_batches(batches, limit=BATCH_BYTES):
            ids, edges = encoder.of(*text_buffer(batch))
            ids = np.ascontiguousarray(ids, "<u4")
            n = np.diff(edges)
            pieces = -(-n // tokens)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = n[row] - (pieces[row] - 1) * tokens
            start = np.where(piece > 0, head + (piece - 1) * tokens, 0)
            length = np.where(piece > 0, tokens, head)
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            begins = np.searchsorted(sorted_, sorted_)
            nth = np.empty(len(row), np.int64)
            nth[order] = seen[sorted_] + np.arange(len(row)) - begins
            seen += np.bincount(length, minlength=tokens + 1)
            spans = list(zip((edges[row] + start).tolist(), (edges[row] + start + length).tolist(), strict=True))
            crc = pa.array([zlib.crc32(ids[a:b]) for a, b in spans], pa.int64())
            doc = pa.array(column(batch, "doc_id"), pa.int64()).take(pa.array(row))
            arrays = [doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), crc, pa.array(np.full(len(row), part, np.int32)), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:  # pieces follow one another as the ids do
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    return docs.mapInArrow(run, _PIECES + ", part int, nth bigint" + (", ids array<int>" if with_ids else ""))


def pack_best_fit(docs: DataFrame, tokenizer: str = TOKENIZER, tokens: int = TOKENS, with_ids: bool = True) -> DataFrame:
    """Pieces of each row's ids (its text's and END_ID) in as few sequences of ``tokens`` as the plan
    finds: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, ``with_ids``, ids.

    Ids of more than ``tokens`` are cut: pieces of ``tokens``, but for the first, which has the rest.
    A null or empty text is END_ID alone. Rows that repeat a doc_id, and rows with a null doc_id, are
    packed each for itself. The literal of an added token in a text gets that token's id. Other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(pieces_of(docs, tokenizer, tokens, with_ids))
    sizes = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(tokens + 1, np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    places = spark.sparkContext.broadcast(Places(plan(counts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = pieces.join(sizes, ["part", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches):
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "number"))
            sequence, offset = places.value.of(length, number)
            own = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = _PIECES + (", ids array<int>" if with_ids else "") + ", sequence_id bigint, offset bigint"
    return placed.select(*names, "number").mapInArrow(place, schema)


def op12_best_fit(spark, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), with_ids=False)
