"""Packing (operator 8): vector bin packing by a dot-product heuristic.

A sequence has simultaneous limits on tokens, segments and loss-bearing tokens. The open sequence
takes the piece whose demand has the largest dot product with what is left of the limits; where
texts may be cut, a piece is cut to fill the rest exactly. Each task packs its own rows in groups
of bounded size and hands what doesn't fill a sequence to its next group, so only the last
sequence of a task is short, and nothing is shuffled.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import column, give_back, small_batches, table, word_table, words_in

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Appended to each text's ids.
END_ID = 1
TOKENS = 2048
SEGMENTS = 256
#: Tokens that a task gathers before it packs.
GROUP_TOKENS = 1_000_000
#: Distinct words that a task remembers, and the ids that they have together (24 and 4 bytes each).
KNOWN_WORDS = 1_000_000
KNOWN_IDS = 8_000_000
#: Words that the tokenizer gets in one string.
WORDS_AT_ONCE = 64

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class WordIds:
    """Ids of texts by the tokenizer, word by word: its rules never reach over white space or from
    ASCII letters to punctuation, part each digit 0-9 from whatever is beside it, and do not tell A-Z
    from a-z.

    A text with the literal of one of its added tokens goes through the tokenizer whole and gets that
    token's id there, or, with ``plain``, ordinary ids.
    """

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in added)) if added else None
        self.digits = [e.ids for e in self.tokenizer.encode_batch_fast(list("0123456789"), add_special_tokens=False)]
        apart = self.tokenizer.encode("a0.0\u03010", add_special_tokens=False).ids
        if any(len(d) != 1 for d in self.digits) or apart.count(self.digits[0][0]) != 3:
            raise ValueError(f"{path} doesn't part digits from what is beside them")
        self.clear()

    def clear(self) -> None:
        """Forgets all words but the digits, which are never learned, as 0 ends each word there."""
        digits = words_in(np.frombuffer(b"0123456789", np.uint8), np.arange(11))
        order = np.argsort(digits.hashes)
        self.hashes, self.at, self.length = digits.hashes[order], order.astype(np.int64), np.ones(10, np.int64)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 10
        self.flat[:10] = np.concatenate(self.digits)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the words ``data[starts[k]:ends[k]]`` lie, and how many they are."""
        sizes = ends - starts + 1
        edges = np.cumsum(sizes)
        joined = np.full(int(edges[-1]), ord("0"), np.uint8)
        inside = np.ones(len(joined), bool)
        inside[edges - 1] = False
        joined[inside] = data[np.repeat(starts - (edges - sizes) + np.arange(len(sizes)), sizes - 1) + np.arange(len(joined) - len(sizes))]
        raw = joined.tobytes()
        cuts = [0, *edges[WORDS_AT_ONCE - 1 : -1 : WORDS_AT_ONCE].tolist(), len(raw)]
        encoded = self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(cuts)], add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in encoded), np.uint32)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        last = np.flatnonzero(ids == self.digits[0][0])
        first = np.concatenate([[0], last[:-1] + 1])
        at = self.used + first
        self.used += len(ids)
        return at, last - first

    def of(self, batch: pa.RecordBatch, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the batch's texts one after the other, and where each begins."""
        if len(self.hashes) > KNOWN_WORDS or self.used > KNOWN_IDS:
            self.clear()
        words = word_table(batch, lower=True, parted=True)
        distinct, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        new = np.flatnonzero(self.hashes[np.minimum(place, len(self.hashes) - 1)] != distinct)
        if len(new):
            at, length = self.learn(words.data, words.starts[first[new]], words.ends[first[new]])
            before = place[new]
            self.hashes, self.at, self.length = (np.insert(x, before, y) for x, y in ((self.hashes, distinct[new]), (self.at, at), (self.length, length)))
            place = np.searchsorted(self.hashes, distinct)
        sizes = self.length[place][which]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.at[place][which] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        edges = np.concatenate([[0], ends])[words.first]
        whole = [k for k in range(len(edges) - 1) if self.added.search(words.text(k))] if self.added and self.added.search(words.data.tobytes()) else []
        if whole:
            parts = np.split(ids, edges[1:-1])
            for k in whole:
                parts[k] = np.array(self.tokenizer.encode(words.text(k).decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            ids, edges = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        if end_id is not None:
            ids = np.insert(ids, edges[1:], end_id)
            edges = edges + np.arange(len(edges))
        return ids, edges


class Packer:
    """Packs pieces (key, start, length, loss) into numbered sequences."""

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool) -> None:
        self.limit = np.array([tokens, segments, loss], float)
        self.cut = cut
        self.number = 0

    def pack(self, pieces: list[tuple], last: bool) -> tuple[list[tuple], list[tuple]]:
        """Placed pieces (key, start, length, sequence, offset), and pieces that are left because
        they don't fill a sequence, unless this is the ``last`` group."""
        size, most = int(self.limit[0]), self.limit
        by_kind: dict[tuple[int, int], list] = defaultdict(list)
        placed: list[tuple] = []
        rest = 0
        for key, start, length, loss in pieces:
            if self.cut:
                while length >= size and loss == length <= most[2] + length - size:
                    placed.append((key, start, size, self.number, 0))
                    self.number += 1
                    start, length, loss = start + size, length - size, loss - size
                if not length:
                    continue
            elif length > size or loss > most[2]:
                raise ValueError(f"an example of {length} tokens ({loss} with loss) exceeds the limits")
            by_kind[length, loss].append((key, start))
            rest += length
        kinds = sorted(by_kind)
        index = {k: n for n, k in enumerate(kinds)}
        demand = np.array([(a, 1, b) for a, b in kinds], float).reshape(-1, 3)
        weight = demand / most
        count = np.array([len(by_kind[k]) for k in kinds])

        def take(n: int):
            count[n] -= 1
            return by_kind[kinds[n]].pop()

        while count.any() and (last or rest >= size):
            free, offset = most.copy(), 0
            while True:
                fits = np.flatnonzero((count > 0) & (demand <= free).all(axis=1))
                if len(fits):
                    n = int(fits[np.argmax(weight[fits] @ (free / most))])
                    length, loss = kinds[n]
                    key, start = take(n)
                elif self.cut and free[0] >= 1 and free[1] >= 1 and free[2] >= free[0] and count.any():
                    whole = np.flatnonzero((count > 0) & (demand[:, 0] == demand[:, 2]))
                    if not len(whole):
                        break
                    n = int(whole[-1])
                    key, start = take(n)
                    length = loss = int(free[0])
                    kind = (kinds[n][0] - length,) * 2
                    by_kind[kind].append((key, start + length))
                    if kind in index:
                        count[index[kind]] += 1
                    else:
                        at = len(kinds)
                        index[kind] = at
                        kinds.append(kind)
                        demand = np.vstack([demand, [kind[0], 1, kind[1]]])
                        weight, count = demand / most, np.append(count, 1)
                else:
                    break
                placed.append((key, start, length, self.number, offset))
                offset += length
                rest -= length
                free -= (length, 1, loss)
            self.number += 1
        left = [(key, start, *kind) for kind, own in by_kind.items() for key, start in own]
        return placed, left


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, tokens: int = TOKENS, segments: int = SEGMENTS, with_ids: bool = True, plain: bool = False) -> DataFrame:
    """Pieces of each row's ids (its text's and END_ID) in sequences of at most ``tokens``.

    The literal of an added token, such as <|endoftext|>, in a text gets that token's id, as the
    tokenizer does it; with ``plain`` it is ordinary text.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, ``with_ids``,
    ids. All ids bear loss. A null or empty text is END_ID alone; repeated rows and null ids are
    packed like others; other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = WordIds(tokenizer, plain), Packer(tokens, segments, tokens, True)
        base = TaskContext.get().partitionId() << 32
        doc: dict[int, tuple] = {}  # by row: doc_id, ids
        pieces: list[tuple] = []
        n_row = n_tokens = 0

        def flush(last: bool):
            nonlocal pieces, n_tokens
            placed, pieces = packer.pack(pieces, last)
            rows = []
            for key, start, length, sequence, offset in placed:
                doc_id, ids = doc[key]
                own = ids[start : start + length]
                rows.append((doc_id, start, length, zlib.crc32(own), len(ids), base + sequence, offset, *([own] if with_ids else [])))
            for a in range(0, len(rows), 5000):
                columns = list(zip(*rows[a : a + 5000], strict=True))
                arrays = [pa.array(x, pa.int64()) for x in columns[:7]]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, columns[7])]).astype(np.int32), pa.array(np.concatenate(columns[7]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=[*(c.split()[0] for c in _PIECES.split(", ")), *(["ids"] if with_ids else [])])
            held = {p[0] for p in pieces}
            for key in [k for k in doc if k not in held]:
                del doc[key]
            n_tokens = sum(p[2] for p in pieces)

        for batch in small_batches(batches):
            ids, edges = encoder.of(batch)
            for k, doc_id in enumerate(column(batch, "doc_id")):
                own = np.ascontiguousarray(ids[edges[k] : edges[k + 1]], "<u4")
                doc[n_row] = (doc_id, own)
                pieces.append((n_row, 0, len(own), len(own)))
                n_row += 1
            n_tokens += len(ids)
            if n_tokens > GROUP_TOKENS:
                yield from flush(False)
        yield from flush(True)
        del encoder, doc, pieces
        give_back()

    return docs.mapInArrow(run, _PIECES + (", ids array<int>" if with_ids else ""))


def pack_examples(examples: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = TOKENS) -> DataFrame:
    """Whole instruction examples (example_id bigint, n_tokens, n_loss) in sequences under all three
    limits: (example_id, sequence_id, offset). Rows with nulls or without tokens are left out; an
    example beyond a limit has neither sequence nor offset. An empty table gives no rows."""
    examples = examples.selectExpr("cast(example_id as bigint) example_id", "cast(n_tokens as bigint) n_tokens", "cast(n_loss as bigint) n_loss").where("example_id is not null and n_loss is not null and n_tokens > 0")

    def run(batches):
        packer = Packer(tokens, segments, loss, False)
        base = TaskContext.get().partitionId() << 32
        pieces: list[tuple] = []

        def rows(last):
            nonlocal pieces
            placed, pieces = packer.pack(pieces, last)
            if placed:
                key, _, _, sequence, offset = zip(*placed, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array([base + s for s in sequence], pa.int64()), pa.array(offset, pa.int64())], names=["example_id", "sequence_id", "offset"])

        for batch in batches:
            pieces += [(i, 0, n, m) for i, n, m in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if len(pieces) > 20_000:
                yield from rows(False)
        yield from rows(True)

    fits = f"n_tokens <= {tokens} and n_loss <= {loss}"
    beyond = examples.where(f"not ({fits})").selectExpr("example_id", "cast(null as bigint) sequence_id", "cast(null as bigint) offset")
    return examples.where(fits).mapInArrow(run, "example_id bigint, sequence_id bigint, offset bigint").unionByName(beyond)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
