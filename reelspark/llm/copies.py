"""Exact copies, found without bringing a group of copies into one task.

Each task names the least id among its copies of a word sequence; only those local
representatives meet in a shuffle, at most one for each task and sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import Words, column, digest, give_back, small_batches, word_table, words_of

FACTS = "doc_id bigint, rep bigint, digest binary, n_words bigint, n_extra bigint, sig binary, sha256 string"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("rep", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64()), ("n_extra", pa.int64()), ("sig", pa.binary()), ("sha256", pa.string())])

_SPACES = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def joined(words: Words, k: int) -> bytes:
    """The words of text ``k``, joined by one space."""
    a, b = words.first[k], words.first[k + 1]
    if a == b:
        return b""
    text = words.data[words.starts[a] : words.ends[b - 1]].tobytes()
    if (words.starts[a + 1 : b] - words.ends[a : b - 1] == 1).all():
        return text.translate(_SPACES)
    return b" ".join(words_of(text))


def facts(lower: bool, extra: Callable | None = None, sha: bool = False, more: Callable | None = None) -> Callable:
    """A mapInArrow function over (doc_id, text): a row for each document, with its task's
    representative ``rep`` and, on the representative's row alone, the digest of its words.

    ``extra(words, k)`` gives a number and bytes for the first copy of a word sequence; ``more()``
    gives batches of other rows, with null doc_id, when all texts are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        least: dict[bytes, list] = {}
        for batch in small_batches(batches):
            words = word_table(batch, lower=lower)
            for k, doc in enumerate(column(batch, "doc_id")):
                own = words.of(k)
                key = digest(own)
                if (known := least.get(key)) is None:
                    known = least[key] = [doc, *(extra(words, k) if extra else (0, None))]
                elif doc < known[0]:
                    known[0] = doc
                rows.append((doc, key, len(own), hashlib.sha256(joined(words, k)).hexdigest() if sha else None))
        for start in range(0, len(rows), 20_000):
            part = rows[start : start + 20_000]
            known = [least[r[1]] for r in part]
            firsts = [r[0] == x[0] for r, x in zip(part, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in part], pa.int64()),
                    pa.array([x[0] for x in known], pa.int64()),
                    pa.array([r[1] if f else None for r, f in zip(part, firsts, strict=True)], pa.binary()),
                    pa.array([r[2] for r in part], pa.int64()),
                    pa.array([x[1] for x in known], pa.int64()),
                    pa.array([x[2] if f else None for x, f in zip(known, firsts, strict=True)], pa.binary()),
                    pa.array([r[3] for r in part], pa.string()),
                ],
                schema=SCHEMA,
            )
        if more:
            yield from more()
        del rows, least
        give_back()

    return run


def classes(rows: DataFrame, *more: str) -> DataFrame:
    """(rep, first, columns ``more`` that the words decide): for each task's representative the least id with the same words anywhere.

    One shuffle by digest; its groups hold a row for each task at most.
    """
    same = Window.partitionBy("digest")
    reps = rows.where("digest is not null").select("rep", "digest", *more)
    return reps.withColumn("first", F.min("rep").over(same)).dropDuplicates(["digest", "rep"]).select("rep", "first", *more)
