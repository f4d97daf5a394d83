"""Document fingerprints (operator 7): a Merkle tree over sections, paragraphs and sentences.

Paragraphs are lines, sections are runs of paragraphs that end where a paragraph's own digest
says so, hence an edit moves no other section's bounds. Equal roots mean equal texts; below
differing roots, sections and their leaves tell where the texts differ.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import column, small_batches, table

#: A paragraph ends its section when its digest is 0 modulo this.
SECTION = 4
#: Bytes of a sentence from which it is cut further, and leaves' digest in the fingerprint.
LONG = 400
LEAF_BYTES = 4
BUCKETS_PER_PARTITION = 4

_SENTENCE = re.compile(r"(?<=[.!?])(?= )")
_PHRASE = re.compile(r"(?<=[aiqyAQY19] )")


def node(kind: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(kind + data, digest_size=16).digest()


def leaves(paragraph: str) -> list[bytes]:
    out = []
    for sentence in _SENTENCE.split(paragraph):
        out += [node(b"0", p.encode()) for p in (_PHRASE.split(sentence) if len(sentence) > LONG else [sentence])]
    return out


def fingerprint(text: str) -> str:
    """``root:section=leaf,leaf;section=...`` in hexadecimal; the root has 128 bits."""
    sections, heads, parts = [], [], []
    below: list[bytes] = []

    def close():
        head = node(b"2", b"".join(below))
        heads.append(head)
        sections.append(head[:LEAF_BYTES].hex() + "=" + ",".join(parts))
        below.clear()
        parts.clear()

    for paragraph in text.split("\n"):
        own = leaves(paragraph)
        head = node(b"1", b"".join(own))
        below.append(head)
        parts.extend(x[:LEAF_BYTES].hex() for x in own)
        if head[0] % SECTION == 0:
            close()
    if below:
        close()
    return node(b"3", b"".join(heads)).hex() + ":" + ";".join(sections)


def differing(a: str, b: str) -> tuple[list[str], list[str]]:
    """Sections of each of two fingerprints that the other doesn't have."""
    (root, a), (other, b) = a.split(":", 1), b.split(":", 1)
    if root == other:
        return [], []
    a, b = a.split(";"), b.split(";")
    x, y = Counter(a), Counter(b)
    return list((x - y).elements()), list((y - x).elements())


def likeness(a: str, b: str) -> float:
    """Share of the leaves that both have (Dice's measure): 1 for equal roots and below 1 for others, also
    where only the order of sections or of leaves tells them apart."""
    if a.split(":", 1)[0] == b.split(":", 1)[0]:
        return 1.0
    x, y = differing(a, b)
    total = a.count(",") + a.count("=") + b.count(",") + b.count("=")
    x, y = (Counter(leaf for s in side for leaf in s.split("=")[1].split(",")) for side in (x, y))
    apart = max(1, sum((x - y).values()) + sum((y - x).values()))
    return (total - apart) / total


def dealt(docs: DataFrame) -> DataFrame:
    """Rows by ranges of doc_id ("bucket"), each followed by the first row of the next range
    ("tail" 1), and the last range by the very first row. Ranges begin at ids that occur."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = parts * BUCKETS_PER_PARTITION
    ids = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n)).first()
    bounds = np.unique(np.array([*([ids[0]] if ids[0] is not None else []), *(ids[1] or [])], np.int64))

    def run(batches):
        for batch in batches:
            doc = batch.column(0).to_numpy()
            bucket = np.searchsorted(bounds, doc, "right") - 1
            first = np.flatnonzero(bounds[bucket] == doc)
            rows = np.concatenate([np.arange(len(doc)), first])
            at = np.concatenate([bucket, (bucket[first] - 1) % len(bounds)])
            tail = np.concatenate([np.zeros(len(doc), np.int32), np.ones(len(first), np.int32)])
            picked = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(tail), *picked.columns], names=["bucket", "tail", "doc_id", "text"])

    out = docs.mapInArrow(run, "bucket int, tail int, doc_id bigint, text string")
    return out.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row beside the one that follows it in its bucket."""
    last = None  # bucket, doc_id, text, fingerprint
    for batch in small_batches(batches):
        out = []
        for bucket, tail, doc, text in zip(*(column(batch, c) for c in ("bucket", "tail", "doc_id", "text")), strict=True):
            if tail and (last is None or last[0] != bucket):
                continue
            text = text or ""
            own = fingerprint(text)
            if last is not None and last[0] == bucket:
                _, before, was, print_ = last
                n = len(was) // 2
                edited = was[: len(was) - n] + text[:n]
                of_edited = fingerprint(edited)
                out.append((before, len(was), hashlib.sha256(edited.encode()).hexdigest(), print_, of_edited, likeness(print_, of_edited), likeness(print_, own)))
            last = None if tail else (bucket, doc, text, own)
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _OUT.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are, for each row.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next row's text, by ascending doc_id and then text; the first follows the last. A
    null text counts as empty, whose fingerprint is the empty line's. Of one row alone the next is
    itself. Rows with null doc_id give none, other columns are not read, an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    return dealt(docs).mapInArrow(compared, _OUT)


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
