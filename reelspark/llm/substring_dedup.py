"""Substring dedup (operator 5): fixed-block anchors.

Non-overlapping blocks of ``anchor`` words index the corpus, and every rolling window of as
many words probes that index. With windows of ``2 * anchor - 1`` words each window holds exactly
one whole aligned block, so a window that two documents share has an aligned block in each of
them that the other's rolling windows hit. Hits are extended to all windows around them, whose
first document is found; overlapping ones make up the maximal exact repeats that go.

Hashes cross the shuffles as sorted arrays, each value once for each task: a passage that a
third of the documents share is as many values as there are tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm import copies
from reelspark.llm.common import MULTIPLIER_2, column, cut, dealt, digest, id_bitmap, kept_by, mix, partitions, small_batches, table, text_bytes, window_hashes, word_table, words_of

#: Words of a window whose repeats go; blocks have (WINDOW_WORDS + 1) // 2.
WINDOW_WORDS = 13
#: Words whose hashes meet in one bucket, and words that a task gathers before it sends them.
BUCKET_WORDS = 4_000_000
FLUSH_WORDS = 3_000_000

_BLOB = "bucket int, payload binary"
_PLACES = "doc_id bigint, tag bigint, starts binary"
_BLOB_SCHEMA = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each with its type and length."""
    return b"".join(f"{a.dtype.str}:{len(a)};".encode() + a.tobytes() for a in arrays)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        end = data.index(b";", at)
        kind, n = data[at:end].decode().split(":")
        out.append(np.frombuffer(data, np.dtype(kind), int(n), end + 1))
        at = end + 1 + out[-1].nbytes
    return out


def pack_sorted(values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 56-bit values as the low 40 bits of their steps, where that suffices."""
    steps = np.diff(values, prepend=np.uint64(0))
    if not len(values) or steps[1:].max(initial=0) >= 1 << 40:
        return [values]
    first, steps = steps[:1], steps.copy()
    steps[0] = 0
    return [first, np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :5]).reshape(-1)]


def unpack_sorted(arrays: list[np.ndarray]) -> np.ndarray:
    if len(arrays) == 1:
        return arrays[0]
    wide = np.zeros((len(arrays[1]) // 5, 8), np.uint8)
    wide[:, :5] = arrays[1].reshape(-1, 5)
    return arrays[0][0] + np.cumsum(wide.view(np.uint64).reshape(-1), dtype=np.uint64)


def bucket_edges(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Places in the sorted keys where each bucket begins, and the end."""
    edges = [(b << bits) // buckets for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]])


def runs(*values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(values[0]):
        return []
    edge = [0, *(np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1).tolist(), len(values[0])]
    return list(zip(edge, edge[1:], strict=False))


def anchors(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blobs of rolling-window hashes of ``size`` words and of the aligned blocks among them."""
    seen: set[bytes] = set()
    hashes: list[np.ndarray] = []
    docs: list[int] = []
    n = 0

    def flush():
        lengths = np.array([len(h) for h in hashes])
        h = np.concatenate(hashes) >> np.uint64(8)
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)
        place = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.argsort(h, kind="stable")  # by document among equal hashes
        h, owner, place = h[order], owner[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(h)) - 1
        several = owner[start] != owner[last]
        values = h[start]
        rank = np.cumsum(new) - 1
        aligned = np.flatnonzero(place % size == 0)
        edges = bucket_edges(values, buckets, 56)
        cut_at = np.searchsorted(rank[aligned], edges)
        ids = np.array(docs, np.int64)
        for b in range(buckets):
            lo, hi = edges[b], edges[b + 1]
            if lo == hi:
                continue
            own = aligned[cut_at[b] : cut_at[b + 1]]
            own = own[np.lexsort((place[own], owner[own]))]
            blob = pack((rank[own] - lo).astype(np.uint32), ids[owner[own]], (place[own] // size).astype(np.int32), np.packbits(several[lo:hi]), *pack_sorted(values[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], schema=_BLOB_SCHEMA)

    for batch in small_batches(batches):
        words = word_table(batch)
        for k, doc in enumerate(column(batch, "doc_id")):
            own = words.of(k)
            if len(own) < 2 * size - 1 or (key := digest(own)) in seen:
                continue
            seen.add(key)
            hashes.append(window_hashes(own, size))
            docs.append(doc)
            n += len(own)
        if n >= FLUSH_WORDS:
            yield from flush()
            hashes, docs, n = [], [], 0
    if docs:
        yield from flush()


def by_home(ids: np.ndarray, tags: np.ndarray, places: np.ndarray, homes: int) -> pd.DataFrame:
    """Places in documents' texts, packed by the home of the documents: few rows whatever the buckets."""
    home = (mix(ids.view(np.uint64)) % np.uint64(homes)).astype(np.int64)
    order = np.lexsort((places, tags, ids, home))
    ids, tags, places, home = ids[order], tags[order], places[order], home[order]
    out: dict[str, list] = {"home": [], "payload": []}
    for a, b in runs(home):
        spans = runs(ids[a:b], tags[a:b])
        first = [x for x, _ in spans]
        out["home"].append(int(home[a]))
        out["payload"].append(pack(ids[a:b][first], tags[a:b][first], np.array([y - x for x, y in spans], np.int32), places[a:b]))
    return pd.DataFrame(out)


def tag_of(sha256: bytes) -> int:
    """64 bits that tell texts of one doc_id apart."""
    return int.from_bytes(sha256[:8], "little", signed=True)


def hit_blocks(pdf: pd.DataFrame, homes: int) -> pd.DataFrame:
    """Of one bucket: the aligned blocks whose hash another document has at any place, packed by
    the home of their documents."""
    parts = [unpack(p) for p in pdf["payload"]]
    values = [unpack_sorted(p[4:]) for p in parts]
    several = [np.unpackbits(p[3], count=len(v)).astype(bool) for p, v in zip(parts, values, strict=True)]
    every = np.sort(np.concatenate(values))
    # a value twice comes from two tasks or flushes, whose documents differ
    shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(v[s] for v, s in zip(values, several, strict=True))]))
    keep = [np.isin(v, shared, assume_unique=True)[p[0]] for p, v in zip(parts, values, strict=True)]
    ids, blocks = (np.concatenate([p[k][x] for p, x in zip(parts, keep, strict=True)]) for k in (1, 2))
    return by_home(ids, np.zeros(len(ids), np.int64), blocks, homes)


def windows(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blobs of the windows around hit blocks: the first document's of each in this task, and
    as finished rows those that an earlier document of the task has."""
    block = (size + 1) // 2
    held: list[tuple] = []
    n = 0

    def flush():
        h, g, doc, tag, start = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((start, doc, g, h))
        h, g, doc, tag, start = (x[order] for x in (h, g, doc, tag, start))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        leader = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        own = doc == doc[leader]
        edges = bucket_edges(h, buckets, 64)
        for b in range(buckets):
            lo, hi = edges[b], edges[b + 1]
            if lo < hi:
                k = own[lo:hi]
                part = [x[lo:hi][k] for x in (h, g, doc, tag, start)]
                by = np.lexsort((part[4], part[2]))
                done = [x[lo:hi][~k] for x in (doc, tag, start)]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([pack(*(x[by] for x in part), *done)], pa.binary())], schema=_BLOB_SCHEMA)

    for batch in small_batches(batches):
        words = word_table(batch)
        for k, (doc, found) in enumerate(zip(column(batch, "doc_id"), column(batch, "hits"), strict=True)):
            hits = np.concatenate([np.frombuffer(x, np.int32) for x in found])
            h = words.of(k)
            starts = (hits.astype(np.int64)[:, None] * block - np.arange(block)[None, :]).reshape(-1)
            starts = np.unique(starts[(starts >= 0) & (starts <= len(h) - size)])
            if len(starts):
                held.append((window_hashes(h, size)[starts], (window_hashes(h, size, MULTIPLIER_2)[starts] >> np.uint64(32)).astype(np.uint32), np.full(len(starts), doc, np.int64), np.full(len(starts), tag_of(hashlib.sha256(copies.joined(words, k)).digest()), np.int64), starts.astype(np.int32)))
                n += len(starts)
        if n >= FLUSH_WORDS // 3:
            yield from flush()
            held, n = [], 0
    if held:
        yield from flush()


def repeated(pdf: pd.DataFrame, homes: int) -> pd.DataFrame:
    """Of one bucket: the windows whose words start in a document with a smaller id too, packed by
    the home of their documents."""
    parts = [unpack(p) for p in pdf["payload"]]
    h, g, doc, tag, start = (np.concatenate([p[k] for p in parts]) for k in range(5))
    order = np.lexsort((doc, g, h))
    h, g, doc, tag, start = (x[order] for x in (h, g, doc, tag, start))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    leader = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    late = doc != doc[leader]
    ids, tags, starts = (np.concatenate([x[late], *(p[k] for p in parts)]) for x, k in ((doc, 5), (tag, 6), (start, 7)))
    return by_home(ids, tags, starts, homes)


def by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one home: a row for each document's text with its places."""
    parts = [unpack(p) for p in pdf["payload"]]
    ids, tags = (np.concatenate([np.repeat(p[k], p[2]) for p in parts]) for k in (0, 1))
    starts = np.concatenate([p[3] for p in parts])
    order = np.lexsort((tags, ids))
    ids, tags, starts = ids[order], tags[order], starts[order]
    spans = runs(ids, tags)
    first = [a for a, _ in spans]
    return pd.DataFrame({"doc_id": ids[first], "tag": tags[first], "starts": [starts[a:b].tobytes() for a, b in spans]})


def covered(n_words: int, starts: np.ndarray, size: int) -> np.ndarray:
    """The words that windows at ``starts`` cover."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for each row of ``docs``.

    A word goes when a window of ``size`` consecutive words of its document covers it whose words
    also start somewhere in a document with a smaller doc_id; the input decides, not what is left.
    ``kept_text`` is null where nothing goes (the text stays) and else the kept words, joined by
    one space. Null, empty and shorter texts lose nothing. Rows that repeat a doc_id are each judged by
    their own words against smaller doc_ids, not against each other. Rows with a null
    doc_id give none, other columns are not read, an empty table gives no rows. ``size`` is odd.
    """
    if size % 2 == 0:
        raise ValueError("the window must have an odd number of words")
    block = (size + 1) // 2
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows = cut(docs.mapInArrow(copies.facts(False, sha=True), copies.FACTS))
    text = ["rep", "sha256"]  # of rows with one doc_id the words tell which text is meant
    classes = cut(copies.classes(rows.where(F.col("n_words") >= size), "sha256"))
    buckets = partitions(spark, rows.agg(F.sum("n_words")).first()[0] or 0, BUCKET_WORDS)

    blobs = docs.mapInArrow(lambda b: anchors(b, block, buckets), _BLOB)
    found = dealt(blobs, "bucket", buckets).groupBy("bucket").applyInPandas(lambda pdf: hit_blocks(pdf, buckets), "home int, payload binary")
    hits = dealt(found, "home", buckets).groupBy("home").applyInPandas(by_document, _PLACES)
    # a task reads one copy of its own; hits count for the class, whose first document stands for it
    member = rows.select("doc_id", *text).distinct().join(classes, text).select("doc_id", "first")
    hits = cut(hits.join(member, "doc_id").groupBy(F.col("first").alias("doc_id")).agg(F.collect_list("starts").alias("hits")))

    bits = spark.sparkContext.broadcast(id_bitmap(hits, "doc_id"))
    near = docs.mapInArrow(lambda b: kept_by(bits.value)(b), "doc_id bigint, text string").join(hits, "doc_id")
    blobs = near.mapInArrow(lambda b: windows(b, size, buckets), _BLOB)
    found = dealt(blobs, "bucket", buckets).groupBy("bucket").applyInPandas(lambda pdf: repeated(pdf, buckets), "home int, payload binary")
    late = cut(dealt(found, "home", buckets).groupBy("home").applyInPandas(by_document, _PLACES))

    late_bits = spark.sparkContext.broadcast(id_bitmap(late, "doc_id"))

    def rewrite(batches):
        for batch in small_batches(batches):
            out = []
            for doc, text, tag, starts in zip(column(batch, "doc_id"), text_bytes(batch), column(batch, "tag"), column(batch, "starts"), strict=True):
                words = words_of(text)
                whole = hashlib.sha256(b" ".join(words))
                if tag_of(whole.digest()) != tag:
                    continue  # the places are another text's of this doc_id
                gone = covered(len(words), np.frombuffer(starts, np.int32), size)
                kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
                out.append((doc, whole.hexdigest(), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "sha256", "n_removed", "sha", "kept_text"])

    touched = docs.mapInArrow(lambda b: kept_by(late_bits.value)(b), "doc_id bigint, text string").join(late, "doc_id").mapInArrow(rewrite, "doc_id bigint, sha256 string, n_removed bigint, sha string, kept_text string")
    # of repeated rows one tells for all; the sort by these columns serves the join as well
    again = F.lag(F.lit(1)).over(Window.partitionBy("doc_id", "sha256").orderBy("n_removed"))
    touched = touched.withColumn("again", again).where("again is null").drop("again")
    out = rows.join(classes, text, "left").join(touched, ["doc_id", "sha256"], "left")
    later = F.col("doc_id") > F.col("first")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id",
        "n_words",
        F.when(later, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(later, nothing).otherwise(F.coalesce("sha", "sha256")).alias("kept_sha256"),
        F.when(later, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS g FROM d, unnest(range(1, len(w) - 11)) AS u(i)),
again AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS least FROM windows) x WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM again, unnest(range(13)) AS t(o)),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) p ANTI JOIN gone USING (doc_id, i) GROUP BY p.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
