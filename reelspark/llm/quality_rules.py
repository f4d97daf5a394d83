"""Quality rules (operator 6): an isolation forest on rule statistics.

Statistics of every whole text are taken in one pass. Trees of random splits are grown on a
bounded sample of statistics; a document that few splits set apart is anomalous. The score from
which documents go is the one that parts labelled junk from labelled good rows best.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import Words, cut, hash_below, hashed, small_batches, table, window_hashes, word_table

MIN_WORDS = 50
REPEAT_WORDS = 3
SYMBOLS = b"#*$%&|<>"
#: Sampled rows of statistics, trees, rows of a tree and its depth.
SAMPLE_ROWS = 8192
TREES = 100
TREE_ROWS = 256
DEPTH = 10
#: Bins of the score for the calibration.
BINS = 2000

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_STATS_DDL = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in STATS)

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IN_WORD = np.array([(b & 0xC0) != 0x80 and b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


class Forest(NamedTuple):
    """Trees as arrays: feature (-1: leaf), split value, left child, path length at a leaf."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    length: np.ndarray
    threshold: float


def repeat_words(hashes: np.ndarray, size: int = REPEAT_WORDS) -> int:
    """Words in windows of ``size`` words that are found twice or more."""
    windows = window_hashes(hashes, size)
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.isin(windows, twice)
    words = np.zeros(len(hashes), bool)
    for k in range(size):
        words[k : k + len(at)] |= at
    return int(words.sum())


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def stats_of(words: Words) -> list[np.ndarray]:
    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags[words.data])])
        return sums[words.offsets[1:]] - sums[words.offsets[:-1]]

    texts = range(len(words.offsets) - 1)
    return [
        np.diff(words.first),
        total(_IN_WORD),
        total(_IS_SYMBOL),
        np.array([dup_lines(words.text(k)) for k in texts], np.int64),
        np.array([repeat_words(words.of(k)) for k in texts], np.int64),
    ]


def rule_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each row."""

    def run(batches):
        for batch in small_batches(batches):
            found = stats_of(word_table(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in found)], names=["doc_id", *STATS])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _STATS_DDL)


def base_failed(stats: list[np.ndarray]) -> np.ndarray:
    return (stats[0] < MIN_WORDS) | (100 * stats[4] > 50 * stats[0])


def features(stats: list[np.ndarray]) -> np.ndarray:
    words, chars, symbols, lines, repeats = (x.astype(float) for x in stats)
    n = np.maximum(words, 1)
    return np.stack([np.log1p(words), chars / n, np.log1p(100 * symbols / n), np.log1p(1000 * lines / n), repeats / n], axis=1)


def usual_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(rows: np.ndarray, seed: int = 6) -> Forest:
    rng = np.random.default_rng(seed)
    size = 2 ** (DEPTH + 1)
    feature, split = np.full((TREES, size), -1, np.int64), np.zeros((TREES, size))
    left, length = np.zeros((TREES, size), np.int64), np.zeros((TREES, size))
    for t in range(TREES):
        used = 1
        todo = [(0, 0, rows[rng.permutation(len(rows))[:TREE_ROWS]])]
        while todo:
            node, depth, own = todo.pop()
            low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(rows.shape[1]),) * 2
            wide = np.flatnonzero(high > low)
            if depth == DEPTH or not len(wide):
                length[t, node] = depth + usual_path(len(own))
                continue
            f = int(rng.choice(wide))
            at = rng.uniform(low[f], high[f])
            feature[t, node], split[t, node], left[t, node] = f, at, used
            below = own[:, f] < at
            todo += [(used, depth + 1, own[below]), (used + 1, depth + 1, own[~below])]
            used += 2
    return Forest(feature, split, left, length, math.inf)


def score(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Anomaly from 0 to 1."""
    paths = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, split, left, length in zip(forest.feature, forest.split, forest.left, forest.length, strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = feature[node]
            step = left[node] + (x[rows, np.maximum(f, 0)] >= split[node])
            node = np.where(f < 0, node, step)
        paths += length[node]
    return 2.0 ** (-paths / len(forest.feature) / usual_path(TREE_ROWS))


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with base_failed, anomaly and kept."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            found = [batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(STATS))]
            failed, anomaly = base_failed(found), score(shared.value, features(found))
            kept = ~failed & (anomaly < shared.value.threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(anomaly), pa.array(kept)], names=[*batch.schema.names, "base_failed", "anomaly", "kept"])

    return stats.mapInArrow(run, f"{_STATS_DDL}, base_failed boolean, anomaly double, kept boolean")


def best_threshold(counts: list[tuple[int, int, int]]) -> float:
    """Least score that goes, from (bin, quality, rows) of labelled rows: where the share of junk
    (quality 0) that goes less that of good rows (quality 1) is greatest; a bin goes whole, and of
    equal differences the one with fewer rows gone holds. However few the labels, they decide; while
    either kind has no row, that share is unknown and nothing is anomalous."""
    total, bins = [0, 0], {}
    for at, kind, n in counts:
        total[kind] += n
        bins.setdefault(at, [0, 0])[kind] += n
    if not all(total):
        return math.inf
    gone, best, threshold = [0, 0], 0, math.inf
    for at in sorted(bins, reverse=True):
        gone = [a + b for a, b in zip(gone, bins[at], strict=True)]
        gain = gone[0] * total[1] - gone[1] * total[0]
        if gain > best:
            best, threshold = gain, at / BINS
    return threshold


def fit(stats: DataFrame, labels: DataFrame) -> Forest:
    """Forest on at most about SAMPLE_ROWS rows that pass the base rule, chosen by a hash of
    doc_id; threshold from all labelled rows (doc_id, quality) that pass it, of both values, by
    counts in BINS bins of the score."""
    passed = stats.where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= 50 * n_words")
    rows = passed.where(hashed("doc_id") < hash_below(SAMPLE_ROWS, passed.count())).orderBy("doc_id", *STATS).collect()
    if not rows:
        return grow(np.zeros((1, len(STATS))))
    forest = grow(features([np.array([r[c] for r in rows], np.int64) for c in STATS]))
    judged = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    known = scored(passed, forest).join(judged, "doc_id").select(F.floor(F.col("anomaly") * BINS).alias("bin"), "quality")
    counts = known.groupBy("bin", "quality").count().collect()
    return forest._replace(threshold=best_threshold([(r.bin, r.quality, r["count"]) for r in counts]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base_failed, anomaly and kept of each row of ``docs`` (doc_id, text).

    Words are runs of other than space and \\x09-\\x0D; a null or empty text has none and fails the
    base rule (fewer than MIN_WORDS words, or over half of the words in repeated windows). Repeated
    rows are judged alike, other columns are not read, an empty table gives no rows.
    """
    stats = cut(rule_stats(docs))
    return scored(stats, fit(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`quality` keeps. Their statistics
    are taken anew beside the texts, so that no text is shuffled."""
    forest = fit(cut(rule_stats(docs)), labels)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in small_batches(batches):
            found = stats_of(word_table(batch))
            yield batch.filter(pa.array(~base_failed(found) & (score(shared.value, features(found)) < shared.value.threshold)))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
