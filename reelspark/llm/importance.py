"""Target-distribution importance resampling (operator 11).

Two Arrow passes over the texts. The first counts hashed n-grams: each task fills one vector of
BUCKETS counts, and treeReduce adds the tasks' vectors. The second gathers the buckets' gains,
which are broadcast (80 KB whatever the input), and sums them by document. The highest scores are
numbered by ranges, so no task sees more than its share of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import column, cut, give_back, small_batches, table, text_buffer
from reelspark.llm.runs import byte_class, ngram_crcs, runs_in

BUCKETS = 10_000
#: Longest n-gram in words; share of the documents to draw; words that a document needs for that.
MOST_WORDS = 3
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
#: Bins of the scores, by which most documents are left out before the rest is sorted.
BINS = 4096

#: Digits, letters and every character outside ASCII.
WORD_BYTES = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def _text(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*(F.col(f"`{n}`").cast("bigint").alias(n) for n in names), F.col("text").cast("string").alias("text"))


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many features of the texts of ``rows`` fall in each bucket."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in small_batches(batches):
            for _, crc in ngram_crcs(runs_in(*text_buffer(batch), WORD_BYTES), MOST_WORDS):
                counts += np.bincount(crc % np.uint32(BUCKETS), minlength=BUCKETS)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])

    vectors = _text(rows).mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    tasks = vectors.getNumPartitions()
    if not tasks:
        return np.zeros(BUCKETS, np.int64)
    return vectors.treeReduce(lambda a, b: a + b, depth=2 if tasks < 10_000 else 3)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, a whole number, from its features in the corpus and in the target."""
    s, t = source.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gains.astype(float))

    def run(batches):
        for batch in small_batches(batches):
            runs = runs_in(*text_buffer(batch), WORD_BYTES)
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for text, crc in ngram_crcs(runs, MOST_WORDS):
                n += np.bincount(text, minlength=batch.num_rows)
                # sums of whole numbers in doubles, exact as far as 2^53
                weight += np.bincount(text, shared.value[crc % np.uint32(BUCKETS)], batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "doc_id"), pa.int64()), pa.array(np.diff(runs.first), pa.int64()), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])
        give_back()

    return _text(docs, "doc_id").mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def with_scores(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``score``: the weight and a Gumbel draw from the id's hash; null where doc_id is."""
    h = F.expr(f"cast(conv(substr(sha2(concat('{seed}:', cast(doc_id as string)), 256), 1, 8), 16, 10) as double)")
    draw = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", (F.col("weight") + draw).cast("bigint"))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their number from 1 in the order given, as column ``name``.

    Rows are dealt by ranges of the order; a row's number is its place in its partition, added to the
    sizes of the partitions before. A row for each partition is all that meets in one task.
    """
    at = F.monotonically_increasing_id()  # partition in the upper bits, place in the lower 33
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    out = placed.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return out.withColumn(name, F.col("_before") + F.expr("(_at & 8589934591) + 1")).drop("_at", "_part", "_before")


def highest(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (a written table) with ``rank``: 1, 2, 3 ... of the ``percent`` of highest scores
    among the rows with ``least_words`` words and a score, ties to the smaller doc_id; null elsewhere."""
    fits = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    n, lo, hi = scored.where(fits).agg(F.count("*"), F.min("score"), F.max("score")).first()
    draw = n * percent // 100
    none = F.lit(None).cast("bigint")
    if not draw:
        return scored.withColumn("rank", none)
    width = (hi - lo) // BINS + 1
    bins = sorted(scored.where(fits).groupBy(F.expr(f"(score - ({lo})) div {width}").alias("bin")).count().collect(), reverse=True)
    above = np.cumsum([count for _, count in bins])
    bound = lo + bins[int(np.searchsorted(above, draw))][0] * width
    may = fits & (F.col("score") >= bound)
    ranked = numbered(scored.where(may), [F.col("score").desc(), F.col("doc_id").asc()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return ranked.unionByName(scored.where(~may).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row of ``docs`` (doc_id, text).

    Features are the runs of 1 to 3 consecutive words; ``target`` (text) tells which are wanted. The
    ``percent`` of the documents with ``least_words`` words whose scores are highest have ranks. A null
    or empty text has no feature and weight 0. Rows that repeat a doc_id are documents of their own,
    with equal draws. A null doc_id has a weight, but neither score nor rank, and does not count among
    the documents to draw from; its features count. With an empty ``target`` every bucket's
    wanted share is the same; an empty ``docs`` gives no rows. Other columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    return highest(cut(with_scores(weigh(docs, gains), seed)), percent, least_words)


def op11_importance(spark, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by half bytes, low half first; its table of 16 follows from the polynomial.
ORACLE = r"""
WITH nibble AS (SELECT list(list_reduce(list_prepend(i, range(4)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(16) r(i)),
raw AS (
  SELECT doc_id, true AS own, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT NULL, false, coalesce(text, '') FROM benchmark),
texts AS (
  SELECT row_number() OVER () AS k, doc_id, own,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw),
grams AS (
  SELECT k, own, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS g FROM texts),
counted AS (SELECT k, own, g, count(*) AS n FROM grams GROUP BY k, own, g),
hexed AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM counted)),
crc AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295, [instr('0123456789ABCDEF', h[i + 1 - 2 * (i % 2) + 1]) - 1 for i in range(len(h))]),
      lambda c, b: xor(c >> 4, t[(xor(c, b) & 15) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, nibble),
hit AS (SELECT k, own, bucket, sum(n) AS n FROM counted JOIN crc USING (g) GROUP BY k, own, bucket),
tally AS (SELECT b AS bucket, coalesce(sum(n) FILTER (WHERE own), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0) AS t FROM range(10000) r(b) LEFT JOIN hit ON bucket = b GROUP BY b),
total AS (SELECT sum(s) AS s, sum(t) AS t FROM tally),
gain AS (SELECT bucket, floor(1000 * ln((tally.t + 1)::DOUBLE * (total.s + 10000)::DOUBLE / ((tally.s + 1)::DOUBLE * (total.t + 10000)::DOUBLE)))::BIGINT AS gain FROM tally, total),
weighed AS (SELECT k, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM hit JOIN gain USING (bucket) WHERE own GROUP BY k),
scored AS (
  SELECT doc_id, len(w) >= 20 AS may, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (k) WHERE own),
ranked AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY may) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND r <= 5 * n // 100 THEN r END AS rank FROM ranked
"""
