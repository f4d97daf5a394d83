"""Source divergence audit (operator 13) by integer-dictionary encoding.

Terms are counted by language and source in one scan. The (language, term) pairs are then dealt by
ranges, so that each partition holds a sorted slice of every language's dictionary: a chunk. There the
terms that enough documents have are kept, searchsorted turns them into ids that preserve UTF-8 order,
and bincount by group makes dense vectors of counts, a stretch of the chunk at a time. Sums of the
vectors' divergences and each group's few best terms leave the chunk; no task sees a whole dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import give_back, small_batches, table, text_buffer
from reelspark.llm.common import cut as written
from reelspark.llm.runs import byte_class, runs_in

#: Documents of a language that a kept term needs, and terms that a group shows.
LEAST_DOCUMENTS = 10
TOP = 10
#: Shares are whole numbers of this unit; a count is raised by PRIOR.
UNIT_DIGITS = 9
PRIOR = 2
#: Cells (groups times terms) of the dense vectors that a task holds at a time.
CELLS = 1 << 20

#: Letters of ASCII and every character outside it.
TERM_BYTES = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_COUNTS = "lang string, source string, term binary, n bigint, docs bigint"
_FOUND = "lang string, source string, part string, item binary, value bigint"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in the group and documents with it, and
    for every group a row with an empty term. Counts are added up by batch, by task, then by key."""
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=4 << 20):
            group: dict[tuple, int] = {}
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            own = np.fromiter((group.setdefault(x, len(group)) for x in names), np.int64, batch.num_rows)
            runs = runs_in(*text_buffer(batch), TERM_BYTES)
            coded = runs.strings().dictionary_encode()
            size = max(1, len(coded.dictionary))
            in_text, n = np.unique(runs.texts() * size + coded.indices.to_numpy(), return_counts=True)
            keys, which = np.unique(own[in_text // size] * size + in_text % size, return_inverse=True)
            of_group = pa.array(np.append(keys // size, np.arange(len(group))))
            terms = pa.concat_arrays([coded.dictionary.cast(pa.binary()).take(pa.array(keys % size)), pa.array([b""] * len(group), pa.binary())])
            none = np.zeros(len(group), np.int64)
            langs, sources = (pa.array([x[k] for x in group], pa.string()).take(of_group) for k in (0, 1))
            total = np.append(np.bincount(which, n, len(keys)).astype(np.int64), none)  # exact as far as 2^53
            texts = np.append(np.bincount(which, minlength=len(keys)), none)
            yield pa.RecordBatch.from_arrays([langs, sources, terms, pa.array(total), pa.array(texts)], names=["lang", "source", "term", "n", "docs"])
        give_back()

    return rows.mapInArrow(run, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, chunk, term, source, n, first) of the terms that ``least`` documents of their language
    have; ``first`` is 1 in one row of each term. Ranges of (lang, term) serve the windows as well."""
    by_term = Window.partitionBy("lang", "term")
    out = counts.where(F.length("term") > 0).repartitionByRange("lang", "term")
    out = out.withColumn("_docs", F.sum("docs").over(by_term)).withColumn("first", (F.row_number().over(by_term.orderBy("source")) == 1).cast("int"))
    return out.where(F.col("_docs") >= least).select("lang", F.spark_partition_id().alias("chunk"), "term", "source", "n", "first")


def shares(counts: np.ndarray, total) -> np.ndarray:
    """1 + floor(10^UNIT_DIGITS * counts / total) by long division, three digits at a time: exact for
    totals up to 9 * 10^15."""
    out, rest = np.divmod(counts, total)
    for _ in range(UNIT_DIGITS // 3):
        more, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + more
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Chunk:
    """One language's chunk: its groups with their totals first, then its terms in ascending order."""

    def __init__(self, lang: str, groups: pa.RecordBatch, top: int) -> None:
        self.lang, self.top = lang, top
        self.sources = groups.column("source").to_pylist()
        self.code = {s: k for k, s in enumerate(self.sources)}
        of_group, self.of_lang = groups.column("total").to_numpy(), groups.column("lang_total").to_numpy()[0]
        self.totals = of_group[:, None]
        self.width = max(16, CELLS // len(self.sources))
        self.sums = np.zeros((len(self.sources), len(self.sources)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in self.sources]
        self.held: list[pa.RecordBatch] = []
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.rows += batch.num_rows
        if self.rows >= self.width:
            self.flush(False)

    def flush(self, last: bool) -> None:
        """Dense vectors of the held terms; a term that may have further rows is held on."""
        if not self.rows:
            return
        held = pa.Table.from_batches(self.held)
        terms = np.array(held.column("term").to_pylist(), object)
        kept = np.unique(terms)
        ids = np.searchsorted(kept, terms)
        if not last:
            open_ = int(np.searchsorted(ids, len(kept) - 1))
            self.held, self.rows = held.slice(open_).to_batches(), held.num_rows - open_
            ids, kept, held = ids[:open_], kept[:-1], held.slice(0, open_)
        n = held.column("n").to_numpy()
        group = np.fromiter((self.code[s] for s in held.column("source").to_pylist()), np.int64, len(ids))
        for a in range(0, len(kept), self.width):
            b = min(len(kept), a + self.width)
            lo, hi = np.searchsorted(ids, (a, b))
            counts = np.zeros((len(self.sources), b - a), np.int64)
            cells = np.bincount(group[lo:hi] * (b - a) + ids[lo:hi] - a, minlength=counts.size) > 0
            counts.reshape(-1)[cells] = _sums(group[lo:hi] * (b - a) + ids[lo:hi] - a, n[lo:hi], counts.size)[cells]
            self.dense(kept[a:b], counts)

    def dense(self, kept: np.ndarray, counts: np.ndarray) -> None:
        p = shares(counts + PRIOR, self.totals)
        q = shares(counts.sum(axis=0) + PRIOR, self.of_lang)
        for k in range(len(p)):
            own = divergence(p[k], p[k + 1 :]).sum(axis=1)
            self.sums[k, k + 1 :] += own
            self.sums[k + 1 :, k] += own
            over = np.flatnonzero((counts[k] > 0) & (p[k] > q))
            value = divergence(p[k][over], q[over])
            order = np.argsort(-value, kind="stable")[: self.top]  # ids ascend with the terms, so ties do
            found = self.best[k] + list(zip(value[order].tolist(), kept[over[order]].tolist(), strict=True))
            self.best[k] = sorted(found, key=lambda x: -x[0])[: self.top]

    def found(self) -> pa.RecordBatch:
        self.flush(True)
        name = [s.encode() for s in self.sources]
        pairs = [(s, "pair", name[j], int(self.sums[i, j])) for i, s in enumerate(self.sources) for j in range(len(name)) if i != j]
        terms = [(s, "term", term, value) for s, best in zip(self.sources, self.best, strict=True) for value, term in best]
        source, part, item, value = zip(*(pairs + terms), strict=True) if pairs or terms else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(source), pa.string()), pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.binary()), pa.array(value, pa.int64())], names=[c.split()[0] for c in _FOUND.split(", ")])


def _sums(cells: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Whole sums of ``n`` by cell: bincount's doubles hold each half exactly."""
    low, high = n & 0xFFFFFFFF, n >> 32
    return np.bincount(cells, low, size).astype(np.int64) + (np.bincount(cells, high, size).astype(np.int64) << 32)


def _chunks(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, groups, at = None, [], None  # groups: rows of the chunk's groups so far
        for batch in batches:
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("chunk").to_pylist(), strict=True))
            heads = pa.compute.equal(pa.compute.binary_length(batch.column("term")), 0).to_pylist()
            edges = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1] or heads[k] != heads[k - 1]]
            for a, b in zip([0, *edges], [*edges, len(keys)], strict=True):
                if b == a:
                    continue
                own = batch.slice(a, b - a)
                if keys[a] != at:
                    if at is not None:
                        yield (chunk or Chunk(at[0], _one(groups), top)).found()
                    chunk, groups, at = None, [], keys[a]
                if heads[a]:
                    groups.append(own)
                else:
                    chunk = chunk or Chunk(at[0], _one(groups), top)
                    chunk.add(own)
        if at is not None:
            yield (chunk or Chunk(at[0], _one(groups), top)).found()
        give_back()

    return run


def _one(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches).combine_chunks()


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for the groups (lang, source) of ``docs``.

    ``pair``: how far the group's term shares lie from those of each other source of its language.
    ``term``: the ``top`` terms that the group has more of than its language. Null text, lang and
    source are empty strings; texts without terms still make their group. A language without kept terms has
    pairs of value 0 and no terms; one with a single source has no pairs. Repeated rows count each, ties
    go by the item's UTF-8 bytes, an empty table gives no rows, other columns are not read.
    """
    counts = written(term_counts(docs))
    kept = written(kept_terms(counts, least))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("_n"), F.sum("first").alias("_terms"))
    of_lang = Window.partitionBy("lang")
    groups = counts.where(F.length("term") == 0).select("lang", "source").join(totals, ["lang", "source"], "left")
    groups = groups.fillna(0, ["_n", "_terms"]).withColumn("_base", PRIOR * F.sum("_terms").over(of_lang))
    groups = groups.select("lang", "source", (F.col("_n") + F.col("_base")).alias("total"), (F.sum("_n").over(of_lang) + F.col("_base")).alias("lang_total"))
    # a language's chunk of no terms makes its pairs where it keeps none
    chunks = kept.select("lang", "chunk").distinct().unionByName(groups.select("lang", F.lit(-1).alias("chunk")).distinct())
    zero = F.lit(0).cast("bigint")
    heads = groups.join(chunks, "lang").select("lang", "chunk", F.lit(b"").alias("term"), "source", zero.alias("n"), "total", "lang_total")
    rows = heads.unionByName(kept.select("lang", "chunk", "term", "source", "n", zero.alias("total"), zero.alias("lang_total")))
    found = rows.repartition("lang", "chunk").sortWithinPartitions("lang", "chunk", "term", "source").mapInArrow(_chunks(top), _FOUND)
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    out = found.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return out.withColumn("item", F.col("item").cast("string"))


def op13_source_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
seen AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
full_ AS (SELECT g.lang, g.source, t.term, coalesce(s.n, 0) AS n FROM groups g JOIN kept t USING (lang) LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = t.term),
shared AS (SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM full_ JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shared a JOIN shared b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shared WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
