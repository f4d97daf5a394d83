"""N-gram Jaccard join (operator 9): rare-first prefix filtering with length, positional and
suffix filters, joined on prefix n-grams, each pair verified once.

Documents are sets of word shingles. Two sets with Jaccard similarity >= t share an n-gram among the
first ``n - ceil(t n) + 1`` of each, in any order common to all sets. The order here is by the exact
number of different texts that have an n-gram, so those that no other text has come first and join
with nothing: a text that has too many of them leaves at once. What two sets can still share behind
a common n-gram is bounded by their sizes (length), by how many shared n-grams stand before and
after it (positional), and by all their shared n-grams (suffix).

A group of G similar texts would make G * G / 2 pairs. Only one of equal texts enters, and where more
than FEW of them meet at an n-gram, each is first compared with one pivot, the text with the fewest n-grams
of its own. What links so far makes components, within which no further pair needs a look: a family of
near copies is done. In each larger group the texts outside the pivot's component are then held against
all others of the group, within blocks of bounded size, by the length, positional and suffix filters and by
bitmaps of the sets, which bound an overlap from above. Only pairs that pass leave a block; those that no
earlier step had are verified, each once (:func:`links_of`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm import copies
from reelspark.llm.common import Words, column, cut, dealt, digest, give_back, mix, partitions, small_batches, table, window_hashes, word_table
from reelspark.llm.components import connected_components
from reelspark.llm.substring_dedup import bucket_edges, pack, pack_sorted, unpack, unpack_sorted

#: Shingle size in words, and the similarity as a percentage.
SHINGLE_WORDS = 5
PERCENT = 75
#: N-grams that meet in one bucket, and that a task gathers before it sends them.
BUCKET_GRAMS = 3_000_000
FLUSH_GRAMS = 2_500_000
#: N-grams that tasks report as frequent have this count there at least; of those, at most MOST_HOT
#: are in HOT_LEAST texts or more and go by document, not by n-gram (24 MB at most are broadcast).
REPORT = 8
HOT_LEAST = 1000
MOST_HOT = 2_000_000
#: Texts at one n-gram that are compared with each other; texts of a larger group that a block holds, and the
#: cells (texts times texts) that it looks at together.
FEW = 8
BLOCK_TEXTS = 512
CELLS = 1 << 20
#: Bits of the map of a set.
SET_BITS = 1024
#: Classes whose ids are broadcast (0.8 MB) to pick their sets.
FEW_IDS = 100_000

_BLOB = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])


def grams_of(words: Words, k: int, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of text ``k``."""
    own = words.of(k)
    if not len(own):
        return np.empty(0, np.uint64)
    grams = np.sort(window_hashes(own, min(size, len(own))) >> np.uint64(8))
    new = np.ones(len(grams), bool)
    np.not_equal(grams[1:], grams[:-1], out=new[1:])
    return grams[new]


def changes(*sorted_arrays: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any of the arrays; the first row does."""
    new = np.ones(len(sorted_arrays[0]), bool)
    if len(new):
        new[1:] = np.any([a[1:] != a[:-1] for a in sorted_arrays], axis=0)
    return new


class Frequent:
    """N-grams that a task's texts have REPORT times or more within a stretch of FLUSH_GRAMS."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.n = 0
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, grams: np.ndarray) -> None:
        self.held.append(grams)
        self.n += len(grams)
        if self.n > FLUSH_GRAMS:
            self.settle()

    def settle(self) -> None:
        if self.held:
            grams = np.sort(np.concatenate(self.held))
            start = np.flatnonzero(changes(grams))
            count = np.diff(np.append(start, len(grams)))
            often = count >= REPORT
            self.found.append((grams[start[often]], count[often]))
        self.held, self.n = [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Rows of the facts' kind: null doc_id, the n-gram as ``rep``, its count as ``n_words``."""
        self.settle()
        for grams, count in self.found:
            null = lambda kind, n=len(grams): pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([null(pa.int64()), pa.array(grams.view(np.int64)), null(pa.binary()), pa.array(count, pa.int64()), null(pa.int64()), null(pa.binary()), null(pa.string())], schema=copies.SCHEMA)


def short_digest(data: bytes) -> int:
    """The first 64 bits of a digest, by which texts go through the shuffles."""
    return int.from_bytes(data[:8], "little", signed=True)


def document_facts(size: int):
    """Facts of each document and, with null doc_id, the task's frequent n-grams."""

    def run(batches):
        frequent = Frequent()

        def extra(words, k):
            grams = grams_of(words, k, size)
            frequent.add(grams)
            return len(grams), None

        for batch in copies.facts(True, extra, more=frequent.rows)(batches):
            keys = [None if d is None else short_digest(d) for d in column(batch, "digest")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "fp"])

    return run


def gram_blobs(docs: DataFrame, hot: np.ndarray, size: int, buckets: int) -> DataFrame:
    """Blobs of (n-gram, text) by ranges of the n-gram, one for each bucket and FLUSH_GRAMS of a task.

    A text is named by 64 bits of its digest. Its set's size, and which hot n-grams it has, go to
    the bucket of that name instead.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        hot, held, names, n_held, seen = shared.value, [], [], 0, set()

        def flush():
            sizes = np.array([len(g) for g in held])
            grams, owner = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
            fps = np.array(names, np.int64)
            own_bucket = home_of(fps, buckets)
            is_hot = numbered(hot, grams) >= 0
            hot_gram, hot_owner = grams[is_hot], owner[is_hot]
            grams, owner = grams[~is_hot], owner[~is_hot]
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], owner[order]
            edges = bucket_edges(grams, buckets, 56)
            hot_bucket = own_bucket[hot_owner]
            for b in range(buckets):
                lo, hi = edges[b], edges[b + 1]
                own, at = np.flatnonzero(own_bucket == b), np.flatnonzero(hot_bucket == b)
                if lo == hi and not len(own):
                    continue
                there = np.zeros(len(fps), bool)
                there[owner[lo:hi]] = True
                place = (np.cumsum(there) - 1).astype(np.uint16 if len(fps) < 1 << 16 else np.uint32)
                payload = pack(fps[there], place[owner[lo:hi]], fps[own], sizes[own].astype(np.int32), fps[hot_owner[at]], hot_gram[at], *pack_sorted(grams[lo:hi]))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([payload], pa.binary())], schema=_BLOB)

        for batch in small_batches(batches):
            words = word_table(batch, lower=True)
            for k in range(batch.num_rows):
                if (key := digest(words.of(k))) in seen:
                    continue
                seen.add(key)
                grams = grams_of(words, k, size)
                if not len(grams):
                    continue
                held.append(grams)
                names.append(short_digest(key))
                n_held += len(grams)
                if n_held > FLUSH_GRAMS:
                    yield from flush()
                    held, names, n_held = [], [], 0
        if held:
            yield from flush()
        del held, names, seen
        give_back()

    return docs.mapInArrow(run, "bucket int, payload binary")


def home_of(fps: np.ndarray, homes: int) -> np.ndarray:
    return (mix(fps.view(np.uint64)) % np.uint64(homes)).astype(np.int64)


def numbered(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value among the sorted ones, or -1."""
    if not len(sorted_values):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return np.where(sorted_values[at] == values, at, -1)


def several_texts(hot_frame, homes: int):
    """A function over one bucket: the n-grams that several texts have, with how many, packed by the
    home of the texts; what goes by text passes through."""

    def run(t: pa.Table) -> pa.Table:
        hot_grams, hot_counts = hot_frame.value
        parts = [unpack(p.as_py()) for p in t["payload"]]
        grams = [unpack_sorted(p[6:]) for p in parts]
        fp = np.concatenate([p[0][p[1]] for p in parts])
        gram = np.concatenate(grams)
        order = np.lexsort((fp, gram))
        gram, fp = gram[order], fp[order]
        keep = changes(gram, fp)  # equal texts come from several tasks
        gram, fp = gram[keep], fp[keep]
        start = np.flatnonzero(changes(gram))
        count = np.diff(np.append(start, len(gram)))
        df = np.repeat(count, count)
        keep = df > 1
        own_fp, own_n, hot_fp, hot_gram = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4, 5))
        fp, gram = np.concatenate([fp[keep], hot_fp]), np.concatenate([gram[keep], hot_gram])
        df = np.concatenate([df[keep], hot_counts[numbered(hot_grams, hot_gram)] if len(hot_gram) else np.empty(0, np.int64)])
        df = np.minimum(df, (1 << 32) - 1).astype(np.uint32)
        home, own_home = home_of(fp, homes), home_of(own_fp, homes)
        order, own_order = np.lexsort((fp, home)), np.argsort(own_home, kind="stable")
        edges, own_edges = (np.searchsorted(h[o], np.arange(homes + 1)) for h, o in ((home, order), (own_home, own_order)))
        out: list[tuple[int, bytes]] = []
        for h in range(homes):
            at, own = order[edges[h] : edges[h + 1]], own_order[own_edges[h] : own_edges[h + 1]]
            if len(at) or len(own):
                begin = np.flatnonzero(changes(fp[at]))
                runs = np.diff(np.append(begin, len(at))).astype(np.int32)
                out.append((h, pack(fp[at][begin], runs, gram[at], df[at], own_fp[own], own_n[own])))
        give_back()
        return pa.table([pa.array([h for h, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["home", "payload"])

    return run


def candidates(percent: int):
    """A function over one home: the texts of which others have enough n-grams, each with its set's
    size and the shared n-grams, rarest first."""

    def run(t: pa.Table) -> pa.Table:
        parts = [unpack(p.as_py()) for p in t["payload"]]
        fp = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        gram, df = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        own_fp, own_n = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
        own_fp, first = np.unique(own_fp, return_index=True)
        own_n = own_n[first].astype(np.int64)
        order = np.lexsort((gram, df, fp))
        fp, gram = fp[order], gram[order]
        keep = changes(fp, gram)
        fp, gram = fp[keep], gram[keep]
        begin = np.flatnonzero(changes(fp))
        shared = np.diff(np.append(begin, len(fp)))
        n = own_n[numbered(own_fp, fp[begin])]
        alive = 100 * shared >= percent * n
        rows = np.repeat(alive, shared)
        offsets = np.concatenate([[0], np.cumsum(shared[alive])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(gram[rows].view(np.int64)))
        return pa.table([pa.array(fp[begin][alive]), pa.array(n[alive]), lists], names=["fp", "n", "grams"])

    return run


def candidate_sets(docs: DataFrame, facts: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(cls, n, s, k, grams) of the texts that may link with another: the least doc_id with that
    text, the set's size, the number of its n-grams that other texts have too, how many of these
    are in the prefix, and they themselves, rarest first. ``texts`` has fp and first."""
    spark = docs.sparkSession
    total = facts.where("digest is not null").agg(F.sum("n_extra")).first()[0] or 0
    reported = facts.where("doc_id is null").groupBy(F.col("rep").alias("gram")).agg(F.sum("n_words").alias("n"))
    hot = reported.where(F.col("n") >= max(HOT_LEAST, total // MOST_HOT + 1)).toArrow()
    hot_grams, counts = hot["gram"].to_numpy().view(np.uint64), hot["n"].to_numpy()
    order = np.argsort(hot_grams)
    shared = spark.sparkContext.broadcast((hot_grams[order], counts[order]))
    buckets = partitions(spark, total, BUCKET_GRAMS)
    blobs = gram_blobs(docs, hot_grams[order], size, buckets)
    found = dealt(blobs, "bucket", buckets).groupBy("bucket").applyInArrow(several_texts(shared, buckets), "home int, payload binary")
    sets = dealt(found, "home", buckets).groupBy("home").applyInArrow(candidates(percent), "fp bigint, n bigint, grams array<bigint>")
    own = sets.join(texts, "fp").select(F.col("first").alias("cls"), "n", F.size("grams").cast("bigint").alias("s"), "grams")
    return cut(own.select("cls", "n", "s", F.expr(f"s - ({percent} * n + 99) div 100 + 1").alias("k"), "grams"))


def may_share(n: str, m: str, most: str, percent: int) -> str:
    """Whether sets of ``n`` and ``m`` n-grams that share ``most`` at most can link."""
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and {100 + percent} * ({most}) >= {percent} * ({n} + {m})"


def named_by(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``sets`` of these classes; only where they are few, the others are left out before
    a shuffle."""
    own = cut(ids.distinct())
    return sets.join(F.broadcast(own), "cls", "left_semi") if own.count() <= FEW_IDS else sets


def set_bitmaps(sets: DataFrame) -> DataFrame:
    """(cls, bits): for each n-gram of a set one of SET_BITS bits is on. A bit that only one of two sets has
    stands for an n-gram at least that the other lacks."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            grams, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for a in range(0, batch.num_rows, 4096):
                b = min(batch.num_rows, a + 4096)
                on = np.zeros((b - a, SET_BITS), bool)
                own = grams[offsets[a] : offsets[b]]
                on[np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1])), (mix(own) % np.uint64(SET_BITS)).astype(np.int64)] = True
                packed = np.packbits(on, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in packed], pa.binary())], names=["cls", "bits"])

    return sets.select("cls", "grams").mapInArrow(run, "cls bigint, bits binary")


class Block:
    """The texts that a block owns; visitors, the open texts of its group, are held against them."""

    columns = ("cls", "label", "n", "s", "i", "open")

    def __init__(self, percent: int) -> None:
        self.percent, self.parts = percent, []
        self.owned: dict[str, np.ndarray] | None = None

    @classmethod
    def arrays(cls, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in cls.columns}
        out["bits"] = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, SET_BITS // 64)
        return out

    def own(self, batch: pa.RecordBatch) -> None:
        self.parts.append(self.arrays(batch))

    def visit(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.owned is None:
            self.owned = {c: np.concatenate([p[c] for p in self.parts]) for c in self.parts[0]} if self.parts else {}
        if not self.owned:
            return
        guests = self.arrays(batch)
        width = max(1, CELLS // len(self.owned["cls"]))
        for a in range(0, batch.num_rows, width):
            yield self.likely({c: x[a : a + width] for c, x in guests.items()})

    def likely(self, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of which no filter shows that they do not link."""
        y, t = self.owned, self.percent
        col = {c: x[c][:, None] for c in self.columns}
        total = t * (col["n"] + y["n"])
        most = np.minimum(col["i"], y["i"]) + np.minimum(col["s"] - col["i"], y["s"] - y["i"])
        ok = (col["label"] != y["label"]) & (~y["open"] | (col["cls"] < y["cls"]))
        ok &= (100 * np.minimum(col["n"], y["n"]) >= t * np.maximum(col["n"], y["n"])) & ((100 + t) * most >= total)
        u, v = np.nonzero(ok)
        only_u, only_v = (np.bitwise_count(p & ~q).sum(axis=1).astype(np.int64) for p, q in ((x["bits"][u], y["bits"][v]), (y["bits"][v], x["bits"][u])))
        most = np.minimum(x["s"][u] - only_u, y["s"][v] - only_v)
        keep = (100 + t) * most >= total[u, v]
        u, v = x["cls"][u[keep]], y["cls"][v[keep]]
        return np.minimum(u, v), np.maximum(u, v)


def likely_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the blocks of ``rows`` (key, block, guest, cls, label, n, s, i, open, bits)."""

    def run(batches):
        block, at = None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "block", "guest")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if (own := tuple(keys[:2, a].tolist())) != at:
                    block, at = Block(percent), own
                part = batch.slice(a, b - a)
                if not keys[2, a]:
                    block.own(part)
                    continue
                for u, v in block.visit(part):
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        give_back()

    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "guest").mapInArrow(run, "u bigint, v bigint")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` (u, v) of classes that link."""
    own = named_by(sets, pairs.select(F.col("u").alias("cls")).unionAll(pairs.select("v")))
    both = pairs.join(own.selectExpr("cls as u", "n", "grams as x"), "u").join(own.selectExpr("cls as v", "n as m", "grams as y"), "v")
    return cut(both.where(f"{100 + percent} * size(array_intersect(x, y)) >= {percent} * (n + m)").select("u", "v"))


def links_of(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between the classes of ``sets`` that connect all that are connected.

    Postings (key, class) meet at their key, a prefix n-gram. Of a small group the pairs that the filters
    leave, and of a larger one the pairs with its pivot, are verified first. Their links make components. Of
    two texts of a larger group that link, at least one is then outside the pivot's component, or they
    are in one component already; so each text outside, an open one, visits every block of its group.
    """
    posts = sets.select("cls", "n", "s", F.posexplode(F.expr("slice(grams, 1, cast(k as int))")).alias("i", "key"))
    best = F.min(F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("own"), F.xxhash64("cls").alias("h"), F.col("cls")))
    heads = cut(posts.groupBy("key").agg(F.count("*").alias("c"), best.alias("best")).where("c > 1").select("key", "c", F.col("best.cls").alias("pivot")))
    met = cut(posts.join(heads, "key"))
    likely = may_share("p.x.n", "p.y.n", "least(p.x.i, p.y.i) + least(p.x.s - p.x.i, p.y.s - p.y.i)", percent)
    groups = met.where(f"c <= {FEW}").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cls", "n", "s", "i"))).alias("g"))
    two = F.expr(f"filter(flatten(transform(g, (x, j) -> transform(slice(g, j + 2, size(g)), y -> struct(x as x, y as y)))), p -> {likely})")
    small = groups.select(F.explode(two).alias("p")).selectExpr("p.x.cls as u", "p.y.cls as v")
    star = met.where(f"c > {FEW} and cls <> pivot").selectExpr("least(cls, pivot) as u", "greatest(cls, pivot) as v")
    pairs = cut(small.unionAll(star).distinct())
    links = verified(pairs, sets, percent)
    label = connected_components(links).select(F.col("v").alias("cls"), "label")
    pivots = heads.where(f"c > {FEW}").select("key", F.col("pivot").alias("cls")).join(label, "cls", "left").select("key", F.coalesce("label", "cls").alias("of_pivot"))
    large = met.where(f"c > {FEW}").join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    large = cut(large.join(pivots, "key").withColumn("open", F.col("label") != F.col("of_pivot")).select("key", "c", "cls", "label", "n", "s", "i", "open"))
    unsettled = large.where("open").groupBy("key").agg(F.count("*").alias("guests"))
    left = large.join(unsettled.select("key"), "key")
    bits = cut(set_bitmaps(named_by(sets, left.select("cls"))))
    rows = cut(left.join(bits, "cls").withColumn("blocks", F.expr(f"cast((c - 1) div {BLOCK_TEXTS} as int) + 1")))
    owned = rows.withColumn("block", F.expr("cast(pmod(xxhash64(cls), blocks) as int)")).withColumn("guest", F.lit(0))
    guests = rows.where("open").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("guest", F.lit(1))
    names = ["key", "block", "guest", *Block.columns, "bits"]
    more = likely_pairs(owned.select(*names).unionByName(guests.select(*names)), percent)
    more = cut(more.distinct().join(pairs, ["u", "v"], "left_anti"))
    return links.unionByName(verified(more, sets, percent))


def jaccard_components(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text, ...).

    Documents link when 100 * |intersection| >= percent * |union| of their distinct ``size``-word
    shingles; fewer words make one shingle of them all. ``component_id`` is the least doc_id
    reachable by links, itself included; a document without words (null, empty, white space)
    links with nothing and is its own component, though its equals are many. Rows
    that repeat a doc_id give as many rows, all in the least of their components; a null doc_id gives
    none; other columns are not read. An empty table gives no rows. Shingles are compared by 56 bits of a hash and texts told apart by
    64: two different shingles fall together with a chance of 1.4e-17.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    facts = cut(docs.mapInArrow(document_facts(size), copies.FACTS + ", fp bigint"))
    rows = facts.where("doc_id is not null")
    reps = rows.where("n_words > 0 and digest is not null").select("rep", "fp")
    texts = cut(reps.groupBy("fp").agg(F.min("rep").alias("first")))
    links = links_of(candidate_sets(docs, facts, texts, size, percent), percent)
    roots = texts.join(connected_components(links).select(F.col("v").alias("first"), "label"), "first", "left").select("fp", F.coalesce("label", "first").alias("component_id"))
    of_rep = reps.join(roots, "fp").groupBy("rep").agg(F.min("component_id").alias("component_id"))
    out = rows.join(of_rep, "rep", "left")
    return out.select("doc_id", F.col("n_extra").alias("n_shingles"), F.when(F.col("n_words") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: Every pair that shares a shingle, as plain SQL can: for tables of some thousand documents.
ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
u AS (SELECT doc_id, unnest(list_transform(g, lambda x: md5_number_lower(x))) AS g FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * c >= 75 * (len(a.g) + len(b.g) - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.doc_id WHERE r.root < e.y)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least AS component_id FROM s JOIN (SELECT doc_id, min(root) AS least FROM reach GROUP BY doc_id) m ON m.doc_id = s.doc_id
"""
