"""Mixing sources to target weights (operator 2): soft-membership mixing.

A classifier fitted on a bounded sample of a labelled table gives each document a posterior over
domains. Nonnegative document rates are then fitted by projected-gradient least squares, so that
the expected tokens of each domain, rates times tokens times posteriors, match their targets. A
step is one sum over all documents of a few numbers for each domain; a document's rate follows
from its posteriors and the list of the steps.
"""

from __future__ import annotations

import warnings
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import Words, column, cut, give_back, small_batches, table, word_table
from reelspark.llm.common import mix as mix_bits

#: Labelled rows that the classifier is fitted on at most, and places that words hash to.
LABELLED_ROWS = 4000
PLACES = 4096
STEPS = 300
RATE = 4.0
DECAY = 1e-5
#: Steps at most, and the largest miss of a target, as a share of all tokens, that ends them.
ROUNDS = 20
MISS = 1e-4
#: Rows of a batch of copies at most, and of texts whose words are counted at once (16 MB of counts).
COPIED_ROWS = 256
COUNTED_ROWS = 500

#: Target weights of the domains of the registered query: quality and toxic of the labelled table.
TARGETS = {"q1t0": 0.86, "q0t0": 0.10, "q1t1": 0.03, "q0t1": 0.01}


class Classifier(NamedTuple):
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray


def word_places(words: Words) -> np.ndarray:
    """Square roots of the share of each place among a text's words, a row for each text."""
    n = np.diff(words.first)
    owner = np.repeat(np.arange(len(n)), n)
    place = (words.hashes % np.uint64(PLACES)).astype(np.int64)
    counts = np.bincount(owner * PLACES + place, minlength=len(n) * PLACES).reshape(len(n), PLACES)
    return np.sqrt(counts / np.maximum(n, 1)[:, None], dtype=np.float32)


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: str) -> Classifier | None:
    """Multinomial logistic regression on at most LABELLED_ROWS rows of ``labels`` (doc_id and what
    the SQL expression ``domain`` names), those with the least hash of doc_id. None without rows."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(domain).alias("domain")).where("doc_id is not null and domain is not null")
    sample = own.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches):
        for batch in small_batches(batches, most_rows=COUNTED_ROWS):
            x = word_places(word_table(batch, lower=True))
            rows = []
            for row in x:
                at = np.flatnonzero(row)
                rows.append(at.astype(np.uint16).tobytes() + row[at].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "doc_id"), pa.int64()), pa.array(column(batch, "domain"), pa.string()), pa.array(rows, pa.binary())], names=["doc_id", "domain", "x"])

    rows = sorted((r.doc_id, r.domain, bytes(r.x)) for r in texts.mapInArrow(run, "doc_id bigint, domain string, x binary").collect())
    if not rows:
        return None
    x = np.zeros((len(rows), PLACES), np.float32)
    for k, (_, _, data) in enumerate(rows):
        half = len(data) // 2
        x[k, np.frombuffer(data[:half], np.uint16)] = np.frombuffer(data[half:], np.float16)
    domains = sorted({d for _, d, _ in rows})
    y = np.eye(len(domains), dtype=np.float32)[[domains.index(d) for _, d, _ in rows]]
    w, b = np.zeros((PLACES, len(domains)), np.float32), np.log(y.mean(axis=0))
    moved, moved_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS):
        p = posteriors_of(x, Classifier(domains, w, b)).astype(np.float32)
        g = (p - y) / len(x)
        moved = 0.9 * moved - RATE * (x.T @ g + DECAY * w)
        moved_b = 0.9 * moved_b - 0.1 * g.sum(axis=0)
        w, b = w + moved, b + moved_b
    return Classifier(domains, w, b)


def posteriors_of(x: np.ndarray, model: Classifier) -> np.ndarray:
    z = x @ model.weights + model.bias
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def members(batch: pa.RecordBatch, model: Classifier) -> tuple[np.ndarray, np.ndarray]:
    """Words and posteriors of each text of a batch."""
    words = word_table(batch, lower=True)
    return np.diff(words.first), posteriors_of(word_places(words), model).astype(np.float64)


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, posteriors) of each row; tokens are words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small_batches(batches, most_rows=COUNTED_ROWS):
            n, p = members(batch, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "posteriors"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, posteriors array<double>")


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates of documents with posteriors ``p`` after the fit's steps, each followed by the
    projection on what isn't negative."""
    r = np.ones(len(p))
    for step in steps:
        r = np.maximum(0.0, r - p @ step)
    return r


def fit_rates(members: DataFrame, targets: np.ndarray) -> list[np.ndarray]:
    """``members`` as from :func:`posteriors`, ``targets`` the domains' token totals.

    Projected gradient of the squared misses, scaled by each document's tokens and by the inverse of
    the domains' second moments among documents with a positive rate. A step after which the misses
    are larger is halved. What is missed at the end beyond MISS is told by a warning.
    """
    k = len(targets)
    kind = ", ".join(f"v{i} double" for i in range(k + k * k + 1))

    def sums(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
        def run(batches):
            total = np.zeros(k + k * k + 1)
            for batch in batches:
                n = batch.column(0).to_numpy().astype(float)
                p = batch.column(1).flatten().to_numpy().reshape(-1, k)
                r = rates(p, steps)
                total[:k] += (r * n) @ p
                total[k:-1] += (p.T @ (p * (n * (r > 0))[:, None])).reshape(-1)
                total[-1] += n.sum()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=[f"v{i}" for i in range(len(total))])

        row = members.select("n_tokens", "posteriors").mapInArrow(run, kind).agg(*(F.sum(f"v{i}") for i in range(k + k * k + 1))).first()
        row = np.array([x or 0.0 for x in row])
        return row[:k], row[k:-1].reshape(k, k), row[-1]

    steps: list[np.ndarray] = []
    total, square, n = sums(steps)
    miss = np.abs(total - targets).max()
    for _ in range(ROUNDS):
        if miss <= MISS * n:
            break
        step = np.linalg.pinv(square + 1e-9 * n * np.eye(k)) @ (total - targets)
        after, square_after, _ = sums([*steps, step])
        for _ in range(3):
            if np.abs(after - targets).max() < miss:
                break
            step = step / 2
            after, square_after, _ = sums([*steps, step])
        if np.abs(after - targets).max() >= miss:
            break
        steps, total, square = [*steps, step], after, square_after
        miss = np.abs(total - targets).max()
    if miss > MISS * n:
        warnings.warn(f"rates miss their targets by {miss / n:.4f} of all tokens at most", stacklevel=2)
    return steps


def keys_of(ids: pa.Array, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What the decision on copies is drawn from: doc_id, or where it is null the text's facts."""
    there = ids.is_valid().to_numpy(zero_copy_only=False)
    facts = mix_bits(np.ascontiguousarray(p[:, 0], np.float64).view(np.uint64) + n.astype(np.uint64)).view(np.int64)
    return np.where(there, ids.cast(pa.int64()).fill_null(0).to_numpy(), facts)


def copies_of(doc_id: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Whole copies: the rate rounded up or down by a hash of doc_id, right in expectation."""
    with np.errstate(over="ignore"):
        h = (doc_id.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.floor(rate + (h >> np.uint64(11)).astype(float) / (1 << 53)).astype(np.int64)


DOMAIN = "concat('q', quality, 't', toxic)"


def target_totals(domains: list[str], targets: dict[str, float], total: float) -> np.ndarray:
    """A domain without a target gets none."""
    weights = np.array([targets.get(d, 0.0) for d in domains])
    return weights / (weights.sum() or 1.0) * total


def mix(docs: DataFrame, labels: DataFrame, domain: str = DOMAIN, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(doc_id, n_tokens, posteriors, rate, copies) of each row of ``docs`` (doc_id, text).

    ``posteriors`` are by domain in order of its name. The targets sum to the input's tokens. A null
    or empty text has no tokens and the posteriors of a text without words; null doc_ids get rates
    too. Without labelled rows there is one domain and every rate is 1. Repeated rows are alike,
    other columns are not read, an empty table gives no rows.
    """
    model = fit_classifier(docs, labels, domain) or Classifier(["all"], np.zeros((PLACES, 1), np.float32), np.zeros(1, np.float32))
    known = cut(posteriors(docs, model))
    total = float(known.agg(F.sum("n_tokens")).first()[0] or 0)
    fit = fit_rates(known, target_totals(model.domains, targets if set(targets) & set(model.domains) else dict.fromkeys(model.domains, 1.0), total))
    shared = docs.sparkSession.sparkContext.broadcast(fit)
    k = len(model.domains)

    def run(batches):
        for batch in batches:
            p = batch.column(2).flatten().to_numpy().reshape(-1, k)
            rate = rates(p, shared.value)
            ids = keys_of(batch.column(0), batch.column(1).to_numpy(), p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate), pa.array(copies_of(ids, rate))], names=[*batch.schema.names, "rate", "copies"])

    return known.mapInArrow(run, "doc_id bigint, n_tokens bigint, posteriors array<double>, rate double, copies bigint")


def thin(docs: DataFrame, labels: DataFrame, whole: str = "q1t0", domain: str = DOMAIN, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the fitted rates say (copies of a row stand
    one after the other).

    The targets sum to what leaves the domain ``whole`` its present tokens, so others are thinned,
    or repeated where they are too scarce, to their weights beside it. Without labelled rows, or none in ``whole``,
    all stay. Posteriors are taken anew beside the texts, so that no text is shuffled.
    """
    model = fit_classifier(docs, labels, domain)
    if model is None or whole not in model.domains or not targets.get(whole):
        return docs
    known = cut(posteriors(docs, model))
    at = model.domains.index(whole)
    present = float(known.agg(F.sum(F.col("n_tokens") * F.col("posteriors")[at])).first()[0] or 0)
    fit = fit_rates(known, target_totals(model.domains, targets, present * sum(targets.get(d, 0.0) for d in model.domains) / targets[whole]))
    shared = docs.sparkSession.sparkContext.broadcast((model, fit))

    def run(batches):
        for batch in small_batches(batches, most_rows=COUNTED_ROWS):
            model, fit = shared.value
            n, p = members(batch, model)
            ids = keys_of(batch.column(batch.schema.get_field_index("doc_id")), n, p)
            at = np.repeat(np.arange(batch.num_rows), copies_of(ids, rates(p, fit)))
            for k in range(0, len(at), COPIED_ROWS):
                yield batch.take(pa.array(at[k : k + COPIED_ROWS]))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
