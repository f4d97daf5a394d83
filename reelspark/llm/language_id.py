"""Language ID (operator 1): segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces, by a forward algorithm over its characters; a
text's is the product over its words. The piece probabilities are fitted by expectation
maximisation on word counts of a bounded sample of labelled texts. Words of like length go through
the algorithm together as arrays, and a task remembers the words that it has scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import column, cut, hash_below, hashed, small_batches, table, word_table, words_of

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Labelled texts of each language that the model is fitted on, about.
SAMPLE_TEXTS = 1500
#: Rounds of expectation maximisation, and each piece's own count.
ROUNDS = 2
PRIOR = 0.05
#: Probability of a character that no piece has, and words that a task remembers.
UNKNOWN = 1e-7
KNOWN_WORDS = 600_000
#: Pieces whose expected counts cross the shuffle in one row.
BLOCK = 4096
#: Words times characters (with the beginning) times languages that go through the algorithm at once.
CELLS = 400_000
#: Bits of the hash by which most runs of characters are known not to be pieces.
SIEVE_BITS = 20

_LETTER = regex.compile(r"\p{L}")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    languages: list[str]
    #: Sorted hashes of pieces, and by piece (the last: none) and language the probability.
    hashes: np.ndarray
    probability: np.ndarray
    #: Characters of the longest piece.
    longest: int = 16


def pieces(path: str) -> tuple[np.ndarray, int]:
    """Sorted hashes of all the vocabulary's pieces, lower-cased, and the characters of the longest; a
    word's beginning counts as a character of its own."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = {p.lower() for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)) and (p := model.id_to_piece(k))}
    return np.unique(np.array([hash_of(p) for p in own], np.uint64)), max(map(len, own))


def hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_FACTOR) + ord(c) + 1) & ((1 << 64) - 1)
    return h


def numbered(hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Number of the piece with each hash, or len(hashes)."""
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    low = np.uint64((1 << SIEVE_BITS) - 1)
    sieve[hashes & low] = True
    out = np.full(h.shape, len(hashes), np.int32)
    maybe = np.nonzero(sieve[h & low])
    at = np.searchsorted(hashes, h[maybe])
    out[maybe] = np.where(hashes[np.minimum(at, len(hashes) - 1)] == h[maybe], at, len(hashes))
    return out


def lattice(words: list[str], hashes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of any lengths: lengths; (word, end, size - 1) -> piece number, and whether a
    character stands alone without being a piece."""
    sizes = np.array([len(w) + 1 for w in words])
    wide = int(sizes.max())
    chars = np.zeros((len(words), wide), np.uint32)
    flat = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars[np.arange(wide) < sizes[:, None]] = flat
    numbers = np.full((len(words), wide, min(longest, wide)), len(hashes), np.int32)
    h = np.zeros((len(words), wide), np.uint64)
    code = chars.astype(np.uint64) + np.uint64(1)
    for size in range(1, min(longest, wide) + 1):
        # hash of the `size` characters from each place on
        h = h[:, : wide - size + 1] * _FACTOR + code[:, size - 1 :]
        numbers[:, size - 1 :, size - 1] = numbered(hashes, h)
    return sizes, numbers, numbers[:, :, 0] == len(hashes)


def forward(sizes: np.ndarray, numbers: np.ndarray, alone: np.ndarray, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of each word by language; the scaled sums over segmentations of each
    beginning, and the log scales."""
    n, wide, most = numbers.shape
    k = probability.shape[1]
    alpha = np.zeros((n, wide + 1, k))
    scale = np.zeros((n, wide + 1, k))
    alpha[:, 0] = 1
    out = np.zeros((n, k))
    for end in range(1, wide + 1):
        total = np.zeros((n, k))
        for size in range(1, min(most, end) + 1):
            own = numbers[:, end - 1, size - 1]
            hit = np.flatnonzero(own < len(probability) - 1)
            if len(hit):
                # beginnings are scaled each on its own; bring them to the scale before `end`
                total[hit] += alpha[hit, end - size] * np.exp(scale[hit, end - size] - scale[hit, end - 1]) * probability[own[hit]]
        unknown = alone[:, end - 1]
        total[unknown] += alpha[unknown, end - 1] * UNKNOWN
        alpha[:, end] = 1
        scale[:, end] = scale[:, end - 1] + np.log(total)
        done = sizes == end
        out[done] = scale[done, end]
    return out, alpha, scale


def alike(words: list[str], depth: int) -> Iterator[np.ndarray]:
    """Places of the words in groups of like length, each of at most CELLS words times characters
    times ``depth``, or of one word."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    a = 0
    while a < len(order):
        wide = int(sizes[order[a]])
        b = a + 1
        while b < len(order) and sizes[order[b]] <= wide + 3 and (b - a + 1) * (int(sizes[order[b]]) + 1) * depth <= CELLS:
            b += 1
        yield order[a:b]
        a = b


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), len(model.languages)))
    for own in alike(words, 1 + len(model.languages)):
        out[own] = forward(*lattice([words[i] for i in own], model.hashes, model.longest), model.probability)[0]
    return out


def expected(words: list[str], counts: np.ndarray, model: Model, language: int) -> np.ndarray:
    """Expected pieces in all segmentations of the words, each ``counts`` times."""
    total = np.zeros(len(model.probability))
    p = model.probability[:, language : language + 1]
    with np.errstate(divide="ignore"):
        log_p = np.log(p[:, 0])
    for own in alike(words, 4):
        sizes, numbers, alone = lattice([words[i] for i in own], model.hashes, model.longest)
        logs, _, scale = forward(sizes, numbers, alone, p)
        n, wide, most = numbers.shape
        # beta: log of the sum over segmentations of what follows a place
        beta = np.full((n, wide + 1), -np.inf)
        beta[np.arange(n), sizes] = 0
        for place in range(wide - 1, -1, -1):
            parts = []
            for size in range(1, min(most, wide - place) + 1):
                number = numbers[:, place + size - 1, size - 1]
                parts.append(log_p[number] + beta[:, place + size])
                if size == 1:
                    parts.append(np.where(alone[:, place], np.log(UNKNOWN), -np.inf) + beta[:, place + 1])
            beta[:, place] = np.where(place < sizes, np.logaddexp.reduce(parts), beta[:, place])
        for size in range(1, min(most, wide) + 1):
            number = numbers[:, size - 1 :, size - 1]
            share = np.exp(scale[:, : wide - size + 1, 0] + log_p[number] + beta[:, size:] - logs[:, :1]) * counts[own][:, None]
            ok = (number < len(p) - 1) & (np.arange(size, wide + 1) <= sizes[:, None])
            np.add.at(total, number[ok], share[ok])
    return total


def lower_words(text: str) -> list[str]:
    """A text's words as :func:`predict` takes them."""
    return [w.decode("utf-8", "replace").lower() for w in words_of(text.encode("utf-8", "replace"))]


def fit(labelled: DataFrame, vocabulary: str = VOCABULARY) -> Model | None:
    """Model on about SAMPLE_TEXTS rows of (doc_id, text, lang) for each language, chosen by a hash
    of doc_id; None without rows. Every value of lang is learned: the model has a number for each
    piece and language, so the languages must be few enough for that. Their words are counted in
    tasks, and each round's expected pieces are summed in tasks by language."""
    spark = labelled.sparkSession
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    bounds = spark.createDataFrame([(la, hash_below(SAMPLE_TEXTS, n)) for la, n in sizes.items()], "lang string, bound bigint")
    sample = labelled.join(F.broadcast(bounds), "lang").where(hashed("doc_id") < F.col("bound"))

    def count(batches):
        found: dict[str, Counter] = {}
        for batch in small_batches(batches):
            for text, lang in zip(column(batch, "text"), column(batch, "lang"), strict=True):
                found.setdefault(lang, Counter()).update(lower_words(text))
        for lang, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = cut(counts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word"))
    hashes, longest = pieces(vocabulary)
    probability = np.full((len(hashes) + 1, len(languages)), 1 / len(hashes))
    probability[-1] = 0
    model = Model(languages, hashes, probability, longest)
    place = {la: k for k, la in enumerate(languages)}
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def step(batches, shared=shared):
            own = shared.value
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                lang, n = np.array([place[x] for x in column(batch, "lang")]), np.array(column(batch, "n"))
                words = column(batch, "word")
                for k in np.unique(lang).tolist():
                    at = np.flatnonzero(lang == k)
                    part = expected([words[i] for i in at], n[at], own, k)
                    totals[k] = totals.get(k, 0) + part
            for k, total in totals.items():
                blocks = [total[a : a + BLOCK].tobytes() for a in range(0, len(total), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=["k", "block", "total"])

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x) for x in t["total"].to_pylist())
            return pa.table({"k": t["k"][:1], "block": t["block"][:1], "total": pa.array([total.tobytes()], pa.binary())})

        probability = np.full((len(hashes) + 1, len(languages)), PRIOR)
        kind = "k int, block int, total binary"
        for r in counts.mapInArrow(step, kind).groupBy("k", "block").applyInArrow(add, kind).collect():
            own = np.frombuffer(bytes(r.total))
            probability[r.block * BLOCK : r.block * BLOCK + len(own), r.k] += own
        probability[-1] = 0
        model = Model(languages, hashes, probability / probability.sum(axis=0), longest)
    return model


def predict(docs: DataFrame, model: Model | None, held_out=None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs`` (doc_id, text).

    ``score`` is the language's posterior with equal priors. A null text or one without letters is
    ``und`` with score 0, and so is all without a model. Repeated rows are judged alike, other
    columns are not read, an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        known: dict[int, int] = {}
        scores = np.zeros((0, len(own.languages) if own else 0))
        for batch in small_batches(batches):
            texts = column(batch, "text")
            found = ["und"] * len(texts)
            value = [0.0] * len(texts)
            if own:
                if len(known) > KNOWN_WORDS:
                    known, scores = {}, scores[:0]
                words = word_table(batch)
                distinct, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
                slot = np.fromiter((known.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
                new = np.flatnonzero(slot < 0)
                if len(new):
                    raw = words.data.tobytes()
                    more = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist(), strict=True)]
                    slot[new] = len(scores) + np.arange(len(new))
                    known.update(zip(distinct[new].tolist(), slot[new].tolist(), strict=True))
                    scores = np.concatenate([scores, word_scores(more, own)])
                sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores[slot[which]], axis=0)])
                logs = sums[words.first[1:]] - sums[words.first[:-1]]
                odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                best = odds.argmax(axis=1)
                share = odds[np.arange(len(best)), best] / odds.sum(axis=1)
                for k, text in enumerate(texts):
                    if text and _LETTER.search(text):
                        found[k], value[k] = own.languages[best[k]], float(share[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(value, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labelled = docs.where((fold != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    return predict(docs, fit(labelled), F.coalesce(fold == 0, F.lit(False)))
