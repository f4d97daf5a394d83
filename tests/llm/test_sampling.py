"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from reelspark.llm import best_fit, importance, source_audit
from tests.conftest import SMALL
from tests.llm.data import DOCS, docs, hard_cases

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[k : k + n]).encode() for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def brute_sample(rows, targets):
    def counts(texts):
        out = Counter()
        for t in texts:
            out.update(zlib.crc32(f) % 10_000 for f in features(t)[1])
        return out

    s, t = counts(text for _, text in rows), counts(targets)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in range(10_000)]
    out, may = [], []
    for k, (i, text) in enumerate(rows):
        n, own = features(text)
        weight = sum(gain[zlib.crc32(f) % 10_000] for f in own)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None])
        if n >= 20 and i is not None:
            may.append((-score, i, k))
    for rank, (_, _, k) in enumerate(sorted(may)[: len(may) * 5 // 100], 1):
        out[k][4] = rank
    return sorted(map(tuple, out), key=repr)


def test_importance(spark):
    rows = [(i, t) for i, t in hard_cases()]
    rows += [(i + 20, " ".join(f"W{(i * 7 + k * k) % 300}é" for k in range(15 + i))) for i in range(150)]
    rows += [(20, rows[15][1]), (40, "x" * 3000 + " y"), (None, rows[100][1]), (None, None)]
    targets = ["w1é w8é w3é, w1é", None, "", "one two"]
    target = spark.createDataFrame([(t, 1) for t in targets], "text string, n_words int")
    got = importance.resample(docs(spark, rows, clash=True), target)
    assert sorted(map(tuple, got.drop("n_words").collect()), key=repr) == brute_sample(rows, targets)
    none = spark.createDataFrame([], DOCS)
    assert importance.resample(none, target).count() == 0
    assert {r.rank for r in importance.resample(docs(spark, rows[:3]), none).collect()} == {None}


def test_ngram_crcs_over_long_words():
    texts = ["a " + "b" * 200 + " c d", "", "é" * 70 + " z"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found = defaultdict(Counter)
    for text, crc in importance.ngram_crcs(importance.runs_in(data, offsets, importance.WORD_BYTES)):
        for k, c in zip(text.tolist(), crc.tolist(), strict=True):
            found[k][c] += 1
    for k, t in enumerate(texts):
        assert found[k] == Counter(map(zlib.crc32, features(t)[1]))


def packed(rows, docs_):
    """Checks pieces against the tokenizer; returns the number of sequences and the pieces' lengths."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(best_fit.TOKENIZER)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t in docs_:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        edges = [0, *range(head, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want[i] += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_sequence), [p[2] for own in want.values() for p in own]


def best_fit_decreasing(lengths, size=1024):
    gaps, bins = Counter(), 0
    for x in sorted(lengths, reverse=True):
        gap = next((g for g in range(x, size) if gaps[g]), size)
        bins += gap == size
        gaps[gap] -= gap < size
        gaps[gap - x] += 1
    return bins


def test_best_fit(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(i + 10_000, t) for i, t in hard_cases()]
    rows += [(10_001, "again"), (10_001, "again"), (None, "no id"), (None, None), (5, "a <|endoftext|> b"), (6, "it's  ' s  x　 y 12a don'T\n\n z")]
    got = best_fit.pack_best_fit(docs(spark, rows, clash=True)).collect()
    n, lengths = packed(got, rows)
    assert -(-sum(lengths) // 1024) <= n <= best_fit_decreasing(lengths)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert best_fit.pack_best_fit(spark.createDataFrame([], DOCS)).count() == 0


def test_plan_places_every_piece():
    rng = random.Random(3)
    for size, many in ((64, 400), (1024, 3000), (1024, 5), (16, 1000)):
        counts = np.bincount([min(size, int(rng.paretovariate(0.6))) for _ in range(many)], minlength=size + 1)
        patterns = best_fit.plan(counts)
        used = Counter()
        for pattern, copies in patterns:
            assert sum(pattern) <= size and copies > 0
            for x in pattern:
                used[x] += copies
        assert used == Counter({k: int(c) for k, c in enumerate(counts) if c})
        lengths = np.repeat(np.arange(size + 1), counts).tolist()
        assert sum(c for _, c in patterns) <= best_fit_decreasing(lengths, size)
    huge = np.zeros(1025, np.int64)
    huge[[1, 3, 511, 700, 1024]] = 10**12
    assert sum(len(p) * c for p, c in best_fit.plan(huge)) == 5 * 10**12


@pytest.mark.parametrize("seed", range(3))
def test_chunk_ids_equal_the_tokenizer(seed):
    rng = random.Random(seed)
    parts = ["a", "don", "'s", "'S", "'", " ", "  ", "\n", "\t", " ", " ", "　", "\x85", "12", "é", "ß", "é", "-", "#", "世界", "🙂", "<|endoftext|>", "<|", "\x00", "\x1c", "xyz"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1500)]
    encoder = best_fit.ChunkIds(best_fit.TOKENIZER)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, edges = encoder.of(data, offsets, None)
    for k, t in enumerate(texts):
        assert ids[edges[k] : edges[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t


def buffer_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


class Strings:
    """A tokenizer that notes the strings it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, []

    def encode(self, text, **how):
        self.seen.append(text)
        return self.tokenizer.encode(text, **how)

    def encode_batch_fast(self, texts, **how):
        self.seen += texts
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_new_chunks_go_to_the_tokenizer_in_short_strings():
    encoder = best_fit.ChunkIds(best_fit.TOKENIZER)
    encoder.tokenizer = count = Strings(encoder.tokenizer)
    letters = str.maketrans("0123456789", "abcdefghij")
    encoder.of(*buffer_of([" ".join(f"x{k:05}".translate(letters) for k in range(60_000))]))
    assert len(count.seen) <= 300 and max(map(len, count.seen)) <= 4_000


def test_a_full_table_keeps_the_chunks_in_use(monkeypatch):
    monkeypatch.setattr(best_fit, "KNOWN_CHUNKS", 40)
    encoder = best_fit.ChunkIds(best_fit.TOKENIZER)
    encoder.tokenizer = count = Strings(tokenizer := encoder.tokenizer)
    often = " the\n\nquick  brown é世界"
    for k in range(12):
        texts = [often, "", *(f" {chr(97 + k)}{chr(97 + j)}zzé" for j in range(15)), often]
        ids, edges = encoder.of(*buffer_of(texts), None)
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.slots) <= 40 + 15
        assert encoder.bytes == sum(map(len, encoder.slots))
    assert sum("quick" in s or "brown" in s for s in count.seen) == 2  # once each


def brute_audit(rows, least, top):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for t, lang, source in rows]
    out = []
    for lang in {x[0] for x in terms}:
        own = [x for x in terms if x[0] == lang]
        df = Counter(w for _, _, ws in own for w in set(ws))
        kept = sorted((w for w in df if df[w] >= least), key=str.encode)
        groups = sorted({x[1] for x in own}, key=str.encode)
        n = {g: Counter(w for _, s, ws in own if s == g for w in ws if df[w] >= least) for g in groups}
        whole = sum(n.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c.values()) + 2 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // total for w in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {g: shares(n[g]) for g in groups}, shares(whole)
        for g in groups:
            pairs = [(-sum(f(p[g][w], p[h][w]) for w in kept), h.encode(), h) for h in groups if h != g]
            found = [(-f(p[g][w], q[w]), w.encode(), w) for w in kept if n[g][w] and p[g][w] > q[w]]
            out += [(lang, g, "pair", h, -v, r) for r, (v, _, h) in enumerate(sorted(pairs), 1)]
            out += [(lang, g, "term", w, -v, r) for r, (v, _, w) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_source_audit(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("Ab", "é", "zz", "ß", "世") for b in ("a", "B", "ü", "dd", "x")]
    rows = [(" ".join(rng.choice(words[: 5 + 3 * (k % 7)]) for _ in range(rng.randrange(25))) + " 12-ab", ("en", "fr", None, "")[k % 4], ("s1", "S2", None, "é", "s3")[rng.randrange(5)]) for k in range(200)]
    rows += [(None, "en", "silent"), ("only here", "de", "alone"), (None, None, None), ("rare words", "it", "a"), ("other words", "it", "b")] + [("ab ab zz", "en", "s1")] * 3
    rows += [("q" * 50_000, "fr", "long")] * 6
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 as n", "2 as term", "3 as value", "4 as chunk")
    want = brute_audit(rows, 5, 4)
    for cells in (1 << 20, 40):
        monkeypatch.setattr(source_audit, "CELLS", cells)
        assert sorted(map(tuple, source_audit.audit(df, 5, 4).collect())) == want
    assert source_audit.audit(df.limit(0)).count() == 0


def test_shares_are_exact():
    totals = [1, 7, 10**10 + 1, 9 * 10**15 - 3]
    for total in totals:
        for count in {0, 1, total // 3, total - 1, total}:
            assert source_audit.shares(np.array([count]), total)[0] == 1 + 10**9 * count // total
