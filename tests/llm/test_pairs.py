import hashlib
import random
import re

import pytest

from reelspark.llm import jaccard_join
from reelspark.llm.components import connected_components
from reelspark.llm.jaccard_join import jaccard_components
from reelspark.llm.substring_dedup import remove_repeats
from tests.conftest import SMALL
from tests.llm.data import DOCS, docs, hard_cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return sorted((i, len(sets[i]), label[i]) for i in sets)


def brute_repeats(rows, size=13):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = []
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def tables(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    return [hard_cases(), real]


@pytest.mark.parametrize("which", [0, 1])
def test_jaccard_is_brute_force(spark, which):
    rows = tables(spark)[which]
    got = sorted(tuple(r) for r in jaccard_components(docs(spark, rows, clash=True).repartition(3)).collect())
    assert got == brute_jaccard(rows)


@pytest.mark.parametrize("which", [0, 1])
def test_repeats_are_brute_force(spark, which):
    rows = tables(spark)[which]
    got = remove_repeats(docs(spark, rows, clash=True).repartition(3)).drop("kept_text")
    assert sorted(tuple(r) for r in got.collect()) == brute_repeats(rows)


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert jaccard_components(none).count() == 0
    assert remove_repeats(none).count() == 0


def varied(seed, n, words, edits, own, copies=1):
    """Texts made from one by up to ``edits`` changes of words."""
    pick, out = random.Random(seed), []
    for _ in range(n):
        text = [f"{own}{k}" for k in range(words)]
        for _ in range(pick.randint(0, edits)):
            text[pick.randrange(words)] = f"x{pick.randrange(400)}"
        out += [" ".join(text)] * pick.randint(1, copies)
    return out


def families():
    long = [f"t{k}" for k in range(300)]
    return {
        "near copies": varied(3, 150, 60, 6, "w", 3),
        "two families with a common half": [f"{a} {' '.join(f'c{k}' for k in range(40))}" for own in "uv" for a in varied(5, 60, 40, 3, own)],
        "beginnings of one text": [" ".join(long[:k]) for k in range(20, 300, 3)],
        "passage in many texts": [" ".join([f"p{i}_{k}" for k in range(i % 40)] + long[:30]) for i in range(200)],
        "revisions": [" ".join(f"r{k}" for k in range(i, i + 40)) for i in [*range(1, 400), 0]],
    }


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_families(spark, monkeypatch, small):
    """Large groups; ``small``: nearly every group has a pivot and many blocks, all n-grams of more than
    three texts are frequent, and all classes are too many to broadcast."""
    if small:
        for name, value in {"FEW": 2, "BLOCK_TEXTS": 16, "REPORT": 1, "HOT_LEAST": 4, "FEW_IDS": -1}.items():
            monkeypatch.setattr(jaccard_join, name, value)
    texts = [t for own in families().values() for t in own]
    ids = random.Random(1).sample(range(10 * len(texts)), len(texts))
    rows = list(zip(ids, texts, strict=True))
    got = jaccard_components(docs(spark, rows).repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == brute_jaccard(rows)


def test_texts_of_shared_passages(spark, monkeypatch):
    """Of 300 texts, each 16 of 24 passages, hardly any link: few pairs are verified, none twice."""
    rng = random.Random(1)
    passages = [" ".join(f"p{k}w{j}" for j in range(14)) for k in range(24)]
    rows = [(i, " ".join(rng.sample(passages, 16))) for i in range(300)]
    seen, verified = [], jaccard_join.verified

    def counted(pairs, sets, percent):
        seen.append(pairs)
        return verified(pairs, sets, percent)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    got = jaccard_components(docs(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == brute_jaccard(rows)
    every = seen[0].unionByName(seen[1])
    n = every.count()
    assert n == every.distinct().count() and n <= 3 * 16_748


def test_jaccard_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (3, "z")]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_components(docs(spark, rows).repartition(2)).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 3)]


def brute_components(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_components(spark):
    """A path, a path in mixed order, a star and random edges, beside one another."""
    pick = random.Random(2)
    mixed = pick.sample(range(1000, 1500), 500)
    edges = [(k, k + 1) for k in range(1, 400)] + [(399, 0)] + list(zip(mixed, mixed[1:], strict=False)) + [(2250, k) for k in range(2000, 2500) if k != 2250] * 2
    edges += [(pick.randrange(3000, 3600), pick.randrange(3000, 3600)) for _ in range(400)]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3), (3, None)], "u bigint, v bigint")
    got = {r.v: r.label for r in connected_components(df).collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]])
    assert connected_components(df.limit(0)).count() == 0


def test_more_buckets_than_partitions(spark, monkeypatch):
    """What is dealt to many buckets gives the same rows."""
    from reelspark.llm import substring_dedup

    monkeypatch.setattr(jaccard_join, "BUCKET_GRAMS", 5_000)
    monkeypatch.setattr(substring_dedup, "BUCKET_WORDS", 5_000)
    rows = hard_cases()
    assert sorted(tuple(r) for r in jaccard_components(docs(spark, rows).repartition(3)).collect()) == brute_jaccard(rows)
    assert sorted(tuple(r) for r in remove_repeats(docs(spark, rows).repartition(3)).drop("kept_text").collect()) == brute_repeats(rows)


def brute_repeats_of_rows(rows, size=13):
    """Like brute_repeats for rows that may repeat a doc_id."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(k, k + size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_repeated_ids(spark, seed):
    rng = random.Random(seed)
    p, q = (" ".join(f"{c}{k}" for k in range(30)) for c in "pq")
    parts = [p, q, " ".join(f"r{k}" for k in range(16)), "x y z", "a"]
    rows = [(0, p), (1, f"{q} {p}"), (1, f"{q} {p}"), (1, "other words"), (1, f"{p} tail"), (2, q), (2, p), (0, q + " " + p)]
    rows += [(rng.randrange(6), " ".join(rng.choice(parts) for _ in range(rng.randrange(6)))) for _ in range(40)] + [(3, None), (3, ""), (3, None)]
    df = docs(spark, [*rows, (None, p), (None, None)], clash=True).repartition(1 + 4 * seed)
    got = remove_repeats(df).drop("kept_text")
    assert sorted(tuple(r) for r in got.collect()) == brute_repeats_of_rows(rows)
