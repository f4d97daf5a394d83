import random

import pytest

from reelspark.operators import coverage, intervals

SHAPE = "session_id bigint, lo bigint, hi bigint"


def rows(df):
    return sorted(map(tuple, df.collect()))


def ranges(values):
    out = []
    for x in sorted(values):
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_algebra_equals_sets(spark, monkeypatch, block):
    monkeypatch.setattr(intervals, "BLOCK", block)
    rng = random.Random(block)

    def made(n):
        found = [(rng.choice([1, 1, 1, 2, 3]), lo := rng.randrange(-20, 60), lo + rng.randrange(-2, 9)) for _ in range(n)]
        return found + found[:3] + [(None, 1, 2), (1, None, 5), (2, 5, None)]

    def values(found, key):
        return {x for k, lo, hi in found if k == key and lo is not None and hi is not None for x in range(lo, hi + 1)}

    a, b, c = made(14), made(9), made(5)
    da, db, dc = (spark.createDataFrame(x, SHAPE).selectExpr("*", "'x' as held") for x in (a, b, c))
    for df, want in (
        (intervals.union("session_id", da, db), lambda k: values(a, k) | values(b, k)),
        (intervals.difference("session_id", da, db, dc), lambda k: values(a, k) - values(b, k) - values(c, k)),
        (intervals.intersection("session_id", da, db), lambda k: values(a, k) & values(b, k)),
    ):
        assert rows(df) == [(k, *r) for k in (1, 2, 3) for r in ranges(want(k))]
    points = [(k, v, "p") for k in (1, 2, 3, 9, None) for v in (-30, *range(-20, 70, 3), None)] * 2
    got = intervals.contained(spark.createDataFrame(points, "session_id bigint, sequence bigint, held string"), "session_id", "sequence", da)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((k, v, h, None not in (k, v) and v in values(a, k))) for k, v, h in points)
    none = da.limit(0)
    assert rows(intervals.union("session_id", none)) == rows(intervals.difference("session_id", none, da)) == []


def test_long_sessions_cost_their_chunks(spark):
    final = 10**9
    sessions = spark.createDataFrame([(1, final), (2, 3), (3, 0), (4, 2)], "session_id bigint, final_sequence bigint")
    chunks = spark.createDataFrame([(1, 1), (1, 2), (1, 70_000), (1, 70_000), (1, final), (2, 1), (2, 3), (4, 1), (4, 2), (1, 0)], "session_id bigint, sequence bigint")
    gaps = spark.createDataFrame([(1, -5, 4), (1, 10**8, 2 * 10**9), (4, 2, 2), (4, None, None)], SHAPE)
    want = [(1, 5, 69_999), (1, 70_001, 10**8 - 1), (2, 2, 2)]
    assert rows(coverage.missing(chunks, gaps, sessions)) == want
    assert rows(coverage.completeness(chunks, gaps, sessions)) == [(1, "partial"), (2, "full"), (3, "empty"), (4, "full")]
    asked = spark.createDataFrame([(1, 5), (1, 6), (1, 9), (1, 2), (2, 2), (4, 1)], "session_id bigint, sequence bigint")
    assert rows(coverage.declared(asked, coverage.missing(chunks, gaps, sessions))) == [(1, 5, 6), (1, 9, 9), (2, 2, 2)]


def test_missing_then_late(spark):
    """Chunks 1 and 3 of three leave 2 missing; once it arrives nothing is."""
    sessions = spark.createDataFrame([(1, 3)], "session_id bigint, final_sequence bigint")
    none = spark.createDataFrame([], SHAPE)
    for there, want in (([1, 3], [(1, 2, 2)]), ([1, 3, 2], [])):
        chunks = spark.createDataFrame([(1, s) for s in there], "session_id bigint, sequence bigint")
        assert rows(coverage.missing(chunks, none, sessions)) == want


def test_wall_only_gap_is_full(spark):
    sessions = spark.createDataFrame([(1, 1)], "session_id bigint, final_sequence bigint")
    chunks = spark.createDataFrame([(1, 1)], "session_id bigint, sequence bigint")
    gaps = spark.createDataFrame([(1, None, None)], SHAPE)
    assert rows(coverage.completeness(chunks, gaps, sessions)) == [(1, "full")]


def test_range_reconcile(spark):
    """Accepted ranges 1-2 and 4: chunks of the session's epoch in them go, a hole's and another epoch's stay."""
    sessions = spark.createDataFrame([(1, 7)], "session_id bigint, epoch bigint")
    arrived = spark.createDataFrame([(1, s) for s in (1, 2, 4)], "session_id bigint, sequence bigint")
    spool = spark.createDataFrame([(1, 1, 7), (1, 2, 6), (1, 3, 7), (1, 4, 7), (1, 4, None), (1, 5, 7)], "session_id bigint, sequence bigint, epoch bigint")
    got = sorted((r.sequence, r.epoch, r.outcome) for r in coverage.reconcile(spool, sessions, arrived).collect() if r.epoch)
    assert got == [(1, 7, "removed"), (2, 6, "retained"), (3, 7, "retained"), (4, 7, "removed"), (5, 7, "retained")]
