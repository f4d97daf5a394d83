import random

import pytest
from pyspark.sql import functions as F

from reelspark.plans.continuity import CHUNK, offered
from reelspark.streaming.ingest import ingested
from reelspark.streaming.leases import interruptions


def holes(beats, lease):
    """Holes of more than ``lease`` seconds behind a beat; the last beat of all is not late yet."""
    out, now = [], max(t for _, _, t in beats) + lease
    for s in {b[0] for b in beats}:
        own = sorted((t, e) for k, e, t in beats if k == s)
        for (t, e), (nxt, _) in zip(own, [*own[1:], (None, None)], strict=True):
            if nxt is not None and nxt > t + lease:
                out.append((s, e, t, "recovered"))
            elif nxt is None and now > t + lease:
                out.append((s, e, t, "open"))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4])
def test_leases_in_any_split(spark, batches):
    rng = random.Random(1)
    beats = [(s, 1000 * s + k, 1_700_000_000 + rng.randrange(400)) for s in (1, 2, 3) for k in range(25)] + [(9, 1, 1_700_000_000)]
    df = spark.createDataFrame(beats + [(None, 5, 1_700_000_001), (4, 6, None)], "session_id bigint, event_id bigint, s bigint").selectExpr("session_id", "event_id", "timestamp_seconds(s) as ts")
    got = interruptions(spark, df, 20, batches)
    assert sorted((r.session_id, r.event_id, r["at"] // 1_000_000, r.outcome) for r in got.collect()) == holes(beats, 20)
    assert interruptions(spark, df.limit(0), 20, 2).count() == 0


def test_ingest_decisions_outlive_restarts(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(6) * 700, k, "w", 1, 0, 2, "audio/webm", rng.choice(["a", "a", "b"]), rng.choice([1, 1, None])) for k in range(120)]
    names = "session_id bigint, sequence bigint, arrival bigint, writer_id string, epoch bigint, start_ms bigint, end_ms bigint, content_type string, sha256 string, byte_length bigint"
    offers = spark.createDataFrame(rows, names)
    want = sorted(map(tuple, offered(offers, ["session_id", "sequence"], ["arrival"], CHUNK).collect()))
    for batches in (1, 5):
        found = ingested(spark, offers, CHUNK, batches)
        assert found.count() == len(rows)
        counts = found.groupBy("session_id", "sequence").agg(*(F.count_if(F.col("outcome") == o) for o in ("accepted", "idempotent", "conflict")))
        assert sorted(map(tuple, counts.collect())) == want


def test_ingest_reads_each_offer_once_and_keeps_unknown_arrivals(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        made.add(1)
        return x

    rows = [(k // 2 % 20_000, k // 40_000, None if k == 39_999 else k, "b" if k % 6 == 1 else "a") for k in range(80_000)]
    offers = spark.createDataFrame(rows, "session_id bigint, sequence bigint, arrival bigint, raw string")
    found = ingested(spark, offers.withColumn("sha256", counted("raw")), ("sha256",), 3)
    got = {(r.session_id, r.sequence): (r.accepted, r.idempotent, r.conflict) for r in found.groupBy("session_id", "sequence").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("accepted", "idempotent", "conflict"))).collect()}
    assert got == {(k // 2 % 20_000, k // 40_000): (1, int(k % 6 != 0), int(k % 6 == 0)) for k in range(0, 80_000, 2)}
    assert made.value == len(rows)
    assert found.where("session_id = 19999 and sequence = 0 and arrival is null").first().outcome == "idempotent"
    assert ingested(spark, offers.limit(0), ("raw",), 2).count() == 0
