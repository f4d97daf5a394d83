import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reelspark.operators.fence import EpochFence
from reelspark.operators.prefix import scan

CLAIMS = "session_id bigint, event_id bigint, writer bigint, expected bigint"


def fold(claims, modulus):
    """One pass over each session's claims."""
    out, by_session = [], defaultdict(list)
    for s, e, w, x in sorted(claims, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        by_session[s].append((e, w, x))
    for own in by_session.values():
        epoch, active = 0, None
        for e, w, x in own:
            told = epoch % modulus if modulus else epoch
            if x is not None and x == told:
                epoch, active, outcome = epoch + 1, w, "valid"
            elif x is not None and epoch and w == active and (x + 1 == epoch if not modulus else (x + 1) % modulus == epoch % modulus):
                outcome = "replay"
            else:
                outcome = "stale"
            out.append((e, epoch, outcome))
    return sorted(out)


@pytest.mark.parametrize("modulus", [5, None])
def test_one_session_over_many_tasks(spark, modulus):
    rng = random.Random(4)
    claims, epoch = [], 0
    for k in range(4000):
        expected = rng.choice([epoch, epoch, epoch - 1, epoch + 1, rng.randrange(9), None]) if rng.random() < 0.6 else epoch - 1
        epoch += expected == epoch
        claims.append((7, k, rng.randrange(3), expected if modulus is None or expected is None else expected % modulus))
    claims += [(None, 5000 + k, 1, k // 2) for k in range(6)] + [(1, 6000, 2, 3), (2, 6001, None, 0), (2, 6002, None, 0)]
    df = spark.createDataFrame(claims, CLAIMS)
    got = scan(df, ["event_id"], EpochFence(modulus), blocks=12)
    assert sorted(map(tuple, got.collect())) == fold(claims, modulus)
    assert scan(df.limit(0), ["event_id"], EpochFence(modulus)).count() == 0


def test_blocks_share_one_session(spark):
    df = spark.range(20_000).select(F.lit(1).cast("bigint").alias("session_id"), F.col("id").alias("event_id"), F.lit(0).cast("bigint").alias("writer"), F.col("id").alias("expected"))
    out = scan(df, ["event_id"], EpochFence(), blocks=8)
    tasks = out.select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks >= 4 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert out.agg(F.max("epoch"), F.count_if(F.col("outcome") == "valid")).first() == (20_000, 20_000)


def test_maps_compose():
    rng = random.Random(9)
    for modulus in (3, 5, None):
        fence = EpochFence(modulus)
        claims = [(k, rng.randrange(2), rng.randrange(5 if modulus is None else modulus)) for k in range(60)]
        for start in range(6):
            want = [None, None]
            for _, epoch, outcome in fence.run(iter(claims), f"[{start}, 9]"):
                want[0] = epoch
            state = f"[{start}, 9]"
            for k in range(0, 60, 13):
                state = fence.apply(fence.summary(iter(claims[k : k + 13])), state)
            assert state.startswith(f"[{want[0]},")
