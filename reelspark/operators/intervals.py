"""Algebra of closed intervals of whole numbers, by a sweep over their ends.

Intervals are rows (key, lo, hi); rows with a null or with lo > hi hold nothing. An interval is two ends,
so work follows the number of intervals, never their lengths. Running counts are made in two levels:
within blocks of BLOCK consecutive values, whose rows are bounded by the block's width, and over the
blocks of a key. So a key with a third of all intervals is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16

_AT, _BLOCK, _NEXT, _ASKED = "_at", "_block", "_next", "_asked"


def _ends(name: str, rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """A row of +1 where each interval begins and one of -1 behind its end."""
    both = rows.where(f"lo <= hi and `{key}` is not null").selectExpr(f"`{key}`", f"stack(2, cast(lo as bigint), 1, cast(hi as bigint) + 1, -1) as ({_AT}, _d)")
    return both.selectExpr(f"`{key}`", _AT, *(f"_d as {n}" if n == name else f"0 as {n}" for n in names))


def sweep(key: str, probes: DataFrame | None = None, **sets: DataFrame) -> DataFrame:
    """(key, lo, hi, one count for each named set): the stretches of values between neighbouring ends, with
    the number of the set's intervals that hold them. ``probes`` (key, lo) begin stretches of their own.
    Values before a key's first end and from its last one on are in no stretch with an interval; the
    stretch after the last end has a null hi."""
    names = list(sets)
    points = [_ends(n, rows, key, names) for n, rows in sets.items()]
    if probes is not None:
        points.append(probes.where(F.col(key).isNotNull() & F.col("lo").isNotNull()).select(key, F.col("lo").cast("bigint").alias(_AT), *(F.lit(0).alias(n) for n in names), F.lit(1).alias(_ASKED)))
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), points).withColumn(_BLOCK, F.expr(f"floor({_AT} / {BLOCK})"))
    kept = " or ".join([f"{n} <> 0" for n in names] + [f"{_ASKED} > 0"] * (probes is not None))
    # dealt by block, which serves the sums by value, the windows and the blocks' own sums
    summed = every.repartition(key, _BLOCK).groupBy(key, _BLOCK, _AT).agg(*(F.sum(n).alias(n) for n in [*names, *[_ASKED] * (probes is not None)])).where(kept)
    inside = f"over (partition by `{key}`, {_BLOCK} order by {_AT})"
    local = summed.selectExpr(f"`{key}`", _BLOCK, _AT, f"lead({_AT}) {inside} as {_NEXT}", *(f"sum({n}) {inside} as {n}" for n in names))
    over = f"over (partition by `{key}` order by {_BLOCK}"
    blocks = summed.groupBy(key, _BLOCK).agg(F.min(_AT).alias("_first"), *(F.sum(n).alias(f"_{n}") for n in names))
    blocks = blocks.selectExpr(f"`{key}`", _BLOCK, f"lead(_first) {over}) as _after", *(f"coalesce(sum(_{n}) {over} rows between unbounded preceding and 1 preceding), 0) as _{n}" for n in names))
    return local.join(blocks, [key, _BLOCK]).selectExpr(f"`{key}`", f"{_AT} as lo", f"coalesce({_NEXT}, _after) - 1 as hi", *(f"{n} + _{n} as {n}" for n in names))


def union(key: str, *rows: DataFrame) -> DataFrame:
    """(key, lo, hi): the longest intervals of values that any of ``rows`` holds; neighbours are joined."""
    every = reduce(DataFrame.unionByName, [r.select(key, "lo", "hi") for r in rows])
    return _joined(sweep(key, held=every).where("held > 0"), key)


def difference(key: str, rows: DataFrame, *others: DataFrame) -> DataFrame:
    """(key, lo, hi): the longest intervals of values that ``rows`` holds and none of ``others`` does."""
    away = reduce(DataFrame.unionByName, [r.select(key, "lo", "hi") for r in others])
    return _joined(sweep(key, held=rows, away=away).where("held > 0 and away = 0"), key)


def intersection(key: str, rows: DataFrame, other: DataFrame) -> DataFrame:
    """(key, lo, hi): the longest intervals of values that both hold."""
    return _joined(sweep(key, held=rows, also=other).where("held > 0 and also > 0"), key)


def _joined(rows: DataFrame, key: str) -> DataFrame:
    """Disjoint intervals, neighbours joined: the ends of neighbours cancel out."""
    return sweep(key, one=rows).where("one > 0").select(key, "lo", "hi")


def contained(points: DataFrame, key: str, value: str, rows: DataFrame) -> DataFrame:
    """``points`` with ``inside``: whether an interval of ``rows`` with the point's key holds its value;
    false where either is null. Rows that repeat a value stay as they are."""
    probes = points.select(F.col(key), F.col(value).alias("lo")).distinct()
    found = sweep(key, probes, held=rows).where("held > 0").select(F.col(key).alias("_key"), F.col("lo").alias("_value"), F.lit(True).alias("inside"))
    joined = points.join(found, (F.col(key) == F.col("_key")) & (F.col(value) == F.col("_value")), "left")
    return joined.drop("_key", "_value").withColumn("inside", F.coalesce("inside", F.lit(False)))
