"""Fair admission of durable jobs.

Jobs: utterance_id, session_id, sequence, created, state, next_attempt, claim_expires and
last_delivery; times are numbers of seconds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Outstanding jobs of a class and of one of its sessions, and seconds between deliveries."""

    total: int
    per_session: int
    cooldown: int = 15


def ready(jobs: DataFrame, now: int, cooldown: int | Column) -> DataFrame:
    """``jobs`` with ``eligible``, ``reserved`` and ``outstanding``.

    Pending jobs, due retries and expired claims may be delivered when none was within the cooldown; the
    latter two also when the last delivery came before they were due. Those delivered within it
    otherwise are reserved; outstanding are these and the claims that hold.
    """
    last, due = F.col("last_delivery"), F.when(F.col("state") == "retry_wait", F.col("next_attempt")).when(F.col("state") == "claimed", F.col("claim_expires"))
    waits = F.coalesce((F.col("state") == "pending") | (due <= now), F.lit(False))
    recent = F.coalesce(last > now - cooldown, F.lit(False))
    anew = F.coalesce(last < due, F.lit(False))
    active = F.coalesce((F.col("state") == "claimed") & (F.col("claim_expires") > now), F.lit(False))
    return jobs.withColumns({"eligible": waits & (~recent | anew), "reserved": waits & recent & ~anew}).withColumn("outstanding", F.col("reserved") | active)


def by_class(classes: dict[str, Limits], field: str) -> Column:
    """A limit by the column ``workload``."""
    out = F.lit(None).cast("bigint")
    for name, limits in classes.items():
        out = F.when(F.col("workload") == name, F.lit(getattr(limits, field)).cast("bigint")).otherwise(out)
    return out


def judge(jobs: DataFrame, now: int, classes: dict[str, Limits]) -> DataFrame:
    """:func:`ready` for jobs of several classes (``workload``), each with its cooldown."""
    return ready(jobs.where(F.col("workload").isin(*classes)), now, by_class(classes, "cooldown"))


def admit(judged: DataFrame, now: int, classes: dict[str, Limits]) -> DataFrame:
    """(workload, utterance_id, session_id, rank, place, new_delivery) of the jobs that are delivered next, of
    all classes in one pass over ``judged``.

    The n-th eligible job of a session comes after every session's (n - 1)-th; among equals the session
    goes first that was served longest ago, one never served counting from its oldest job on. Free
    places are what outstanding jobs leave of the limits. Ranks and places are cut at the classes' limits
    before rows are shuffled, so no task holds a session or a class.
    """
    session = ["workload", "session_id"]
    by_session = judged.groupBy(*session).agg(F.count_if("outstanding").alias("busy"), F.coalesce(F.max("last_delivery"), F.min("created")).alias("turn"))
    used = by_session.groupBy("workload").agg(F.sum("busy").alias("used"))
    order = Window.partitionBy(*session).orderBy("sequence", "created", "utterance_id")
    ranked = judged.where("eligible").withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= max(x.per_session for x in classes.values()))
    open_ = ranked.join(by_session, session).where(F.col("rank") <= by_class(classes, "per_session") - F.col("busy"))
    line = Window.partitionBy("workload").orderBy("rank", "turn", "session_id", "utterance_id")
    first = open_.withColumn("place", F.row_number().over(line).cast("bigint")).where(F.col("place") <= max(x.total for x in classes.values()))
    held = first.join(F.broadcast(used), "workload").where(F.col("place") <= by_class(classes, "total") - F.col("used"))  # a row for each class
    return held.select("workload", "utterance_id", "session_id", "rank", "place", F.greatest("last_delivery", F.lit(now).cast("bigint")).alias("new_delivery"))


def reserve(jobs: DataFrame, now: int, limits: Limits) -> DataFrame:
    """(utterance_id, session_id, rank, new_delivery) that :func:`admit` finds for jobs of one class."""
    classes = {"": limits}
    return admit(judge(jobs.withColumn("workload", F.lit("")), now, classes), now, classes).select("utterance_id", "session_id", "rank", "new_delivery")


def claim_next(jobs: DataFrame, now: int, cooldown: int) -> DataFrame:
    """The reserved job that a worker takes: delivered first, then by age, session and place in it."""
    return ready(jobs, now, cooldown).where("reserved").orderBy("last_delivery", "created", "session_id", "sequence", "utterance_id").limit(1)
