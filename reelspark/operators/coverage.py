"""Which sequences of a session arrived, which its gaps cover, and which are missing, as ranges.

Ranges are rows (session_id, lo, hi); no step makes a row for each sequence, so a session whose final
sequence is 10^9 costs what its chunks and gaps do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators import intervals

KEY = "session_id"


def accepted(chunks: DataFrame) -> DataFrame:
    """Each chunk from sequence 1 on as a range of one; ranges may repeat."""
    return chunks.where("sequence >= 1").select(KEY, F.col("sequence").alias("lo"), F.col("sequence").alias("hi"))


def covered(gaps: DataFrame, sessions: DataFrame) -> DataFrame:
    """What gaps (session_id, lo, hi) cover within 1 to ``final_sequence``; ranges may overlap. Gaps of wall
    time, without lo or hi, cover nothing."""
    ranges = gaps.join(sessions.select(KEY, "final_sequence"), KEY)
    return ranges.selectExpr(KEY, "greatest(1L, lo) as lo", "least(hi, final_sequence) as hi").where("lo <= hi")


def expected(sessions: DataFrame) -> DataFrame:
    return sessions.where("final_sequence >= 1").select(KEY, F.lit(1).cast("bigint").alias("lo"), F.col("final_sequence").alias("hi"))


def missing(chunks: DataFrame, gaps: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, lo, hi): the longest ranges from 1 to ``final_sequence`` of which no sequence arrived or
    is covered."""
    return intervals.difference(KEY, expected(sessions), accepted(chunks), covered(gaps, sessions))


def declared(requested: DataFrame, gone: DataFrame) -> DataFrame:
    """(session_id, lo, hi): requested sequences (session_id, sequence) that are in ``gone``, as ranges."""
    return intervals.intersection(KEY, accepted(requested), gone)


def completeness(chunks: DataFrame, gaps: DataFrame, sessions: DataFrame) -> DataFrame:
    """empty, partial (a covered sequence did not arrive) or full, for each session."""
    lost = intervals.sweep(KEY, there=accepted(chunks), gone=covered(gaps, sessions)).where("gone > 0 and there = 0")
    kind = F.when(F.col("final_sequence") == 0, "empty").when(F.col("lost"), "partial").otherwise("full")
    return sessions.join(lost.select(KEY, F.lit(True).alias("lost")).distinct(), KEY, "left").select(KEY, kind.alias("audio_completeness"))


def reconcile(spool: DataFrame, sessions: DataFrame, arrived: DataFrame) -> DataFrame:
    """``spool`` chunks (session_id, sequence, epoch) with ``outcome``: removed where the session's epoch is
    the chunk's and its sequence lies in a range that the server accepted, else retained."""
    ranges = intervals.union(KEY, accepted(arrived))
    judged = intervals.contained(spool, KEY, "sequence", ranges).join(sessions.select(KEY, F.col("epoch").alias("_epoch")), KEY)
    same = F.col("inside") & F.col("epoch").eqNullSafe(F.col("_epoch"))
    return judged.withColumn("outcome", F.when(same, "removed").otherwise("retained")).drop("inside", "_epoch")
