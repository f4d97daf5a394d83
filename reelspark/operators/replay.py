"""Final states of durable work from its ordered attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replay(attempts: DataFrame, most: int) -> DataFrame:
    """(key, state, attempts) from (key, at, outcome).

    An outcome other than ``retry`` or ``permanent`` is the state that ends the work; a permanent error,
    and a retry at the ``most``-th attempt, fail it; until then a retry waits. Attempts after the end are
    not made, so no more than ``most`` of a key are read.
    """
    tries = attempts.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("at"))).where(F.col("rn") <= most)
    ends = F.when((F.col("outcome") == "permanent") | ((F.col("outcome") == "retry") & (F.col("rn") == most)), "failed").when(F.col("outcome") != "retry", F.col("outcome"))
    first = tries.withColumn("ends", ends).groupBy("key").agg(F.min(F.when(F.col("ends").isNotNull(), F.struct("rn", "ends"))).alias("e"), F.max("rn").alias("n"))
    return first.select("key", F.coalesce("e.ends", F.lit("retry_wait")).alias("state"), F.coalesce("e.rn", "n").cast("bigint").alias("attempts"))


def release_outcome(installed: Column, safe: Column, migrated: Column, healthy: Column, back_healthy: Column) -> Column:
    """Where applying a pulled release ends: a failed migration and a failure that cannot or must not be
    undone call for recovery by hand; a candidate that does not become healthy is rolled back where the
    release before is known and listed as safe, if that one becomes healthy again."""
    return (
        F.when(~migrated, "migration_failed_manual_recovery").when(healthy, "success").when(~installed, "install_failed_manual_recovery")
        .when(~safe, "rollback_refused_unsafe").when(~back_healthy, "rollback_failed_manual_recovery").otherwise("rolled_back_to_previous_known_good")
    )
