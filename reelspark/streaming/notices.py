"""Followers of transcripts: notices may be lost or doubled, so each is only a reason to read on from a cursor."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.sources.shared import shared_folder

DELIVERED = "session_id bigint, sequence bigint, how string"
CURSORS = "session_id bigint, cursor bigint"


def _at(cursors: DataFrame) -> DataFrame:
    return cursors.where("session_id is not null").select("session_id", "cursor")


def follow(spark: SparkSession, batches: Iterable[DataFrame], table: DataFrame, delay: str = "1 hour", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(DELIVERED, CURSORS) of a follower of ``batches`` of notices (session_id, sequence, ts).

    The stream drops a notice that repeats one within ``delay``; one that is later than that, or has no
    session, is lost. Each micro-batch reads the rows of ``table`` (session_id, sequence unique in it) from behind the
    session's cursor to the batch's highest notice by one join: ``how`` is ``notice`` for a row that a notice
    names and ``caught_up`` for one whose notice was lost. A session's notices tell of sequences that are all in ``table``.
    Cursors are a stored table of a row for each session; a micro-batch reads those of the one before and
    writes its own under its number, so one that runs again delivers the same. Each batch is a restart.
    """
    folder = folder or shared_folder(spark, "notices")

    def deliver(rows: DataFrame, batch_id: int) -> None:
        known_path = f"{folder}/known/{batch_id}"
        rows.select("session_id", "sequence").write.mode("overwrite").parquet(known_path)
        known = spark.read.schema("session_id bigint, sequence bigint").parquet(known_path)
        cursors = spark.createDataFrame([], CURSORS)
        if batch_id:
            cursors = spark.read.schema(CURSORS).parquet(f"{folder}/cursors/{batch_id - 1}")
        tops = known.groupBy("session_id").agg(F.max("sequence").alias("top"))
        moved = tops.join(_at(cursors), "session_id", "left").selectExpr("session_id", "coalesce(cursor, 0) as cursor", "top")
        fresh = table.select("session_id", "sequence").join(moved, "session_id").where("sequence > cursor and sequence <= top")
        named = fresh.join(known.withColumn("named", F.lit(True)), ["session_id", "sequence"], "left")
        how = F.when(F.col("named"), "notice").otherwise("caught_up").alias("how")
        named.select("session_id", "sequence", how).write.mode("overwrite").parquet(f"{folder}/delivered/{batch_id}")
        after = cursors.join(tops, "session_id", "full").select("session_id", F.greatest("cursor", "top").alias("cursor"))
        after.write.mode("overwrite").parquet(f"{folder}/cursors/{batch_id}")

    last = -1
    for k, batch in enumerate(batches):
        batch.select("session_id", "sequence", "ts").write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema("session_id bigint, sequence bigint, ts timestamp").parquet(f"{folder}/in/*")
        once = stream.where("session_id is not null and sequence >= 1").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "sequence"])
        query = once.writeStream.foreachBatch(deliver).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        last = max([last, *(p["batchId"] for p in query.recentProgress)])
    if last < 0:
        return spark.createDataFrame([], DELIVERED), spark.createDataFrame([], CURSORS)
    return spark.read.schema(DELIVERED).parquet(f"{folder}/delivered/*"), spark.read.schema(CURSORS).parquet(f"{folder}/cursors/{last}")


def reopened(table: DataFrame, cursors: DataFrame) -> DataFrame:
    """DELIVERED rows that a follower reads when it opens a session anew: those behind its cursor."""
    behind = table.select("session_id", "sequence").join(_at(cursors), "session_id", "left").where("sequence > coalesce(cursor, 0)")
    return behind.select("session_id", "sequence", F.lit("reopened").alias("how"))
