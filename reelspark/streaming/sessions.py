"""Heartbeat sessions as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.sources.shared import shared_folder


DELAY = "1 hour"


def heartbeat_sessions(spark: SparkSession, sf_dir: str, gap: str = "6 hours") -> DataFrame:
    """Sessions of each user's events (user_id, started, last heartbeat, beats), by an event-time
    session window with a watermark. The stream is run to its end and then goes on with one end
    marker, an event so late that the watermark passes every session; only the marker's own session
    stays open."""
    folder = shared_folder(spark, "heartbeats")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = batch.select(F.max(F.col("ts").cast("timestamp")).alias("ts"))
    marker = last.where("ts is not null").selectExpr("cast(null as bigint) as user_id", f"ts + interval '{gap}' + 2 * interval '{DELAY}' as ts")
    marker.limit(0).write.parquet(f"{folder}/marker")

    def streamed(schema, path: str) -> DataFrame:
        return spark.readStream.schema(schema).parquet(path).select(F.col("user_id").cast("bigint").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))

    events = streamed(batch.schema, f"{sf_dir}/events.parque[t]").unionByName(streamed(marker.schema, f"{folder}/marker"))
    window = F.session_window("ts", gap)
    found = events.withWatermark("ts", DELAY).groupBy("user_id", window).agg(F.count("*").alias("beats"), F.max("ts").alias("last"))
    rows = found.select("user_id", F.unix_timestamp("session_window.start").alias("started"), F.unix_timestamp("last").alias("last_heartbeat"), "beats")

    def run_to_end() -> None:
        query = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    run_to_end()
    marker.write.mode("append").parquet(f"{folder}/marker")
    run_to_end()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")
