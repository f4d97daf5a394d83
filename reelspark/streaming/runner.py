"""Runs a streaming query over stored rows, micro-batch by micro-batch, with a restart before each."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def restarted(spark: SparkSession, batches: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """The rows that ``build`` of the stream of ``batches`` (of one schema) appends. After each batch is
    written, a new query goes on from the checkpoint of the one before, so state must outlive it."""
    before, out = spark.conf.get(PROVIDER), None
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        for k, batch in enumerate(batches):
            batch.write.parquet(f"{folder}/in/{k}")
            out = build(spark.readStream.schema(batch.schema).parquet(f"{folder}/in/*"))
            query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
