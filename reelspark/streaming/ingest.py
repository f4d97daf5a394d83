"""Ingest as a stream: the first offer of a natural key is accepted, later ones repeat it or conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from reelspark.sources.shared import cut, shared_folder

KEY = ["session_id", "sequence"]
DECISIONS = "session_id bigint, sequence bigint, arrival bigint, outcome string"


def decided(offers: DataFrame, accepted: DataFrame | None) -> DataFrame:
    """``offers`` (session_id, sequence, arrival, identity) with ``outcome``, judged by the ``accepted`` ones of before
    (session_id, sequence, identity; one of a key) and by each other, by ascending arrival, an unknown one last."""
    both = offers.withColumn("_known", F.lit(False))
    if accepted is not None:
        both = both.unionByName(accepted.withColumn("_known", F.lit(True)), allowMissingColumns=True)
    own = Window.partitionBy(*KEY).orderBy(F.col("_known").desc(), F.col("arrival").asc_nulls_last())
    judged = both.withColumns({"_place": F.row_number().over(own), "_first": F.first("identity").over(own)}).where("not _known")
    outcome = F.when(F.col("_place") == 1, "accepted").when(F.col("identity").eqNullSafe(F.col("_first")), "idempotent").otherwise("conflict")
    return judged.select(*KEY, "arrival", "identity", outcome.alias("outcome"))


def ingested(spark: SparkSession, offers: DataFrame, identity: tuple[str, ...], batches: int) -> DataFrame:
    """DECISIONS for ``offers`` (session_id, sequence, arrival and ``identity``'s columns), run as a stream in ``batches``
    by arrival, each a restart. Offers of one key with equal arrival are taken in any order; null keys are left out, as
    the natural key forbids them.

    What is accepted is a stored table: a micro-batch reads what those before it have accepted, of the sessions between
    the least and the greatest of its own, and writes its decisions under its number, so one that runs again after a
    failure decides the same.
    """
    folder = shared_folder(spark, "ingest")
    kept = cut(offers.where("session_id is not null and sequence is not null").select(*(F.col(c).cast("bigint") for c in (*KEY, "arrival")), F.struct(*identity).alias("identity")), "offers")
    schema = StructType([*kept.schema.fields]).add("outcome", StringType())

    def decide(rows: DataFrame, batch_id: int) -> None:
        before = None
        if batch_id:
            least, most = rows.agg(F.min("session_id"), F.max("session_id")).first()
            stored = rows.sparkSession.read.schema(schema).parquet(*(f"{folder}/out/{k}" for k in range(batch_id)))
            before = stored.where((F.col("outcome") == "accepted") & F.col("session_id").between(least, most)).select(*KEY, "identity")
        found = decided(rows, before).withColumn("identity", F.when(F.col("outcome") == "accepted", F.col("identity")))
        found.write.mode("overwrite").parquet(f"{folder}/out/{batch_id}")

    lo, hi = (x or 0 for x in kept.agg(F.min("arrival"), F.max("arrival")).first())
    part = F.expr(f"coalesce((arrival - {lo}L) div {(hi - lo) // batches + 1}L, {batches - 1})")
    last = -1
    for k in range(batches):
        kept.where(part == k).write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(kept.schema).parquet(f"{folder}/in/*")
        query = stream.writeStream.foreachBatch(decide).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        last = max([last, *(p["batchId"] for p in query.recentProgress)])
    if last < 0:
        return spark.createDataFrame([], DECISIONS)
    return spark.read.schema(DECISIONS).parquet(*(f"{folder}/out/{k}" for k in range(last + 1)))
