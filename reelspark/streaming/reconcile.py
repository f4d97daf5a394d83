"""The reconcile loop over a stream of ticks, with a snapshot of the jobs carried from tick to tick."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators.admission import Limits, admit, judge
from reelspark.sources.shared import shared_folder

JOBS = "utterance_id bigint, session_id bigint, sequence bigint, created bigint, state string, next_attempt bigint, claim_expires bigint, last_delivery bigint, updated bigint"
REPORT = "tick bigint, workload string, created bigint, converged bigint, repaired bigint, reserved bigint, wake_target bigint"


def _none(name: str):
    return F.lit(None).cast("bigint").alias(name)


def repaired(jobs: DataFrame, work: DataFrame, evidence: DataFrame, now: int, batch: int) -> DataFrame:
    """``jobs`` with the pass's repairs, named in ``change``: jobs of utterances that lack one (created), of
    those with evidence that have not succeeded (converged) and of those without it that have (repaired).
    Of each kind ``batch`` rows at most are taken, so they are broadcast."""
    lacking = work.join(jobs, "utterance_id", "left_anti").orderBy("created", "session_id", "sequence").limit(batch)
    fresh = lacking.select("utterance_id", "session_id", "sequence", "created", F.lit("pending").alias("state"), _none("next_attempt"), _none("claim_expires"), _none("last_delivery"), F.lit(now).cast("bigint").alias("updated"), F.lit("created").alias("change"))
    every = jobs.withColumn("change", F.lit(None).cast("string")).unionByName(fresh)
    there = evidence.where(F.col("at") <= now).select("utterance_id", "session_id").distinct()
    order = ("updated", "utterance_id")
    done = every.where("state <> 'succeeded'").join(there, ["utterance_id", "session_id"], "left_semi").orderBy(*order).limit(batch)
    false = every.where("state = 'succeeded'").join(there, ["utterance_id", "session_id"], "left_anti").orderBy(*order).limit(batch)
    marks = done.select("utterance_id", F.lit("converged").alias("_mark")).unionByName(false.select("utterance_id", F.lit("repaired").alias("_mark")))
    marked = every.join(F.broadcast(marks), "utterance_id", "left")
    state = F.when(F.col("_mark") == "converged", "succeeded").when(F.col("_mark") == "repaired", "pending").otherwise(F.col("state"))
    cleared = {c: F.when(F.col("_mark").isNull(), F.col(c)) for c in ("next_attempt", "claim_expires")}
    cleared["last_delivery"] = F.when(F.col("_mark") == "repaired", F.lit(None)).otherwise(F.col("last_delivery"))
    cleared["updated"] = F.when(F.col("_mark").isNull(), F.col("updated")).otherwise(now)
    return marked.withColumns({"state": state, **cleared})


def reconcile_class(jobs: DataFrame, sessions: DataFrame, workload: str, limits: Limits, now: int) -> DataFrame:
    """``jobs`` with the deliveries that a class of sessions (session_id, workload) gets now: ``delivery`` is new,
    or null. As many as the class's limit are broadcast."""
    own = {workload: limits}
    judged = judge(jobs.join(sessions, "session_id"), now, own)
    given = admit(judged, now, own).select("utterance_id", F.col("new_delivery").alias("delivery"))
    return jobs.join(F.broadcast(given), "utterance_id", "left")


def reconcile_loop(spark: SparkSession, jobs: DataFrame, work: DataFrame, evidence: DataFrame, sessions: DataFrame, ticks: list[int], classes: dict[str, Limits], batch: int) -> DataFrame:
    """REPORT of each tick (a time) and class.

    At a tick the classes are reconciled in their order, each from the snapshot that the one before left:
    repairs of all classes, then the class's fair reservation and its wake target. Ticks are a
    stream, one to a micro-batch; a micro-batch reads the snapshot of the one before and writes its own under
    its number, so one that runs again after a failure writes the same.
    """
    folder = shared_folder(spark, "reconcile")
    columns = [c.split()[0] for c in JOBS.split(", ")]
    jobs.select(*columns).write.parquet(f"{folder}/jobs/-1-{len(classes) - 1}")
    for k, now in enumerate(ticks):
        spark.createDataFrame([(k, now)], "tick bigint, now bigint").coalesce(1).write.parquet(f"{folder}/ticks/{k}")

    def pass_(rows: DataFrame, batch_id: int) -> None:
        tick, now = rows.first()
        before = f"{folder}/jobs/{batch_id - 1}-{len(classes) - 1}"
        for k, (workload, limits) in enumerate(classes.items()):
            path, own = f"{folder}/jobs/{batch_id}-{k}", spark.read.schema(JOBS).parquet(before)
            fixed = f"{folder}/fixed/{batch_id}-{k}"
            repaired(own, work, evidence, now, batch).write.mode("overwrite").parquet(fixed)
            marked = spark.read.schema(JOBS + ", change string, _mark string").parquet(fixed)
            after = reconcile_class(marked, sessions, workload, limits, now)
            stamped = {"last_delivery": F.coalesce("delivery", "last_delivery"), "updated": F.when(F.col("delivery").isNull(), F.col("updated")).otherwise(now)}
            after.withColumns(stamped).select(*columns, "change", "_mark", "delivery").write.mode("overwrite").parquet(path)
            done = spark.read.schema(JOBS + ", change string, _mark string, delivery bigint").parquet(path)
            own = {workload: limits}
            held = judge(done.join(sessions, "session_id"), now, own).agg(F.count_if("reserved").alias("wake_target"))
            counts = done.agg(*(F.count_if(x).alias(n) for n, x in (("created", F.col("change") == "created"), ("converged", F.col("_mark") == "converged"), ("repaired", F.col("_mark") == "repaired"), ("reserved", F.col("delivery").isNotNull()))))
            out = counts.crossJoin(held).select(F.lit(tick).cast("bigint").alias("tick"), F.lit(workload).alias("workload"), "created", "converged", "repaired", "reserved", "wake_target")
            out.write.mode("overwrite").parquet(f"{folder}/report/{batch_id}-{k}")
            before = path

    stream = spark.readStream.schema("tick bigint, now bigint").option("maxFilesPerTrigger", 1).parquet(f"{folder}/ticks/*")
    stream.writeStream.foreachBatch(pass_).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(REPORT).parquet(f"{folder}/report/*")
