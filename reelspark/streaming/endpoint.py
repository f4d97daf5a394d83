"""The endpoint detector on a stream of frames, with a detector for each stream as state."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelspark.operators.endpoint import SEGMENTS, Detector, Settings

FRAMES = "stream_id bigint, frame_no bigint, sample_offset bigint, size bigint, level double, ends boolean"


class EndpointProcessor(StatefulProcessor):
    """Frames of a micro-batch in order; a jump of the offset resets what is in flight, a row that
    ``ends`` closes the stream. A stream that is not closed keeps its tail."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("detector", "held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        detector, end, n = Detector(self.settings), None, 0
        if self.held.exists():
            detector.noise, detector.start, detector.voiced, detector.quiet, lead, end, n = json.loads(self.held.get()[0])
            detector.lead.extend(map(tuple, lead))
        frames = pd.concat(list(rows)).sort_values(["ends", "frame_no"])
        columns = (frames[c].tolist() for c in ("sample_offset", "size", "level", "ends"))
        for offset, size, level, ends in zip(*columns, strict=True):
            if ends:
                if end is not None:
                    detector.finish(end)
                continue
            if end is not None and offset != end:
                detector.reset()
            detector.frame(int(offset), int(size), math.nan if level is None else float(level))
            end = int(offset + size)
        out = [(key[0], n + k + 1, *x) for k, x in enumerate(detector.out)]
        self.held.update((json.dumps([detector.noise, detector.start, detector.voiced, detector.quiet, list(detector.lead), end, n + len(out)]),))
        yield pd.DataFrame(out, columns=["stream_id", "ordinal", "start_sample", "end_sample", "voiced"])

    def close(self) -> None:
        pass


def segment_stream(frames: DataFrame, settings: Settings) -> DataFrame:
    """Segments of a streaming DataFrame of FRAMES, as each ends."""
    return frames.groupBy("stream_id").transformWithStateInPandas(EndpointProcessor(settings), SEGMENTS, "Append", "None")


def run_in_batches(spark: SparkSession, frames: DataFrame, settings: Settings, folder: str, batches: int) -> DataFrame:
    """Runs the stream over ``frames`` (without ``ends``), cut into micro-batches by frame_no and closed by
    end markers; returns its rows."""
    source = f"{folder}/frames"
    stream = spark.readStream.schema(FRAMES).parquet(f"{source}/*")
    most = (frames.agg(F.max("frame_no")).first()[0] or 0) + 1
    part = frames.withColumn("ends", F.lit(False)).withColumn("batch", F.expr(f"least({batches - 1}, cast(frame_no * {batches} div {most} as int))"))
    marks = frames.select("stream_id").distinct().selectExpr("stream_id", f"{most}L as frame_no", "0L as sample_offset", "0L as size", "0D as level", "true as ends")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(batches + 1):
            (marks if k == batches else part.where(f"batch = {k}").drop("batch")).select(*(c.split()[0] for c in FRAMES.split(", "))).write.parquet(f"{source}/{k}")
            query = segment_stream(stream, settings).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(SEGMENTS).parquet(f"{folder}/out")
