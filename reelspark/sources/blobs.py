"""Media files as binary objects: written by tasks, read and verified with ``binaryFile``."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of a frame, and the header of a 16 kHz mono 16-bit WAV file.
FRAME = 320
HEADER = 44


def write_blobs(rows: DataFrame, folder: str) -> int:
    """Writes each row's ``content`` to its ``key`` below ``folder``; returns how many. A task that runs
    anew writes the same files."""

    def run(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{root}/{key}"
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(path, compression=None) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("key", "content").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    """(key, content, length) of the files below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.substring_index("path", folder.rpartition("/")[2] + "/", -1).alias("key"), "content", "length")


def verify(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """``manifest`` (key, sha256, byte_length) with ``outcome``: key (absolute or climbing out), missing,
    length, sha256 or verified. Only names of sound keys are looked up."""
    unsafe = F.col("key").rlike(r"^/|(^|/)\.\.(/|$)|\\") | (F.col("key") == "")
    digests = found.select("key", F.col("length").alias("read"), F.sha2("content", 256).alias("digest"))
    both = manifest.withColumn("unsafe", F.coalesce(unsafe, F.lit(True))).join(digests, "key", "left")
    outcome = F.when(F.col("unsafe"), "key").when(F.col("digest").isNull(), "missing").when(~F.col("read").eqNullSafe(F.col("byte_length")), "length").when(~F.col("digest").eqNullSafe(F.col("sha256")), "sha256").otherwise("verified")
    return both.withColumn("outcome", outcome).drop("unsafe", "read", "digest")


def wav_format(content: Column) -> Column:
    """Whether a binary is a WAV file of 16 kHz, one channel, 16 bits, uncompressed, with a sample."""
    at = lambda place, n: F.hex(F.substring(content, place, n))
    fields = {(1, 4): "52494646", (9, 8): "57415645666D7420", (21, 4): "01000100", (25, 4): "803E0000", (35, 2): "1000", (37, 4): "64617461"}
    right = F.octet_length(content) >= HEADER + 2
    for (place, n), value in fields.items():
        right = right & (at(place, n) == value)
    return F.coalesce(right, F.lit(False))


def wav_frames(found: DataFrame) -> DataFrame:
    """(key, frame_no, samples, content) of the frames of FRAME samples, the last one shorter, of those
    ``blobs`` that :func:`wav_format` accepts."""
    good = found.where(wav_format(F.col("content")))
    n = F.expr(f"cast((octet_length(content) - {HEADER} + {2 * FRAME - 1}) div {2 * FRAME} as int)")
    frames = good.select("key", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame_no"))
    body = F.substring(F.col("content"), F.col("frame_no") * (2 * FRAME) + HEADER + 1, F.lit(2 * FRAME))
    return frames.select("key", F.col("frame_no").cast("bigint").alias("frame_no"), body.alias("content")).withColumn("samples", F.expr("cast(octet_length(content) div 2 as bigint)"))
