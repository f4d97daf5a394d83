"""Immutable objects by key, written by a data source: the first job that commits a key has it.

Tasks write each content to a file named by its digest, so a task that runs twice leaves one object, and
an index of their own. The job's commit publishes one numbered marker that names the indexes of the
attempts that counted; until then, and after an abort, nothing of the job is seen.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from reelspark.sources.publish import names, opened, publish, replace

INDEX = "key string, task bigint, place bigint, sha256 string, byte_length bigint"
_INDEX = pa.schema([("key", pa.string()), ("task", pa.int64()), ("place", pa.int64()), ("sha256", pa.string()), ("byte_length", pa.int64())])
FETCHED = "key string, sha256 string, byte_length bigint, sound boolean, content binary"


def object_path(sha256: str) -> str:
    return f"objects/{sha256[:2]}/{sha256}"


@dataclass
class Attempt(WriterCommitMessage):
    """The index of a task attempt."""

    name: str


class ObjectWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        fs, root = opened(self.folder)
        context = TaskContext.get()
        task, place, name = context.partitionId() if context else 0, 0, f"{uuid.uuid4().hex}.parquet"
        fs.create_dir(f"{root}/index/{self.job}", recursive=True)
        with fs.open_output_stream(f"{root}/index/{self.job}/{name}", compression=None) as out, pq.ParquetWriter(out, _INDEX) as index:
            for batch in iterator:
                rows = []
                for key, content in zip(batch.column("key"), batch.column("content"), strict=True):
                    if key.is_valid and content.is_valid:
                        data = content.as_py()
                        sha256 = hashlib.sha256(data).hexdigest()
                        path = f"{root}/{object_path(sha256)}"
                        if fs.get_file_info(path).size != len(data):
                            replace(fs, path, data)
                        rows.append((key.as_py(), task, place, sha256, len(data)))
                        place += 1
                index.write_batch(pa.RecordBatch.from_pylist([dict(zip(_INDEX.names, r, strict=True)) for r in rows], schema=_INDEX))
        return Attempt(name)

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, root = opened(self.folder)
        own = sorted(m.name for m in messages if m is not None)
        marker = json.dumps({"job": self.job, "names": own}).encode()
        while True:
            taken = names(fs, f"{root}/commits")
            number = int(taken[-1].partition(".")[0]) + 1 if taken else 0
            if publish(fs, f"{root}/commits/{number:020d}.json", marker):
                break
        for name in set(names(fs, f"{root}/index/{self.job}")) - set(own):
            fs.delete_file(f"{root}/index/{self.job}/{name}")

    def abort(self, messages: list[Attempt | None]) -> None:
        fs, root = opened(self.folder)
        if fs.get_file_info(f"{root}/index/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/index/{self.job}")


class ObjectSink(DataSource):
    """``df.write.format("first_objects").mode("append").save(folder)`` for (key string, content binary).

    Rows without a key or content name no object and are left out. Of rows of one job with one key the
    first of the first task counts.
    """

    @classmethod
    def name(cls) -> str:
        return "first_objects"

    def writer(self, schema, overwrite: bool) -> ObjectWriter:
        if overwrite:
            raise ValueError("objects are never replaced; use mode append")
        return ObjectWriter(self.options["path"])


def put(rows: DataFrame, folder: str) -> None:
    """Offers ``rows`` (key, content) as one job."""
    rows.sparkSession.dataSource.register(ObjectSink)
    rows.select(F.col("key").cast("string"), F.col("content").cast("binary")).write.format("first_objects").mode("append").save(folder)


def winners(spark: SparkSession, folder: str) -> DataFrame:
    """(key, sha256, byte_length) of each key's first committed offer."""
    fs, root = opened(folder)
    if not names(fs, f"{root}/commits"):
        return spark.createDataFrame([], "key string, sha256 string, byte_length bigint")
    marks = spark.read.schema("job string, names array<string>").json(f"{folder}/commits/*.json")
    number = F.regexp_extract("_metadata.file_name", "^[0-9]+", 0).cast("bigint")
    named = marks.select(number.alias("number"), F.explode("names").alias("name"))
    index = spark.read.schema(INDEX).option("recursiveFileLookup", "true").parquet(f"{folder}/index").select("*", F.col("_metadata.file_name").alias("name"))
    first = F.min_by(F.struct("sha256", "byte_length"), F.struct("number", "task", "place"))
    return index.join(named, "name").groupBy("key").agg(first.alias("first")).select("key", "first.*")


def fetch(spark: SparkSession, folder: str) -> DataFrame:
    """FETCHED: the winners with their contents; ``sound`` is whether the file has the length and digest
    of its index (a missing one has not, and null content). One object at a time is in memory."""

    def run(batches):
        fs, root = opened(folder)
        for batch in batches:
            for key, sha256, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path, data = f"{root}/{object_path(sha256)}", None
                if fs.get_file_info(path).type == pafs.FileType.File:
                    with fs.open_input_stream(path) as file:
                        data = file.read()
                sound = data is not None and len(data) == length and hashlib.sha256(data).hexdigest() == sha256
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha256]), pa.array([length], pa.int64()), pa.array([sound]), pa.array([data], pa.binary())], names=["key", "sha256", "byte_length", "sound", "content"])

    return winners(spark, folder).select("key", "sha256", "byte_length").mapInArrow(run, FETCHED)


def sweep(spark: SparkSession, folder: str) -> int:
    """Removes the objects that no winner refers to, and returns how many; no job may be writing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/objects").select(F.substring_index("path", "/", -1).alias("sha256"))

    def run(batches):
        fs, root = opened(folder)
        for batch in batches:
            for sha256 in batch.column(0).to_pylist():
                path = f"{root}/{object_path(sha256)}"
                if fs.get_file_info(path).type == pafs.FileType.File:
                    fs.delete_file(path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.join(winners(spark, folder), "sha256", "left_anti").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
