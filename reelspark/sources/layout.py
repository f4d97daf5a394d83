"""Transcripts on disk: a layout whose pages read few row groups, and exports in ordered parts."""

from __future__ import annotations

import hashlib
import io
from contextlib import ExitStack
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.formats import clock, line_feeds
from reelspark.sources.publish import opened, replacing
from reelspark.sources.shared import cut

TIMELINE = ["start_ms", "end_ms", "sequence"]


def write_clustered(segments: DataFrame, folder: str, group_bytes: int = 16 << 20) -> None:
    """``segments`` as Parquet in ranges of (session_id, timeline), sorted, in row groups of ``group_bytes``,
    whose statistics let a page of one session skip the others, in its files too."""
    dealt = segments.repartitionByRange("session_id", *TIMELINE).sortWithinPartitions("session_id", *TIMELINE)
    dealt.write.option("parquet.block.size", group_bytes).parquet(folder)


def page(spark: SparkSession, folder: str, session: int, size: int, anchor: int | None = None) -> DataFrame | None:
    """The ``size`` + 1 segments in timeline order behind the one of sequence ``anchor``, or the first ones;
    more than ``size`` rows tell that there are more. None where the session has no such anchor."""
    own = spark.read.parquet(folder).where(F.col("session_id") == session)
    if anchor is not None:
        place = own.where(F.col("sequence") == anchor).select(*TIMELINE).first()
        if place is None:
            return None
        behind = F.struct(*TIMELINE) > F.struct(*(F.lit(x).cast("bigint").alias(n) for n, x in zip(TIMELINE, place, strict=True)))
        own = own.where((F.col("start_ms") >= place.start_ms) & behind)
    return own.orderBy(*TIMELINE).limit(size + 1)


def numbered(segments: DataFrame, blocks: int | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """``segments`` (of ``sessions``, if given) with ``_block``, ``number`` (1, 2, ... of a session's timeline) and
    ``total``; a task has whole blocks, by block, session and number.

    Rows are dealt by ranges, so a long session has many blocks; a block's rows are counted on from the sums
    of those before it, of which a session has one row each. That row goes ahead of the block's rows of the session, so
    that they are shuffled once. Without ``blocks`` there are as many as the session's shuffle partitions, small ones
    merged. Rows without a session are left out.
    """
    own = segments.where("session_id is not null")
    dealt = own.repartitionByRange(blocks, "session_id", *TIMELINE) if blocks else own.repartitionByRange("session_id", *TIMELINE)
    placed = cut(dealt.withColumn("_block", F.spark_partition_id()), "timeline", "zstd")
    counts = placed.groupBy("session_id", "_block").agg(F.count("*").alias("n"))
    sums = counts.selectExpr("session_id", "_block", "sum(n) over (partition by session_id order by _block) - n as _before", "sum(n) over (partition by session_id) as _total")
    if sessions is not None:
        sums = sums.join(sessions.select("session_id"), "session_id", "left_semi")
    window = f"over (partition by _block, session_id order by _before is null, {', '.join(TIMELINE)})"
    both = placed.unionByName(sums, allowMissingColumns=True).repartition("_block")
    ranked = both.selectExpr("*", f"first_value(_before) {window} + row_number() {window} - 1 as number", f"first_value(_total) {window} as total")
    return ranked.where("_before is null and number is not null").drop("_before", "_total").sortWithinPartitions("_block", "session_id", "number")


def pages(segments: DataFrame, size: int) -> DataFrame:
    """(session_id, page, rows, anchor, has_more): the pages of ``size`` of every session; ``anchor`` is
    the sequence that the next one begins behind."""
    own = numbered(segments).withColumn("page", F.expr(f"(number - 1) div {size}"))
    out = own.groupBy("session_id", "page").agg(F.count("*").alias("rows"), F.max_by("sequence", "number").alias("anchor"), (F.max("number") < F.max("total")).alias("has_more"))
    return out.select("session_id", "page", "rows", "anchor", "has_more")


def _json_open() -> Column:
    return F.concat(F.lit('{"session_id":'), F.col("session_id").cast("string"), F.lit(',"segments":['))


def _cue(separator: str) -> Column:
    return F.concat(clock("start_ms", separator), F.lit(" --> "), clock("end_ms", separator), F.lit("\n"), F.col("body"), F.lit("\n\n"))


#: Of each format the head, a segment's text and the tail.
FORMS = {
    "txt": lambda: (F.lit(""), F.concat("body", F.lit("\n")), F.lit("")),
    "vtt": lambda: (F.lit("WEBVTT\n\n"), _cue("."), F.lit("")),
    "srt": lambda: (F.lit(""), F.concat(F.col("number").cast("string"), F.lit("\n"), _cue(",")), F.lit("")),
    "json": lambda: (_json_open(), F.concat(F.when(F.col("number") > 1, ",").otherwise(""), F.to_json(F.struct("sequence", "start_ms", "end_ms", "text", "language"), {"ignoreNullFields": "false"})), F.lit("]}\n")),
}

PARTS = "session_id bigint, block int, path string, offset bigint, byte_length bigint, whole boolean"

#: Of a part while its rows come: whether the first and the last row of its session are in it.
_PIECE = [("session_id", "i8"), ("offset", "i8"), ("byte_length", "i8"), ("begins", "?"), ("ends", "?")]


def _in_files(lines: DataFrame, form: str, folder: str, prefix: str) -> DataFrame:
    """PARTS of ``lines`` (session_id, _block, number, total, line), of which a task has whole blocks, sorted by block,
    session and number: one file for each block, written as its rows come."""

    def run(batches):
        fs, root = opened(folder)
        file = path = block = None
        size, held = 0, np.empty(0, _PIECE)

        def told(pieces: np.ndarray) -> pa.RecordBatch:
            n = len(pieces)
            columns = [pa.array(pieces["session_id"]), pa.array(np.full(n, block or 0, "i4")), pa.array([path] * n, pa.string()), pa.array(pieces["offset"]), pa.array(pieces["byte_length"]), pa.array(pieces["begins"] & pieces["ends"])]
            return pa.RecordBatch.from_arrays(columns, names=["session_id", "block", "path", "offset", "byte_length", "whole"])

        with ExitStack() as files:
            for batch in batches:
                sessions, blocks, numbers, totals = (batch.column(n).to_numpy() for n in ("session_id", "_block", "number", "total"))
                line = batch.column("line").cast(pa.large_string())
                _, places, data = line.buffers()
                places = np.frombuffer(places, "i8")[line.offset : line.offset + len(line) + 1]
                for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]):
                    if blocks[lo] != block:
                        yield told(held)
                        files.close()
                        block, size, held = int(blocks[lo]), 0, held[:0]
                        path = f"{prefix}{block:08d}.{form}"
                        file = files.enter_context(replacing(fs, f"{root}/{path}"))
                    starts = lo + np.append(0, np.flatnonzero(np.diff(sessions[lo:hi])) + 1)
                    behind = np.append(starts[1:], hi)
                    pieces = np.empty(len(starts), _PIECE)
                    pieces["session_id"], pieces["offset"], pieces["byte_length"] = sessions[starts], size + places[starts] - places[lo], places[behind] - places[starts]
                    pieces["begins"], pieces["ends"] = numbers[starts] == 1, numbers[behind - 1] == totals[starts]
                    if places[hi] > places[lo]:
                        file.write(data.slice(int(places[lo]), int(places[hi] - places[lo])))
                        size += int(places[hi] - places[lo])
                    if len(held) and held["session_id"][0] == pieces["session_id"][0]:  # begun in the batch before
                        pieces["byte_length"][0] += held["byte_length"][0]
                        for n in ("offset", "begins"):
                            pieces[n][0] = held[n][0]
                    else:
                        pieces = np.concatenate([held, pieces])
                    yield told(pieces[:-1])
                    held = pieces[-1:]
        yield told(held)

    return lines.mapInArrow(run, PARTS)


def write_export(segments: DataFrame, sessions: DataFrame, form: str, folder: str, blocks: int | None = None) -> DataFrame:
    """Writes the export of every one of ``sessions`` (session_id, unique) in ``form`` below ``folder`` and returns its
    PARTS, whose contents by ascending block are the document; a part that is ``whole`` is all of it.

    A part is what one block has of a session. A file has the parts of one block, by ascending session, each at its
    ``offset``; so there are as many files as blocks, however many sessions there are. A session without segments has
    head and tail alone, in files that hold only such ones; a null text is empty. A task that runs again replaces its
    files by the same ones.
    """
    head, line, tail = FORMS[form]()
    rows = numbered(segments, blocks, sessions).withColumn("body", F.coalesce(line_feeds("text"), F.lit("")))
    text = F.concat(F.when(F.col("number") == 1, head).otherwise(""), line, F.when(F.col("number") == F.col("total"), tail).otherwise(""))
    lines = rows.select("session_id", "_block", "number", "total", text.alias("line"))
    one = F.lit(1).cast("bigint")
    bare = sessions.where("session_id is not null").join(segments, "session_id", "left_anti").sortWithinPartitions("session_id").select("session_id", F.spark_partition_id().alias("_block"), one.alias("number"), one.alias("total"), F.concat(head, tail).alias("line"))
    return cut(_in_files(lines, form, folder, "").unionByName(_in_files(bare, form, folder, "bare-")), "parts", "zstd")


DIGESTS = "session_id bigint, byte_length bigint, sha256 string"


def digests(parts: DataFrame, folder: str) -> DataFrame:
    """DIGESTS of the documents of PARTS, read part by part: whole ones as they lie in their files, the parts of
    others by session and block."""

    def run(batches):
        fs, root = opened(folder)
        file = last = own = digest = None
        size = 0

        def told(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["session_id", "byte_length", "sha256"])

        with ExitStack() as files:
            for batch in batches:
                rows = []
                for session, path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if digest is None or session != own:
                        if digest is not None:
                            rows.append((own, size, digest.hexdigest()))
                        own, size, digest = session, 0, hashlib.sha256()
                    if length and path != last:
                        files.close()
                        file, last = files.enter_context(io.BufferedReader(fs.open_input_file(f"{root}/{path}"), 1 << 20)), path
                    if length:
                        file.seek(offset)
                    while length:
                        data = file.read(min(length, 1 << 20))
                        if not data:
                            raise EOFError(f"{path} is shorter than its parts")
                        digest.update(data)
                        size, length = size + len(data), length - len(data)
                yield told(rows)
        if digest is not None:
            yield told([(own, size, digest.hexdigest())])

    read = lambda own: own.select("session_id", "path", "offset", "byte_length").mapInArrow(run, DIGESTS)
    return read(parts.where("whole")).unionByName(read(parts.where("not whole").repartition("session_id").sortWithinPartitions("session_id", "block")))
