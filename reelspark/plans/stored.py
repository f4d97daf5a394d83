"""Stored state: versioned jobs, first-writer objects, media by byte ranges, followers, pages and exports in parts."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.admission import ready
from reelspark.plans import transcripts
from reelspark.plans.audio import DUCK_QUANTISE, recordings
from reelspark.plans.book import Book
from reelspark.sources import layout, objects
from reelspark.sources.adapters import COOLDOWN, NOW
from reelspark.sources.blobs import write_blobs
from reelspark.sources.media import ranged_frames
from reelspark.sources.shared import shared_folder
from reelspark.sources.snapshots import Conflict, VersionedTable, forward
from reelspark.streaming.notices import follow, reopened

book = Book()

JOBS = "utterance_id bigint, session_id bigint, k bigint, state string, next_attempt bigint, claim_expires bigint, last_delivery bigint"


def deliveries(jobs: DataFrame, now: int, which: str) -> DataFrame:
    """The jobs of ``which`` that may be delivered at ``now``, with their stamp moved forward."""
    own = ready(jobs.where(which), now, COOLDOWN).where("eligible")
    return own.withColumn("last_delivery", forward("last_delivery", F.lit(now).cast("bigint"))).select(*jobs.columns)


#: Seconds by which the second writer's clock is behind.
BEHIND = 5


@book.frame(
    "jobs_conditional_update",
    f""", a AS (SELECT utterance_id, k, state, last_delivery, next_attempt, claim_expires,
    CASE WHEN k < 60 AND k % 5 <> 0 AND eligible THEN greatest(coalesce(last_delivery, {NOW}), {NOW}) ELSE last_delivery END AS first FROM v_ready),
b AS (SELECT *, CASE WHEN state = 'pending' THEN 'pending' WHEN state = 'retry_wait' AND next_attempt <= {NOW - BEHIND} THEN 'due' WHEN state = 'claimed' AND claim_expires <= {NOW - BEHIND} THEN 'due' END AS waits, CASE state WHEN 'retry_wait' THEN next_attempt ELSE claim_expires END AS due FROM a)
SELECT utterance_id, CAST(CASE WHEN k % 5 = 0 THEN last_delivery
  WHEN k >= 40 AND waits IS NOT NULL AND (first IS NULL OR first <= {NOW - BEHIND - COOLDOWN} OR (waits = 'due' AND first < due)) THEN greatest(coalesce(first, {NOW - BEHIND}), {NOW - BEHIND}) ELSE first END AS BIGINT) AS last_delivery FROM b""",
)
def jobs_conditional_update(v) -> DataFrame:
    """Two writers on one version of the jobs, of which one in five is inserted only afterwards: the second, whose
    clock is behind, loses and judges anew the jobs that the first has just delivered."""
    jobs = v.v_jobs.select(*(c.split()[0] for c in JOBS.split(", ")))
    table = VersionedTable(v.spark, shared_folder(v.spark, "jobs"), JOBS, ["utterance_id"])
    base = table.commit(-1, jobs.where("k % 5 <> 0"))
    read = table.read(base)
    late = deliveries(read, NOW - BEHIND, "k >= 40")
    table.commit(base, deliveries(read, NOW, "k < 60"))
    try:
        table.commit(base, late)
    except Conflict:
        table.update(lambda now: deliveries(now, NOW - BEHIND, "k >= 40"))
    table.insert_missing(jobs)
    return table.read().select("utterance_id", "last_delivery")


@book.frame(
    "objects_first_wins",
    """, o AS (SELECT CAST(floor(doc_id / 2) AS BIGINT) AS slot, doc_id % 2 AS late, text FROM documents WHERE text IS NOT NULL AND NOT (doc_id % 2 = 0 AND doc_id % 3 = 0))
SELECT slot, sha256(arg_min(text, late)) AS sha256, octet_length(encode(arg_min(text, late))) AS byte_length, true AS sound FROM o GROUP BY slot""",
)
def objects_first_wins(v) -> DataFrame:
    """Two jobs offer a text for each slot of two documents, the first for two slots of three; then the objects are
    read back and their digests verified."""
    folder = shared_folder(v.spark, "objects")
    offers = v.documents.select("doc_id", F.expr("cast(floor(doc_id / 2) as string)").alias("key"), F.encode("text", "UTF-8").alias("content"))
    objects.put(offers.where("doc_id % 2 = 0 and doc_id % 3 <> 0"), folder)
    objects.put(offers.where("doc_id % 2 = 1"), folder)
    return objects.fetch(v.spark, folder).select(F.col("key").cast("bigint").alias("slot"), "sha256", "byte_length", "sound")


#: Bytes of a range: most files have several.
SPLIT = 1_000


def with_chunk(content: bytes) -> bytes:
    """A WAV file with a chunk of five bytes, and its pad, between format and data."""
    return content[:36] + struct.pack("<4sI6s", b"LIST", 5, b"notes\0") + content[36:]


def sample_sum(content: bytes) -> int:
    """Of 16-bit samples, small end first."""
    return int(np.frombuffer(content, "<i2").sum(dtype="int64"))


@book.frame(
    "wav_ranges",
    f""", e AS (SELECT vec_id, list_sum({DUCK_QUANTISE}) AS once, len(embedding) AS each, len(embedding) * (1 + vec_id % 30) AS n FROM embeddings WHERE vec_id % 11 <> 0)
SELECT vec_id, CAST(i AS BIGINT) AS frame_no, CAST(least(320, n - 320 * i) AS BIGINT) AS samples, CAST(least(320, n - 320 * i) // each * once AS BIGINT) AS total FROM e, unnest(range(0, (n + 319) // 320)) AS u(i)""",
)
def wav_ranges(v) -> DataFrame:
    """The frames of the WAV files of a folder, read in ranges of SPLIT bytes, with the sums of their samples."""
    folder = shared_folder(v.spark, "media")

    @F.pandas_udf("binary")
    def with_chunks(content: pd.Series) -> pd.Series:
        return content.map(with_chunk)

    @F.pandas_udf("bigint")
    def sums(content: pd.Series) -> pd.Series:
        return content.map(sample_sum)

    files = recordings(v).withColumn("content", F.when(F.col("vec_id") % 3 == 0, with_chunks("content")).otherwise(F.col("content")))
    broken = F.when(F.col("vec_id") % 11 == 0, F.concat(F.expr("X'00'"), "content")).otherwise(F.col("content"))
    write_blobs(files.withColumn("content", broken), folder)
    frames = ranged_frames(v.spark, folder, SPLIT).withColumn("total", sums("content"))
    return frames.select(F.regexp_extract("key", "([0-9]+)[.]wav$", 1).cast("bigint").alias("vec_id"), "frame_no", "samples", "total")


@book.frame(
    "notice_catch_up",
    """, n AS (SELECT session_id, sequence FROM v_segments WHERE (session_id + sequence) % 3 <> 0), t AS (SELECT session_id, max(sequence) AS top FROM n GROUP BY session_id)
SELECT s.session_id, s.sequence, CASE WHEN coalesce(s.sequence > top, true) THEN 'reopened' WHEN (s.session_id + s.sequence) % 3 <> 0 THEN 'notice' ELSE 'caught_up' END AS how FROM v_segments s LEFT JOIN t ON t.session_id = s.session_id""",
)
def notice_catch_up(v) -> DataFrame:
    """Every segment once: one notice in three is lost, one in four comes twice, in three micro-batches."""
    table = v.v_segments.select("session_id", "sequence")
    sent = table.where("(session_id + sequence) % 3 <> 0").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sequence")))
    doubled = sent.unionAll(sent.where("session_id % 4 = 1"))
    found, cursors = follow(v.spark, [doubled.where(f"least(2, (sequence - 1) div 2) = {k}") for k in range(3)], table)
    return found.unionByName(reopened(table, cursors))


#: Segments of a page.
PAGE = 3


@book.frame(
    "timeline_pages",
    f""", r AS (SELECT session_id, sequence, row_number() OVER w AS n, count(*) OVER (PARTITION BY session_id) AS total FROM v_segments WINDOW w AS (PARTITION BY session_id ORDER BY start_ms, end_ms, sequence))
SELECT session_id, CAST((n - 1) // {PAGE} AS BIGINT) AS page, count(*) AS rows, arg_max(sequence, n) AS anchor, max(n) < max(total) AS has_more FROM r GROUP BY session_id, (n - 1) // {PAGE}""",
)
def timeline_pages(v) -> DataFrame:
    """All pages of all sessions in one ordered pass."""
    return layout.pages(v.v_segments, PAGE)


def export_parts(v, form: str) -> DataFrame:
    """Digest and size of each session's export, written in parts by many tasks and read back; every
    order is a session here too, most of them without segments."""
    folder = shared_folder(v.spark, "export")
    sessions = v.v_segments.select("session_id").unionAll(v.v_sessions.select("session_id")).distinct()
    return layout.digests(layout.write_export(v.v_segments, sessions, form, folder), folder)


#: What a session without segments is exported as, by format, in the oracle.
EMPTY = {"txt": "''", "vtt": "'WEBVTT' || chr(10) || chr(10)", "srt": "''", "json": """'{"session_id":' || s.session_id || ',"segments":[]}' || chr(10)"""}

for _form, _empty in EMPTY.items():
    _sql = transcripts.DOCUMENTS[_form]
    book.frame(
        f"export_parts_{_form}",
        f""", d AS ({_sql}), s AS (SELECT session_id FROM v_segments UNION SELECT session_id FROM v_sessions), f AS (SELECT s.session_id, coalesce(document, {_empty}) AS document FROM s LEFT JOIN d ON d.session_id = s.session_id)
SELECT session_id, octet_length(encode(document)) AS byte_length, sha256(document) AS sha256 FROM f""",
    )(lambda v, form=_form: export_parts(v, form))
