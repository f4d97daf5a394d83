"""Audio: levels, quantising, segmentation, WAV and PCM codecs, and streams."""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions import formats
from reelspark.operators.endpoint import Settings, dbfs, segments, speech_frames
from reelspark.operators.transcribe import ProviderError, transcribe
from reelspark.plans.book import Book
from reelspark.sources import blobs as blob_source
from reelspark.sources.blobs import write_blobs
from reelspark.sources.shared import shared_folder
from reelspark.streaming.endpoint import run_in_batches
from reelspark.streaming.sessions import heartbeat_sessions

book = Book()

#: JavaScript rounding of floats to 16 bits: negative ones scale by 32768, others by 32767.
QUANTISE = "transform(embedding, x -> cast(floor(greatest(-1D, least(1D, cast(x as double))) * if(x < 0, 32768, 32767) + 0.5) as bigint))"
DUCK_QUANTISE = "list_transform(embedding, lambda x: CAST(floor(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x::DOUBLE)) * CASE WHEN x < 0 THEN 32768 ELSE 32767 END + 0.5) AS BIGINT))"


@book.frame("pcm_quantize", f"SELECT vec_id, CAST(list_sum({DUCK_QUANTISE}) AS BIGINT) AS total FROM embeddings")
def pcm_quantize(v) -> DataFrame:
    return v.embeddings.selectExpr("vec_id", f"aggregate({QUANTISE}, 0L, (a, x) -> a + x) as total")


#: Two channels of a vector's halves, a null sample as silence, and frames of 20 ms at RATE.
RATE = 250
_FRAME = max(1, round(RATE * 0.02))


@book.frame(
    "pcm_downmix",
    f""", m AS (SELECT vec_id, list_transform(range(1, 33), lambda i: CAST((coalesce(embedding[i], 0)::DOUBLE + coalesce(embedding[i + 32], 0)::DOUBLE) / 2 AS FLOAT)) AS mixed FROM embeddings)
SELECT vec_id, CAST(o AS BIGINT) AS sample_offset, CAST(list_sum({DUCK_QUANTISE.replace("embedding", f"mixed[o + 1:o + {_FRAME}]")}) AS BIGINT) AS total FROM m, unnest(range(0, 32 - {_FRAME} + 1, {_FRAME})) AS u(o)""",
)
def pcm_downmix(v) -> DataFrame:
    """The mean of the channels, as frames with the place of their first sample; what is left at the end
    waits for more samples and is no frame."""
    channels = v.embeddings.selectExpr("vec_id", "array(slice(embedding, 1, 32), slice(embedding, 33, 32)) as channels")
    mean = "cast(aggregate(channels, 0D, (a, channel) -> a + coalesce(cast(channel[i] as double), 0D)) / size(channels) as float)"
    mixed = channels.selectExpr("vec_id", f"transform(sequence(0, size(channels[0]) - 1), i -> {mean}) as mixed")
    frames = mixed.selectExpr("vec_id", "mixed", f"explode(sequence(0, size(mixed) div {_FRAME} - 1)) as frame").selectExpr("vec_id", f"cast(frame * {_FRAME} as bigint) as sample_offset", f"slice(mixed, frame * {_FRAME} + 1, {_FRAME}) as embedding")
    return frames.selectExpr("vec_id", "sample_offset", f"aggregate({QUANTISE}, 0L, (a, x) -> a + x) as total")


@book.frame("frame_dbfs", f"SELECT vec_id, round(greatest(-120, 20 * log10(sqrt(list_sum(list_transform({DUCK_QUANTISE}, lambda x: CAST(x * x AS DOUBLE))) / len(embedding)) / 32768)), 6) AS level FROM embeddings")
def frame_dbfs(v) -> DataFrame:
    return v.embeddings.selectExpr("vec_id", f"{QUANTISE} as samples").select("vec_id", F.round(dbfs(), 6).alias("level"))


def frames(v) -> DataFrame:
    """A level series for each user: 20 ms frames, events' values as levels."""
    order = "row_number() over (partition by session_id order by utterance_id)"
    return v.v_raw_jobs.selectExpr("session_id as stream_id", f"cast({order} as bigint) as frame_no", f"cast(({order} - 1) * 320 as bigint) as sample_offset", "320L as size", "-90D + k as level")


SHORT = Settings(pre_roll=40, min_voiced=40, silence=60, hard_max=2000)


#: The oracle of the detector with SHORT's settings: its state after each frame, frame by frame.
_ENDS = """
, f AS (SELECT session_id AS stream_id, -90.0::DOUBLE + k AS level, row_number() OVER (PARTITION BY session_id ORDER BY utterance_id) AS rn FROM v_raw_jobs),
fold AS (
  SELECT stream_id, 0::BIGINT AS rn, -65.0::DOUBLE AS noise, NULL::BIGINT AS start, 0::BIGINT AS voiced, 0::BIGINT AS quiet, 0::BIGINT AS lead, NULL::BIGINT AS s, NULL::BIGINT AS e, NULL::BIGINT AS n FROM (SELECT DISTINCT stream_id FROM f) d
  UNION ALL
  SELECT stream_id, rn, noise, CASE WHEN NOT closes THEN start END, CASE WHEN closes THEN 0 ELSE voiced END, CASE WHEN closes THEN 0 ELSE quiet END, lead, CASE WHEN closes AND voiced >= 640 THEN start END, CASE WHEN closes AND voiced >= 640 THEN rn * 320 END, CASE WHEN closes AND voiced >= 640 THEN voiced END
  FROM (SELECT *, inside AND (quiet >= 960 OR rn * 320 - start >= 32000) AS closes FROM (
    SELECT stream_id, rn, start IS NOT NULL AS inside, CASE WHEN speech THEN noise ELSE 0.95::DOUBLE * noise + (1 - 0.95::DOUBLE) * level END AS noise, CASE WHEN start IS NULL AND speech THEN (rn - 1 - lead) * 320 ELSE start END AS start,
           voiced + CASE WHEN speech THEN 320 ELSE 0 END AS voiced, CASE WHEN speech OR start IS NULL THEN 0 ELSE quiet + 320 END AS quiet, CASE WHEN speech OR start IS NOT NULL THEN 0 ELSE least(2, lead + 1) END AS lead
    FROM (SELECT f.stream_id, f.rn, f.level, noise, start, voiced, quiet, lead, level >= greatest(-50.0::DOUBLE, noise + 12) AS speech FROM fold JOIN f ON f.stream_id = fold.stream_id AND f.rn = fold.rn + 1) x) y) z),
ends AS (SELECT stream_id, s, e, n FROM fold WHERE s IS NOT NULL UNION ALL SELECT o.stream_id, start, rn * 320, voiced FROM fold o WHERE start IS NOT NULL AND voiced >= 640 AND rn = (SELECT max(rn) FROM f WHERE f.stream_id = o.stream_id))
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY s) AS ordinal, s AS start_sample, e AS end_sample, n AS voiced FROM ends
"""


@book.frame("vad_endpoint", _ENDS)
def vad_endpoint(v) -> DataFrame:
    return segments(frames(v), SHORT)


@book.frame("vad_stream", _ENDS)
def vad_stream(v) -> DataFrame:
    """The segments of :func:`vad_endpoint`, found by a stream in three micro-batches."""
    return run_in_batches(v.spark, frames(v), SHORT, shared_folder(v.spark, "vad"), 3)


@book.frame(
    "noise_floor",
    """, f AS (SELECT session_id AS stream_id, -90.0::DOUBLE + k AS level, row_number() OVER (PARTITION BY session_id ORDER BY utterance_id) AS rn FROM v_raw_jobs),
fold AS (SELECT stream_id, rn, CASE WHEN level >= greatest(-50.0::DOUBLE, -65.0::DOUBLE + 12) THEN -65.0::DOUBLE ELSE 0.95::DOUBLE * -65.0::DOUBLE + (1 - 0.95::DOUBLE) * level END AS noise, CASE WHEN level >= greatest(-50.0::DOUBLE, -65.0::DOUBLE + 12) THEN 1 ELSE 0 END AS speech FROM f WHERE rn = 1
  UNION ALL SELECT f.stream_id, f.rn, CASE WHEN level >= greatest(-50.0::DOUBLE, noise + 12) THEN noise ELSE 0.95::DOUBLE * noise + (1 - 0.95::DOUBLE) * level END, speech + CASE WHEN level >= greatest(-50.0::DOUBLE, noise + 12) THEN 1 ELSE 0 END FROM fold JOIN f ON f.stream_id = fold.stream_id AND f.rn = fold.rn + 1)
SELECT stream_id, CAST(max(speech) AS BIGINT) AS speech_frames FROM fold GROUP BY stream_id""",
)
def noise_floor(v) -> DataFrame:
    return speech_frames(frames(v))


@book.frame(
    "hysteresis",
    """, f AS (SELECT session_id AS stream_id, k, row_number() OVER (PARTITION BY session_id ORDER BY utterance_id) AS rn FROM v_raw_jobs),
fold AS (SELECT stream_id, rn, k >= 80 AS degraded, CASE WHEN k >= 80 THEN 1 ELSE 0 END AS episodes FROM f WHERE rn = 1
  UNION ALL SELECT f.stream_id, f.rn, CASE WHEN degraded THEN k > 40 ELSE k >= 80 END, episodes + CASE WHEN NOT degraded AND k >= 80 THEN 1 ELSE 0 END FROM fold JOIN f ON f.stream_id = fold.stream_id AND f.rn = fold.rn + 1)
SELECT stream_id, CAST(max(episodes) AS BIGINT) AS episodes, count(*) FILTER (WHERE degraded) AS degraded_frames FROM fold GROUP BY stream_id""",
)
def hysteresis(v) -> DataFrame:
    """Degraded from a level of 80 until it falls to 40: the last crossing decides."""
    marks = v.v_raw_jobs.selectExpr("session_id as stream_id", "utterance_id", "case when k >= 80 then true when k <= 40 then false end as crossing")
    state = marks.selectExpr("stream_id", "utterance_id", "coalesce(last_value(crossing) ignore nulls over (partition by stream_id order by utterance_id rows between unbounded preceding and current row), false) as degraded")
    steps = state.selectExpr("stream_id", "degraded", "coalesce(lag(degraded) over (partition by stream_id order by utterance_id), false) as before")
    return steps.groupBy("stream_id").agg(F.count_if(F.expr("degraded and not before")).alias("episodes"), F.count_if("degraded").alias("degraded_frames"))


def wav(samples: bytes, rate: int = 16_000) -> bytes:
    """Mono 16-bit WAV file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(samples))
    return head + samples


_LE = "substr(lpad(to_hex({0}), {1}, '0'), {2}, 2)"


def _duck_le(value: str, size: int) -> str:
    """The bytes of a whole number, small end first, in hexadecimal."""
    return " || ".join(_LE.format(value, 2 * size, k) for k in range(2 * size - 1, 0, -2))


@book.frame(
    "wav_encode",
    f""", q AS (SELECT vec_id, {DUCK_QUANTISE} AS s FROM embeddings), d AS (SELECT vec_id, 2 * len(s) AS n, list_aggregate(list_transform(s, lambda x: {_duck_le("(x + 65536) % 65536", 2)}), 'string_agg', '') AS data FROM q)
SELECT vec_id, sha256(encode('RIFF') || unhex({_duck_le("36 + n", 4)}) || encode('WAVEfmt ') || unhex({_duck_le("16", 4)} || {_duck_le("1", 2)} || {_duck_le("1", 2)} || {_duck_le("16000", 4)} || {_duck_le("32000", 4)} || {_duck_le("2", 2)} || {_duck_le("16", 2)}) || encode('data') || unhex({_duck_le("n", 4)} || data)) AS sha256 FROM d""",
)
def wav_encode(v) -> DataFrame:
    @F.pandas_udf("string")
    def encoded(samples: pd.Series) -> pd.Series:
        return samples.map(lambda s: hashlib.sha256(wav(struct.pack(f"<{len(s)}h", *s))).hexdigest())

    return v.embeddings.selectExpr("vec_id", f"{QUANTISE} as s").select("vec_id", encoded("s").alias("sha256"))


def recordings(v) -> DataFrame:
    """(vec_id, key, content): WAV files of the embeddings' samples, repeated to several frames."""

    @F.pandas_udf("binary")
    def encoded(samples: pd.Series, times: pd.Series) -> pd.Series:
        return pd.Series([wav(struct.pack(f"<{len(s)}h", *s) * int(n)) for s, n in zip(samples, times, strict=True)])

    rows = v.embeddings.selectExpr("vec_id", f"{QUANTISE} as s", "1 + vec_id % 30 as times")
    return rows.select("vec_id", F.format_string("media/%02d/%08d.wav", F.col("vec_id") % 16, "vec_id").alias("key"), encoded("s", "times").alias("content"))


@book.frame("wav_frames", "SELECT vec_id, CAST(i AS BIGINT) AS frame_no, CAST(least(320, n - 320 * i) AS BIGINT) AS samples FROM (SELECT vec_id, len(embedding) * (1 + vec_id % 30) AS n FROM embeddings WHERE vec_id % 11 <> 0) e, unnest(range(0, (n + 319) // 320)) AS u(i)")
def wav_frames(v) -> DataFrame:
    """Frames of the WAV files of a folder; files of another format give none."""
    folder = shared_folder(v.spark, "media")
    broken = F.when(F.col("vec_id") % 11 == 0, F.concat(F.expr("X'00'"), "content")).otherwise(F.col("content"))
    write_blobs(recordings(v).withColumn("content", broken), folder)
    found = blob_source.wav_frames(blob_source.blobs(v.spark, folder))
    return found.select(F.regexp_extract("key", "([0-9]+)[.]wav$", 1).cast("bigint").alias("vec_id"), "frame_no", "samples")


@book.frame("blob_verify", "SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN 'key' WHEN vec_id % 7 = 0 THEN 'missing' WHEN vec_id % 5 = 0 THEN 'length' WHEN vec_id % 3 = 0 THEN 'sha256' ELSE 'verified' END AS outcome FROM embeddings")
def blob_verify(v) -> DataFrame:
    """Objects of a manifest against the files themselves: some keys climb out, some files are absent,
    some manifest rows have another length or digest."""
    folder, rows = shared_folder(v.spark, "blobs"), recordings(v)
    write_blobs(rows.where("vec_id % 7 <> 0"), folder)
    key = F.when(F.col("vec_id") % 13 == 0, F.concat(F.lit("media/../"), "key")).otherwise(F.col("key"))
    digest = F.when(F.col("vec_id") % 3 == 0, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.sha2("content", 256))
    manifest = rows.select("vec_id", key.alias("key"), digest.alias("sha256"), (F.octet_length("content") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)).cast("bigint").alias("byte_length"))
    return blob_source.verify(manifest, blob_source.blobs(v.spark, folder)).select("vec_id", "outcome")


#: Bytes of a packet at most: its offset and 2 000 samples less one.
MOST_PACKET = 8 + 2 * 1999
_NIBBLE = "(strpos('0123456789ABCDEF', h[{0}]) - 1)"
_BYTE = f"({_NIBBLE.format('2 * i + 1')} * 16 + {_NIBBLE.format('2 * i + 2')})"


@book.frame(
    "pcm_decode",
    f""", p AS (SELECT l_orderkey, l_linenumber, octet_length(payload) AS n, hex(payload) AS h FROM v_packets),
b AS (SELECT *, list_transform(range(n), lambda i: CAST({_BYTE} AS HUGEINT)) AS b FROM p WHERE n BETWEEN 10 AND {MOST_PACKET} AND n % 2 = 0),
w AS (SELECT *, list_sum(list_transform(range(8), lambda i: b[i + 1] * CAST(power(256, i) AS HUGEINT))) AS at, list_transform(range((n - 8) // 2), lambda i: CAST(b[2 * i + 9] + 256 * b[2 * i + 10] AS BIGINT)) AS s FROM b)
SELECT l_orderkey, l_linenumber, CAST(w.at AS BIGINT) AS sample_offset, CAST(len(s) AS BIGINT) AS samples, CAST(list_sum(list_transform(s, lambda x: CASE WHEN x >= 32768 THEN x - 65536 ELSE x END)) AS BIGINT) AS total FROM w WHERE w.at < 9223372036854775808""",
)
def pcm_decode(v) -> DataFrame:
    """Packets of a little-endian offset and samples; short, oversize and odd ones go, as do offsets
    beyond 63 bits."""
    good = v.v_packets.where(formats.packet_fault("payload", MOST_PACKET).isNull()).withColumn("s", formats.packet_samples("payload"))
    return good.select("l_orderkey", "l_linenumber", formats.packet_offset("payload").alias("sample_offset"), F.size("s").cast("bigint").alias("samples"), F.expr("aggregate(s, 0L, (a, x) -> a + x)").alias("total"))


@book.frame(
    "heartbeat_stream",
    """, steps AS (SELECT session_id, event_id, ts, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS before FROM v_heartbeats WHERE ts IS NOT NULL),
runs AS (SELECT session_id, ts, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM steps)
SELECT session_id AS user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_heartbeat, count(*) AS beats FROM runs GROUP BY session_id, run""",
)
def heartbeat_stream(v) -> DataFrame:
    return heartbeat_sessions(v.spark, v.sf_dir)


def stand_in(payload: bytes, content_type: str) -> tuple[str | None, str | None]:
    """A provider for tests: the payload is the text, ``!`` and a number an error of that status."""
    text = payload.decode()
    if text.startswith("!"):
        raise ProviderError(int(text[1:]) if text[1:] else None)
    return text, content_type.partition(";")[2] or None


@book.frame(
    "transcribe_map",
    """, r AS (SELECT utterance_id, spoken, content_type, CASE WHEN spoken LIKE '!%' THEN coalesce(nullif(spoken[2:], ''), '599')::INT END AS status FROM v_speech),
k AS (SELECT *, CASE WHEN status = 429 THEN 'rate_limited' WHEN status IN (401, 403) THEN 'configuration' WHEN status IN (408, 425) OR status >= 500 THEN 'transient' WHEN status IS NOT NULL THEN 'permanent' END AS category FROM r)
SELECT utterance_id, CASE WHEN category IS NULL THEN nullif(trim(spoken), '') END AS text, CASE WHEN category IS NULL AND trim(spoken) <> '' AND content_type LIKE '%;%' THEN string_split(content_type, ';')[2] END AS language,
  CASE WHEN category IN ('transient', 'rate_limited') THEN 'retry' WHEN category IS NOT NULL THEN 'failed' WHEN trim(spoken) = '' THEN 'no_speech' ELSE 'succeeded' END AS outcome, category FROM k""",
)
def transcribe_map(v) -> DataFrame:
    """Each utterance through a provider, here a stand-in."""
    return transcribe(v.v_speech.select("utterance_id", F.encode("spoken", "UTF-8").alias("payload"), "content_type"), stand_in)
