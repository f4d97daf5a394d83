"""Continuity accounting and idempotent ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators import coverage, intervals
from reelspark.operators.fence import EpochFence
from reelspark.operators.prefix import scan
from reelspark.operators.ranges import compress_ranges, highest_contiguous
from reelspark.plans.book import Book
from reelspark.streaming.ingest import ingested
from reelspark.streaming.leases import interruptions

book = Book()

#: The oracle of coverage: accepted, covered and missing sequences of each session.
COVER = """
, accepted AS (SELECT DISTINCT session_id, sequence FROM v_chunks WHERE sequence >= 1),
covered AS (SELECT DISTINCT s.session_id, i AS sequence FROM v_gaps g JOIN v_sessions s ON g.session_id = s.session_id, unnest(range(greatest(1, lo), least(hi, final_sequence) + 1)) AS u(i)),
missing AS (SELECT s.session_id, i AS sequence FROM v_sessions s, unnest(range(1, final_sequence + 1)) AS u(i)
            WHERE NOT EXISTS (SELECT 1 FROM accepted a WHERE a.session_id = s.session_id AND a.sequence = i)
              AND NOT EXISTS (SELECT 1 FROM covered c WHERE c.session_id = s.session_id AND c.sequence = i))
"""

book.both(
    boundary_validation=""", ends AS (SELECT session_id, max(sequence) AS last, max(end_ms) AS end_ms FROM v_chunks GROUP BY session_id)
SELECT s.session_id, coalesce(last, 0) > final_sequence AS excludes_audio, final_sequence * 2000 < coalesce(end_ms, 0) AS ends_early
FROM v_sessions s LEFT JOIN ends ON s.session_id = ends.session_id
WHERE coalesce(last, 0) > final_sequence OR final_sequence * 2000 < coalesce(end_ms, 0)""",
    session_chunks="SELECT session_id, sequence, byte_length FROM v_chunks ORDER BY session_id, sequence",
    session_gaps="SELECT session_id, gap_id, lo, hi, reason FROM v_gaps ORDER BY session_id, created_at, gap_id",
    session_dedupe=""", again AS (SELECT session_id, CASE WHEN session_id % 7 = 0 THEN 'other' ELSE kind END AS kind, owner_id FROM v_sessions)
SELECT CASE WHEN s.kind = a.kind AND s.owner_id = a.owner_id THEN 'idempotent' ELSE 'conflict' END AS outcome, count(*) AS n
FROM v_sessions s JOIN again a ON s.session_id = a.session_id GROUP BY CASE WHEN s.kind = a.kind AND s.owner_id = a.owner_id THEN 'idempotent' ELSE 'conflict' END""",
    first_wins=""", ranked AS (SELECT session_id, sequence, writer_id, byte_length, row_number() OVER (PARTITION BY session_id, sequence ORDER BY l_shipdate, l_partkey, writer_id, l_extendedprice, byte_length, l_discount, l_tax) AS rn FROM v_chunks)
SELECT session_id, sequence, writer_id, byte_length FROM ranked WHERE rn = 1""",
    upload_progress_max=""", steps AS (SELECT session_id, event_id, (event_id * 7919) % 100000 AS offset_bytes, 1 + (session_id * 104729) % 100000 AS declared FROM v_heartbeats)
SELECT event_id, max(least(offset_bytes, declared)) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS received,
       least(99, greatest(0, CAST(floor(100.0 * max(least(offset_bytes, declared)) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / declared) AS BIGINT))) AS percent
FROM steps""",
    spool_validate=""", steps AS (SELECT session_id, sequence, lag(sequence) OVER (PARTITION BY session_id ORDER BY sequence) AS before FROM (SELECT DISTINCT session_id, sequence FROM v_chunks) d)
SELECT session_id, sequence, before AS previous FROM steps WHERE sequence <> coalesce(before, 0) + 1""",
    latest_session=""", ranked AS (SELECT session_id, owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, session_id DESC) AS rn FROM v_sessions)
SELECT owner_id, session_id FROM ranked WHERE rn = 1""",
)


@book.frame(
    "audio_completeness",
    COVER
    + """, lost AS (SELECT c.session_id, count(*) AS n FROM covered c
         WHERE NOT EXISTS (SELECT 1 FROM accepted a WHERE a.session_id = c.session_id AND a.sequence = c.sequence) GROUP BY c.session_id)
SELECT s.session_id, CASE WHEN final_sequence = 0 THEN 'empty' WHEN n > 0 THEN 'partial' ELSE 'full' END AS audio_completeness
FROM v_sessions s LEFT JOIN lost ON s.session_id = lost.session_id""",
)
def audio_completeness(v) -> DataFrame:
    return coverage.completeness(v.v_chunks, v.v_gaps, v.v_sessions)


def as_ranges(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", F.col("lo").alias("range_start"), F.col("hi").alias("range_end"), (F.col("hi") - F.col("lo") + 1).alias("n"))


#: Islands of single sequences, for the oracles.
ISLANDS = """, k AS (SELECT *, sequence - row_number() OVER (PARTITION BY session_id ORDER BY sequence) AS island FROM {rows})
SELECT session_id, min(sequence) AS range_start, max(sequence) AS range_end, count(*) AS n FROM k GROUP BY session_id, island"""


@book.frame("missing_sequences", COVER + ISLANDS.format(rows="missing"))
def missing_sequences(v) -> DataFrame:
    return as_ranges(coverage.missing(v.v_chunks, v.v_gaps, v.v_sessions))


@book.frame("gap_coverage_ranges", COVER + ISLANDS.format(rows="covered"))
def gap_coverage_ranges(v) -> DataFrame:
    return as_ranges(intervals.union("session_id", coverage.covered(v.v_gaps, v.v_sessions)))


@book.frame("gap_coverage_expand", COVER + "SELECT session_id, sequence FROM covered")
def gap_coverage_expand(v) -> DataFrame:
    """A row for each covered sequence is what this query is asked for."""
    ranges = intervals.union("session_id", coverage.covered(v.v_gaps, v.v_sessions))
    return ranges.select("session_id", F.explode(F.sequence("lo", "hi")).alias("sequence"))


@book.frame(
    "spool_reconcile",
    """, arrived AS (SELECT session_id, sequence FROM v_chunks WHERE l_partkey % 3 <> 0 AND sequence >= 1)
SELECT c.session_id, c.sequence, c.epoch, CASE WHEN c.epoch = s.epoch AND EXISTS (SELECT 1 FROM arrived a WHERE a.session_id = c.session_id AND a.sequence = c.sequence) THEN 'removed' ELSE 'retained' END AS outcome, count(*) AS n
FROM v_chunks c JOIN v_sessions s ON c.session_id = s.session_id GROUP BY ALL""",
)
def spool_reconcile(v) -> DataFrame:
    """The server has two of three chunks; a chunk in a hole of its ranges, or of another epoch, stays."""
    found = coverage.reconcile(v.v_chunks.select("session_id", "sequence", "epoch"), v.v_sessions, v.v_chunks.where("l_partkey % 3 <> 0"))
    return found.groupBy("session_id", "sequence", "epoch", "outcome").agg(F.count("*").alias("n"))


@book.frame(
    "seq_range_compress",
    """, d AS (SELECT DISTINCT session_id, sequence FROM v_chunks), k AS (SELECT *, sequence - row_number() OVER (PARTITION BY session_id ORDER BY sequence) AS island FROM d)
SELECT session_id, min(sequence) AS range_start, max(sequence) AS range_end, count(*) AS n FROM k GROUP BY session_id, island""",
)
def seq_range_compress(v) -> DataFrame:
    return compress_ranges(v.v_chunks, "session_id", "sequence")


@book.frame(
    "seq_highest_contiguous",
    """, d AS (SELECT DISTINCT session_id, sequence FROM v_chunks WHERE sequence >= 1), k AS (SELECT *, sequence - row_number() OVER (PARTITION BY session_id ORDER BY sequence) AS island FROM d)
SELECT session_id, CAST(coalesce(max(CASE WHEN island = 0 THEN sequence END), 0) AS BIGINT) AS highest FROM k GROUP BY session_id""",
)
def seq_highest_contiguous(v) -> DataFrame:
    return highest_contiguous(v.v_chunks, "session_id", "sequence")


@book.frame(
    "missing_label",
    COVER
    + """, k AS (SELECT *, sequence - row_number() OVER (PARTITION BY session_id ORDER BY sequence) AS island FROM missing),
r AS (SELECT session_id, min(sequence) AS a, max(sequence) AS b FROM k GROUP BY session_id, island)
SELECT session_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || '–' || CAST(b AS VARCHAR) END, ', ' ORDER BY a) AS label FROM r GROUP BY session_id""",
)
def missing_label(v) -> DataFrame:
    ranges = missing_sequences(v)
    label = F.when(F.col("range_start") == F.col("range_end"), F.col("range_start").cast("string")).otherwise(F.concat_ws("–", "range_start", "range_end"))
    return ranges.withColumn("label", label).groupBy("session_id").agg(F.expr("listagg(label, ', ') WITHIN GROUP (ORDER BY range_start)").alias("label"))


@book.frame("gap_autodeclare_group", COVER + ", asked AS (SELECT * FROM missing WHERE sequence % 2 = 0 OR session_id % 3 = 0)" + ISLANDS.format(rows="asked"))
def gap_autodeclare_group(v) -> DataFrame:
    """Clients ask for every even sequence of a session, or for all of every third session."""
    listed = v.v_sessions.where("final_sequence >= 1").select("session_id", F.explode(F.expr("sequence(1L, final_sequence)")).alias("sequence"))
    missing = coverage.missing(v.v_chunks, v.v_gaps, v.v_sessions)
    return as_ranges(coverage.declared(listed.where("sequence % 2 = 0 or session_id % 3 = 0"), missing))


@book.frame(
    "capture_epoch_fence",
    """, attempts AS (SELECT session_id, event_id, k % 3 AS writer, k % 5 AS expected, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS rn FROM (SELECT utterance_id AS event_id, session_id, k FROM v_raw_jobs) e),
fold AS (
  SELECT session_id, rn, event_id, CASE WHEN expected = 0 THEN 1 ELSE 0 END AS epoch, CASE WHEN expected = 0 THEN writer ELSE -1 END AS writer, CASE WHEN expected = 0 THEN 'valid' ELSE 'stale' END AS outcome FROM attempts WHERE rn = 1
  UNION ALL
  SELECT a.session_id, a.rn, a.event_id, CASE WHEN a.expected = f.epoch % 5 THEN f.epoch + 1 ELSE f.epoch END, CASE WHEN a.expected = f.epoch % 5 THEN a.writer ELSE f.writer END,
         CASE WHEN a.expected = f.epoch % 5 THEN 'valid' WHEN (a.expected + 1) % 5 = f.epoch % 5 AND a.writer = f.writer THEN 'replay' ELSE 'stale' END
  FROM fold f JOIN attempts a ON a.session_id = f.session_id AND a.rn = f.rn + 1)
SELECT event_id, CAST(epoch AS BIGINT) AS epoch, outcome FROM fold""",
)
def capture_epoch_fence(v) -> DataFrame:
    """Claims of a session in order, which tell the epoch modulo 5 here."""
    claims = v.v_raw_jobs.selectExpr("session_id", "utterance_id as event_id", "k % 3 as writer", "k % 5 as expected")
    return scan(claims, ["event_id"], EpochFence(5))


#: The fields by which a repeated chunk or gap is known to be the same.
CHUNK = ("writer_id", "epoch", "start_ms", "end_ms", "content_type", "sha256", "byte_length")
GAP = ("writer_id", "epoch", "lo", "hi", "wall_started_at", "wall_ended_at", "reason")


def offered(df: DataFrame, key: list[str], order: list[str], identity: tuple[str, ...]) -> DataFrame:
    """How many rows of each key were accepted (the first), repeat it in all of ``identity``, or conflict."""
    by = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("me", F.struct(*identity)).withColumns({"rn": F.row_number().over(by), "first": F.first("me").over(by)})
    same = F.col("me").eqNullSafe(F.col("first"))
    return rows.groupBy(*key).agg(F.count_if(F.col("rn") == 1).alias("accepted"), F.count_if((F.col("rn") > 1) & same).alias("idempotent"), F.count_if((F.col("rn") > 1) & ~same).alias("conflict"))


def duck_offered(view: str, key: str, order: str, identity: tuple[str, ...]) -> str:
    same = " AND ".join(f"o.{c} IS NOT DISTINCT FROM f.{c}" for c in identity)
    on = " AND ".join(f"o.{c} = f.{c}" for c in key.split(", "))
    return f""", o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {view}), f AS (SELECT * FROM o WHERE rn = 1)
SELECT {", ".join(f"o.{c}" for c in key.split(", "))}, count(*) FILTER (WHERE o.rn = 1) AS accepted, count(*) FILTER (WHERE o.rn > 1 AND {same}) AS idempotent, count(*) FILTER (WHERE o.rn > 1 AND NOT ({same})) AS conflict
FROM o JOIN f ON {on} GROUP BY {", ".join(f"o.{c}" for c in key.split(", "))}"""


@book.frame("chunk_dedupe_conflict", duck_offered("v_chunk_offers", "session_id, sequence", "arrival", CHUNK))
def chunk_dedupe_conflict(v) -> DataFrame:
    return offered(v.v_chunk_offers, ["session_id", "sequence"], ["arrival"], CHUNK)


@book.frame("gap_dedupe_conflict", duck_offered("v_gap_offers", "session_id, gap_id", "arrival", GAP))
def gap_dedupe_conflict(v) -> DataFrame:
    return offered(v.v_gap_offers, ["session_id", "gap_id"], ["arrival"], GAP)


TIMEOUT = 20


HOLES = f""", b AS (SELECT user_id AS session_id, event_id, ts FROM events), m AS (SELECT max(ts) + INTERVAL {TIMEOUT} SECOND AS now FROM b),
n AS (SELECT session_id, event_id, ts, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS next FROM b), s AS (SELECT session_id, state FROM v_sessions)
SELECT n.session_id, n.event_id AS last_heartbeat_event, CAST(floor(epoch(ts)) AS BIGINT) AS interrupted_at, CASE WHEN next IS NULL THEN 'open' ELSE 'recovered' END AS outcome FROM n JOIN s ON s.session_id = n.session_id CROSS JOIN m
WHERE (next IS NOT NULL AND next > ts + INTERVAL {TIMEOUT} SECOND) OR (next IS NULL AND s.state = 'recording' AND now > ts + INTERVAL {TIMEOUT} SECOND)"""


@book.frame("heartbeat_interruptions", HOLES)
def heartbeat_interruptions(v) -> DataFrame:
    """Holes of more than TIMEOUT seconds after a heartbeat, which is when the session counts as
    interrupted; at the end only a session that still records is."""
    beats = v.v_heartbeats.withColumn("next", F.lead("ts").over(Window.partitionBy("session_id").orderBy("ts", "event_id")))
    now = beats.agg(F.expr(f"max(ts) + interval '{TIMEOUT}' second").alias("now"))
    seen = beats.join(v.v_sessions.select("session_id", "state"), "session_id").crossJoin(F.broadcast(now))
    late = F.expr(f"ts + interval '{TIMEOUT}' second")
    holes = seen.where((F.col("next") > late) | (F.col("next").isNull() & (F.col("state") == "recording") & (F.col("now") > late)))
    return holes.select("session_id", F.col("event_id").alias("last_heartbeat_event"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("interrupted_at"), F.when(F.col("next").isNull(), "open").otherwise("recovered").alias("outcome"))


@book.frame("heartbeat_timers", HOLES)
def heartbeat_timers(v) -> DataFrame:
    """The same holes, told by a stream's event-time timers over three micro-batches."""
    found = interruptions(v.spark, v.v_heartbeats, TIMEOUT, 3).join(v.v_sessions.select("session_id", "state"), "session_id")
    known = found.where((F.col("outcome") == "recovered") | (F.col("state") == "recording"))
    return known.select("session_id", F.col("event_id").alias("last_heartbeat_event"), F.expr("at div 1000000").alias("interrupted_at"), "outcome")


@book.frame("ingest_stream", duck_offered("v_chunk_offers", "session_id, sequence", "arrival", CHUNK))
def ingest_stream(v) -> DataFrame:
    """The decisions of a stream whose state outlives a restart before each of three micro-batches."""
    found = ingested(v.spark, v.v_chunk_offers, CHUNK, 3)
    return found.groupBy("session_id", "sequence").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("accepted", "idempotent", "conflict")))
