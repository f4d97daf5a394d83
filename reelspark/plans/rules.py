"""Rules of ingest, uploads and recorder state over the rows they judge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import rules
from reelspark.plans.book import Book
from reelspark.plans.continuity import duck_offered, offered
from reelspark.sources.adapters import NOW

book = Book()

MOST_BYTES = 200


@book.frame(
    "chunk_validate",
    f"""SELECT session_id, sequence, part, CASE WHEN end_ms < start_ms THEN 'time' WHEN strlen(payload) = 0 THEN 'empty' WHEN strlen(payload) > {MOST_BYTES} THEN 'too_large' WHEN sha256(payload) <> lower(declared_sha256) THEN 'digest' WHEN active_writer IS DISTINCT FROM writer_id OR active_epoch IS DISTINCT FROM epoch THEN 'fenced'
  WHEN state NOT IN ('recording', 'recovering', 'interrupted', 'finalizing') THEN 'closed' WHEN state = 'finalizing' AND final_sequence IS NOT NULL AND sequence > final_sequence THEN 'beyond_boundary' ELSE 'accepted' END AS outcome FROM v_chunk_posts""",
)
def chunk_validate(v) -> DataFrame:
    return v.v_chunk_posts.select("session_id", "sequence", "part", rules.chunk_outcome(MOST_BYTES).alias("outcome"))


@book.frame(
    "utterance_validate",
    """, t AS (SELECT *, trim(producer_key, ' ' || chr(9) || chr(10)) AS k, lower(trim(content_type)) AS t FROM v_utterance_posts),
j AS (SELECT *, CASE WHEN k = '' THEN 'blank_key' WHEN len(k) > 160 THEN 'long_key' WHEN NOT (0 <= start_ms AND start_ms < end_ms) THEN 'time' WHEN t = '' THEN 'blank_type' WHEN len(t) > 128 THEN 'long_type' WHEN payload = '' THEN 'payload' ELSE 'accepted' END AS outcome FROM t)
SELECT utterance_id, outcome, CASE WHEN outcome = 'accepted' THEN k END AS producer_key, CASE WHEN outcome = 'accepted' THEN t END AS content_type, CASE WHEN outcome = 'accepted' THEN sha256(payload) END AS sha256 FROM j""",
)
def utterance_validate(v) -> DataFrame:
    """Each utterance's outcome; accepted ones with key, type and digest as they are kept."""
    key, kind = rules.strip("producer_key"), F.lower(rules.strip("content_type"))
    rows = v.v_utterance_posts.withColumn("outcome", rules.utterance_outcome(key, kind))
    kept = lambda x: F.when(F.col("outcome") == "accepted", x)
    return rows.select("utterance_id", "outcome", kept(key).alias("producer_key"), kept(kind).alias("content_type"), kept(F.sha2("payload", 256)).alias("sha256"))


#: The fields by which a repeated segment or utterance is known to be the same.
SEGMENT = ("start_ms", "end_ms", "text", "language")
UTTERANCE = ("work_id", "start_ms", "end_ms", "content_type", "sha256", "byte_length")


@book.frame("producer_key_dedupe", duck_offered("v_segment_offers", "session_id, producer_key", "arrival", SEGMENT))
def producer_key_dedupe(v) -> DataFrame:
    return offered(v.v_segment_offers, ["session_id", "producer_key"], ["arrival"], SEGMENT)


@book.frame("utterance_dedupe", duck_offered("v_utterance_offers", "session_id, producer_key", "arrival", UTTERANCE))
def utterance_dedupe(v) -> DataFrame:
    return offered(v.v_utterance_offers, ["session_id", "producer_key"], ["arrival"], UTTERANCE)


@book.frame(
    "result_status",
    """, n AS (SELECT r.*, (SELECT count(*) FROM v_segments g WHERE g.session_id = r.session_id) AS segments FROM v_results r),
j AS (SELECT *, CASE WHEN uploaded_at IS NULL THEN CASE WHEN session_state = 'failed' OR failure_code IS NOT NULL THEN 'failed' ELSE 'uploading' END WHEN coalesce(processing, 'pending') IN ('pending', 'claimed', 'retry_wait') THEN 'preparing' WHEN processing = 'waiting_stt' THEN 'transcribing'
  WHEN processing <> 'succeeded' THEN 'failed' WHEN segments > 0 THEN 'complete' ELSE 'no_speech' END AS state FROM n)
SELECT session_id, state, segments, state IN ('complete', 'no_speech') AS exports_available, CASE WHEN uploaded_at IS NOT NULL AND state NOT IN ('preparing', 'transcribing') THEN processed_at END AS completed_at FROM j""",
)
def result_status(v) -> DataFrame:
    counts = v.v_segments.groupBy("session_id").agg(F.count(F.lit(1)).alias("segments"))
    rows = v.v_results.join(counts, "session_id", "left").withColumn("segments", F.coalesce("segments", F.lit(0)))
    rows = rows.withColumn("state", rules.result_state(F.col("segments")))
    ended = F.col("uploaded_at").isNotNull() & F.col("state").isin("failed", "complete", "no_speech")
    return rows.select("session_id", "state", "segments", F.col("state").isin("complete", "no_speech").alias("exports_available"), F.when(ended, F.col("processed_at")).alias("completed_at"))


@book.frame(
    "local_fence",
    """, a AS (SELECT *, coalesce(pending_writer IS NOT NULL AND server_epoch - epoch = 1 AND server_writer = pending_writer, false) AS advanced FROM v_claims)
SELECT session_id, CASE WHEN server_state = 'complete' AND server_epoch = epoch AND final_sequence = last_sequence AND final_end_ms = last_end_ms THEN 'matching_completion' WHEN advanced THEN 'advanced'
  WHEN server_state = 'complete' OR server_epoch <> epoch OR server_writer <> writer THEN 'fenced' ELSE 'open' END AS fence,
  CASE WHEN pending_writer IS NULL THEN 'none' WHEN advanced AND recovery_token IS NULL THEN 'no_capability' WHEN advanced THEN 'adopt' WHEN server_epoch = epoch AND server_writer = writer THEN 'drop' ELSE 'conflict' END AS pending_claim FROM a""",
)
def local_fence(v) -> DataFrame:
    return v.v_claims.select("session_id", rules.local_fence().alias("fence"), rules.pending_claim().alias("pending_claim"))


@book.frame(
    "ux_rules",
    """, p AS (SELECT *, n_pending > 0 AS waits, session_id IS NOT NULL AS known, phase = 'recoverable' AND n_missing > 0 AS lost FROM v_snapshots)
SELECT snapshot_id, CASE WHEN fenced THEN 'Needs attention/warning' ELSE CASE phase WHEN 'requesting' THEN 'Starting microphone…/neutral' WHEN 'recording' THEN 'recording/positive' WHEN 'finalizing' THEN 'Finalizing/neutral' WHEN 'recoverable' THEN 'Needs recovery/warning'
    WHEN 'complete' THEN 'Complete/' || CASE WHEN n_gaps > 0 THEN 'warning' ELSE 'positive' END WHEN 'error' THEN 'Ready to retry/warning' ELSE 'Ready/neutral' END END AS lifecycle,
  CASE WHEN fenced AND waits THEN 'Orphaned local evidence — action blocked/danger' WHEN fenced THEN 'Session ownership changed/warning' WHEN write_failed THEN 'Unsafe audio storage/danger' WHEN n_missing > 0 THEN 'Audio missing — action required/danger'
    WHEN waits AND NOT online THEN 'Audio saved locally/' || CASE WHEN persisted THEN 'warning' ELSE 'danger' END WHEN waits THEN CASE phase WHEN 'recoverable' THEN 'Recovering audio' ELSE 'Syncing audio' END || '/warning'
    WHEN phase = 'complete' AND n_gaps > 0 THEN 'Audio finalized with declared loss/warning' WHEN NOT known THEN 'Audio ready/neutral' WHEN phase = 'recoverable' THEN 'Audio recovery ready/warning' ELSE 'Audio synced/positive' END AS audio,
  CASE WHEN NOT known THEN 'Not started/neutral' WHEN realtime = 'connecting' THEN 'Starting transcription/neutral' WHEN realtime = 'live' THEN 'Transcribing/positive' WHEN realtime = 'degraded' OR realtime_error IS NOT NULL THEN 'Transcription delayed/warning'
    WHEN phase = 'complete' THEN 'Processing may continue/neutral' ELSE 'Not active/neutral' END AS transcription,
  CASE WHEN NOT fenced THEN CASE WHEN phase = 'recording' THEN 'stop' WHEN phase = 'finalizing' THEN 'defer-finalization' WHEN lost THEN 'finish-recovered' WHEN phase = 'recoverable' THEN 'resume' WHEN phase <> 'requesting' THEN 'start' END END AS primary_action,
  CASE WHEN fenced THEN '' ELSE concat_ws(',', CASE WHEN phase = 'recoverable' AND NOT lost THEN 'finish-recovered' END, CASE WHEN known AND waits AND phase NOT IN ('requesting', 'finalizing') THEN 'sync' END) END AS secondary_actions,
  CASE WHEN lost AND NOT fenced THEN 'declare-missing-gaps' ELSE '' END AS danger_actions, CASE WHEN phase = 'complete' AND acknowledged + n_gaps = 0 THEN 'Recording finalized with no durable audio captured.' ELSE message END AS message FROM p""",
)
def ux_rules(v) -> DataFrame:
    return v.v_snapshots.select("snapshot_id", *(rule.alias(name) for name, rule in rules.recorder_labels().items()))


@book.frame(
    "upload_hooks",
    f""", d AS (SELECT page_id AS page, hook, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM v_hooks),
f AS (SELECT page, hook, json_extract_string(j, '$.Type') AS kind, json_extract_string(j, '$.Event.Upload.ID') AS id, CAST(json_extract_string(j, '$.Event.Upload.Size') AS BIGINT) AS size, coalesce(json_extract_string(j, '$.Event.Upload.SizeIsDeferred') = 'true', false) AS deferred,
  CAST(coalesce(json_extract_string(j, '$.Event.Upload.Offset'), '0') AS BIGINT) AS sent, json_extract_string(j, '$.Event.Upload.MetaData.session') AS session, json_extract_string(j, '$.Event.Upload.MetaData.filename') AS name, coalesce(json_extract_string(j, '$.Event.Upload.MetaData.filetype'), '') AS type,
  coalesce(json_extract_string(j, '$.Event.HTTPRequest.Header.X-Upload-Capability[0]'), json_extract_string(j, '$.Event.HTTPRequest.Header.X-UPLOAD-CAPABILITY[0]')) AS token FROM d),
s AS (SELECT f.*, u.declared, u.received, u.bound_id, CASE WHEN kind IS NULL OR size IS NULL OR size < 0 THEN 422 WHEN kind = 'post-terminate' THEN 200 WHEN session IS NULL OR NOT regexp_full_match(session, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') OR token IS NULL THEN 403
  WHEN u.declared IS NULL THEN 404 WHEN sha256(token) <> token_hash THEN 403 WHEN {NOW} >= expires_at THEN 410 WHEN deferred THEN 422 WHEN size <> declared OR name <> file_name OR CASE WHEN type = '' THEN 'application/octet-stream' ELSE lower(trim(string_split(type, ';')[1])) END <> content_type OR sent > declared THEN 409
  WHEN kind = 'pre-create' THEN CASE WHEN bound_id IS NULL THEN 200 ELSE 409 END WHEN id IS NULL OR id <> bound_id THEN 409 WHEN kind LIKE '%-finish' AND sent <> declared THEN 409 ELSE 200 END AS status FROM f LEFT JOIN v_upload_rows u ON u.session_key = f.session)
SELECT page AS page_id, hook, status, status <> 200 AND kind = 'pre-create' AND coalesce(size >= 0, false) AS reject_upload, status <> 200 AND kind = 'post-receive' AND coalesce(size >= 0, false) AS stop_upload,
  CASE WHEN status = 200 AND kind IN ('post-create', 'post-receive', 'pre-finish', 'post-finish') THEN coalesce(bound_id, id) END AS bound_id, CASE WHEN status = 200 AND kind IN ('post-create', 'post-receive', 'pre-finish', 'post-finish') THEN greatest(received, least(sent, declared)) END AS received FROM s""",
)
def upload_hooks(v) -> DataFrame:
    """The answer to each hook of the upload server, and what its upload's row holds after it. A payload
    that is not of the hooks' shape is 422 and neither rejects nor stops the upload."""
    hooks = v.v_hooks.select(F.col("page_id").alias("page"), "hook", F.from_json("payload", rules.HOOK_JSON, {"columnNameOfCorruptRecord": "broken"}).alias("j"))
    hooks = hooks.withColumns({"session": rules.hook_session(), "token": rules.hook_header("x-upload-capability")})
    rows = hooks.join(v.v_upload_rows, F.col("session") == F.col("session_key"), "left").withColumn("status", rules.hook_status(NOW))
    kind, failed = F.col("j.Type"), (F.col("status") != 200) & F.coalesce(F.col("j.Event.Upload.Size") >= 0, F.lit(False))
    taken = (F.col("status") == 200) & kind.isin(*rules.HOOKS[1:])
    return rows.select(
        F.col("page").alias("page_id"), "hook", "status", F.coalesce(failed & (kind == "pre-create"), F.lit(False)).alias("reject_upload"), F.coalesce(failed & (kind == "post-receive"), F.lit(False)).alias("stop_upload"),
        F.when(taken, F.coalesce("bound_id", "j.Event.Upload.ID")).alias("bound_id"), F.when(taken, F.greatest("received", F.least(F.coalesce("j.Event.Upload.Offset", F.lit(0)), "declared"))).alias("received"),
    )


@book.frame(
    "recovery_gap",
    """, g AS (SELECT session_id, server_state, coalesce(last_wall_end_ms, recording_started_ms) AS wall_started_ms, now_ms AS wall_ended_ms, CASE WHEN write_failed THEN 'browser_local_spool_failure' ELSE 'browser_interruption_before_recovery' END AS reason FROM v_recoveries)
SELECT session_id, wall_started_ms, wall_ended_ms, reason FROM g WHERE NOT (wall_ended_ms - wall_started_ms < 1000 OR server_state = 'finalizing')""",
)
def recovery_gap(v) -> DataFrame:
    """The gap by the wall clock that a recovered recording declares: of a second at least, and none once
    its end is being settled."""
    start = F.coalesce("last_wall_end_ms", "recording_started_ms")
    due = v.v_recoveries.where((F.col("now_ms") - start >= 1000) & (F.col("server_state") != "finalizing"))
    reason = F.when(F.col("write_failed"), "browser_local_spool_failure").otherwise("browser_interruption_before_recovery")
    return due.select("session_id", start.alias("wall_started_ms"), F.col("now_ms").alias("wall_ended_ms"), reason.alias("reason"))


@book.frame(
    "local_high_water",
    """, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence) AS n FROM v_captures),
fold AS (SELECT session_id, n, 0::BIGINT AS start_ms, greatest(1, measured_ms) AS end_ms FROM o WHERE n = 1
  UNION ALL SELECT o.session_id, o.n, f.end_ms, greatest(f.end_ms + 1, o.measured_ms) FROM fold f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1)
SELECT session_id, n AS sequence, start_ms, end_ms FROM fold""",
)
def local_high_water(v) -> DataFrame:
    """Each captured piece takes the next sequence, begins where the last ended, and ends at the measured
    time or a millisecond after its begin, whichever is later.

    end(n) = max(end(n - 1) + 1, measured(n)) is n plus the running maximum of measured - n, which a
    window gives without a fold."""
    own = Window.partitionBy("session_id").orderBy("sequence")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = v.v_captures.withColumn("n", F.row_number().over(own).cast("bigint"))
    rows = rows.withColumn("end_ms", F.col("n") + F.greatest(F.lit(0).cast("bigint"), F.max(F.col("measured_ms") - F.col("n")).over(so_far)))
    start = F.coalesce(F.lag("end_ms").over(own), F.lit(0).cast("bigint"))
    return rows.select("session_id", F.col("n").alias("sequence"), start.alias("start_ms"), "end_ms")


@book.frame(
    "upload_percent",
    """, d AS (SELECT session_id, min(event_id) AS since FROM v_progress WHERE durable GROUP BY session_id)
SELECT p.session_id, event_id, CAST(CASE WHEN event_id >= since THEN 100 WHEN bytes_total <= 0 THEN 0 WHEN bytes_sent < 0 THEN 0 WHEN bytes_sent >= bytes_total THEN 99 ELSE bytes_sent * 100 // bytes_total END AS BIGINT) AS percent FROM v_progress p LEFT JOIN d ON d.session_id = p.session_id""",
)
def upload_percent(v) -> DataFrame:
    """Percent that an upload shows: 0 to 99 until its durable copy is confirmed, 100 from then on."""
    so_far = Window.partitionBy("session_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sent = F.when(F.col("bytes_total") > 0, F.floor(F.col("bytes_sent") * 100 / F.col("bytes_total"))).otherwise(0)
    percent = F.when(F.max("durable").over(so_far), 100).otherwise(F.least(F.lit(99), F.greatest(F.lit(0), sent)))
    return v.v_progress.select("session_id", "event_id", percent.cast("bigint").alias("percent"))


_SAVED = ("fingerprint", "clientRequestId", "capabilityToken", "sessionId")


@book.frame(
    "latest_saved_upload",
    f""", m AS (SELECT c_custkey, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM v_saved_uploads),
e AS (SELECT c_custkey, key, json_extract(j, '$."' || key || '"') AS r FROM (SELECT c_custkey, j, unnest(json_keys(j)) AS key FROM m WHERE json_type(j) = 'OBJECT') k),
u AS (SELECT c_custkey, key, json_extract_string(r, '$.sessionId') AS session_id, CASE WHEN json_type(r, '$.updatedAt') = 'VARCHAR' THEN json_extract_string(r, '$.updatedAt') WHEN json_type(r, '$.expiresAt') = 'VARCHAR' THEN json_extract_string(r, '$.expiresAt') ELSE '1970-01-01T00:00:00.000Z' END AS updated_at
  FROM e WHERE {" AND ".join(f"json_type(r, '$.{f}') = 'VARCHAR'" for f in _SAVED)})
SELECT c_custkey, session_id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY updated_at DESC, key) AS rn FROM u) r WHERE rn = 1""",
)
def latest_saved_upload(v) -> DataFrame:
    """The newest saved upload with a session, by the time of its update, else of its expiry, else 1970.
    Records whose fields are not texts do not count, nor does what is not a JSON object; of equal times
    the first key's record is taken."""
    text = lambda f: F.expr(f"case when schema_of_variant(variant_get(r, '$.{f}', 'variant')) = 'STRING' then variant_get(r, '$.{f}', 'string') end")
    saved = v.v_saved_uploads.select("c_custkey", F.try_parse_json("payload").alias("j")).where("schema_of_variant(j) like 'OBJECT<%'")
    records = saved.select("c_custkey", F.explode(F.expr("cast(j as map<string, variant>)")).alias("key", "r"))
    fields = records.where("schema_of_variant(r) like 'OBJECT<%'").select("c_custkey", "key", *(text(f).alias(f) for f in (*_SAVED, "updatedAt", "expiresAt")))
    whole = fields.dropna(subset=list(_SAVED)).withColumn("updated_at", F.coalesce("updatedAt", "expiresAt", F.lit("1970-01-01T00:00:00.000Z")))
    first = Window.partitionBy("c_custkey").orderBy(F.desc("updated_at"), "key")
    return whole.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("c_custkey", F.col("sessionId").alias("session_id"), "updated_at")
