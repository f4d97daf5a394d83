"""Rows that the ingest, upload, recorder and result rules judge: views beside those of the adapters, right
and wrong ones of each kind, as SQL that both Spark and DuckDB read."""

POSTS = """v_chunk_posts AS (
  SELECT p.session_id, p.sequence, p.part, p.start_ms, p.end_ms, p.payload, CASE WHEN p.part % 7 = 0 THEN @sha(p.payload || '?') WHEN p.part % 3 = 0 THEN upper(@sha(p.payload)) ELSE @sha(p.payload) END AS declared_sha256, p.writer_id, p.epoch,
         s.active_writer, s.epoch AS active_epoch, s.state, s.final_sequence
  FROM (SELECT session_id, sequence, l_partkey AS part, writer_id % 2 AS writer_id, epoch, start_ms, CASE WHEN l_partkey % 19 = 0 THEN start_ms - 1 ELSE end_ms END AS end_ms, repeat('a' || CAST(l_partkey AS VARCHAR(20)), CAST(CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE byte_length END AS INT)) AS payload FROM v_chunks) p
  JOIN (SELECT session_id, CASE WHEN owner_id % 5 <> 0 THEN owner_id % 2 END AS active_writer, epoch, CASE WHEN session_id % 3 <> 0 THEN final_sequence END AS final_sequence,
          CASE owner_id % 7 WHEN 0 THEN 'complete' WHEN 1 THEN 'finalizing' WHEN 2 THEN 'recovering' WHEN 3 THEN 'interrupted' WHEN 4 THEN 'failed' ELSE 'recording' END AS state FROM v_sessions) s ON s.session_id = p.session_id)"""

UTTERANCES = """v_utterance_posts AS (
  SELECT utterance_id, session_id, CASE k % 11 WHEN 0 THEN '  ' WHEN 1 THEN chr(9) || 'u:' || CAST(utterance_id AS VARCHAR(20)) || ' ' WHEN 2 THEN repeat('k', 161) WHEN 3 THEN ' ' || repeat('k', 160) || chr(10) ELSE 'u:' || CAST(utterance_id AS VARCHAR(20)) END AS producer_key,
         CASE WHEN k % 17 = 0 THEN -1 ELSE k * 10 END AS start_ms, CASE WHEN k % 13 = 0 THEN k * 10 ELSE k * 10 + 20 END AS end_ms, CASE k % 9 WHEN 0 THEN ' ' WHEN 1 THEN ' Audio/WAV ' WHEN 2 THEN repeat('T', 129) WHEN 3 THEN 'AUDIO/L16; rate=16000' ELSE 'audio/wav' END AS content_type,
         CASE WHEN k % 19 = 0 THEN '' ELSE repeat('p', CAST(k % 5 + 1 AS INT)) END AS payload FROM v_raw_jobs),
v_utterance_offers AS (
  SELECT session_id, 'u:' || CAST(utterance_id AS VARCHAR(20)) AS producer_key, b AS arrival, utterance_id + CASE WHEN b = 1 AND k % 5 = 0 THEN 1 ELSE 0 END AS work_id, k * 10 AS start_ms, k * 10 + CASE WHEN b = 1 AND k % 7 = 0 THEN 21 ELSE 20 END AS end_ms, CASE WHEN b = 1 AND k % 11 = 0 THEN 'audio/l16' ELSE 'audio/wav' END AS content_type,
         'h' || CAST(k + CASE WHEN b = 1 AND k % 13 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)) AS sha256, k + CASE WHEN b = 1 AND k % 17 = 0 THEN 1 ELSE 0 END AS byte_length
  FROM v_raw_jobs CROSS JOIN (VALUES (0), (1)) AS t(b)),
v_segment_offers AS (
  SELECT session_id, producer_key, b AS arrival, start_ms + CASE WHEN b = 1 AND session_id % 7 = 0 THEN 1 ELSE 0 END AS start_ms, end_ms + CASE WHEN b = 1 AND session_id % 5 = 0 THEN 1 ELSE 0 END AS end_ms, CASE WHEN b = 1 AND sequence % 3 = 0 THEN text || '.' ELSE text END AS text,
         CASE WHEN b = 1 AND session_id % 11 = 0 THEN NULL ELSE language END AS language
  FROM v_segments CROSS JOIN (VALUES (0), (1)) AS t(b))"""

RESULTS = """v_results AS (
  SELECT page_id AS session_id, CASE WHEN page_id % 4 <> 1 THEN 1000 + page_id END AS uploaded_at, CASE WHEN page_id % 9 = 1 THEN 'failed' ELSE 'uploading' END AS session_state, CASE WHEN page_id % 7 = 3 THEN 'storage' END AS failure_code,
         CASE page_id % 11 WHEN 0 THEN 'pending' WHEN 1 THEN 'claimed' WHEN 2 THEN 'retry_wait' WHEN 3 THEN 'waiting_stt' WHEN 4 THEN 'failed' WHEN 5 THEN 'withdrawn' WHEN 6 THEN NULL ELSE 'succeeded' END AS processing, CASE WHEN page_id % 2 = 0 THEN 'no_speech' END AS outcome_code, CAST(2000 + page_id AS BIGINT) AS processed_at
  FROM pages)"""

SNAPSHOTS = """v_snapshots AS (
  SELECT o_orderkey AS snapshot_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS session_id, CASE o_custkey % 8 WHEN 0 THEN 'idle' WHEN 1 THEN 'requesting' WHEN 2 THEN 'recording' WHEN 3 THEN 'finalizing' WHEN 4 THEN 'complete' WHEN 5 THEN 'error' ELSE 'recoverable' END AS phase,
         o_orderkey % 17 = 0 AS fenced, o_orderkey % 13 = 0 AS write_failed, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END AS n_missing, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 ELSE 0 END AS n_pending, o_orderkey % 11 < 8 AS online, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 2 = 0 END AS persisted,
         CASE o_orderkey % 6 WHEN 0 THEN 'connecting' WHEN 1 THEN 'live' WHEN 2 THEN 'degraded' ELSE 'off' END AS realtime, CASE WHEN o_orderkey % 10 = 3 THEN 'socket' END AS realtime_error, CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS n_gaps, o_custkey % 5 AS acknowledged, 'Audio is kept.' AS message
  FROM orders)"""

CLAIMS = """v_claims AS (
  SELECT o_orderkey AS session_id, o_custkey % 4 AS epoch, 'w' || CAST(o_custkey % 3 AS VARCHAR(20)) AS writer, CASE WHEN o_orderkey % 3 <> 0 THEN 'p' || CAST(o_custkey % 3 AS VARCHAR(20)) END AS pending_writer, CASE WHEN o_orderkey % 5 <> 0 THEN 'token' END AS recovery_token, o_orderkey % 8 AS last_sequence, o_orderkey % 8 * 2000 AS last_end_ms,
         CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'recording' ELSE 'finalizing' END AS server_state, o_custkey % 4 + CASE WHEN o_orderkey % 4 = 1 THEN 1 WHEN o_orderkey % 11 = 0 THEN 2 ELSE 0 END AS server_epoch,
         CASE WHEN o_orderkey % 4 = 1 THEN 'p' || CAST(o_custkey % 3 AS VARCHAR(20)) WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'w9' ELSE 'w' || CAST(o_custkey % 3 AS VARCHAR(20)) END AS server_writer, CASE WHEN o_orderkey % 6 <> 5 THEN o_orderkey % 8 END AS final_sequence, o_orderkey % 8 * 2000 AS final_end_ms
  FROM orders)"""

#: The session's identifier of an upload, as text.
_KEY = "'00000000-0000-4000-8000-' || lpad(CAST({0} AS VARCHAR(20)), 12, '0')"

HOOKS = f"""v_upload_rows AS (
  SELECT page_id, {_KEY.format("page_id")} AS session_key, 'f' || CAST(page_id AS VARCHAR(20)) || '.wav' AS file_name, 'audio/wav' AS content_type, CAST(1000 + page_id AS BIGINT) AS declared, CAST(page_id % 400 AS BIGINT) AS received, CASE WHEN page_id % 2 = 0 THEN 'tus-' || CAST(page_id AS VARCHAR(20)) END AS bound_id,
         @sha('t' || CAST(page_id AS VARCHAR(20))) AS token_hash, CASE WHEN page_id % 23 = 0 THEN 999999 ELSE 1000001 END AS expires_at FROM pages),
v_hooks AS (
  SELECT page_id, hook, CASE WHEN h % 37 = 0 THEN '{{"Type": "pre' WHEN h % 41 = 0 THEN '{{"Type": "' || hook || '", "Event": {{"HTTPRequest": {{}}}}}}' ELSE '{{"Type": "' || hook || '", "Event": {{"Upload": {{'
      || CASE WHEN hook = 'pre-create' OR h % 43 = 0 THEN '' ELSE '"ID": "tus-' || CAST(page_id + CASE WHEN h % 13 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)) || '", ' END || '"Size": ' || CAST(CASE WHEN h % 17 = 0 THEN 5 WHEN h % 59 = 0 THEN -1 ELSE 1000 + page_id END AS VARCHAR(20))
      || CASE WHEN h % 19 = 0 THEN ', "SizeIsDeferred": true' ELSE '' END || CASE WHEN hook = 'post-create' THEN '' ELSE ', "Offset": ' || CAST(CASE WHEN hook LIKE '%finish' AND h % 5 <> 0 THEN 1000 + page_id WHEN h % 29 = 0 THEN 9999999 ELSE h % 900 END AS VARCHAR(20)) END
      || ', "MetaData": {{' || CASE WHEN h % 31 = 0 THEN '' ELSE '"session": "' || CASE WHEN h % 47 = 0 THEN 'none' WHEN h % 53 = 0 THEN {_KEY.format("1000000 + page_id")} ELSE {_KEY.format("page_id")} END || '", ' END || '"filename": "f' || CAST(page_id + CASE WHEN h % 61 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)) || '.wav"'
      || CASE WHEN h % 11 = 0 THEN '' ELSE ', "filetype": " Audio/WAV; x=1"' END || '}}}}, "HTTPRequest": {{"Method": "PATCH", "Header": {{"Host": ["a"], ' || CASE WHEN h % 7 = 0 THEN '"X-UPLOAD-CAPABILITY"' ELSE '"X-Upload-Capability"' END || ': [' || CASE WHEN h % 67 = 0 THEN '' ELSE '"t' || CAST(page_id + CASE WHEN h % 71 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)) || '"' END || ']}}}}}}}}' END AS payload
  FROM (SELECT page_id, hook, page_id * 6 + b + 1 AS h FROM pages CROSS JOIN (VALUES (0, 'pre-create'), (1, 'post-create'), (2, 'post-receive'), (3, 'pre-finish'), (4, 'post-finish'), (5, 'post-terminate')) AS t(b, hook)) x)"""

#: What a recorder knows when it finishes a recording again, when it captures a piece, and what an upload reports.
CAPTURES = """v_recoveries AS (
  SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'interrupted' WHEN 'O' THEN 'recording' ELSE 'finalizing' END AS server_state, CAST(o_orderkey * 10000 AS BIGINT) AS recording_started_ms, CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_orderkey * 10000 + 4000 AS BIGINT) END AS last_wall_end_ms,
         CAST(o_orderkey * 10000 + 4000 + o_custkey % 5 * 500 - CASE WHEN o_orderkey % 9 = 0 THEN 9000 ELSE 0 END AS BIGINT) AS now_ms, o_orderkey % 4 = 0 AS write_failed FROM orders),
v_captures AS (SELECT session_id, sequence, CAST(min(l_partkey) * 31 % 9000 AS BIGINT) AS measured_ms FROM v_chunks GROUP BY session_id, sequence),
v_progress AS (SELECT session_id, utterance_id AS event_id, CAST(k * 1000 - 500 AS BIGINT) AS bytes_sent, CAST(session_id % 60 * 1000 AS BIGINT) AS bytes_total, event_type = 'signup' AND k % 4 = 0 AS durable FROM v_raw_jobs)"""

#: A browser's saved uploads: a JSON object of records, old, broken and foreign ones among them.
SAVED = """v_saved_uploads AS (
  SELECT c_custkey, CASE WHEN c_custkey % 29 = 0 THEN '{"a": ' WHEN c_custkey % 31 = 0 THEN '[1]' ELSE '{"a' || n || '": {"fingerprint": "f' || n || '", "clientRequestId": "r1", "capabilityToken": "t1", "sessionId": ' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE '"s1-' || n || '"' END || ', "expiresAt": "2026-01-0' || CAST(1 + c_custkey % 8 AS VARCHAR(20)) || 'T00:00:00.000Z"}'
    || ', "b' || n || '": {"fingerprint": ' || CASE WHEN c_custkey % 7 = 0 THEN '7' ELSE '"g"' END || ', "clientRequestId": "r2", "capabilityToken": "t2", "sessionId": ' || CASE WHEN c_custkey % 11 = 0 THEN '5' ELSE '"s2-' || n || '"' END || ', "updatedAt": ' || CASE WHEN c_custkey % 3 = 0 THEN '12' ELSE '"2026-01-0' || CAST(1 + c_custkey % 6 AS VARCHAR(20)) || 'T00:00:00.000Z"' END || '}'
    || CASE WHEN c_custkey % 13 = 0 THEN ', "c": null' WHEN c_custkey % 17 = 0 THEN ', "c": {"fingerprint": "h", "clientRequestId": "r3", "sessionId": "s3", "updatedAt": "2027"}' ELSE '' END || '}' END AS payload
  FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR(20)) AS n FROM customer) c)"""

#: Packets of sound: a 64-bit offset and 16-bit samples, small end first; and what a provider is asked about.
PACKETS = """v_packets AS (
  SELECT l_orderkey, l_linenumber, unhex(substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || CASE WHEN f = 3 THEN 'FF' ELSE substr(h, 1, 2) END
    || repeat('D204FEFF', CAST(CASE f WHEN 1 THEN 0 WHEN 2 THEN 1000 ELSE l_linenumber * 5 END AS INT)) || CASE WHEN f = 0 THEN '00' ELSE '' END) AS payload
  FROM (SELECT l_orderkey, l_linenumber, lpad(hex(CAST(l_orderkey * 160 AS BIGINT)), 16, '0') AS h, CASE WHEN l_linenumber = 3 THEN l_orderkey % 4 ELSE 9 END AS f FROM lineitem) p),
v_speech AS (SELECT utterance_id, k, CASE WHEN k % 10 = 0 THEN '  ' WHEN k % 21 = 1 THEN '!' || CAST(400 + k AS VARCHAR(20)) WHEN k % 21 = 2 THEN '!' ELSE 'utterance ' || CAST(utterance_id AS VARCHAR(20)) || ' ' END AS spoken, CASE WHEN k % 2 = 0 THEN 'audio/wav;en' ELSE 'audio/wav' END AS content_type FROM v_raw_jobs)"""

RULE_INPUTS = ",\n".join((POSTS, UTTERANCES, RESULTS, SNAPSHOTS, CLAIMS, HOOKS, CAPTURES, SAVED, PACKETS))
