"""Recording tables as views of the supplied synthetic tables (TESTDATA.md)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from reelspark.sources.rule_inputs import RULE_INPUTS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations")

#: All job predicates are taken at this instant, in seconds; retries and claims lie around it.
NOW = 1_000_000
COOLDOWN = 15

#: JSON texts of notices and of media probes, right and wrong ones.
NOTICES = """v_notices AS (
  SELECT utterance_id, session_id, CASE WHEN k % 13 = 0 THEN '{"type": "transcript_avail' WHEN k % 17 = 0 THEN '[1, 2]' ELSE
    '{"type": "' || CASE WHEN event_type = 'error' THEN 'ping' ELSE 'transcript_available' END || '", "session_id": ' || CASE WHEN k % 7 = 0 THEN CAST(session_id AS VARCHAR(20)) ELSE '"' || CAST(CASE WHEN k % 5 = 0 THEN session_id + 1 ELSE session_id END AS VARCHAR(20)) || '"' END
    || ', "sequence": ' || CASE WHEN k % 11 = 0 THEN 'true' WHEN k % 10 = 1 THEN '"' || CAST(k AS VARCHAR(20)) || '"' WHEN k % 10 = 2 THEN CAST(k AS VARCHAR(20)) || '.5' WHEN k % 10 = 3 THEN CAST(2 - k AS VARCHAR(20)) WHEN k % 10 = 4 THEN 'null' ELSE CAST(k AS VARCHAR(20)) END || '}' END AS payload
  FROM v_raw_jobs)"""
MANIFESTS = """v_manifests AS (
  SELECT p_partkey, CASE WHEN k = 1 THEN '{"version": ' ELSE
    '{"format_version": ' || CASE WHEN k = 2 THEN '3' WHEN p_partkey % 6 = 0 THEN '1' ELSE '2' END || ', "version": ' || CASE WHEN k = 3 THEN '7' WHEN k = 4 THEN '"v1.2"' ELSE '"v1.2.' || CAST(p_size AS VARCHAR(20)) || '-rc.1"' END || ', "channel": "' || CASE k WHEN 5 THEN 'nightly' WHEN 6 THEN 'stable' ELSE 'beta' END || '"'
    || ', "source": {"repository": "https://' || CASE WHEN k = 16 THEN 'elsewhere' ELSE 'git' END || '.example/audio", "revision": "' || CASE WHEN k = 7 THEN 'ABC' ELSE substr(@sha(CAST(p_partkey AS VARCHAR(20))), 1, 40) END || '"}'
    || ', "images": {"api": {"repository": "registry.example/api", "digest": "sha256:' || CASE WHEN k = 8 THEN 'x' ELSE @sha('a') END || '", "reference": "registry.example/api@sha256:' || CASE WHEN k = 9 THEN 'y' ELSE @sha('a') END || '"}, "web": {"repository": "registry.example/' || CASE WHEN k = 17 THEN 'api' ELSE 'web' END || '", "digest": "sha256:' || @sha('b') || '", "reference": "registry.example/web@sha256:' || @sha('b') || '"}}, "compose_file": "deploy/' || CASE WHEN k = 18 THEN 'dev' ELSE 'release' END || '.yaml"'
    || ', "compatibility": {"platforms": ' || CASE k WHEN 10 THEN '[]' WHEN 19 THEN '["linux/amd64", 7]' WHEN 20 THEN '[""]' ELSE '["linux/amd64"]' END || ', "schema_head": "' || CASE WHEN k = 11 THEN '  ' ELSE '0009' END || '", "automatic_database_downgrade": ' || CASE WHEN k = 12 THEN 'true' ELSE 'false' END
    || ', "application_rollback_safe_to_versions": ' || CASE k WHEN 13 THEN '["v1.0.0", "v1.0.0"]' WHEN 14 THEN '["one"]' WHEN 21 THEN '["v1.0.0", 2]' WHEN 22 THEN '"v1.0.0"' ELSE '["v1.0.0", "v1.1.0-alpha"]' END || ', "backup_required": ' || CASE WHEN k = 15 THEN '"no"' ELSE 'true' END || '}}' END AS payload
  FROM (SELECT p_partkey, p_size, p_partkey % 29 AS k FROM part) m)"""
PROBES = """v_probes AS (
  SELECT utterance_id, CASE WHEN k % 23 = 0 THEN '{"streams": [' WHEN k % 19 = 0 THEN '{"streams": {}}' ELSE
    '{"streams": [{"index": 0, "codec_type": "video", "codec_name": "h264"}' || CASE WHEN k % 8 = 0 THEN '' ELSE
      ', {"index": ' || CASE WHEN k % 29 = 0 THEN '-1' ELSE '1' END || ', "codec_type": "audio", "codec_name": "' || CASE k % 6 WHEN 0 THEN ' AAC ' WHEN 1 THEN 'mp3' WHEN 2 THEN 'opus' WHEN 3 THEN 'pcm_s16le' WHEN 4 THEN 'wmav2' ELSE 'vorbis' END || '"' || CASE WHEN k % 4 = 1 THEN ', "duration": "' || CAST(k * 9 - 20 AS VARCHAR(20)) || '.25"' ELSE '' END || '}' END
      || CASE WHEN k % 8 = 3 THEN ', {"index": 2, "codec_type": "audio", "codec_name": "aac"}' ELSE '' END || ']'
      || CASE WHEN k % 9 = 0 THEN '' ELSE ', "format": {"format_name": "' || CASE k % 5 WHEN 0 THEN 'mov,mp4, M4A' WHEN 1 THEN 'ogg' WHEN 2 THEN 'avi' ELSE 'matroska,webm' END || '", "duration": "' || CASE k % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN '-3' WHEN 2 THEN '50000' ELSE CAST(k * 10 AS VARCHAR(20)) || '.5' END || '"}' END || '}' END AS payload
  FROM v_raw_jobs)"""

UTTERANCE_MANIFESTS = """v_utterance_manifests AS (
  SELECT utterance_id AS work_id, session_id, k * 10 AS start_ms, k * 10 + 20 AS end_ms, 'audio/wav' AS content_type, @sha(CAST(k AS VARCHAR(20))) AS sha256, k + 1 AS byte_length,
         CASE k % 12 WHEN 0 THEN NULL WHEN 1 THEN '{"work_id": ' WHEN 2 THEN '[]' ELSE '{"session_id": ' || CAST(CASE WHEN k % 12 = 3 THEN session_id + 1 ELSE session_id END AS VARCHAR(20)) || ', "work_id": ' || CASE WHEN k % 12 = 4 THEN '"' || CAST(utterance_id AS VARCHAR(20)) || '"' ELSE CAST(utterance_id AS VARCHAR(20)) END
           || ', "start_ms": ' || CAST(k * 10 AS VARCHAR(20)) || CASE WHEN k % 12 = 5 THEN '' ELSE ', "end_ms": ' || CAST(k * 10 + 20 AS VARCHAR(20)) END || ', "content_type": ' || CASE WHEN k % 12 = 6 THEN 'null' ELSE '"audio/wav"' END || ', "byte_length": ' || CAST(k + 1 AS VARCHAR(20))
           || CASE WHEN k % 12 = 7 THEN ', "more": 1' ELSE '' END || ', "sha256": "' || @sha(CAST(CASE WHEN k % 12 = 8 THEN k + 1 ELSE k END AS VARCHAR(20))) || '"}' END AS manifest FROM v_raw_jobs)"""

#: Common table expressions that both Spark and DuckDB read.
ADAPTERS = f"""
WITH v_sessions AS (
  SELECT o_orderkey AS session_id, o_custkey AS owner_id,
         CASE WHEN substr(o_orderpriority, 1, 1) IN ('4', '5') THEN 'upload' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'guest_record' ELSE 'live' END AS kind,
         CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'recording' ELSE 'finalizing' END AS state,
         CAST(o_custkey % 4 AS BIGINT) AS epoch, CAST(o_orderkey % 8 AS BIGINT) AS final_sequence, o_orderdate AS created_at
  FROM orders),
v_chunks AS (
  SELECT l_orderkey AS session_id, CAST(l_linenumber AS BIGINT) AS sequence, l_suppkey AS writer_id, CAST(l_suppkey % 4 AS BIGINT) AS epoch,
         CAST(l_quantity AS BIGINT) AS byte_length, CAST((l_linenumber - 1) * 2000 AS BIGINT) AS start_ms, CAST(l_linenumber * 2000 AS BIGINT) AS end_ms,
         l_shipdate, l_partkey, l_extendedprice, l_discount, l_tax
  FROM lineitem),
v_gaps AS (
  SELECT o_orderkey AS session_id, o_orderkey AS gap_id, CAST(2 AS BIGINT) AS lo, CAST(2 + o_orderkey % 3 AS BIGINT) AS hi, o_orderpriority AS reason, o_orderdate AS created_at
  FROM orders WHERE o_orderkey % 2 = 0),
v_chunk_offers AS (
  SELECT session_id, sequence, 2 * l_partkey + b AS arrival, writer_id, epoch, start_ms, end_ms + CASE WHEN b = 1 AND l_partkey % 7 = 0 THEN 1 ELSE 0 END AS end_ms, CASE WHEN b = 1 AND l_partkey % 11 = 0 THEN 'audio/ogg' ELSE 'audio/webm' END AS content_type,
         'h' || CAST(l_partkey + CASE WHEN b = 1 AND l_partkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)) AS sha256, CASE WHEN l_partkey % 13 <> 0 THEN byte_length END AS byte_length
  FROM (SELECT session_id, sequence, max(l_partkey) AS l_partkey, max(writer_id) AS writer_id, max(epoch) AS epoch, max(start_ms) AS start_ms, max(end_ms) AS end_ms, max(byte_length) AS byte_length FROM v_chunks GROUP BY session_id, sequence) c CROSS JOIN (VALUES (0), (1)) AS t(b)),
v_gap_offers AS (
  SELECT session_id, gap_id, b AS arrival, gap_id % 5 AS writer_id, gap_id % 3 + CASE WHEN b = 1 AND gap_id % 11 = 0 THEN 1 ELSE 0 END AS epoch, lo, CASE WHEN b = 1 AND gap_id % 7 = 0 THEN hi + 1 ELSE hi END AS hi, CASE WHEN gap_id % 4 = 0 THEN created_at END AS wall_started_at,
         CASE WHEN gap_id % 4 = 0 AND NOT (b = 1 AND gap_id % 9 = 0) THEN created_at END AS wall_ended_at, CASE WHEN b = 1 AND gap_id % 13 = 0 THEN 'other' ELSE reason END AS reason
  FROM v_gaps CROSS JOIN (VALUES (0), (1)) AS t(b)),
v_heartbeats AS (SELECT user_id AS session_id, event_id, ts FROM events),
v_raw_jobs AS (
  SELECT event_id AS utterance_id, user_id AS session_id, event_type, ts AS created_at, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
v_jobs AS (
  SELECT utterance_id, session_id, k, created_at, value, CAST(k % 6 AS BIGINT) AS attempts, state,
         CAST((utterance_id * 7919) % 10007 AS BIGINT) AS sequence, CAST({NOW} - 5000 + (utterance_id * 31) % 4000 AS BIGINT) AS created,
         CASE WHEN utterance_id % 7 = 0 THEN NULL ELSE {NOW} - utterance_id % 30 END AS last_delivery,
         CASE WHEN state = 'retry_wait' THEN {NOW} - 10 + k % 20 END AS next_attempt,
         CASE WHEN state = 'claimed' THEN {NOW} - 10 + k % 25 END AS claim_expires, CAST({NOW} - 1000 + (utterance_id * 17) % 900 AS BIGINT) AS updated,
         CASE WHEN state = 'failed' THEN 'permanent' WHEN state = 'retry_wait' THEN CASE WHEN k % 2 = 0 THEN 'transient' ELSE 'rate_limited' END WHEN state IN ('pending', 'claimed') AND k % 7 = 0 THEN 'transient' END AS last_error_category
  FROM (SELECT *, CASE WHEN event_type = 'view' THEN 'pending' WHEN event_type = 'click' THEN 'claimed' WHEN event_type = 'purchase' THEN 'succeeded'
                       WHEN event_type = 'signup' THEN 'no_speech' WHEN k >= 80 THEN 'failed' ELSE 'retry_wait' END AS state FROM v_raw_jobs) raw),
v_ready AS (
  SELECT *,
         coalesce(last_delivery > {NOW} - {COOLDOWN}, false) AS recent,
         CASE WHEN state = 'pending' THEN last_delivery IS NULL OR last_delivery <= {NOW} - {COOLDOWN}
              WHEN state = 'retry_wait' AND next_attempt <= {NOW} THEN last_delivery IS NULL OR last_delivery <= {NOW} - {COOLDOWN} OR last_delivery < next_attempt
              WHEN state = 'claimed' AND claim_expires <= {NOW} THEN last_delivery IS NULL OR last_delivery <= {NOW} - {COOLDOWN} OR last_delivery < claim_expires
              ELSE false END AS eligible,
         coalesce(last_delivery > {NOW} - {COOLDOWN} AND (state = 'pending' OR (state = 'retry_wait' AND next_attempt <= {NOW} AND last_delivery >= next_attempt)
              OR (state = 'claimed' AND claim_expires <= {NOW} AND last_delivery >= claim_expires)), false) AS reserved,
         coalesce(state = 'claimed' AND claim_expires > {NOW}, false) AS active
  FROM v_jobs),
v_lines AS (
  SELECT conv_id AS session_id, CAST(turn + 1 AS BIGINT) AS sequence, role, text, CAST(length(text) AS BIGINT) AS n,
         CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM conversations),
v_segments AS (
  SELECT session_id, sequence, 'utterance:' || CAST(sequence AS VARCHAR(20)) AS producer_key, 40 * (upto - n) AS start_ms, 40 * upto + 1 AS end_ms, text,
         CASE role WHEN 'user' THEN 'en' WHEN 'assistant' THEN 'de' END AS language
  FROM v_lines),
v_segment_posts AS (
  SELECT session_id, sequence, CASE sequence % 6 WHEN 0 THEN chr(9) || ' ' || '\u2003' WHEN 1 THEN repeat('k', 161) WHEN 2 THEN chr(10) || ' ' || repeat('k', 160) || chr(13) WHEN 3 THEN NULL ELSE producer_key END AS producer_key,
         start_ms, CASE WHEN session_id % 7 = 0 THEN start_ms ELSE end_ms END AS end_ms, CASE session_id % 5 WHEN 0 THEN chr(9) || chr(13) || chr(28) WHEN 1 THEN '\u00a0' || text || '\u2028' ELSE text END AS text,
         CASE (session_id + sequence) % 6 WHEN 0 THEN ' DE' || chr(9) WHEN 1 THEN repeat(' ', 40) || 'En' WHEN 2 THEN repeat('x', 33) WHEN 3 THEN '\u3000' WHEN 4 THEN NULL ELSE language END AS language
  FROM v_segments),
v_media_types AS (
  SELECT doc_id, CASE doc_id % 15 WHEN 0 THEN 'Audio/WebM; codecs=opus' WHEN 1 THEN ' audio/mp4 ' WHEN 2 THEN '' WHEN 3 THEN 'AUDIO/OGG;x' WHEN 4 THEN 'video/webm' WHEN 5 THEN 'Video/MP4;a;b' WHEN 6 THEN 'audio/wav' WHEN 7 THEN 'audio/x-wav;' WHEN 8 THEN 'audio/flac'
         WHEN 9 THEN 'audio/mpeg' WHEN 10 THEN 'audio/mp3' WHEN 11 THEN 'text/plain' WHEN 12 THEN ';audio/wav' WHEN 13 THEN chr(9) || 'audio/ogg' || '\u00a0' ELSE NULL END AS content_type FROM documents),
v_gap_posts AS (
  SELECT gap_id, CASE WHEN gap_id % 6 = 0 THEN NULL ELSE lo END AS lo, CASE WHEN gap_id % 10 = 0 OR gap_id % 12 = 0 THEN NULL WHEN gap_id % 14 = 0 THEN lo - 1 ELSE hi END AS hi,
         CASE WHEN gap_id % 4 = 0 THEN gap_id * 37 % 3000 END AS wall_from, CASE WHEN gap_id % 8 = 0 THEN gap_id * 37 % 3000 + gap_id % 5 - 1 END AS wall_to FROM v_gaps),
{UTTERANCE_MANIFESTS},
v_canonical AS (
  SELECT j.utterance_id, CASE WHEN l.doc_id % 11 = 0 THEN j.session_id + 1 ELSE j.session_id END AS session_id, 'utterance:' || CAST(l.doc_id AS VARCHAR(20)) AS producer_key, l.quality, l.toxic
  FROM labels l JOIN v_raw_jobs j ON j.utterance_id = l.doc_id),
{NOTICES},
{PROBES},
{MANIFESTS},
{RULE_INPUTS},
v_uploads AS (
  SELECT page_id AS session_id, url, CAST(1000 + (page_id * 7919) % 100000 AS BIGINT) AS declared, CAST((page_id * 104729) % 120000 AS BIGINT) AS sent,
         CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR(20)) END AS sha256, CAST(page_id % 50 AS BIGINT) AS expires_in
  FROM pages),
v_requests AS (
  SELECT page_id AS session_id, CASE page_id % 9 WHEN 0 THEN 'C:' || chr(92) || 'music' || chr(92) || 'Take ' || CAST(page_id AS VARCHAR(20)) || '.MP3' WHEN 1 THEN 'a/b/talk.wav' WHEN 2 THEN 'notes.txt' WHEN 3 THEN ' x.m4a ' WHEN 4 THEN '..' WHEN 5 THEN 'clip.tar.ogg' WHEN 6 THEN '.mp3' WHEN 7 THEN 'show.webm' ELSE 'dir/' END AS file_name,
         CASE page_id % 7 WHEN 0 THEN 'audio/mpeg; q=1' WHEN 1 THEN ' Audio/WAV' WHEN 2 THEN 'AUDIO/MP4' WHEN 3 THEN '' WHEN 4 THEN 'audio/ogg;codecs=opus' WHEN 5 THEN 'video/webm' ELSE ';x' END AS content_type,
         CAST(CASE page_id % 11 WHEN 0 THEN 0 WHEN 1 THEN 6000000000 ELSE page_id * 1000 END AS BIGINT) AS declared_bytes, CAST(CASE page_id % 13 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 50000000 ELSE page_id + 1 END AS BIGINT) AS declared_ms
  FROM pages),
v_sources AS (
  SELECT page_id AS session_id, 'uploads/' || CAST(page_id AS VARCHAR(20)) AS source_storage_key, CASE WHEN page_id % 3 <> 0 THEN 'h' || CAST(page_id * 7 AS VARCHAR(20)) END AS source_sha256, CAST(page_id * 11 AS BIGINT) AS source_byte_length, CAST(1000 + page_id AS BIGINT) AS source_completed_at,
         'norm-1' AS normalization_spec_id, 'seg-1' AS segmentation_spec_id, '[20, 200, 160]' AS segmentation_params_json FROM pages),
v_processed AS (
  SELECT session_id, CASE WHEN session_id % 17 = 0 THEN source_storage_key || 'x' ELSE source_storage_key END AS source_storage_key, CASE WHEN session_id % 7 = 0 THEN 'h1' ELSE source_sha256 END AS source_sha256, source_byte_length + CASE WHEN session_id % 11 = 0 THEN 1 ELSE 0 END AS source_byte_length,
         CASE WHEN session_id % 13 <> 0 THEN source_completed_at END AS source_completed_at, normalization_spec_id, CASE WHEN session_id % 5 = 0 THEN 'seg-2' ELSE segmentation_spec_id END AS segmentation_spec_id, CASE WHEN session_id % 19 = 0 THEN '[20, 200]' ELSE segmentation_params_json END AS segmentation_params_json FROM v_sources),
v_finished AS (SELECT session_id, CASE WHEN session_id % 4 <> 0 THEN source_completed_at + session_id % 3 END AS completed_at FROM v_sources),
v_processing AS (SELECT session_id FROM v_processed WHERE session_id % 5 <> 2),
v_capabilities AS (
  SELECT page_id AS session_id, CASE WHEN page_id % 8 <> 0 THEN 't' || CAST(page_id AS VARCHAR(20)) END AS token, @sha('t' || CAST(CASE WHEN page_id % 9 = 0 THEN page_id + 1 ELSE page_id END AS VARCHAR(20))) AS token_hash, CAST({NOW} AS BIGINT) AS now_s, CAST({NOW} - 10 + page_id % 50 AS BIGINT) AS expires_at FROM pages),
v_recovery AS (
  SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN text || ' ' ELSE text END AS kept_text, 'f' || CAST(doc_id AS VARCHAR(20)) || '.wav' AS name, CAST(n_chars AS VARCHAR(20)) AS size, CAST(doc_id * 3 AS VARCHAR(20)) AS mtime, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'audio/wav' END AS type,
         'f' || CAST(doc_id AS VARCHAR(20)) || '.wav:' || CAST(n_chars AS VARCHAR(20)) || ':' || CAST(doc_id * 3 + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)) || ':' || CASE WHEN doc_id % 2 = 0 THEN 'application/octet-stream' ELSE 'audio/wav' END AS fingerprint,
         doc_id % 5 <> 0 AS has_evidence, CASE doc_id % 7 WHEN 0 THEN 410 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 500 ELSE 200 END AS status FROM documents),
v_releases AS (
  SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'install' ELSE 'update' END AS mode, CASE WHEN p_partkey % 7 <> 0 THEN 'v1.' || CAST(p_partkey % 12 AS VARCHAR(20)) || '.0' END AS current_v, 'v1.' || CAST(p_size % 13 AS VARCHAR(20)) || '.0' AS candidate_v, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 2 END AS format,
         p_partkey % 3 = 0 AS backup, p_partkey % 2 = 0 AS checkpoint, 'v1.' || CAST(p_partkey % 12 - p_size % 2 AS VARCHAR(20)) || '.0,v0.9.0' AS safe, 'v0.9.0,v1.' || CAST(p_partkey % 12 - p_size % 3 AS VARCHAR(20)) || '.0' AS schema_safe FROM part)
"""


#: The views by name: each begins a line.
VIEWS = {m[1]: m[0].removeprefix("WITH ").rstrip().rstrip(",") for m in re.finditer(r"^(?:WITH )?(v_\w+) AS \(.*?(?=^v_\w+ AS \(|\Z)", ADAPTERS, re.M | re.S)}


def with_views(sql: str) -> str:
    """``sql`` (SELECT, or further common table expressions after a comma) behind the views it needs, in
    their order: Spark analyses every view that a statement has."""
    needed: set[str] = set()
    more = set(re.findall(r"\bv_\w+", sql)) & VIEWS.keys()
    while more:
        needed |= more
        more = {n for own in more for n in re.findall(r"\bv_\w+", VIEWS[own]) if n in VIEWS} - needed
    if not needed:
        return sql.strip().replace(",", "WITH ", 1) if sql.strip().startswith(",") else sql
    return "WITH " + ",\n".join(VIEWS[n] for n in VIEWS if n in needed) + "\n" + sql


def spark_text(sql: str) -> str:
    """``@sha(x)`` as sha2(x, 256): the length goes before the parenthesis that closes it."""
    while "@sha(" in sql:
        head, _, rest = sql.partition("@sha(")
        depth, end = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        sql = f"{head}sha2({rest[: end - 1]}, 256){rest[end:]}"
    return sql


_REGISTERED: list[tuple] = []


class Views:
    """The tables of one folder; ``v.name`` is a supplied table or an adapter view."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def register(self) -> None:
        """The tables as temporary views, once for each session and folder."""
        own = (id(self.spark), self.spark.sparkContext.applicationId, self.sf_dir)
        if _REGISTERED == [own]:
            return
        _REGISTERED[:] = [own]
        for name in TABLES:
            self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").createOrReplaceTempView(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if not name.startswith("v_"):
            raise AttributeError(name)
        self.register()
        return self.spark.sql(spark_text(with_views(f"SELECT * FROM {name}")))
