"""Canonical transcript reads, exports, uploads and client derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions import formats, rules, versions
from reelspark.functions.formats import clock, line_feeds
from reelspark.plans.book import Book
from reelspark.sources.adapters import spark_text, with_views

book = Book()

_CLOCK = "printf('%02d:%02d:%02d{sep}%03d', {x} // 3600000, ({x} // 60000) % 60, ({x} // 1000) % 60, {x} % 1000)"


def _cue(sep: str) -> str:
    return _CLOCK.format(x="start_ms", sep=sep) + " || ' --> ' || " + _CLOCK.format(x="end_ms", sep=sep)


_LF = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"

book.both(
    segment_count="SELECT session_id, count(*) AS n FROM v_segments GROUP BY session_id",
    seq_allocate=", m AS (SELECT session_id, max(sequence) AS m FROM v_segments GROUP BY session_id) SELECT u.utterance_id, u.session_id, coalesce(m, 0) + row_number() OVER (PARTITION BY u.session_id ORDER BY u.created_at, u.utterance_id) AS sequence FROM v_raw_jobs u LEFT JOIN m ON m.session_id = u.session_id",
    cursor_page=""", r AS (SELECT session_id, sequence, text, row_number() OVER (PARTITION BY session_id ORDER BY sequence) AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM v_segments WHERE sequence > 2)
SELECT session_id, sequence, text, n > 3 AS has_more FROM r WHERE rn <= 3""",
    timeline_page=""", anchor AS (SELECT session_id, start_ms AS s, end_ms AS e, sequence AS q FROM v_segments WHERE sequence = 2),
r AS (SELECT g.session_id, sequence, start_ms, row_number() OVER (PARTITION BY g.session_id ORDER BY start_ms, end_ms, sequence) AS rn FROM v_segments g JOIN anchor a ON a.session_id = g.session_id
  WHERE start_ms > s OR (start_ms = s AND (end_ms > e OR (end_ms = e AND sequence > q))))
SELECT session_id, sequence, start_ms FROM r WHERE rn <= 3""",
    merge_last_write=""", b AS (SELECT 0 AS batch, session_id, sequence, text FROM v_segments UNION ALL SELECT 1, session_id, sequence, text || '!' FROM v_segments WHERE sequence % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, sequence ORDER BY batch DESC) AS rn FROM b) SELECT session_id, sequence, text FROM r WHERE rn = 1""",
    prefix_count="SELECT count(*) AS n FROM part WHERE p_name LIKE 'a%'",
    pk_lookup="SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 7",
    storage_level="""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'unknown' WHEN c_custkey % 3 = 0 AND greatest(0, quota - used) >= 67108864 THEN 'safe' ELSE 'warning' END AS level FROM (SELECT c_custkey, CAST(c_custkey % 100 * 2000000 AS BIGINT) AS quota, CAST(c_custkey % 37 * 1000000 AS BIGINT) AS used FROM customer) q""",
    sha256_evidence="SELECT doc_id, @sha(text) AS sha256 FROM documents",
    request_projection="SELECT o_orderkey, CAST(ceil(ms / 180000.0) AS BIGINT) AS upload_requests, CAST(ceil(ms / 8000.0) AS BIGINT) AS live_requests FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 10 AS ms FROM orders) d",
    duration_label="""SELECT session_id, sequence, CASE WHEN h < 10 THEN '0' ELSE '' END || CAST(h AS VARCHAR(20)) || ':' || lpad(CAST(m AS VARCHAR(20)), 2, '0') || ':' || lpad(CAST(s AS VARCHAR(20)), 2, '0') AS label
FROM (SELECT session_id, sequence, CAST(floor(end_ms / 3600000) AS BIGINT) AS h, CAST(floor(end_ms / 60000) AS BIGINT) % 60 AS m, CAST(floor(end_ms / 1000) AS BIGINT) % 60 AS s FROM v_segments) d""",
    discontinuities=""", d AS (SELECT session_id, event_id, lag(event_id) OVER (PARTITION BY session_id ORDER BY event_id) AS before FROM v_heartbeats)
SELECT session_id, count(CASE WHEN before IS NOT NULL AND event_id <> before + 1 THEN 1 END) AS jumps, count(CASE WHEN before IS NULL OR event_id <> before + 1 THEN 1 END) AS episodes FROM d GROUP BY session_id""",
)


#: The oracles' documents by format.
DOCUMENTS = {
    "txt": f"SELECT session_id, string_agg({_LF} || chr(10), '' ORDER BY start_ms, end_ms, sequence) AS document FROM v_segments GROUP BY session_id",
    "vtt": f"SELECT session_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_cue('.')} || chr(10) || {_LF} || chr(10) || chr(10), '' ORDER BY start_ms, end_ms, sequence) AS document FROM v_segments GROUP BY session_id",
    "srt": f"SELECT session_id, string_agg(cue || chr(10) || {_cue(',')} || chr(10) || {_LF} || chr(10) || chr(10), '' ORDER BY start_ms, end_ms, sequence) AS document FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, end_ms, sequence) AS cue FROM v_segments) r GROUP BY session_id",
    "json": "SELECT session_id, CAST(to_json({'session_id': session_id, 'segments': list({'sequence': sequence, 'start_ms': start_ms, 'end_ms': end_ms, 'text': text, 'language': language} ORDER BY start_ms, end_ms, sequence)}) AS VARCHAR) || chr(10) AS document FROM v_segments GROUP BY session_id",
}


def _document(v, body: str, sep: str = "") -> DataFrame:
    """One text per session: ``body`` of each segment in timeline order."""
    lines = v.v_segments.withColumn("text", line_feeds("text"))
    lines = lines.withColumn("cue", F.expr("row_number() over (partition by session_id order by start_ms, end_ms, sequence)"))
    lines = lines.select("session_id", "start_ms", "end_ms", "sequence", F.expr(body).alias("line") if isinstance(body, str) else body.alias("line"))
    return lines.groupBy("session_id").agg(F.expr(f"listagg(line, '{sep}') WITHIN GROUP (ORDER BY start_ms, end_ms, sequence)").alias("document"))


@book.frame("export_txt", DOCUMENTS["txt"])
def export_txt(v) -> DataFrame:
    return _document(v, "concat(text, '\\n')")


@book.frame("export_vtt", DOCUMENTS["vtt"])
def export_vtt(v) -> DataFrame:
    cues = _document(v, F.concat(clock("start_ms", "."), F.lit(" --> "), clock("end_ms", "."), F.lit("\n"), F.col("text"), F.lit("\n\n")))
    return cues.withColumn("document", F.concat(F.lit("WEBVTT\n\n"), "document"))


@book.frame("export_srt", DOCUMENTS["srt"])
def export_srt(v) -> DataFrame:
    return _document(v, F.concat(F.col("cue").cast("string"), F.lit("\n"), clock("start_ms", ","), F.lit(" --> "), clock("end_ms", ","), F.lit("\n"), F.col("text"), F.lit("\n\n")))


@book.frame("export_json", DOCUMENTS["json"])
def export_json(v) -> DataFrame:
    segments = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "sequence", "text", "language")))
    own = v.v_segments.groupBy("session_id").agg(segments.alias("s"))
    body = "transform(s, x -> named_struct('sequence', x.sequence, 'start_ms', x.start_ms, 'end_ms', x.end_ms, 'text', x.text, 'language', x.language))"
    return own.select("session_id", F.expr(f"concat(to_json(named_struct('session_id', session_id, 'segments', {body}), map('ignoreNullFields', 'false')), '\\n')").alias("document"))


#: The oracles' white space: a class of characters of its own.
_DUCK_SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_DUCK_STRIP = "regexp_replace({x}, '^" + _DUCK_SPACE.replace("{", "{{").replace("}", "}}") + "+|" + _DUCK_SPACE.replace("{", "{{").replace("}", "}}") + "+$', '', 'g')"


@book.frame("text_normalize", f"SELECT doc_id, sha256(substr(coalesce(nullif(trim(regexp_replace(text, '{_DUCK_SPACE}+', ' ', 'g')), ''), 'unknown'), 1, 512)) AS sha256 FROM documents")
def text_normalize(v) -> DataFrame:
    cut = F.substring(F.coalesce(F.nullif(rules.one_spaced("text"), F.lit("")), F.lit("unknown")), 1, 512)
    return v.documents.select("doc_id", F.sha2(cut, 256).alias("sha256"))


@book.frame(
    "segment_validate",
    f""", d AS (SELECT session_id, sequence, start_ms, end_ms, coalesce({_DUCK_STRIP.format(x="producer_key")}, '') AS k, coalesce({_DUCK_STRIP.format(x="text")}, '') AS t, nullif(lower({_DUCK_STRIP.format(x="language")}), '') AS l FROM v_segment_posts),
j AS (SELECT *, CASE WHEN k = '' THEN 'producer_key_blank' WHEN len(k) > 160 THEN 'producer_key_length' WHEN NOT (0 <= start_ms AND start_ms < end_ms) THEN 'time' WHEN t = '' THEN 'text' WHEN len(l) > 32 THEN 'language' ELSE 'accepted' END AS outcome FROM d)
SELECT session_id, sequence, outcome, CASE WHEN outcome = 'accepted' THEN l END AS language, CASE WHEN outcome = 'accepted' THEN sha256(k || chr(10) || t) END AS sha256 FROM j""",
)
def segment_validate(v) -> DataFrame:
    """Each segment's outcome; accepted ones with their language and a digest of key and text as they are kept."""
    rows = v.v_segment_posts.withColumn("outcome", rules.segment_outcome())
    kept = lambda x: F.when(F.col("outcome") == "accepted", x)
    language = F.nullif(F.lower(rules.strip("language")), F.lit(""))
    return rows.select("session_id", "sequence", "outcome", kept(language).alias("language"), kept(F.sha2(F.concat_ws("\n", rules.strip("producer_key"), rules.strip("text")), 256)).alias("sha256"))


@book.frame(
    "gap_validate",
    """SELECT gap_id, CASE WHEN lo IS NULL AND hi IS NULL AND wall_from IS NULL AND wall_to IS NULL THEN 'nothing' WHEN num_nulls(lo, hi) = 1 OR hi < lo THEN 'range' WHEN num_nulls(wall_from, wall_to) = 1 OR wall_to < wall_from THEN 'wall' ELSE 'accepted' END AS outcome FROM v_gap_posts""".replace("num_nulls(lo, hi)", "(lo IS NULL)::INT + (hi IS NULL)::INT").replace("num_nulls(wall_from, wall_to)", "(wall_from IS NULL)::INT + (wall_to IS NULL)::INT"),
)
def gap_validate(v) -> DataFrame:
    return v.v_gap_posts.select("gap_id", rules.gap_outcome().alias("outcome"))


#: Suffixes of stored objects, and of what the provider is sent.
STORED = {"audio/webm": ".webm", "video/webm": ".webm", "audio/ogg": ".ogg", "audio/mp4": ".m4a", "video/mp4": ".mp4", "audio/wav": ".wav", "audio/x-wav": ".wav"}
SENT = {"audio/flac": ".flac", "audio/mpeg": ".mp3", "audio/mp3": ".mp3", "audio/mp4": ".m4a", "audio/ogg": ".ogg", "audio/wav": ".wav", "audio/x-wav": ".wav", "audio/webm": ".webm"}


def _suffixes(known: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{s}')" for k, s in known.items())


@book.frame(
    "mime_normalize",
    f""", b AS (SELECT doc_id, coalesce(nullif(lower({_DUCK_STRIP.format(x="split_part(content_type, ';', 1)")}), ''), 'application/octet-stream') AS base FROM v_media_types),
stored(base, s) AS (VALUES {_suffixes(STORED)}), sent(base, s) AS (VALUES {_suffixes(SENT)})
SELECT doc_id, b.base, coalesce(stored.s, '.bin') AS suffix, sent.s AS provider_suffix FROM b LEFT JOIN stored ON stored.base = b.base LEFT JOIN sent ON sent.base = b.base""",
)
def mime_normalize(v) -> DataFrame:
    """The bare type, the stored object's suffix and the provider's, which has none for other types."""
    rows = v.v_media_types.withColumn("bare", F.substring_index("content_type", ";", 1))
    base = F.coalesce(F.nullif(F.lower(rules.strip("bare")), F.lit("")), F.lit("application/octet-stream"))
    suffix = lambda known: F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[base]
    return rows.select("doc_id", base.alias("base"), F.coalesce(suffix(STORED), F.lit(".bin")).alias("suffix"), suffix(SENT).alias("provider_suffix"))


#: An utterance's stored identity.
MEMBERS = {"work_id": "bigint", "session_id": "bigint", "start_ms": "bigint", "end_ms": "bigint", "content_type": "string", "sha256": "string", "byte_length": "bigint"}


@book.frame(
    "utterance_manifest",
    f"""SELECT work_id, CASE WHEN manifest IS NULL THEN 'missing' WHEN NOT json_valid(manifest) THEN 'unreadable' WHEN json_type(manifest) <> 'OBJECT' OR list_sort(json_keys(manifest)) <> {sorted(MEMBERS)}
  OR {" OR ".join(f"json_extract(manifest, '$.{n}')::VARCHAR IS DISTINCT FROM " + (f"CAST({n} AS VARCHAR)" if t == "bigint" else f"'\"' || {n} || '\"'") for n, t in MEMBERS.items())} THEN 'different' ELSE 'verified' END AS outcome FROM v_utterance_manifests""",
)
def utterance_manifest(v) -> DataFrame:
    """A stored manifest is the utterance's if it has the identity's members, no other, with equal values of
    equal types; their order is free."""
    j = F.try_parse_json("manifest")
    same = F.array_sort(F.json_object_keys("manifest")) == F.array(*(F.lit(n) for n in sorted(MEMBERS)))
    for name, kind in MEMBERS.items():
        member = F.try_variant_get(j, f"$.{name}", "variant")
        typed = F.schema_of_variant(member) == {"bigint": "BIGINT", "string": "STRING"}[kind]
        same = same & typed & (F.try_variant_get(j, f"$.{name}", kind) == F.col(name))
    outcome = F.when(F.col("manifest").isNull(), "missing").when(j.isNull(), "unreadable").when(F.coalesce(same, F.lit(False)), "verified").otherwise("different")
    return v.v_utterance_manifests.select("work_id", outcome.alias("outcome"))


@book.frame(
    "uuid5_work_id",
    """, h AS (SELECT o_orderkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('order:' || CAST(o_orderkey AS VARCHAR))) AS h FROM orders)
SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(strpos('0123456789abcdef', substr(h, 17, 1)) - 1 AS BIGINT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS work_id FROM h""",
)
def uuid5_work_id(v) -> DataFrame:
    """Version 5 identifier of a name: SHA-1 of namespace and name, version and variant set."""
    h = v.orders.select("o_orderkey", F.expr("sha1(concat(unhex('6ba7b8109dad11d180b400c04fd430c8'), encode(concat('order:', o_orderkey), 'UTF-8')))").alias("h"))
    variant = "substr('89ab', cast(conv(substr(h, 17, 1), 16, 10) as int) % 4 + 1, 1)"
    return h.selectExpr("o_orderkey", f"concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', {variant}, substr(h, 18, 3), '-', substr(h, 21, 12)) as work_id")


_DUCK_EVIDENCE = "sha256(unhex(lpad(to_hex(octet_length({b})), 16, '0')) || {b}[1:262144] || {b}[greatest(1, octet_length({b}) - 262143):octet_length({b})])"


@book.frame("content_evidence", f"SELECT doc_id, {_DUCK_EVIDENCE.format(b='b')} AS evidence FROM (SELECT doc_id, encode(text) AS b FROM documents) d")
def content_evidence(v) -> DataFrame:
    return v.documents.select("doc_id", formats.content_evidence(F.encode("text", "UTF-8")).alias("evidence"))


@book.frame("path_keys", "SELECT o_orderkey, printf('sessions/%08d', o_orderkey) AS path FROM orders")
def path_keys(v) -> DataFrame:
    return v.orders.select("o_orderkey", F.format_string("sessions/%08d", "o_orderkey").alias("path"))


@book.frame(
    "timeline_ms",
    """SELECT s, s * 1000 // 16000 AS start_ms, (e * 1000 + 15999) // 16000 AS end_ms, CAST(round_even(s / 16.0, 0) AS BIGINT) AS live_start_ms, greatest(CAST(round_even(s / 16.0, 0) AS BIGINT) + 1, CAST(round_even(e / 16.0, 0) AS BIGINT)) AS live_end_ms,
  greatest(1, CAST(round_even((e - s) * 11025 / 1000.0, 0) AS BIGINT)) AS samples FROM (SELECT DISTINCT CAST(l_partkey * 37 AS BIGINT) AS s, CAST(l_partkey * 37 + l_linenumber * 648 AS BIGINT) AS e FROM lineitem) x""",
)
def timeline_ms(v) -> DataFrame:
    """Samples at 16 kHz as milliseconds, rounded outwards for uploads and half to even for live audio,
    whose end is later than its start; and milliseconds as samples at 11025 Hz, one at least."""
    spans = v.lineitem.selectExpr("cast(l_partkey * 37 as bigint) as s", "cast(l_partkey * 37 + l_linenumber * 648 as bigint) as e").distinct()
    live = lambda c: F.rint(F.col(c) * 1000 / 16000).cast("bigint")
    return spans.select("s", F.expr("s * 1000 div 16000").alias("start_ms"), F.expr("(e * 1000 + 15999) div 16000").alias("end_ms"), live("s").alias("live_start_ms"), F.greatest(live("s") + 1, live("e")).alias("live_end_ms"), F.greatest(F.lit(1).cast("bigint"), F.rint((F.col("e") - F.col("s")) * 11025 / 1000).cast("bigint")).alias("samples"))


@book.frame(
    "bytes_label",
    """, b AS (SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN n_chars * power(7, doc_id % 9)::BIGINT END AS n FROM documents),
t AS (SELECT *, floor(n / 1048576 * 10 + 0.5)::BIGINT AS mb, floor(n / 1073741824 * 10 + 0.5)::BIGINT AS gb FROM b)
SELECT doc_id, CASE WHEN n < 1048576 THEN greatest(1, floor(n / 1024 + 0.5)::BIGINT) || ' KB' WHEN n < 1073741824 THEN mb // 10 || '.' || mb % 10 || ' MB' ELSE gb // 10 || '.' || gb % 10 || ' GB' END AS upload_label,
  CASE WHEN n IS NULL THEN 'unknown' WHEN n < 1048576 THEN floor(n / 1024 + 0.5)::BIGINT || ' KB' WHEN n < 1073741824 THEN floor(n / 1048576 + 0.5)::BIGINT || ' MB' ELSE gb // 10 || '.' || gb % 10 || ' GB' END AS storage_label FROM t""",
)
def bytes_label(v) -> DataFrame:
    sizes = v.documents.selectExpr("doc_id", "case when doc_id % 50 <> 0 then n_chars * cast(power(7, doc_id % 9) as bigint) end as n")
    return sizes.select("doc_id", formats.bytes_label("n", False).alias("upload_label"), formats.bytes_label("n", True).alias("storage_label"))


#: Versions of many forms, unsupported ones too.
_VERSIONS = ", forms AS (SELECT DISTINCT 'v' || CAST(p_size % 12 AS VARCHAR(20)) || '.' || CAST(p_partkey % 11 AS VARCHAR(20)) || '.0' || CASE p_partkey % 9 WHEN 0 THEN '-alpha.' || CAST(p_partkey % 13 AS VARCHAR(20)) WHEN 1 THEN '-beta.' || CAST(p_partkey % 13 AS VARCHAR(20)) WHEN 2 THEN '-rc.1' WHEN 3 THEN '' WHEN 4 THEN '-alpha' WHEN 5 THEN '-alpha.x1' WHEN 6 THEN '-beta.2.' || CAST(p_partkey % 5 AS VARCHAR(20)) WHEN 7 THEN '-rc.a.10' ELSE '-x' END AS v FROM part)"
_DUCK_CHANNEL = "CASE WHEN regexp_full_match(v, 'v[0-9]+[.][0-9]+[.][0-9]+') THEN 'stable' WHEN regexp_full_match(v, 'v[0-9]+[.][0-9]+[.][0-9]+-alpha([.][0-9A-Za-z-]+)*') THEN 'alpha' WHEN regexp_full_match(v, 'v[0-9]+[.][0-9]+[.][0-9]+-(beta|rc)([.][0-9A-Za-z-]+)*') THEN 'beta' END"


def _forms(v) -> DataFrame:
    v.register()
    return v.spark.sql(spark_text(with_views(f"{_VERSIONS} SELECT v FROM forms")))


@book.frame("version_channel", f"{_VERSIONS} SELECT v, coalesce({_DUCK_CHANNEL}, 'unsupported') AS channel FROM forms")
def version_channel(v) -> DataFrame:
    return _forms(v).select("v", F.coalesce(versions.channel(F.col("v")), F.lit("unsupported")).alias("channel"))


@book.frame(
    "version_latest",
    f"""{_VERSIONS}, c AS (SELECT v, {_DUCK_CHANNEL} AS channel FROM forms),
k AS (SELECT *, list_transform(string_split(regexp_replace(substr(v, 2), '-.*', ''), '.'), lambda x: CAST(x AS BIGINT)) AS core, CASE WHEN contains(v, '-') THEN 0 ELSE 1 END AS final,
  list_transform(string_split(regexp_extract(v, '-(.*)$', 1), '.'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '0' || lpad(x, 18, '0') ELSE '1' || x END) AS pre FROM c WHERE channel IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY core DESC, final DESC, pre DESC) AS rn FROM k) SELECT channel, v FROM r WHERE rn = 1""",
)
def version_latest(v) -> DataFrame:
    """The latest version of each channel in semantic order."""
    named = _forms(v).select("v", versions.channel(F.col("v")).alias("channel")).where("channel is not null")
    return named.groupBy("channel").agg(F.max_by("v", versions.order_key(F.col("v"))).alias("v"))


#: The media types that each extension allows.
TYPES = {
    ".wav": ["audio/wav", "audio/x-wav", "audio/vnd.wave", "application/octet-stream"],
    ".mp3": ["audio/mpeg", "audio/mp3", "application/octet-stream"],
    ".m4a": ["audio/mp4", "audio/x-m4a", "application/octet-stream"],
    ".ogg": ["audio/ogg", "application/ogg", "application/octet-stream"],
    ".webm": ["audio/webm", "video/webm", "application/octet-stream"],
    ".mp4": ["video/mp4", "audio/mp4", "application/octet-stream"],
}
MOST_BYTES, MOST_MS = 5 << 30, 12 * 3_600_000


@book.frame(
    "upload_policy",
    f""", r AS (SELECT session_id, trim(regexp_extract(replace(file_name, chr(92), '/'), '[^/]*$')) AS name, coalesce(nullif(lower(trim(string_split(content_type, ';')[1])), ''), 'application/octet-stream') AS kind, declared_bytes, declared_ms FROM v_requests),
x AS (SELECT *, lower(regexp_extract(name, '.([.][^.]*[^.])$', 1)) AS ext FROM r), t AS (SELECT * FROM (VALUES {", ".join(f"('{e}', {k})" for e, k in TYPES.items())}) AS t(e, kinds))
SELECT session_id, CASE WHEN name IN ('', '.', '..') THEN 'file_name' WHEN kinds IS NULL THEN 'extension' WHEN NOT list_contains(kinds, kind) THEN 'content_type' WHEN declared_bytes <= 0 THEN 'empty' WHEN declared_bytes > {MOST_BYTES} THEN 'size'
  WHEN declared_ms <= 0 THEN 'duration' WHEN declared_ms > {MOST_MS} THEN 'duration_limit' ELSE 'accepted' END AS outcome, name, kind FROM x LEFT JOIN t ON e = ext""",
)
def upload_policy(v) -> DataFrame:
    """Why an upload is refused: its base name, extension, media type for that extension, size, duration."""
    name = F.trim(F.substring_index(F.translate("file_name", "\\", "/"), "/", -1))
    kind = F.coalesce(F.nullif(F.lower(F.trim(F.substring_index("content_type", ";", 1))), F.lit("")), F.lit("application/octet-stream"))
    rows = v.v_requests.select("session_id", name.alias("name"), kind.alias("kind"), "declared_bytes", "declared_ms")
    extension = F.lower(F.regexp_extract("name", r".(\.[^.]*[^.])$", 1))
    kinds = F.create_map(*(x for e, k in TYPES.items() for x in (F.lit(e), F.array(*map(F.lit, k)))))[extension]
    outcome = (
        F.when(F.col("name").isin("", ".", ".."), "file_name").when(kinds.isNull(), "extension").when(~F.array_contains(kinds, F.col("kind")), "content_type")
        .when(F.col("declared_bytes") <= 0, "empty").when(F.col("declared_bytes") > MOST_BYTES, "size").when(F.col("declared_ms") <= 0, "duration").when(F.col("declared_ms") > MOST_MS, "duration_limit").otherwise("accepted")
    )
    return rows.select("session_id", outcome.alias("outcome"), "name", "kind")


#: The columns of a source's identity, in the order in which they are compared.
IDENTITY = ("source_storage_key", "source_sha256", "source_byte_length", "source_completed_at", "normalization_spec_id", "segmentation_spec_id", "segmentation_params_json")


@book.frame("identity_drift", ", d AS (SELECT a.session_id, [" + ", ".join(f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in IDENTITY) + "] AS found FROM v_sources a JOIN v_processed b ON a.session_id = b.session_id) SELECT session_id, list_filter(found, lambda x: x IS NOT NULL)[1] AS first_drift, len(list_filter(found, lambda x: x IS NOT NULL)) AS n FROM d WHERE len(list_filter(found, lambda x: x IS NOT NULL)) > 0")
def identity_drift(v) -> DataFrame:
    """Sources whose processing was begun for another identity: the first column that differs, and how
    many do."""
    both = v.v_sources.alias("a").join(v.v_processed.alias("b"), "session_id")
    found = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in IDENTITY)))
    return both.select("session_id", found.alias("found")).where(F.size("found") > 0).select("session_id", F.col("found")[0].alias("first_drift"), F.size("found").cast("bigint").alias("n"))


@book.frame("capability_state", "SELECT session_id, CASE WHEN token IS NULL OR sha256(token) <> token_hash THEN 'invalid' WHEN now_s >= expires_at THEN 'expired' ELSE 'valid' END AS state FROM v_capabilities")
def capability_state(v) -> DataFrame:
    same = F.coalesce(F.sha2("token", 256) == F.col("token_hash"), F.lit(False))
    return v.v_capabilities.select("session_id", F.when(~same, "invalid").when(F.col("now_s") >= F.col("expires_at"), "expired").otherwise("valid").alias("state"))


@book.frame(
    "recovery_match",
    f"""SELECT doc_id, CASE WHEN name || ':' || size || ':' || mtime || ':' || coalesce(nullif(type, ''), 'application/octet-stream') <> fingerprint THEN 'metadata_changed' WHEN evidence IS NULL THEN 'no_evidence' WHEN {_DUCK_EVIDENCE.format(b="encode(text)")} = evidence THEN 'match' ELSE 'content_changed' END AS outcome,
  CASE WHEN status = 410 THEN 'drop' WHEN status IN (403, 404) THEN 'drop_and_recreate' WHEN status <> 200 THEN 'rethrow' ELSE 'continue' END AS reaction
FROM (SELECT *, {_DUCK_EVIDENCE.format(b="encode(kept_text)")} AS kept_evidence, CASE WHEN has_evidence THEN {_DUCK_EVIDENCE.format(b="encode(kept_text)")} END AS evidence FROM v_recovery) r""",
)
def recovery_match(v) -> DataFrame:
    """A chosen file against the saved upload: name, size, time and type first, then the evidence of its
    content; and what the answer to the saved upload's lookup leads to."""
    saved = F.when(F.col("has_evidence"), formats.content_evidence(F.encode("kept_text", "UTF-8")))
    rows = v.v_recovery.withColumns({"evidence": saved, "now": formats.content_evidence(F.encode("text", "UTF-8")), "file": F.concat_ws(":", "name", "size", "mtime", F.coalesce(F.nullif("type", F.lit("")), F.lit("application/octet-stream")))})
    outcome = F.when(F.col("file") != F.col("fingerprint"), "metadata_changed").when(F.col("evidence").isNull(), "no_evidence").when(F.col("evidence") == F.col("now"), "match").otherwise("content_changed")
    reaction = F.when(F.col("status") == 410, "drop").when(F.col("status").isin(403, 404), "drop_and_recreate").when(F.col("status") != 200, "rethrow").otherwise("continue")
    return rows.select("doc_id", outcome.alias("outcome"), reaction.alias("reaction"))


@book.frame(
    "release_admission",
    f""", s AS (SELECT p_partkey, mode, current_v, candidate_v, format, backup, checkpoint, safe, schema_safe, list_transform(string_split(substr(current_v, 2), '.'), lambda x: CAST(x AS BIGINT)) AS cur, list_transform(string_split(substr(candidate_v, 2), '.'), lambda x: CAST(x AS BIGINT)) AS cand FROM v_releases)
SELECT p_partkey, CASE WHEN mode = 'install' AND current_v IS NOT NULL THEN 'installed' WHEN mode = 'update' AND current_v IS NULL THEN 'not_installed' WHEN mode = 'update' AND format <> 2 THEN 'format' WHEN current_v = candidate_v THEN 'current' WHEN mode = 'update' AND cand <= cur THEN 'not_newer'
  WHEN format = 2 AND backup AND NOT checkpoint THEN 'checkpoint' ELSE 'accepted' END AS outcome, current_v IS NOT NULL AND list_contains(string_split(safe, ','), current_v) AS may_return, current_v IS NOT NULL AND list_contains(string_split(safe, ','), current_v) AND list_contains(string_split(schema_safe, ','), current_v) AS may_roll_back FROM s""",
)
def release_admission(v) -> DataFrame:
    """Whether a release may be installed or updated to, and whether one may go back from it: by itself
    if it lists the version before, by hand if the applied schema lists it too."""
    current, candidate = F.col("current_v"), F.col("candidate_v")
    update = F.col("mode") == "update"
    outcome = (
        F.when((F.col("mode") == "install") & current.isNotNull(), "installed").when(update & current.isNull(), "not_installed").when(update & (F.col("format") != 2), "format").when(current == candidate, "current")
        .when(update & (versions.order_key(candidate) <= versions.order_key(current)), "not_newer").when((F.col("format") == 2) & F.col("backup") & ~F.col("checkpoint"), "checkpoint").otherwise("accepted")
    )
    lists = lambda c: F.coalesce(F.array_contains(F.split(c, ","), current), F.lit(False))
    return v.v_releases.select("p_partkey", outcome.alias("outcome"), lists("safe").alias("may_return"), (lists("safe") & lists("schema_safe")).alias("may_roll_back"))


#: Where a manifest's images, sources and services file come from.
IMAGES = {"api": "registry.example/api", "web": "registry.example/web"}
SOURCE = "https://git.example/audio"
SERVICES = "deploy/release.yaml"
_DUCK_IMAGES = " ".join(f"WHEN json_extract_string(j, '$.images.{role}.repository') IS DISTINCT FROM '{at}' OR NOT coalesce(regexp_full_match(json_extract_string(j, '$.images.{role}.digest'), 'sha256:[0-9a-f]{{64}}'), false) OR json_extract_string(j, '$.images.{role}.reference') IS DISTINCT FROM '{at}@' || json_extract_string(j, '$.images.{role}.digest') THEN 'image'" for role, at in IMAGES.items())


@book.frame(
    "manifest_check",
    f""", r AS (SELECT p_partkey, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM v_manifests),
m AS (SELECT *, CASE WHEN json_type(j, '$.version') = 'VARCHAR' THEN json_extract_string(j, '$.version') END AS v, json_extract(j, '$.compatibility.application_rollback_safe_to_versions') AS listed, json_extract_string(j, '$.compatibility.application_rollback_safe_to_versions[*]') AS back, json_extract(j, '$.compatibility.platforms[*]') AS platforms FROM r),
c AS (SELECT *, {_DUCK_CHANNEL} AS named, len(list_filter(back, lambda v: {_DUCK_CHANNEL} IS NULL)) AS strange FROM m)
SELECT p_partkey, CASE WHEN j IS NULL THEN 'json' WHEN json_extract_string(j, '$.format_version') NOT IN ('1', '2') THEN 'format_version' WHEN named IS NULL THEN 'version' WHEN json_extract_string(j, '$.channel') IS DISTINCT FROM named THEN 'channel'
  WHEN json_extract_string(j, '$.source.repository') IS DISTINCT FROM '{SOURCE}' THEN 'source' WHEN NOT regexp_full_match(json_extract_string(j, '$.source.revision'), '[0-9a-f]{{40}}') THEN 'revision' {_DUCK_IMAGES} WHEN len(platforms) = 0 OR len(list_filter(platforms, lambda x: json_type(x) <> 'VARCHAR' OR x::VARCHAR = '""')) > 0 THEN 'platforms' WHEN trim(json_extract_string(j, '$.compatibility.schema_head')) = '' THEN 'schema_head'
  WHEN json_extract_string(j, '$.compatibility.automatic_database_downgrade') <> 'false' THEN 'downgrade' WHEN json_extract_string(j, '$.compose_file') IS DISTINCT FROM '{SERVICES}' THEN 'services' WHEN json_extract_string(j, '$.format_version') = '1' THEN 'accepted' WHEN json_type(listed) <> 'ARRAY' OR len(list_filter(json_extract(listed, '$[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'rollback_types' WHEN len(list_distinct(back)) <> len(back) OR strange > 0 THEN 'rollback_versions'
  WHEN json_type(j, '$.compatibility.backup_required') <> 'BOOLEAN' THEN 'backup_required' ELSE 'accepted' END AS outcome FROM c""",
)
def manifest_check(v) -> DataFrame:
    """The first rule that a release manifest breaks; format 1 says nothing of going back."""
    image = "struct<repository: string, digest: string, reference: string>"
    shape = f"format_version string, version string, channel string, compose_file string, source struct<repository: string, revision: string>, images struct<{', '.join(f'{r}: {image}' for r in IMAGES)}>, compatibility struct<platforms: array<string>, schema_head: string, automatic_database_downgrade: string, application_rollback_safe_to_versions: array<string>, backup_required: string>, broken string"
    rows = v.v_manifests.select("p_partkey", "payload", F.from_json("payload", shape, {"columnNameOfCorruptRecord": "broken"}).alias("j"))
    text = lambda path, pattern: F.coalesce(F.col(path).rlike(pattern), F.lit(False))
    images = F.lit(True)
    for role, at in IMAGES.items():
        own = f"j.images.{role}"
        images = images & (F.col(f"{own}.repository") == at) & text(f"{own}.digest", "^sha256:[0-9a-f]{64}$") & (F.col(f"{own}.reference") == F.concat(F.lit(f"{at}@"), F.col(f"{own}.digest")))
    variant = F.try_parse_json("payload")
    strings = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(variant, f"$.compatibility.{path}", "variant")) == "ARRAY<STRING>", F.lit(False))
    none = F.coalesce(F.to_json(F.try_variant_get(variant, "$.compatibility.application_rollback_safe_to_versions", "variant")) == "[]", F.lit(False))
    own, back = "j.compatibility", F.col("j.compatibility.application_rollback_safe_to_versions")
    channel = versions.channel(F.col("j.version"))
    outcome = (
        F.when(variant.isNull(), "json").when(~text("j.format_version", "^[12]$"), "format_version").when(channel.isNull(), "version").when(~F.coalesce(F.col("j.channel") == channel, F.lit(False)), "channel")
        .when(~F.coalesce(F.col("j.source.repository") == SOURCE, F.lit(False)), "source").when(~text("j.source.revision", "^[0-9a-f]{40}$"), "revision").when(~F.coalesce(images, F.lit(False)), "image").when(~strings("platforms") | F.array_contains(f"{own}.platforms", ""), "platforms").when(~text(f"{own}.schema_head", r"\S"), "schema_head")
        .when(~text(f"{own}.automatic_database_downgrade", "^false$"), "downgrade").when(~F.coalesce(F.col("j.compose_file") == SERVICES, F.lit(False)), "services").when(F.col("j.format_version") == "1", "accepted")
        .when(~strings("application_rollback_safe_to_versions") & ~none, "rollback_types").when((F.size(F.array_distinct(back)) != F.size(back)) | F.exists(back, lambda x: versions.channel(x).isNull()), "rollback_versions")
        .when(~F.col("payload").rlike(r'"backup_required"\s*:\s*(true|false)\s*[,}]'), "backup_required").otherwise("accepted")
    )
    return rows.select("p_partkey", outcome.alias("outcome"))
