"""Durable job scheduling: eligibility, fair bounded admission, convergence, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators.admission import Limits, admit, judge
from reelspark.functions.errors import client_retries, provider_category
from reelspark.operators.replay import release_outcome, replay
from reelspark.plans.book import Book
from reelspark.sources.adapters import COOLDOWN, NOW
from reelspark.streaming.reconcile import JOBS, reconcile_loop

book = Book()

#: Outstanding jobs of each class, and of a session in it.
LIMITS = {"live": Limits(15_000, 24, COOLDOWN), "upload": Limits(12_000, 24, COOLDOWN)}
STATES = "(VALUES ('pending'), ('claimed'), ('retry_wait'), ('succeeded'), ('no_speech'), ('failed')) AS states(s)"

#: The oracle of the admission: jobs in fair order, as many of a class as its limit leaves.
_TOTALS = " UNION ALL ".join(f"SELECT '{c}' AS workload, {x.total} AS total, {x.per_session} AS most" for c, x in LIMITS.items())
FAIR = f"""
, limits AS ({_TOTALS}),
own AS (SELECT CASE WHEN s.kind = 'upload' THEN 'upload' ELSE 'live' END AS workload, j.* FROM v_ready j JOIN v_sessions s ON s.session_id = j.session_id),
free AS (SELECT l.workload, most, greatest(0, total - coalesce((SELECT count(*) FROM own o WHERE o.workload = l.workload AND (o.active OR o.reserved)), 0)) AS places FROM limits l),
served AS (SELECT session_id, count(*) FILTER (WHERE active OR reserved) AS busy, coalesce(max(last_delivery), min(created)) AS turn FROM own GROUP BY session_id),
line AS (SELECT workload, utterance_id, session_id, last_delivery, row_number() OVER (PARTITION BY session_id ORDER BY sequence, created, utterance_id) AS r FROM own WHERE eligible),
placed AS (SELECT l.*, f.places, row_number() OVER (PARTITION BY l.workload ORDER BY l.r, s.turn, l.session_id, l.utterance_id) AS place
  FROM line l JOIN served s ON s.session_id = l.session_id JOIN free f ON f.workload = l.workload WHERE l.r + s.busy <= f.most),
admitted AS (SELECT * FROM placed WHERE place <= places),
target AS (SELECT f.workload, (SELECT count(*) FROM admitted a WHERE a.workload = f.workload) + (SELECT count(*) FROM own o WHERE o.workload = f.workload AND o.reserved) AS target FROM free f)
"""

book.both(
    workload_class="SELECT CASE WHEN kind = 'upload' THEN 'upload' ELSE 'live' END AS workload, count(*) AS n FROM v_sessions GROUP BY CASE WHEN kind = 'upload' THEN 'upload' ELSE 'live' END",
    jobs_state_counts=f", sessions AS (SELECT DISTINCT session_id FROM v_jobs), n AS (SELECT session_id, state, count(*) AS c FROM v_jobs GROUP BY session_id, state) SELECT t.session_id, s AS state, coalesce(c, 0) AS n FROM sessions t CROSS JOIN {STATES} LEFT JOIN n ON n.session_id = t.session_id AND n.state = s",
)


def _duck_replay(outcome: str, most: int) -> str:
    """The oracle of a replay: attempt by attempt."""
    return f""", a AS (SELECT session_id, {outcome} AS outcome, row_number() OVER (PARTITION BY session_id ORDER BY utterance_id) AS rn FROM v_raw_jobs),
fold AS (SELECT session_id, 0::BIGINT AS rn, 'pending' AS state, 0::BIGINT AS attempts FROM (SELECT DISTINCT session_id FROM a) s
  UNION ALL SELECT a.session_id, a.rn, CASE WHEN a.outcome = 'permanent' OR (a.outcome = 'retry' AND f.attempts + 1 = {most}) THEN 'failed' WHEN a.outcome = 'retry' THEN 'retry_wait' ELSE a.outcome END, f.attempts + 1
  FROM fold f JOIN a ON a.session_id = f.session_id AND a.rn = f.rn + 1 WHERE f.state IN ('pending', 'retry_wait')),
ends AS (SELECT session_id, max(rn) AS rn FROM fold GROUP BY session_id), final AS (SELECT f.* FROM fold f JOIN ends e ON e.session_id = f.session_id AND e.rn = f.rn)
"""


#: What an attempt at a transcript, and one at a media file, came to.
STT = "CASE WHEN k % 10 = 0 THEN 'permanent' WHEN k % 9 = 4 THEN 'succeeded' WHEN k % 14 = 3 THEN 'no_speech' ELSE 'retry' END"
MEDIA = "CASE WHEN k % 8 = 0 THEN 'permanent' WHEN k % 5 = 0 THEN 'waiting_stt' WHEN k % 9 = 1 THEN 'succeeded' ELSE 'retry' END"


@book.frame(
    "job_replay",
    _duck_replay(STT, 5) + "SELECT session_id, CASE WHEN session_id IN (SELECT session_id FROM v_canonical WHERE quality = 0) THEN 'succeeded' ELSE state END AS state, attempts, state = 'retry_wait' AND session_id NOT IN (SELECT session_id FROM v_canonical WHERE quality = 0) AS waits FROM final",
)
def job_replay(v) -> DataFrame:
    """Final state of each job from its attempts; canonical evidence makes it succeeded whatever they say."""
    canonical = v.v_canonical.where("quality = 0").select(F.col("session_id").alias("key"), F.lit(True).alias("canonical")).distinct()
    ends = replay(v.v_raw_jobs.selectExpr("session_id as key", "utterance_id as at", f"{STT} as outcome"), 5).join(canonical, "key", "left")
    return ends.selectExpr("key as session_id", "if(canonical, 'succeeded', state) as state", "attempts", "state = 'retry_wait' and canonical is null as waits")


@book.frame("media_replay", _duck_replay(MEDIA, 3) + "SELECT session_id, state, attempts, CASE WHEN state = 'retry_wait' THEN (5.0 * power(2, attempts - 1))::DOUBLE END AS next_delay, CASE WHEN state = 'succeeded' THEN 'no_speech' END AS outcome_code FROM final")
def media_replay(v) -> DataFrame:
    """Final state of each media file: waiting for its transcripts, done without any, waiting or failed."""
    ends = replay(v.v_raw_jobs.selectExpr("session_id as key", "utterance_id as at", f"{MEDIA} as outcome"), 3)
    waits = F.when(F.col("state") == "retry_wait", backoff(5.0, "attempts"))
    return ends.select(F.col("key").alias("session_id"), "state", "attempts", waits.alias("next_delay"), F.when(F.col("state") == "succeeded", "no_speech").alias("outcome_code"))


@book.frame(
    "release_replay",
    """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'migration_failed_manual_recovery' WHEN p_partkey % 4 <> 1 THEN 'success' WHEN current_v IS NULL THEN 'install_failed_manual_recovery' WHEN NOT list_contains(string_split(safe, ','), current_v) THEN 'rollback_refused_unsafe'
  WHEN p_partkey % 5 = 0 THEN 'rollback_failed_manual_recovery' ELSE 'rolled_back_to_previous_known_good' END AS result, CASE WHEN p_partkey % 9 <> 0 AND p_partkey % 4 <> 1 THEN candidate_v ELSE current_v END AS current_v, CASE WHEN p_partkey % 9 <> 0 THEN candidate_v END AS schema_authority FROM v_releases""",
)
def release_replay(v) -> DataFrame:
    """What applying each release came to, which version is current then, and whose schema is applied."""
    safe = F.coalesce(F.array_contains(F.split("safe", ","), F.col("current_v")), F.lit(False))
    n = F.col("p_partkey")
    result = release_outcome(F.col("current_v").isNotNull(), safe, n % 9 != 0, n % 4 != 1, n % 5 != 0)
    rows = v.v_releases.withColumn("result", result)
    return rows.select("p_partkey", "result", F.when(F.col("result") == "success", F.col("candidate_v")).otherwise(F.col("current_v")).alias("current_v"), F.when(F.col("result") != "migration_failed_manual_recovery", F.col("candidate_v")).alias("schema_authority"))


def classed(v) -> DataFrame:
    """Jobs with the class of their session, uploads or all others, judged by its limits."""
    kind = F.when(F.col("kind") == "upload", "upload").otherwise("live")
    return judge(v.v_jobs.join(v.v_sessions.select("session_id", kind.alias("workload")), "session_id"), NOW, LIMITS)


@book.frame("jobs_eligible", FAIR + "SELECT workload, state, recent, count(*) AS n FROM own WHERE eligible GROUP BY workload, state, recent")
def jobs_eligible(v) -> DataFrame:
    recent = F.coalesce(F.col("last_delivery") > NOW - COOLDOWN, F.lit(False))
    return classed(v).where("eligible").groupBy("workload", "state", recent.alias("recent")).agg(F.count("*").alias("n"))


@book.frame("jobs_reserved", FAIR + "SELECT workload, state, count(*) AS n FROM own WHERE reserved GROUP BY workload, state")
def jobs_reserved(v) -> DataFrame:
    return classed(v).where("reserved").groupBy("workload", "state").agg(F.count("*").alias("n"))


@book.frame("jobs_outstanding", FAIR + "SELECT session_id, count(*) AS n FROM own WHERE active OR reserved GROUP BY session_id")
def jobs_outstanding(v) -> DataFrame:
    return classed(v).where("outstanding").groupBy("session_id").agg(F.count("*").alias("n"))


#: Failures that a session's diagnostics show.
FAILURES = 10


@book.frame("jobs_recent_failures", f", r AS (SELECT *, (SELECT count(*) FROM v_jobs o WHERE o.session_id = j.session_id AND o.last_error_category IS NOT NULL AND (o.updated > j.updated OR (o.updated = j.updated AND o.utterance_id < j.utterance_id))) AS newer FROM v_jobs j WHERE last_error_category IS NOT NULL) SELECT session_id, utterance_id, last_error_category, CAST(newer + 1 AS BIGINT) AS place FROM r WHERE newer < {FAILURES}")
def jobs_recent_failures(v) -> DataFrame:
    """A session's jobs that ended in an error at any time, in whatever state they are now, latest update first."""
    order = Window.partitionBy("session_id").orderBy(F.col("updated").desc(), "utterance_id")
    ranked = v.v_jobs.where("last_error_category is not null").withColumn("place", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("place") <= FAILURES).select("session_id", "utterance_id", "last_error_category", "place")


#: How a provider's answer and a client's failed request are sorted.
_DUCK_CATEGORY = {"rate_limited": [429], "configuration": [401, 403], "transient": [408, 425, *range(500, 700)]}


@book.frame(
    "error_category",
    f""", e AS (SELECT utterance_id, k, CASE WHEN k < 10 THEN 429 WHEN k < 20 THEN 401 WHEN k < 30 THEN 403 WHEN k < 40 THEN 408 WHEN k < 50 THEN 425 WHEN k % 3 <> 0 THEN 350 + k * 3 END AS code,
  CASE k % 6 WHEN 0 THEN 'network' WHEN 3 THEN CASE WHEN k % 12 = 3 THEN 'timeout' ELSE 'aborted' END ELSE 'http' END AS kind FROM v_jobs)
SELECT utterance_id, code, kind, CASE {" ".join(f"WHEN list_contains({v}, code) THEN '{k}'" for k, v in _DUCK_CATEGORY.items())} WHEN code IS NULL THEN 'transient' ELSE 'permanent' END AS category,
  CASE kind WHEN 'network' THEN true WHEN 'timeout' THEN true WHEN 'aborted' THEN false ELSE coalesce(list_contains([408, 429], code) OR code BETWEEN 500 AND 699, false) END AS client_retry FROM e""",
)
def error_category(v) -> DataFrame:
    """The provider's category of an answer, none of which is transient, and whether the client asks again: after
    network errors and timeouts, never once the caller has given up, else by the answer's status."""
    k = F.col("k")
    code = F.when(k < 10, 429).when(k < 20, 401).when(k < 30, 403).when(k < 40, 408).when(k < 50, 425).when(k % 3 != 0, (350 + k * 3).cast("int"))
    kind = F.when(k % 6 == 0, "network").when(k % 12 == 3, "timeout").when(k % 6 == 3, "aborted").otherwise("http")
    rows = v.v_jobs.select("utterance_id", code.alias("code"), kind.alias("kind"))
    return rows.select("utterance_id", "code", "kind", provider_category(F.col("code")).alias("category"), client_retries(F.col("kind"), F.col("code")).alias("client_retry"))


@book.frame("jobs_history", "SELECT session_id, CAST(max(last_delivery) AS BIGINT) AS last_delivery, CAST(min(created) AS BIGINT) AS oldest FROM v_jobs GROUP BY session_id")
def jobs_history(v) -> DataFrame:
    return v.v_jobs.groupBy("session_id").agg(F.max("last_delivery").cast("bigint").alias("last_delivery"), F.min("created").alias("oldest"))


@book.frame("jobs_fair_reserve", FAIR + f"SELECT workload, utterance_id, session_id, CAST(r AS BIGINT) AS rank_in_session, CAST(place AS BIGINT) AS place, CAST(greatest(coalesce(last_delivery, 0), {NOW}) AS BIGINT) AS new_delivery FROM admitted")
def jobs_fair_reserve(v) -> DataFrame:
    """The admitted jobs with their place in the fair order, which the limit of their class bounds."""
    return admit(classed(v), NOW, LIMITS).withColumnRenamed("rank", "rank_in_session")


@book.frame(
    "jobs_claim_next",
    FAIR + """, c AS (SELECT workload, utterance_id, session_id, row_number() OVER (PARTITION BY workload ORDER BY last_delivery, created, session_id, sequence, utterance_id) AS n FROM own WHERE reserved)
SELECT workload, utterance_id, session_id FROM c WHERE n = 1""",
)
def jobs_claim_next(v) -> DataFrame:
    """The first reserved job of each class in delivery order."""
    order = F.struct("last_delivery", "created", "session_id", "sequence", "utterance_id")
    first = classed(v).where("reserved").groupBy("workload").agg(F.min(order).alias("j"))
    return first.select("workload", "j.utterance_id", "j.session_id")


@book.frame("jobs_wake_target", FAIR + "SELECT workload, CAST(target AS BIGINT) AS target FROM target")
def jobs_wake_target(v) -> DataFrame:
    """Reserved jobs of each class once the admitted ones are reserved too."""
    judged = classed(v)
    held = judged.where("reserved").select("workload").unionAll(admit(judged, NOW, LIMITS).select("workload"))
    none = v.spark.createDataFrame([(c, 0) for c in LIMITS], "workload string, n int")
    return held.withColumn("n", F.lit(1)).unionAll(none).groupBy("workload").agg(F.sum("n").alias("target"))


@book.frame("wake_deficit", FAIR + "SELECT workload, queued, CAST(greatest(0, target - queued) AS BIGINT) AS to_publish FROM target CROSS JOIN (VALUES (0), (100), (100000)) AS q(queued)")
def wake_deficit(v) -> DataFrame:
    """Wakes to publish, given how many are queued."""
    queued = F.explode(F.array(F.lit(0), F.lit(100), F.lit(100_000)))
    return jobs_wake_target(v).select("workload", "target", queued.alias("queued")).selectExpr("workload", "queued", "greatest(0L, target - queued) as to_publish")


def with_job(v) -> DataFrame:
    """Four of five jobs; the utterances of the others lack one."""
    return v.v_jobs.where("k % 5 <> 0").select("utterance_id")


@book.frame("jobs_missing", "SELECT utterance_id FROM v_raw_jobs u WHERE NOT EXISTS (SELECT 1 FROM v_jobs j WHERE j.utterance_id = u.utterance_id AND j.k % 5 <> 0)")
def jobs_missing(v) -> DataFrame:
    return v.v_raw_jobs.join(with_job(v), "utterance_id", "left_anti").select("utterance_id")


def with_evidence(v, how: str) -> DataFrame:
    """Jobs with (semi) or without (anti) a canonical segment of their session and producer key."""
    jobs = v.v_jobs.withColumn("producer_key", F.concat(F.lit("utterance:"), F.col("utterance_id").cast("string")))
    return jobs.join(v.v_canonical.select("session_id", "producer_key"), ["session_id", "producer_key"], how)


_EVIDENCE = "EXISTS (SELECT 1 FROM v_canonical c WHERE c.session_id = j.session_id AND c.producer_key = 'utterance:' || CAST(j.utterance_id AS VARCHAR))"


#: Rows that a pass repairs of each kind at most, those updated longest ago first.
REPAIRS = 4 * LIMITS["live"].total


@book.frame("jobs_converge", f"SELECT utterance_id, state AS before, 'succeeded' AS after FROM v_jobs j WHERE state <> 'succeeded' AND {_EVIDENCE} ORDER BY updated, utterance_id LIMIT {REPAIRS}")
def jobs_converge(v) -> DataFrame:
    """Jobs in any other state whose canonical segment exists have succeeded: as many as a pass takes."""
    due = with_evidence(v, "left_semi").where("state <> 'succeeded'").orderBy("updated", "utterance_id").limit(REPAIRS)
    return due.select("utterance_id", F.col("state").alias("before"), F.lit("succeeded").alias("after"))


@book.frame("jobs_false_success", f"SELECT utterance_id, 'pending' AS after FROM v_jobs j WHERE state = 'succeeded' AND NOT {_EVIDENCE} ORDER BY updated, utterance_id LIMIT {REPAIRS}")
def jobs_false_success(v) -> DataFrame:
    due = with_evidence(v, "left_anti").where("state = 'succeeded'").orderBy("updated", "utterance_id").limit(REPAIRS)
    return due.select("utterance_id", F.lit("pending").alias("after"))


@book.frame("jobs_backfill", f"SELECT utterance_id, CASE WHEN {_EVIDENCE} THEN 'succeeded' ELSE 'pending' END AS state, 0 AS attempts FROM v_raw_jobs j")
def jobs_backfill(v) -> DataFrame:
    found = v.v_canonical.select("session_id", "producer_key", F.lit(True).alias("there"))
    jobs = v.v_raw_jobs.withColumn("producer_key", F.concat(F.lit("utterance:"), F.col("utterance_id").cast("string"))).join(found, ["session_id", "producer_key"], "left")
    return jobs.select("utterance_id", F.when(F.col("there"), "succeeded").otherwise("pending").alias("state"), F.lit(0).alias("attempts"))


@book.frame(
    "reconcile_report",
    FAIR + f""", n AS (SELECT (SELECT least({REPAIRS}, count(*)) FROM v_raw_jobs u WHERE NOT EXISTS (SELECT 1 FROM v_jobs j WHERE j.utterance_id = u.utterance_id AND j.k % 5 <> 0)) AS created,
  (SELECT least({REPAIRS}, count(*)) FROM v_jobs j WHERE state <> 'succeeded' AND {_EVIDENCE}) AS converged, (SELECT least({REPAIRS}, count(*)) FROM v_jobs j WHERE state = 'succeeded' AND NOT {_EVIDENCE}) AS repaired)
SELECT t.workload, created, converged, repaired, (SELECT count(*) FROM admitted a WHERE a.workload = t.workload) AS reserved, CAST(target AS BIGINT) AS wake_target FROM target t CROSS JOIN n""",
)
def reconcile_report(v) -> DataFrame:
    """What one pass over the jobs does: three counts of repairs, and by class what it reserves and wakes."""
    judged = classed(v)
    reserved = admit(judged, NOW, LIMITS).groupBy("workload").agg(F.count("*").alias("reserved"))
    held = judged.groupBy("workload").agg(F.count_if("reserved").alias("held"))
    counts = [rows.agg(F.count("*").alias(name)) for name, rows in (("created", jobs_missing(v).limit(REPAIRS)), ("converged", jobs_converge(v)), ("repaired", jobs_false_success(v)))]
    each = v.spark.createDataFrame([(c,) for c in LIMITS], "workload string").join(reserved, "workload", "left").join(held, "workload", "left")
    rows = each.crossJoin(counts[0]).crossJoin(counts[1]).crossJoin(counts[2])  # single rows
    zero = F.coalesce("reserved", F.lit(0).cast("bigint"))
    return rows.select("workload", "created", "converged", "repaired", zero.alias("reserved"), (zero + F.coalesce("held", F.lit(0))).alias("wake_target"))


@book.frame("reconcile_ticks")
def reconcile_ticks(v) -> DataFrame:
    """Three ticks of the loop over one job in eight missing, with results that arrive between ticks."""
    kind = F.when(F.col("kind") == "upload", "upload").otherwise("live")
    sessions = v.v_sessions.select("session_id", kind.alias("workload"))
    jobs = v.v_jobs.select(*(c.split()[0] for c in JOBS.split(", ")))
    work = jobs.select("utterance_id", "session_id", "sequence", "created")
    evidence = v.v_canonical.selectExpr("utterance_id", "session_id", f"{NOW - 1} + quality as at")
    return reconcile_loop(v.spark, jobs.where("utterance_id % 8 <> 0"), work, evidence, sessions, [NOW, NOW + 1, NOW + COOLDOWN + 1], LIMITS, 500)


def backoff(base: float, attempts: str, most: float | None = None):
    """Seconds before the attempt after the n-th: doubled each time, up to ``most``."""
    delay = F.lit(base) * F.pow(F.lit(2.0), F.greatest(F.lit(0).cast("bigint"), F.col(attempts) - 1))
    return delay if most is None else F.least(F.lit(most), delay)


@book.frame(
    "retry_backoff",
    """SELECT utterance_id, CASE WHEN k % 9 = 0 THEN 300.0::DOUBLE ELSE least(60.0, 2.0 * power(2, greatest(0, attempts - 1)))::DOUBLE END AS stt_delay, (5.0 * power(2, greatest(0, attempts - 1)))::DOUBLE AS media_delay, (250.0 * power(2, least(attempts, 3)))::DOUBLE AS client_ms,
  CAST(floor(least(15000, 500 * power(2, least(30, greatest(0, attempts)))) / 2 * (1 + k / 100.0) + 0.5) AS BIGINT) AS reconnect_ms, greatest(60, 20 + k + 10) AS lease FROM v_jobs""",
)
def retry_backoff(v) -> DataFrame:
    """Delays after ``attempts``: a configuration error waits a fixed time, media retries have no ceiling,
    the client doubles four times, its reconnect takes half of the ceiling and up to as much by chance
    (``k`` stands for it), and a lease outlasts the provider's time limit."""
    stt = F.when(F.col("k") % 9 == 0, 300.0).otherwise(backoff(2.0, "attempts", 60.0))
    ceiling = F.least(F.lit(15_000.0), 500 * F.pow(F.lit(2.0), F.least(F.lit(30), F.greatest(F.lit(0), F.col("attempts")))))
    reconnect = F.floor(ceiling / 2 * (1 + F.col("k") / 100) + 0.5).cast("bigint")
    client = 250 * F.pow(F.lit(2.0), F.least(F.col("attempts"), F.lit(3)))
    return v.v_jobs.select("utterance_id", stt.alias("stt_delay"), backoff(5.0, "attempts").alias("media_delay"), client.alias("client_ms"), reconnect.alias("reconnect_ms"), F.greatest(F.lit(60).cast("bigint"), F.col("k") + 30).alias("lease"))


#: Uploads that get a processing row in a pass.
MEDIA_BATCH = 100


@book.frame("media_missing_rows", f"SELECT session_id, completed_at FROM v_finished u WHERE completed_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_processing p WHERE p.session_id = u.session_id) ORDER BY completed_at, session_id LIMIT {MEDIA_BATCH}")
def media_missing_rows(v) -> DataFrame:
    """Completed uploads without a processing row, those completed first, as many as a pass takes."""
    rows = v.v_finished.where("completed_at is not null").join(v.v_processing, "session_id", "left_anti")
    return rows.orderBy("completed_at", "session_id").limit(MEDIA_BATCH).select("session_id", "completed_at")


@book.frame(
    "media_waiting_converge",
    f""", e AS (SELECT session_id, count(*) - CASE session_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS expected FROM v_raw_jobs GROUP BY session_id),
x AS (SELECT j.session_id, j.state, {_EVIDENCE} AS canonical FROM v_jobs j WHERE NOT (j.session_id % 3 = 0 AND j.state IN ('failed', 'pending', 'claimed', 'retry_wait')))
SELECT x.session_id, CASE WHEN count(*) > any_value(expected) OR bool_or(state = 'failed' AND NOT canonical) THEN 'failed' WHEN count(*) = any_value(expected) AND bool_and(canonical OR state = 'no_speech') THEN 'succeeded' ELSE 'waiting' END AS outcome
FROM x JOIN e ON e.session_id = x.session_id GROUP BY x.session_id""",
)
def media_waiting_converge(v) -> DataFrame:
    """Outcome of each upload from its utterances' jobs: more of them than the media pass counted, or a
    failed one without a canonical segment, fail it; all of them settled complete it."""
    expected = v.v_raw_jobs.groupBy("session_id").agg((F.count("*") - F.expr("case session_id % 4 when 0 then 1 when 1 then -1 else 0 end")).alias("expected"))
    jobs = with_evidence(v, "left_semi").select("utterance_id", F.lit(True).alias("canonical"))
    jobs = v.v_jobs.join(jobs, "utterance_id", "left").where("not (session_id % 3 = 0 and state in ('failed', 'pending', 'claimed', 'retry_wait'))").withColumn("canonical", F.coalesce("canonical", F.lit(False)))
    seen = jobs.groupBy("session_id").agg(F.count("*").alias("n"), F.bool_or(F.expr("state = 'failed' and not canonical")).alias("failed"), F.bool_and(F.expr("canonical or state = 'no_speech'")).alias("settled")).join(expected, "session_id")
    return seen.select("session_id", F.when((F.col("n") > F.col("expected")) | F.col("failed"), "failed").when((F.col("n") == F.col("expected")) & F.col("settled"), "succeeded").otherwise("waiting").alias("outcome"))


@book.frame(
    "check_shapes",
    """, j AS (SELECT utterance_id, state, claim_expires, next_attempt, CASE WHEN k % 11 <> 0 THEN next_attempt END AS shown, sha256(CAST(utterance_id AS VARCHAR)) AS h, k FROM v_jobs),
d AS (SELECT *, CASE WHEN k % 13 = 0 THEN upper(h) WHEN k % 17 = 0 THEN substr(h, 1, 63) ELSE h END AS hash, CASE WHEN k % 19 = 0 THEN 'Bad Queue' ELSE 'stt.live-' || k END AS queue, CASE WHEN k % 7 = 0 THEN substr(h, 1, 20) ELSE h END AS capability,
  CASE WHEN k % 5 <> 0 THEN 1 END AS byte_length FROM j)
SELECT count(*) FILTER (WHERE (state = 'claimed') <> (claim_expires IS NOT NULL)) AS claim_shape, count(*) FILTER (WHERE (state = 'retry_wait') <> (shown IS NOT NULL)) AS retry_shape, count(*) FILTER (WHERE NOT regexp_full_match(hash, '[0-9a-f]{64}')) AS hash_shape,
  count(*) FILTER (WHERE NOT regexp_full_match(queue, '[A-Za-z0-9_.-]{1,64}')) AS queue_shape, count(*) FILTER (WHERE NOT regexp_full_match(capability, '[A-Za-z0-9_-]{43,128}')) AS capability_shape, count(*) FILTER (WHERE (byte_length IS NULL) <> (k % 10 = 0)) AS completion_shape, count(*) AS n FROM d""",
)
def check_shapes(v) -> DataFrame:
    """Violations of the shapes that rows must have: claim and retry columns set in their states alone,
    completion evidence whole or absent, and the patterns of hashes, queue names and capabilities."""
    h = F.sha2(F.col("utterance_id").cast("string"), 256)
    k = F.col("k")
    rows = v.v_jobs.select("state", "claim_expires", "k", F.when(k % 11 != 0, F.col("next_attempt")).alias("shown"), F.when(k % 13 == 0, F.upper(h)).when(k % 17 == 0, F.substring(h, 1, 63)).otherwise(h).alias("hash"),
        F.when(k % 19 == 0, "Bad Queue").otherwise(F.concat(F.lit("stt.live-"), k.cast("string"))).alias("queue"), F.when(k % 7 == 0, F.substring(h, 1, 20)).otherwise(h).alias("capability"), F.when(k % 5 != 0, 1).alias("byte_length"), F.when(k % 10 != 0, h).alias("evidence"))
    wrong = {
        "claim_shape": (F.col("state") == "claimed") != F.col("claim_expires").isNotNull(),
        "retry_shape": (F.col("state") == "retry_wait") != F.col("shown").isNotNull(),
        "hash_shape": ~F.col("hash").rlike("^[0-9a-f]{64}$"),
        "queue_shape": ~F.col("queue").rlike("^[A-Za-z0-9_.-]{1,64}$"),
        "capability_shape": ~F.col("capability").rlike("^[A-Za-z0-9_-]{43,128}$"),
        "completion_shape": F.col("byte_length").isNull() != F.col("evidence").isNull(),
    }
    return rows.agg(*(F.count_if(c).alias(n) for n, c in wrong.items()), F.count("*").alias("n"))


#: What the media probe accepts besides codecs that begin with pcm_.
CODECS = ("mp3", "aac", "alac", "opus", "vorbis", "flac")
CONTAINERS = ("wav", "mp3", "mov", "mp4", "m4a", "3gp", "3g2", "mj2", "ogg", "matroska", "webm", "flac")
MOST_SECONDS = 12 * 3600


@book.frame(
    "notice_decode",
    """, r AS (SELECT n.utterance_id, n.session_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM v_notices n)
SELECT utterance_id, CASE WHEN json_type(j) = 'OBJECT' AND json_extract_string(j, '$.type') = 'transcript_available' AND json_type(j, '$.session_id') = 'VARCHAR' AND json_extract_string(j, '$.session_id') = CAST(session_id AS VARCHAR)
  AND json_type(j, '$.sequence') IN ('BIGINT', 'UBIGINT') AND CAST(json_extract_string(j, '$.sequence') AS BIGINT) >= 1 THEN CAST(json_extract_string(j, '$.sequence') AS BIGINT) END AS sequence FROM r""",
)
def notice_decode(v) -> DataFrame:
    """The sequence of a valid notice of the session: an object of the right type and session with a
    whole number from 1 on; anything else is null."""
    kind = F.regexp_extract("payload", r'"sequence"\s*:\s*(-?[0-9]+)\s*[,}]', 1)
    fields = F.from_json("payload", "type string, session_id string, sequence string", {"mode": "PERMISSIVE"})
    read = v.v_notices.select("utterance_id", "session_id", "payload", fields.alias("f"), kind.alias("digits"))
    good = "f.type = 'transcript_available' and f.session_id = cast(session_id as string) and payload rlike '\"session_id\"\\\\s*:\\\\s*\"' and f.sequence = digits and try_cast(digits as bigint) >= 1"
    return read.selectExpr("utterance_id", f"case when {good} then cast(digits as bigint) end as sequence")


_DUCK_SECONDS = "CASE WHEN json_type({0}) = 'VARCHAR' AND isfinite(try_cast(json_extract_string({0}, '$') AS DOUBLE)) AND try_cast(json_extract_string({0}, '$') AS DOUBLE) >= 0 THEN try_cast(json_extract_string({0}, '$') AS DOUBLE) END"


@book.frame(
    "probe_classify",
    f""", r AS (SELECT utterance_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM v_probes),
s AS (SELECT utterance_id, j, list_filter(CAST(json_extract(j, '$.streams') AS JSON[]), lambda x: json_extract_string(x, '$.codec_type') = 'audio') AS audio FROM r WHERE json_type(j, '$.streams') = 'ARRAY'),
d AS (SELECT utterance_id, len(audio) AS n, json_type(audio[1], '$.index') IN ('BIGINT', 'UBIGINT') AND CAST(json_extract_string(audio[1], '$.index') AS BIGINT) >= 0 AND json_type(audio[1], '$.codec_name') = 'VARCHAR' AS whole, lower(trim(json_extract_string(audio[1], '$.codec_name'))) AS codec,
  json_type(j, '$.format.format_name') = 'VARCHAR' AS named, list_transform(string_split(json_extract_string(j, '$.format.format_name'), ','), lambda x: lower(trim(x))) AS names,
  greatest({_DUCK_SECONDS.format("json_extract(j, '$.format.duration')")}, {_DUCK_SECONDS.format("json_extract(audio[1], '$.duration')")}) AS duration FROM s)
SELECT p.utterance_id, CASE WHEN d.utterance_id IS NULL THEN 'probe_malformed' WHEN n = 0 THEN 'no_audio' WHEN n > 1 THEN 'multiple_audio_streams' WHEN NOT coalesce(whole, false) THEN 'probe_malformed'
  WHEN NOT (starts_with(codec, 'pcm_') OR codec IN {CODECS}) THEN 'unsupported_codec' WHEN NOT coalesce(named, false) THEN 'probe_malformed' WHEN NOT list_has_any(names, {list(CONTAINERS)}) THEN 'unsupported_container'
  WHEN duration > {MOST_SECONDS} THEN 'duration_limit' ELSE 'accepted' END AS outcome, CASE WHEN n = 1 THEN duration END AS duration FROM v_probes p LEFT JOIN d ON d.utterance_id = p.utterance_id""",
)
def probe_classify(v) -> DataFrame:
    """What the media probe's answer leads to: exactly one audio stream, of a known codec, in a known
    container, within the time limit; durations are decimal texts, finite and not negative."""
    shape = "streams array<struct<index: string, codec_type: string, codec_name: string, duration: string>>, format struct<format_name: string, duration: string>"
    read = v.v_probes.select("utterance_id", "payload", F.from_json("payload", shape).alias("j"))
    read = read.withColumn("audio", F.filter("j.streams", lambda x: x["codec_type"] == "audio")).withColumn("one", F.get("audio", F.lit(0)))

    def seconds(x: str):
        value = F.expr(f"try_cast({x} as double)")
        return F.when((value >= 0) & (value < float("inf")), value)

    codec = F.lower(F.trim("one.codec_name"))
    names = F.transform(F.split("j.format.format_name", ","), lambda x: F.lower(F.trim(x)))
    known = F.arrays_overlap(names, F.array(*map(F.lit, CONTAINERS)))
    length = F.greatest(seconds("j.format.duration"), seconds("one.duration"))
    outcome = (
        F.when(F.col("j.streams").isNull(), "probe_malformed").when(F.size("audio") == 0, "no_audio").when(F.size("audio") > 1, "multiple_audio_streams")
        .when(~F.coalesce(F.expr("one.index rlike '^[0-9]+$'"), F.lit(False)) | F.col("one.codec_name").isNull(), "probe_malformed")
        .when(~(codec.startswith("pcm_") | codec.isin(*CODECS)), "unsupported_codec").when(F.col("j.format.format_name").isNull(), "probe_malformed")
        .when(~known, "unsupported_container").when(length > MOST_SECONDS, "duration_limit").otherwise("accepted")
    )
    return read.select("utterance_id", outcome.alias("outcome"), F.when(F.size("audio") == 1, length).alias("duration"))


@book.frame(
    "media_claimable",
    f""", c AS (SELECT *, row_number() OVER (PARTITION BY session_id % 20 ORDER BY created, session_id, utterance_id) AS n FROM v_jobs WHERE state = 'pending' OR (state = 'retry_wait' AND next_attempt <= {NOW}) OR (state = 'claimed' AND claim_expires <= {NOW}))
SELECT session_id % 20 AS queue, count(*) AS runnable, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS wake, max(CASE WHEN n = 1 THEN utterance_id END) AS next_id FROM c GROUP BY session_id % 20""",
)
def media_claimable(v) -> DataFrame:
    """Runnable files of each queue, whether its worker is woken, and the oldest, which it claims next."""
    due = (F.col("state") == "pending") | ((F.col("state") == "retry_wait") & (F.col("next_attempt") <= NOW)) | ((F.col("state") == "claimed") & (F.col("claim_expires") <= NOW))
    runnable = v.v_jobs.where(due).withColumn("queue", F.expr("session_id % 20"))
    return runnable.groupBy("queue").agg(F.count("*").alias("runnable"), F.least(F.lit(1), F.count("*").cast("int")).alias("wake"), F.min_by("utterance_id", F.struct("created", "session_id", "utterance_id")).alias("next_id"))
