"""Cases with known results of the scheduler, coverage, version, format and stream rules."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reelspark.functions import formats, rules, versions
from reelspark.operators import coverage
from reelspark.operators.admission import Limits, claim_next, reserve
from reelspark.operators.replay import replay
from reelspark.operators.transcribe import ProviderError, transcribe
from reelspark.plans.jobs import backoff
from reelspark.sources.blobs import verify, wav_format
from tests.conftest import SMALL

JOBS = "utterance_id bigint, session_id string, sequence bigint, created bigint, state string, next_attempt bigint, claim_expires bigint, last_delivery bigint"


def jobs(spark, rows):
    return spark.createDataFrame([(i, s, q, c, st, None, None, d) for i, s, q, c, st, d in rows], JOBS)


def stamped(rows, ids, now):
    return [(i, s, q, c, st, now if i in ids else d) for i, s, q, c, st, d in rows]


def reserved(spark, rows, now, total, per_session, cooldown):
    return [r.utterance_id for r in reserve(jobs(spark, rows), now, Limits(total, per_session, cooldown)).collect()]


def test_admission(spark):
    rows = [(k, "a", k, 0, "pending", None) for k in range(8)]
    first = reserved(spark, rows, 100, 32, 2, 60)
    assert first == [0, 1]
    rows = [*stamped(rows, first, 100), (50, "b", 1, 100, "pending", None)]
    assert reserved(spark, rows, 101, 32, 2, 60) == [50]
    assert reserved(spark, rows, 101, 2, 2, 60) == []  # what is outstanding fills the class


def test_newcomers_do_not_starve_a_session(spark):
    rows = [(1, "a", 1, 0, "succeeded", 100), (2, "a", 2, 0, "pending", None), (3, "new", 1, 101, "pending", None)]
    assert reserved(spark, rows, 300, 1, 1, 60) == [2]


def test_sessions_take_turns(spark):
    rows = [(10 * s + k, f"s{s}", k, s, "pending", None) for s in range(4) for k in range(2)]
    one = reserved(spark, rows, 100, 2, 1, 10)
    done = [(i, s, q, c, "succeeded" if i in one else st, d) for i, s, q, c, st, d in stamped(rows, one, 100)]
    two = reserved(spark, done, 101, 2, 1, 10)
    assert {i // 10 for i in one} == {0, 1} and {i // 10 for i in two} == {2, 3}


def test_claims_take_what_was_delivered_first(spark):
    rows = [(1, "b", 2, 5, "pending", 95), (2, "a", 1, 7, "pending", 95), (3, "b", 1, 5, "pending", 95), (4, "c", 1, 1, "pending", 99), (5, "d", 1, 0, "pending", None)]
    assert [r.utterance_id for r in claim_next(jobs(spark, rows), 100, 10).collect()] == [3]
    assert claim_next(jobs(spark, rows), 200, 10).count() == 0


def test_backoff(spark):
    df = spark.range(0, 5).select(backoff(2.0, "id", 3.0).alias("stt"), backoff(5.0, "id").alias("media"))
    assert [tuple(r) for r in df.collect()] == [(2, 5), (2, 5), (3, 10), (3, 20), (3, 40)]


def test_coverage(spark):
    sessions = spark.createDataFrame([("full", 2), ("partial", 3), ("empty", 0), ("long", 1000)], "session_id string, final_sequence bigint")
    chunks = spark.createDataFrame([("full", 1), ("full", 2), ("partial", 1), *(("long", k) for k in range(1, 1001) if k % 100)], "session_id string, sequence bigint")
    gaps = spark.createDataFrame([("partial", 2, 9), ("long", 900, 5000)], "session_id string, lo bigint, hi bigint")
    got = {r.session_id: r.audio_completeness for r in coverage.completeness(chunks, gaps, sessions).collect()}
    assert got == {"full": "full", "partial": "partial", "empty": "empty", "long": "partial"}
    assert sorted((r.lo, r.hi) for r in coverage.missing(chunks, gaps, sessions).collect()) == [(k, k) for k in range(100, 900, 100)]


def test_versions(spark):
    order = ["v1.0.0-alpha", "v1.0.0-alpha.1", "v1.0.0-alpha.2", "v1.0.0-alpha.10", "v1.0.0-alpha.beta", "v1.0.0-alpha.beta.1", "v1.0.0-beta.2", "v1.0.0-rc.1", "v1.0.0", "v1.0.1-alpha", "v1.2.0", "v1.10.0", "v2.0.0-rc.1"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string").withColumn("key", versions.order_key(F.col("v")))
    assert [r.v for r in df.orderBy("key").collect()] == order
    forms = {"v1.2.3": "stable", "v1.2.3-alpha": "alpha", "v1.2.3-beta.1": "beta", "v1.2.3-rc.1": "beta", "v1.2": None, "1.2.3": None, "v1.2.3-alpha_1": None, "v1.2.3-x": None}
    got = spark.createDataFrame([(v,) for v in forms], "v string").select("v", versions.channel(F.col("v")).alias("c"))
    assert {r.v: r.c for r in got.collect()} == forms


def test_byte_labels(spark):
    cases = {0: ("1 KB", "0 KB"), 1536: ("2 KB", "2 KB"), (1 << 20) + (1 << 19): ("1.5 MB", "2 MB"), 5 << 30: ("5.0 GB", "5.0 GB"), None: (None, "unknown")}
    df = spark.createDataFrame([(n,) for n in cases], "n bigint").select("n", formats.bytes_label("n", False).alias("a"), formats.bytes_label("n", True).alias("b"))
    assert {r.n: (r.a, r.b) for r in df.collect()} == cases


@pytest.mark.parametrize("sample", [3, 100])
def test_content_evidence(spark, sample):
    data = [b"", b"ab", b"abc", bytes(range(10))]
    got = {bytes(r.b): r.e for r in spark.createDataFrame([(d,) for d in data], "b binary").select("b", formats.content_evidence(F.col("b"), sample).alias("e")).collect()}
    assert got == {d: hashlib.sha256(len(d).to_bytes(8, "big") + d[:sample] + d[max(0, len(d) - sample) :]).hexdigest() for d in data}


def test_objects(spark):
    found = spark.createDataFrame([("a/1", b"xy", 2), ("../up", b"", 0)], "key string, content binary, length bigint")
    digest = hashlib.sha256(b"xy").hexdigest()
    rows = [("a/1", digest, 2), ("a/1", digest, 3), ("a/1", "0", 2), ("a/2", digest, 2), ("../up", "", 0), ("/a/1", digest, 2), ("a\\..\\1", digest, 2), (None, digest, 2)]
    got = [r.outcome for r in verify(spark.createDataFrame(rows, "key string, sha256 string, byte_length bigint").coalesce(1).withColumn("n", F.monotonically_increasing_id()), found).orderBy("n").collect()]
    assert got == ["verified", "length", "sha256", "missing", "key", "key", "key", "key"]
    assert spark.createDataFrame([(b"RIFF",), (b"",), (None,)], "b binary").where(wav_format(F.col("b"))).count() == 0


def test_stream_equals_batch(spark):
    got, want = ({tuple(r) for r in entry.queries()[name](spark, SMALL).collect()} for name in ("vad_stream", "vad_endpoint"))
    assert got == want and all(len(list(own)) for _, own in itertools.groupby(sorted(want), lambda r: r[0]))


def test_replay(spark):
    cases = {
        "a": (["retry", "retry", "succeeded", "permanent"], ("succeeded", 3)),
        "b": (["retry"] * 9, ("failed", 3)),
        "c": (["retry", "permanent"], ("failed", 2)),
        "d": (["no_speech", "retry"], ("no_speech", 1)),
        "e": (["retry"], ("retry_wait", 1)),
        "f": (["retry", "waiting_stt"], ("waiting_stt", 2)),
    }
    rows = [(key, at, outcome) for key, (own, _) in cases.items() for at, outcome in enumerate(own)]
    got = {r.key: (r.state, r.attempts) for r in replay(spark.createDataFrame(rows, "key string, at bigint, outcome string"), 3).collect()}
    assert got == {key: want for key, (_, want) in cases.items()}


def snapshot(spark, **changed):
    base = {"session_id": "s", "phase": "recording", "fenced": False, "write_failed": False, "n_missing": 0, "n_pending": 0, "online": True, "persisted": True, "realtime": "live", "realtime_error": None, "n_gaps": 0, "acknowledged": 3, "message": "m"} | changed
    kinds = "session_id string, phase string, fenced boolean, write_failed boolean, n_missing int, n_pending int, online boolean, persisted boolean, realtime string, realtime_error string, n_gaps int, acknowledged int, message string"
    row = spark.createDataFrame([tuple(base.values())], kinds)
    return row.select(*(c.alias(n) for n, c in rules.recorder_labels().items())).first()


def test_recorder_labels_by_priority(spark):
    assert snapshot(spark)[:6] == ("recording/positive", "Audio synced/positive", "Transcribing/positive", "stop", "", "")
    lost = snapshot(spark, phase="recoverable", n_missing=1, n_pending=2, write_failed=True, realtime="degraded")
    assert lost[:6] == ("Needs recovery/warning", "Unsafe audio storage/danger", "Transcription delayed/warning", "finish-recovered", "sync", "declare-missing-gaps")
    shut = snapshot(spark, fenced=True, n_pending=1, n_missing=1)
    assert shut[:6] == ("Needs attention/warning", "Orphaned local evidence — action blocked/danger", "Transcribing/positive", None, "", "")
    assert snapshot(spark, n_pending=1, online=False, persisted=None).audio == "Audio saved locally/danger"
    empty = snapshot(spark, phase="complete", acknowledged=0, realtime="off", session_id=None)
    assert empty[1:3] == ("Audio ready/neutral", "Not started/neutral") and empty.message.startswith("Recording finalized with no")
    assert snapshot(spark, phase="complete", acknowledged=0, n_gaps=1).message == "m"


def test_local_fence_and_pending_claim(spark):
    kinds = "epoch int, writer string, pending_writer string, recovery_token string, last_sequence int, last_end_ms int, server_state string, server_epoch int, server_writer string, final_sequence int, final_end_ms int"
    cases = [
        ((1, "w", None, "t", 4, 9, "complete", 1, None, 4, 9), ("matching_completion", "none")),
        ((1, "w", None, "t", 4, 9, "complete", 1, None, None, 9), ("fenced", "none")),
        ((1, "w", "p", "t", 4, 9, "recording", 2, "p", None, None), ("advanced", "adopt")),
        ((1, "w", "p", None, 4, 9, "recording", 2, "p", None, None), ("advanced", "no_capability")),
        ((1, "w", "p", "t", 4, 9, "finalizing", 1, "w", None, None), ("open", "drop")),
        ((1, "w", "p", "t", 4, 9, "recording", 1, None, None, None), ("open", "conflict")),
        ((1, "w", "p", "t", 4, 9, "recording", 3, "p", None, None), ("fenced", "conflict")),
        ((1, "w", "", "t", 4, 9, "recording", 1, "x", None, None), ("fenced", "none")),
    ]
    for row, want in cases:
        assert tuple(spark.createDataFrame([row], kinds).select(rules.local_fence(), rules.pending_claim()).first()) == want


def test_chunk_and_utterance_outcomes(spark):
    digest = hashlib.sha256(b"ab").hexdigest()
    kinds = "start_ms int, end_ms int, payload binary, declared_sha256 string, writer_id string, epoch int, active_writer string, active_epoch int, state string, sequence int, final_sequence int"
    good = (0, 0, b"ab", digest.upper(), "w", 1, "w", 1, "finalizing", 3, 3)
    for at, value, want in [(0, 0, "accepted"), (1, -1, "time"), (2, b"", "empty"), (2, None, "empty"), (2, b"abcd", "too_large"), (3, None, "digest"), (6, None, "fenced"), (7, 2, "fenced"), (8, "failed", "closed"), (8, None, "closed"), (9, 4, "beyond_boundary"), (10, None, "accepted")]:
        row = (*good[:at], value, *good[at + 1 :])
        assert spark.createDataFrame([row], kinds).select(rules.chunk_outcome(3)).first()[0] == want
    rows = [(" k\n", "T", 0, 1, b"x", "accepted"), (" ", "t", 0, 1, b"x", "blank_key"), ("k" * 161, "t", 0, 1, b"x", "long_key"), ("k", "t", None, 1, b"x", "time"), ("k", None, 0, 1, b"x", "blank_type"), ("k", "t", 0, 1, None, "payload")]
    for key, kind, start, end, payload, want in rows:
        df = spark.createDataFrame([(key, kind, start, end, payload)], "producer_key string, content_type string, start_ms int, end_ms int, payload binary")
        assert df.select(rules.utterance_outcome(rules.strip("producer_key"), F.lower(rules.strip("content_type")))).first()[0] == want


def test_packets(spark):
    good = (7).to_bytes(8, "little") + (1234).to_bytes(2, "little") + (-2).to_bytes(2, "little", signed=True)
    rows = [good, good[:8], good + b"x", b"\0" * 7 + b"\x80" + b"ab", None, good + b"1234"]
    df = spark.createDataFrame([(r,) for r in rows], "p binary")
    assert [r[0] for r in df.select(formats.packet_fault("p", 14)).collect()] == [None, "short", "odd", "offset", "short", "oversize"]
    assert tuple(df.limit(1).select(formats.packet_offset("p"), formats.packet_samples("p")).first()) == (7, [1234, -2])


def test_a_provider_fails_by_rows(spark):
    def provider(payload, content_type):
        if payload == b"!":
            raise ProviderError(None)
        if payload.isdigit():
            raise ProviderError(int(payload))
        return payload.decode(), content_type

    work = spark.createDataFrame([(k, p, "t") for k, p in enumerate([b"a ", b" ", b"!", b"429", b"401", b"400", b"503", None])], "utterance_id bigint, payload binary, content_type string")
    got = {r.utterance_id: (r.text, r.outcome, r.category) for r in transcribe(work.repartition(3), provider).collect()}
    assert got[0] == ("a", "succeeded", None) and got[1] == (None, "no_speech", None)
    assert [got[k][1:] for k in range(2, 8)] == [("retry", "transient"), ("retry", "rate_limited"), ("failed", "configuration"), ("failed", "permanent"), ("retry", "transient"), ("failed", "permanent")]
    assert transcribe(work.limit(0), provider).count() == 0
