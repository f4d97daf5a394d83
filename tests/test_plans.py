import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reelspark.operators.endpoint import Detector, Settings, dbfs, segments
from reelspark.sources.adapters import TABLES, Views
from reelspark.streaming.sessions import heartbeat_sessions
from tests.conftest import SMALL

OWN = [q for b in entry._BOOKS for q in b.queries]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def plain(rows):
    return sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    sql = entry.oracle_sql().get(name)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if sql:
        want = duck.execute(f"select {', '.join(columns)} from ({sql}) q").fetchall()
        assert plain(rows) == plain(want)


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("session_chunks", "select count(*) from lineitem"),
        ("session_gaps", "select count(*) from orders where o_orderkey % 2 = 0"),
        ("jobs_recent_failures", "select sum(least(n, 10)) from (select count(*) n from v_jobs where last_error_category is not null group by session_id) q"),
        ("pcm_decode", "select count(*) from lineitem where l_linenumber <> 3"),
        ("heartbeat_stream", "select count(*) from (select ts > lag(ts) over (partition by user_id order by ts) + interval 6 hour as apart from events) q where apart or apart is null"),
    ],
)
def test_query_returns_the_whole_table(spark, duck, name, want):
    if "v_jobs" in want:
        want = entry.oracle_sql()["jobs_history"].split("SELECT session_id, CAST(max")[0] + want
    assert entry.queries()[name](spark, SMALL).count() == duck.execute(want).fetchone()[0]


def test_stream_closes_all_sessions(spark, tmp_path):
    times = ["2024-01-01 00:00:00", "2024-01-01 06:00:00", "2024-01-01 12:00:01", "2024-01-03 00:00:00"]
    rows = [(k, t, u) for u in (1, 2, None) for k, t in enumerate(times)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id")
    events.repartition(3).write.parquet(f"{tmp_path}/a/events.parquet")
    events.limit(0).write.parquet(f"{tmp_path}/b/events.parquet")
    got = [(r.user_id, r.beats) for r in heartbeat_sessions(spark, f"{tmp_path}/a").collect()]
    window = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "6 hours")).count().collect()
    assert sorted(got, key=repr) == sorted(((r.user_id, r["count"]) for r in window), key=repr)
    assert sum(n for _, n in got) == len(rows) and heartbeat_sessions(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.parametrize("name", ["capture_epoch_fence", "job_replay", "noise_floor", "vad_endpoint"])
def test_no_task_holds_a_whole_session(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "FlatMapGroupsIn" not in plan


@pytest.mark.parametrize("size", [1, 7])
def test_state_is_carried_over_batches(spark, duck, size):
    rows = [(s, n, n * 320, 320, float(-90 + (n * 37 + s * 11 + n // 9 * 50) % 100)) for s in (1, 2) for n in range(300)]
    want = []
    for stream in (1, 2):
        detector = Detector(Settings(pre_roll=40, min_voiced=40, silence=60, hard_max=2000))
        for _, _, *frame in rows[300 * (stream - 1) : 300 * stream]:
            detector.frame(*frame)
        detector.finish(300 * 320)
        want += [(stream, k + 1, *x) for k, x in enumerate(detector.out)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        frames = spark.createDataFrame(rows[::-1], "stream_id bigint, frame_no bigint, sample_offset bigint, size bigint, level double")
        got = segments(frames, Settings(pre_roll=40, min_voiced=40, silence=60, hard_max=2000)).collect()
        assert len(want) > 4 and sorted(map(tuple, got)) == want
        for name in ("capture_epoch_fence", "noise_floor"):
            test_query_equals_its_oracle(spark, duck, name)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_labels_of_duration_and_progress(spark):
    ends = {(r.session_id, r.sequence): r.end_ms // 1000 for r in Views(spark, SMALL).v_segments.collect()}
    got = {(r.session_id, r.sequence): r.label for r in entry.queries()["duration_label"](spark, SMALL).collect()}
    assert got == {k: f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}" for k, s in ends.items()}
    assert max(r.percent for r in entry.queries()["upload_progress_max"](spark, SMALL).collect()) == 99


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def run(settings, levels, offsets=None):
    detector, end = Detector(settings), 0
    for k, level in enumerate(levels):
        at = offsets[k] if offsets else k * 160
        if at != end:
            detector.reset()
        detector.frame(at, 160, level)
        end = at + 160
    detector.finish(end)
    return detector.out


LOUD, QUIET = -9.0, -120.0


def test_detector_keeps_pre_roll():
    s = Settings(rate=8000, pre_roll=40, min_voiced=40, silence=60, hard_max=500, absolute=-45)
    assert run(s, [QUIET] * 2 + [LOUD] * 3 + [QUIET] * 3) == [(0, 1280, 480)]


def test_detector_drops_what_is_too_short():
    assert run(Settings(rate=8000, pre_roll=40, min_voiced=80, silence=40, absolute=-45), [QUIET, LOUD, QUIET, QUIET]) == []


def test_detector_cuts_at_the_hard_maximum():
    s = Settings(rate=8000, pre_roll=0, min_voiced=40, silence=60, hard_max=100, absolute=-45)
    assert [x[:2] for x in run(s, [LOUD] * 10)] == [(0, 800), (800, 1600)]


def test_detector_resets_at_a_jump():
    s = Settings(rate=8000, pre_roll=0, min_voiced=20, silence=40, absolute=-45)
    assert run(s, [LOUD, QUIET, QUIET], [0, 10000, 10160]) == []


def test_level_of_silence(spark):
    assert spark.sql("select array(0, 0, 0) as samples").select(dbfs().alias("x")).first().x == -120
