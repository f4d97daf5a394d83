import hashlib
import json
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelspark.operators.admission import ready
from reelspark.plans.audio import wav
from reelspark.plans.stored import with_chunk
from reelspark.sources import layout, objects
from reelspark.sources.blobs import blobs, wav_frames
from reelspark.sources.media import RangeReader, ranged_frames
from reelspark.sources.publish import opened, publish
from reelspark.sources.snapshots import Conflict, VersionedTable, forward
from reelspark.streaming.notices import follow, reopened

ROWS = "id bigint, state string, last bigint"


def stored(spark, tmp_path, rows, **more):
    table = VersionedTable(spark, f"file://{tmp_path}/t", ROWS, ["id"], **more)
    assert table.latest() == -1 and table.read().count() == 0
    assert table.commit(-1, spark.createDataFrame(rows, ROWS)) == 0
    return table


def test_of_two_writers_on_one_version_one_wins(spark, tmp_path):
    table = stored(spark, tmp_path, [(k, "pending", 100 if k == 3 else None) for k in range(20)])
    seen = table.read(0)
    first = seen.where("id < 12").withColumns({"state": F.lit("a"), "last": forward("last", F.lit(50))})
    assert table.commit(0, first) == 1
    files = sorted(p for p in (tmp_path / "t" / "data").iterdir())
    with pytest.raises(Conflict):
        table.commit(0, seen.where("id >= 8").withColumn("state", F.lit("b")))
    assert sorted(p for p in (tmp_path / "t" / "data").iterdir()) == files

    def again(now):
        return now.where("id >= 8 and state = 'pending'").withColumns({"state": F.lit("b"), "last": forward("last", F.lit(40))})

    assert table.update(again) == 2
    got = {r.id: (r.state, r["last"]) for r in table.read().collect()}
    assert got == {k: ("a", 100 if k == 3 else 50) if k < 12 else ("b", 40) for k in range(20)}
    assert {r.state for r in table.read(0).collect()} == {"pending"}


def test_update_that_meets_a_conflict_judges_anew(spark, tmp_path):
    table, calls = stored(spark, tmp_path, [(1, "pending", 9), (2, "pending", None)]), []

    def change(now):
        calls.append(table.latest())
        if len(calls) == 1:
            table.commit(0, now.where("id = 1").withColumns({"state": F.lit("done"), "last": forward("last", F.lit(20))}))
        return now.where("state = 'pending'").withColumns({"state": F.lit("late"), "last": forward("last", F.lit(5))})

    assert table.update(change) == 2 and calls == [0, 1]
    assert sorted(map(tuple, table.read().collect())) == [(1, "done", 20), (2, "late", 5)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = stored(spark, tmp_path, [(k, "x", k) for k in range(200)], buckets=8)
    before, after = table._parts(0), table._parts(table.commit(0, spark.createDataFrame([(7, "y", 1)], ROWS)))
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert table.read().count() == 200 and table.read().where("id = 7").first().state == "y"


def test_odd_rows_of_a_versioned_table(spark, tmp_path):
    table = stored(spark, tmp_path, [(None, "a", 1), (1, None, None)])
    with pytest.raises(ValueError, match="repeat"):
        table.commit(0, spark.createDataFrame([(None, "b", 1), (None, "c", 1)], ROWS))
    assert table.commit(0, spark.createDataFrame([], ROWS)) == 0
    assert table.insert_missing(spark.createDataFrame([(None, "z", 1), (2, "n", 2)], ROWS)) == 1
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted([(None, "a", 1), (1, None, None), (2, "n", 2)], key=repr)
    other = spark.createDataFrame([("more", 3, "s", 4)], "_bucket string, id bigint, state string, last bigint")
    table.update(lambda now: other)
    assert table.read().columns == ["id", "state", "last"] and table.read().count() == 4


def test_a_name_is_taken_once(tmp_path):
    fs, root = opened(f"file://{tmp_path}")
    assert publish(fs, f"{root}/v/1", b"a") and not publish(fs, f"{root}/v/1", b"b")
    assert [p.name for p in (tmp_path / "v").iterdir()] == ["1"] and (tmp_path / "v" / "1").read_bytes() == b"a"


def files(folder):
    return [p for p in folder.rglob("*") if p.is_file()] if folder.exists() else []


def test_a_repeated_task_leaves_one_object(spark, tmp_path):
    folder = f"file://{tmp_path}/o"
    batch = pa.RecordBatch.from_pydict({"key": ["k", None, "n", "k"], "content": [b"sound", b"x", None, b"later"]}, schema=pa.schema([("key", pa.string()), ("content", pa.binary())]))
    writer = objects.ObjectWriter(folder)
    lost, counted = writer.write(iter([batch])), writer.write(iter([batch]))
    assert objects.winners(spark, folder).count() == 0
    writer.commit([counted, None])
    assert [tuple(r) for r in objects.winners(spark, folder).collect()] == [("k", hashlib.sha256(b"sound").hexdigest(), 5)]
    assert len(files(tmp_path / "o" / "objects")) == 2 and [p.name for p in files(tmp_path / "o" / "index")] == [counted.name] != [lost.name]
    assert objects.sweep(spark, folder) == 1 and len(files(tmp_path / "o" / "objects")) == 1


def test_an_aborted_job_is_not_seen_and_the_first_commit_wins(spark, tmp_path):
    folder = f"file://{tmp_path}/o"
    rows = spark.createDataFrame([("a", b"1"), ("b", b"2")], "key string, content binary")
    broken = rows.withColumn("content", F.when(F.col("key") == "b", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        objects.put(broken, folder)
    assert objects.winners(spark, folder).count() == 0 and not files(tmp_path / "o" / "index")
    objects.put(rows.where("key = 'a'"), folder)
    objects.put(spark.createDataFrame([("a", b"9"), ("c", b"3")], "key string, content binary"), folder)
    objects.put(rows.limit(0), folder)
    got = {r.key: (bytes(r.content), r.sound) for r in objects.fetch(spark, folder).collect()}
    assert got == {"a": (b"1", True), "c": (b"3", True)}
    own = objects.winners(spark, folder).where("key = 'a'").first().sha256
    (tmp_path / "o" / objects.object_path(own)).write_bytes(b"8")
    assert {r.key: r.sound for r in objects.fetch(spark, folder).collect()} == {"a": False, "c": True}
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame([("a", b"1")], "key string, content binary").write.format("first_objects").mode("overwrite").save(folder)


def sound(n):
    return struct.pack(f"<{n}h", *((k * 7919) % 60_000 - 30_000 for k in range(n)))


def test_a_file_in_ranges_has_the_frames_of_the_whole(spark, tmp_path):
    (tmp_path / "m" / "sub").mkdir(parents=True)
    whole = wav(sound(320 * 40 + 17))
    (tmp_path / "m" / "sub" / "a.wav").write_bytes(whole)
    want = sorted((r.key, r.frame_no, r.samples, bytes(r.content)) for r in wav_frames(blobs(spark, f"file://{tmp_path}/m")).select("key", "frame_no", "samples", "content").collect())
    split = -(-len(whole) // 8)
    assert len(RangeReader(f"file://{tmp_path}/m", split).partitions()) == 8
    for size in (split, 641, 1 << 20):
        got = ranged_frames(spark, f"file://{tmp_path}/m", size)
        assert sorted((r.key, r.frame_no, r.samples, bytes(r.content)) for r in got.collect()) == want and len(want) == 41


def test_chunks_truncation_and_other_files(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    assert ranged_frames(spark, f"file://{folder}").count() == 0
    data = sound(700)
    cases = {"more.wav": with_chunk(wav(data)), "cut.wav": wav(data)[:-3], "none.wav": wav(b""), "odd.wav": wav(data, 8000), "head.wav": wav(data)[:20], "text.wav": b"words", "empty.wav": b""}
    for name, content in cases.items():
        (folder / name).write_bytes(content)
    got = {}
    for r in sorted(ranged_frames(spark, f"file://{folder}", 500).collect(), key=lambda r: r.frame_no):
        got[r.key] = got.get(r.key, b"") + bytes(r.content)
    assert got == {"more.wav": data, "cut.wav": data[:-4]}


def test_tasks_and_batches_do_not_follow_small_ranges(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for k in range(60):
        (tmp_path / "m" / f"{k:02d}.wav").write_bytes(wav(sound(320 * 17 + k)))
    reader = RangeReader(f"file://{tmp_path}/m", 100)
    dealt = reader.partitions()
    assert 200 <= len(dealt) <= 300 and sum(hi - lo for p in dealt for _, _, lo, hi in p.pieces) == sum(p.stat().st_size for p in files(tmp_path / "m"))
    assert sum(sum(1 for _ in reader.read(p)) for p in dealt) <= len(dealt)
    want = {(r.key, r.frame_no, bytes(r.content)) for r in wav_frames(blobs(spark, f"file://{tmp_path}/m")).collect()}
    got = [(r.key, r.frame_no, bytes(r.content)) for r in ranged_frames(spark, f"file://{tmp_path}/m", 100).collect()]
    assert len(got) == len(want) == 60 * 17 + 59 and set(got) == want


@pytest.mark.parametrize("batches", [1, 4])
def test_no_duplicate_and_no_hole_after_lost_notices(spark, batches):
    rng = random.Random(batches)
    rows = [(s, k) for s in (1, 2, 3, 4) for k in range(1, 30)]
    kept = [(s, k) for s, k in rows if s < 4 and rng.random() < 0.5]
    notices = [(s, k, 1_700_000_000 + k) for s, k in kept for _ in range(rng.choice([1, 1, 3]))] + [(None, 5, 1_700_000_005), (2, None, 1_700_000_005), (3, 0, None), (9, 1, 1_700_000_001)]
    table = spark.createDataFrame(rows, "session_id bigint, sequence bigint")
    sent = spark.createDataFrame(notices, "session_id bigint, sequence bigint, s bigint").selectExpr("*", "timestamp_seconds(s) as ts")
    width = 30 // batches + 1
    found, cursors = follow(spark, [sent.where(f"coalesce(sequence, 0) div {width} = {k}") for k in range(batches)], table)
    got = sorted(map(tuple, found.unionByName(reopened(table, cursors)).collect()))
    tops = {s: max((k for t, k in kept if t == s), default=0) for s in (1, 2, 3, 4)}
    assert got == sorted((s, k, "notice" if (s, k) in kept else "caught_up" if k < tops[s] else "reopened") for s, k in rows)


def test_a_follower_without_notices(spark):
    table = spark.createDataFrame([(1, 1)], "session_id bigint, sequence bigint")
    found, cursors = follow(spark, [], table)
    assert found.count() == 0 and [tuple(r) for r in reopened(table, cursors).collect()] == [(1, 1, "reopened")]


SEGMENTS = "session_id bigint, sequence bigint, start_ms bigint, end_ms bigint, text string, language string"


def long_transcript(spark, n=505, sessions=(7,)):
    rows = [(s, k, 1000 * (n - k) // 2 * 2, 1000 * (n - k) // 2 * 2 + 900, f"line {k}\r\nmore" if k % 50 else None, "de" if k % 2 else None) for s in sessions for k in range(1, n + 1)]
    return spark.createDataFrame(rows, SEGMENTS), sorted(rows, key=lambda r: (r[0], r[2], r[3], r[1]))


def scans(df):
    """The Parquet scans of an executed plan."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return [leaves.apply(k) for k in range(leaves.size())]


def test_pages_of_a_long_transcript(spark, tmp_path):
    segments, rows = long_transcript(spark, sessions=range(20))
    layout.write_clustered(segments, f"file://{tmp_path}/p", 4096)
    folder, own = f"file://{tmp_path}/p", [r for r in rows if r[0] == 7]
    first = layout.page(spark, folder, 7, 200)
    plan = first._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(session_id,7)" in plan
    got, anchor = first.collect(), None
    assert len(got) == 201
    read = []
    while True:
        part = layout.page(spark, folder, 7, 200, anchor).collect()
        read += [r.sequence for r in part[:200]]
        if len(part) <= 200:
            break
        anchor = part[199].sequence
    assert read == [r[1] for r in own]
    assert layout.page(spark, folder, 7, 200, 9999) is None and layout.page(spark, folder, 99, 200).count() == 0
    scan = spark.read.parquet(folder).where("session_id = 7")
    scan.collect()
    own_rows = [int(str(m.value())) for m in (node.metrics().get("numOutputRows").get() for node in scans(scan))]
    assert 505 <= sum(own_rows) < 20 * 505 / 4
    pages = {(r.page, r.rows, r.anchor, r.has_more) for r in layout.pages(segments.where("session_id = 7"), 200).collect()}
    assert pages == {(0, 200, own[199][1], True), (1, 200, own[399][1], True), (2, 105, own[504][1], False)}


def document(rows, form, session=7):
    clean = [(n, r[1], r[2], r[3], (r[4] or "").replace("\r\n", "\n"), r[4], r[5]) for n, r in enumerate(rows, 1)]
    t = lambda ms, sep: f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d}{sep}{ms % 1000:03d}"
    if form == "json":
        return json.dumps({"session_id": session, "segments": [{"sequence": q, "start_ms": s, "end_ms": e, "text": raw, "language": lang} for _, q, s, e, _, raw, lang in clean]}, separators=(",", ":"), ensure_ascii=False) + "\n"
    lines = {"txt": lambda n, s, e, x: f"{x}\n", "vtt": lambda n, s, e, x: f"{t(s, '.')} --> {t(e, '.')}\n{x}\n\n", "srt": lambda n, s, e, x: f"{n}\n{t(s, ',')} --> {t(e, ',')}\n{x}\n\n"}
    return ("WEBVTT\n\n" if form == "vtt" else "") + "".join(lines[form](n, s, e, x) for n, _, s, e, x, _, _ in clean)


@pytest.mark.parametrize("form", ["txt", "vtt", "srt", "json"])
def test_export_in_parts(spark, tmp_path, form):
    segments, rows = long_transcript(spark)
    sessions = spark.createDataFrame([(7,), (8,), (None,)], "session_id bigint")
    parts = layout.write_export(segments, sessions, form, f"file://{tmp_path}/e", 4)
    own = sorted((r.block, r.path) for r in parts.where("session_id = 7").collect())
    assert len(own) >= 3
    assert "".join((tmp_path / "e" / p).read_text() for _, p in own) == document(rows, form)
    assert (tmp_path / "e" / parts.where("session_id = 8").first().path).read_text() == document([], form, 8)
    got = {r.session_id: (r.byte_length, r.sha256) for r in layout.digests(parts, f"file://{tmp_path}/e").collect()}
    texts = {7: document(rows, form).encode(), 8: document([], form, 8).encode()}
    assert got == {s: (len(x), hashlib.sha256(x).hexdigest()) for s, x in texts.items()}


def test_a_stamp_never_goes_back(spark):
    jobs = spark.createDataFrame([("pending", 50), ("pending", None), ("claimed", 10)], "state string, last_delivery bigint").withColumns({"next_attempt": F.lit(None).cast("bigint"), "claim_expires": F.lit(60).cast("bigint")})
    got = ready(jobs, 70, 15).where("eligible").select(forward("last_delivery", F.lit(40)).alias("x")).collect()
    assert sorted(r.x for r in got) == [40, 40, 50]


@pytest.mark.parametrize("form", ["txt", "vtt", "srt", "json"])
def test_export_has_as_many_files_as_blocks(spark, tmp_path, form):
    segments, rows = long_transcript(spark, 20, range(59))
    sessions = spark.range(240).selectExpr("id as session_id")
    folder, own = f"file://{tmp_path}/e", {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        parts = layout.write_export(segments, sessions, form, folder, 4)
        got = {r.session_id: (r.byte_length, r.sha256) for r in layout.digests(parts, folder).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in range(240):
        own[s] = document(rows[20 * s : 20 * (s + 1)], form, s).encode() if s < 59 else document([], form, s).encode()
    assert got == {s: (len(x), hashlib.sha256(x).hexdigest()) for s, x in own.items()}
    assert len(files(tmp_path / "e")) <= 8
    read = {}
    for p in sorted(parts.collect(), key=lambda p: (p.session_id, p.block)):
        data = (tmp_path / "e" / p.path).read_bytes()[p.offset : p.offset + p.byte_length]
        assert not p.whole or data == own[p.session_id]
        read[p.session_id] = read.get(p.session_id, b"") + data
    assert read == own and any(not p.whole for p in parts.collect())
