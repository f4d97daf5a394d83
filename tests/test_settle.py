import random

import pytest

from reelspark.operators.endpoint import Detector, Endpoints, NoiseFloor, Settings, segments, speech_frames
from reelspark.operators.settle import settle

TIGHT = Settings(pre_roll=40, min_voiced=40, silence=60, hard_max=2000)
FRAMES = "stream_id bigint, frame_no bigint, sample_offset bigint, size bigint, level double"


def frames(seed, n, streams, jump=False):
    rng = random.Random(seed)
    return [(s, k, k * 320 + (9000 if jump and k > n // 2 else 0), 320, None if rng.random() < 0.001 and s else float(-90 + rng.randrange(20) + (60 if k // 40 % 3 == 1 else 0))) for s in streams for k in range(n)]


def plain(rows, settings):
    out = []
    for s in dict.fromkeys(r[0] for r in rows):
        detector, end = Detector(settings), None
        for _, _, offset, size, level in (r for r in rows if r[0] == s):
            if end is not None and offset != end:
                detector.reset()
            detector.frame(offset, size, float("nan") if level is None else level)
            end = offset + size
        detector.finish(end)
        out += [(s, k + 1, *x) for k, x in enumerate(detector.out)]
    return out


@pytest.mark.parametrize(("streams", "blocks", "jump"), [((1,), 6, False), ((1, None, 3), 5, True), (range(9), 3, False)])
def test_one_stream_over_many_tasks(spark, streams, blocks, jump):
    rows = frames(blocks, 1200, streams, jump)
    df = spark.createDataFrame(random.Random(0).sample(rows, len(rows)), FRAMES)
    want = plain(rows, TIGHT)
    assert sorted(map(tuple, segments(df, TIGHT, blocks, 50).collect()), key=repr) == sorted(want, key=repr) and len(want) > 4
    placed = settle(df.select("stream_id", "frame_no", "level"), ["frame_no"], NoiseFloor(TIGHT), blocks, 50)
    assert placed.select("_block").distinct().count() >= min(4, blocks)


def test_a_state_that_does_not_forget_is_right_too(spark):
    """All frames loud but few: the floor of the first block lasts, so that blocks settle one after the other."""
    rows = [(1, k, k * 320, 320, -75.0 if k < 5 else -20.0 if k % 50 else -52.0) for k in range(400)]
    settings = Settings(absolute=-70.0, margin=16.0, alpha=0.5)
    noise, want = settings.noise, 0
    for r in rows:
        if r[4] >= max(settings.absolute, noise + settings.margin):
            want += 1
        else:
            noise = settings.alpha * noise + (1 - settings.alpha) * r[4]
    got = speech_frames(spark.createDataFrame(rows, FRAMES), settings, 5, 10).collect()
    assert [tuple(r) for r in got] == [(1, want)]


def test_no_frames(spark):
    assert segments(spark.createDataFrame([], FRAMES), TIGHT).count() == 0


def test_state_as_text():
    fold = Endpoints(TIGHT)
    rows = [(k, k * 320, 320, -20.0 if k % 7 else None) for k in range(30)]
    half = fold.leave(iter(rows[:15]), fold.start())
    assert fold.leave(iter(rows[15:]), half) == fold.leave(iter(rows), fold.start())
