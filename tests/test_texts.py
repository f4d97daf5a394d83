from pyspark.sql import functions as F

from reelspark.functions import rules

SPACES = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\x85", "\xa0", " ", " ", " ", " ", " ", " ", " ", "　"]
OTHERS = ["​", "\x00", "﻿", "᠎", "x", "é"]


def test_white_space_is_that_of_unicode(spark):
    texts = [f"{a}one{a}{b}two{b}{a}" for a in SPACES + OTHERS for b in (" ", "\n", " ", "\x1f")] + ["", " ", "\x1c　\n", "a\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.strip("t").alias("s"), rules.one_spaced("t").alias("w")).collect()
    assert [(r.t, r.s, r.w) for r in rows] == [(t, t.strip(), " ".join(t.split())) for t in texts]


def test_segment_outcomes(spark):
    cases = [("\t k", 0, 1, " a\n", " DE ", "accepted"), (" ", 0, 1, "a", None, "producer_key_blank"), (None, 0, 1, "a", None, "producer_key_blank"), ("k" * 160 + " ", 0, 1, "a", None, "accepted"), ("k" * 161, 0, 1, "a", None, "producer_key_length"), ("k", 1, 1, "a", None, "time"), ("k", -1, 1, "a", None, "time"), ("k", 0, 1, "\t\x1c", None, "text"), ("k", 0, 1, None, None, "text"), ("k", 0, 1, "a", "x" * 33, "language"), ("k", 0, 1, "a", " " * 40, "accepted")]
    df = spark.createDataFrame(cases, "producer_key string, start_ms bigint, end_ms bigint, text string, language string, want string")
    assert [r.want for r in df.withColumn("got", rules.segment_outcome()).where(~F.col("got").eqNullSafe(F.col("want"))).collect()] == []


def test_gap_outcomes(spark):
    cases = [(None, None, None, None, "nothing"), (1, None, None, None, "range"), (2, 1, None, None, "range"), (1, 1, None, None, "accepted"), (1, 2, 5, None, "wall"), (1, 2, 5, 4, "wall"), (None, None, 5, 5, "accepted"), (None, None, None, 5, "wall"), (None, 3, 1, 2, "range")]
    df = spark.createDataFrame(cases, "lo bigint, hi bigint, wall_from bigint, wall_to bigint, want string")
    assert [r.want for r in df.withColumn("got", rules.gap_outcome()).where("got <> want").collect()] == []
