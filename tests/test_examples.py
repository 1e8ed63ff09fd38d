"""Examples that quote recordings, inputs of two runs, codes of decoded texts, times as text."""

import datetime

from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators import ordered, rules


def test_quoted(spark):
    recordings = spark.createDataFrame([(1, "the whole text"), (2, None)], "recording_id long, text string")
    parts = spark.createDataFrame([(1, 0.0, "the whole"), (1, 30.0, "b later"), (1, 30.0, "a first"), (2, 0.0, "x"), (3, 0.0, "x")], "recording_id long, start double, text string")
    rows = [(1, 0.0, "whole text", "whole", "quoted"), (1, 30.0, "the", "first", "quoted"), (1, 30.0, "the", "later", "stale_other"), (1, 15.0, "the", "whole", "no_part"), (1, 0.0, "other", "nor", "stale_original"),
            (1, 0.0, "the", None, "stale_other"), (2, 0.0, "x", "x", "stale_original"), (3, 0.0, "x", "x", "no_recording"), (None, 0.0, "x", "x", "no_recording")]
    examples = spark.createDataFrame(rows, "recording_id long, start double, original string, other string, want string")
    got = rules.quoted(examples, recordings, parts)
    assert got.count() == len(rows) and got.where("NOT outcome <=> want").count() == 0


def test_mismatched_inputs(spark):
    left = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "c", 3), (5, "e", 5)], "k long, hash string, n int")
    right = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "x", None), (4, "d", 4)], "k long, hash string, n int")
    assert sorted(map(tuple, rules.mismatched_inputs(left, right, "k", ["hash", "n"]).collect())) == [(3, ["hash", "n"]), (4, ["missing"]), (5, ["missing"])]
    assert rules.mismatched_inputs(left, left, "k", ["hash", "n"]).count() == 0


def test_decode_issues(spark):
    df = spark.createDataFrame([(9, None), (10, True), (11, False)], "n int, r boolean")
    assert [r[0] for r in df.select(rules.decode_issues(F.col("n"), 10, F.col("r"))).collect()] == [[], ["generation_token_limit", "consecutive_repetition"], ["generation_token_limit"]]


def test_stamps_sort_as_times(spark):
    times = [datetime.datetime(y, 3, 9, 4, 5, 6, ms * 1000, tzinfo=datetime.timezone.utc) for y in (1999, 2024) for ms in (0, 7, 70, 700)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t timestamp").orderBy("t").select(text.stamp(F.col("t"))).collect()]
    assert got == sorted(got) and got[1] == "1999-03-09T04:05:06.007Z"


def test_repeated_words_are_compared_themselves(spark):
    df = spark.createDataFrame([(1, ["a", "b"] * 5 + ["c"]), (2, ["a", "b", "c"]), (3, [])], "k long, words array<string>")
    got = [tuple(r) for r in ordered.repeated_grams(df, "k", copies=3).collect()]
    assert got == [(1, ["a", "b"], 5, 2, 0, 10)]
