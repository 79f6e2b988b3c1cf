"""Column helpers on their own."""

from pyspark.sql import functions as F

from seatspark.functions.columns import (display_date, seats_or_full, sorted_ci,
                                         split_seat_text, without)
from seatspark.session import checkpoint_dir


def test_seat_text_helpers(spark):
    df = spark.createDataFrame([("1, 2,3", ""), (" A ", None)], "t string, s string")
    got = df.select(split_seat_text(F.col("t")).alias("a"), seats_or_full(F.col("s")).alias("f")).collect()
    assert [(r["a"], r["f"]) for r in got] == [(["1", "2", "3"], "FULL"), (["A"], "FULL")]


def test_sorted_and_without(spark):
    df = spark.createDataFrame([(["b", "A", "10", "2", "a"], ["2"])], "x array<string>, h array<string>")
    r = df.select(sorted_ci(F.col("x")).alias("s"), without(F.col("x"), F.col("h")).alias("w"),
                  without(F.col("x"), F.lit(None).cast("array<string>")).alias("n")).first()
    assert r["s"] == ["10", "2", "A", "a", "b"]
    assert r["w"] == ["b", "A", "10", "a"] and r["n"] == ["b", "A", "10", "2", "a"]


def test_display_date(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2026-04-05 18:30:00' AS d")
    assert df.select(display_date("d").alias("x")).first()["x"] == "4/5/2026"


def test_checkpoint_dir_is_the_sessions_own(spark):
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
