"""Ordered operators: the split path equals the plain window on skewed data."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowtide.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; order values repeat between keys only."""
    rng = random.Random(7)
    rows = [(0 if rng.random() < 0.7 else rng.randrange(1, 40), i, rng.randrange(1000)) for i in range(3000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, o int, v int").cache()


def by_window(df, keys):
    """The same columns from plain windows."""
    window = Window.partitionBy(*keys).orderBy("o")
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", F.row_number().over(window).cast("bigint").alias("n"), F.sum("v").over(running).alias("s"),
                     F.max("v").over(running).alias("m"), F.lead("v").over(window).alias("nx"))


OUT = {"n": ("row_number", None), "s": ("sum", "v"), "m": ("max", "v"), "nx": ("lead", "v")}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_split_scan_equals_window(skewed, keys):
    plain = by_window(skewed, keys)
    split = ordered.scan_ordered(skewed, keys, ["o"], OUT)
    columns = ["k", "o", *OUT]
    assert split.select(columns).orderBy("o").collect() == plain.select(columns).orderBy("o").collect()


def test_split_scan_with_nulls_in_key_and_value(spark):
    rows = [(None if i % 3 else 1, i, None if i % 5 == 0 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    columns = ["o", *OUT]
    plain = by_window(df, ["k"]).select(columns).orderBy("o").collect()
    assert ordered.scan_ordered(df, ["k"], ["o"], OUT).select(columns).orderBy("o").collect() == plain


def test_sequential_ids_start_at_zero(spark):
    df = spark.createDataFrame([(c,) for c in "dbca"], "x string")
    rows = ordered.sequential_ids(df, ["x"], "id", "flow-").orderBy("x").collect()
    assert [r.id for r in rows] == ["flow-0", "flow-1", "flow-2", "flow-3"]


def test_launch_schedule_matches_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), i, rng.randrange(500)) for i in range(300)]
    df = spark.createDataFrame(rows, "p int, i int, at int")
    df = df.withColumn("at", F.col("at").cast("bigint"))
    got = ordered.launch_schedule(df, ["p"], ["at", "i"], "at", F.lit(7).cast("bigint"), "start")
    got = {r.i: r.start for r in got.collect()}
    last = {}
    for p, i, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        start = max(at, last[p] + 7) if p in last else at
        last[p] = start
        assert got[i] == start


def test_function_bounds(spark):
    df = spark.createDataFrame(
        [("a.js", "f", 3, 0, 5), ("a.js", "g", 10, 1, 14), ("b.js", "h", 1, 0, None)],
        "file_path string, fn_id string, line int, ord int, max_line int",
    )
    rows = {r.fn_id: (r.start, r.end) for r in ordered.function_bounds(df).collect()}
    assert rows == {"f": (3, 9), "g": (10, 19), "h": (1, 6)}


def test_trim_groups(spark):
    df = spark.createDataFrame([(k, i, f"n{i}") for k, n in ((1, 8), (2, 6), (3, 1)) for i in range(n)], "k int, i int, n string")
    rows = {r.k: r.steps for r in ordered.trim_groups(df, ["k"], "i", "n").collect()}
    assert rows[1] == ["n0", "n1", "n2", "... (2 nodes) ...", "n5", "n6", "n7"]
    assert rows[2] == [f"n{i}" for i in range(6)] and rows[3] == ["n0"]


def test_eviction(spark):
    df = spark.range(510).withColumn("ts", F.col("id"))
    kept = ordered.evict_oldest(df, "ts", "id", 500, 100)
    assert kept.count() == 410 and kept.agg(F.min("id")).first()[0] == 100
    assert ordered.evict_oldest(spark.range(500).withColumn("ts", F.col("id")), "ts", "id", 500, 100).count() == 500


def test_budget_and_transcript(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "x" * 50)], "c int, t int, role string, text string")
    for limit in (0, 100):
        assert ordered.within_budget(df, ["c"], ["t"], "text", 10, limit).count() == 2
        lines = ordered.transcript_lines(df, ["c"], ["t"], "role", "text", limit).orderBy("t").collect()
        whole = "".join(r.line for r in lines)
        assert whole.startswith("User: hi\n\nAssistant: yes\n\nUser: ")
        assert all(whole[r.offset:].startswith(r.line) for r in lines)


def test_first_wins_limits_before_the_shuffle(spark, skewed):
    plan = ordered.first_per_key(skewed, ["k"], ["o"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
