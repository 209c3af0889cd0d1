"""Incremental loads: mark filter, upsert writer, day-by-day replay, stream form."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from stridelake.operators.incremental import incremental_filter, upsert, write_upsert
from stridelake.plans.bronze import bronze_distinct, bronze_workouts
from stridelake.sources import fixtures
from stridelake.streaming.landing_stream import stream_upsert

SF = "/root/testdata/sf0.001"


def _land(spark):
    """Activities spread over six landing days (few partition folders)."""
    a = fixtures.activities(spark, SF)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("activity_id") % 6).cast("int"))
    return a.withColumn("run_date", day.cast("string")).withColumn("dt", day)


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_filter_inclusive_mark_and_empty_target(spark):
    batch = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3)], "dt string, k int")
    target = spark.createDataFrame([("2024-01-02", 9)], "dt string, k int")
    assert [r.k for r in incremental_filter(batch, "dt", target).orderBy("k").collect()] == [2, 3]
    assert [r.k for r in incremental_filter(batch, "dt", target, lookback_days=1).orderBy("k").collect()] == [1, 2, 3]
    empty = target.limit(0)
    assert incremental_filter(batch, "dt", empty).count() == 0  # NULL mark: nothing loads
    assert incremental_filter(batch, "dt", None).count() == 3  # first run: full load


def test_upsert_semantics(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    batch = spark.createDataFrame([(2, "B"), (3, "C"), (3, "C2"), (None, "m")], "k int, v string")
    got = sorted((r.k if r.k is not None else -1, r.v) for r in upsert(target, batch, ["k"]).collect())
    # key 2 replaced; in-batch duplicates kept; NULL keys never match
    assert got == [(-1, "m"), (-1, "n"), (1, "a"), (2, "B"), (3, "C"), (3, "C2")]


def test_day_by_day_replay_equals_full_refresh(spark, tmp_root):
    land = _land(spark)
    days = sorted(r.dt for r in land.select("dt").distinct().collect())
    cut = [days[1], days[3], days[-1]]
    target = os.path.join(tmp_root, "bronze_activities")
    prev = None
    for end in cut:
        # landing grows by day; each run loads partitions since the mark
        visible = land.filter(F.col("dt") <= F.lit(end))
        tgt = spark.read.parquet(target) if prev else None
        batch = bronze_distinct(visible, tgt, lookback_days=0)
        write_upsert(spark, target, batch, ["activity_id"], partition_col="dt")
        prev = end
    cols = ["activity_id", "distance", "run_date", "dt"]
    assert _rows(spark.read.parquet(target), cols) == _rows(bronze_distinct(land), cols)


def test_upsert_moves_key_to_new_partition_and_drops_empty_partition(spark, tmp_root):
    target = os.path.join(tmp_root, "t")
    first = spark.createDataFrame([(1, "x", "2024-01-01"), (2, "y", "2024-01-01"), (3, "z", "2024-01-02")],
                                  "k int, v string, dt string")
    write_upsert(spark, target, first, ["k"], partition_col="dt")
    second = spark.createDataFrame([(3, "Z", "2024-01-03")], "k int, v string, dt string")
    write_upsert(spark, target, second, ["k"], partition_col="dt")
    got = sorted((r.k, r.v, str(r.dt)) for r in spark.read.parquet(target).collect())
    assert got == [(1, "x", "2024-01-01"), (2, "y", "2024-01-01"), (3, "Z", "2024-01-03")]
    assert not os.path.exists(os.path.join(target, "dt=2024-01-02"))


def test_latest_workout_per_key(spark):
    rows = [(1, "a", "2024-01-01", "f1"), (1, "b", "2024-01-03", "f1"), (1, "c", "2024-01-02", "f1"),
            (2, "d", "2024-01-01", "f1"), (2, "e", "2024-01-01", "f2")]
    df = spark.createDataFrame(rows, "workout_id int, workout_name string, run_date string, source_file string")
    got = sorted((r.workout_id, r.workout_name) for r in bronze_workouts(df.withColumn("dt", F.col("run_date"))).collect())
    assert got == [(1, "b"), (2, "e")]


def test_stream_upsert_equals_batch(spark, tmp_root):
    land = _land(spark).withColumn("dt", F.col("dt").cast("string"))
    src = os.path.join(tmp_root, "landing")
    days = sorted(r.dt for r in land.select("dt").distinct().collect())
    half = days[len(days) // 2]
    land.filter(F.col("dt") <= half).write.partitionBy("dt").parquet(src)
    target = os.path.join(tmp_root, "bronze")
    ckpt = os.path.join(tmp_root, "ckpt")
    stream_upsert(spark, src, target, ["activity_id"], "dt", ckpt)
    land.filter(F.col("dt") > half).write.mode("append").partitionBy("dt").parquet(src)
    stream_upsert(spark, src, target, ["activity_id"], "dt", ckpt)  # second run: only new files
    cols = ["activity_id", "distance", "run_date"]
    assert _rows(spark.read.parquet(target), cols) == _rows(land.distinct(), cols)


def test_empty_batch_is_a_no_op(spark, tmp_root):
    target = os.path.join(tmp_root, "t")
    first = spark.createDataFrame([(1, "x", "2024-01-01")], "k int, v string, dt string")
    write_upsert(spark, target, first, ["k"], partition_col="dt")
    write_upsert(spark, target, first.limit(0), ["k"], partition_col="dt")
    assert [(r.k, r.v) for r in spark.read.parquet(target).collect()] == [(1, "x")]


def test_upsert_keeps_the_null_partition(spark, tmp_root):
    target = os.path.join(tmp_root, "nulls")
    schema = "k int, v string, dt string"
    first = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", "2024-01-01")], schema)
    write_upsert(spark, target, first, ["k"], partition_col="dt")
    write_upsert(spark, target, spark.createDataFrame([(9, "z", None)], schema), ["k"], partition_col="dt")
    read = lambda: sorted((r.k, r.dt) for r in spark.read.schema(schema).parquet(target).collect())
    assert read() == [(1, None), (2, None), (3, "2024-01-01"), (9, None)]
    moved = spark.createDataFrame([(k, "m", "2024-01-02") for k in (1, 2, 9)], schema)
    write_upsert(spark, target, moved, ["k"], partition_col="dt")
    assert read() == [(1, "2024-01-02"), (2, "2024-01-02"), (3, "2024-01-01"), (9, "2024-01-02")]


def test_unpartitioned_upsert_swaps_whole_folders(spark, tmp_root):
    target = os.path.join(tmp_root, "swap")
    write_upsert(spark, target, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    write_upsert(spark, target, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(target).collect()) == [(1, "a"), (2, "c")]
    assert os.listdir(tmp_root) == ["swap"]


def test_stream_takes_the_latest_landing_of_a_key(spark, tmp_root):
    src, target, ckpt = (os.path.join(tmp_root, x) for x in ("landing", "bronze", "ckpt"))
    schema = "k int, v string, dt string"
    spark.createDataFrame([(1, "old", "2024-01-01"), (1, "new", "2024-01-02")], schema).write.partitionBy("dt").parquet(src)
    stream_upsert(spark, src, target, ["k"], "dt", ckpt)
    stream_upsert(spark, src, target, ["k"], "dt", ckpt)
    assert [(r.k, r.v) for r in spark.read.parquet(target).collect()] == [(1, "new")]


def test_late_file_of_an_older_day_does_not_replace_a_newer_row(spark, tmp_root):
    import os

    src, target, ckpt = (os.path.join(tmp_root, x) for x in ("late-src", "late-t", "late-c"))
    schema = "k int, v string, dt date"
    day = lambda n: __import__("datetime").date(2024, 1, n)

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").partitionBy("dt").parquet(src)
        stream_upsert(spark, src, target, ["k"], "dt", ckpt)
        return sorted((r.k, r.v) for r in spark.read.parquet(target).collect())

    assert run([(1, "new", day(5)), (2, "x", day(5))]) == [(1, "new"), (2, "x")]
    assert run([(1, "old", day(3)), (3, "late", day(3))]) == [(1, "new"), (2, "x"), (3, "late")]
    assert run([(1, "same day", day(5)), (2, "newer", day(6))]) == [(1, "same day"), (2, "newer"), (3, "late")]
