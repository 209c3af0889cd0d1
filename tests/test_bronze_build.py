"""Stored, incremental bronze: marks, pruning, upserts, and the build on top of it."""

from __future__ import annotations

import datetime as dt
import os

from stridelake.operators.incremental import _path_exists, replace_table
from stridelake.plans import bronze
from stridelake.plans.medallion import build_all, stored_quality_report
from stridelake.sources import fixtures
from stridelake.sources.raw import landing_scan

SF = "/root/testdata/sf0.001"
LAPS = "activity_id long, message_index long, distance double, ingested_at string, dt date"


def land(spark, root, asset, rows, schema=LAPS):
    df = spark.createDataFrame(rows, schema)
    df.write.mode("append").partitionBy("dt").parquet(os.path.join(root, "landing", asset))


def laps(spark, path):
    return sorted((r.activity_id, r.message_index, r.distance, str(r.dt)) for r in spark.read.parquet(path).collect())


def day(n):
    return dt.date(2024, 3, n)


def test_relanded_activity_keeps_one_row_a_lap(spark, tmp_root):
    landing, out = os.path.join(tmp_root, "landing"), os.path.join(tmp_root, "bronze")
    build = lambda **kw: bronze.build_bronze(spark, landing, out, tables=("splits",), **{"latest": False, **kw})["splits"]
    land(spark, tmp_root, "splits", [(1, 0, 5.0, "a", day(1)), (1, 1, 6.0, "a", day(1)), (2, 0, 7.0, "a", day(2))])
    path = build()
    assert laps(spark, path) == [(1, 0, 5.0, "2024-03-01"), (1, 1, 6.0, "2024-03-01"), (2, 0, 7.0, "2024-03-02")]
    # activity 1 is landed again under another day, one lap changed; its first landing was not removed
    land(spark, tmp_root, "splits", [(1, 0, 5.5, "b", day(4)), (1, 1, 6.0, "b", day(4)), (3, 0, 8.0, "b", day(4))])
    build()
    want = [(1, 0, 5.5, "2024-03-04"), (1, 1, 6.0, "2024-03-04"), (2, 0, 7.0, "2024-03-02"), (3, 0, 8.0, "2024-03-04")]
    assert laps(spark, path) == want
    assert not os.path.exists(os.path.join(path, "dt=2024-03-01"))  # its last row has moved
    build()  # nothing new: the mark's day is loaded again and changes nothing
    assert laps(spark, path) == want
    # a late partition, older than the mark, loads only within the lookback
    land(spark, tmp_root, "splits", [(4, 0, 9.0, "c", day(3))])
    build()
    assert laps(spark, path) == want
    build(lookback_days=1)
    assert laps(spark, path) == sorted([*want, (4, 0, 9.0, "2024-03-03")])
    # all of landing at once: both landings of activity 1 stay, unless only the newest is asked for
    build(full_refresh=True)
    assert len(laps(spark, path)) == 7
    build(full_refresh=True, latest=True)
    assert laps(spark, path) == sorted([*want, (4, 0, 9.0, "2024-03-03")])
    # landed on the mark's day and after it: both are in one batch
    land(spark, tmp_root, "splits", [(3, 0, 8.5, "d", day(5))])
    build(latest=True)
    assert (3, 0, 8.5, "2024-03-05") in laps(spark, path) and len(laps(spark, path)) == 5


def test_mark_prunes_landing_folders_ahead_of_the_distinct(spark, tmp_root):
    land(spark, tmp_root, "splits", [(1, 0, 5.0, "a", day(1)), (2, 0, 7.0, "a", day(2))])
    landing = landing_scan(spark, os.path.join(tmp_root, "landing"), "splits")
    fresh = bronze.landed_since(landing, day(3), lookback_days=1)
    plan = bronze.bronze_batch("splits", fresh)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "2024-03-02" in scan[scan.index("PartitionFilters") : scan.index("PushedFilters")]
    assert len(fresh.inputFiles()) == 2  # the scan's files; pruning is the plan's
    assert [r.activity_id for r in fresh.collect()] == [2]


def test_empty_target_loads_nothing_and_null_keys_never_match(spark, tmp_root):
    landing, out = os.path.join(tmp_root, "landing"), os.path.join(tmp_root, "bronze")
    land(spark, tmp_root, "splits", [(1, None, 5.0, "a", day(1))])
    table = landing_scan(spark, landing, "splits")
    replace_table(spark, f"{out}/splits", table.limit(0), "dt")
    bronze.build_bronze(spark, landing, out, tables=("splits",))
    assert spark.read.schema(table.schema).parquet(f"{out}/splits").count() == 0
    bronze.build_bronze(spark, landing, out, full_refresh=True, tables=("splits",))
    bronze.build_bronze(spark, landing, out, tables=("splits",))
    assert spark.read.parquet(f"{out}/splits").count() == 2  # the key (1, NULL) matches nothing, so it is added again


def test_new_landing_column_reaches_bronze(spark, tmp_root):
    landing, out = os.path.join(tmp_root, "landing"), os.path.join(tmp_root, "bronze")
    land(spark, tmp_root, "splits", [(1, 0, 5.0, "a", day(1)), (2, 0, 5.0, "a", day(2))])
    bronze.build_bronze(spark, landing, out, tables=("splits",))
    land(spark, tmp_root, "splits", [(2, 0, 6.0, "b", day(3), 150.0)], LAPS + ", max_hr double")
    bronze.build_bronze(spark, landing, out, tables=("splits",))
    rows = bronze.landing_scan(spark, out, "splits").orderBy("activity_id").collect()
    assert [(r.activity_id, r.distance, r.max_hr) for r in rows] == [(1, 5.0, None), (2, 6.0, 150.0)]


def test_build_writes_four_bronze_tables_and_is_checked_from_them(spark, tmp_root):
    landing, out = os.path.join(tmp_root, "landing"), os.path.join(tmp_root, "models")
    shift = lambda df: df.withColumn("dt", dt_of(df))
    from pyspark.sql import functions as F

    dt_of = lambda df: F.date_add(F.lit("2024-02-01").cast("date"), (F.col(df.columns[0]) % 4).cast("int"))
    sources = {
        "activities": fixtures.activities(spark, SF),
        "splits": fixtures.splits(spark, SF),
        "activity_details": fixtures.activity_details(spark, SF),
        "workouts": fixtures.workouts(spark, SF).withColumn("run_date", F.lit("2024-02-01")),
    }
    for name, df in sources.items():
        if name != "workouts":  # the run date is the day of the landing, so tables have few partitions
            df = df.withColumn("run_date", dt_of(df).cast("string"))
        shift(df).write.partitionBy("dt").parquet(os.path.join(landing, name))
    paths = build_all(spark, landing, out)
    assert set(bronze.BRONZE_TABLES) <= set(paths) and all(_path_exists(spark, p) for p in paths.values())
    counts = {n: spark.read.parquet(paths[n]).count() for n in ("splits", "running_trainings", "running_splits")}
    # every activity is landed once more, later: nothing multiplies
    for name in ("activities", "splits"):
        again = landing_scan(spark, landing, name).withColumn("dt", F.lit("2024-02-09").cast("date"))
        again.write.mode("append").partitionBy("dt").parquet(os.path.join(landing, f"{name}-again"))
        spark.read.parquet(os.path.join(landing, f"{name}-again")).write.mode("append").partitionBy("dt").parquet(
            os.path.join(landing, name)
        )
    build_all(spark, landing, out)
    assert counts == {n: spark.read.parquet(paths[n]).count() for n in counts}
    report = {(r.model, r.test, r.column_name): r.failures for r in stored_quality_report(spark, out).collect()}
    assert len(report) == 37
    assert report["activities", "unique", "activity_id"] == 0
    assert report["splits", "unique_combination", "activity_id,message_index"] == 0


def test_failed_move_brings_the_old_table_back(spark, tmp_root, monkeypatch):
    from stridelake.operators import incremental

    target = os.path.join(tmp_root, "t")
    replace_table(spark, target, spark.range(3))
    real = incremental._delete
    monkeypatch.setattr(incremental, "_delete", lambda s, p: None)
    try:
        incremental._move_in(spark, os.path.join(tmp_root, "not there"), target, os.path.join(tmp_root, "aside"))
        raise AssertionError("no error")
    except OSError:
        pass
    monkeypatch.setattr(incremental, "_delete", real)
    assert spark.read.parquet(target).count() == 3
