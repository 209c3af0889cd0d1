"""Incremental silver/gold build: a second run that adds a day equals a full build."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from stridelake.plans.incremental_build import TABLE_MODELS, incremental_build
from stridelake.plans.pipeline import TrainingModels
from stridelake.sources import fixtures

SF = "/root/testdata/sf0.001"


def _six_days(df):
    """Move rows onto six run dates (by activity) so tables have few partitions."""
    day = F.date_add(F.lit("2024-02-01").cast("date"), (F.col("activity_id") % 6).cast("int"))
    return df.withColumn("run_date", day.cast("string"))


def _sources(spark, upto_last_day: bool):
    a = _six_days(fixtures.activities(spark, SF))
    s = _six_days(fixtures.splits(spark, SF))
    d = _six_days(fixtures.activity_details(spark, SF))
    w = fixtures.workouts(spark, SF)
    if not upto_last_day:
        a_last = a.agg(F.max("run_date")).first()[0]
        d_last = d.agg(F.max("run_date")).first()[0]
        a = a.filter(F.col("run_date") < a_last)
        s = s.filter(F.col("run_date") < a_last)
        d = d.filter(F.col("run_date") < d_last)
    return TrainingModels(a, s, d, w)


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect())


def test_second_run_equals_full_build(spark, tmp_root):
    inc_root = os.path.join(tmp_root, "inc")
    incremental_build(spark, _sources(spark, upto_last_day=False), inc_root)
    paths = incremental_build(spark, _sources(spark, upto_last_day=True), inc_root)
    full_root = os.path.join(tmp_root, "full")
    full = incremental_build(spark, _sources(spark, upto_last_day=True), full_root, full_refresh=True)
    expected = {name: _rows(spark.read.parquet(full[name])) for name in TABLE_MODELS}
    for name in TABLE_MODELS:
        assert _rows(spark.read.parquet(paths[name])) == expected[name], name
    # a rerun with no new data reprocesses the mark day and changes nothing
    incremental_build(spark, _sources(spark, upto_last_day=True), inc_root)
    for name in TABLE_MODELS:
        assert _rows(spark.read.parquet(paths[name])) == expected[name], name


def test_full_refresh_drops_old_partitions(spark, tmp_root):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        target = os.path.join(tmp_root, "t")
        rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "k int, run_date string")
        rows.write.partitionBy("run_date").parquet(target)
        new = spark.createDataFrame([(1, "2024-01-05")], "k int, run_date string")
        new.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("run_date").parquet(target)
        assert [r.k for r in spark.read.parquet(target).collect()] == [1]
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
