"""Ingest-side table operators (the download loop itself is not rebuilt).

* ``fetch_worklist``: which raw payload each activity needs, per enabled
  asset -- the planning half of the download loop, as a DataFrame.
* ``backfill_dates``: the dates of a requested range that have raw data.
* ``partition_by_event_date``: the ``dt`` a raw activity is filed under.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import event_date

# Asset key -> vendor client method used to fetch it.
METHOD_REGISTRY = {
    "splits": "get_activity_splits",
    "activity_details": "get_activity_details",
    "workouts": "get_workout_by_id",
}


@dataclass(frozen=True)
class IngestAsset:
    key: str
    output_folder: str
    enabled: bool = True
    overwrite: bool = True
    source: str = "activity"


# The default ingest asset list.
DEFAULT_INGEST_ASSETS = (
    IngestAsset("splits", "splits", True, True, "activity"),
    IngestAsset("activity_details", "activity_details", True, True, "activity"),
    IngestAsset("workouts", "workouts", True, True, "reference"),
)


def fetch_worklist(
    activities: DataFrame,
    assets: tuple[IngestAsset, ...] = DEFAULT_INGEST_ASSETS,
    storage_root: str = "raw",
    existing_outputs: DataFrame | None = None,
) -> DataFrame:
    """(asset, activity_id, lookup_id, dt, output_file) for every fetch to make.

    ``activities`` needs ``activity_id``, ``workout_id`` and ``dt``. The
    asset list is configuration (a handful of entries); it is expanded per
    activity with a generator, not joined. ``existing_outputs`` (column
    ``output_file``) drops outputs that exist for assets with
    ``overwrite=False``. Files are named by activity id, even workouts.
    """
    specs = [
        a
        for a in assets
        if a.enabled and a.key in METHOD_REGISTRY and (a.source == "activity" or (a.source == "reference" and a.key == "workouts"))
    ]
    if not specs:
        return activities.sparkSession.createDataFrame(
            [], "asset string, activity_id bigint, lookup_id bigint, dt string, output_file string, overwrite boolean"
        )
    arr = F.array(
        *[
            F.struct(
                F.lit(a.key).alias("key"),
                F.lit(a.output_folder).alias("folder"),
                F.lit(a.overwrite).alias("overwrite"),
                F.lit(a.source).alias("source"),
            )
            for a in specs
        ]
    )
    exploded = activities.select("activity_id", "workout_id", F.col("dt").cast("string").alias("dt"), F.explode(arr).alias("a"))
    lookup = F.when(F.col("a.source") == "activity", F.col("activity_id")).otherwise(
        F.when(F.coalesce(F.col("workout_id"), F.lit(0)) != 0, F.col("workout_id"))
    )
    out = exploded.select(
        F.col("a.key").alias("asset"),
        "activity_id",
        lookup.cast("bigint").alias("lookup_id"),
        "dt",
        F.concat(
            F.lit(storage_root.rstrip("/") + "/"), F.col("a.folder"), F.lit("/dt="), F.col("dt"), F.lit("/"),
            F.col("a.key"), F.lit("_"), F.col("activity_id").cast("string"), F.lit(".json"),
        ).alias("output_file"),
        F.col("a.overwrite").alias("overwrite"),
    ).filter(F.col("lookup_id").isNotNull())
    if existing_outputs is not None:
        skip = out.filter(~F.col("overwrite")).join(existing_outputs.select("output_file"), "output_file", "left_semi")
        out = out.join(skip.select("output_file"), "output_file", "left_anti")
    return out.select("asset", "activity_id", "lookup_id", "dt", "output_file")


def date_range(spark: SparkSession, start_date: str | None, end_date: str | None) -> DataFrame:
    """Inclusive daily sequence as a one-column frame (``run_date`` string)."""
    if not start_date or not end_date:
        raise ValueError("Both start_date and end_date params are required.")
    start = _dt.date.fromisoformat(start_date)
    end = _dt.date.fromisoformat(end_date)
    if start > end:
        raise ValueError("start_date must be less than or equal to end_date.")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("d"))
    return days.select(F.col("d").cast("string").alias("run_date"))


def backfill_dates(
    spark: SparkSession,
    start_date: str | None,
    end_date: str | None,
    existing_partitions: DataFrame | None,
) -> DataFrame:
    """Requested dates that have a raw partition for any enabled asset.

    ``existing_partitions`` has a ``dt`` column (one row per asset
    partition); ``None`` means "no source path / no assets": every date.
    """
    dates = date_range(spark, start_date, end_date)
    if existing_partitions is None:
        return dates
    present = existing_partitions.select(F.col("dt").cast("string").alias("run_date")).distinct()
    return dates.join(present, "run_date", "left_semi").orderBy("run_date")


def discover_partitions(spark: SparkSession, source_path: str, folders: list[str]) -> DataFrame:
    """``dt=`` partition folders present under ``<source>/<folder>`` (a listing)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for folder in folders:
        pattern = jvm.org.apache.hadoop.fs.Path(f"{source_path.rstrip('/')}/{folder}/dt=*")
        fs = pattern.getFileSystem(conf)
        statuses = fs.globStatus(pattern) or []
        for st in statuses:
            if st.isDirectory():
                rows.append((folder, st.getPath().getName().removeprefix("dt=")))
    return spark.createDataFrame(rows, "asset string, dt string")


def partition_by_event_date(raw_activities: DataFrame, fallback_date: str) -> DataFrame:
    """Adds ``dt``: local start date, else GMT start date, else the fallback."""
    return raw_activities.withColumn(
        "dt", event_date(F.col("start_time_local"), F.col("start_time_gmt"), F.lit(fallback_date))
    )
