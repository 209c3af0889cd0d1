"""Bronze models: de-duplicated landing rows since the high-water mark, stored and upserted by key.

``select distinct *`` keeps metadata columns, so a row re-landed with a new
``ingested_at`` is a new row (faithful to the original models). Workouts
additionally keep only the latest landing per workout.

``build_bronze`` stores the four tables partitioned by ``dt``. Each table's mark, the greatest ``dt`` it
holds, is read first (from the partition column alone) and goes into the landing scan as a
literal, so folders older than the mark are pruned when the plan is made, ahead of the distinct. The
batch replaces the rows of its keys in whatever day they are. The mark's day is always loaded again, so an
activity landed on that day and on a later one is in the batch twice: the job keeps its newest landing per
key. ``latest=False`` keeps both, as the original upsert does.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import _path_exists, incremental_filter, newest_per_key, replace_table, write_upsert
from ..sources.raw import landing_scan
from ..sources.tables import tasks_for

# Unique keys of each incremental model.
UNIQUE_KEYS: dict[str, list[str]] = {
    "activities": ["activity_id"],
    "splits": ["activity_id", "message_index"],
    "activity_details": ["activity_id", "measurement_index", "metric_index"],
    "workouts": ["workout_id"],
    "running_trainings": ["activity_id"],
    "running_splits": ["activity_id", "split_index"],
    "running_activity_details": ["activity_id", "measurement_index"],
    "running_derived_splits": ["activity_id", "distance_km_bucket"],
    "running_workouts": ["workout_id", "step_order"],
    "running_workout_results": ["activity_id", "split_index"],
    "running_trainings_summary": ["activity_id"],
    "running_workout_results_summary": ["activity_id"],
    "running_derived_splits_summary": ["activity_id"],
}


def bronze_distinct(landing: DataFrame, target: DataFrame | None = None, lookback_days: int = 0) -> DataFrame:
    """Landing rows at/after the target's ``dt`` mark, exact duplicates removed."""
    return incremental_filter(landing, "dt", target, lookback_days).distinct()


def latest_per_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """Keep the row with the greatest ``order_cols`` per key.

    ``max_by`` is a partial aggregate: each task pre-selects its best row
    per key before the shuffle, so a key holding a third of all rows costs
    one row per task on the network, not a third of the data in one task.
    """
    cols = [c for c in df.columns]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*cols), F.struct(*[F.col(c) for c in order_cols])).alias("_row")
    )
    return best.select("_row.*").select(*cols)


def bronze_workouts(landing: DataFrame, target: DataFrame | None = None, lookback_days: int = 0) -> DataFrame:
    """The newest landing of each workout. Equal rows need no distinct ahead of it, which would hold the plans' texts as keys."""
    d = incremental_filter(landing, "dt", target, lookback_days)
    order = ["run_date"] + (["source_file"] if "source_file" in d.columns else [])
    return latest_per_key(d, ["workout_id"], order)


BRONZE_TABLES = ("activities", "splits", "activity_details", "workouts")


def stored_mark(spark: SparkSession, path: str, landing: DataFrame) -> _dt.date | None:
    """Greatest ``dt`` of a stored bronze table; None when it has no row."""
    stored = spark.read.schema(landing.schema).parquet(path)
    return stored.agg(F.max(F.col("dt").cast("date")).alias("mark")).first()["mark"]


def landed_since(landing: DataFrame, mark: _dt.date | None, lookback_days: int = 0) -> DataFrame:
    """Landing rows of the mark's day minus the lookback, and later; nothing without a mark."""
    if mark is None:
        return landing.filter(F.lit(False))
    return landing.filter(F.col("dt") >= F.lit(mark - _dt.timedelta(days=lookback_days)))


def bronze_batch(name: str, landing: DataFrame, latest: bool = True) -> DataFrame:
    """What a load adds to the bronze table ``name``."""
    if name == "workouts":
        return bronze_workouts(landing)
    if latest:
        # Equal rows have equal keys: exchanged by key once, they need no exchange for the distinct and another
        # for the newest.
        landing = landing.repartition(tasks_for(landing), *UNIQUE_KEYS[name])
    batch = bronze_distinct(landing)
    if latest:
        newest_by = [c for c in ("dt", "ingested_at", "source_file") if c in batch.columns]
        batch = newest_per_key(batch, UNIQUE_KEYS[name], newest_by)
    return batch


def build_bronze(
    spark: SparkSession,
    landing_path: str,
    root: str,
    lookback_days: int = 0,
    full_refresh: bool = False,
    latest: bool = True,
    tables: tuple[str, ...] = BRONZE_TABLES,
) -> dict[str, str]:
    """Load the landing tables into the stored bronze tables under ``root``; returns their paths.

    The first run and ``full_refresh`` load everything, later ones what was landed since the mark minus
    ``lookback_days``. A stored table without rows has no mark, so nothing loads (the original's rule).
    """
    paths = {}
    for name in tables:
        path = paths[name] = f"{root.rstrip('/')}/{name}"
        landing = landing_scan(spark, landing_path, name)
        exists = _path_exists(spark, path)
        if exists and not full_refresh:
            landing = landed_since(landing, stored_mark(spark, path, landing), lookback_days)
        batch = bronze_batch(name, landing, latest)
        if full_refresh:
            replace_table(spark, path, batch, "dt")
        else:
            write_upsert(spark, path, batch, UNIQUE_KEYS[name], "dt")
    return paths


def stored_bronze(spark: SparkSession, landing_path: str, root: str) -> dict[str, DataFrame]:
    """The stored tables, with the landing tables' columns (a table written empty has no files to tell them)."""
    schemas = {n: landing_scan(spark, landing_path, n).schema for n in BRONZE_TABLES}
    return {n: spark.read.schema(s).parquet(f"{root.rstrip('/')}/{n}") for n, s in schemas.items()}
