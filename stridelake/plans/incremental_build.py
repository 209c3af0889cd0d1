"""Incremental build of the silver and gold tables.

Each incremental model keeps only rows whose ``run_date`` is at or after
``max(target.run_date) - lookback_days`` (its own target, or an upstream
table for the derived splits) and upserts them by the model's unique key.
``run_date`` is constant per activity and, for all but one model, the
output's ``run_date`` is the filtered input's, so filtering the output
equals filtering the input; Catalyst pushes the filter down through the
projections, joins and per-activity aggregations to the scans. The
derived-splits summary filters its input explicitly (its output carries
the training's run_date, its filter the samples').

Tables are parquet folders partitioned by ``run_date``; an upsert rewrites
only the partitions it touches (``write_upsert``). After each model is
written, the graph re-reads it, so downstream models see the full,
updated upstream table (as a model referencing another one does).
``running_workouts`` has no mark: it is recomputed and upserted in full.
The two views (``running_summary``, ``running_workout_summary``) stay lazy.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import _path_exists, incremental_filter, replace_table, write_upsert
from .bronze import UNIQUE_KEYS
from . import gold
from .pipeline import TrainingModels

# model -> table its high-water mark is read from (None: no mark, full upsert)
MARK_SOURCE = {
    "running_trainings": "running_trainings",
    "running_splits": "running_splits",
    "running_activity_details": "running_activity_details",
    "running_derived_splits": "running_activity_details",
    "running_workouts": None,
    "running_workout_results": "running_workout_results",
    "running_trainings_summary": "running_trainings_summary",
    "running_derived_splits_summary": "running_derived_splits_summary",
    "running_workout_results_summary": "running_workout_results_summary",
}
TABLE_MODELS = tuple(MARK_SOURCE)


def incremental_build(
    spark: SparkSession,
    models: TrainingModels,
    root: str,
    lookback_days: int = 0,
    full_refresh: bool = False,
) -> dict[str, str]:
    """Build or update every silver/gold table under ``root``; returns paths."""
    paths = {name: f"{root.rstrip('/')}/{name}" for name in TABLE_MODELS}
    exists = {name: _path_exists(spark, p) for name, p in paths.items()}
    for name in TABLE_MODELS:
        df = getattr(models, name)
        if "run_date" in df.columns:
            df = df.withColumn("run_date", F.col("run_date").cast("date"))
        partition = "run_date" if "run_date" in df.columns else None
        mark_from = MARK_SOURCE[name]
        if full_refresh or not exists[name]:
            batch = df
        elif mark_from is None:
            batch = df
        else:
            # The mark is read when this model runs. For the derived splits
            # it comes from the upstream details table, already updated in
            # this run (as in the original model).
            mark_schema = (df if mark_from == name else getattr(models, mark_from)).schema
            mark_table = spark.read.schema(mark_schema).parquet(paths[mark_from]) if exists[mark_from] else None
            if name == "running_derived_splits_summary":
                # This model's mark filters its input: the derived splits'
                # run_date (sensor dates), not the summary's own run_date
                # (training dates), exactly as the original model does.
                src = incremental_filter(models.running_derived_splits, "run_date", mark_table, lookback_days)
                batch = gold.running_derived_splits_summary(src, models.running_trainings_summary)
                batch = batch.withColumn("run_date", F.col("run_date").cast("date"))
            else:
                batch = incremental_filter(df, "run_date", mark_table, lookback_days)
        if full_refresh and exists[name]:
            # the whole table: partitions that the source no longer has go as well
            replace_table(spark, paths[name], batch, partition)
        else:
            write_upsert(spark, paths[name], batch, UNIQUE_KEYS[name], partition)
        # Read back with the known schema: an empty table has no files to infer it from.
        models.__dict__[name] = spark.read.schema(df.schema).parquet(paths[name])
    return paths
