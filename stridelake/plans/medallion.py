"""Landing tables -> bronze frames -> the silver/gold model graph.

``models_from_landing`` reads the four landing tables (all ``dt=``
partitions, schemas merged by name), applies the bronze rules (exact
duplicates removed; the latest landing of each workout) and returns the
lazy model graph over them. ``build_all`` is the job: it loads the stored bronze tables
incrementally and builds the silver and gold tables from them. ``quality_report`` runs the 37 schema tests
over a graph; ``stored_quality_report`` runs them over the tables that ``build_all`` wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.quality import run_checks
from ..sources.raw import landing_scan
from .bronze import BRONZE_TABLES, bronze_distinct, bronze_workouts, build_bronze, stored_bronze
from .incremental_build import TABLE_MODELS, incremental_build
from .pipeline import TrainingModels


def bronze_tables(spark: SparkSession, landing_path: str) -> dict[str, DataFrame]:
    def land(asset: str) -> DataFrame:
        return landing_scan(spark, landing_path, asset)

    return {
        "activities": bronze_distinct(land("activities")),
        "splits": bronze_distinct(land("splits")),
        "activity_details": bronze_distinct(land("activity_details")),
        "workouts": bronze_workouts(land("workouts")),
    }


def models_from_landing(spark: SparkSession, landing_path: str) -> TrainingModels:
    b = bronze_tables(spark, landing_path)
    return TrainingModels(b["activities"], b["splits"], b["activity_details"], b["workouts"])


def quality_report(models: TrainingModels, bronze: dict[str, DataFrame] | None = None) -> DataFrame:
    tables = dict(bronze or {})
    for name in TrainingModels.MODEL_ORDER:
        tables[name] = getattr(models, name)
    return run_checks(tables)


def build_all(
    spark: SparkSession,
    landing_path: str,
    root: str,
    lookback_days: int = 0,
    full_refresh: bool = False,
    latest: bool = True,
) -> dict[str, str]:
    """Bronze under ``root/bronze``, silver and gold under ``root``; returns the tables' paths."""
    bronze_root = f"{root.rstrip('/')}/bronze"
    paths = build_bronze(spark, landing_path, bronze_root, lookback_days, full_refresh, latest)
    b = stored_bronze(spark, landing_path, bronze_root)
    models = TrainingModels(*(b[n] for n in TrainingModels.SOURCES))
    return {**paths, **incremental_build(spark, models, root, lookback_days, full_refresh)}


def stored_quality_report(spark: SparkSession, root: str) -> DataFrame:
    """The schema tests over the stored tables under ``root``; the two views are made from them."""
    base = root.rstrip("/")
    tables = {n: spark.read.parquet(f"{base}/bronze/{n}") for n in BRONZE_TABLES}
    models = TrainingModels(*(tables[n] for n in TrainingModels.SOURCES))
    for name in TABLE_MODELS:
        models.__dict__[name] = spark.read.parquet(f"{base}/{name}")
    return quality_report(models, tables)
