"""The model graph: bronze -> silver -> gold, wired lazily.

``TrainingModels`` takes the four source frames (landing tables or the
derived fixture tables) and exposes every model as a cached property. Only
the DataFrame plans are cached -- nothing is computed until an action -- so
asking for one gold table builds exactly its upstream plan.

``materialize`` writes chosen models as parquet tables and re-reads them,
which is how a full build cuts lineage between layers (and survives lost
executors: downstream stages recompute from the written table).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from . import gold, silver


class TrainingModels:
    """Source frames may be DataFrames or zero-argument loaders (built on first use)."""

    SOURCES = ("activities", "splits", "activity_details", "workouts")

    def __init__(
        self,
        activities: DataFrame | Callable[[], DataFrame],
        splits: DataFrame | Callable[[], DataFrame],
        activity_details: DataFrame | Callable[[], DataFrame],
        workouts: DataFrame | Callable[[], DataFrame],
        lap_tasks: Callable[[], int] | None = None,
    ) -> None:
        # how many tasks share the laps, where their number is known
        self._lap_tasks = lap_tasks
        self._sources = dict(zip(self.SOURCES, (activities, splits, activity_details, workouts)))

    def _source(self, name: str) -> DataFrame:
        src = self._sources[name]
        if not isinstance(src, DataFrame):
            src = src()
            self._sources[name] = src
        return src

    @property
    def activities(self) -> DataFrame:
        return self._source("activities")

    @property
    def splits(self) -> DataFrame:
        return self._source("splits")

    @property
    def activity_details(self) -> DataFrame:
        return self._source("activity_details")

    @property
    def workouts(self) -> DataFrame:
        return self._source("workouts")

    @classmethod
    def from_fixtures(cls, spark: SparkSession, sf_dir: str) -> "TrainingModels":
        from ..sources import fixtures
        from ..sources.tables import read_table, tasks_for

        return cls(
            lambda: fixtures.activities(spark, sf_dir),
            lambda: fixtures.splits(spark, sf_dir),
            lambda: fixtures.activity_details(spark, sf_dir),
            lambda: fixtures.workouts(spark, sf_dir),
            lambda: tasks_for(read_table(spark, sf_dir, "lineitem")),
        )

    # silver -----------------------------------------------------------------
    @cached_property
    def running_trainings(self) -> DataFrame:
        return silver.running_trainings(self.activities)

    @cached_property
    def running_splits(self) -> DataFrame:
        return silver.running_splits(self.splits, self.running_trainings)

    @cached_property
    def running_activity_details(self) -> DataFrame:
        return silver.running_activity_details(self.activity_details, self.running_trainings)

    @cached_property
    def running_derived_splits(self) -> DataFrame:
        return silver.running_derived_splits(self.running_activity_details)

    @cached_property
    def running_workouts(self) -> DataFrame:
        return silver.running_workouts(self.workouts)

    @cached_property
    def running_workout_results(self) -> DataFrame:
        return silver.running_workout_results(self.running_splits, self.running_workouts)

    # gold -------------------------------------------------------------------
    @cached_property
    def running_trainings_summary(self) -> DataFrame:
        return gold.running_trainings_summary(self.running_trainings)

    @cached_property
    def running_derived_splits_summary(self) -> DataFrame:
        return gold.running_derived_splits_summary(self.running_derived_splits, self.running_trainings_summary)

    @cached_property
    def running_workout_results_summary(self) -> DataFrame:
        tasks = self._lap_tasks() if self._lap_tasks else None
        return gold.running_workout_results_summary(self.running_workout_results, self.running_trainings_summary, tasks)

    @cached_property
    def running_summary(self) -> DataFrame:
        return gold.running_summary(self.running_workout_results_summary, self.running_derived_splits_summary)

    @cached_property
    def running_workout_summary(self) -> DataFrame:
        return gold.running_workout_summary(self.running_workouts)

    @cached_property
    def latest_training_context(self) -> DataFrame:
        return gold.latest_training_context(self.running_trainings_summary)

    MODEL_ORDER = (
        "running_trainings",
        "running_splits",
        "running_activity_details",
        "running_derived_splits",
        "running_workouts",
        "running_workout_results",
        "running_trainings_summary",
        "running_derived_splits_summary",
        "running_workout_results_summary",
        "running_summary",
        "running_workout_summary",
    )

    def materialize(self, spark: SparkSession, root: str, names: tuple[str, ...] | None = None) -> dict[str, str]:
        """Write models in dependency order; downstream models read the written tables."""
        written: dict[str, str] = {}
        for name in names or self.MODEL_ORDER:
            path = f"{root.rstrip('/')}/{name}"
            getattr(self, name).write.mode("overwrite").parquet(path)
            # Re-point the cached plan at the written table: later models
            # read it instead of recomputing the upstream lineage.
            self.__dict__[name] = spark.read.parquet(path)
            written[name] = path
        return written
