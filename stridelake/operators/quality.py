"""Data-quality tests as queries.

Each test returns its failing rows (as the schema tests of the original
project do). ``run_checks`` reports one row per test with the failure count, and
reads each model as seldom as it can: one grouped pass per key set counts the rows of each key, and the
uniqueness, not-null and relationships tests of these columns are all read off these counts; the not-null
tests of other columns share one aggregate. Counts are partial aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dq_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def dq_unique(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_records"))
        .filter(F.col("n_records") > 1)
    )


def dq_unique_combination(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_records")).filter(F.col("n_records") > 1)


def dq_relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


@dataclass(frozen=True)
class Check:
    model: str
    test: str  # not_null | unique | unique_combination | relationships
    columns: tuple[str, ...]
    parent: str | None = None
    parent_column: str | None = None


def _c(model: str, test: str, *cols: str, parent: str | None = None, parent_column: str | None = None) -> Check:
    return Check(model, test, tuple(cols), parent, parent_column)


# The 37 schema tests of the model layer (model, test, columns).
CHECKS: tuple[Check, ...] = (
    _c("activities", "not_null", "activity_id"),
    _c("activities", "unique", "activity_id"),
    _c("splits", "unique_combination", "activity_id", "message_index"),
    _c("activity_details", "unique_combination", "activity_id", "measurement_index", "metric_index"),
    _c("workouts", "unique", "workout_id"),
    _c("workouts", "not_null", "workout_id"),
    _c("running_trainings", "not_null", "activity_id"),
    _c("running_trainings", "unique", "activity_id"),
    _c("running_splits", "unique_combination", "activity_id", "split_index"),
    _c("running_splits", "not_null", "activity_id"),
    _c("running_splits", "relationships", "activity_id", parent="running_trainings", parent_column="activity_id"),
    _c("running_splits", "not_null", "split_index"),
    _c("running_derived_splits", "unique_combination", "activity_id", "distance_km_bucket"),
    _c("running_derived_splits", "not_null", "activity_id"),
    _c("running_derived_splits", "relationships", "activity_id", parent="running_trainings", parent_column="activity_id"),
    _c("running_derived_splits", "not_null", "distance_km_bucket"),
    _c("running_activity_details", "unique_combination", "activity_id", "measurement_index"),
    _c("running_activity_details", "not_null", "activity_id"),
    _c("running_activity_details", "relationships", "activity_id", parent="running_trainings", parent_column="activity_id"),
    _c("running_activity_details", "not_null", "measurement_index"),
    _c("running_workouts", "unique_combination", "workout_id", "step_order"),
    _c("running_workouts", "not_null", "workout_id"),
    _c("running_workouts", "not_null", "step_order"),
    _c("running_workout_results", "unique_combination", "activity_id", "split_index"),
    _c("running_workout_results", "not_null", "activity_id"),
    _c("running_workout_results", "relationships", "activity_id", parent="running_trainings", parent_column="activity_id"),
    _c("running_workout_results", "not_null", "split_index"),
    _c("running_trainings_summary", "not_null", "activity_id"),
    _c("running_trainings_summary", "unique", "activity_id"),
    _c("running_derived_splits_summary", "not_null", "activity_id"),
    _c("running_derived_splits_summary", "unique", "activity_id"),
    _c("running_workout_results_summary", "not_null", "activity_id"),
    _c("running_workout_results_summary", "unique", "activity_id"),
    _c("running_summary", "not_null", "activity_id"),
    _c("running_summary", "unique", "activity_id"),
    _c("running_workout_summary", "not_null", "workout_id"),
    _c("running_workout_summary", "unique", "workout_id"),
)


def failing_rows(check: Check, tables: dict[str, DataFrame]) -> DataFrame:
    df = tables[check.model]
    if check.test == "not_null":
        return dq_not_null(df, check.columns[0])
    if check.test == "unique":
        return dq_unique(df, check.columns[0])
    if check.test == "unique_combination":
        return dq_unique_combination(df, list(check.columns))
    if check.test == "relationships":
        return dq_relationships(df, check.columns[0], tables[check.parent], check.parent_column)
    raise ValueError(check.test)


def _report(counted: DataFrame, failures: list[tuple[Check, Column]]) -> DataFrame:
    """One row per check from one aggregate."""
    one = counted.agg(*[F.coalesce(F.sum(f), F.lit(0)).cast("bigint").alias(f"f{i}") for i, (_, f) in enumerate(failures)])
    rows = [
        F.struct(
            F.lit(ch.model).alias("model"), F.lit(ch.test).alias("test"),
            F.lit(",".join(ch.columns)).alias("column_name"), F.col(f"f{i}").alias("failures"),
        )
        for i, (ch, _) in enumerate(failures)
    ]
    return one.select(F.inline(F.array(*rows)))


def _passes(checks: list[Check]) -> list[tuple[tuple[str, ...], list[Check]]]:
    """Key sets of one model, each with the checks that its counts answer; () is the pass without groups."""
    sets = list(dict.fromkeys(ch.columns for ch in checks if ch.test in ("unique", "unique_combination")))
    sets += [c for c in dict.fromkeys(ch.columns for ch in checks if ch.test == "relationships") if not any(c[0] in s for s in sets)]
    of: dict[tuple[str, ...], list[Check]] = {}
    for ch in checks:
        if ch.test in ("unique", "unique_combination"):
            key = ch.columns
        else:
            key = next((s for s in sets if ch.columns[0] in s), ())
        of.setdefault(key, []).append(ch)
    return list(of.items())


def _pass(df: DataFrame, keys: tuple[str, ...], checks: list[Check], tables: dict[str, DataFrame]) -> DataFrame:
    if keys:
        counted = df.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    else:
        used = list(dict.fromkeys(ch.columns[0] for ch in checks))
        keys, counted = tuple(used), df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(used)], F.lit(1).alias("n"))
    col = {k: F.col(f"k{i}") for i, k in enumerate(keys)}
    failures = []
    for i, ch in enumerate(checks):
        c = col[ch.columns[0]]
        if ch.test == "not_null":
            failed = F.when(c.isNull(), F.col("n"))
        elif ch.test == "unique":
            failed = F.when(c.isNotNull() & (F.col("n") > 1), 1)
        elif ch.test == "unique_combination":
            failed = F.when(F.col("n") > 1, 1)
        elif ch.test == "relationships":
            parents = tables[ch.parent].select(F.col(ch.parent_column).alias(f"p{i}")).distinct()
            counted = counted.join(parents, c == F.col(f"p{i}"), "left")
            failed = F.when(c.isNotNull() & F.col(f"p{i}").isNull(), F.col("n"))
        else:
            raise ValueError(ch.test)
        failures.append((ch, failed))
    return _report(counted, failures)


def run_checks(tables: dict[str, DataFrame], checks: tuple[Check, ...] = CHECKS) -> DataFrame:
    """One row per check: model, test, column_name, failures. A check whose table is absent is an error."""
    missing = sorted({t for ch in checks for t in (ch.model, ch.parent) if t is not None and t not in tables})
    if missing:
        raise ValueError(f"tables of the checks are missing: {', '.join(missing)}")
    parts = []
    for model in dict.fromkeys(ch.model for ch in checks):
        for keys, some in _passes([ch for ch in checks if ch.model == model]):
            parts.append(_pass(tables[model], keys, some, tables))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
