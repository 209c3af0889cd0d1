"""Gold models: readable training summaries.

String aggregation is ``listagg ... WITHIN GROUP (ORDER BY ...)``, a partial
aggregate. Every group it builds is small by construction: the laps of one
step of one activity, the steps of one activity, the km buckets of one
activity, the repeat blocks of one workout plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (
    NEWLINE,
    cast_int_half_even,
    concat_skip_nulls,
    listagg_ordered,
    round2,
)


def running_trainings_summary(trainings: DataFrame) -> DataFrame:
    return trainings.select(
        "activity_id",
        "workout_id",
        F.col("run_date").cast("date").alias("run_date"),
        concat_skip_nulls(
            F.lit("Total distance: "),
            F.col("distance_km").cast("string"),
            F.lit(" km, time: "),
            F.col("duration_min").cast("string"),
        ).alias("training_summary"),
    )


def latest_training_context(trainings_summary: DataFrame) -> DataFrame:
    """One row: ``Latest run on {date}: {summary}`` for the newest activity.

    ``max_by`` over (run_date, activity_id) is a global partial aggregate
    (one row per task crosses the network) and always yields exactly one
    row, so the empty case falls out as NULL -> the fixed fallback text.
    """
    order = F.struct(F.col("run_date"), F.col("activity_id"))
    best = trainings_summary.agg(
        F.max_by(F.struct("run_date", "training_summary"), order).alias("b")
    )
    text = F.concat(
        F.lit("Latest run on "),
        F.col("b.run_date").cast("string"),
        F.lit(": "),
        F.col("b.training_summary"),
    )
    return best.select(
        F.when(F.col("b").isNull(), F.lit("No training summary available."))
        .otherwise(text)
        .alias("training_context")
    )


def _summaries_join(per_activity: DataFrame, trainings_summary: DataFrame, with_workout: bool) -> DataFrame:
    cond = F.col("workout_id").isNotNull() if with_workout else F.col("workout_id").isNull()
    tr = trainings_summary.filter(cond).select("activity_id", "run_date", "training_summary")
    return per_activity.join(tr, "activity_id", "inner").select(
        "activity_id", "run_date", "full_summary", "training_summary"
    )


def running_derived_splits_summary(derived_splits: DataFrame, trainings_summary: DataFrame) -> DataFrame:
    lines = derived_splits.select(
        "activity_id",
        "distance_km_bucket",
        concat_skip_nulls(
            F.col("distance_km_bucket").cast("string"),
            F.lit(" km: "),
            F.col("split_pace"),
            F.lit(" pace."),
        ).alias("split_summary"),
    )
    per_activity = lines.groupBy("activity_id").agg(
        listagg_ordered("split_summary", NEWLINE, "distance_km_bucket").alias("full_summary")
    )
    return _summaries_join(per_activity, trainings_summary, with_workout=False)


def workout_split_line(results: DataFrame) -> DataFrame:
    """One text line per executed lap (NULL for laps with no line, e.g. recovery)."""
    km = round2(F.col("distance_m") / F.lit(1000.0)).cast("string")
    st = F.col("step_type")
    line = (
        F.when(st == "warmup", concat_skip_nulls(F.lit("Warmup: "), km, F.lit(" km for "), F.col("split_pace")))
        .when(st == "cooldown", concat_skip_nulls(F.lit("Cooldown: "), km, F.lit(" km for "), F.col("split_pace")))
        .when(
            st == "interval",
            concat_skip_nulls(
                F.lit("pace "), F.col("split_pace"), F.lit(", distance: "),
                F.col("distance_km").cast("string"), F.lit(" km."),
            ),
        )
    )
    return results.withColumn("split_summary", line)


def running_workout_results_summary(results: DataFrame, trainings_summary: DataFrame, tasks: int | None = None) -> DataFrame:
    """One text per activity with a workout, its steps in order.

    ``tasks``: how many tasks share the laps, which then are exchanged once, by activity, for both aggregations and
    the join.
    """
    lines = workout_split_line(results)
    if tasks:
        lines = lines.repartition(tasks, "activity_id")
    group_keys = [
        "activity_id",
        "workout_id",
        "run_date",
        "workout_step_index",
        "target_goal",
        "target_time_min",
        "target_distance_km",
        "target_pace_lower_range",
        "target_pace_upper_range",
    ]
    per_step = lines.groupBy(*group_keys).agg(
        listagg_ordered("split_summary", NEWLINE, "split_index").alias("_laps")
    )
    goal = F.col("target_goal")
    target_text = concat_skip_nulls(
        F.lit("Target: "),
        F.when(goal == "time", concat_skip_nulls(F.col("target_time_min"), F.lit(" min")))
        .when(goal == "distance", concat_skip_nulls(F.col("target_distance_km").cast("string"), F.lit(" km")))
        .otherwise(F.lit(" NULL ")),
        F.when(
            F.col("target_pace_lower_range").isNotNull() & F.col("target_pace_upper_range").isNotNull(),
            concat_skip_nulls(
                F.lit(" (target pace "), F.col("target_pace_lower_range"), F.lit(" - "),
                F.col("target_pace_upper_range"), F.lit(")"),
            ),
        ).otherwise(F.lit("")),
    )
    target_summary = F.when(goal.isNotNull(), target_text).otherwise(F.lit(""))
    actual_prefix = F.when(goal.isNotNull(), F.lit(NEWLINE + "Actual: " + NEWLINE)).otherwise(F.lit(""))
    steps = per_step.select(
        "activity_id",
        "workout_id",
        "run_date",
        "workout_step_index",
        concat_skip_nulls(target_summary, concat_skip_nulls(actual_prefix, F.col("_laps"))).alias("step_text"),
    )
    per_activity = steps.groupBy("activity_id", "workout_id", "run_date").agg(
        listagg_ordered("step_text", NEWLINE + NEWLINE, "workout_step_index").alias("full_summary")
    )
    return _summaries_join(per_activity.drop("workout_id", "run_date"), trainings_summary, with_workout=True)


def running_summary(workout_results_summary: DataFrame, derived_splits_summary: DataFrame) -> DataFrame:
    return workout_results_summary.unionByName(derived_splits_summary)


def repeat_next_boundary(planned: DataFrame) -> DataFrame:
    """Per repeat step: the step_order of the next repeat step (NULL if last).

    ``lead`` over the repeat rows of each workout replaces the theta
    self-join with ``min``; equal because step_order is unique per workout.
    """
    reps = planned.filter(F.col("step_type") == "repeat")
    w = Window.partitionBy("workout_id").orderBy("step_order")
    return reps.select(
        "workout_id",
        "workout_name",
        F.col("step_order").alias("repeat_step_order"),
        "number_of_iterations",
        F.lead("step_order").over(w).alias("next_repeat_step_order"),
    )


def repeat_blocks(planned: DataFrame) -> DataFrame:
    """Interval/recovery targets of each repeat block.

    A step belongs to the most recent repeat step before it (a running
    ``last(..., ignorenulls)`` over the plan's steps) -- the window form of
    the range join "after this repeat and before the next one".
    """
    is_repeat = F.col("step_type") == "repeat"
    before = (
        Window.partitionBy("workout_id")
        .orderBy("step_order")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    owner = F.when(is_repeat, F.col("step_order")).otherwise(
        F.last(F.when(is_repeat, F.col("step_order")), ignorenulls=True).over(before)
    )
    tagged = planned.withColumn("_block", owner).filter(F.col("_block").isNotNull())
    st = F.col("step_type")

    def member(kind: str, c: str):
        return F.max(F.when(st == kind, F.col(c)))

    blocks = tagged.groupBy("workout_id", "_block").agg(
        F.max(F.when(is_repeat, F.col("workout_name"))).alias("workout_name"),
        F.max(F.when(is_repeat, F.col("number_of_iterations"))).alias("number_of_iterations"),
        F.max(F.when(is_repeat, F.lit(1))).alias("_has_repeat"),
        member("interval", "target_distance_m").alias("interval_distance_m"),
        member("interval", "target_time_sec").alias("interval_time_sec"),
        member("interval", "target_pace_lower_range").alias("interval_pace_lower_range"),
        member("interval", "target_pace_upper_range").alias("interval_pace_upper_range"),
        member("recovery", "target_distance_m").alias("recovery_distance_m"),
        member("recovery", "target_time_sec").alias("recovery_time_sec"),
    )
    return blocks.filter(F.col("_has_repeat") == 1).drop("_has_repeat").withColumnRenamed(
        "_block", "repeat_step_order"
    )


def running_workout_summary(planned: DataFrame) -> DataFrame:
    b = repeat_blocks(planned)

    def whole(c: str):
        return cast_int_half_even(c).cast("string")

    effort = (
        F.when(F.col("interval_distance_m").isNotNull(), F.concat(whole("interval_distance_m"), F.lit("m")))
        .when(F.col("interval_time_sec").isNotNull(), F.concat(whole("interval_time_sec"), F.lit("sec")))
        .otherwise(F.lit("!ERROR!"))
    )
    recovery = (
        F.when(
            F.col("recovery_distance_m").isNotNull(),
            F.concat(F.lit(" with "), whole("recovery_distance_m"), F.lit("m recovery")),
        )
        .when(
            F.col("recovery_time_sec").isNotNull(),
            F.concat(F.lit(" with "), whole("recovery_time_sec"), F.lit("s recovery")),
        )
        .otherwise(F.lit(""))
    )
    pace = F.when(
        F.col("interval_pace_lower_range").isNotNull() & F.col("interval_pace_upper_range").isNotNull(),
        F.concat(F.lit(" @ "), F.col("interval_pace_lower_range"), F.lit("-"), F.col("interval_pace_upper_range")),
    ).otherwise(F.lit(""))
    described = b.select(
        "workout_id",
        "workout_name",
        "repeat_step_order",
        concat_skip_nulls(
            F.col("number_of_iterations").cast("string"), F.lit(" x "), effort, recovery, pace
        ).alias("repeat_description"),
    )
    return described.groupBy("workout_id", "workout_name").agg(
        listagg_ordered("repeat_description", NEWLINE, "repeat_step_order").alias("workout_summary")
    )

