"""Silver models: typed, running-only analytics tables.

Each model is a function from input DataFrames to a DataFrame; nothing is
executed until an action. Joins against dimension-like inputs (trainings,
planned workout steps) are plain joins: AQE broadcasts a side whose measured
bytes allow it and splits skewed keys otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cast_int_half_even, format_duration, format_pace_from_speed, round2

# Sensor metrics kept by the pivot, and their output names.
PIVOT_METRICS = (
    ("directTimestamp", "timestamp_raw"),
    ("sumDistance", "distance_m"),
    ("sumDuration", "duration_sec"),
    ("sumElapsedDuration", "elapsed_duration_sec"),
    ("sumMovingDuration", "moving_duration_sec"),
    ("directSpeed", "speed_mps"),
    ("directHeartRate", "heart_rate_bpm"),
)
WARMUP_COOLDOWN = ("warmup", "cooldown")


# ---------------------------------------------------------------------------
# running_trainings
# ---------------------------------------------------------------------------
def running_trainings(activities: DataFrame) -> DataFrame:
    """Running activities, renamed, with km, m:ss duration and pace text."""
    return activities.filter(F.col("activity_type") == "running").select(
        "activity_id",
        "start_time_gmt",
        F.col("distance").alias("distance_m"),
        round2(F.col("distance") / F.lit(1000.0)).alias("distance_km"),
        F.col("duration").alias("duration_sec"),
        format_duration("duration").alias("duration_min"),
        F.col("average_speed").alias("average_speed_ms"),
        "average_hr",
        "has_splits",
        "device_id",
        "workout_id",
        F.to_date("run_date").alias("run_date"),
        format_pace_from_speed("average_speed").alias("training_pace"),
        F.col("device_id").isNotNull().alias("include_hr"),
    )


# ---------------------------------------------------------------------------
# running_splits
# ---------------------------------------------------------------------------
def running_splits(splits: DataFrame, trainings: DataFrame) -> DataFrame:
    """Laps of running activities, with the parent's workout_id/include_hr."""
    parent = trainings.select("activity_id", "workout_id", "include_hr")
    s = splits.alias("s")
    joined = s.join(parent.alias("a"), F.col("s.activity_id") == F.col("a.activity_id"), "inner")
    return joined.select(
        F.col("s.activity_id").alias("activity_id"),
        F.col("s.start_time_gmt").alias("start_time_gmt"),
        F.lower("s.intensity_type").alias("step_type"),
        F.col("s.distance").alias("distance_m"),
        F.col("s.duration").alias("duration_sec"),
        F.col("s.average_speed").alias("average_speed_ms"),
        F.col("s.average_hr").alias("average_hr"),
        F.col("s.message_index").alias("split_index"),
        F.col("a.workout_id").alias("workout_id"),
        F.col("s.workout_step_index").alias("workout_step_index"),
        F.to_date("s.run_date").alias("run_date"),
        format_pace_from_speed("s.average_speed").alias("split_pace"),
        F.col("a.include_hr").alias("include_hr"),
    )


# ---------------------------------------------------------------------------
# running_activity_details (metric pivot)
# ---------------------------------------------------------------------------
def metric_pivot(details: DataFrame) -> DataFrame:
    """Long (activity, measurement, key, value) -> one row per measurement.

    One conditional maximum per key: a partial aggregate and one exchange of the samples. The key
    filter runs before the shuffle (and reaches the scan when it can).
    """
    keys = [k for k, _ in PIVOT_METRICS]
    base = details.filter(F.col("metric_key").isin(*keys)).select(
        "activity_id",
        "measurement_index",
        "metric_key",
        "metric_value",
        F.to_date("run_date").alias("run_date"),
    )
    pivoted = base.groupBy("activity_id", "measurement_index", "run_date").agg(
        *[F.max(F.when(F.col("metric_key") == k, F.col("metric_value"))).alias(k) for k in keys]
    )
    return pivoted.select(
        "activity_id",
        "measurement_index",
        "run_date",
        *[F.col(k).alias(name) for k, name in PIVOT_METRICS],
    )


def running_activity_details(details: DataFrame, trainings: DataFrame) -> DataFrame:
    """Pivoted sensor samples of running activities.

    The reference joins to trainings and keeps only the sample columns; with
    activity_id unique in trainings that is a semi join, which never
    duplicates rows.
    """
    running_ids = trainings.select("activity_id")
    kept = details.join(running_ids, "activity_id", "left_semi")
    return metric_pivot(kept)


# ---------------------------------------------------------------------------
# running_derived_splits (per-kilometre buckets)
# ---------------------------------------------------------------------------
def km_bucket_agg(details_silver: DataFrame) -> DataFrame:
    """Per (activity, km bucket): mean speed, mean HR, and the last sample.

    One partial aggregation replaces the reference's row_number endpoint
    CTE plus two joins: ``max_by`` picks the sample with the highest
    measurement_index.
    """
    base = details_silver.filter((F.col("distance_m") > 0) & (F.col("speed_mps") > 0)).withColumn(
        "distance_km_bucket", F.ceil(F.col("distance_m") / F.lit(1000.0)).cast("int")
    )
    return base.groupBy("activity_id", "distance_km_bucket").agg(
        F.avg("speed_mps").alias("avg_speed_mps"),
        F.avg("heart_rate_bpm").alias("avg_heart_rate_bpm"),
        F.max_by(
            F.struct(F.col("moving_duration_sec").alias("moving"), F.col("run_date").alias("run_date")),
            F.col("measurement_index"),
        ).alias("_last"),
    )


def running_derived_splits(details_silver: DataFrame) -> DataFrame:
    buckets = km_bucket_agg(details_silver)
    # The window runs over the bucket table (one row per km), so even an
    # activity with a huge number of samples has a small partition here.
    w = Window.partitionBy("activity_id").orderBy("distance_km_bucket")
    moving = F.col("_last.moving")
    split_duration = moving - F.coalesce(F.lag(moving).over(w), F.lit(0.0))
    out = buckets.select(
        "activity_id",
        F.col("_last.run_date").alias("run_date"),
        "distance_km_bucket",
        split_duration.alias("split_duration_sec"),
        "avg_speed_mps",
        "avg_heart_rate_bpm",
    )
    return out.select(
        "*",
        format_duration("split_duration_sec").alias("split_duration_min"),
        format_pace_from_speed("avg_speed_mps").alias("split_pace"),
    )


# ---------------------------------------------------------------------------
# running_workouts (planned steps from nested JSON)
# ---------------------------------------------------------------------------
def _step_fields(nested: bool) -> list[T.StructField]:
    fields = [
        T.StructField("type", T.StringType()),
        T.StructField("stepOrder", T.DoubleType()),
        T.StructField("stepType", T.StructType([T.StructField("stepTypeKey", T.StringType())])),
        T.StructField("numberOfIterations", T.DoubleType()),
        T.StructField("endCondition", T.StructType([T.StructField("conditionTypeKey", T.StringType())])),
        T.StructField("endConditionValue", T.DoubleType()),
        T.StructField("targetType", T.StructType([T.StructField("workoutTargetTypeKey", T.StringType())])),
        T.StructField("targetValueOne", T.DoubleType()),
        T.StructField("targetValueTwo", T.DoubleType()),
    ]
    if nested:
        fields.append(T.StructField("workoutSteps", T.ArrayType(T.StructType(_step_fields(False)))))
    return fields


SEGMENTS_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("segmentOrder", T.DoubleType()),
            T.StructField("workoutSteps", T.ArrayType(T.StructType(_step_fields(True)))),
        ]
    )
)


def _step_struct(step, nested: bool):
    """The attributes of one planned step; ``step`` is a Column of the parsed step."""
    iterations = F.lit(None).cast("int") if nested else cast_int_half_even(step["numberOfIterations"])
    return F.struct(
        cast_int_half_even(step["stepOrder"]).alias("step_order"),
        iterations.alias("number_of_iterations"),
        step["type"].alias("step_dto_type"),
        step["stepType"]["stepTypeKey"].alias("step_type"),
        step["endCondition"]["conditionTypeKey"].alias("end_condition_type_key"),
        step["endConditionValue"].alias("end_condition_value"),
        step["targetType"]["workoutTargetTypeKey"].alias("target_type"),
        step["targetValueOne"].alias("target_value_one"),
        step["targetValueTwo"].alias("target_value_two"),
        F.lit(nested).alias("is_nested_step"),
    )


def workout_steps_explode(workouts: DataFrame) -> DataFrame:
    """Segments -> top-level steps -> children of repeat groups (depth 2).

    One scan and one typed ``from_json``; every top-level step becomes the array of itself and its
    children, so generators replace the union and no row is read twice. A NULL
    or missing array yields no rows, like the lateral ``json_each``.
    """
    parsed = workouts.select(
        "workout_id",
        "workout_name",
        F.explode(F.from_json("workout_segments", SEGMENTS_SCHEMA)).alias("seg"),
    )
    top = parsed.select("workout_id", "workout_name", F.explode("seg.workoutSteps").alias("st"))
    st = F.col("st")
    own = F.array(_step_struct(st, nested=False))
    nested = F.when(st["type"] == "RepeatGroupDTO", F.transform(st["workoutSteps"], lambda c: _step_struct(c, nested=True)))
    steps = F.when(nested.isNull(), own).otherwise(F.concat(own, nested))
    return top.select("workout_id", "workout_name", F.inline(steps))


def running_workouts(workouts: DataFrame) -> DataFrame:
    steps = workout_steps_explode(workouts)
    goal = F.col("end_condition_type_key")
    pace_zone = F.col("target_type") == "pace.zone"
    executable = F.col("step_dto_type") == "ExecutableStepDTO"
    return steps.select(
        "workout_id",
        "workout_name",
        "step_order",
        "number_of_iterations",
        "step_type",
        goal.alias("target_goal"),
        F.when(goal == "distance", F.col("end_condition_value")).alias("target_distance_m"),
        F.when(goal == "time", F.col("end_condition_value")).alias("target_time_sec"),
        F.when(pace_zone, format_pace_from_speed("target_value_one")).alias("target_pace_lower_range"),
        F.when(pace_zone, format_pace_from_speed("target_value_two")).alias("target_pace_upper_range"),
        # Index of the lap the device records for this step. The formula is
        # the original pipeline's; it is exact for a single repeat block.
        F.when(executable & ~F.col("is_nested_step"), F.col("step_order") - 1)
        .when(executable & F.col("is_nested_step"), F.col("step_order") - 2)
        .alias("garmin_step_index"),
    )


# ---------------------------------------------------------------------------
# running_workout_results (executed vs planned)
# ---------------------------------------------------------------------------
def warmup_cooldown_agg(run_splits: DataFrame) -> DataFrame:
    return (
        run_splits.filter(F.col("step_type").isin(*WARMUP_COOLDOWN))
        .groupBy("activity_id", "workout_id", "run_date", "step_type", "workout_step_index")
        .agg(
            F.avg("average_speed_ms").alias("average_speed_ms"),
            F.max("split_index").alias("split_index"),
            F.sum("duration_sec").alias("duration_sec"),
            F.sum("distance_m").alias("distance_m"),
            F.avg("average_hr").alias("average_hr"),
        )
    )


PLANNED_STEP_COLUMNS = (
    "workout_id",
    "garmin_step_index",
    "workout_name",
    "step_type",
    "target_goal",
    "target_distance_m",
    "target_time_sec",
    "target_pace_lower_range",
    "target_pace_upper_range",
)


def workout_interval_match(run_splits: DataFrame, planned: DataFrame) -> DataFrame:
    """Laps matched to planned steps on (workout_id, lap index).

    The steps come out of generators over parsed JSON: Spark takes them for as small as the plans' table and would
    collect all of them on the driver to broadcast them. They are shuffled; AQE splits a workout with many laps.
    """
    steps = planned.select(*PLANNED_STEP_COLUMNS).hint("merge").alias("w")
    s = run_splits.filter(~F.col("step_type").isin(*WARMUP_COOLDOWN)).alias("s")
    cond = (F.col("s.workout_id") == F.col("w.workout_id")) & (
        F.col("s.workout_step_index") == F.col("w.garmin_step_index")
    )
    return s.join(steps, cond, "inner").select(
        F.col("s.activity_id").alias("activity_id"),
        F.col("s.run_date").alias("run_date"),
        F.col("s.workout_id").alias("workout_id"),
        F.col("w.workout_name").alias("workout_name"),
        F.col("s.distance_m").alias("distance_m"),
        F.col("s.duration_sec").alias("duration_sec"),
        F.col("s.split_index").alias("split_index"),
        F.col("s.split_pace").alias("split_pace"),
        F.col("s.workout_step_index").alias("workout_step_index"),
        F.col("w.step_type").alias("step_type"),
        F.col("w.target_goal").alias("target_goal"),
        F.col("w.target_distance_m").alias("target_distance_m"),
        F.col("w.target_time_sec").alias("target_time_sec"),
        F.col("w.target_pace_lower_range").alias("target_pace_lower_range"),
        F.col("w.target_pace_upper_range").alias("target_pace_upper_range"),
        F.col("s.average_hr").alias("average_hr"),
    )


def workout_names(planned: DataFrame) -> DataFrame:
    """workout_id -> its single name; a workout with two names fails the job.

    Same contract as a scalar subquery returning more than one row, but as
    one partial aggregation instead of a correlated lookup.
    """
    agg = planned.groupBy("workout_id").agg(
        F.count_distinct("workout_name").alias("_names"), F.min("workout_name").alias("_name")
    )
    return agg.select(
        "workout_id",
        F.when(
            F.col("_names") > 1,
            F.raise_error(F.concat(F.lit("more than one workout_name for workout_id "), F.col("workout_id").cast("string"))),
        )
        .otherwise(F.col("_name"))
        .cast("string")
        .alias("workout_name"),
    )


def running_workout_results(run_splits: DataFrame, planned: DataFrame) -> DataFrame:
    # Both branches start from the same projection of the laps, so their
    # upstream plans are identical and the shuffle feeding them is computed
    # once and reused (AQE stage cache) instead of once per branch.
    run_splits = run_splits.select(
        "activity_id", "workout_id", "run_date", "step_type", "workout_step_index", "average_speed_ms",
        "split_index", "split_pace", "duration_sec", "distance_m", "average_hr",
    )
    wc = warmup_cooldown_agg(run_splits)
    steps = planned.select(*PLANNED_STEP_COLUMNS)
    names = workout_names(steps)
    is_warmup = F.col("step_type") == "warmup"
    # Laps outside workouts have no id to join by: a key of their own spreads them over all tasks.
    key = F.coalesce(F.col("workout_id").cast("string"), F.concat(F.lit("none "), F.col("activity_id").cast("string")))
    named = names.select(F.col("workout_id").cast("string").alias("_name_key"), "workout_name").hint("merge")
    wc_rows = wc.withColumn("_key", key).join(named, F.col("_key") == F.col("_name_key"), "left").select(
        "activity_id",
        "workout_id",
        "run_date",
        "workout_name",
        "distance_m",
        "duration_sec",
        F.when(is_warmup, F.lit(0).cast("bigint")).otherwise(F.col("split_index")).alias("split_index"),
        format_pace_from_speed("average_speed_ms").alias("split_pace"),
        F.when(is_warmup, F.lit(0).cast("bigint"))
        .otherwise(F.col("workout_step_index"))
        .alias("workout_step_index"),
        "step_type",
        F.lit(None).cast("string").alias("target_goal"),
        F.lit(None).cast("double").alias("target_distance_m"),
        F.lit(None).cast("double").alias("target_time_sec"),
        F.lit(None).cast("string").alias("target_pace_lower_range"),
        F.lit(None).cast("string").alias("target_pace_upper_range"),
        "average_hr",
    )
    matched = workout_interval_match(run_splits, steps).select(*wc_rows.columns)
    u = wc_rows.unionByName(matched)
    return u.select(
        "activity_id",
        "workout_id",
        "run_date",
        "workout_name",
        "distance_m",
        round2(F.col("distance_m") / F.lit(1000.0)).alias("distance_km"),
        "duration_sec",
        format_duration("duration_sec").alias("duration_min"),
        "split_index",
        "split_pace",
        "workout_step_index",
        "step_type",
        "target_goal",
        "target_distance_m",
        round2(F.col("target_distance_m") / F.lit(1000.0)).alias("target_distance_km"),
        "target_time_sec",
        format_duration("target_time_sec").alias("target_time_min"),
        "target_pace_lower_range",
        "target_pace_upper_range",
        "average_hr",
    )
