"""Training-log tables derived from the driver's TPC-H-like tables.

The pipeline's native inputs (activities, laps, per-second sensor samples,
workout plans, chat messages) are derived here from ``orders``,
``lineitem``, ``events``, ``part`` and ``conversations`` so every model runs
over whole tables whose size grows with the scale factor. FIXTURES.md part B
is the SQL form of the same definitions (used by the DuckDB oracle).

Scale notes:
* ``splits`` numbers lines within an order (<= 17 lines per order at any
  scale factor, so the per-order window is bounded) and joins ``orders`` on
  the same key the window partitions by: one shuffle serves both.
* ``activity_details`` numbers the samples of a user. One user may hold a
  large share of all events, so the numbering uses
  ``ordinal_by_chunk`` (by hour) instead of one window over the whole user.
* The six metrics per sample come from ``explode(sequence(0, 5))``, a
  generator, not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sequence import ordinal_by_chunk
from .tables import ROWS_PER_TASK, read_table, tasks_for


def _date_string(ts: Column) -> Column:
    return F.to_date(ts).cast("string")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(
        spark, sf_dir, "orders",
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    )
    speed_base = F.lit(2.0) + (F.col("o_custkey") % 30) / F.lit(10.0)
    distance = F.col("o_totalprice") / F.lit(20.0)
    return o.select(
        F.col("o_orderkey").alias("activity_id"),
        F.col("o_orderdate").cast("string").alias("start_time_gmt"),
        F.when(F.col("o_orderstatus") == "O", "cycling").otherwise("running").alias("activity_type"),
        distance.alias("distance"),
        (distance / speed_base).alias("duration"),
        F.when(F.col("o_custkey") % 97 == 0, F.lit(0.0)).otherwise(speed_base).alias("average_speed"),
        (F.lit(120.0) + F.col("o_custkey") % 60).alias("average_hr"),
        (F.col("o_custkey") % 2 == 0).alias("has_splits"),
        F.when(F.col("o_custkey") % 7 == 0, F.lit(None).cast("bigint"))
        .otherwise(F.col("o_custkey") % 7)
        .alias("device_id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_custkey") % 50 + 1).alias(
            "workout_id"
        ),
        _date_string(F.col("o_orderdate")).alias("run_date"),
    )


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(
        spark, sf_dir, "lineitem",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"],
        spread_by="l_orderkey",  # the per-order window's own partitioning
    )
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    joined = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    order_w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    # Number the lines on the raw columns; text columns are derived after
    # the window so the shuffle carries narrow rows.
    numbered = joined.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "o_orderdate",
        (F.row_number().over(order_w) - 1).cast("bigint").alias("message_index"),
        F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("n"),
    )
    x = numbered.select(
        F.col("l_orderkey").alias("activity_id"),
        F.col("l_shipdate").cast("string").alias("start_time_gmt"),
        "message_index",
        "n",
        (F.col("l_quantity") * F.lit(50.0)).alias("distance"),
        (F.col("l_quantity") * F.lit(20.0)).alias("duration"),
        (F.lit(2.0) + F.col("l_linenumber") / F.lit(8.0)).alias("average_speed"),
        (F.lit(120.0) + F.col("l_linenumber")).alias("average_hr"),
        _date_string(F.col("o_orderdate")).alias("run_date"),
    )
    mi, n = F.col("message_index"), F.col("n")
    return x.select(
        "activity_id",
        "message_index",
        "start_time_gmt",
        F.when(mi == 0, "WARMUP")
        .when(mi == n - 1, "COOLDOWN")
        .when(mi % 2 == 1, "INTERVAL")
        .otherwise("RECOVERY")
        .alias("intensity_type"),
        F.when(mi == 0, F.lit(0))
        .when(mi == n - 1, F.lit(3))
        .when(mi % 2 == 1, F.lit(1))
        .otherwise(F.lit(2))
        .cast("bigint")
        .alias("workout_step_index"),
        "distance",
        "duration",
        "average_speed",
        "average_hr",
        "run_date",
    )


# ---------------------------------------------------------------------------
# Workout plan templates (tokens @SIZE@, @SIZE10@, @SIZE100@,
# @ITER2@ are replaced from the part row). Variant = p_partkey % 3.
# ---------------------------------------------------------------------------
WORKOUT_TEMPLATES = (
    # 0: distance intervals with pace zone, timed recovery
    '[{"segmentOrder":1,"workoutSteps":['
    '{"type":"ExecutableStepDTO","stepOrder":1,"stepType":{"stepTypeKey":"warmup"},'
    '"endCondition":{"conditionTypeKey":"distance"},"endConditionValue":2000.0,'
    '"targetType":{"workoutTargetTypeKey":"no.target"}},'
    '{"type":"RepeatGroupDTO","stepOrder":2,"stepType":{"stepTypeKey":"repeat"},"numberOfIterations":@SIZE@,'
    '"endCondition":{"conditionTypeKey":"iterations"},"workoutSteps":['
    '{"type":"ExecutableStepDTO","stepOrder":3,"stepType":{"stepTypeKey":"interval"},'
    '"endCondition":{"conditionTypeKey":"distance"},"endConditionValue":@SIZE100@.0,'
    '"targetType":{"workoutTargetTypeKey":"pace.zone"},"targetValueOne":3.5,"targetValueTwo":4.25},'
    '{"type":"ExecutableStepDTO","stepOrder":4,"stepType":{"stepTypeKey":"recovery"},'
    '"endCondition":{"conditionTypeKey":"time"},"endConditionValue":90.0,'
    '"targetType":{"workoutTargetTypeKey":"no.target"}}]},'
    '{"type":"ExecutableStepDTO","stepOrder":5,"stepType":{"stepTypeKey":"cooldown"},'
    '"endCondition":{"conditionTypeKey":"distance"},"endConditionValue":1500.0,'
    '"targetType":{"workoutTargetTypeKey":"no.target"}}]}]',
    # 1: timed intervals with a heart-rate target (ignored), lap-button recovery
    '[{"segmentOrder":1,"workoutSteps":['
    '{"type":"ExecutableStepDTO","stepOrder":1,"stepType":{"stepTypeKey":"warmup"},'
    '"endCondition":{"conditionTypeKey":"time"},"endConditionValue":600.0,'
    '"targetType":{"workoutTargetTypeKey":"no.target"}},'
    '{"type":"RepeatGroupDTO","stepOrder":2,"stepType":{"stepTypeKey":"repeat"},"numberOfIterations":@SIZE@,'
    '"endCondition":{"conditionTypeKey":"iterations"},"workoutSteps":['
    '{"type":"ExecutableStepDTO","stepOrder":3,"stepType":{"stepTypeKey":"interval"},'
    '"endCondition":{"conditionTypeKey":"time"},"endConditionValue":@SIZE10@.0,'
    '"targetType":{"workoutTargetTypeKey":"heart.rate.zone"},"targetValueOne":140.0,"targetValueTwo":160.0},'
    '{"type":"ExecutableStepDTO","stepOrder":4,"stepType":{"stepTypeKey":"recovery"},'
    '"endCondition":{"conditionTypeKey":"lap.button"},'
    '"targetType":{"workoutTargetTypeKey":"no.target"}}]},'
    '{"type":"ExecutableStepDTO","stepOrder":5,"stepType":{"stepTypeKey":"cooldown"},'
    '"endCondition":{"conditionTypeKey":"time"},"endConditionValue":300.0,'
    '"targetType":{"workoutTargetTypeKey":"no.target"}}]}]',
    # 2: two repeat blocks; the second has an interval without a target
    '[{"segmentOrder":1,"workoutSteps":['
    '{"type":"ExecutableStepDTO","stepOrder":1,"stepType":{"stepTypeKey":"warmup"},'
    '"endCondition":{"conditionTypeKey":"distance"},"endConditionValue":1000.0,'
    '"targetType":{"workoutTargetTypeKey":"no.target"}},'
    '{"type":"RepeatGroupDTO","stepOrder":2,"stepType":{"stepTypeKey":"repeat"},"numberOfIterations":4,'
    '"endCondition":{"conditionTypeKey":"iterations"},"workoutSteps":['
    '{"type":"ExecutableStepDTO","stepOrder":3,"stepType":{"stepTypeKey":"interval"},'
    '"endCondition":{"conditionTypeKey":"distance"},"endConditionValue":400.0,'
    '"targetType":{"workoutTargetTypeKey":"pace.zone"},"targetValueOne":4.0,"targetValueTwo":4.5},'
    '{"type":"ExecutableStepDTO","stepOrder":4,"stepType":{"stepTypeKey":"recovery"},'
    '"endCondition":{"conditionTypeKey":"distance"},"endConditionValue":200.0,'
    '"targetType":{"workoutTargetTypeKey":"no.target"}}]},'
    '{"type":"RepeatGroupDTO","stepOrder":5,"stepType":{"stepTypeKey":"repeat"},"numberOfIterations":@ITER2@,'
    '"endCondition":{"conditionTypeKey":"iterations"},"workoutSteps":['
    '{"type":"ExecutableStepDTO","stepOrder":6,"stepType":{"stepTypeKey":"interval"},'
    '"endCondition":{"conditionTypeKey":"lap.button"},'
    '"targetType":{"workoutTargetTypeKey":"no.target"}},'
    '{"type":"ExecutableStepDTO","stepOrder":7,"stepType":{"stepTypeKey":"recovery"},'
    '"endCondition":{"conditionTypeKey":"time"},"endConditionValue":60.0,'
    '"targetType":{"workoutTargetTypeKey":"no.target"}}]},'
    '{"type":"ExecutableStepDTO","stepOrder":8,"stepType":{"stepTypeKey":"cooldown"},'
    '"endCondition":{"conditionTypeKey":"distance"},"endConditionValue":1000.0,'
    '"targetType":{"workoutTargetTypeKey":"no.target"}}]}]',
)


def _plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workout_id and what its plan is rendered from."""
    # Plans are parsed from JSON downstream (CPU-heavy per row): spread a
    # single-split part table over all cores first.
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_size"], spread_by="p_partkey")
    return p.select((F.col("p_partkey") + 1).alias("workout_id"), "p_partkey", "p_size")


def _plan_columns() -> list[Column]:
    """workout_name and workout_segments of ``_plan_rows``."""
    variant = F.col("p_partkey") % 3
    template = (
        F.when(variant == 0, F.lit(WORKOUT_TEMPLATES[0]))
        .when(variant == 1, F.lit(WORKOUT_TEMPLATES[1]))
        .otherwise(F.lit(WORKOUT_TEMPLATES[2]))
    )
    size = F.col("p_size")
    segments = F.replace(template, F.lit("@SIZE100@"), (size * 100).cast("string"))
    segments = F.replace(segments, F.lit("@SIZE10@"), (size * 10).cast("string"))
    segments = F.replace(segments, F.lit("@SIZE@"), size.cast("string"))
    segments = F.replace(segments, F.lit("@ITER2@"), (size % 5 + 2).cast("string"))
    name = F.concat(F.lit("Workout "), (F.col("p_partkey") + 1).cast("string"))
    return [name.alias("workout_name"), segments.alias("workout_segments")]


def workouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_rows(spark, sf_dir).select("workout_id", *_plan_columns())


def plan_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that render the plans in use: at most one use an order, 50,000 texts of 1.5 KB a task."""
    return tasks_for(read_table(spark, sf_dir, "orders", ["o_orderkey"]), ROWS_PER_TASK // 10)


def used_workouts(spark: SparkSession, sf_dir: str, uses: DataFrame, tasks: int | None = None) -> DataFrame:
    """``workouts`` joined to ``uses`` by ``workout_id``.

    The join moves a plan's two numbers; its text is rendered behind it. Both sides are shuffled: Spark takes the
    plans for smaller than they are and would send all of them to each executor through the driver. The uses may be of
    few plans, and adaptive execution sizes the tasks of the join by these numbers, not by the texts: so its
    rows are dealt out by plan and day, to ``tasks`` (default: as many as other shuffles have).
    """
    rows = _plan_rows(spark, sf_dir).hint("merge").join(uses, "workout_id")
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "workout_id", "run_date")
    others = [c for c in uses.columns if c != "workout_id"]
    return rows.select("workout_id", *_plan_columns(), *others)


def workout_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing rows of workouts: one per workout and day it was used."""
    uses = (
        activities(spark, sf_dir).filter(F.col("workout_id").isNotNull()).select("workout_id", "run_date").distinct()
    )
    return used_workouts(spark, sf_dir, uses, plan_tasks(spark, sf_dir)).withColumn("dt", F.to_date("run_date"))


# Sensor metric keys by metric position in the derived samples.
DETAIL_METRIC_KEYS = (
    "directTimestamp",
    "sumDistance",
    "sumMovingDuration",
    "directSpeed",
    "directHeartRate",
    "directCadence",
)


def activity_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id"])
    numbered = ordinal_by_chunk(
        ev, ["user_id"], ["ts", "event_id"], chunk=F.date_trunc("hour", F.col("ts")), name="measurement_index",
        tasks=tasks_for(ev, ROWS_PER_TASK // 6),  # each event becomes six rows
    )
    e = numbered.select(
        F.col("user_id").alias("activity_id"),
        "event_id",
        "measurement_index",
        F.concat(F.lit("2024-01-"), F.lpad((F.col("user_id") % 28 + 1).cast("string"), 2, "0")).alias(
            "run_date"
        ),
    ).withColumn("metric_index", F.explode(F.sequence(F.lit(0), F.lit(5))))
    k = F.col("metric_index")
    mi = F.col("measurement_index").cast("double")
    ev_id = F.col("event_id")
    key = F.when(k == 0, DETAIL_METRIC_KEYS[0])
    for i, name in enumerate(DETAIL_METRIC_KEYS[1:-1], start=1):
        key = key.when(k == i, name)
    key = key.otherwise(DETAIL_METRIC_KEYS[-1])
    value = (
        F.when(k == 0, mi)
        .when(k == 1, mi * F.lit(137.5))
        .when(k == 2, mi * F.lit(45.0))
        .when(
            k == 3,
            F.when(ev_id % 41 == 0, F.lit(0.0)).otherwise(F.lit(2.0) + (ev_id % 16) / F.lit(8.0)),
        )
        .when(k == 4, F.lit(120.0) + ev_id % 60)
        .otherwise(F.lit(1.0))
    )
    return e.select(
        "activity_id",
        "measurement_index",
        F.col("metric_index").cast("int").alias("metric_index"),
        key.alias("metric_key"),
        value.alias("metric_value"),
        "run_date",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return c.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("created_at"),
        "role",
        F.col("text").alias("content"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat sessions, some of which already have a summary of their first messages."""
    ids = read_table(spark, sf_dir, "conversations", ["conv_id"]).distinct()
    n = F.pmod(F.col("conv_id"), F.lit(3)).cast("bigint")
    return ids.select(
        F.col("conv_id").alias("session_id"),
        n.alias("summarized_message_count"),
        F.when(n == 1, F.lit("")).when(n == 2, F.concat(F.lit("Runner "), F.col("conv_id").cast("string"), F.lit(" has a race goal."))).alias("summary"),
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of model runs: every assistant turn's run is started; most are completed, some fail, some have no end yet."""
    m = messages(spark, sf_dir).filter(F.col("role") == "assistant")
    key = F.col("session_id") + F.col("created_at")
    none = F.lit(None).cast("bigint")
    tokens = lambda every, per: F.when(key % every == 0, none).otherwise(F.floor(F.length("content") / F.lit(float(per))).cast("bigint"))
    started = F.struct(
        F.lit("started").alias("status"), F.lit(0).alias("after"), none.alias("prompt_tokens"),
        none.alias("completion_tokens"), none.alias("duration_ms"), F.lit(None).cast("string").alias("error_message"),
    )
    ended = F.when(
        key % 11 == 0,
        F.struct(
            F.lit("failed").alias("status"), F.lit(1).alias("after"), none.alias("prompt_tokens"),
            none.alias("completion_tokens"), (key * 10).alias("duration_ms"), F.lit("provider unavailable").alias("error_message"),
        ),
    ).otherwise(
        F.struct(
            F.lit("completed").alias("status"), F.lit(1).alias("after"), tokens(5, 4).alias("prompt_tokens"),
            tokens(7, 3).alias("completion_tokens"), (key * 10).alias("duration_ms"), F.lit(None).cast("string").alias("error_message"),
        )
    )
    log = F.filter(F.array(ended, started), lambda e: (e["status"] == "started") | (key % 13 != 0))
    e = m.select("session_id", "created_at", F.explode(log).alias("e"))
    return e.select("session_id", "created_at", (F.col("created_at") * 2 + F.col("e.after")).alias("at"), "e.*").drop("after")


def as_landing(df: DataFrame) -> DataFrame:
    """A derived table as a landing table: ``dt`` = the run date partition."""
    return df.withColumn("dt", F.to_date("run_date"))
