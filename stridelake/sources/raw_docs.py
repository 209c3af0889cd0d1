"""Raw JSON documents derived from the driver's tables.

The landing stage consumes vendor payload files. To exercise it on the
given data (sized by the scale factor) these functions render the derived
training-log rows back into payload documents, one row per "file":
``(dt, source_file, value)``.

Each document groups the lines of one order, the samples of one user-hour, or the orders of one day and
priority. The latter grow with the orders of a day, as a list payload does by its contract (one snapshot a
day); ``sources.raw_sink`` and line-wise landing handle such files without holding one whole. A few deterministic rules plant invalid
files (a required field missing) so validation and quarantine have work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .tables import read_table


def _activity_record(local: Column, gmt: Column) -> Column:
    """The payload of one activity, from the activities table joined to its order's ``o_custkey``."""
    return F.struct(
        F.col("activity_id").alias("activityId"),
        local.alias("startTimeLocal"),
        gmt.alias("startTimeGMT"),
        F.concat(F.lit("Run "), F.col("activity_id").cast("string")).alias("activityName"),
        F.struct(F.col("activity_type").alias("typeKey")).alias("activityType"),
        F.col("distance").alias("distance"),
        F.col("duration").alias("duration"),
        F.col("o_custkey").alias("ownerId"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("ownerFullName"),
        F.col("average_speed").alias("averageSpeed"),
        F.col("average_hr").alias("averageHR"),
        F.col("has_splits").alias("hasSplits"),
        F.col("device_id").alias("deviceId"),
        F.col("workout_id").alias("workoutId"),
    )


def _with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    return fixtures.activities(spark, sf_dir).join(
        o.select(F.col("o_orderkey").alias("activity_id"), "o_custkey", "o_orderdate", "o_orderpriority"), "activity_id"
    )


def activity_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(activity_id, payload): raw activities as the vendor returns them, dated by months.

    A fifth has an empty local start (GMT, a month later, files them); some of March 1995 have none, which
    spoils the file of the following month.
    """
    a = _with_orders(spark, sf_dir).withColumn("month", F.trunc(F.to_date("o_orderdate"), "month"))
    local = (
        F.when(F.col("o_custkey") % 5 == 0, F.lit(""))
        .when((F.col("o_custkey") % 5 == 1) & (F.col("month") == F.lit("1995-03-01").cast("date")), F.lit(None))
        .otherwise(F.concat(F.col("month").cast("string"), F.lit(" 07:00:00")))
    )
    gmt = F.concat(F.add_months("month", 1).cast("string"), F.lit(" 05:00:00"))
    return a.select("activity_id", F.to_json(_activity_record(local, gmt)).alias("payload"))


def activity_list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily activity snapshots: one file per (day, priority); the lexically
    last file of a day (priority 5) is the one landing keeps."""
    a = _with_orders(spark, sf_dir)
    local = F.when(F.col("o_custkey") % 53 == 0, F.lit(None)).otherwise(F.col("start_time_gmt"))
    rec = _activity_record(local, F.col("start_time_gmt"))
    files = a.groupBy("run_date", "o_orderpriority").agg(
        F.array_sort(F.collect_list(F.struct(F.col("activity_id").alias("k"), rec.alias("r")))).alias("items")
    )
    return files.select(
        F.col("run_date").alias("dt"),
        F.concat(
            F.lit("activities_"), F.col("run_date"), F.lit("T0"), F.substring("o_orderpriority", 1, 1), F.lit(":00:00.json")
        ).alias("source_file"),
        F.to_json(F.transform("items", lambda x: x["r"])).alias("value"),
    )


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``{activityId, lapDTOs}`` object per activity (<= 17 laps)."""
    s = fixtures.splits(spark, sf_dir)
    start = F.when((F.col("message_index") == 2) & (F.col("distance") >= 2000), F.lit(None)).otherwise(
        F.col("start_time_gmt")
    )
    lap = F.struct(
        start.alias("startTimeGMT"),
        F.col("intensity_type").alias("intensityType"),
        F.col("distance").alias("distance"),
        F.col("duration").alias("duration"),
        F.col("average_speed").alias("averageSpeed"),
        F.col("average_hr").alias("averageHR"),
        (F.col("average_hr") + F.lit(10.0)).alias("maxHR"),
        F.col("message_index").alias("messageIndex"),
        F.col("workout_step_index").alias("wktStepIndex"),
    )
    docs = s.groupBy("activity_id", "run_date").agg(
        F.array_sort(F.collect_list(F.struct(F.col("message_index").alias("k"), lap.alias("l")))).alias("laps")
    )
    body = F.struct(F.col("activity_id").alias("activityId"), F.transform("laps", lambda x: x["l"]).alias("lapDTOs"))
    return docs.select(
        F.col("run_date").alias("dt"),
        F.concat(F.lit("splits_"), F.col("activity_id").cast("string"), F.lit(".json")).alias("source_file"),
        F.to_json(body).alias("value"),
    )


def workout_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workout record per (workout, day it was used), named by activity."""
    uses = (
        fixtures.activities(spark, sf_dir)
        .filter(F.col("workout_id").isNotNull())
        .groupBy("workout_id", "run_date")
        .agg(F.min("activity_id").alias("activity_id"))
    )
    w = fixtures.used_workouts(spark, sf_dir, uses, fixtures.plan_tasks(spark, sf_dir))
    est = F.when(F.col("workout_id") % 13 == 0, F.lit(None)).otherwise((F.col("workout_id") * 60).cast("bigint"))
    head = F.to_json(
        F.struct(
            F.col("workout_id").alias("workoutId"),
            F.col("workout_name").alias("workoutName"),
            F.struct(F.lit("running").alias("sportTypeKey")).alias("sportType"),
            est.alias("estimatedDurationInSecs"),
            (F.col("workout_id") * 100.0).alias("estimatedDistanceInMeters"),
        )
    )
    value = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"workoutSegments":'), F.col("workout_segments"), F.lit("}"))
    return w.withColumn("h", head).select(
        F.col("run_date").alias("dt"),
        F.concat(F.lit("workouts_"), F.col("activity_id").cast("string"), F.lit(".json")).alias("source_file"),
        value.alias("value"),
    )


# Descriptor list of the derived sensor documents
# (metricsIndex, key, unit key, unit factor).
DETAIL_DESCRIPTORS = (
    (0, "directTimestamp", "gmt", 1.0),
    (1, "sumDistance", "meter", 100.0),
    (2, "sumMovingDuration", "second", 1000.0),
    (3, "directSpeed", "mps", 10.0),
    (4, "directHeartRate", "bpm", 1.0),
    (5, "directCadence", "spm", 1.0),
)


def _descriptor_json(idx: int, key: str, unit: str, factor: float) -> str:
    return f'{{"metricsIndex":{idx},"key":"{key}","unit":{{"key":"{unit}","factor":{factor}}}}}'


def detail_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor dumps: one document per (user, hour) of ``events``.

    Users with ``user_id % 10 = 0`` lack the descriptor of position 5 (their
    files are invalid: metric_key is required); for ``user_id % 10 = 1`` a
    later duplicate descriptor relabels position 2.
    """
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"])
    ts = F.col("ts")
    # Epoch seconds of the wall-clock time, independent of the session time zone.
    epoch = (
        F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
        + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    )
    metrics = F.array(
        epoch.cast("double"),
        F.col("value"),
        (F.col("event_id") % 100).cast("double"),
        F.lit(2.0) + (F.col("event_id") % 16) / F.lit(8.0),
        F.lit(120.0) + F.col("event_id") % 60,
        F.when(F.col("event_id") % 9 == 0, F.lit(None).cast("double")).otherwise(F.lit(1.0)),
    )
    samples = ev.select(
        "user_id",
        F.date_trunc("hour", F.col("ts")).alias("hour"),
        F.struct(F.col("ts"), F.col("event_id"), F.struct(metrics.alias("metrics")).alias("m")).alias("s"),
    )
    docs = samples.groupBy("user_id", "hour").agg(F.array_sort(F.collect_list("s")).alias("samples"))
    full = ",".join(_descriptor_json(*d) for d in DETAIL_DESCRIPTORS)
    missing5 = ",".join(_descriptor_json(*d) for d in DETAIL_DESCRIPTORS[:5])
    dup2 = full + "," + _descriptor_json(2, "sumElapsedDuration", "second", 1000.0)
    descs = (
        F.when(F.col("user_id") % 10 == 0, F.lit(f"[{missing5}]"))
        .when(F.col("user_id") % 10 == 1, F.lit(f"[{dup2}]"))
        .otherwise(F.lit(f"[{full}]"))
    )
    measurements = F.to_json(F.transform("samples", lambda x: x["m"]))
    value = F.concat(
        F.lit('{"activityId":'), F.col("user_id").cast("string"),
        F.lit(',"metricDescriptors":'), descs,
        F.lit(',"activityDetailMetrics":'), measurements, F.lit("}"),
    )
    return docs.select(
        F.date_format("hour", "yyyy-MM-dd").alias("dt"),
        F.concat(
            F.lit("activity_details_"), F.col("user_id").cast("string"), F.lit("_"),
            F.date_format("hour", "yyyyMMddHH"), F.lit(".json"),
        ).alias("source_file"),
        value.alias("value"),
    )


DOCUMENT_SOURCES = {
    "activities": activity_list_documents,
    "splits": split_documents,
    "workouts": workout_documents,
    "activity_details": detail_documents,
}
