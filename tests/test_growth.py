"""Steps whose plan must stay bounded when the tables grow."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from stridelake.operators.extract import extract_documents
from stridelake.operators.incremental import write_upsert
from stridelake.operators.sequence import ordinal_by_chunk
from stridelake.plans import bronze, gold, silver
from stridelake.sources import fixtures, raw_docs
from stridelake.sources.tables import read_table, tasks_for


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def parts(spark, folder: str, rows: list[tuple]) -> str:
    spark.createDataFrame(rows, "p_partkey bigint, p_size int").write.mode("overwrite").parquet(f"{folder}/part.parquet")
    return folder


def laps(spark):
    return spark.createDataFrame(
        [
            (1, 7, "2024-01-01", "interval", 1, 3.0, 1, "5:00", 100.0, 400.0, 150.0),
            (1, 7, "2024-01-01", "warmup", 0, 2.5, 0, "6:00", 300.0, 900.0, 120.0),
            (2, None, "2024-01-02", "warmup", 0, 2.5, 0, "6:00", 310.0, 910.0, 121.0),
            (3, None, "2024-01-03", "interval", 1, 3.0, 1, "5:00", 100.0, 400.0, 150.0),
        ],
        "activity_id bigint, workout_id bigint, run_date string, step_type string, workout_step_index bigint, average_speed_ms double,"
        " split_index bigint, split_pace string, duration_sec double, distance_m double, average_hr double",
    )


def planned_steps(spark, folder: str):
    return silver.running_workouts(fixtures.workouts(spark, parts(spark, folder, [(6, 10), (6, 10), (7, 11), (None, 3)])))


def test_planned_steps_are_not_collected_for_a_broadcast(spark, tmp_root):
    planned = planned_steps(spark, tmp_root)
    matched = silver.workout_interval_match(laps(spark), planned)
    assert "Broadcast" not in plan_of(matched)
    # the plan is there twice, so its lap matches twice
    assert [(r.activity_id, r.workout_name, r.step_type) for r in matched.collect()] == [(1, "Workout 7", "interval")] * 2


def test_results_take_names_without_a_broadcast(spark, tmp_root):
    planned = planned_steps(spark, tmp_root)
    results = silver.running_workout_results(laps(spark), planned)
    assert "Broadcast" not in plan_of(results)
    rows = sorted((r.activity_id, r.step_type, r.workout_name or "") for r in results.collect())
    assert rows == [(1, "interval", "Workout 7")] * 2 + [(1, "warmup", "Workout 7"), (2, "warmup", "")]


def test_workout_texts_are_rendered_behind_the_join(spark, tmp_root):
    folder = parts(spark, tmp_root, [(6, 10), (6, 10), (7, 11), (8, 12), (None, 3)])
    uses = spark.createDataFrame([(7, "2024-01-01"), (7, "2024-01-02"), (8, "2024-01-01"), (99, "2024-01-01")], "workout_id bigint, run_date string")
    used = fixtures.used_workouts(spark, folder, uses)
    plan = plan_of(used)
    assert "Broadcast" not in plan
    assert plan.index("segmentOrder") < plan.index("Join")  # the first lines of a plan are its last steps
    assert "segmentOrder" not in plan[plan.index("Join") :]
    expected = fixtures.workouts(spark, folder).join(uses, "workout_id").select(used.columns)
    assert sorted(used.collect()) == sorted(expected.collect()) and used.count() == 5


def test_texts_of_one_plan_are_rendered_by_many_tasks(spark, tmp_root):
    folder = parts(spark, tmp_root, [(6, 10), (6, 10)])
    days = [(7, f"2024-01-{d:02d}") for d in range(1, 29)]
    used = fixtures.used_workouts(spark, folder, spark.createDataFrame(days, "workout_id bigint, run_date string"), tasks=9)
    at = used.select(F.spark_partition_id().alias("task"), "run_date").collect()
    assert len(at) == 56 and len({r.task for r in at}) > 4  # (adaptive execution would make it one)
    assert "hashpartitioning(workout_id" in plan_of(used) and ", 9)" in plan_of(used)


def test_newest_workout_holds_no_texts_as_keys(spark):
    rows = [(1, "a", "2024-01-01"), (1, "b", "2024-01-02"), (1, "b", "2024-01-02"), (2, None, "2024-01-01"), (None, "c", "2024-01-01")]
    landing = spark.createDataFrame(rows, "workout_id bigint, workout_segments string, run_date string").withColumn("dt", F.to_date("run_date"))
    newest = bronze.bronze_workouts(landing)
    assert "HashAggregate" not in plan_of(newest)
    got = sorted(map(str, newest.drop("dt").collect()))
    assert got == sorted(map(str, spark.createDataFrame([rows[1], rows[3], rows[4]], newest.drop("dt").schema).collect()))


def test_workout_documents_hold_the_same_texts(spark, tmp_root):
    folder = parts(spark, tmp_root, [(6, 10), (7, 11), (12, 12)])
    spark.createDataFrame(
        [(i, c, "F", 1000.0 + i, "1-URGENT") for i, c in enumerate([6, 6, 7, 12, 90])],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
    ).withColumn("o_orderdate", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{folder}/orders.parquet")
    docs = raw_docs.workout_documents(spark, folder).orderBy("source_file").collect()
    assert [(d.dt, d.source_file) for d in docs] == [("2024-01-01", f"workouts_{i}.json") for i in (0, 2, 3)]
    assert '"workoutId":7,"workoutName":"Workout 7"' in docs[0].value and '"numberOfIterations":10' in docs[0].value
    assert '"estimatedDurationInSecs"' not in docs[2].value  # every thirteenth plan lacks it


def test_descriptors_are_read_once_per_document(spark):
    asset = {
        "extract": {
            "payload_kind": "descriptor_metrics", "schema_path": "ds", "schema_index_field": "at", "schema_key_field": "key",
            "schema_unit_path": "unit", "records_path": "ms", "values_path": "vs",
        },
        "column_mapping": [
            {"target": t, "source": s, "dtype": d, "required": False}
            for t, s, d in [("i", "metric_index", "int64"), ("k", "metric_key", "string"), ("k_json", "metric_key", "json"),
                            ("v", "metric_value", "float64"), ("f", "unit_factor", "int64"), ("x", "absent", "string")]
        ],
    }
    value = '{"ds":[{"at":0,"key":"a","unit":{"factor":2}},{"key":"no"},{"at":1,"key":"old"},{"at":1,"key":7,"unit":{"factor":"z"}}],"ms":[{"vs":[1,"w",3]}]}'
    docs = spark.createDataFrame([("2024-01-01", "f", value)], "dt string, source_file string, value string")
    out = extract_documents(docs, asset)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("['at']") == 1
    (row,) = out.collect()
    assert [tuple(r) for r in row.records] == [(0, "a", '"a"', 1.0, 2, None), (1, "7", "7", None, None, None), (2, None, None, 3.0, None, None)]


def test_upsert_computes_its_batch_once(spark, tmp_root):
    computed = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def seen(x):
        computed.add(1)
        return x

    table = f"{tmp_root}/table"
    held = [(1, 10, "2024-01-01"), (2, 20, "2024-01-02"), (3, 30, "2024-01-03")]
    spark.createDataFrame(held, "k bigint, v bigint, dt string").write.partitionBy("dt").parquet(table)
    new = spark.createDataFrame([(1, 11, "2024-01-02"), (4, 40, None), (None, 50, "2024-01-02")], "k bigint, v bigint, dt string")
    write_upsert(spark, table, new.withColumn("k", seen("k")), ["k"], "dt")
    assert computed.value == 3
    rows = spark.read.schema("k bigint, v bigint, dt string").parquet(table).collect()
    expected = [(2, 20, "2024-01-02"), (3, 30, "2024-01-03"), (1, 11, "2024-01-02"), (4, 40, None), (None, 50, "2024-01-02")]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    assert sorted(f for f in os.listdir(tmp_root) if "crc" not in f) == ["table"]


def test_newest_landing_needs_one_exchange_of_the_rows(spark, tmp_root):
    path = f"{tmp_root}/landing"
    rows = [(1, 1, 5.0, "2024-01-01"), (1, 1, 5.0, "2024-01-01"), (1, 1, 6.0, "2024-01-02"), (1, 2, 7.0, "2024-01-01")]
    spark.createDataFrame(rows, "activity_id bigint, message_index bigint, v double, dt string").write.parquet(path)
    batch = bronze.bronze_batch("splits", spark.read.parquet(path).filter("activity_id is not null and message_index is not null"))
    assert plan_of(batch).count("hashpartitioning") == 2  # rows with a key, and the (here no) rows without one
    assert sorted(map(tuple, batch.collect())) == [(1, 1, 6.0, "2024-01-02"), (1, 2, 7.0, "2024-01-01")]


def test_rows_of_a_task_are_bounded(spark, tmp_root):
    spark.range(40).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_root}/part.parquet")
    df = read_table(spark, tmp_root, "part")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(df, 100) == least and tasks_for(df, 2) == max(least, 20) and tasks_for(df.limit(0), 2) == least
    stamped = spark.range(50).select(F.lit(1).alias("g"), F.timestamp_seconds("id").alias("t"))
    numbered = ordinal_by_chunk(stamped, ["g"], ["t"], F.date_trunc("minute", "t"), tasks=least + 5)
    assert f", {least + 5})" in plan_of(numbered)
    assert sorted(r.ordinal for r in numbered.collect()) == list(range(50))


def test_summary_of_results_exchanges_the_laps_once(spark, tmp_root):
    results = silver.running_workout_results(laps(spark), planned_steps(spark, tmp_root))
    trainings = spark.createDataFrame([(1, 7, "2024-01-01", "t")], "activity_id bigint, workout_id bigint, run_date string, training_summary string")
    plain = gold.running_workout_results_summary(results, trainings)
    spread = gold.running_workout_results_summary(results, trainings, tasks=13)
    assert plan_of(spread).count("hashpartitioning(activity_id") < plan_of(plain).count("hashpartitioning(activity_id")
    assert "hashpartitioning(activity_id" in plan_of(spread) and ", 13)" in plan_of(spread)
    assert sorted(spread.collect()) == sorted(plain.collect()) and spread.count() == 1
