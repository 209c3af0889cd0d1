"""Plan shape: no Python in any registered query, pruning and pushdown reach the scan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridelake.operators.sequence import ordinal_by_chunk, ordinal_within_group
from stridelake.query_registry import QUERIES

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF", "MapInArrow")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_any_query(spark):
    for name, q in QUERIES.items():
        plan = _plan(q(spark, SF))
        assert not any(n in plan for n in PYTHON_NODES), name


def test_trainings_scan_reads_only_needed_columns(spark):
    plan = _plan(QUERIES["running_trainings"](spark, SF))
    scan = [line for line in plan.split("\n") if "orders.parquet" in line][0]
    assert "o_orderkey" in scan and "o_totalprice" in scan
    assert "o_comment" not in scan and "o_clerk" not in scan


def test_filter_pushed_to_scan(spark):
    df = QUERIES["running_splits"](spark, SF).filter(F.col("activity_id") == 7)
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,7)]" in df._jdf.queryExecution().toString() or (
        "EqualTo(l_orderkey,7)" in plan
    )


def test_ordinal_within_group_equals_row_number(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    chunked = ordinal_within_group(ev, ["user_id"], ["ts", "event_id"], name="pos")
    direct = ev.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    a = sorted((r.event_id, r.pos) for r in chunked.select("event_id", "pos").collect())
    b = sorted((r.event_id, r.pos) for r in direct.select("event_id", "pos").collect())
    assert a == b


def _without_subqueries(plan: str) -> str:
    """The plan's lines outside scalar subqueries (a subquery adds up one number of a few partial sums)."""
    kept, skip = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip is not None and depth > skip:
            continue
        skip = depth if "Subquery" in line else None
        if skip is None:
            kept.append(line)
    return "\n".join(kept)


def _numbered_both_ways(df, groups, order, **sizes):
    got = ordinal_within_group(df, groups, order, name="pos", **sizes)
    w = Window.partitionBy(*groups).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return got, df.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))


def test_numbering_of_any_shape_of_group(spark):
    ids = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("g"),
        F.when(F.col("id") % 4 == 0, None).otherwise((F.col("id") * 7919) % 11).alias("o"),  # a few values and NULL
        "id",
    )
    for sizes in ({}, {"rows_per_chunk": 100}, {"rows_per_chunk": 1, "max_chunks": 40}, {"rows_per_chunk": 3}):
        got, want = _numbered_both_ways(ids, ["g"], ["o", "id"], **sizes)
        assert got.exceptAll(want).count() == 0 and got.count() == 4000
    got, want = _numbered_both_ways(ids.limit(0), ["g"], ["o", "id"], rows_per_chunk=1)
    assert got.count() == 0


def test_numbering_by_chunk_equals_row_number_with_one_exchange(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    got = ordinal_by_chunk(ev, ["user_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"), name="pos")
    want = ev.withColumn("pos", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    window = plan[plan.index("Window [row_number()") :]
    assert plan[: plan.index("Window [row_number()")].count("Exchange") == 0  # from the window to the result: none
    assert window.count("FileScan") == 2


def test_numbering_exchanges_its_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ev = spark.read.parquet(f"{SF}/events.parquet")
        plan = _without_subqueries(_plan(ordinal_within_group(ev, ["user_id"], ["ts", "event_id"], name="pos")))
        wide = [line for line in plan.splitlines() if "FileScan" in line and "value" in line]
        assert len(wide) == 1  # only one scan reads more than the keys
        assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(user_id") >= 1
        spark_rows = [x for x in plan.splitlines() if "Exchange hashpartitioning(user_id" in x and "_chunk" in x]
        assert len(spark_rows) <= 2  # the rows, and the counts of the chunks of hot groups
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_job_runs_while_a_plan_is_built(spark):
    from stridelake.query_registry import QUERIES

    group = "plan-building"
    spark.sparkContext.setJobGroup(group, "no action expected")
    for name in ("running_splits", "running_workout_results", "running_activity_details"):
        plan = _without_subqueries(_plan(QUERIES[name](spark, SF)))
        assert "SinglePartition" not in plan, name
    seen = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(seen) <= 12, seen  # reading Parquet footers (schemas of the tables) only



def test_hot_group_is_numbered_across_tasks(spark):
    """One user holds a third of all rows: numbering stays exact and the hot
    user's rows are processed by several tasks, not one."""
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * i), 0 if i % 3 == 0 else 1 + i % 50) for i in range(6000)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    out = ordinal_within_group(ev, ["user_id"], ["ts", "event_id"], name="pos", rows_per_chunk=150)
    hot = out.filter(F.col("user_id") == 0)
    assert sorted(r.pos for r in hot.select("pos").collect()) == list(range(2000))
    # tiny test data: keep AQE from merging all shuffle partitions into one
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = hot.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1
