"""Fused data-quality tests equal the failing rows of each test, and read each model once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stridelake.operators import quality
from stridelake.operators.quality import CHECKS, Check, failing_rows, run_checks
from stridelake.plans.pipeline import TrainingModels


def tables(spark):
    child = spark.createDataFrame(
        [(1, 0, "a"), (1, 0, "a"), (1, 1, None), (None, 1, "b"), (None, 1, "b"), (7, None, "c"), (8, 2, "c"), (8, 3, None)],
        "id long, k long, v string",
    )
    parent = spark.createDataFrame([(1,), (1,), (None,), (8,)], "id long")
    return {"child": child, "parent": parent}


FEW = (
    Check("child", "not_null", ("id",)), Check("child", "not_null", ("v",)), Check("child", "not_null", ("k",)),
    Check("child", "unique", ("id",)), Check("child", "unique", ("v",)), Check("child", "unique_combination", ("id", "k")),
    Check("child", "relationships", ("id",), "parent", "id"), Check("child", "relationships", ("k",), "parent", "id"),
    Check("parent", "not_null", ("id",)), Check("parent", "unique", ("id",)),
)


def report(df):
    return {(r.model, r.test, r.column_name): r.failures for r in df.collect()}


@pytest.mark.parametrize("some", [FEW, FEW[:1], FEW[1:3], FEW[5:7], FEW[6:8]])
def test_report_equals_failing_rows(spark, some):
    t = tables(spark)
    want = {(c.model, c.test, ",".join(c.columns)): failing_rows(c, t).count() for c in some}
    assert report(run_checks(t, some)) == want
    empty = {n: df.limit(0) for n, df in t.items()}
    assert set(report(run_checks(empty, some)).values()) == {0}


def test_missing_table_and_unknown_test_are_errors(spark):
    with pytest.raises(ValueError, match="parent"):
        run_checks({"child": tables(spark)["child"]}, FEW)
    with pytest.raises(ValueError, match="odd"):
        run_checks(tables(spark), (Check("child", "odd", ("id",)),))


def test_each_model_is_read_once(spark, tmp_root):
    """All 37 tests over stored tables: a scan per model and key set, and one per relationships test's parent."""
    stored = {}
    for name in sorted({c.model for c in CHECKS}):
        cols = sorted({x for c in CHECKS if c.model == name for x in c.columns} | {"activity_id"})
        spark.range(3).select(*[F.col("id").alias(c) for c in cols]).write.parquet(f"{tmp_root}/{name}")
        stored[name] = spark.read.parquet(f"{tmp_root}/{name}")
    plan = run_checks(stored)._jdf.queryExecution().executedPlan().toString()
    parents = sum(c.test == "relationships" for c in CHECKS)
    assert plan.count("FileScan") == len(stored) + parents
    assert set(report(run_checks(stored)).values()) == {0}
    assert len(stored) == len(TrainingModels.MODEL_ORDER) + 4 and quality.CHECKS is CHECKS
