"""Every registered query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import pytest

import os, sys
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from oracle_check import compare  # noqa: E402
from stridelake.query_registry import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() >= 0
    assert df.columns == ["activity_id", "run_date", "full_summary", "training_summary"]


def test_all_queries_match_oracle(spark):
    res = compare(spark, SF, verbose=False)
    # only the optional training-data queries may have no SQL
    bad = {k: v for k, v in res.items() if v[0] != "OK" and (k in QUERIES or v[0] != "NO_ORACLE")}
    assert not bad, bad
    assert set(QUERIES) <= set(res)
