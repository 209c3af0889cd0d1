from __future__ import annotations

import os

import pytest

from stridelake.operators import ingest


def test_fetch_worklist_rules(spark):
    acts = spark.createDataFrame([(1, 10, "2024-03-01"), (2, None, "2024-03-01"), (3, 0, "2024-03-02")],
                                 "activity_id long, workout_id long, dt string")
    assets = (
        ingest.IngestAsset("splits", "splits", True, False, "activity"),
        ingest.IngestAsset("activity_details", "activity_details", False, True, "activity"),
        ingest.IngestAsset("workouts", "workouts", True, True, "reference"),
        ingest.IngestAsset("unknown", "unknown", True, True, "activity"),
        ingest.IngestAsset("splits", "splits2", True, True, "elsewhere"),
    )
    existing = spark.createDataFrame([("raw/splits/dt=2024-03-01/splits_1.json",)], "output_file string")
    got = sorted(tuple(r) for r in ingest.fetch_worklist(acts, assets, "raw", existing).collect())
    assert got == [
        ("splits", 2, 2, "2024-03-01", "raw/splits/dt=2024-03-01/splits_2.json"),
        ("splits", 3, 3, "2024-03-02", "raw/splits/dt=2024-03-02/splits_3.json"),
        ("workouts", 1, 10, "2024-03-01", "raw/workouts/dt=2024-03-01/workouts_1.json"),
    ]


def test_backfill_dates(spark, tmp_root):
    os.makedirs(os.path.join(tmp_root, "activities", "dt=2024-03-02"))
    os.makedirs(os.path.join(tmp_root, "splits", "dt=2024-03-03"))
    os.makedirs(os.path.join(tmp_root, "splits", "dt=2024-04-01"))
    parts = ingest.discover_partitions(spark, tmp_root, ["activities", "splits"])
    got = [r.run_date for r in ingest.backfill_dates(spark, "2024-03-01", "2024-03-04", parts).collect()]
    assert got == ["2024-03-02", "2024-03-03"]
    none = ingest.discover_partitions(spark, tmp_root, ["workouts"])
    assert ingest.backfill_dates(spark, "2024-03-01", "2024-03-04", none).count() == 0
    assert ingest.backfill_dates(spark, "2024-03-01", "2024-03-03", None).count() == 3
    with pytest.raises(ValueError, match="required"):
        ingest.backfill_dates(spark, None, "2024-03-03", None)
    with pytest.raises(ValueError, match="less than or equal"):
        ingest.backfill_dates(spark, "2024-03-05", "2024-03-03", None)
