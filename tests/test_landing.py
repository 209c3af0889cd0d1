"""Landing stage end to end on JSON files in a temp folder."""

from __future__ import annotations

import copy
import datetime as dt
import json
import os

import pytest

from stridelake.config import DEFAULT_LANDING_CONFIG
from stridelake.plans.landing import (
    MalformedDocumentError,
    QualityGateError,
    land_asset,
    quality_gate,
    run_landing,
)

CLOCK = dt.datetime(2024, 5, 1, 12, 0, 0)


def config(root: str) -> dict:
    c = copy.deepcopy(DEFAULT_LANDING_CONFIG)
    c["source_path"] = os.path.join(root, "raw")
    c["landing_path"] = os.path.join(root, "landing")
    c["quarantine_dir"] = os.path.join(root, "quarantine")
    return c


def put(root: str, folder: str, day: str, name: str, payload) -> None:
    d = os.path.join(root, "raw", folder, f"dt={day}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w", encoding="utf-8") as f:
        f.write(payload if isinstance(payload, str) else json.dumps(payload, indent=4))


def activity(i: int, **over):
    a = {
        "activityId": i,
        "startTimeLocal": "2024-03-02 07:00:00",
        "startTimeGMT": "2024-03-02 06:00:00",
        "activityName": f"Run {i}",
        "activityType": {"typeKey": "running"},
        "distance": 5000.0 + i,
        "duration": 1500.0,
        "averageSpeed": 3.3,
        "deviceId": 7,
    }
    a.update(over)
    return a


def test_list_payload_success(spark, tmp_root):
    put(tmp_root, "activities", "2024-03-02", "activities_2024-03-02T08:00:00.json", [activity(1), activity(2)])
    counts = land_asset(spark, config(tmp_root), "activities", clock=CLOCK)
    assert counts == {"asset": "activities", "files_seen": 1, "rows_valid": 2, "rows_invalid": 0,
                      "staged_files": 1, "malformed_files": 0}
    rows = spark.read.parquet(os.path.join(tmp_root, "landing", "activities")).orderBy("activity_id").collect()
    assert [r.activity_id for r in rows] == [1, 2]
    assert rows[0].activity_type == "running" and rows[0].ingested_at == CLOCK.isoformat()
    assert rows[0].source_file == "activities_2024-03-02T08:00:00.json" and rows[0].run_date == "2024-03-02"
    assert not os.path.exists(os.path.join(tmp_root, "quarantine", "activities"))


def test_required_value_missing_quarantines_whole_file(spark, tmp_root):
    bad = activity(2)
    del bad["activityType"]["typeKey"]
    put(tmp_root, "activities", "2024-03-02", "activities_a.json", [activity(1), bad])
    counts = land_asset(spark, config(tmp_root), "activities", clock=CLOCK)
    assert (counts["rows_valid"], counts["rows_invalid"], counts["staged_files"]) == (0, 2, 0)
    q = spark.read.parquet(os.path.join(tmp_root, "quarantine", "activities"))
    assert q.count() == 2
    assert not os.path.exists(os.path.join(tmp_root, "landing", "activities", "dt=2024-03-02"))
    with pytest.raises(QualityGateError, match="invalid_rows=2"):
        run_landing(spark, config(tmp_root), asset_names=["activities"], clock=CLOCK)


def test_latest_snapshot_only(spark, tmp_root):
    put(tmp_root, "activities", "2024-03-02", "activities_2024-03-02T08:00:00.json", [activity(1)])
    put(tmp_root, "activities", "2024-03-02", "activities_2024-03-02T09:00:00.json", [activity(2), activity(3)])
    counts = land_asset(spark, config(tmp_root), "activities", clock=CLOCK)
    assert counts["files_seen"] == 1 and counts["rows_valid"] == 2
    ids = sorted(r.activity_id for r in spark.read.parquet(os.path.join(tmp_root, "landing", "activities")).collect())
    assert ids == [2, 3]


def test_object_payload_context_key(spark, tmp_root):
    put(tmp_root, "splits", "2024-03-02", "splits_11.json", {
        "activityId": 11,
        "lapDTOs": [
            {"startTimeGMT": "2024-03-02 06:00:00", "distance": 1000.0, "duration": 300.0, "messageIndex": 0},
            {"startTimeGMT": "2024-03-02 06:05:00", "distance": 1000.0, "duration": 290.0, "messageIndex": 1,
             "intensityType": "INTERVAL"},
        ],
    })
    land_asset(spark, config(tmp_root), "splits", clock=CLOCK)
    df = spark.read.parquet(os.path.join(tmp_root, "landing", "splits"))
    rows = df.orderBy("message_index").collect()
    assert [r.activity_id for r in rows] == [11, 11]
    # optional column all NULL in one file keeps its declared type
    assert dict(df.dtypes)["intensity_type"] == "string" and rows[0].intensity_type is None


def test_undeclared_context_key_is_kept(spark, tmp_root):
    c = config(tmp_root)
    c["assets"]["splits"]["extract"]["context_key"] = {"source": "ownerId", "target": "owner_ref"}
    put(tmp_root, "splits", "2024-03-02", "splits_11.json", {
        "activityId": 11, "ownerId": 99,
        "lapDTOs": [{"activityId": 11, "startTimeGMT": "x", "distance": 1.0, "duration": 1.0}],
    })
    land_asset(spark, c, "splits", clock=CLOCK)
    r = spark.read.parquet(os.path.join(tmp_root, "landing", "splits")).collect()[0]
    assert r.owner_ref == "99" and r.activity_id == 11


def test_record_payload_json_column(spark, tmp_root):
    segs = [{"segmentOrder": 1, "workoutSteps": [{"type": "ExecutableStepDTO", "stepOrder": 1}]}]
    put(tmp_root, "workouts", "2024-03-02", "workouts_5.json", {
        "workoutId": 77, "workoutName": "Tempo", "sportType": {"sportTypeKey": "running"},
        "estimatedDurationInSecs": 1800, "estimatedDistanceInMeters": 6000.0, "workoutSegments": segs,
    })
    land_asset(spark, config(tmp_root), "workouts", clock=CLOCK)
    r = spark.read.parquet(os.path.join(tmp_root, "landing", "workouts")).collect()[0]
    assert r.workout_id == 77 and json.loads(r.workout_segments) == segs


def test_descriptor_metrics_expansion(spark, tmp_root):
    put(tmp_root, "activity_details", "2024-03-02", "activity_details_9.json", {
        "activityId": 9,
        "metricDescriptors": [
            {"metricsIndex": 0, "key": "directSpeed", "unit": {"key": "mps", "factor": 10.0}},
            "not-a-dict",
            {"metricsIndex": 1, "key": "old", "unit": {"key": "x", "factor": 1.0}},
            {"metricsIndex": 1, "key": "directHeartRate", "unit": {"key": "bpm", "factor": 1.0}},
        ],
        "activityDetailMetrics": [{"metrics": [3.1, 150]}, "skip-me", {"metrics": [3.2, 151]}],
    })
    counts = land_asset(spark, config(tmp_root), "activity_details", clock=CLOCK)
    assert counts["rows_valid"] == 4
    rows = spark.read.parquet(os.path.join(tmp_root, "landing", "activity_details")).orderBy(
        "measurement_index", "metric_index").collect()
    assert [(r.measurement_index, r.metric_index, r.metric_key, r.metric_value, r.unit_key, r.unit_factor) for r in rows] == [
        (0, 0, "directSpeed", 3.1, "mps", 10.0),
        (0, 1, "directHeartRate", 150.0, "bpm", 1.0),
        (2, 0, "directSpeed", 3.2, "mps", 10.0),
        (2, 1, "directHeartRate", 151.0, "bpm", 1.0),
    ]
    assert all(r.activity_id == 9 for r in rows)


def test_empty_file_counted_and_rerun_clears_stale_output(spark, tmp_root):
    c = config(tmp_root)
    put(tmp_root, "splits", "2024-03-02", "splits_1.json", {"activityId": 1, "lapDTOs": [
        {"startTimeGMT": "t", "distance": 1.0, "duration": 1.0}]})
    land_asset(spark, c, "splits", clock=CLOCK)
    assert os.path.exists(os.path.join(tmp_root, "landing", "splits", "dt=2024-03-02"))
    # the day now only has an empty payload: old landing output must go
    os.remove(os.path.join(tmp_root, "raw", "splits", "dt=2024-03-02", "splits_1.json"))
    put(tmp_root, "splits", "2024-03-02", "splits_2.json", {"activityId": 2, "lapDTOs": []})
    counts = land_asset(spark, c, "splits", clock=CLOCK)
    assert counts["files_seen"] == 1 and counts["rows_valid"] == 0 and counts["staged_files"] == 0
    assert not os.path.exists(os.path.join(tmp_root, "landing", "splits", "dt=2024-03-02"))


def test_rerun_is_idempotent_and_only_touches_processed_days(spark, tmp_root):
    c = config(tmp_root)
    put(tmp_root, "activities", "2024-03-02", "activities_a.json", [activity(1)])
    put(tmp_root, "activities", "2024-03-03", "activities_a.json", [activity(2)])
    land_asset(spark, c, "activities", clock=CLOCK)
    land_asset(spark, c, "activities", "2024-03-03", "2024-03-03", clock=CLOCK)
    ids = sorted(r.activity_id for r in spark.read.parquet(os.path.join(tmp_root, "landing", "activities")).collect())
    assert ids == [1, 2]


def test_malformed_json_raises(spark, tmp_root):
    put(tmp_root, "splits", "2024-03-02", "splits_1.json", "{not json")
    with pytest.raises(MalformedDocumentError):
        land_asset(spark, config(tmp_root), "splits", clock=CLOCK)


def test_quality_gate_messages():
    assert quality_gate({"rows_invalid": 0, "quarantine_files": 0})["rows_invalid"] == 0
    with pytest.raises(QualityGateError, match="Quality gate failed: invalid_rows=1"):
        quality_gate({"rows_invalid": 1})
    with pytest.raises(QualityGateError, match="quarantine_files=1"):
        quality_gate({"rows_invalid": 0, "quarantine_files": 1})
