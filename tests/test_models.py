"""Model semantics on hand-made rows (cases the derived tables never produce)."""

from __future__ import annotations

import pytest

from stridelake.operators import quality
from stridelake.plans import gold, silver

PLANNED = (
    "workout_id int, workout_name string, step_order int, number_of_iterations int, step_type string, "
    "target_goal string, target_distance_m double, target_time_sec double, target_pace_lower_range string, "
    "target_pace_upper_range string, garmin_step_index int"
)


def test_workout_summary_blocks(spark):
    rows = [
        (1, "W1", 1, None, "warmup", "distance", 2000.0, None, None, None, 0),
        (1, "W1", 2, 6, "repeat", "iterations", None, None, None, None, None),
        (1, "W1", 3, None, "interval", "distance", 400.0, None, "9:59", "4:10", 1),
        (1, "W1", 4, None, "interval", "distance", 399.5, None, "10:01", "4:00", 2),
        (1, "W1", 5, None, "recovery", "time", None, 90.0, None, None, 3),
        (1, "W1", 6, 3, "repeat", "iterations", None, None, None, None, None),
        (1, "W1", 7, None, "interval", "time", None, 60.0, None, None, 5),
        (1, "W1", 8, None, "recovery", "distance", 200.0, None, None, None, 6),
        (1, "W1", 9, None, "cooldown", "distance", 1000.0, None, None, None, 8),
        (2, "W2", 1, 4, "repeat", "iterations", None, None, None, None, None),
        (2, "W2", 2, None, "recovery", "lap.button", None, None, None, None, 0),
        (3, "W3", 1, None, "interval", "distance", 400.0, None, None, None, 0),
    ]
    out = {r.workout_id: r.workout_summary for r in gold.running_workout_summary(spark.createDataFrame(rows, PLANNED)).collect()}
    # paces are compared as text: '9:59' > '10:01'
    assert out == {1: "6 x 400m with 90s recovery @ 9:59-4:10\n3 x 60sec with 200m recovery", 2: "4 x !ERROR!"}


def test_repeat_next_boundary(spark):
    rows = [(1, "W", 2, 6, "repeat", None, None, None, None, None, None),
            (1, "W", 6, 3, "repeat", None, None, None, None, None, None),
            (1, "W", 3, None, "interval", None, None, None, None, None, 1)]
    got = sorted((r.repeat_step_order, r.next_repeat_step_order)
                 for r in gold.repeat_next_boundary(spark.createDataFrame(rows, PLANNED)).collect())
    assert got == [(2, 6), (6, None)]


RESULTS = (
    "activity_id long, workout_id long, run_date date, workout_name string, distance_m double, distance_km double, "
    "duration_sec double, duration_min string, split_index long, split_pace string, workout_step_index long, "
    "step_type string, target_goal string, target_distance_m double, target_distance_km double, "
    "target_time_sec double, target_time_min string, target_pace_lower_range string, "
    "target_pace_upper_range string, average_hr double"
)


def _res(split, step, kind, dist, pace, goal=None, tkm=None, tmin=None, lo=None, hi=None):
    import datetime as dt

    return (1, 7, dt.date(2024, 1, 1), "W", dist, round(dist / 1000, 2), 100.0, "1:40", split, pace, step, kind,
            goal, None if tkm is None else tkm * 1000, tkm, None, tmin, lo, hi, 150.0)


def test_workout_results_summary_text(spark):
    import datetime as dt

    results = spark.createDataFrame(
        [
            _res(0, 0, "warmup", 2400.0, "7:51"),
            _res(1, 1, "interval", 400.0, "7:24", "distance", 0.2, None, "4:46", "3:55"),
            _res(2, 2, "recovery", 300.0, "9:00", "time", None, "1:30"),
            _res(4, 4, "interval", 500.0, "7:00", "lap.button"),
            _res(3, 3, "cooldown", 2100.0, "6:04"),
        ],
        RESULTS,
    )
    ts = spark.createDataFrame([(1, 7, dt.date(2024, 1, 1), "Total distance: 5.7 km, time: 30:00")],
                               "activity_id long, workout_id long, run_date date, training_summary string")
    r = gold.running_workout_results_summary(results, ts).collect()[0]
    assert r.full_summary == (
        "Warmup: 2.4 km for 7:51\n\nTarget: 0.2 km (target pace 4:46 - 3:55)\nActual: \npace 7:24, distance: 0.4 km."
        "\n\nTarget: 1:30 min\nActual: \n\n\nCooldown: 2.1 km for 6:04"
        "\n\nTarget:  NULL \nActual: \npace 7:00, distance: 0.5 km."
    )


def test_result_key_collision_surfaces_in_quality_check(spark):
    results = spark.createDataFrame([_res(0, 0, "warmup", 1000.0, "7:00"), _res(0, 0, "warmup", 900.0, "7:10")], RESULTS)
    of_model = tuple(c for c in quality.CHECKS if c.model == "running_workout_results")
    with pytest.raises(ValueError, match="running_trainings"):  # a check's table is missing: no silent skip
        quality.run_checks({"running_workout_results": results}, of_model)
    report = quality.run_checks({"running_workout_results": results}, tuple(c for c in of_model if c.parent is None))
    got = {(r.test, r.column_name): r.failures for r in report.collect()}
    assert got[("unique_combination", "activity_id,split_index")] == 1
    assert got[("not_null", "activity_id")] == 0


DETAILS = (
    "activity_id long, measurement_index long, run_date date, timestamp_raw double, distance_m double, "
    "duration_sec double, elapsed_duration_sec double, moving_duration_sec double, speed_mps double, heart_rate_bpm double"
)


def test_derived_splits_skip_bucket_and_zero_speed(spark):
    import datetime as dt

    d = dt.date(2024, 1, 1)
    rows = [
        (1, 0, d, 0.0, 0.0, None, None, 0.0, 3.0, 140.0),      # distance 0: dropped
        (1, 1, d, 1.0, 500.0, None, None, 100.0, 3.0, 140.0),
        (1, 2, d, 2.0, 900.0, None, None, 200.0, 5.0, 150.0),
        (1, 3, d, 3.0, 950.0, None, None, 210.0, 0.0, 160.0),  # speed 0: dropped
        (1, 4, d, 4.0, 2100.0, None, None, 600.0, 2.5, 160.0),  # bucket 3 (bucket 2 skipped)
    ]
    out = sorted(silver.running_derived_splits(spark.createDataFrame(rows, DETAILS)).collect(),
                 key=lambda r: r.distance_km_bucket)
    assert [(r.distance_km_bucket, r.split_duration_sec, r.avg_speed_mps, r.split_duration_min, r.split_pace) for r in out] == [
        (1, 200.0, 4.0, "3:20", "4:10"),
        (3, 400.0, 2.5, "6:40", "6:40"),
    ]


def test_workout_steps_from_json(spark):
    seg = ('[{"segmentOrder":1,"workoutSteps":[{"type":"ExecutableStepDTO","stepOrder":1.0,'
           '"stepType":{"stepTypeKey":"warmup"},"endCondition":{"conditionTypeKey":"time"},"endConditionValue":300},'
           '{"type":"RepeatGroupDTO","stepOrder":2,"stepType":{"stepTypeKey":"repeat"},"numberOfIterations":5,'
           '"workoutSteps":[{"type":"ExecutableStepDTO","stepOrder":3,"stepType":{"stepTypeKey":"interval"},'
           '"endCondition":{"conditionTypeKey":"distance"},"endConditionValue":800.0,'
           '"targetType":{"workoutTargetTypeKey":"pace.zone"},"targetValueOne":4.0,"targetValueTwo":4.5}]}]}]')
    w = spark.createDataFrame([(5, "Intervals", seg), (6, "Empty", None)], "workout_id int, workout_name string, workout_segments string")
    got = sorted(tuple(r) for r in silver.running_workouts(w).select(
        "step_order", "number_of_iterations", "step_type", "target_time_sec", "target_distance_m",
        "target_pace_lower_range", "target_pace_upper_range", "garmin_step_index").collect())
    assert got == [
        (1, None, "warmup", 300.0, None, None, None, 0),
        (2, 5, "repeat", None, None, None, None, None),
        (3, None, "interval", None, 800.0, "4:10", "3:42", 1),
    ]
