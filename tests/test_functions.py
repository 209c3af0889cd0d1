"""Scalar helpers against plain-Python statements of the same rules."""

from __future__ import annotations

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stridelake import functions as SF


def _py_round(x: float) -> float:
    # half away from zero on the double value
    return math.floor(x + 0.5) if x >= 0 else -math.floor(-x + 0.5)


def _py_duration(s):
    if s is None or s < 0:
        return None
    r = _py_round(s)
    return "%d:%02d" % (int(math.floor(r / 60)), int(r % 60))


def _py_pace(v):
    if v is None or v <= 0:
        return None
    return _py_duration(1000.0 / v)


def _eval(spark, col_fn, values, dtype="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(col_fn(F.col("v"))).collect()]


def test_format_duration_examples(spark):
    vals = [None, -1.0, 0.0, 59.4, 59.5, 60.0, 4503.0, 4502.5]
    assert _eval(spark, SF.format_duration, vals) == [None, None, "0:00", "0:59", "1:00", "1:00", "75:03", "75:03"]


def test_format_pace_examples(spark):
    assert _eval(spark, SF.format_pace_from_speed, [None, 0.0, -2.0, 3.5, 4.25]) == [None, None, None, "4:46", "3:55"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(min_value=-100, max_value=1e6, allow_nan=False)), min_size=1, max_size=40))
def test_format_duration_matches_rule(spark, values):
    assert _eval(spark, SF.format_duration, values) == [_py_duration(v) for v in values]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(min_value=0.01, max_value=50, allow_nan=False), min_size=1, max_size=40))
def test_format_pace_matches_rule(spark, values):
    assert _eval(spark, SF.format_pace_from_speed, values) == [_py_pace(v) for v in values]


def test_round2_half_away_on_scaled_double(spark):
    # 20.185 * 100 = 2018.4999999999998 -> 20.18 (the SQL layer's answer)
    assert _eval(spark, SF.round2, [20.185, 0.285, 2.675, 1.005, -1.005]) == [
        round(_py_round(v * 100) / 100, 10) for v in [20.185, 0.285, 2.675, 1.005, -1.005]
    ]


def test_cast_int_half_even(spark):
    assert _eval(spark, SF.cast_int_half_even, [2.5, 3.5, 799.9, -2.5]) == [2, 4, 800, -2]


def test_format_pace_min_per_km(spark):
    assert _eval(spark, SF.format_pace_min_per_km, [None, 4.5, 4.999, 5.0]) == [None, "4:30", "4:60", "5:0"]


def test_session_title_rules(spark):
    def title(v, n=60):
        return _eval(spark, lambda c: SF.session_title(c, n), [v], "string")[0]

    assert title("   ") == "New chat"
    assert title("This is a very long message that should be truncated for a session title", 20) == (
        "This is a very lo..."
    )
    assert title("  hello  \t world \x1c ok ") == "hello world ok"
    assert title("x" * 60) == "x" * 60
    assert title("abcd efgh " * 10, 10) == "abcd ef..."


@settings(max_examples=12, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \t\n  \x1cé")), max_size=80))
def test_session_title_matches_python(spark, text):
    cleaned = " ".join(text.strip().split())
    if not cleaned:
        expected = "New chat"
    elif len(cleaned) <= 20:
        expected = cleaned
    else:
        expected = cleaned[:17].rstrip() + "..."
    assert _eval(spark, lambda c: SF.session_title(c, 20), [text], "string")[0] == expected


def test_event_date_rules(spark):
    df = spark.createDataFrame(
        [
            ("2024-03-02 07:00:00", "2024-03-01 23:00:00"),
            ("", "2024-03-03 01:00:00"),
            (None, "2024-03-04T01:00:00"),
            ("2024-03", "2024-03-05 01:00:00"),  # short local -> fallback, not GMT
            (None, None),
        ],
        "l string, g string",
    )
    got = [r[0] for r in df.select(SF.event_date("l", "g", F.lit("2000-01-01"))).collect()]
    assert got == ["2024-03-02", "2024-03-03", "2024-03-04", "2000-01-01", "2000-01-01"]


def test_concat_skip_nulls_and_interval_summary(spark):
    df = spark.createDataFrame([(2.4, "5:00", 150.0, True), (2.4, None, 150.0, False), (1.0, "4:00", 140.0, False)],
                               "km double, p string, hr double, inc boolean")
    got = [r[0] for r in df.select(SF.interval_summary("Interval", "km", "p", "hr", "inc")).collect()]
    assert got == ["Interval: 2.4 km with pace 5:00 min/km and avg HR 150.0", None,
                   "Interval: 1.0 km with pace 4:00 min/km"]
    got2 = [r[0] for r in df.select(SF.concat_skip_nulls(F.lit("a"), "p", F.lit("b"))).collect()]
    assert got2 == ["a5:00b", "ab", "a4:00b"]
