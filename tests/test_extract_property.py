"""Extraction against a plain-Python statement of the rules, on random payloads."""

from __future__ import annotations

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stridelake.config import DEFAULT_LANDING_CONFIG
from stridelake.operators.extract import extract_documents

ASSET = DEFAULT_LANDING_CONFIG["assets"]["activities"]
MAPPING = ASSET["column_mapping"]


def nested(record, path):
    value = record
    for key in path.split("."):
        if not isinstance(value, dict):
            return None
        value = value.get(key)
        if value is None:
            return None
    return value


field_values = {
    "activityId": st.one_of(st.none(), st.integers(min_value=0, max_value=10**12)),
    "startTimeLocal": st.one_of(st.none(), st.sampled_from(["2024-03-02 07:00:00", "x"])),
    "startTimeGMT": st.one_of(st.none(), st.just("2024-03-02 06:00:00")),
    "activityType": st.one_of(st.none(), st.just("flat"), st.fixed_dictionaries({"typeKey": st.sampled_from(["running", "cycling"])})),
    "distance": st.one_of(st.none(), st.floats(min_value=0, max_value=1e5, allow_nan=False)),
    "duration": st.one_of(st.none(), st.floats(min_value=0, max_value=1e5, allow_nan=False)),
    "hasSplits": st.one_of(st.none(), st.booleans()),
}


@st.composite
def record(draw):
    r = {}
    for k, strat in field_values.items():
        if draw(st.booleans()):
            r[k] = draw(strat)
    return r


docs = st.lists(st.one_of(st.lists(record(), max_size=4), st.just({"not": "a list"})), min_size=1, max_size=6)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs)
def test_list_extraction_matches_python(spark, payloads):
    rows = [("2024-03-02", f"f{i}.json", json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "dt string, source_file string, value string")
    got = {r.source_file: r for r in extract_documents(df, ASSET).collect()}
    required = [c for c in MAPPING if c["required"]]
    for i, p in enumerate(payloads):
        recs = p if isinstance(p, list) else []
        mapped = [{c["target"]: nested(r, c["source"]) for c in MAPPING} for r in recs]
        valid = all(m[c["target"]] is not None for m in mapped for c in required)
        g = got[f"f{i}.json"]
        assert g.parsed and g.valid == valid and len(g.records) == len(mapped)
        for m, r in zip(mapped, g.records):
            assert r.activity_id == m["activity_id"]
            assert r.activity_type == m["activity_type"]
            assert r.start_time_local == m["start_time_local"]
            assert r.has_splits == m["has_splits"]
            assert r.distance == m["distance"]  # JSON -> variant -> double is exact
