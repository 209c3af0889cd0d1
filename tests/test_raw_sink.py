"""Daily raw documents, from raw rows to landed rows, and the backfill job."""

from __future__ import annotations

import copy
import datetime as dt
import json
import os

import pytest

from stridelake.config import DEFAULT_LANDING_CONFIG
from stridelake.plans.landing import MalformedDocumentError, land_asset, run_backfill, run_landing
from stridelake.sources.raw_sink import daily_documents, write_daily_documents

CLOCK = dt.datetime(2024, 5, 1, 12, 0, 0)


def config(root):
    c = copy.deepcopy(DEFAULT_LANDING_CONFIG)
    c.update(source_path=os.path.join(root, "raw"), landing_path=os.path.join(root, "landing"),
             quarantine_dir=os.path.join(root, "quarantine"))
    return c


def activity(i, local="2024-03-02 07:00:00", gmt="2024-03-02 06:00:00", **over):
    a = {"activityId": i, "startTimeLocal": local, "startTimeGMT": gmt, "activityName": f"Lauf {i} \"ä\"",
         "activityType": {"typeKey": "running"}, "distance": 5000.0, "duration": 1500.0}
    return {**a, **over}


def payloads(spark, acts):
    return spark.createDataFrame([(i, None if a is None else json.dumps(a)) for i, a in enumerate(acts)], "seq long, payload string")


def raw_files(root):
    base = os.path.join(root, "raw", "activities")
    return {f"{d}/{f}": json.load(open(os.path.join(base, d, f), encoding="utf-8"))
            for d in sorted(os.listdir(base)) for f in os.listdir(os.path.join(base, d)) if f.endswith(".json")}


def test_raw_rows_become_daily_files_and_landed_rows(spark, tmp_root):
    acts = [
        activity(5, "2024-03-02 23:00:00", "2024-03-03 01:00:00"),  # the local day counts
        activity(3, "", "2024-03-03 01:00:00"),                     # no local start: GMT
        activity(4, "2024", "2024-03-03 01:00:00"),                 # a short local start: the fallback
        activity(1), None, activity(2, None, None),
    ]
    raw, stamp = os.path.join(tmp_root, "raw"), "2024-03-05T10:00:00"
    write = lambda p, **kw: write_daily_documents(payloads(spark, p), raw, "activities", kw.pop("at", stamp), "2024-03-01", order_col="seq", **kw)
    files = write(acts)
    assert [f.split("/activities/")[1] for f in files] == [f"dt=2024-03-0{d}/activities_{stamp}.json" for d in (1, 2, 3)]
    ids = {k: [a["activityId"] for a in v] for k, v in raw_files(tmp_root).items()}
    assert ids == {f"dt=2024-03-0{d}/activities_{stamp}.json": x for d, x in ((1, [4, 2]), (2, [5, 1]), (3, [3]))}
    assert raw_files(tmp_root)[f"dt=2024-03-02/activities_{stamp}.json"][0] == acts[0]

    cfg = config(tmp_root)
    summary = run_landing(spark, cfg, asset_names=["activities"], clock=CLOCK, gate=False)
    landed = lambda: sorted((r.activity_id, str(r.dt)) for r in spark.read.parquet(os.path.join(tmp_root, "landing", "activities")).collect())
    # activities 2, 3 and 4 lack no required column but for 2's start times: its file is quarantined whole
    assert landed() == [(1, "2024-03-02"), (3, "2024-03-03"), (5, "2024-03-02")]
    assert summary["rows_invalid"] == 2 and summary["staged_files"] == 2

    write([activity(9)], at="2024-03-06T10:00:00")  # a newer snapshot of one day; the others are not touched
    assert len(raw_files(tmp_root)) == 4
    write([activity(9)], at="2024-03-06T10:00:00")  # the same run again
    assert len(raw_files(tmp_root)) == 4
    run_landing(spark, cfg, asset_names=["activities"], clock=CLOCK, gate=False)
    assert landed() == [(3, "2024-03-03"), (9, "2024-03-02")]
    write([activity(10)], at="2024-03-07T10:00:00", keep_older=False)
    assert [k for k in raw_files(tmp_root) if "dt=2024-03-02" in k] == ["dt=2024-03-02/activities_2024-03-07T10:00:00.json"]
    assert not [f for f in os.listdir(raw) if f != "activities"]  # nothing staged is left


def test_payloads_that_are_no_json_fail(spark):
    bad = spark.createDataFrame([("{not json",)], "payload string")
    with pytest.raises(Exception, match="not JSON"):
        daily_documents(bad, "2024-03-01").collect()
    assert daily_documents(bad.limit(0), "2024-03-01").collect() == []


def put(root, folder, day, name, payload):
    d = os.path.join(root, "raw", folder, f"dt={day}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w", encoding="utf-8") as f:
        f.write(payload if isinstance(payload, str) else json.dumps(payload))


def lap(i):
    return {"activityId": i, "lapDTOs": [{"startTimeGMT": "t", "distance": 1.0, "duration": 1.0, "messageIndex": 0}]}


def test_backfill_lands_existing_days_of_all_assets(spark, tmp_root):
    cfg = config(tmp_root)
    for d in ("2024-03-01", "2024-03-03", "2024-03-09"):
        put(tmp_root, "activities", d, "activities_a.json", [activity(int(d[-2:]))])
    put(tmp_root, "splits", "2024-03-02", "splits_2.json", lap(2))
    run_landing(spark, cfg, asset_names=["activities"], clock=CLOCK)
    put(tmp_root, "activities", "2024-03-09", "activities_b.json", [activity(90)])  # outside the range
    put(tmp_root, "activities", "2024-03-03", "activities_b.json", [activity(30)])
    got = run_backfill(spark, cfg, "2024-03-01", "2024-03-05", ["activities", "splits", "workouts"], clock=CLOCK)
    assert got["dates"] == ["2024-03-01", "2024-03-02", "2024-03-03"]
    assert [c["files_seen"] for c in got["per_asset"]] == [2, 1, 0]  # newest list file a day; workouts have no folder
    rows = spark.read.parquet(os.path.join(tmp_root, "landing", "activities")).collect()
    assert sorted((r.activity_id, str(r.dt)[-2:]) for r in rows) == [(1, "01"), (9, "09"), (30, "03")]
    assert spark.read.parquet(os.path.join(tmp_root, "landing", "splits")).count() == 1
    none = run_backfill(spark, cfg, "2023-01-01", "2023-01-05", ["activities"], clock=CLOCK)
    assert none["dates"] == [] and none["staged_files"] == 0
    with pytest.raises(ValueError, match="required"):
        run_backfill(spark, cfg, None, "2024-03-05")


def test_backfill_command(spark, tmp_root, capsys):
    from stridelake.cli import main

    put(tmp_root, "splits", "2024-03-02", "splits_2.json", lap(2))
    put(tmp_root, "splits", "2024-03-07", "splits_7.json", lap(7))
    args = [f"--{k}={os.path.join(tmp_root, v)}" for k, v in (("source", "raw"), ("landing", "landing"), ("quarantine", "q"))]
    assert main(["backfill", *args, "--start=2024-03-01", "--end=2024-03-03", "--assets=splits"]) == 0
    assert json.loads(capsys.readouterr().out)["dates"] == ["2024-03-02"]
    assert [r.activity_id for r in spark.read.parquet(os.path.join(tmp_root, "landing", "splits")).collect()] == [2]


def test_days_become_a_partition_filter(spark, tmp_root):
    from stridelake.sources.raw import scan_raw

    for d in ("2024-03-01", "2024-03-02"):
        put(tmp_root, "splits", d, "splits_1.json", lap(1))
    docs = scan_raw(spark, os.path.join(tmp_root, "raw"), "splits", days=["2024-03-02"])
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "dt#" in plan[plan.index("PartitionFilters") :] and "2024-03-02" in plan[plan.index("PartitionFilters") :]
    assert docs.count() == 1


def test_malformed_files_stop_the_job_or_go_to_their_own_table(spark, tmp_root):
    cfg = config(tmp_root)
    put(tmp_root, "splits", "2024-03-02", "splits_1.json", lap(1))
    land_asset(spark, cfg, "splits", clock=CLOCK)
    put(tmp_root, "splits", "2024-03-02", "splits_2.json", lap(2))
    put(tmp_root, "splits", "2024-03-02", "splits_3.json", "{not json")
    with pytest.raises(MalformedDocumentError, match="splits_3.json"):
        land_asset(spark, cfg, "splits", clock=CLOCK)
    landed = lambda: sorted(r.activity_id for r in spark.read.parquet(os.path.join(tmp_root, "landing", "splits")).collect())
    assert landed() == [1]  # nothing was moved
    counts = land_asset(spark, cfg, "splits", clock=CLOCK, on_malformed="quarantine")
    assert (counts["files_seen"], counts["malformed_files"], counts["rows_valid"]) == (3, 1, 2) and landed() == [1, 2]
    texts = spark.read.parquet(os.path.join(tmp_root, "quarantine", "malformed", "splits")).collect()
    assert [(r.source_file, r.raw_text) for r in texts] == [("splits_3.json", "{not json")]
    put(tmp_root, "splits", "2024-03-02", "splits_3.json", lap(3))  # mended: its text leaves the table
    land_asset(spark, cfg, "splits", clock=CLOCK, on_malformed="quarantine")
    assert landed() == [1, 2, 3] and not os.path.exists(os.path.join(tmp_root, "quarantine", "malformed", "splits", "dt=2024-03-02"))
    assert not [f for f in os.listdir(os.path.join(tmp_root, "landing")) if f != "splits"]


def as_lines(cfg):
    cfg["assets"]["activities"]["extract"]["layout"] = "lines"
    return cfg


def test_list_files_by_lines_equal_whole_documents(spark, tmp_root):
    """A large array is split over tasks; the landed rows, quarantine and counts are those of whole documents."""
    acts = [activity(i, f"2024-03-0{1 + i % 3} 07:00:00", activityName="[1,2],{\"]") for i in range(600)]
    del acts[2]["distance"]  # spoils the file of 2024-03-03
    write_daily_documents(payloads(spark, acts), os.path.join(tmp_root, "raw"), "activities", "2024-03-05T10:00:00", "2024-03-01")
    whole = config(tmp_root)
    lines = as_lines({**copy.deepcopy(whole), "landing_path": os.path.join(tmp_root, "l2"), "quarantine_dir": os.path.join(tmp_root, "q2")})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        from stridelake.sources.raw import scan_raw

        docs = scan_raw(spark, whole["source_path"], "activities", lines=True)
        assert docs.rdd.getNumPartitions() > 6 > len(raw_files(tmp_root))
        a, b = (land_asset(spark, c, "activities", clock=CLOCK) for c in (whole, lines))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert a == b and (a["rows_valid"], a["rows_invalid"], a["staged_files"]) == (400, 200, 2)
    for x, y in (("landing", "l2"), ("quarantine", "q2")):
        x, y = (spark.read.parquet(os.path.join(tmp_root, r, "activities")) for r in (x, y))
        assert x.columns == y.columns and x.exceptAll(y).count() == 0 == y.exceptAll(x).count()
    assert sorted(os.listdir(os.path.join(tmp_root, "l2"))) == ["activities"]


def test_broken_line_files_are_malformed(spark, tmp_root):
    one = json.dumps(activity(1, None))
    texts = {
        "01": f"[{one}\n,{one}\n]", "02": f"[\n{one},\n{one}\n]\n", "03": "[]", "04": "[\n]",  # well-formed
        "11": f"[{one}\n{one}]", "12": f"[{one}", "13": f"{one}]", "14": f"[{one},\n]", "15": f"[{one}]\n[{one}]", "16": f"[{one}\n,{{x]",
    }
    for d, t in texts.items():
        put(tmp_root, "activities", f"2024-03-{d}", "activities_a.json", t)
    counts = land_asset(spark, as_lines(config(tmp_root)), "activities", clock=CLOCK, on_malformed="quarantine")
    assert (counts["files_seen"], counts["malformed_files"], counts["rows_invalid"], counts["rows_valid"]) == (10, 6, 4, 0)
    bad = spark.read.parquet(os.path.join(tmp_root, "quarantine", "malformed", "activities"))
    assert sorted({str(r.dt)[-2:] for r in bad.collect()}) == ["11", "12", "13", "14", "15", "16"]
    with pytest.raises(MalformedDocumentError, match="6 malformed"):
        land_asset(spark, as_lines(config(tmp_root)), "activities", clock=CLOCK)
