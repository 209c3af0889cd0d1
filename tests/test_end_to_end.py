"""Raw JSON files -> landing -> bronze -> silver/gold -> quality report."""

from __future__ import annotations

import copy
import datetime as dt
import os

from pyspark.sql import functions as F

from stridelake.config import DEFAULT_LANDING_CONFIG
from stridelake.plans.incremental_build import incremental_build
from stridelake.plans.landing import run_landing
from stridelake.plans.medallion import bronze_tables, models_from_landing, quality_report
from stridelake.sources import raw_docs

SF = "/root/testdata/sf0.001"


def write_documents(docs, root):
    """Lay documents out as ``<root>/dt=<d>/<source_file>`` files."""
    for r in docs.toLocalIterator():
        d = os.path.join(root, f"dt={r['dt']}")
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, r["source_file"]), "w", encoding="utf-8") as f:
            f.write(r["value"])


def test_raw_to_gold(spark, tmp_root):
    raw = os.path.join(tmp_root, "raw")
    # a few days of derived payload files, laid out as the ingest writes them
    for asset, fn in raw_docs.DOCUMENT_SOURCES.items():
        docs = fn(spark, SF)
        days = sorted(r.dt for r in docs.select("dt").distinct().collect())[:12]
        write_documents(docs.filter(F.col("dt").isin(days)), os.path.join(raw, asset))
    cfg = copy.deepcopy(DEFAULT_LANDING_CONFIG)
    cfg.update(source_path=raw, landing_path=os.path.join(tmp_root, "landing"),
               quarantine_dir=os.path.join(tmp_root, "quarantine"))
    summary = run_landing(spark, cfg, clock=dt.datetime(2024, 1, 1), gate=False)
    assert summary["rows_valid"] > 0 and summary["rows_invalid"] > 0  # planted defects were quarantined

    models = models_from_landing(spark, cfg["landing_path"])
    assert models.running_trainings.count() > 0
    paths = incremental_build(spark, models, os.path.join(tmp_root, "models"))
    assert spark.read.parquet(paths["running_trainings_summary"]).count() == models.running_trainings.count()

    report = {(r.model, r.test, r.column_name): r.failures
              for r in quality_report(models, bronze_tables(spark, cfg["landing_path"])).collect()}
    assert len(report) == 37
    assert report[("running_trainings", "unique", "activity_id")] == 0
    assert report[("running_splits", "relationships", "activity_id")] == 0
