"""Raw JSON -> landing (valid files) + quarantine (invalid files).

One Spark job per asset over a whole date range:

scan (one row per file) -> [list payloads: latest file per day]
-> extract records + per-file validity (inside the row, no shuffle)
-> one row per record, marked valid or invalid -> one write by (outcome, day)
-> the processed days are moved into ``<landing>/<asset>/dt=.../`` and ``<quarantine>/<asset>/dt=.../``.

Files and rows are counted while they are written: an ``Observation`` sits in the stage of the write,
whose tasks count once however often a lost executor makes earlier stages run again. Nothing is persisted
or read a second time. Days that were processed but produced no valid (or no invalid) rows have
their old output removed, as a rerun of the original task does.

A list asset whose files have one element a line (``extract.layout: lines``, as the daily raw writer lays
them out) is not read by whole documents: its lines are split over tasks and extracted one by one, the typed
rows are written once, and what is wrong with a file is counted from that table and joined back, so no
row holds a document that grows with the day.

A malformed file stops the job before anything is moved (``on_malformed="raise"``), or its text goes to a
third table, ``<quarantine>/malformed/<asset>/dt=.../`` (``"quarantine"``), while the other files land.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import validate_config
from ..operators.extract import extract_documents
from ..operators.incremental import _delete, beside, partition_folders, publish_partitions
from ..operators.ingest import backfill_dates, discover_partitions
from ..sources.raw import latest_snapshot_file, list_elements, scan_raw

METADATA_COLUMNS = ("ingested_at", "ingestion_date", "run_date", "source_file")


class QualityGateError(RuntimeError):
    pass


class MalformedDocumentError(ValueError):
    pass


def stage_documents(docs: DataFrame, asset: dict, spread: int | None = None) -> DataFrame:
    """Snapshot filter + extraction; one row per file kept.

    Extraction is CPU-heavy per document. File scans already split work by
    file; documents produced by an upstream shuffle can arrive coalesced
    into few tasks, so ``spread`` re-distributes them by file name (a
    deterministic hash, safe to recompute) over that many tasks first.
    """
    if asset["extract"]["payload_kind"] == "list":
        docs = latest_snapshot_file(docs)
    if spread:
        docs = docs.repartition(spread, "source_file")
    return extract_documents(docs, asset)


def _row_columns(asset: dict, clock: _dt.datetime) -> list:
    """A record's columns and its metadata, from ``r`` (the record), ``dt`` and ``source_file``."""
    targets = [c["target"] for c in asset["column_mapping"]]
    ck = (asset["extract"].get("context_key") or {}).get("target")
    if ck and ck not in targets:
        targets.append(ck)
    return [
        *[F.col(f"r.`{t}`").alias(t) for t in targets],
        F.lit(clock.isoformat()).alias("ingested_at"),
        F.lit(clock.date().isoformat()).alias("ingestion_date"),
        F.col("dt").alias("run_date"),
        "source_file",
        "dt",
    ]


def landing_rows(staged: DataFrame, asset: dict, clock: _dt.datetime, valid: bool = True) -> DataFrame:
    """Exploded records of valid (or invalid) files plus metadata columns."""
    # The file choice sits inside the generator rather than in a Filter: a
    # Filter on ``valid`` would be pushed below the projection that builds
    # ``records`` and re-evaluate the whole extraction in its condition.
    chosen = F.when(F.col("parsed") & (F.col("valid") == F.lit(valid)), F.col("records"))
    rows = staged.select("dt", "source_file", F.explode(chosen).alias("r"))
    return rows.select(*_row_columns(asset, clock))


OUTCOME = "landing_outcome"


def counted_rows(staged: DataFrame, asset: dict, clock: _dt.datetime, seen: Observation) -> DataFrame:
    """Records of all parsed files with ``landing_outcome`` (valid, invalid); ``seen`` observes the counts.

    A file without records passes the observation as one row without a record and is filtered behind it.
    """
    rows = staged.select("dt", "source_file", "parsed", "valid", F.posexplode_outer("records").alias("at", "r"))
    # One file per outcome and day when days are small; AQE splits a hot
    # day over several tasks instead of one (rebalance).
    rows = rows.withColumn(OUTCOME, F.when(F.col("valid"), "valid").otherwise("invalid")).hint("rebalance", OUTCOME, "dt")
    record = F.col("at").isNotNull() & F.col("parsed")
    observed = rows.observe(
        seen,
        F.count_if(F.coalesce(F.col("at"), F.lit(0)) == 0).alias("files_seen"),
        F.count_if(record & F.col("valid")).alias("rows_valid"),
        F.count_if(record & ~F.col("valid")).alias("rows_invalid"),
        F.count_if(~F.col("parsed")).alias("malformed_files"),
    )
    return observed.filter(record).select(*_row_columns(asset, clock), OUTCOME)


def batch_counts(staged: DataFrame, asset_name: str) -> DataFrame:
    """Per (asset, dt): files_seen, rows_valid, rows_invalid, staged_files, malformed_files."""
    n = F.size("records")
    return staged.groupBy("dt").agg(
        F.count(F.lit(1)).cast("bigint").alias("files_seen"),
        F.sum(F.when(F.col("parsed") & F.col("valid"), n).otherwise(0)).cast("bigint").alias("rows_valid"),
        F.sum(F.when(F.col("parsed") & ~F.col("valid"), n).otherwise(0)).cast("bigint").alias("rows_invalid"),
        F.sum(F.when(~F.col("parsed"), 1).otherwise(0)).cast("bigint").alias("malformed_files"),
    ).select(
        F.lit(asset_name).alias("asset"),
        "dt",
        "files_seen",
        "rows_valid",
        "rows_invalid",
        F.when(F.col("rows_valid") > 0, 1).otherwise(0).cast("bigint").alias("staged_files"),
        "malformed_files",
    )


def run_summary(counts: DataFrame) -> DataFrame:
    """Totals over assets (missing counts are 0)."""
    def total(c: str):
        return F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c)

    cols = set(counts.columns)
    quarantine = total("quarantine_files") if "quarantine_files" in cols else F.lit(0).cast("bigint").alias("quarantine_files")
    return counts.agg(
        F.array_sort(F.collect_set("asset")).alias("assets"),
        total("rows_valid"),
        total("rows_invalid"),
        quarantine,
        total("staged_files"),
    )


def quality_gate(summary: dict) -> dict:
    problems = []
    if int(summary.get("rows_invalid") or 0) > 0:
        problems.append(f"invalid_rows={int(summary['rows_invalid'])}")
    if int(summary.get("quarantine_files") or 0) > 0:
        problems.append(f"quarantine_files={int(summary['quarantine_files'])}")
    if problems:
        raise QualityGateError("Quality gate failed: " + "; ".join(problems))
    return summary


def stage_elements(lines: DataFrame, asset: dict) -> DataFrame:
    """One row per line of list files: its record ``r`` (NULL on a line without one) and what the line says of its file."""
    single = {**asset, "extract": {**asset["extract"], "payload_kind": "record"}}
    staged = extract_documents(list_elements(lines), single)
    record = F.col("value") != ""
    return staged.select(
        "dt", "source_file", F.get("records", F.lit(0)).alias("r"),
        record.alias("is_record"),
        (record & ~F.col("valid")).alias("is_invalid"),
        (record & ~F.col("parsed")).alias("is_broken"),
        "opens", "closes", "commas",
    )


def file_outcomes(elements: DataFrame) -> DataFrame:
    """(dt, source_file, n, outcome) of list files from their lines: valid, invalid or malformed.

    A file is one array if it opens and closes once, each line's element is JSON, and there are as many commas
    as elements but one.
    """
    n, commas = F.count_if("is_record"), F.sum("commas")
    array = (F.count_if("opens") == 1) & (F.count_if("closes") == 1) & (F.count_if("is_broken") == 0)
    outcome = (
        F.when(~array | (commas != F.greatest(n - 1, F.lit(0))), "malformed")
        .when(F.count_if("is_invalid") > 0, "invalid")
        .otherwise("valid")
    )
    return elements.groupBy("dt", "source_file").agg(n.alias("n"), outcome.alias("outcome"))


def line_rows(spark: SparkSession, docs: DataFrame, asset: dict, clock: _dt.datetime, scratch: str) -> tuple[DataFrame, dict[str, int]]:
    """Records of all well-formed files of lines, with ``landing_outcome``, and the counts."""
    elements = stage_elements(latest_snapshot_file(docs), asset)
    elements.write.partitionBy("dt").parquet(scratch)
    elements = spark.read.schema(elements.schema).parquet(scratch)
    files = file_outcomes(elements)
    is_ = lambda o: F.col("outcome") == o
    counts = files.agg(
        F.count(F.lit(1)).alias("files_seen"),
        F.coalesce(F.sum(F.when(is_("valid"), F.col("n"))), F.lit(0)).alias("rows_valid"),
        F.coalesce(F.sum(F.when(is_("invalid"), F.col("n"))), F.lit(0)).alias("rows_invalid"),
        F.count_if(is_("malformed")).alias("malformed_files"),
    ).first().asDict()
    good = files.filter(F.col("outcome") != "malformed").select("dt", "source_file", F.col("outcome").alias(OUTCOME))
    rows = elements.filter("is_record").select("dt", "source_file", "r").join(good, ["dt", "source_file"])
    return rows.hint("rebalance", OUTCOME, "dt").select(*_row_columns(asset, clock), OUTCOME), counts


COUNTS = ("files_seen", "rows_valid", "rows_invalid", "staged_files", "malformed_files")


def land_asset(
    spark: SparkSession,
    config: dict,
    asset_name: str,
    start_date: str | None = None,
    end_date: str | None = None,
    clock: _dt.datetime | None = None,
    on_malformed: str = "raise",
    days: list[str] | None = None,
) -> dict:
    """Land one asset for a date range, or for the listed ``days``; returns its counts.

    ``staged_files`` is the number of days with landed rows. An asset without a raw folder of these days
    has no files: its counts are 0 and its tables stay as they are.
    """
    if on_malformed not in ("raise", "quarantine"):
        raise ValueError("on_malformed must be 'raise' or 'quarantine'")
    asset = config["assets"][asset_name]
    clock = clock or _dt.datetime.now()
    raw_root = f"{config['source_path'].rstrip('/')}/{asset['source_folder']}"
    found = [f.removeprefix("dt=") for f in partition_folders(spark, raw_root, "dt")]
    wanted = set(days) if days is not None else None
    processed = [
        d for d in found
        if (wanted is None or d in wanted) and (start_date is None or d >= start_date) and (end_date is None or d <= end_date)
    ]
    counts = {"asset": asset_name, **dict.fromkeys(COUNTS, 0)}
    if not processed:
        return counts
    lines = asset["extract"].get("layout") == "lines"
    docs = scan_raw(
        spark, config["source_path"], asset["source_folder"], start_date, end_date, processed if days is not None else None, lines
    )
    landing_root = f"{config['landing_path'].rstrip('/')}/{asset_name}"
    quarantine_root = f"{config['quarantine_dir'].rstrip('/')}/{asset_name}"
    malformed_root = f"{config['quarantine_dir'].rstrip('/')}/malformed/{asset_name}"
    folders = [f"dt={d}" for d in processed]
    staged, broken, elements = beside(landing_root), beside(malformed_root), beside(landing_root)
    if lines:
        rows, seen = line_rows(spark, docs, asset, clock, elements)
        rows.write.partitionBy(OUTCOME, "dt").parquet(staged)
    else:
        observed = Observation()
        counted_rows(stage_documents(docs, asset), asset, clock, observed).write.partitionBy(OUTCOME, "dt").parquet(staged)
        seen = observed.get
    counts.update({k: int(v or 0) for k, v in seen.items()})
    if counts["malformed_files"]:
        chosen = latest_snapshot_file(docs) if asset["extract"]["payload_kind"] == "list" else docs
        if lines:
            bad = file_outcomes(stage_elements(chosen, asset)).filter("outcome = 'malformed'").select("dt", "source_file")
            texts = chosen.join(bad, ["dt", "source_file"]).select("dt", "source_file", F.col("value").alias("raw_text"))
        else:
            texts = chosen.filter(F.try_parse_json("value").isNull()).select("dt", "source_file", F.col("value").alias("raw_text"))
        if on_malformed == "raise":
            for folder in (staged, elements):
                _delete(spark, folder)
            names = [r.source_file for r in texts.select("source_file").distinct().orderBy("source_file").limit(10).collect()]
            raise MalformedDocumentError(f"{asset_name}: {counts['malformed_files']} malformed JSON file(s), e.g. {names}")
        texts.write.partitionBy("dt").parquet(broken)
    counts["staged_files"] = len(partition_folders(spark, f"{staged}/{OUTCOME}=valid", "dt"))
    publish_partitions(spark, f"{staged}/{OUTCOME}=valid", landing_root, folders)
    publish_partitions(spark, f"{staged}/{OUTCOME}=invalid", quarantine_root, folders)
    publish_partitions(spark, broken, malformed_root, folders)
    for folder in (staged, elements):
        _delete(spark, folder)
    return counts


def run_landing(
    spark: SparkSession,
    config: dict,
    start_date: str | None = None,
    end_date: str | None = None,
    asset_names: list[str] | None = None,
    clock: _dt.datetime | None = None,
    gate: bool = True,
    on_malformed: str = "raise",
    days: list[str] | None = None,
) -> dict:
    """Land all enabled assets; returns the totals and, as ``per_asset``, each asset's counts."""
    validate_config(config)
    names = asset_names or [n for n, a in config["assets"].items() if a.get("enabled", True)]
    clock = clock or _dt.datetime.now()
    per_asset = [land_asset(spark, config, n, start_date, end_date, clock, on_malformed, days) for n in names]
    totals = {
        "assets": names,
        "rows_valid": sum(c["rows_valid"] for c in per_asset),
        "rows_invalid": sum(c["rows_invalid"] for c in per_asset),
        "quarantine_files": 0,
        "staged_files": sum(c["staged_files"] for c in per_asset),
        "malformed_files": sum(c["malformed_files"] for c in per_asset),
        "per_asset": per_asset,
    }
    return quality_gate(totals) if gate else totals


def run_backfill(
    spark: SparkSession,
    config: dict,
    start_date: str | None,
    end_date: str | None,
    asset_names: list[str] | None = None,
    clock: _dt.datetime | None = None,
    gate: bool = True,
    on_malformed: str = "raise",
) -> dict:
    """Land the days of a range again: those for which any enabled asset has a raw folder.

    The days come from a listing of the folders and become the scans' ``dt IN (...)`` partition filter, one job
    per asset for all of them. Other days, landed or not, are not touched. ``dates`` are the days.
    """
    validate_config(config)
    names = asset_names or [n for n, a in config["assets"].items() if a.get("enabled", True)]
    folders = sorted({config["assets"][n]["source_folder"] for n in names})
    present = discover_partitions(spark, config["source_path"], folders)
    days = [r.run_date for r in backfill_dates(spark, start_date, end_date, present).collect()]  # one row a day
    return {**run_landing(spark, config, None, None, names, clock, gate, on_malformed, days), "dates": days}
