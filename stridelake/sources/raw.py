"""Raw JSON payload sources.

Layout: ``<source_path>/<source_folder>/dt=YYYY-MM-DD/*.json``, one JSON
document per file. ``scan_raw`` reads every file whole (``wholetext``), so
one row = one file; ``dt`` comes from partition discovery (kept as a string
so ``dt`` bounds prune folders) and ``source_file`` from ``_metadata``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_raw(
    spark: SparkSession,
    source_path: str,
    source_folder: str,
    start_date: str | None = None,
    end_date: str | None = None,
    days: list[str] | None = None,
    lines: bool = False,
) -> DataFrame:
    """One row per JSON file: (dt, source_file, value); the bounds and ``days`` prune ``dt=`` folders.

    With ``lines`` one row per line: large files are split over tasks.
    """
    root = f"{source_path.rstrip('/')}/{source_folder}"
    df = (
        spark.read.format("text")
        .schema("value string, dt string")
        .option("wholetext", "false" if lines else "true")
        .option("pathGlobFilter", "*.json")
        .load(root)
    )
    if start_date is not None:
        df = df.filter(F.col("dt") >= start_date)
    if end_date is not None:
        df = df.filter(F.col("dt") <= end_date)
    if days is not None:
        df = df.filter(F.col("dt").isin(days))
    return df.select("dt", F.col("_metadata.file_name").alias("source_file"), "value")


def list_elements(lines: DataFrame) -> DataFrame:
    """Lines of JSON arrays laid out one element a line -> (dt, source_file, value, opens, closes, commas).

    ``value`` is the element's text, '' on a line that has brackets only; blank lines are left out. A
    comma may end a line or begin the next one.
    """
    text = F.trim(F.regexp_replace("value", r"[\r\t]", " "))
    head, tail = F.substring("text", 1, 1), F.substring("text", -1, 1)
    opens, leads = (head == "["), (head == ",")
    body = F.when(opens | leads, F.expr("substring(text, 2)")).otherwise(F.col("text"))
    marked = lines.select("dt", "source_file", text.alias("text")).filter("text <> ''")
    marked = marked.select("dt", "source_file", opens.alias("opens"), leads.alias("leads"), body.alias("body"), tail.alias("tail"))
    closes, trails = (F.col("tail") == "]") & (F.col("body") != ""), (F.col("tail") == ",") & (F.col("body") != "")
    value = F.trim(F.when(closes | trails, F.expr("substring(body, 1, length(body) - 1)")).otherwise(F.col("body")))
    return marked.select(
        "dt", "source_file", value.alias("value"), "opens", closes.alias("closes"),
        (F.col("leads").cast("int") + trails.cast("int")).alias("commas"),
    )


def latest_snapshot_file(docs: DataFrame) -> DataFrame:
    """Keep only the lexically last file per ``dt`` (list payloads).

    File names embed the ISO ingest time, so last = newest. The pick is a
    tiny aggregate (one row per day) joined back as a semi join.
    """
    latest = docs.groupBy("dt").agg(F.max("source_file").alias("source_file"))
    # One row per day: AQE broadcasts it at run time from its measured size.
    return docs.join(latest, ["dt", "source_file"], "left_semi")


def landing_scan(spark: SparkSession, landing_path: str, asset: str) -> DataFrame:
    """A landing table: every ``dt=`` partition, columns unified by name.

    ``mergeSchema`` lets partitions written before a column was added be
    read together with newer ones (missing columns read as NULL).
    """
    return spark.read.option("mergeSchema", "true").parquet(f"{landing_path.rstrip('/')}/{asset}")
