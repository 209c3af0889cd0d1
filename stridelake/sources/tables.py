"""Readers for the driver-supplied parquet tables.

Each reader names only the columns it needs so the parquet scan prunes the
rest (``ReadSchema`` in the plan); filters written downstream are pushed
into the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


#: Rows of a spread table that one task takes, and at least how many tasks there are (``spark.sql.shuffle.partitions``).
ROWS_PER_TASK = 500_000


#: Rows of the files that were counted, by application and files. A file replaced under its name keeps its old number, which only sizes tasks.
_COUNTED: dict[tuple, int] = {}


def tasks_for(df: DataFrame, rows_per_task: int = ROWS_PER_TASK, rows: int | None = None) -> int:
    """Number of tasks that keeps a task's rows bounded whatever the size of ``df``, a table read from Parquet.

    The rows are counted from the files' footers, in one small job when the plan is built (``df.count()`` would take two).
    """
    spark = df.sparkSession
    rows = _count(df) if rows is None else rows
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


def _count(df: DataFrame) -> int:
    return df.select()._jdf.rdd().count()


def read_table(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    columns: list[str] | None = None,
    spread_by: str | None = None,
) -> DataFrame:
    """Read a table, pruned to ``columns``.

    ``spread_by`` hashes the rows by this key over ``spark.sql.shuffle.partitions`` tasks, more if a task would
    get over ``ROWS_PER_TASK``, on any input, so that
    the plan does not depend on the files (a single-row-group file is one task however big it is). Use it
    with the key the next shuffle needs anyway (e.g. the key of a window),
    so it replaces that exchange instead of adding one, or ahead of
    CPU-heavy per-row work (JSON parsing) on a narrow table.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    if spread_by is not None:
        files = (spark.sparkContext.applicationId, *df.inputFiles())
        if files not in _COUNTED:
            _COUNTED[files] = _count(df)
        df = df.repartition(tasks_for(df, rows=_COUNTED[files]), spread_by)
    return df
