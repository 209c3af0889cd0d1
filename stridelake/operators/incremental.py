"""Incremental processing: high-water mark filter and keyed upsert.

``incremental_filter`` keeps batch rows at or after ``max(target.col) -
lookback``. The mark is a scalar subquery, so the plan stays lazy and, when
``col`` is a partition column of the batch, Spark prunes partitions with it
at run time. The semantics of the original models are kept on purpose:
inclusive bound (the last day is always reprocessed), late partitions older
than the mark are skipped, and an existing-but-empty target yields a NULL
mark, so nothing loads.

``upsert`` is delete-then-insert by key: target rows whose key appears in
the batch are replaced; NULL keys never match; duplicates inside the batch
are kept.

``write_upsert`` applies an upsert to a parquet table folder without a
table format. It never overwrites a path it is reading: new files are written beside the table and
moved in by rename, so a failure before the move leaves the table as it was. A table without partitions is
moved in whole. For a partitioned one only the partitions (the NULL one included) that hold batch keys
or batch rows are rewritten; finding them reads the key columns of the target alone.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def mark_column(target: DataFrame, col: str, lookback_days: int = 0) -> Column:
    """``max(target.col) - lookback_days`` as a lazy scalar subquery."""
    mark = target.agg(F.max(F.col(col).cast("date")).alias("_mark"))
    return F.date_sub(mark.scalar(), lookback_days)


def incremental_filter(
    batch: DataFrame,
    col: str,
    target: DataFrame | None,
    lookback_days: int = 0,
    mark_col: str | None = None,
) -> DataFrame:
    """Rows of ``batch`` with ``col >= max(target.mark_col) - lookback``.

    ``target=None`` is the first run / full refresh: everything loads.
    """
    if target is None:
        return batch
    return batch.filter(F.col(col).cast("date") >= mark_column(target, mark_col or col, lookback_days))


def upsert(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    batch_keys = batch.select(*keys).distinct()
    kept = target.join(batch_keys, keys, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _move_in(spark: SparkSession, new: str | None, target: str, aside: str) -> None:
    """Rename the folder ``new`` (None: nothing) to ``target``; what was there goes to ``aside``, and comes back on failure."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(path(target))
    if had:
        fs.mkdirs(path(aside).getParent())
        if not fs.rename(path(target), path(aside)):
            raise OSError(f"{target}: could not be moved aside")
    if new is None:
        return
    fs.mkdirs(path(target).getParent())
    try:
        moved = fs.rename(path(new), path(target))
    except Py4JJavaError:
        moved = False
    if not moved:
        if had:
            fs.rename(path(aside), path(target))
        raise OSError(f"{target}: could not be replaced; the new rows are in {new}")


def replace_table(spark: SparkSession, target: str, df: DataFrame, partition_col: str | None = None) -> None:
    """Write ``df`` as the whole table; the old one, if any, is there until the new one is complete."""
    new = beside(target)
    w = df.write
    (w.partitionBy(partition_col) if partition_col else w).parquet(new)
    _move_in(spark, new, target, f"{new}-replaced")
    _delete(spark, f"{new}-replaced")


def beside(target: str) -> str:
    """A fresh folder name next to ``target``: on its filesystem, so that a rename moves it in."""
    return f"{target.rstrip('/')}-{uuid.uuid4().hex[:12]}"


def partition_folders(spark: SparkSession, root: str, col: str) -> list[str]:
    """Names ``col=value`` of the partition folders under ``root``: a listing, one entry a partition."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(path) if st.getPath().getName().startswith(f"{col}="))


def publish_partitions(spark: SparkSession, staged: str, target: str, folders: list[str]) -> None:
    """Each of ``folders`` of ``target`` becomes that of ``staged``; one that is not staged goes."""
    root, aside = target.rstrip("/"), f"{staged}-replaced"
    have = {f for col in {f.split("=")[0] for f in folders} for f in partition_folders(spark, staged, col)}
    for f in folders:
        _move_in(spark, f"{staged}/{f}" if f in have else None, f"{root}/{f}", f"{aside}/{f}")
    _delete(spark, staged)
    _delete(spark, aside)


def _partition_literal(v) -> str:
    if v is None:
        return "__HIVE_DEFAULT_PARTITION__"
    if isinstance(v, (_dt.date, _dt.datetime)):
        return v.isoformat()
    return str(v)


def newest_per_key(batch: DataFrame, keys: list[str], newest_by: list[str]) -> DataFrame:
    """One row per key: the one of the latest ``newest_by`` (ties: a fixed hash order).

    Rows with a NULL key match nothing; their distinct rows all stay.
    """
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    rank = F.struct(*newest_by, F.xxhash64(*batch.columns))
    best = batch.filter(has_key).groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys])
    one = best.agg(F.max_by(F.struct(*batch.columns), rank).alias("_row")).select("_row.*")
    return one.unionByName(batch.filter(~has_key).distinct())


def not_outdated(spark: SparkSession, target_path: str, batch: DataFrame, keys: list[str], newest_by: str) -> DataFrame:
    """Batch rows but those whose key the target holds with a greater ``newest_by``.

    Reads the target's keys and ``newest_by`` alone. A missing target holds nothing; NULL keys match nothing.
    """
    if not _path_exists(spark, target_path):
        return batch
    held = spark.read.schema(batch.schema).parquet(target_path).groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys])
    held = held.agg(F.max(newest_by).alias("_newest"))
    same = F.lit(True)
    for k in keys:
        same = same & (batch[k] == F.col(f"_key_{k}"))
    return batch.join(held, same & (batch[newest_by] < F.col("_newest")), "left_anti")


def write_upsert(
    spark: SparkSession,
    target_path: str,
    batch: DataFrame,
    keys: list[str],
    partition_col: str | None = None,
) -> None:
    """Upsert ``batch`` into the parquet table at ``target_path``."""
    if not _path_exists(spark, target_path):
        replace_table(spark, target_path, batch, partition_col)
        return

    # The batch's schema also reads a table that was written empty (no files).
    target = spark.read.schema(batch.schema).parquet(target_path)
    if partition_col is None:
        replace_table(spark, target_path, upsert(target, batch, keys))
        return

    # The batch is computed once: its staged files are what is moved in, and its keys are read from them.
    staged = beside(target_path)
    batch.write.partitionBy(partition_col).parquet(staged)
    batch = spark.read.schema(batch.schema).parquet(staged)
    batch_keys = batch.select(*keys).distinct()
    # Partitions touched: those holding a key being replaced, plus the batch's.
    touched_df = (
        target.join(batch_keys, keys, "left_semi").select(partition_col)
        .union(batch.select(partition_col))
        .distinct()
    )
    touched = [r[0] for r in touched_df.collect()]  # one value per partition (days), not rows
    if not touched:
        _delete(spark, staged)
        return  # empty batch: nothing to replace or insert
    in_touched = F.col(partition_col).isin([v for v in touched if v is not None])
    if None in touched:  # isin never matches NULL
        in_touched = in_touched | F.col(partition_col).isNull()
    kept = target.filter(in_touched).join(batch_keys, keys, "left_anti")
    kept.write.mode("append").partitionBy(partition_col).parquet(staged)
    folders = [f"{partition_col}={_partition_literal(v)}" for v in touched]
    publish_partitions(spark, staged, target_path, folders)
