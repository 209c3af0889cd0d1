"""Helpers shared by the operators: table access, hold-out remainders, scratch tables."""

from __future__ import annotations

import contextlib
import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.session import ensure_checkpoint_dir

#: ASCII white space, the separators of words in every contract: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, A-Z lower-cased; null has none.

    ``bytes.lower`` and ``bytes.split`` know only ASCII letters and exactly those six separators.
    """
    return text.encode().lower().split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): extra columns, whatever their names, stay outside the operator."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def remainder(key: Column, mod: int) -> Column:
    """crc32 of the id as text, mod ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % F.lit(mod)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices of the Arrow batches, so that Python objects of few texts exist at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"{stem}_{i}" for i in itertools.count()) if n.lower() not in taken)


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """The table written to the shared folder of spark.checkpoint.dir and read again.

    Cuts lineage like ``checkpoint``, in columnar form: the files survive lost executors.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends; otherwise they stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
