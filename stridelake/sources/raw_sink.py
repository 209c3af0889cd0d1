"""Raw activity payloads filed as one JSON document per event day.

``write_daily_documents`` is the storing half of the ingest: every payload goes under the ``dt=`` folder of its
event date (local start, else GMT start, else a fallback), and each day's payloads form one JSON array in one file
whose name carries the ingest time, so that landing's "latest file of the day" finds it.

A day's document is streamed: the day's payloads pass sorted through the task that writes the file, a line
each, with the brackets and commas set from the neighbouring rows. No array is collected. Files are
written beside the folder and moved in by rename; days without a payload in the batch are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import event_date
from ..operators.incremental import _delete, _move_in, beside, partition_folders


def daily_documents(payloads: DataFrame, fallback_date: str, payload_col: str = "payload", order_col: str | None = None) -> DataFrame:
    """(dt, value): the lines of each day's JSON array, in the order of ``order_col``, then of the text.

    A row whose payload is no JSON fails the job, as it would spoil its whole day; rows without a payload
    hold no activity and have no line.
    """
    p = F.col(payload_col)
    checked = F.when(F.try_parse_json(p).isNull(), F.raise_error(F.concat(F.lit("not JSON: "), F.substring(p, 1, 80)))).otherwise(p)
    dated = payloads.filter(p.isNotNull()).select(
        event_date(F.get_json_object(p, "$.startTimeLocal"), F.get_json_object(p, "$.startTimeGMT"), F.lit(fallback_date)).alias("dt"),
        (F.col(order_col) if order_col else F.lit(0)).alias("rank"),
        checked.alias("payload"),
    )
    day = Window.partitionBy("dt").orderBy("rank", "payload")
    first, last = F.row_number().over(day) == 1, F.lead(F.lit(1)).over(day).isNull()
    numbered = dated.select("dt", "payload", first.alias("first"), last.alias("last"))
    opening, closing = F.when(F.col("first"), "[").otherwise(","), F.when(F.col("last"), "]").otherwise("")
    return numbered.select("dt", F.concat(opening, "payload", closing).alias("value"))


def write_daily_documents(
    payloads: DataFrame,
    storage_root: str,
    folder: str,
    ingestion_time: str,
    fallback_date: str,
    payload_col: str = "payload",
    order_col: str | None = None,
    keep_older: bool = True,
) -> list[str]:
    """Write ``<storage_root>/<folder>/dt=<day>/<folder>_<ingestion_time>.json``; returns the files.

    A second run with the same ingest time replaces its files. Older files of a touched day stay, as
    landing takes the newest, unless ``keep_older`` is false.
    """
    spark = payloads.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = f"{storage_root.rstrip('/')}/{folder}"
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged = beside(root)
    docs = daily_documents(payloads, fallback_date, payload_col, order_col)
    docs.write.option("maxRecordsPerFile", 0).partitionBy("dt").text(staged)
    written = []
    for day in partition_folders(spark, staged, "dt"):
        parts = [st.getPath() for st in fs.listStatus(path(f"{staged}/{day}")) if st.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise OSError(f"{day}: {len(parts)} files instead of one")
        if not keep_older and fs.exists(path(f"{root}/{day}")):
            _move_in(spark, None, f"{root}/{day}", f"{staged}-replaced/{day}")
        target = f"{root}/{day}/{folder}_{ingestion_time}.json"
        _move_in(spark, parts[0].toString(), target, f"{staged}-replaced/{day}-{folder}.json")
        written.append(target)
    _delete(spark, staged)
    _delete(spark, f"{staged}-replaced")
    return written
