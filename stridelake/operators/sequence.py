"""Position of a row within its group, without sending a group to one task.

``row_number() over (partition by g order by o)`` routes every row of a
group to a single task; a hot group (say a third of all rows) then sorts in
one task. ``ordinal_within_group`` gives the same numbers with one exchange of the rows, whatever
column or combination of columns orders them:

1. groups are counted; the hot ones hold more than ``rows_per_chunk`` rows, or more than one
   ``max_chunks``-th of all rows, whichever is more;
2. a hot group's chunk borders are picked from a sample of its order keys (chosen by their hash, so that a
   task that runs again chooses the same);
3. rows are numbered within (group, chunk); a row of a hot group finds its chunk by a search in the
   borders, all other groups are one chunk;
4. chunks of hot groups are counted, and the running sum is added to the numbers of their rows.

Borders and offsets number at most about ``max_chunks`` and 2 ``max_chunks``, whatever the data, so both are
broadcast. Equal order keys stay in one chunk: the result equals the plain window if the order is total.

``ordinal_by_chunk`` is the shorter way where a column is known to cut every group into small chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order keys sampled per chunk, and borders compared at a time.
SAMPLED, BLOCK = 20, 64


def _same(left: list[Column], right: list[Column]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & a.eqNullSafe(b)
    return cond


def _borders(df: DataFrame, groups: list[str], key: Column, rows_per_chunk: int, max_chunks: int) -> DataFrame:
    """g0, g1, ... and blocks of sorted borders, one row per hot group."""
    g = [F.col(c).alias(f"g{i}") for i, c in enumerate(groups)]
    names = [f"g{i}" for i in range(len(groups))]
    counts = df.groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).scalar()
    chunk = F.greatest(F.lit(rows_per_chunk), F.ceil(total / F.lit(max_chunks)))
    hot = counts.withColumn("chunk", chunk).filter(F.col("n") > F.col("chunk")).select(*names, "chunk")
    hot = hot.select(*[F.col(n).alias(f"h{i}") for i, n in enumerate(names)], "chunk")
    keyed = df.select(*g, key.alias("key"))
    rows = keyed.join(F.broadcast(hot), _same([F.col(n) for n in names], [F.col(f"h{i}") for i in range(len(names))]))
    step = F.greatest(F.floor(F.col("chunk") / F.lit(SAMPLED)), F.lit(1))
    sample = rows.filter(F.pmod(F.xxhash64("key"), step) == 0)
    keys = sample.groupBy(*names).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    picked = F.array_distinct(F.filter("keys", lambda _, i: (i % SAMPLED) == SAMPLED - 1))
    cut = keys.withColumn("borders", picked).filter(F.size("borders") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("borders") - 1) / F.lit(BLOCK)))
    blocks = F.transform(starts, lambda b: F.slice("borders", (b * BLOCK + 1).cast("int"), F.lit(BLOCK)))
    return cut.select(*names, blocks.alias("blocks"))


def ordinal_within_group(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[str],
    name: str = "ordinal",
    start: int = 0,
    rows_per_chunk: int = 1_000_000,
    max_chunks: int = 10_000,
) -> DataFrame:
    """``df`` with ``name``: positions by ``order_cols``, ascending with nulls last, from ``start`` on."""
    columns = df.columns
    key = F.struct(*[x for i, c in enumerate(order_cols) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"c{i}"))])
    borders = _borders(df, group_cols, key, rows_per_chunk, max_chunks)
    names = [f"g{i}" for i in range(len(group_cols))]
    hot = F.broadcast(borders.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("blocks").alias("_blocks")))
    rows = df.join(hot, _same([df[c] for c in group_cols], [F.col(f"_{n}") for n in names]), "left")
    below = F.size(F.filter("_blocks", lambda b: F.element_at(b, -1) < key))
    inside = F.size(F.filter(F.coalesce(F.get(F.col("_blocks"), below), F.slice(F.col("_blocks")[0], 1, 0)), lambda b: b < key))
    chunk = F.when(F.col("_blocks").isNotNull(), (below * BLOCK + inside).cast("int")).otherwise(F.lit(-1))
    rows = rows.select(*columns, chunk.alias("_chunk"))

    of_hot = rows.filter(F.col("_chunk") >= 0).groupBy(*[F.col(c).alias(n) for c, n in zip(group_cols, names)], "_chunk")
    before = Window.partitionBy(*names).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_hot.agg(F.count(F.lit(1)).alias("n")).select(
        *names, F.col("_chunk").alias("chunk"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset")
    )
    local = F.row_number().over(
        Window.partitionBy(*group_cols, "_chunk").orderBy(*[F.col(c).asc_nulls_last() for c in order_cols])
    )
    numbered = rows.withColumn("_local", local)
    same = _same([numbered[c] for c in group_cols], [F.col(n) for n in names]) & (F.col("_chunk") == F.col("chunk"))
    placed = numbered.join(F.broadcast(offsets), same, "left")
    position = F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_local") - 1 + F.lit(start)
    return placed.select(*columns, position.cast("bigint").alias(name))


def ordinal_by_chunk(df: DataFrame, group_cols: list[str], order_cols: list[str], chunk: Column, name: str = "ordinal", tasks: int | None = None) -> DataFrame:
    """``df`` with ``name``: positions from 0 on, numbered within (group, chunk) and moved on by the earlier chunks' counts.

    ``chunk`` must not decrease in the order, and its chunks should be small (the hour of a timestamp, say).
    Rows are exchanged once, to ``tasks`` tasks if given: the offsets join them by the keys of their window. Rows
    with a NULL group or chunk have no position.
    """
    keys = [*group_cols, "_chunk"]
    chunked = df.withColumn("_chunk", chunk)
    before = Window.partitionBy(*group_cols).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = chunked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order_cols]))
    spread = chunked.repartition(tasks, *keys) if tasks else chunked
    placed = spread.withColumn("_local", local).join(offsets, keys, "left")
    return placed.select(*df.columns, (F.col("_offset") + F.col("_local") - 1).cast("bigint").alias(name))
