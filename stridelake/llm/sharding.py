"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Documents of equal text form a group; a group that is large against a shard is split into units
of bounded size, so no group has to fit one shard or one task. Units are dealt over blocks of
bounded row count by hash. Within a block every unit goes, largest first, to the shard where the
dot product of its demand with the residual capacity is highest. Each block fills an equal
part of all shards, so the shards of the whole table are sums of balanced parts, and ties fall
on a different shard in each block. Only counts per (block, shard) are gathered for numbering.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, stored

PLACED = "doc_id long, size long, text_crc32 long, n_tokens long, block long, shard int, local long"


def place_units(demand: np.ndarray, n_shards: int, start: int = 0) -> np.ndarray:
    """Shard of each unit; demand: units x (bytes, tokens, rows), in shares of one shard."""
    total = demand.sum(axis=0)
    used = total > 0
    d = demand[:, used] / (total[used] / n_shards)
    # The byte law decides: bytes weigh most, tokens and rows share the rest.
    weight = np.array([4.0, 0.5, 0.5])[used]
    residual = np.ones((n_shards, d.shape[1]))
    order = np.lexsort((np.arange(len(d)), -d[:, 0]))
    rotate = (np.arange(n_shards) + start) % n_shards
    shard = np.empty(len(d), np.int32)
    for u in order:
        gain = residual @ (d[u] * weight)
        s = rotate[np.argmax(gain[rotate])]
        residual[s] -= d[u]
        shard[u] = s
    return even_bytes(demand[:, 0], shard, n_shards)


def even_bytes(size: np.ndarray, shard: np.ndarray, n_shards: int, rounds: int = 400) -> np.ndarray:
    """Swap pairs of units between the fullest and the emptiest shard while that lowers their gap."""
    load = np.bincount(shard, weights=size, minlength=n_shards)
    for _ in range(rounds):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = load[hi] - load[lo]
        a, b = np.flatnonzero(shard == hi), np.flatnonzero(shard == lo)
        if gap <= 1e-4 * load.mean() or not len(a) or not len(b):
            break
        b = b[np.argsort(size[b], kind="stable")]
        at = np.clip(np.searchsorted(size[b], size[a] - gap / 2), 0, len(b) - 1)
        moved = size[a] - size[b[at]]
        best = int(np.abs(moved - gap / 2).argmin())
        if not 0 < moved[best] < gap:
            break
        shard[a[best]], shard[b[at[best]]] = lo, hi
        load[hi] -= moved[best]
        load[lo] += moved[best]
    return shard


def shard_documents(
    docs: DataFrame,
    n_shards: int = 40,
    rows_per_block: int = 20_000,
    units_per_shard: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, n_tokens, shard, slot: one row per row of ``docs``.

    size is UTF-8 bytes + 16; a null text counts as empty (size 16, crc 0, no token) and belongs to
    the group of empty texts. Repeated rows are rows of one group. Null ids are placed like others.
    Slots of a shard run from 0 without gaps. An empty table gives an empty table.
    """
    d = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    gaps = F.split("text", r"[\x20\x09-\x0D]+")
    rows = stored(
        d.select(
            "doc_id",
            (F.octet_length("text") + F.lit(16)).cast("long").alias("size"),
            F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
            F.size(F.filter(gaps, lambda x: x != "")).cast("long").alias("n_tokens"),
            F.xxhash64("text").alias("text_hash"),
            F.monotonically_increasing_id().alias("row"),  # fixed by the written table
        ),
        "shard-rows",
    )
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_blocks = max(1, -(-n // rows_per_block))
    unit_bytes = max(1, total // (n_shards * units_per_shard))
    unit_rows = max(1, n // (n_shards * units_per_shard))

    key = ["text_hash", "text_crc32", "size"]
    heavy = (
        rows.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_parts", F.greatest(F.ceil(F.col("_n") * F.col("size") / unit_bytes), F.ceil(F.col("_n") / unit_rows)))
        .filter((F.col("_n") > 1) & (F.col("_parts") > 1))
        .select(*key, F.least("_parts", "_n").alias("_parts"))
    )
    # Rows, not ids, are dealt out: a group of rows that repeat one id, or have none, is split as well. The heavy
    # groups are fewer than 2 * n_shards * units_per_shard, as each has more than a unit of the bytes or rows.
    part = F.pmod(F.xxhash64("row", F.lit("part")), F.coalesce("_parts", F.lit(1)))
    units = rows.join(F.broadcast(heavy), key, "left").withColumn("part", part).drop("_parts", "row")
    units = units.withColumn("block", F.pmod(F.xxhash64("text_hash", "part"), F.lit(n_blocks)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        pdf = pdf.sort_values(["text_hash", "text_crc32", "size", "part", "doc_id"], kind="stable").reset_index(drop=True)
        unit = pdf.groupby(["text_hash", "text_crc32", "size", "part"], sort=True).ngroup().to_numpy()
        sums = [np.bincount(unit, weights=w) for w in (pdf["size"], pdf["n_tokens"], np.ones(len(pdf)))]
        pdf["shard"] = place_units(np.stack(sums, axis=1), n_shards, block * 7)[unit]
        pdf["local"] = pdf.groupby("shard").cumcount()
        return pdf[["doc_id", "size", "text_crc32", "n_tokens", "block", "shard", "local"]].astype({"doc_id": "Int64"})

    placed = stored(units.groupBy("block").applyInPandas(pack, PLACED), "shard-placed")
    counts = placed.groupBy("block", "shard").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("block", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, ["block", "shard"]).select(
        "doc_id", "size", "text_crc32", "n_tokens", "shard", (F.col("_before") + F.col("local")).cast("long").alias("slot")
    )
