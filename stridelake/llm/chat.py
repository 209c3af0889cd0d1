"""Chat formatting after a cumulative-snapshot collapse (DataFrame functions only).

Logs often hold the same conversation several times, once per turn, each snapshot longer than
the last. A rolling hash of every turn prefix (sum of two 64-bit hashes of position, role and
text over the prefix) is compared with the hash of every whole conversation: one that equals a
proper prefix of another, or repeats another one whole, is removed by an anti join; what remains is
rendered turn by turn.

Positions and running sums are built per chunk of turns plus a chunk offset, so a conversation with
very many turns is never gathered in one task; its rendering is cut into parts of a bounded
number of turns for the same reason (nearly all conversations have just part 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Fixed text of the rendered form: role marks of the public ChatML layout.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CHUNK = 1024


def _before(df: DataFrame, keys: list[str], chunk: str, sums: dict[str, Column]) -> DataFrame:
    """Totals of the earlier chunks of each group, one row per (group, chunk)."""
    totals = df.groupBy(*keys, chunk).agg(*[c.alias(n) for n, c in sums.items()])
    w = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, chunk, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_b_{n}") for n in sums])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their position k (from 1) in the conversation and prefix hashes.

    Order within a conversation: turn (null first), role, text. A turn logged twice with equal role
    and text counts once. Rows without conv_id form one conversation of their own.
    """
    c = conversations
    t = c.select(
        c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"),
        c["role"].cast("string").alias("role"), c["text"].cast("string").alias("text"),
    ).distinct()
    t = t.select(
        F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("c_null"),
        "turn", "role", "text", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 53))).alias("_t"),
    )
    key = ["c", "c_null"]
    order = [F.col(x).asc_nulls_first() for x in ("turn", "role", "text")]
    local = t.withColumn("_k", F.row_number().over(Window.partitionBy(*key, "_t").orderBy(*order)))
    first = _before(t, key, "_t", {"n": F.count(F.lit(1))})
    t = local.join(first, [*key, "_t"]).withColumn("k", (F.col("_b_n") + F.col("_k")).cast("long")).drop("_t", "_k", "_b_n")

    wide = lambda seed: F.xxhash64(F.lit(seed), "k", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    t = t.withColumn("_c", F.floor((F.col("k") - 1) / CHUNK))
    t = t.withColumns({f"h{i}": wide(seed).cast("decimal(20,0)") for i, seed in enumerate((17, 4099))})
    t = stored(t, "turns")
    run = Window.partitionBy(*key, "_c").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    summed = t.withColumns({f"_p{i}": F.sum(f"h{i}").over(run) for i in (0, 1)})
    parts = _before(t, key, "_c", {"h0": F.sum("h0"), "h1": F.sum("h1")})
    whole = "decimal(38,0)"
    return summed.join(parts, [*key, "_c"]).select(
        *key, "turn", "k", "role", "text",
        *[(F.col(f"_p{i}").cast(whole) + F.col(f"_b_h{i}").cast(whole)).cast(whole).alias(f"p{i}") for i in (0, 1)],
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """c, c_null, n_turns, n_logged: conversations that no longer one starts with.

    Of equal conversations the smallest id stays (a missing id comes last); n_logged counts them.
    """
    sizes = turns.groupBy("c", "c_null").agg(F.max("k").alias("n_turns"))
    ends = turns.join(sizes, ["c", "c_null"])
    proper = ends.filter(F.col("k") < F.col("n_turns")).select("k", "p0", "p1").distinct()
    full = (
        ends.filter(F.col("k") == F.col("n_turns"))
        .groupBy("k", "p0", "p1")
        .agg(F.min(F.struct("c_null", "c")).alias("id"), F.count(F.lit(1)).alias("n_logged"))
    )
    kept = full.join(proper, ["k", "p0", "p1"], "left_anti")
    return kept.select(F.col("id.c").alias("c"), F.col("id.c_null").alias("c_null"), F.col("k").alias("n_turns"), "n_logged")


def format_chats(conversations: DataFrame, turns_per_part: int = 512) -> DataFrame:
    """conv_id, part, n_turns, n_logged, rendered: maximal conversations in rendered form.

    Null role or text renders as empty text. n_turns counts the whole conversation. An empty
    table gives an empty table; columns besides conv_id, turn, role and text are not read.
    """
    turns = stored(numbered_turns(conversations), "turn-prefixes")
    kept = maximal_conversations(turns)
    piece = F.concat(
        F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n")
    )
    part = F.floor((F.col("k") - 1) / turns_per_part).cast("int")
    rendered = (
        turns.join(kept, ["c", "c_null"])
        .groupBy("c", "c_null", part.alias("part"))
        .agg(
            F.first("n_turns").alias("n_turns"),
            F.first("n_logged").alias("n_logged"),
            F.sort_array(F.collect_list(F.struct("k", piece.alias("s")))).alias("_s"),
        )
    )
    return rendered.select(
        F.when(~F.col("c_null"), F.col("c")).alias("conv_id"), "part", F.col("n_turns").cast("long").alias("n_turns"),
        F.col("n_logged").cast("long").alias("n_logged"),
        F.concat_ws("", F.transform("_s", lambda x: x["s"])).alias("rendered"),
    )
