"""Quality rules with thresholds that adapt to language and source (DataFrame functions only).

1. ``text_statistics``: counts per text with SQL functions.
2. ``fences``: one mergeable KLL quantile sketch per (lang, source) and statistic; sketches of
   sources are merged into one per language and one overall. A (lang, source) with fewer than
   ``min_rows`` usable documents takes its language's sketch, a small language the overall one.
   The fence is Q3 + ``reach`` * (Q3 - Q1) (below: Q1 - ...), with a small minimum in place of
   Q3 - Q1 where most documents have the same value; the group alone decides, looser or tighter.
3. The fences are joined to the statistics and decide ``kept``.

The sketches hold every usable value exactly while a group has fewer than ``k`` rows; beyond that
quartiles have a rank error below 0.2 % and come out of random compaction, so a document
exactly at a fence can change sides between runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed values of the contract: separators of words, counted symbols, window of words.
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: statistic -> (lower fence, upper fence, least value that Q3 - Q1 counts as).
LIMITS: dict[str, tuple[bool, bool, float]] = {
    "word_length": (True, True, 0.5),
    "symbol_share": (False, True, 0.01),
    "dup_line_share": (False, True, 0.05),
    "repeat_share": (False, True, 0.03),
    "upper_share": (False, True, 0.02),
}


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from the word array ``_w``: words that lie in a 5-word window found twice.

    Windows are hashed, sorted by (hash, position) within the row, and equal neighbours mark the
    positions; each marked position then covers 5 words or as many as lie before the next one.
    """
    at = lambda i, k: F.get(F.col("_h"), i + F.lit(k))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_h") - WINDOW),
        lambda i: F.struct(F.xxhash64(*[at(i, k) for k in range(WINDOW)]).alias("h"), i.alias("p")),
    )
    none = F.expr("array_repeat(struct(0L as h, 0 as p), 0)")
    df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    df = df.withColumn("_s", F.when(F.size("_h") >= WINDOW, F.sort_array(windows)).otherwise(none))
    same = lambda x, j: F.coalesce(x["h"] == F.get(F.col("_s"), j)["h"], F.lit(False))
    df = df.withColumn(
        "_p",
        F.array_sort(
            F.transform(F.filter("_s", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])
        ),
    )
    reach = F.transform(
        "_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(WINDOW)))
    )
    return df.withColumn("n_repeat_words", F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x))


def text_statistics(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source"):
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, shares.

    A null or empty text has no words, lines or symbols. Ids, lang and source may be null;
    repeated rows stay repeated.
    """
    df = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[lang_col].cast("string").alias("lang"),
        docs[source_col].cast("string").alias("source"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_t"),
    )
    bare = F.translate("_t", " \t\n\x0b\x0c\r", "")
    df = df.withColumn("_w", F.filter(F.split("_t", GAP), lambda x: x != ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_l", lines)
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("word_chars", F.char_length(bare).cast("long"))
    df = df.withColumn("n_symbols", (F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, ""))).cast("long"))
    df = df.withColumn("n_lines", F.size("_l").cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    df = df.withColumn("n_upper", F.char_length(F.regexp_replace("_t", r"[^\p{Lu}]", "")).cast("long"))
    df = _repeat_words(df)
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return df.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        share("word_chars", "n_words").alias("word_length"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"),
    )


def _quartile_fences(sketches: DataFrame, keys: list[str], prefix: str, reach: float) -> DataFrame:
    out = [*keys, F.col("n").alias(f"{prefix}_n")]
    for name, (low, high, spread) in LIMITS.items():
        q = lambda p: F.kll_sketch_get_quantile_double(F.col(f"s_{name}"), F.lit(p))  # noqa: B023,E731
        wide = reach * F.greatest(q(0.75) - q(0.25), F.lit(spread))
        if low:
            out.append((q(0.25) - wide).alias(f"{prefix}_{name}_low"))
        if high:
            out.append((q(0.75) + wide).alias(f"{prefix}_{name}_high"))
    return sketches.select(*out)


def fences(stats: DataFrame, reach: float = 3.0, min_rows: int = 200, k: int = 2048) -> DataFrame:
    """lang, source and the fences of each statistic, one row per (lang, source), nulls included."""
    usable = stats.filter(~F.col("base_failed"))
    by_source = usable.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(n, F.lit(k)).alias(f"s_{n}") for n in LIMITS]
    )
    by_source = stored(by_source, "quantile-sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(f"s_{n}", F.lit(k)).alias(f"s_{n}") for n in LIMITS]]
    by_lang = by_source.groupBy("lang").agg(*merged)
    overall = by_lang.agg(*merged).filter(F.col("n") > 0)

    groups = stats.select("lang", "source").distinct()
    own = _quartile_fences(by_source, ["lang", "source"], "a", reach)
    lang = _quartile_fences(by_lang, ["lang"], "b", reach).withColumnRenamed("lang", "_lang")
    whole = _quartile_fences(overall, [], "c", reach).withColumn("_one", F.lit(1))
    own = own.withColumnsRenamed({"lang": "_l", "source": "_s"})
    j = (
        groups.join(own, groups["lang"].eqNullSafe(own["_l"]) & groups["source"].eqNullSafe(own["_s"]), "left")
        .join(lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .withColumn("_k", F.lit(1))
        .join(whole, F.col("_k") == F.col("_one"), "left")
    )
    cols = []
    for name, (low, high, _) in LIMITS.items():
        for side in (s for s, v in zip(("low", "high"), (low, high)) if v):
            cols.append(
                F.coalesce(
                    F.when(F.col("a_n") >= min_rows, F.col(f"a_{name}_{side}")),
                    F.when(F.col("b_n") >= min_rows, F.col(f"b_{name}_{side}")),
                    F.col(f"c_{name}_{side}"),
                ).alias(f"{name}_{side}")
            )
    return j.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *cols)


def inside() -> Column:
    ok = F.lit(True)
    for name, (low, high, _) in LIMITS.items():
        if low:
            ok = ok & F.coalesce(F.col(name) >= F.col(f"{name}_low"), F.lit(True))
        if high:
            ok = ok & F.coalesce(F.col(name) <= F.col(f"{name}_high"), F.lit(True))
    return ok


def quality_rules(docs: DataFrame, reach: float = 3.0, min_rows: int = 200, k: int = 2048, **cols) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every row of ``docs``.

    Null/empty texts fail the base rule. Null lang or source form groups of their own. Repeated
    rows each get a row; an empty table gives an empty table; columns other than the id, text,
    language and source are not read, whatever their names.
    """
    stats = stored(text_statistics(docs, **cols), "text-statistics")
    f = fences(stats, reach, min_rows, k)
    j = stats.join(f, stats["lang"].eqNullSafe(f["f_lang"]) & stats["source"].eqNullSafe(f["f_source"]), "left")
    return j.select(*[stats[c] for c in stats.columns], (~F.col("base_failed") & inside()).alias("kept"))
