"""Column helpers: the scalar semantics of the training-log models.

Everything here returns a ``pyspark.sql.Column`` built from built-in
expressions, so it stays inside whole-stage codegen; no Python UDFs.

Several helpers exist only to pin down number/text formatting so the
summaries are byte-identical to what the SQL layer of the original
pipeline produced (half-away-from-zero rounding on the double value,
NULL-skipping ``concat``, banker's rounding on double -> int casts).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# ---------------------------------------------------------------------------
# Fixed values (must equal the original pipeline's, stated as plain text)
# ---------------------------------------------------------------------------
# Characters Python's ``str.split()`` treats as whitespace (Python 3.13).
# Java's (?U)\s lacks \x1c-\x1f, so the class is spelled out.
PY_WHITESPACE_CLASS = (
    "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a"
    "\\u2028\\u2029\\u202f\\u205f\\u3000]"
)
NEWLINE = "\n"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_away(x: ColumnOrName, scale: int = 0) -> Column:
    """``round(x, scale)`` as DuckDB computes it on a double.

    DuckDB scales the double first and rounds the product half away from
    zero; Spark's ``round`` rounds the decimal rendering of the unscaled
    value, which differs on values like 20.185. Scaling first matches.
    """
    x = _c(x).cast("double")
    if scale == 0:
        return F.round(x, 0)
    factor = float(10**scale)
    return F.round(x * F.lit(factor), 0) / F.lit(factor)


def round2(x: ColumnOrName) -> Column:
    return round_half_away(x, 2)


def cast_int_half_even(x: ColumnOrName) -> Column:
    """double -> int the way DuckDB casts (round half to even), not truncation."""
    return F.rint(_c(x).cast("double")).cast("int")


def _minutes_seconds(total_seconds: Column) -> Column:
    """``printf('%d:%02d', floor(r / 60), r % 60)`` for r = round(s) >= 0.

    Built from concat/lpad rather than ``format_string``: same text, but it
    stays in generated code (``String.format`` per row is several times
    slower on large tables).
    """
    r = F.round(total_seconds, 0)
    minutes = F.floor(r / F.lit(60.0)).cast("int").cast("string")
    seconds = F.pmod(r, F.lit(60.0)).cast("int").cast("string")
    return F.concat(minutes, F.lit(":"), F.lpad(seconds, 2, "0"))


def format_duration(seconds: ColumnOrName) -> Column:
    """Seconds -> ``m:ss`` (minutes unbounded); NULL or negative -> NULL."""
    s = _c(seconds).cast("double")
    return F.when(s.isNull() | (s < 0), F.lit(None).cast("string")).otherwise(
        _minutes_seconds(s)
    )


def format_pace_from_speed(speed_mps: ColumnOrName) -> Column:
    """Speed in m/s -> pace per km as ``m:ss``; NULL or <= 0 -> NULL."""
    v = _c(speed_mps).cast("double")
    return F.when(v.isNull() | (v <= 0), F.lit(None).cast("string")).otherwise(
        _minutes_seconds(F.lit(1000.0) / v)
    )


def format_pace_min_per_km(pace: ColumnOrName) -> Column:
    """Decimal minutes -> ``m:s`` with no zero padding (may print ``:60``)."""
    p = _c(pace).cast("double")
    whole = F.floor(p)
    # double -> bigint casts round (half to even) in the SQL dialect the
    # macro was written for, hence rint rather than a truncating cast.
    frac_seconds = F.rint((p - whole) * F.lit(60.0)).cast("bigint")
    return F.when(p.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(whole.cast("bigint").cast("string"), F.lit(":"), frac_seconds.cast("string"))
    )


def concat_skip_nulls(*cols: ColumnOrName) -> Column:
    """SQL ``concat`` as DuckDB defines it: NULL arguments are skipped."""
    return F.concat_ws("", *[_c(c) for c in cols])


def interval_summary(
    name: str,
    distance_km: ColumnOrName,
    pace: ColumnOrName,
    average_hr: ColumnOrName,
    include_hr: ColumnOrName,
) -> Column:
    """``'Name: {km} km with pace {p} min/km[ and avg HR {hr}]'``.

    Built with NULL-propagating ``concat`` (the ``||`` operator), so any
    NULL piece nulls the whole line.
    """
    hr_part = F.when(
        _c(include_hr), F.concat(F.lit(" and avg HR "), _c(average_hr).cast("string"))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit(f"{name}: "),
        _c(distance_km).cast("string"),
        F.lit(" km with pace "),
        _c(pace).cast("string"),
        F.lit(" min/km"),
        hr_part,
    )


def event_date(local: ColumnOrName, gmt: ColumnOrName, fallback: ColumnOrName) -> Column:
    """Partition date of a raw activity.

    First non-empty of local/GMT start time; its first 10 characters when it
    has at least 10, otherwise the fallback (a short local value does not
    fall through to GMT).
    """
    v = F.coalesce(F.nullif(_c(local), F.lit("")), F.nullif(_c(gmt), F.lit("")))
    return F.when(F.length(v) >= 10, F.substring(v, 1, 10)).otherwise(_c(fallback))


def collapse_whitespace(text: ColumnOrName) -> Column:
    """``' '.join(text.split())``: trim and collapse Unicode whitespace runs."""
    runs = F.regexp_replace(_c(text), PY_WHITESPACE_CLASS + "+", " ")
    return F.regexp_replace(runs, "^ | $", "")


def session_title(first_message: ColumnOrName, max_length: int = 60) -> Column:
    """Short label from a session's first user message."""
    cleaned = collapse_whitespace(first_message)
    cut = F.concat(F.rtrim(F.substring(cleaned, 1, max_length - 3)), F.lit("..."))
    return (
        F.when(cleaned.isNull(), F.lit(None).cast("string"))
        .when(cleaned == "", F.lit("New chat"))
        .when(F.length(cleaned) <= max_length, cleaned)
        .otherwise(cut)
    )


def listagg_ordered(value: str, separator: str, order_by: str) -> Column:
    """``listagg(value, sep) WITHIN GROUP (ORDER BY order_by)``.

    NULL values are skipped; an all-NULL group yields NULL. Runs as a
    partial (map-side) aggregate.
    """
    sep = separator.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return F.expr(f"listagg(`{value}`, '{sep}') WITHIN GROUP (ORDER BY `{order_by}`)")


__all__ = [
    "NEWLINE",
    "PY_WHITESPACE_CLASS",
    "cast_int_half_even",
    "collapse_whitespace",
    "concat_skip_nulls",
    "event_date",
    "format_duration",
    "format_pace_from_speed",
    "format_pace_min_per_km",
    "interval_summary",
    "listagg_ordered",
    "round2",
    "round_half_away",
    "session_title",
]
