"""Config-driven extraction of semi-structured payloads.

Input: one row per raw document ``(dt, source_file, value)`` -- the whole
file text. Output of ``extract_documents``: the same rows plus

* ``parsed`` (false for malformed JSON),
* ``records``: ``array<struct<target columns>>``, typed and leniently cast,
* ``valid``: no record has NULL in a required column.

Everything happens inside the document's row with built-in variant and
higher-order functions: no shuffle, no Python. Because the document row *is*
the file, the file-granular quarantine rule ("one bad row sends the whole
file to quarantine") is a per-row ``exists`` over the records array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DTYPES


def _json_path(dotted: str) -> str:
    """``a.b`` -> ``$['a']['b']`` (safe for any key text)."""
    parts = dotted.split(".")
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in parts)


def _doc_kind(value: Column) -> Column:
    """First non-blank character of the raw text: '{' object, '[' array."""
    return F.regexp_extract(value, r"^\s*(.)", 1)


def _variant_value(v: Column, source: str, dtype: str) -> Column:
    if dtype == "json":
        inner = F.try_variant_get(v, _json_path(source), "variant")
        return F.when(inner.isNotNull() & ~F.is_variant_null(inner), F.to_json(inner))
    return F.try_variant_get(v, _json_path(source), DTYPES[dtype])


def _map_record(r: Column, mapping: list[dict], context: dict[str, Column]) -> Column:
    fields = []
    for col in mapping:
        target = col["target"]
        if target in context:
            value = context[target]  # typed once per document
        else:
            value = _variant_value(r, col["source"], col["dtype"])
        fields.append(value.alias(target))
    mapped = {c["target"] for c in mapping}
    for target, value in context.items():
        if target not in mapped:  # undeclared context key: kept, as text
            fields.append(value.alias(target))
    return F.struct(*fields)


def _records_generic(doc: Column, kind: str, extract: dict, raw: Column) -> Column:
    """array<variant> of records for list / record / object payloads."""
    empty = F.array().cast("array<variant>")
    shape = _doc_kind(raw)
    if kind == "list":
        return F.when(shape == "[", F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), empty)).otherwise(empty)
    if kind == "record":
        return F.when(shape == "{", F.array(doc)).otherwise(empty)
    if kind == "object":
        path = _json_path(extract["records_path"])
        return F.when(shape == "{", F.coalesce(F.try_variant_get(doc, path, "array<variant>"), empty)).otherwise(empty)
    raise ValueError(kind)


def _records_descriptor(doc: Column, extract: dict, mapping: list[dict], context: dict[str, Column], raw: Column) -> tuple[dict[str, Column], Column]:
    """Measurements x metric values, each labelled by its descriptor.

    Descriptors: objects with an integer index; a later duplicate index
    wins. They are read once per document and reduced to an index -> (key, unit) map that
    holds the typed columns they give; each value then costs one map lookup and its own
    cast. A value whose position has no descriptor keeps NULL key/unit. Positions are kept even when an earlier
    measurement is skipped (not an object, or no list of values).
    """
    empty_v = F.array().cast("array<variant>")
    descs_raw = F.try_variant_get(doc, _json_path(extract["schema_path"]), "array<variant>")
    meas = F.try_variant_get(doc, _json_path(extract["records_path"]), "array<variant>")
    has_descs = F.try_variant_get(doc, _json_path(extract["schema_path"]), "variant")
    has_meas = F.try_variant_get(doc, _json_path(extract["records_path"]), "variant")
    # Missing keys mean empty lists; present but not a list means no rows.
    descs_ok = has_descs.isNull() | descs_raw.isNotNull()
    meas_ok = has_meas.isNull() | meas.isNotNull()

    idx_field = _json_path(extract["schema_index_field"])
    key_path = _json_path(extract["schema_key_field"])
    unit = extract.get("schema_unit_path")
    none_v = F.lit(None).cast("variant")
    # Non-objects have no fields, so a NULL index also drops them.
    descs = F.filter(
        F.transform(
            F.coalesce(descs_raw, empty_v),
            lambda d: F.struct(
                F.try_variant_get(d, idx_field, "bigint").alias("idx"),
                F.try_variant_get(d, key_path, "variant").alias("key"),
                (F.try_variant_get(d, _json_path(unit) + "['key']", "variant") if unit else none_v).alias("unit_key"),
                (F.try_variant_get(d, _json_path(unit) + "['factor']", "variant") if unit else none_v).alias("unit_factor"),
            ),
        ),
        lambda x: x["idx"].isNotNull(),
    )
    values_path = _json_path(extract["values_path"])
    mapped = {c["target"] for c in mapping}
    # Per-document values become columns first; lambdas below only reference
    # them (an expression captured by a lambda is re-evaluated per element).
    described = F.col("_descs")
    last_wins = F.filter(
        F.transform(described, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda y: ~F.exists(F.slice(described, y["i"] + 2, F.size(described) + 1), lambda z: z["idx"] == y["x"]["idx"]),
    )
    of_descriptor = {"metric_key": "key", "unit_key": "unit_key", "unit_factor": "unit_factor"}
    labels = {c["target"]: c for c in mapping if c["source"] in of_descriptor and c["target"] not in context}

    def typed(x: Column, col: dict) -> Column:
        return F.to_json(x) if col["dtype"] == "json" else F.try_variant_get(x, "$", DTYPES[col["dtype"]])

    by_index = F.map_from_entries(
        F.transform(
            last_wins,
            lambda y: F.struct(
                y["x"]["idx"].alias("k"),
                F.struct(
                    y["x"]["idx"].alias("idx"),
                    *[typed(y["x"][of_descriptor[c["source"]]], c).alias(f"label {t}") for t, c in labels.items()],
                ).alias("v"),
            ),
        )
    )
    shape = _doc_kind(raw)
    pre = {
        "_descs": descs,
        "_dmap": by_index,
        "_meas": F.when((shape == "{") & descs_ok & meas_ok, F.coalesce(meas, empty_v)),
    }
    by_index = F.col("_dmap")

    def record(x: Column, mi: Column) -> Column:
        # Positions are integers, what the descriptor says is typed already; only the value is a JSON value
        # still to be cast leniently to the configured type.
        positions = {"measurement_index": mi, "metric_index": x["ki"]}
        fields = []
        for col in mapping:
            t, dtype = col["target"], col["dtype"]
            if t in context:
                fields.append(context[t].alias(t))  # typed once per document
                continue
            if t in labels:
                value = x["dsc"][f"label {t}"]
            elif col["source"] in positions:
                value = positions[col["source"]].cast("bigint").cast(DTYPES[dtype])
            elif col["source"] == "metric_value":
                value = typed(x["val"], col)
            else:
                value = F.lit(None).cast(DTYPES[dtype])
            fields.append(value.alias(t))
        for t, v in context.items():
            if t not in mapped:
                fields.append(v.alias(t))
        return F.struct(*fields)

    def per_measurement(m: Column, mi: Column) -> Column:
        vals = F.try_variant_get(m, values_path, "array<variant>")
        labelled = F.transform(
            vals,
            lambda val, ki: F.struct(val.alias("val"), ki.alias("ki"), F.try_element_at(by_index, ki.cast("bigint")).alias("dsc")),
        )
        return F.transform(labelled, lambda x: record(x, mi))

    rows = F.flatten(F.filter(F.transform(F.col("_meas"), per_measurement), lambda a: a.isNotNull()))
    return pre, rows


def extract_documents(docs: DataFrame, asset: dict) -> DataFrame:
    """Adds ``parsed``, ``records`` and ``valid`` to a frame of raw documents."""
    extract = asset["extract"]
    mapping = asset["column_mapping"]
    kind = extract["payload_kind"]
    v = F.try_parse_json(F.col("value"))
    parsed = docs.withColumn("_doc", v).withColumn("parsed", F.col("_doc").isNotNull())
    doc = F.col("_doc")

    context: dict[str, Column] = {}
    ck = extract.get("context_key") or {}
    if ck.get("target"):
        src = ck.get("source")
        ctx_val = (
            F.when(_doc_kind(F.col("value")) == "{", F.try_variant_get(doc, _json_path(src), "variant"))
            if src
            else F.lit(None).cast("variant")
        )
        parsed = parsed.withColumn("_ctx0", ctx_val)
        target_cfg = next((c for c in mapping if c["target"] == ck["target"]), None)
        if target_cfg is None:  # undeclared context key: kept as text
            typed = F.try_variant_get(F.col("_ctx0"), "$", "string")
        elif target_cfg["dtype"] == "json":
            typed = F.to_json(F.col("_ctx0"))
        else:
            typed = F.try_variant_get(F.col("_ctx0"), "$", DTYPES[target_cfg["dtype"]])
        parsed = parsed.withColumn("_ctx0_t", typed)
        context[ck["target"]] = F.col("_ctx0_t")

    pre: dict[str, Column] = {}
    if kind == "descriptor_metrics":
        pre, records = _records_descriptor(doc, extract, mapping, context, F.col("value"))
    else:
        recs = _records_generic(doc, kind, extract, F.col("value"))
        records = F.transform(recs, lambda r: _map_record(r, mapping, context))
    for name, expr in pre.items():
        parsed = parsed.withColumn(name, expr)
    helper_cols = [c for c in parsed.columns if c.startswith("_")]

    target_types = ", ".join(
        f"`{c['target']}`: {DTYPES[c['dtype']]}" for c in mapping
    ) + "".join(f", `{t}`: string" for t in context if t not in {c["target"] for c in mapping})
    empty = F.array().cast(f"array<struct<{target_types}>>")
    # The helper columns are referenced inside lambdas. One more reference
    # outside the lambdas makes the optimizer keep them as computed columns
    # (evaluated once per document) instead of inlining them into the lambda
    # body, where they would be re-evaluated for every element.
    keep = F.lit(True)
    for c in helper_cols:
        if c != "_doc":
            keep = keep & (F.isnull(F.col(c)) | F.isnotnull(F.col(c)))
    out = parsed.withColumn("records", F.when(keep, F.coalesce(records, empty)))
    required = [c["target"] for c in mapping if c.get("required")]

    def has_violation(r: Column) -> Column:
        cond = F.lit(False)
        for t in required:
            cond = cond | r[t].isNull()
        return cond

    out = out.withColumn("valid", ~F.exists("records", has_violation))
    return out.drop(*helper_cols)
