"""Filling a schema's fields from lines of text."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, FIELD_SYNONYMS, EngineConfig
from ..functions.text import normalize
from ..plans.stage import staged


def flatten_schema(schema: dict[str, Any], typed_leaves: bool = DEFAULTS.typed_leaves, prefix: str = "") -> list[tuple[str, str]]:
    """(path, kind) of every field; arrays also give the fields of their first element under `name[]`."""
    out = []
    for key, value in schema.items():
        path = f"{prefix}.{key}" if prefix else key
        if isinstance(value, list):
            out.append((path, "array"))
            if value and isinstance(value[0], dict):
                out += flatten_schema(value[0], typed_leaves, f"{path}[]")
        elif isinstance(value, dict):
            out += [(path, "object"), *flatten_schema(value, typed_leaves, path)]
        else:
            out.append((path, leaf_kind(value, typed_leaves)))
    return out


def leaf_kind(value: Any, typed_leaves: bool) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float):
        return "number"
    if isinstance(value, str):
        return value.lower() if typed_leaves and value.lower() in ("number", "boolean") else "string"
    return "unknown"


def empty_shape(schema: dict[str, Any]) -> dict[str, Any]:
    return {k: [] if isinstance(v, list) else empty_shape(v) if isinstance(v, dict) else None for k, v in schema.items()}


def schema_query(schema: dict[str, Any]) -> str:
    return " ".join(p for p, _ in flatten_schema(schema))


def field_terms(path: str) -> list[str]:
    name = re.sub("([a-z])([A-Z])", r"\1 \2", path.rsplit(".", 1)[-1].replace("[]", ""))
    base = [t.lower() for t in re.split("[^a-zA-Z0-9]+", name) if len(t) > 1]
    return list(dict.fromkeys(s for t in base for s in FIELD_SYNONYMS.get(t, t).split()))


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), normalize), lambda x: (F.length(x) > 0) & (F.length(x) < 600))


# Words that answer a yes-or-no field.
YES_NO = "yes|no|available|included|enabled|disabled|not|without"
NO = "no|not|without|unavailable|disabled"
WORD = "(?i)(?<![A-Za-z0-9_])(?:{})(?![A-Za-z0-9_])"


def line_score(line: Column, terms: list[str], kind: str) -> Column:
    low, score = F.lower(line), F.lit(0)
    for t in terms:
        score = score + F.when(F.instr(low, t) > 0, 3 if " " in t else 1).otherwise(0)
    if kind == "number":
        score = score + F.when(line.rlike("[0-9]"), 2).otherwise(0)
    if kind == "boolean":
        score = score + F.when(line.rlike(WORD.format(YES_NO)), 1).otherwise(0)
    if kind == "string":
        score = score + F.when(F.length(line) < 220, 1).otherwise(0)
    return score


def best_line(all_lines: Column, terms: list[str], kind: str) -> Column:
    """struct<score, line> of the best line above 0, the earliest of equals; null if there is none."""
    zero = F.struct(F.lit(0).alias("score"), F.lit(None).cast("string").alias("line"))
    best = F.aggregate(all_lines, zero, lambda b, x: F.when(line_score(x, terms, kind) > b["score"], F.struct(line_score(x, terms, kind).alias("score"), x.alias("line"))).otherwise(b))
    return F.when(best["score"] > 0, best)


def infer_value(kind: str, line: Column) -> Column:
    """The value as a JSON-like string; null if there is none."""
    if kind == "boolean":
        return F.when(line.isNull(), None).when(line.rlike(WORD.format(NO)), "false").otherwise("true")
    if kind == "number":
        number = F.regexp_extract(line, "-?[0-9]+(?:[,.][0-9]+)?", 0)
        return F.when(F.length(number) > 0, F.regexp_replace(number, ",", ""))
    return line


def extract(df: DataFrame, id_col: str, text: Column, schema: dict[str, Any], config: EngineConfig = DEFAULTS) -> DataFrame:
    """id and `fields`: array<struct<path, kind, value, evidence, confidence>> for the fields that can be filled.

    The fields are part of the plan, so a text's lines meet them in its own row and nothing is joined.
    """
    fields = [(p, k) for p, k in flatten_schema(schema, config.typed_leaves) if k not in ("object", "array")]
    split = staged(df.select(id_col, text.alias("_text")), _lines=lines(F.col("_text")))
    best = staged(split, **{f"_b{n}": best_line(F.col("_lines"), field_terms(path), kind) for n, (path, kind) in enumerate(fields)})
    each = [
        F.struct(
            F.lit(path).alias("path"),
            F.lit(kind).alias("kind"),
            infer_value(kind, F.col(f"_b{n}.line")).alias("value"),
            F.col(f"_b{n}.line").alias("evidence"),
            F.round(F.least(F.lit(0.85), 0.35 + F.col(f"_b{n}.score") * 0.08), 2).alias("confidence"),
        )
        for n, (path, kind) in enumerate(fields)
    ]
    return best.select(id_col, F.array(*each).alias("fields"))


def record(df: DataFrame, id_col: str, text: Column, schema: dict[str, Any], config: EngineConfig = DEFAULTS) -> DataFrame:
    """id, data (JSON), confidence, unfilled: one record for each row."""
    got = staged(extract(df, id_col, text, schema, config).withColumnRenamed("fields", "_f"), fields=F.col("_f"))
    filled = F.filter("fields", lambda f: f["value"].isNotNull())
    share = F.size(filled) / F.greatest(F.size("fields"), F.lit(1))
    mean = F.aggregate(filled, F.lit(0.0), lambda s, f: s + f["confidence"]) / F.greatest(F.size(filled), F.lit(1))
    values = F.map_from_entries(F.transform(F.filter(filled, lambda f: ~F.contains(f["path"], F.lit("[]"))), lambda f: F.struct(f["path"], f["value"])))
    return got.select(
        id_col,
        nested_json(schema, values, config).alias("data"),
        F.round(F.least(F.lit(0.9), share * mean), 2).alias("confidence"),
        F.transform(F.filter("fields", lambda f: f["value"].isNull()), lambda f: f["path"]).alias("unfilled"),
    )


def nested_json(schema: dict[str, Any], values: Column, config: EngineConfig, prefix: str = "") -> Column:
    """The schema's shape with its values, as JSON: arrays stay empty, missing leaves are null."""
    parts = [F.lit("{")]
    for n, (key, v) in enumerate(schema.items()):
        path = f"{prefix}.{key}" if prefix else key
        parts.append(F.lit(("," if n else "") + json.dumps(key) + ":"))
        if isinstance(v, list):
            parts.append(F.lit("[]"))
        elif isinstance(v, dict):
            parts.append(nested_json(v, values, config, path))
        else:
            own = F.try_element_at(values, F.lit(path))
            quoted = own if leaf_kind(v, config.typed_leaves) in ("boolean", "number") else F.regexp_extract(F.to_json(F.struct(own.alias("v"))), "^[{]\"v\":(.*)[}]$", 1)
            parts.append(F.coalesce(F.when(own.isNotNull(), quoted), F.lit("null")))
    return F.concat(*parts, F.lit("}"))


