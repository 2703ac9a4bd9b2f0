"""Scanning pages for text that instructs, asks for credentials or sends data away; the patterns are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import INJECTION_PATTERNS, SEVERITY
from ..functions.text import normalize
from ..plans.stage import staged


def texts(visible: Column, metadata_values: Column, hidden: Column, comments: Column) -> Column:
    """array<struct<location, text>> of all places to look at, empty texts left out."""
    some = lambda values, where: F.transform(values, lambda v: F.struct(F.lit(where).alias("location"), v.alias("text")))
    both = F.concat(some(F.array(visible), "visible_text"), some(metadata_values, "metadata"), some(hidden, "hidden_text"), some(comments, "html_comment"))
    return F.filter(both, lambda x: F.length(F.coalesce(x["text"], F.lit(""))) > 0)


def warnings(places: Column) -> Column:
    """array<struct<type, severity, location, snippet>>: one for each place and pattern that matches, in that order."""

    def of(place: Column, family: str, pattern: str) -> Column:
        covert = place["location"].isin("hidden_text", "html_comment")
        kind = F.when(covert, "hidden_instruction_like_text").otherwise("instruction_like_text") if family == "instruction" else F.lit(f"{family}_request")
        severity = F.when(place["location"] == "visible_text", "medium").otherwise("high") if family == "instruction" else F.lit("high")
        regex = f"(?i){pattern}"
        at = F.regexp_instr(place["text"], F.lit(regex)) - 1
        start = F.greatest(F.lit(0), at - 80)
        snippet = normalize(F.substring(place["text"], start + 1, at + 180 - start))
        return F.when(place["text"].rlike(regex), F.struct(kind.alias("type"), severity.alias("severity"), place["location"].alias("location"), snippet.alias("snippet")))

    each = F.transform(places, lambda p: F.array_compact(F.array(*[of(p, family, pattern) for family, patterns in INJECTION_PATTERNS.items() for pattern in patterns])))
    return F.flatten(each)


def verdict(found: Column, most: int = 20) -> Column:
    """risk, score, warning_count and the first warnings; the score counts all of them."""
    weight = lambda w: F.when(w["severity"] == "high", SEVERITY["high"]).when(w["severity"] == "medium", SEVERITY["medium"]).otherwise(SEVERITY["low"])
    score = F.least(F.lit(1.0), F.aggregate(found, F.lit(0.0), lambda s, w: s + weight(w)))
    risk = F.when(score >= 0.65, "high").when(score >= 0.25, "medium").otherwise("low")
    return F.struct(risk.alias("risk"), F.round(score, 2).alias("score"), F.size(found).alias("warning_count"), F.slice(found, 1, most).alias("warnings"))


def scan(df: DataFrame, visible: Column, metadata_values: Column, hidden: Column, comments: Column) -> DataFrame:
    """df with `safety`."""
    found = staged(df, _warnings=warnings(texts(visible, metadata_values, hidden, comments)))
    return staged(found, safety=verdict(F.col("_warnings"))).drop("_warnings")
