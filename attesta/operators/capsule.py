"""The single-page pipeline: clean, scan, chunk, rank, select, assemble, trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions.text import token_estimate, token_savings
from ..functions.url import source_class
from ..plans.stage import staged
from .chunk import chunk_array, match_headings
from .dom import clean
from .provenance import prepared_blocks, prepared_chunks, source_blocks
from .rank import confidence, context_text, priority, rank, select
from .safety import scan


def metadata_text(metadata: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def structured_text(json_ld: Column, microdata: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("["), F.array_join(json_ld, ","), F.lit("]")), F.to_json(microdata))


def context_base(text: Column, metadata: Column, json_ld: Column, microdata: Column) -> Column:
    """The cleaned text, or where it is blank what the page says of itself."""
    data = structured_text(json_ld, microdata)
    other = F.concat_ws("\n\n", F.nullif(metadata_text(metadata), F.lit("")), data)
    return F.coalesce(F.when(F.length(F.trim(text)) > 0, text), other)


def capsules(pages: DataFrame, tasks: list[str], max_tokens: int = DEFAULTS.max_tokens, config: EngineConfig = DEFAULTS) -> DataFrame:
    """page_id, task_id, url, title, source_quality, context, selected chunks with source blocks, capsule, confidence, safety, savings."""
    base = clean(pages)
    safe = scan(base, F.col("text"), F.map_values("metadata"), F.col("hidden"), F.col("comments"))
    own = staged(safe, _heads=match_headings(F.col("headings")), _meta_text=metadata_text(F.col("metadata")), _data_text=structured_text(F.col("json_ld"), F.col("microdata")), _text=context_base(F.col("text"), F.col("metadata"), F.col("json_ld"), F.col("microdata")))
    chunked = staged(own, _all=chunk_array(F.col("_text"), F.col("_heads"), config), _blocks=prepared_blocks(F.col("blocks")))
    ranked = rank(chunked, F.col("_all"), tasks, F.col("_meta_text"), F.col("_data_text"), config)
    chosen = staged(select(ranked, max_tokens, config.min_score), context=context_text(F.col("selected")), _prepared=prepared_chunks(F.col("selected")))
    traced = F.transform("_prepared", lambda c: c.dropFields("match", "terms").withField("source_blocks", source_blocks(c["match"], c["terms"], F.col("_blocks"))))
    return chosen.select(
        "page_id",
        "task_id",
        "task",
        "url",
        "title",
        "fingerprint",
        source_class(F.col("url"), F.col("title")).alias("source_quality"),
        "context",
        traced.alias("evidence"),
        priority(F.col("selected")).alias("capsule"),
        confidence(F.col("selected"), F.col("task"), max_tokens, config).alias("confidence"),
        "safety",
        token_savings(F.ceil(F.col("html_chars") / 4).cast("int"), token_estimate(F.col("context"))).alias("savings"),
    )
