"""Research: the best pages of each query, read for it, and what they say together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions.text import preview, strings
from ..plans.stage import cut, staged
from ..sources.search import corpus_search
from .chunk import chunk_array, match_headings
from .crosssource import agreement, agreement_reason, agreement_score, budgeted, cluster, contradictions, one_per_cluster
from .rank import rank, select


def sources(pages: DataFrame, queries: list[str], depth: int) -> DataFrame:
    """query_id, rank, page_id, url, text, headings, ok, error: the best `depth` pages of each query; one without text is a row with an error."""
    hits = corpus_search(pages, "page_id", F.col("text"), queries, depth).select("query_id", "page_id", "rank")
    found = pages.join(hits, "page_id")
    blank = F.length(F.trim("text")) == 0
    return found.withColumn("ok", ~blank).withColumn("error", F.when(blank, "the page has no text"))


def evidence(pages: DataFrame, queries: list[str], depth: int, total_tokens: int, config: EngineConfig = DEFAULTS) -> DataFrame:
    """The pooled, clustered and ranked chunks of each query's pages, before the common budget.

    pages: page_id, url, text, headings.  Every source gets an equal part of the budget, 400 tokens at least.
    """
    read = sources(pages, queries, depth).where("ok").withColumn("task", F.element_at(strings(queries), F.col("query_id")))
    chunked = staged(staged(read, heads=match_headings(F.col("headings"))), chunks=chunk_array(F.col("text"), F.col("heads"), config))
    chosen = select(rank(chunked, F.col("chunks"), config=config), max(400, total_tokens // depth), config.min_score)
    each = chosen.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("long").alias("source_index"), "page_id", F.explode("selected").alias("c"))
    pool = cut(each.select("query_id", "source_index", "page_id", F.col("c.chunk_id").cast("long").alias("chunk_id"), "c.text", "c.normalized_score", "c.token_estimate"))
    unique = pool.groupBy("query_id").agg(F.countDistinct("source_index").alias("unique_sources"))
    joined = agreement(pool.join(cluster(pool, by_vector=False, config=config), ["query_id", "source_index", "chunk_id"]))
    ranked = one_per_cluster(joined, max(6, total_tokens // 250))
    order = F.sort_array(F.collect_list(F.struct("rank", "token_estimate")))
    within = ranked.groupBy("query_id").agg(order.alias("e")).select("query_id", F.explode(budgeted(F.col("e"), total_tokens)).alias("rank"))
    return cut(ranked.join(within, ["query_id", "rank"]).join(unique, "query_id"))


def answers(found: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """The evidence with its query's agreement score, reason and number of contradictions.  A query without evidence has no row."""
    clashes = contradictions(found, config=config).groupBy("query_id").agg(F.count("*").alias("contradictions"))
    counts = found.groupBy("query_id").agg(F.collect_list("agreement_count").alias("counts"), F.first("unique_sources").alias("unique"))
    scored = staged(counts, agreement_score=agreement_score(F.col("counts"), F.col("unique")))
    reasons = scored.select("query_id", "agreement_score", agreement_reason(F.lit(1), F.size("counts"), F.col("unique"), F.col("agreement_score")).alias("reason"))
    out = found.join(reasons, "query_id").join(clashes, "query_id", "left")
    return out.select("query_id", "rank", "page_id", "chunk_id", "cluster_id", "agreement_count", "combined_score", preview(F.col("text"), 240).alias("preview"), "unique_sources", "agreement_score", "reason", F.coalesce("contradictions", F.lit(0)).alias("contradictions"))
