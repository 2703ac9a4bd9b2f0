"""Agreement and contradiction across the sources of a query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions.text import cosine, negated, preview, shingles, tokens


def leaders(similar: Callable, threshold: float, first: bool, scores: list[float], items: list) -> list[int]:
    """Cluster numbers (from 1) by sequential leader clustering.

    first: join the first leader at the threshold, else the most similar one.  A member with a better score leads on.
    """
    lead: list[int] = []
    out = []
    for i, item in enumerate(items):
        best, best_similarity = -1, 0.0
        for c, k in enumerate(lead):
            s = similar(item, items[k])
            if first and s >= threshold:
                best = c
                break
            if not first and s > best_similarity:
                best, best_similarity = c, s
        if best < 0 or not first and best_similarity < threshold:
            lead.append(i)
            out.append(len(lead))
        else:
            if scores[i] > scores[lead[best]]:
                lead[best] = i
            out.append(best + 1)
    return out


def set_jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a and b else 0.0


def vector_cosine(a, b) -> float:
    if a is None or b is None or len(a) != len(b) or not len(a):
        return 0.0
    norm = float((a @ a) ** 0.5 * (b @ b) ** 0.5)
    return float(a @ b) / norm if norm else 0.0


def cluster(pool: DataFrame, by_vector: bool, config: EngineConfig = DEFAULTS) -> DataFrame:
    """query_id, source_index, chunk_id, cluster_id of a pool (with text, or embedding; and normalized_score).

    Leader clustering depends on the order (source, chunk), so each query's pool is one group.  A pool holds the few
    selected chunks of a query's sources, however large the corpus is; many queries spread over the cluster.
    """
    item = F.col("embedding") if by_vector else shingles(F.col("text"), config.shingle)
    rows = pool.select("query_id", "source_index", "chunk_id", F.col("normalized_score").cast("double").alias("score"), item.alias("item"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source_index", "chunk_id"], kind="stable")
        if by_vector:
            numbers = leaders(vector_cosine, config.cosine_threshold, False, pdf["score"].tolist(), [None if x is None else np.asarray(x, float) for x in pdf["item"]])
        else:
            numbers = leaders(set_jaccard, config.jaccard_threshold, True, pdf["score"].tolist(), [frozenset(x) for x in pdf["item"]])
        return pdf.assign(cluster_id=numbers)[["query_id", "source_index", "chunk_id", "cluster_id"]]

    return rows.groupBy("query_id").applyInPandas(run, "query_id long, source_index long, chunk_id long, cluster_id int")


def agreement(pool: DataFrame) -> DataFrame:
    """pool (with cluster_id) plus agreement_count and combined_score.  Counts are summed before the shuffle and joined back."""
    counts = pool.groupBy("query_id", "cluster_id").agg(F.countDistinct("source_index").alias("agreement_count"))
    joined = pool.join(counts, ["query_id", "cluster_id"])
    return joined.withColumn("combined_score", F.round(F.col("normalized_score") * F.least(F.lit(1.6), 1 + 0.25 * (F.col("agreement_count") - 1)), 4))


def one_per_cluster(ranked: DataFrame, most: int = 12) -> DataFrame:
    """The best chunk of each cluster, then the best `most` of a query, with `rank`."""
    order = [F.desc("combined_score"), F.desc("normalized_score"), F.asc("source_index"), F.asc("chunk_id")]
    best = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "cluster_id").orderBy(*order))).where("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= most)


def budgeted(evidence: Column, max_tokens: int) -> Column:
    """Ids of evidence (array of structs with rank and token_estimate, by rank) within the budget; the first is always taken."""

    def step(s: Column, e: Column) -> Column:
        take = (F.size(s["ranks"]) == 0) | (s["total"] + e["token_estimate"] <= max_tokens)
        return F.struct(F.when(take, F.concat(s["ranks"], F.array(e["rank"]))).otherwise(s["ranks"]).alias("ranks"), (s["total"] + F.when(take, e["token_estimate"]).otherwise(0)).alias("total"))

    zero = F.struct(F.array().cast("array<int>").alias("ranks"), F.lit(0).alias("total"))
    return F.aggregate(evidence, zero, step, lambda s: s["ranks"])


def agreement_score(counts: Column, unique_sources: Column) -> Column:
    """counts: agreement counts of the selected evidence."""
    total = F.aggregate(counts, F.lit(0), lambda s, c: s + (c.cast("int") - 1))
    return F.when((unique_sources <= 1) | (F.size(counts) == 0), 0.0).otherwise(F.round(total / (F.size(counts) * (unique_sources - 1)), 4))


def agreement_reason(fetched: Column, selected: Column, unique_sources: Column, score: Column) -> Column:
    return (
        F.when(fetched == 0, "no_sources_fetched")
        .when(selected == 0, "sources_returned_no_relevant_chunks")
        .when(unique_sources == 1, "only_one_source_returned_evidence")
        .when(score < 0.1, "sources_did_not_overlap")
        .when(score >= 0.4, "multiple_sources_corroborated")
        .otherwise("partial_cross_source_agreement")
    )


def topical_pairs(top: DataFrame) -> DataFrame:
    """Each two of a query's chunks (rank, source_index, chunk_id and more) from different sources, as columns _a and _b."""
    a, b = (top.select("query_id", *[F.col(c).alias(f"{c}_{s}") for c in top.columns if c != "query_id"]) for s in "ab")
    return a.join(b, "query_id").where((F.col("rank_a") < F.col("rank_b")) & (F.col("source_index_a") != F.col("source_index_b")))


def contradiction_candidates(ranked: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Pairs of a query's top chunks from different sources that are about the same thing (cosine at the topical floor).

    ranked: query_id, rank, source_index, embedding.  Only the top few chunks of a query meet, joined on query_id.
    """
    top = ranked.where(F.col("rank") <= config.contradiction_top).select("query_id", "rank", "source_index", "chunk_id", "embedding")
    similar = topical_pairs(top).withColumn("topical_similarity", cosine(F.col("embedding_a"), F.col("embedding_b")))
    return similar.where(F.col("topical_similarity") >= config.topical_floor).drop("embedding_a", "embedding_b")


def term_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sets of terms: what stands in for an embedding where no model is at hand."""
    both = F.sqrt(F.size(a).cast("double")) * F.sqrt(F.size(b).cast("double"))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def contradictions(ranked: DataFrame, stance: Callable[[Column, Column, Column], Column] | None = None, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Pairs of a query's top chunks from different sources that are about the same thing and deny each other.

    ranked: query_id, rank, source_index, chunk_id, text.  stance(preview_a, preview_b, shared terms) gives how sure a model
    is (0 to 1, null for no contradiction); by default a pair contradicts if a negation stands beside the shared terms on
    exactly one side, and is as sure as half of its topical similarity.  Columns: the pair, topical_similarity, confidence, method.
    """
    top = ranked.where(F.col("rank") <= config.contradiction_top).select("query_id", "rank", "source_index", "chunk_id", preview(F.col("text"), 400).alias("text"), F.array_distinct(tokens(F.substring("text", 1, 700))).alias("terms"))
    pairs = topical_pairs(top).withColumn("topical_similarity", F.round(term_cosine(F.col("terms_a"), F.col("terms_b")), 4)).where(F.col("topical_similarity") >= config.topical_floor)
    shared = pairs.withColumn("shared", F.array_intersect("terms_a", "terms_b"))
    if stance:
        judged = shared.withColumn("confidence", stance(F.col("text_a"), F.col("text_b"), F.col("shared"))).withColumn("method", F.lit("model"))
    else:
        one_denies = negated(F.col("text_a"), F.col("shared")) != negated(F.col("text_b"), F.col("shared"))
        judged = shared.withColumn("confidence", F.when(one_denies, F.round(F.col("topical_similarity") / 2, 4))).withColumn("method", F.lit("lexical"))
    return judged.where("confidence is not null").drop("terms_a", "terms_b", "shared")
