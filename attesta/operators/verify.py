"""Claims against sources: a stance for each chunk, a verdict for each source, one verdict for each claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions.text import claim_terms, coverage, negated, preview
from ..plans.stage import staged


def stances(df: DataFrame, claim: Column, config: EngineConfig = DEFAULTS) -> DataFrame:
    """df (with ranked) plus `stances`: array<struct<chunk_id, section, score, stance, coverage, text_preview>>.

    The cheap tests (rank, score, coverage) come before the look at each sentence.
    """
    known = staged(df, _claim=claim_terms(claim))
    terms = F.col("_claim")
    least = max(config.claim_min_coverage, 0.4)
    near = staged(known, _near=F.filter(F.slice("ranked", 1, config.claim_top), lambda c: (c["normalized_score"] >= config.claim_min_score) & (coverage(c["matched_terms"], terms) >= least)))
    found = F.transform(
        "_near",
        lambda c: F.struct(
            c["chunk_id"].alias("chunk_id"),
            c["section"].alias("section"),
            c["normalized_score"].alias("score"),
            F.when(negated(c["text"], terms), "refute").otherwise("support").alias("stance"),
            F.round(coverage(c["matched_terms"], terms), 4).alias("coverage"),
            preview(c["text"], 240).alias("text_preview"),
        ),
    )
    return staged(near, stances=found).drop("_claim", "_near")


def source_verdict(found: Column) -> Column:
    """verdict, confidence, reason of one source's stances."""
    signal = lambda stance: F.aggregate(F.filter(found, lambda s: s["stance"] == stance), F.lit(0.0), lambda t, s: t + s["score"])
    return decide(signal("support"), signal("refute"))


def decide(support: Column, refute: Column) -> Column:
    verdict = F.when(support > refute * 1.5, "supported").when(refute > support * 1.5, "refuted").otherwise("unclear")
    reason = (
        F.when((support == 0) & (refute == 0), "no_chunks_passed_term_coverage")
        .when(support > refute * 1.5, "majority_supporting_chunks")
        .when(refute > support * 1.5, "majority_refuting_chunks")
        .otherwise("mixed_or_conflicting_chunks")
    )
    confidence = F.round(F.least(F.lit(1.0), F.abs(support - refute) / 2 + 0.2), 4)
    return F.struct(verdict.alias("verdict"), F.when(verdict == "unclear", F.least(confidence, F.lit(0.5))).otherwise(confidence).alias("confidence"), reason.alias("reason"), F.lit("lexical").alias("method"))


def decide_model(support: Column, refute: Column) -> Column:
    """The same from a model's stance probabilities (refuting mass is the contradiction score, not entailment)."""
    verdict = F.when(support > refute * 1.5, "supported").when(refute > support * 1.5, "refuted").otherwise("unclear")
    confidence = F.round(F.least(F.lit(1.0), F.abs(support - refute) / F.greatest(support + refute, F.lit(1.0)) + 0.2), 4)
    return F.struct(verdict.alias("verdict"), F.when(verdict == "unclear", F.least(confidence, F.lit(0.5))).otherwise(confidence).alias("confidence"), F.lit("nli").alias("method"))


def combine(per_source: DataFrame) -> DataFrame:
    """claim_id, verdict, confidence, reason, n_sources from rows with claim_id, verdict and confidence."""
    supported, refuted = F.col("n_supported"), F.col("n_refuted")
    sums = per_source.groupBy("claim_id").agg(
        F.count("*").alias("n_sources"),
        F.count_if(F.col("verdict") == "supported").alias("n_supported"),
        F.count_if(F.col("verdict") == "refuted").alias("n_refuted"),
        F.avg(F.when(F.col("verdict") == "supported", F.col("confidence"))).alias("c_supported"),
        F.avg(F.when(F.col("verdict") == "refuted", F.col("confidence"))).alias("c_refuted"),
    )
    one = (supported > 0) & (refuted == 0)
    other = (refuted > 0) & (supported == 0)
    both = (supported > 0) & (refuted > 0)
    return sums.select(
        "claim_id",
        F.when(one, "supported").when(other, "refuted").otherwise("unclear").alias("verdict"),
        F.round(F.when(one, F.col("c_supported")).when(other, F.col("c_refuted")).when(both, 0.4).otherwise(0.1), 4).alias("confidence"),
        F.when(one, F.concat(supported.cast("string"), F.lit("_sources_support"))).when(other, F.concat(refuted.cast("string"), F.lit("_sources_refute"))).when(both, "sources_conflict").otherwise("no_source_returned_a_verdict").alias("reason"),
        "n_sources",
    )
