"""Ranking a text's chunks for a task, selecting under a token budget, and assembling the context.

The collection of a score is one text, so everything a score needs lies in the text's own row: term counts, document
frequencies and lengths are higher-order functions over its array of chunks, and ranking many texts for many tasks
takes no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions.text import coverage, normalize, phrases, query_term_count, rounded, sentences, task_terms, tokens, trim_to_budget
from ..plans.stage import staged
from .chunk import chunk_array


def with_tasks(df: DataFrame, tasks: list[str]) -> DataFrame:
    """A row for each row and task: task_id (from 1) and task."""
    each = F.array(*[F.struct(F.lit(i).alias("task_id"), F.lit(t).alias("task")) for i, t in enumerate(tasks, 1)])
    return df.withColumn("_t", F.explode(each)).withColumn("task_id", F.col("_t.task_id")).withColumn("task", F.col("_t.task")).drop("_t")


def counted(df: DataFrame, chunks: Column, vocabulary: Column) -> DataFrame:
    """df with `_chunks`: the chunks with their number of tokens and those tokens, of text and heading, that are in the vocabulary.

    A chunk's text is split once, however many tasks it is ranked for.
    """
    known = lambda ts: F.filter(ts, lambda t: F.array_contains(F.col("_vocabulary"), t))
    split = staged(df, _vocabulary=vocabulary, _split=F.transform(chunks, lambda c: c.withField("tokens", tokens(c["text"]))))
    slim = lambda c: c.withField("length", F.size(c["tokens"])).withField("tokens", known(c["tokens"])).withField("heading", known(tokens(F.coalesce(c["section"], F.lit("")))))
    return staged(split, _chunks=F.transform("_split", slim)).drop("_split", "_vocabulary")


def rank(df: DataFrame, chunks: Column, tasks: list[str] | None = None, metadata: Column | None = None, structured: Column | None = None, config: EngineConfig = DEFAULTS) -> DataFrame:
    """df, for each of tasks (or with a column task of its own), plus `ranked`: its chunks with scores, best first.

    metadata, structured: texts of what the page says of itself, for words that it and a chunk share.
    """
    k1, b = config.k1, config.b
    none = F.array().cast("array<string>")
    vocabulary = task_terms(F.col("task")) if tasks is None else F.array_distinct(F.flatten(F.array(*[task_terms(F.lit(t)) for t in tasks]))) if tasks else none
    own = counted(df, chunks, vocabulary)
    shown = lambda text: none if text is None else F.array_distinct(tokens(text))
    own = staged(own, _meta=shown(metadata), _data=shown(structured))
    words = staged(own if tasks is None else with_tasks(own, tasks), _terms=task_terms(F.col("task")), _phrases=phrases(F.col("task")))
    all_chunks, terms, n = F.col("_chunks"), F.col("_terms"), F.size("_chunks")
    frequencies = staged(
        words,
        _average=F.greatest(F.aggregate(all_chunks, F.lit(0.0), lambda s, c: s + c["length"]) / F.greatest(n, F.lit(1)), F.lit(1.0)),
        _df=F.transform(terms, lambda t: F.struct(t.alias("t"), F.size(F.filter(all_chunks, lambda c: F.array_contains(c["tokens"], t))).alias("df"))),
    )
    weighed = staged(frequencies, _idf=F.transform("_df", lambda x: F.struct(x["t"].alias("t"), F.log(1 + (n - x["df"] + 0.5) / F.greatest(x["df"] + 0.5, F.lit(1.0))).alias("idf"))))
    empty = F.size("_terms") == 0

    def bm25(c: Column) -> Column:
        stretch = k1 * (1 - b + b * c["length"] / F.col("_average"))
        found = F.transform("_idf", lambda x: F.struct(x["idf"].alias("idf"), F.size(F.filter(c["tokens"], lambda v: v == x["t"])).alias("tf")))
        return F.aggregate(F.filter(found, lambda x: x["tf"] > 0), F.lit(0.0), lambda s, x: s + x["idf"] * (x["tf"] * (k1 + 1)) / (x["tf"] + stretch))

    def scored(c: Column) -> Column:
        shared = F.array_intersect(terms, c["tokens"])
        parts = {
            "bm25": F.when(empty, F.when(c["chunk_id"] == 1, 1.0).otherwise(0.0)).otherwise(bm25(c)),
            "phrase": F.when(empty, 0.0).otherwise(F.size(F.filter("_phrases", lambda p: F.instr(F.lower(c["text"]), p) > 0)) * config.phrase_bonus),
            "heading": F.when(empty, 0.0).otherwise(F.size(F.array_intersect(terms, c["heading"])) * config.heading_boost),
            "metadata": F.size(F.array_intersect(shared, F.col("_meta"))) * config.metadata_boost,
            "structured_data": F.size(F.array_intersect(shared, F.col("_data"))) * config.structured_boost,
            "position": F.when(~empty & (c["chunk_id"] == 1), config.position_prior).otherwise(0.0),
        }
        matched = F.filter(terms, lambda t: F.array_contains(c["tokens"], t))
        return c.dropFields("tokens", "length", "heading").withField("matched_terms", matched).withField("breakdown", F.struct(*[v.cast("double").alias(k) for k, v in parts.items()]))

    total = lambda c: sum((c["breakdown"][k] for k in ("phrase", "heading", "metadata", "structured_data", "position")), c["breakdown"]["bm25"])
    rows = staged(weighed, _rows=F.transform(all_chunks, scored))
    topped = staged(rows, _top=F.array_max(F.transform("_rows", total)))
    short = staged(topped, _rounded=F.transform("_rows", lambda c: c.withField("score", rounded(total(c))).withField("normalized_score", F.when(F.col("_top") > 0, rounded(total(c) / F.col("_top"))).otherwise(0.0))))
    best_first = lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).otherwise((x["chunk_id"] - y["chunk_id"]).cast("int"))
    return staged(short, ranked=F.array_sort("_rounded", best_first)).drop("_chunks", "_terms", "_phrases", "_meta", "_data", "_average", "_df", "_idf", "_rows", "_top", "_rounded")


def selected_ids(ranked: Column, max_tokens: Column | int, min_score: float = DEFAULTS.min_score) -> Column:
    """Ids of a greedy choice in rank order: what scores too low or doesn't fit is passed over; the first is always taken."""
    budget = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    picks = F.transform(ranked, lambda c: F.struct(c["chunk_id"].alias("id"), c["token_estimate"].alias("tokens"), c["normalized_score"].alias("score")))

    def step(state: Column, c: Column) -> Column:
        first = F.size(state["ids"]) == 0
        take = (first | ((c["score"] >= min_score) & (state["total"] + c["tokens"] <= budget))) & ~state["done"]
        total = state["total"] + F.when(take, c["tokens"]).otherwise(0)
        return F.struct(F.when(take, F.concat(state["ids"], F.array(c["id"]))).otherwise(state["ids"]).alias("ids"), total.alias("total"), (state["done"] | (take & (total >= budget))).alias("done"))

    zero = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("total"), F.lit(False).alias("done"))
    return F.aggregate(picks, zero, step, lambda s: F.array_sort(s["ids"]))


def select(df: DataFrame, max_tokens: Column | int, min_score: float = DEFAULTS.min_score) -> DataFrame:
    """df (with ranked) plus `selected`: the chosen chunks by chunk_id."""
    ids = staged(df, _ids=selected_ids(F.col("ranked"), max_tokens, min_score))
    by_id = lambda x, y: (x["chunk_id"] - y["chunk_id"]).cast("int")
    return staged(ids, selected=F.array_sort(F.filter("ranked", lambda c: F.array_contains("_ids", c["chunk_id"])), by_id)).drop("_ids")


def relevant_text(df: DataFrame, text: Column, headings: Column | None, query: str | None, max_tokens: int, config: EngineConfig = DEFAULTS) -> DataFrame:
    """df plus `relevant`: the chunks of text that suit the query, within the budget; without a query, or without chunks, its beginning."""
    whole = staged(df, _text=normalize(text))
    if not query:
        return staged(whole, relevant=trim_to_budget(F.col("_text"), max_tokens)).drop("_text")
    chunked = staged(whole, _own=chunk_array(F.col("_text"), headings, config))
    chosen = select(rank(chunked, F.col("_own"), [query], config=config), max_tokens, config.min_score)
    parts = F.array_join(F.transform("selected", lambda c: c["text"]), "\n\n---\n\n")
    return staged(chosen, relevant=F.when(F.size("selected") > 0, parts).otherwise(trim_to_budget(F.col("_text"), max_tokens))).drop("_text", "_own", "ranked", "selected", "task", "task_id")


def context_text(selected: Column) -> Column:
    return F.array_join(F.transform(selected, lambda c: F.concat(F.lit("[chunk "), c["chunk_id"].cast("string"), F.lit(" | score "), c["score"].cast("string"), F.lit("]\n"), c["text"])), "\n\n---\n\n")


def by_norm(selected: Column) -> Column:
    return F.array_sort(
        selected,
        lambda x, y: F.when(x["normalized_score"] > y["normalized_score"], -1).when(x["normalized_score"] < y["normalized_score"], 1).otherwise((x["chunk_id"] - y["chunk_id"]).cast("int")),
    )


def priority(selected: Column, most: int = 3) -> Column:
    """tldr, top_sections, highlight_chunk_ids; chunks after the one that completes the sentences are not looked at."""

    def step(state: Column, c: Column) -> Column:
        done = F.size(state["s"]) >= most
        added = F.slice(F.array_distinct(F.concat(state["s"], sentences(c["text"]))), 1, most)
        ids = F.when(F.size(state["ids"]) < most, F.concat(state["ids"], F.array(c["chunk_id"]))).otherwise(state["ids"])
        sections = F.when(F.length(F.coalesce(c["section"], F.lit(""))) > 0, F.array_distinct(F.concat(state["sec"], F.array(c["section"])))).otherwise(state["sec"])
        return F.when(done, state).otherwise(F.struct(added.alias("s"), sections.alias("sec"), ids.alias("ids")))

    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("s"), none.alias("sec"), F.array().cast("array<int>").alias("ids"))
    finish = lambda s: F.struct(F.array_join(s["s"], " ").alias("tldr"), F.slice(s["sec"], 1, 5).alias("top_sections"), s["ids"].alias("highlight_chunk_ids"))
    return F.aggregate(by_norm(selected), zero, step, finish)


def confidence(selected: Column, task: Column, max_tokens: Column | int, config: EngineConfig = DEFAULTS) -> Column:
    """level, score, reasons of what was selected."""
    budget = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    ordered = by_norm(selected) if config.confidence_top == "best_score" else selected
    top = F.try_element_at(ordered, F.lit(1))
    n_terms = query_term_count(task)
    score = F.coalesce(top["normalized_score"], F.lit(0.0))
    share = F.when(n_terms == 0, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.size(top["matched_terms"]), F.lit(0)) / n_terms))
    used = F.aggregate(selected, F.lit(0), lambda s, c: s + c["token_estimate"])
    fill = F.when(budget > 0, used / budget).otherwise(0.0)
    reason = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    none = F.size(selected) == 0
    reasons = F.when(none, F.array(F.lit("no_chunks_selected"))).otherwise(
        F.concat(reason(score < 0.35, "low_top_score"), reason((share < 0.34) & (n_terms > 1), "few_query_terms_matched"), reason((F.size(selected) == 1) & (fill < 0.2), "very_short_evidence"))
    )
    total = F.when(none, 0.0).otherwise(rounded(F.least(F.lit(1.0), score * 0.6 + share * 0.3 + F.least(fill, F.lit(0.5)) * 0.2)))
    level = F.when(none, "low").when((F.size(reasons) == 0) & (total >= 0.6), "high").when((F.size(reasons) >= 2) | (total < 0.3), "low").otherwise("medium")
    return F.struct(level.alias("level"), total.alias("score"), reasons.alias("reasons"))


def rerank_array(ranked: Column, scores: Column, weight: float = 1.0, top: int = 12) -> Column:
    """Blends a scorer's numbers (one for each of the first `top` chunks) with the normalised score; the tail stays as it is."""
    head = F.slice(ranked, 1, top)
    best = F.greatest(F.array_max(scores), F.lit(1e-9))
    mixed = F.zip_with(head, scores, lambda c, s: c.withField("normalized_score", rounded((c["normalized_score"] + weight * s / best) / (1 + weight))))
    return F.concat(by_norm(mixed), F.filter(ranked, lambda c, i: i >= top))


def rerank(df: DataFrame, scorer: Callable[[Iterator[tuple[pd.Series, pd.Series]]], Iterator[pd.Series]] | None = None, weight: float = 1.0, top: int = 12) -> DataFrame:
    """df (with task and ranked) with the first `top` chunks in the order of a second scorer, blended with the normalised score.

    scorer: for batches of tasks and their lists of texts a list of scores each, with its model loaded once for each worker; by
    default the share of the task's terms that a chunk has.
    """
    head = F.slice("ranked", 1, top)
    if scorer:
        scores = F.pandas_udf(scorer, "array<double>", F.PandasUDFType.SCALAR_ITER)(F.col("task"), F.transform(head, lambda c: c["text"]))
    else:
        terms = task_terms(F.col("task"))
        scores = F.transform(head, lambda c: coverage(c["matched_terms"], terms))
    scored = staged(df.withColumn("_scores", scores), _reranked=rerank_array(F.col("ranked"), F.col("_scores"), weight, top))
    return scored.drop("ranked", "_scores").withColumnRenamed("_reranked", "ranked")
