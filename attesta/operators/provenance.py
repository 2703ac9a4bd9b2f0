"""Which source blocks a chunk came from: a scored inner join within the page, as higher-order functions over its arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import normalize_match, preview, provenance_terms, rounded


def prepared_blocks(blocks: Column) -> Column:
    """Blocks with their match form and terms; compute once per page, not per chunk."""
    return F.transform(blocks, lambda b: b.withField("match", normalize_match(b["text"])).withField("terms", provenance_terms(normalize_match(b["text"]))))


def prepared_chunks(chunks: Column) -> Column:
    """Chunks with the same, as `match` and `terms`."""
    return F.transform(chunks, lambda c: c.withField("match", normalize_match(c["text"])).withField("terms", provenance_terms(normalize_match(c["text"]))))


def source_blocks(chunk: Column, terms: Column, blocks: Column, most: int = 5) -> Column:
    """The best `most` of prepared blocks by overlap, then id: shared terms over the chunk's terms, plus containment.

    chunk, terms: a prepared chunk's match form and terms, as columns or fields (an expression would run for each block).
    """

    def scored(b: Column) -> Column:
        lexical = F.size(F.array_intersect(terms, b["terms"])) / F.greatest(F.size(terms), F.lit(1))
        inside = F.when((F.length(chunk) == 0) | (F.length(b["match"]) == 0), 0.0).when(F.instr(chunk, b["match"]) > 0, 0.45).when(F.instr(b["match"], chunk) > 0, 0.65).otherwise(0.0)
        return F.struct((-F.least(F.lit(1.0), lexical + inside)).alias("order"), b["id"].alias("id"), b.dropFields("match", "terms").alias("b"))

    usable = F.filter(F.transform(blocks, scored), lambda x: (x["order"] < 0) & (F.size(terms) > 0))
    best = F.slice(F.array_sort(usable, lambda x, y: F.when(x["order"] < y["order"], -1).when(x["order"] > y["order"], 1).otherwise((x["id"] - y["id"]).cast("int"))), 1, most)
    return F.transform(best, lambda x: x["b"].withField("overlap_score", rounded(-x["order"])).withField("text_preview", preview(x["b"]["text"], 220)))
