"""Splitting texts into chunks: an ordered fold over a text's paragraphs, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions.text import normalize, normalize_match, strip, token_estimate

CHUNK = "struct<section:string,text:string,char_start:int,char_end:int>"


def is_heading(paragraph: Column, known: Column | None) -> Column:
    short = (F.length(paragraph) <= 80) & ~paragraph.rlike("[.!?]$") & paragraph.rlike("^[A-Z0-9][A-Za-z0-9 /:_-]+$")
    return short if known is None else short | F.array_contains(known, normalize_match(paragraph))


def paragraphs(normalized: Column) -> Column:
    """array<struct<text, char_start, char_end>>: parts between empty lines, with offsets into the normalised text."""
    parts = F.split(normalized, "\n\n+")

    def step(state: Column, part: Column) -> Column:
        text = strip(part)
        start = state["at"] + F.length(part) - F.length(F.regexp_replace(part, r"^\s+", ""))
        own = F.struct(text.alias("text"), start.alias("char_start"), (start + F.length(text)).alias("char_end"))
        return F.struct((state["at"] + F.length(part) + 2).alias("at"), F.when(F.length(text) > 0, F.concat(state["out"], F.array(own))).otherwise(state["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,char_start:int,char_end:int>>").alias("out"))
    return F.aggregate(parts, zero, step, lambda s: s["out"])


def match_headings(headings: Column) -> Column:
    return F.transform(headings, normalize_match)


def chunk_array(text: Column, headings: Column | None = None, config: EngineConfig = DEFAULTS) -> Column:
    """array<struct<chunk_id, section, text, char_start, char_end, token_estimate>>.

    headings: a column of known headings in match form (match_headings).

    A heading closes the current chunk and opens the next; so does a paragraph that would stretch it over the limit.
    Chunks below the least size are dropped and the others numbered from 1.
    """
    none = F.lit(None).cast(CHUNK)

    def step(state: Column, p: Column) -> Column:
        heading, now = is_heading(p["text"], headings), state["now"]
        close = now.isNotNull() & (heading | (p["char_end"] - now["char_start"] > config.max_chunk_chars))
        section = F.when(heading, p["text"]).otherwise(state["section"])
        fresh = F.struct(section.alias("section"), p["text"].alias("text"), p["char_start"].alias("char_start"), p["char_end"].alias("char_end"))
        longer = F.struct(now["section"].alias("section"), F.concat(now["text"], F.lit("\n\n"), p["text"]).alias("text"), now["char_start"].alias("char_start"), p["char_end"].alias("char_end"))
        return F.struct(
            F.when(close, F.concat(state["out"], F.array(now))).otherwise(state["out"]).alias("out"),
            F.when(now.isNull() | close, fresh).otherwise(longer).alias("now"),
            section.alias("section"),
        )

    zero = F.struct(F.array().cast(f"array<{CHUNK}>").alias("out"), none.alias("now"), F.lit(None).cast("string").alias("section"))
    raw = F.aggregate(paragraphs(normalize(text)), zero, step, lambda s: F.when(s["now"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["now"]))))
    texts = F.transform(raw, lambda c: c.withField("text", normalize(c["text"])))
    kept = F.filter(texts, lambda c: F.length(c["text"]) >= config.min_chunk_chars)
    return F.transform(
        kept,
        lambda c, i: F.struct((i + 1).alias("chunk_id"), c["section"].alias("section"), c["text"].alias("text"), c["char_start"].alias("char_start"), c["char_end"].alias("char_end"), token_estimate(c["text"]).alias("token_estimate")),
    )


def chunks(df: DataFrame, id_col: str, text: Column, headings: Column | None = None, config: EngineConfig = DEFAULTS) -> DataFrame:
    """A row for each chunk: id, chunk_id, section, text, char_start, char_end, token_estimate."""
    return df.select(id_col, F.inline(chunk_array(text, headings, config)))
