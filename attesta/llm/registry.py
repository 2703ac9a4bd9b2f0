"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, flac, langid, linededup, maintext, pii, quality, simhash, suffixdedup
from .common import table

WORD_BPE = "word_bpe_49k.json"


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(table(spark, sf_dir, "documents"))


def op2_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digest(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digest(table(spark, sf_dir, "documents"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_langid, op2_maintext, op3_bpe, op4_flac, op5_pii, op6_suffixdedup, op7_decontam, op8_quality, op9_linededup, op10_simhash)}


#: The line key in SQL: ASCII white space stripped, A-Z lower-cased, nothing else.
KEY = r"translate(regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES_SQL = f"""
with split as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
numbered as (select r, unnest(lines) as line, generate_subscripts(lines, 1) as n from split),
keyed as (select r, n, line, {KEY} as key from numbered),
shared as (select key from keyed where key <> '' group by key having count(distinct r) >= 10),
marked as (select k.*, s.key is not null as gone from keyed k left join shared s using (key)),
sums as (select r, count(*) as n_lines, count(*) filter (gone) as n_dropped, coalesce(string_agg(line, chr(10) order by n) filter (not gone), '') as kept from marked group by r)
select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from split join sums using (r)"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can say.  The other operators train models, decode streams, hash with XXH64 or compare all
    strings of 400 bytes; tests/llm holds their brute-force versions, round trips and held-out accuracy."""
    return {"op9_linededup": LINES_SQL}
