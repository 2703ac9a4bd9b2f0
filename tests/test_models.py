"""Ordered folds against row-at-a-time models on random inputs, and readers on arbitrary text."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import chunk, dom, rank
from attesta.plans.stage import staged


def plain_chunks(text, most=1800, least=80):
    paragraphs = [(m.group().strip(), m.start(), m.start() + len(m.group().strip())) for m in re.finditer(r"\S(?:(?!\n\n)[\s\S])*", text)]
    out, now, section = [], [], None

    def push():
        joined = dom.normalize("\n\n".join(p[0] for p in now))
        if now and len(joined) >= least:
            out.append((len(out) + 1, section, joined, now[0][1], now[-1][2]))

    for p in paragraphs:
        heading = len(p[0]) <= 80 and p[0][-1] not in ".!?" and re.fullmatch(r"[A-Z0-9][A-Za-z0-9 /:_-]+", p[0])
        if heading:
            push()
            now, section = [], p[0]
        if now and p[2] - now[0][1] > most:
            push()
            now = []
        now.append(p)
    push()
    return out


def test_chunks_equal_the_model(spark):
    rng, rows = random.Random(1), []
    for i in range(150):
        parts = [rng.choice(("Heading Number 1", "A title: part", "x" * rng.randint(1, 900), "Some words here. " * rng.randint(1, 60), "lower case line", "a\nb\nc")) for _ in range(rng.randint(0, 14))]
        rows.append((i, rng.choice(("\n\n", "\n\n\n", " \n\n ")).join(parts)))
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: [tuple(c)[:5] for c in r.c] for r in df.select("id", chunk.chunk_array(F.col("text")).alias("c")).collect()}
    assert all(got[i] == plain_chunks(dom.normalize(t)) for i, t in rows)


def test_selection_equals_the_model(spark):
    rng, rows = random.Random(2), []
    for i in range(300):
        rows.append((i, rng.randint(1, 120), [(k, rng.randint(1, 60), round(rng.random(), 2)) for k in rng.sample(range(1, 30), rng.randint(0, 9))]))

    def plain(budget, ranked):
        ids, total = [], 0
        for k, tokens, score in ranked:
            if ids and (score < 0.05 or total + tokens > budget):
                continue
            ids.append(k)
            total += tokens
            if total >= budget:
                break
        return sorted(ids)

    df = spark.createDataFrame(rows, "id long, budget int, ranked array<struct<chunk_id:int,token_estimate:int,normalized_score:double>>")
    got = {r.id: [c.chunk_id for c in r.selected] for r in rank.select(df, F.col("budget")).collect()}
    assert all(got[i] == plain(b, r) for i, b, r in rows)


def test_staged_values_are_computed_once(spark):
    df = staged(spark.range(5), a=F.rand())
    assert all(r.a == r.b == r.c for r in df.select("a", F.col("a").alias("b"), (F.col("a") * 1).alias("c")).where("a >= 0").collect())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/ab p=\"'!-&;hdivtr\n", max_size=80))
def test_any_markup_can_be_read(html):
    c = dom.clean_page(html, "http://x.example/")
    assert [b["id"] for b in c["blocks"]] == list(range(1, len(c["blocks"]) + 1))


def test_text_functions_take_nulls_and_blanks(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",), ("é\U0001f600",)], "t string")
    c = F.col("t")
    rows = df.select(T.normalize(c).alias("n"), T.tokens(c).alias("k"), T.shingles(c).alias("s"), T.sentences(c).alias("e"), T.preview(c, 240).alias("p"), T.trim_to_budget(c, 1).alias("b"), T.token_estimate(c).alias("x"), T.jaccard(T.shingles(c), T.shingles(c)).alias("j")).collect()
    assert rows[1].n == "" and rows[1].k == [] and rows[1].s == [] and rows[1].x == 0 and rows[1].j == 0.0 and rows[0].n is None
    assert rows[3].x == 1 and rows[3].b == "é\U0001f600"
