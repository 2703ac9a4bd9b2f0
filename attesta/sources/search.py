"""Corpus search, where no search service is at hand, and the readers of search services' answers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..config import DEFAULTS
from ..functions.text import task_terms, tokens
from ..functions.url import source_class, unwrap_redirect
from ..operators.dom import normalize, tree
from ..plans.stage import cut, staged

SERVICE_ANSWER = "web struct<results:array<struct<title:string,url:string,description:string>>>"


def service_hits(answer: Column, limit: int = 5) -> Column:
    """array<struct<title, url, snippet, source_quality>> of a JSON search answer; hits without title or url are left out."""
    results = F.filter(F.coalesce(F.from_json(answer, SERVICE_ANSWER)["web"]["results"], F.array().cast("array<struct<title:string,url:string,description:string>>")), lambda r: (F.length(r["title"]) > 0) & (F.length(r["url"]) > 0))
    return F.transform(F.slice(results, 1, limit), lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"), F.coalesce(r["description"], F.lit("")).alias("snippet"), source_class(r["url"], r["title"]).alias("source_quality")))


HITS = "title string, href string, snippet string"


def page_anchors(html: str | None) -> list[dict]:
    """Title, link and snippet of each result on a results page, in page order; read from the element tree, so the order of
    attributes, tags within titles and character references don't matter."""
    out = []
    for result in tree(html or "").walk():
        if "result" not in result.attrs.get("class", "").split():
            continue
        of = lambda name: result.find(lambda e: name in e.attrs.get("class", "").split())  # noqa: B023, E731
        anchor, snippet = of("result__a"), of("result__snippet")
        title, href = (normalize(anchor.text()), anchor.attrs.get("href", "")) if anchor else ("", "")
        if title and href:
            out.append({"title": title, "href": href, "snippet": normalize(snippet.text()) if snippet else ""})
    return out


def result_page_hits(answers: DataFrame, id_col: str, html_col: str, limit: int = 5) -> DataFrame:
    """id and `hits`: array<struct<title, url, snippet, source_quality>> of a results page, redirect links unwrapped."""
    schema = f"`{id_col}` {answers.schema[id_col].dataType.simpleString()}, found array<struct<{HITS.replace(' string', ':string')}>>"
    struct = _parse_datatype_string(schema)

    def run(batches):
        arrow = to_arrow_schema(struct)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                ids, pages = batch.slice(k, 64).columns
                yield pa.RecordBatch.from_arrays([ids, pa.array([page_anchors(x) for x in pages.to_pylist()], arrow.field(1).type)], schema=pa.schema([pa.field(id_col, ids.type), arrow.field(1)]))

    found = answers.select(id_col, html_col).mapInArrow(run, struct)
    url = F.transform("found", lambda r: F.struct(r["title"].alias("title"), unwrap_redirect(r["href"]).alias("url"), r["snippet"].alias("snippet")))
    usable = staged(found, _u=F.slice(F.filter(url, lambda r: r["url"].isNotNull()), 1, limit))
    return usable.select(id_col, F.transform("_u", lambda r: r.withField("source_quality", source_class(r["url"], r["title"]))).alias("hits"))


def corpus_search(docs: DataFrame, id_col: str, text: Column, queries: list[str], limit: int = 5) -> DataFrame:
    """query_id, id, score, rank: BM25 over the corpus.

    Only the queries' own terms leave a document's row, as counts; document frequencies and lengths are partial sums,
    and the top of each query is cut in every task before the shuffle.
    """
    k1, b = DEFAULTS.k1, DEFAULTS.b
    wanted = docs.sparkSession.createDataFrame([(i, q) for i, q in enumerate(queries, 1)], "query_id int, query string").select("query_id", F.explode(task_terms(F.col("query"))).alias("term")).distinct()
    terms = F.array(*[F.lit(r[0]) for r in wanted.select("term").distinct().orderBy("term").collect()]).cast("array<string>")
    counted = staged(docs, _t=tokens(text)).select(id_col, F.size("_t").alias("length"), F.filter("_t", lambda t: F.array_contains(terms, t)).alias("_own"))
    each = lambda t: F.struct(t.alias("term"), F.size(F.filter("_own", lambda x: x == t)).alias("tf"))
    counted = cut(counted.select(id_col, "length", F.transform(F.array_distinct("_own"), each).alias("hits")))
    totals = counted.agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()
    n, average = totals["n"], max(totals["average"] or 0.0, 1.0)
    postings = counted.select(id_col, "length", F.inline("hits"))
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    weights = wanted.join(frequency, "term").withColumn("idf", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / F.greatest(F.col("df") + 0.5, F.lit(1.0))))
    scored = postings.join(weights, "term").withColumn("part", F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / average)))
    best = scored.groupBy("query_id", id_col).agg(F.round(F.sum("part"), 4).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
