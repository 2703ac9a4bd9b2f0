"""Queries against their SQL on rows that the smallest tables do not hold."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import TABLES, plain

from attesta.functions import text as T
from attesta.plans.queries import ORACLES, QUERIES


def same_as_sql(spark, folder, name):
    """The rows that the query and its SQL agree on; folder holds the tables that they read."""
    con = duckdb.connect()
    for t in TABLES:
        if (folder / f"{t}.parquet").exists():
            con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = con.sql(ORACLES[name])
    rows = [tuple(plain(r[c]) for c in found.columns) for r in QUERIES[name](spark, str(folder)).collect()]
    want = [tuple(map(plain, r)) for r in found.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    return rows


def with_table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).toPandas().to_parquet(folder / f"{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def long_pages(spark, tmp_path_factory):
    html = "<html>\n<body>\n<article><h1>Long page</h1>\n" + "".join(f"<p>Paragraph {k}.</p>\n" for k in range(700)) + "</article></body></html>"
    return with_table(spark, tmp_path_factory.mktemp("long"), "pages", [(1, "https://site.example/long", html)], "page_id long, url string, html string")


def test_blocks_of_a_long_page(spark, long_pages):
    assert len(same_as_sql(spark, long_pages, "blocks")) == 701


def test_dom_paths_of_a_long_page(spark, long_pages):
    rows = same_as_sql(spark, long_pages, "dom_paths")
    assert any("p:nth-of-type(700)" in x for r in rows for x in r if isinstance(x, str))


def rows_of(spark, folder, name, key, ids):
    """A table of the rows of sf0.1 with these ids."""
    spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet").where(F.col(key).isin(ids)).toPandas().to_parquet(folder / f"{name}.parquet")
    return folder


def test_rounded_as_sql(spark):
    rng = random.Random(3)
    values = [(rng.randrange(10_001) / 10_000 + rng.randrange(13) / rng.randint(1, 12)) / 2 for _ in range(3000)] + [k / 160 + 0.45 for k in range(160)] + [-k / 7 for k in range(100)] + [-0.00005, 0.0, 1e300]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.r for r in frame.select(T.rounded(F.col("v")).alias("r")).collect()]
    con = duckdb.connect()
    want = [con.execute("select round(?::double, 4)", [v]).fetchone()[0] for v in values]
    assert got == want


def test_blends_that_end_in_a_five(spark, tmp_path):
    same_as_sql(spark, rows_of(spark, tmp_path, "documents", "doc_id", [1625, 2207, 5261, 8417, 9982]), "reranked")


def test_overlaps_and_savings_that_end_in_a_five(spark, tmp_path):
    same_as_sql(spark, rows_of(spark, tmp_path, "pages", "page_id", [517, 596]), "context_capsule")
