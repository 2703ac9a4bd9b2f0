"""Where pages come from and results go to."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import fresh, latest

FETCHED = "requested_url string, final_url string, status int, content_type string, body string, bytes_read long, truncated boolean, timed_out boolean, ok boolean, error string"


def bounded_body(body: Column, max_bytes: int) -> Column:
    """struct<body, bytes_read, truncated>: at most max_bytes bytes, a letter cut in two shown as U+FFFD."""
    raw = body.cast("binary")
    cut = F.make_valid_utf8(F.substring(raw, 1, max_bytes).cast("string"))
    return F.struct(cut.alias("body"), F.least(F.octet_length(raw), F.lit(max_bytes)).cast("long").alias("bytes_read"), (F.octet_length(raw) > max_bytes).alias("truncated"))


def read_pages(spark: SparkSession, path: str, max_bytes: int = 5_000_000) -> DataFrame:
    """page_id, url, html of a Parquet table, bodies bounded as a fetch bounds them."""
    return spark.read.parquet(path).select("page_id", "url", bounded_body(F.col("html"), max_bytes)["body"].alias("html"))


def retriable(status: int | None, error: str | None) -> bool:
    """Network failures and server errors are worth another attempt; the client's own errors aren't."""
    return (status is None and error is not None) or (status is not None and status >= 500)


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str, str, bytes]], retries: int = 1, max_bytes: int = 5_000_000, delay: float = 0.75, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """FETCHED for a column url.  get(url) gives status, final url, content type and body, or raises; time-outs and redirects are its own.

    Before the n-th further attempt it waits n times `delay` seconds.  A failure is a row with ok = false; it never fails the job.
    """

    def one(url: str) -> dict:
        status = error = None
        final, kind, body = url, None, b""
        for attempt in range(retries + 1):
            if attempt:
                wait(delay * attempt)
            try:
                status, final, kind, body = get(url)
                error = None if 200 <= status < 300 else f"status {status}"
            except Exception as e:  # whatever the transport raises belongs in the row
                status, error = None, f"{type(e).__name__}: {e}"
            if error is None or not retriable(status, error):
                break
        return {"requested_url": url, "final_url": final, "status": status, "content_type": kind, "body": body[:max_bytes].decode("utf-8", "replace").removeprefix("﻿"), "bytes_read": min(len(body), max_bytes), "truncated": len(body) > max_bytes, "timed_out": "timeout" in (error or "").lower(), "ok": error is None, "error": error}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(u) for u in batch.column(0).to_pylist() if u]
            types = {"status": pa.int32(), "bytes_read": pa.int64(), "truncated": pa.bool_(), "timed_out": pa.bool_(), "ok": pa.bool_()}
            names = [f.split()[0] for f in FETCHED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names=names)

    return urls.select("url").mapInArrow(run, FETCHED)


def fetch_missing(urls: DataFrame, entries: DataFrame, now: Column, ttl_seconds: Column | int, get: Callable[[str], tuple[int, str, str, bytes]], **options) -> DataFrame:
    """FETCHED and from_cache: urls that have a fresh entry (rows of FETCHED with stored_at) are answered by it, only the others are fetched.

    Only answers that are ok count as entries; failures are asked again.
    """
    known = fresh(latest(entries.where("ok"), "requested_url", "stored_at"), F.col("stored_at"), now, ttl_seconds).drop("stored_at")
    wanted = urls.select("url").distinct()
    names = [f.split()[0] for f in FETCHED.split(", ")]
    hits = known.join(wanted, known["requested_url"] == wanted["url"], "left_semi").select(*names, F.lit(True).alias("from_cache"))
    others = wanted.join(known.select("requested_url"), wanted["url"] == F.col("requested_url"), "left_anti")
    return hits.union(fetch(others, get, **options).select(*names, F.lit(False).alias("from_cache")))


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labelled cases or site lists: a JSON array in one file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON string, the form in which tools hand out results."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
