"""The page cache as queries over an append-only log of fetches (Parquet in production)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Letters of the fingerprint that name a partition of the stored log.
PREFIX = 2


def store(entries: DataFrame, path: str, fingerprint: str = "fingerprint") -> None:
    """Appends entries to the log, in partitions by the fingerprint's first letters."""
    entries.withColumn("part", F.substring(fingerprint, 1, PREFIX)).write.mode("append").partitionBy("part").parquet(path)


def stored(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    """The log, or one fingerprint's entries, for which only its partition is read."""
    log = spark.read.option("basePath", path).parquet(path)
    if fingerprint is not None:
        log = log.where((F.col("part") == fingerprint[:PREFIX]) & (F.col("fingerprint") == fingerprint))
    return log.drop("part")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def latest(log: DataFrame, key: str, stored_at: str, *tie: str) -> DataFrame:
    """The last entry of each key, as an upsert leaves it.  max_by sums up before the shuffle, so a hot key costs no task."""
    order = F.struct(stored_at, *tie)
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("_e")).select(key, "_e.*")


def fresh(entries: DataFrame, stored_at: Column, now: Column, ttl_seconds: Column | int) -> DataFrame:
    """Entries within their time to live, counted from when they were stored, however often they were read."""
    ttl = F.lit(ttl_seconds) if isinstance(ttl_seconds, int) else ttl_seconds
    return entries.where(micros(now) - micros(stored_at) <= ttl.cast("long") * 1_000_000)


def least_recent_out(entries: DataFrame, last_access: str, size: int, *tie: str) -> DataFrame:
    """The `size` most recently used entries: a top-k that every task shortens before anything moves."""
    return entries.orderBy(F.desc(last_access), *[F.desc(t) for t in tie]).limit(size)


def by_fingerprint(entries: DataFrame, fingerprint: str, stored_at: str, now: Column, ttl_seconds: Column | int, *tie: str) -> DataFrame:
    """The last entry of each fingerprint, if it is still within its time to live."""
    return fresh(latest(entries, fingerprint, stored_at, *tie), F.col(stored_at), now, ttl_seconds)


def listed(entries: DataFrame, key: str, stored_at: str, now: Column, ttl_seconds: Column | int) -> DataFrame:
    """What the cache holds: key, stored_at, and seconds of life left."""
    ttl = F.lit(ttl_seconds) if isinstance(ttl_seconds, int) else ttl_seconds
    left = ttl.cast("long") - F.floor((micros(now) - micros(F.col(stored_at))) / 1_000_000)
    return fresh(latest(entries, key, stored_at), F.col(stored_at), now, ttl_seconds).select(key, stored_at, left.alias("seconds_left"))


def statistics(log: DataFrame, key: str, stored_at: str, ttl_seconds: int) -> DataFrame:
    """One row: lookups, hits (an entry of the key within its time to live came before), misses, distinct keys.

    Lookups are summed by key and stretch of ttl_seconds: in a stretch all but the first are hits, and the first is one if the
    stretch before ends near enough.  So a hot key is many small sums, not one task's rows.
    """
    ttl = ttl_seconds * 1_000_000
    at = micros(F.col(stored_at))
    sums = log.groupBy(F.col(key).alias("key"), F.floor(at / ttl).alias("stretch")).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    before = sums.select("key", (F.col("stretch") + 1).alias("stretch"), F.col("last").alias("before"))
    met = sums.join(before, ["key", "stretch"], "left")
    hits = F.col("n") - 1 + F.coalesce((F.col("first") - F.col("before") <= ttl).cast("long"), F.lit(0))
    return met.agg(F.sum("n").alias("lookups"), F.sum(hits).alias("hits"), (F.sum("n") - F.sum(hits)).alias("misses"), F.countDistinct("key").alias("keys"))
