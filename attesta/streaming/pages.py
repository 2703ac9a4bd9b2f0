"""The page pipeline over a stream of arriving pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..operators.capsule import capsules

PAGES = "page_id long, url string, html string"


def read_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def first_seen(pages: DataFrame, arrived: str, within: str = "10 minutes") -> DataFrame:
    """Pages whose content did not arrive before within the watermark; older state is dropped."""
    return pages.withColumn("fingerprint", fingerprint(F.col("html"))).withWatermark(arrived, within).dropDuplicatesWithinWatermark(["fingerprint"])


def stream_capsules(pages: DataFrame, tasks: list[str]) -> DataFrame:
    """Capsules of a stream: stateless, so any output mode and any number of restarts do."""
    return capsules(pages, tasks)


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums for each window and event type.  In append mode a window is given out once the watermark has passed its
    end, and its state is dropped; rows that come later don't count."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
