"""Metrics of labelled runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(test: Column) -> Column:
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def detection_metrics(df: DataFrame, expected: Column, detected: Column) -> DataFrame:
    """One row: counts, recall (TPR), false-positive rate and precision."""
    sums = df.agg(
        F.count_if(expected & detected).alias("tp"),
        F.count_if(expected & ~detected).alias("fn"),
        F.count_if(~expected & detected).alias("fp"),
        F.count_if(~expected & ~detected).alias("tn"),
    )
    rate = lambda a, b: F.round(F.when(F.col(a) + F.col(b) == 0, 0.0).otherwise(F.col(a) / (F.col(a) + F.col(b))), 4)
    return sums.select("tp", "fn", "fp", "tn", rate("tp", "fn").alias("recall"), rate("fp", "tn").alias("false_positive_rate"), rate("tp", "fp").alias("precision"))


def detection_by_category(df: DataFrame, category: str, correct: Column) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("cases"), F.count_if(correct).alias("passed"), F.round(share(correct), 4).alias("rate"))


def latency_summary(df: DataFrame, category: str, value: Column, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Count, mean, nearest-rank percentiles and maximum for each category."""
    ranks = [F.expr(f"percentile_disc({q}) within group (order by _v)").alias(f"p{round(100 * q)}") for q in quantiles]
    return df.withColumn("_v", value).groupBy(category).agg(F.count("*").alias("n"), F.round(F.avg("_v"), 4).alias("mean"), *ranks, F.max("_v").alias("largest"))
