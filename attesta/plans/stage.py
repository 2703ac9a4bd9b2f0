"""Plan barriers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that are computed once, however often later expressions and filters name them.

    Projections collapse into their readers, and inside a lambda nothing is shared; a one-row generator is left alone by both.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def cut(df: DataFrame) -> DataFrame:
    """df computed once, in the checkpoint folder that all executors share, for plans that read it several times."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.  Only a local session may do without spark.checkpoint.dir."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", folder := tempfile.mkdtemp(prefix="attesta-"))
    return folder.rstrip("/")


#: Values fall into so many buckets at most; this bounds what possibly_in broadcasts.
BUCKETS = 1 << 20


def possibly_in(df: DataFrame, column: str, others: DataFrame) -> DataFrame:
    """The rows of df whose column falls into a bucket with a value of the same column of others.

    A cheap pass before an exact join: no row is shuffled, and what is broadcast has BUCKETS rows at most, however many
    values there are.
    """
    bucket = F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")
    buckets = others.select(bucket.alias("bucket")).distinct().alias("_near")
    return df.join(F.broadcast(buckets), F.pmod(F.xxhash64(df[column]), F.lit(BUCKETS)).cast("int") == F.col("_near.bucket"), "left_semi")
