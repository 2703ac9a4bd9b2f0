"""What the training-data operators share: Arrow mapping, held-out split, bounded samples and shared-folder tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python strings at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def map_columns(df: DataFrame, schema: str, make: Callable[[], Callable[..., tuple[list, ...]]]) -> DataFrame:
    """Maps Arrow batches without any per-row serialisation.

    make() runs once per task and returns a function from the input columns (as lists) to the output columns (as
    lists of any common length).
    """
    struct: StructType = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, f = to_arrow_schema(struct), make()
        for batch in small_parts(batches):
            out = f(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, struct)


def map_text(df: DataFrame, make: Callable[[], Callable[[list], list]], using: str | None = None) -> DataFrame:
    """df with another text: the function maps a list of texts (and, with using, that column's values) to new texts."""
    at, more = df.columns.index("text"), df.columns.index(using) if using else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in small_parts(batches):
            args = [batch.column(k).to_pylist() for k in (at, more) if k is not None]
            columns = list(batch.columns)
            columns[at] = pa.array(f(*args), pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = df.mapInArrow(run, df.schema)
    return out.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else out


def keep_texts(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of df, all columns, whose text the function keeps: no shuffle and no join by id."""
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in small_parts(batches):
            yield batch.filter(pa.array(f(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


_STATE: dict = {}


def worker_state(kind: str, source, build: Callable):
    """build(source), kept in this worker process from task to task until another operator's state takes its place."""
    if _STATE.get("kind") != kind or _STATE.get("source") is not source:
        forget()
        _STATE.update(kind=kind, source=source, value=build(source))
    return _STATE["value"]


def forget() -> None:
    """Frees what earlier operators kept in this worker process, and gives it back to the system."""
    if _STATE:
        _STATE.clear()
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(HELD_OUT_MODULUS)) == HELD_OUT_REMAINDER, F.lit(False))


def hashed_below(share: float | Column, *cols: Column) -> Column:
    """A repeatable Bernoulli sample of the rows by the hash of cols: no shuffle, and the same rows at any partitioning."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) < F.lit(share) * float(1 << 30)


def unused(name: str, *frames: DataFrame) -> str:
    """name, with lines before it until no column of the frames is called that."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name in taken:
        name = f"_{name}"
    return name


#: Ids fall into so many buckets at most; this bounds what near_ids broadcasts.
ID_BUCKETS = 1 << 20


def near_ids(df: DataFrame, ids: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of df (inside: False, the others) whose doc_id falls into a bucket with one of ids' doc_id.

    A cheap pass before an exact join: no row of df is shuffled, what is broadcast has ID_BUCKETS rows at most, and rows that
    only share a bucket are left to the join.  Rows without an id are in no bucket.
    """
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS)).cast("int")
    buckets = ids.where("doc_id is not null").select(bucket.alias("bucket")).distinct().alias("__near")
    of = F.when(df["doc_id"].isNotNull(), F.pmod(F.xxhash64(df["doc_id"]), F.lit(ID_BUCKETS)).cast("int"))
    return df.join(F.broadcast(buckets), of == F.col("__near.bucket"), "left_semi" if inside else "left_anti")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Only a local session (tests) may do without and gets a temporary one."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", base := tempfile.mkdtemp(prefix="attesta-"))
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder, which cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def settle(spark: SparkSession, *paths: str) -> None:
    """Drops tables and, through Spark, the shuffle files of finished steps."""
    remove(spark, *paths)
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
