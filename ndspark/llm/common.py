"""Shared folder, staging and column helpers of the pipeline operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new
    temporary folder that is then set, if the master is local; else an error, as executors
    would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else None
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run of one operator, below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through the file system that owns it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, and what
    follows survives the loss of any executor."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def unstage(*frames: DataFrame) -> None:
    """Delete what stage() wrote, when no later plan reads it."""
    for path, df in {getattr(df, "staged_at", None): df for df in frames}.items():
        if path:
            drop_folder(df.sparkSession, path)


def to_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def binary_texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without a detour by str."""
    values = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return values.cast(kind).to_pylist()


def small_batches(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = 16 << 20
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of the column each, or one row:
    bounds what a Python worker holds when texts are very long."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if batch.column(column).nbytes <= limit:
            yield batch
            continue
        step = max(1, n * limit // max(1, batch.column(column).nbytes))
        for i in range(0, n, step):
            yield batch.slice(i, step)


def least_by_hash(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k rows with the least hash of some columns: a sample that depends on nothing else.
    A cutoff that about 2 k rows pass comes first, so that tasks do not each offer k rows."""
    h, n, some = F.xxhash64(*columns), df.count(), df
    if n > 8 * k:
        under = df.where(h <= int(-(1 << 63) + (1 << 64) * (2 * k / n)))
        some = under if under.limit(k).count() >= k else df
    return some.orderBy(h, *columns).limit(k)
