"""Shared helpers: reading tables, cutting lineage, joining behind a size check."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.functions.workers import importable

#: Bytes that a side may have, as counted before the join, to be broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ratelens-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def tidy(spark: SparkSession):
    """Executions inside drop their shuffle files at their end: what follows reads their result from
    the shared folder. (Spark does so itself only when the driver collects garbage.)"""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, lineage cut, survives lost executors."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as a compressed table in the shared folder and read again, and its path, for
    unstash() once what follows is cut too."""
    path = new_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def unstash(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bytes_of(df: DataFrame) -> int:
    """The size of df's rows: 16 bytes for each, 8 for each value and entry of an array, and strings."""
    def size(f: T.StructField) -> F.Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            return F.coalesce(F.size(c), F.lit(0)).cast("long") * 8 + 16
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
        if isinstance(f.dataType, T.StructType):
            return F.lit(8 * len(f.dataType) + 16).cast("long")
        return F.lit(8).cast("long")

    return df.agg(F.sum(sum(map(size, df.schema.fields), F.lit(16).cast("long")))).first()[0] or 0


def small(df: DataFrame) -> DataFrame:
    """Marks df for broadcast if its rows are counted to have at most BROADCAST_BYTES; else Spark
    shuffles. Give only frames that are cheap to read: cut() or written ones."""
    return F.broadcast(df) if bytes_of(df) <= BROADCAST_BYTES else df


def give_back() -> None:
    """Returns freed memory to the system: workers live on in other stages, where it would count."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def slices(batches, rows: int = 256):
    """Record batches cut into short ones, so that memory follows texts rather than the batch size."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def append(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + list(new.values()), names=[*keep, *new])


def fields(df: DataFrame, keep: list[str]) -> list:
    return [df.schema[c] for c in keep]
