"""Evidence files: string tables, JSON records, compressed record archives, digest lists and process
snapshots. Sinks refuse what a reader could not take back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder with a header; every column is a string, as cast where it is used."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_rows(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty table is refused."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    df.write.option("header", True).option("escape", '"').csv(path)


def _finite(df: DataFrame) -> None:
    """Refuses NaN and infinities in any column of floats, which JSON can't hold."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if floats:
        bad = F.lit(False)
        for c in floats:
            bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
        if df.where(bad).limit(1).count():
            raise ValueError("NaN or infinity can't be written")


def _publish(spark: SparkSession, made: str, path: str) -> None:
    fs = spark._jvm.org.apache.hadoop.fs
    target = fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target):
        system.delete(target, True)
    if not system.rename(fs.Path(made), target):
        raise OSError(f"{path} was not written")


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines in a folder that appears whole or not at all: written beside it, then renamed."""
    _finite(df)
    made = f"{path}.tmp-{uuid.uuid4().hex}"
    df.write.json(made)
    _publish(df.sparkSession, made, path)


def digests(lines: DataFrame, column: str = "value") -> DataFrame:
    """digest, n: how often each SHA-256 occurs among the lines."""
    return lines.groupBy(F.sha2(column, 256).alias("digest")).agg(F.count("*").alias("n"))


def write_archive(df: DataFrame, path: str, order: list[str]) -> None:
    """gzip JSON lines, ranged and sorted by `order`, read back and held against the digests of what
    was written before the archive takes its place."""
    _finite(df)
    spark = df.sparkSession
    lines = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    made = f"{path}.tmp-{uuid.uuid4().hex}"
    lines.write.option("compression", "gzip").text(made)
    want, got = digests(lines), digests(spark.read.text(made))
    if want.exceptAll(got).limit(1).count() or got.exceptAll(want).limit(1).count():
        raise OSError("what was read back differs from what was written")
    _publish(spark, made, path)


def read_archive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of write_archive(); a line that isn't a record of the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, digest of a digest list: 64 hexadecimal digits, two spaces (or a space and a star), a name."""
    m = lambda i: F.regexp_extract("value", r"^([0-9a-fA-F]{64}) [ *](.+)$", i)
    return spark.read.text(path).where(F.trim("value") != "").select(m(2).alias("name"), F.lower(m(1)).alias("digest"))


def write_digests(df: DataFrame, path: str) -> None:
    """name, digest as a digest list, in the order of names."""
    df.orderBy("name").select(F.concat("digest", F.lit("  "), "name").alias("value")).write.text(path)


def digest_files(spark: SparkSession, folder: str) -> DataFrame:
    """name (below the folder) and digest of every file in it, folders below too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    name = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    return files.select(F.substring(name, F.lit(len(root) + 2), F.length(name)).alias("name"), F.sha2("content", 256).alias("digest"))


def process_snapshot(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines' columns and pid, command, state, parent, ticks (user and system) and started of the
    kernel's process lines; rows of another form are left out. A command may hold spaces and brackets."""
    parts = F.split(F.regexp_extract(column, r"^\d+ \(.*\) (.*)$", 1), " ")
    out = lines.where(F.col(column).rlike(r"^\d+ \(.*\) \S( -?\d+){20}")).withColumn("__p", parts)
    at = lambda i: F.col("__p")[i].cast("long")
    return out.select(
        *[c for c in lines.columns if c != column], F.regexp_extract(column, r"^(\d+)", 1).cast("long").alias("pid"), F.regexp_extract(column, r"^\d+ \((.*)\)", 1).alias("command"),
        F.col("__p")[0].alias("state"), at(1).alias("parent"), (at(11) + at(12)).alias("ticks"), at(19).alias("started"),
    )
