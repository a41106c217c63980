"""Work that starts as soon as all rows of a key have arrived, over a growing folder of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def complete_keys(rows: DataFrame, key: str, parts: list[str], expected: int) -> DataFrame:
    """Keys that have `expected` different parts."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*parts)).alias("n")).where(F.col("n") == expected).select(key)


def follow(spark: SparkSession, path: str, schema: StructType, key: str, parts: list[str], expected: int, store: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], out: str) -> None:
    """Reads what is new in a folder of JSON files, keeps all rows in `store` and appends work(rows)
    to `out` for keys that are complete and not in it yet. Batches that are tried again write
    their own folder anew, so a lost driver repeats nothing."""

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{store}/batch={n}")
        rows = spark.read.schema(schema).parquet(store)
        ready = complete_keys(rows, key, parts, expected)
        try:
            done = spark.read.parquet(out).where(F.col("batch") != n).select(key).distinct()
            ready = ready.join(done, key, "left_anti")
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        work(rows.join(ready, key, "left_semi")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    q = spark.readStream.schema(schema).json(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
