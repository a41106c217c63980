"""Token ids in ORC files.

Documents are dealt by ranges of doc_id and sorted, so files, stripes and row groups each span a
narrow range of ids: their column statistics prune by range, Bloom filters on doc_id prune point
look-ups, integers are run-length encoded, and readers split files by stripe.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelens.llm.common import cut, small
from ratelens.llm.tokens import with_ids

STRIPE_BYTES, ROW_INDEX_ROWS, BLOOM_FPP, PART_BYTES = 64 << 20, 10_000, 0.01, 128 << 20
#: Pieces that a worker remembers: nothing else here takes much memory, and rare words recur.
PIECES = 1_500_000


def write_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2, partitions: int | None = None) -> None:
    """Writes doc_id (as a long), n_tokens, ids, part (the file's place in ascending doc_id order) and
    row (the place in the file) to ORC files at `path`. Null and empty texts have the end id alone.
    Null ids come first; rows that repeat an id are all written, in the order of a hash of their
    texts, by which they are dealt as well. Unless told, a range is made for each PART_BYTES of what
    Spark takes the input's size for, or for each shuffle partition if those are more."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 20, -(-size // PART_BYTES)))
    order = ("doc_id", F.xxhash64("text"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    (
        with_ids(dealt, keep=["doc_id"], path=tokenizer, end_id=end_id, pieces=PIECES)
        .select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
        .write.mode("errorifexists")
        .options(**{
            "compression": "zstd", "orc.stripe.size": STRIPE_BYTES, "orc.create.index": "true", "orc.row.index.stride": ROW_INDEX_ROWS,
            "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": BLOOM_FPP, "orc.encoding.strategy": "COMPRESSION",
        })
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, part and row as written; filters on doc_id are pushed to the ORC reader."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>, part int, row long").orc(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What is read back, as doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    Running sums are within files; what lies before each file comes from the files' totals."""

    def run(batches):
        for b in batches:
            ids = b.column(3)
            values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_pylist()
            raw = memoryview(np.ascontiguousarray(values)).cast("B")
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(offsets, offsets[1:])]
            n = pa.array(np.diff(ids.offsets.to_numpy()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), n, pa.array(crc, pa.int64())], names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    read = read_ids(spark, path).select("doc_id", "part", "row", "ids").mapInArrow(run, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    totals = read_ids(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each file.
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        read.join(small(cut(before)), "part")
        .select("doc_id", (F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
    )
