"""From documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm.classifier import drop_rejected
from ratelens.llm.common import new_path, table
from ratelens.llm.decontaminate import drop_contaminated
from ratelens.llm.line_dedup import dedup_lines
from ratelens.llm.packing import pack
from ratelens.llm.simhash import LOOSE, keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, as they are. An empty table or one without
    labelled rows loses none."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that match an earlier one; n_chars follows the text."""
    own = {c: f"__own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    out = dedup_lines(docs.withColumnsRenamed(own)).drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, fingerprints of 128 bits at 22 or fewer
    differing bits (11 of the first 64), the distance that similarities of 0.8 or more have."""
    return keep_one(docs, setting=LOOSE)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, placed in sequences."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("packing", packing),
]

#: A learned classifier and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again. Empty tables
    give no rows; null texts count as empty from packing on and null ids are kept; rows that repeat an
    id are separate documents; further columns of documents pass through up to packing, whatever
    their names. The stages' files stay in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
