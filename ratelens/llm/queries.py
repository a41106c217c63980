"""The registered queries over the document tables: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm import oracles
from ratelens.llm.common import new_path, table


def op1_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratelens.llm.sharding import shard_documents

    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratelens.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"], out="d")
    return found.select(
        "doc_id", "d.n_words", "d.n_hit", F.size("d.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("d.items", ","), 256).alias("items_sha256"), (F.col("d.n_hit") > 0).alias("contaminated"),
    )


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratelens.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratelens.llm.quality_rules import COUNTS, apply_rules

    return apply_rules(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def op5_token_ids_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratelens.llm.orc_ids import read_index, write_ids

    path = new_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_index(spark, path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratelens.llm.packing import pack

    packed = pack(table(spark, sf_dir, "documents"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratelens.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratelens.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is spark.ratelens.pii.key, or a public one where that is unset."""
    from ratelens.llm.pii import pseudonymise

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, spark.conf.get("spark.ratelens.pii.key", "a public key"))
    return out.select("doc_id", F.size("pii").cast("long").alias("n_values"), "text")


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratelens.llm.classifier import score_documents

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_documents(docs, labels, keep=["doc_id"]).select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        op1_label_propagation_shards, op2_decontamination, op3_main_text, op4_host_rules, op5_token_ids_orc,
        op6_packing, op7_line_dedup, op8_simhash_components, op9_feistel_pseudonyms,
        op10_quality_gam,
    )
}

ORACLE_SQL = oracles.ORACLE_SQL
