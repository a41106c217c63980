"""Quality rules per document and, by empirical Bayes, per host.

Base rules are measured on each whole text. Failures are summed by host (map-side first, so a hot
host costs one row per task), the failure rates of all hosts give a beta prior by the method of
moments, each host's rate is shrunk towards it, and hosts whose shrunk rate is over a limit lose
all their documents.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.llm.common import append, cut, fields, slices, small

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Shrunk failure rate above which a whole host is rejected.
MAX_HOST_RATE = 0.6
#: Weight in documents of the prior where the hosts' rates say nothing about it (one host, no spread).
DEFAULT_WEIGHT = 20.0
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    if not text:
        return (0,) * 5
    words = _WORD.findall(text)
    n = len(words)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if _WORD.search(line):
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            many, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if many[w] > 1:
                    repeat += i + WINDOW - max(end, i)
                    end = i + WINDOW
    return n, sum(map(len, words)), sum(map(text.count, _SYMBOLS)), dup, repeat


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (all by default; those named as a count are replaced), COUNTS and
    base_failed. Null and empty texts count zero and fail."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*COUNTS, "base_failed")]

    def run(batches):
        for b in slices(batches):
            rows = [counts(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield append(b, keep, {c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(COUNTS)})

    need = list(dict.fromkeys([*keep, text]))
    schema = T.StructType([*fields(docs, keep), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return (
        docs.select(*need).mapInArrow(run, schema)
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )


def host_rates(ruled: DataFrame, host: str = "source") -> DataFrame:
    """(host, n, failed, rate): rate is the posterior mean (failed + a) / (n + a + b) under the
    beta prior of all hosts. A null host is a host of its own."""
    by = ruled.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    by = by.withColumn("p", F.col("failed") / F.col("n"))
    # Weighted moments: mean m, spread v around it less what binomial noise explains.
    m = by.agg(F.sum("failed").alias("f"), F.sum("n").alias("n"), F.count("*").alias("hosts"), F.sum(F.col("n") * F.col("p") * F.col("p")).alias("s2")).first()
    mean, weight = 0.0, DEFAULT_WEIGHT
    if m.n:
        mean = m.f / m.n
        spread = m.s2 / m.n - mean * mean
        noise = mean * (1 - mean) * m.hosts / m.n
        between = spread - noise
        if m.hosts > 1 and between > 1e-12:
            weight = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
        elif m.hosts > 1:
            weight = 1e6
    a, b = mean * weight, (1 - mean) * weight
    return by.select("host", "n", "failed", ((F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))).alias("rate"))


def apply_rules(docs: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",), max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """docs' columns `keep` (narrow ones: they are checkpointed with the counts, so that texts are
    read once), COUNTS, base_failed, host_rate and kept. Hosts are joined back by broadcast where
    their number is small, else by a shuffle join whose hot partitions Spark splits."""
    ruled = cut(with_counts(docs, text, list(dict.fromkeys([*keep, host]))))
    rates = host_rates(ruled.select(host, "base_failed"), host)
    bad = cut(rates.select(F.col("host").alias("__host"), F.col("rate").alias("host_rate")))
    out = ruled.join(small(bad), F.col(host).eqNullSafe(F.col("__host")), "left")
    kept = ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_rate)
    return out.select(*[c for c in keep if c not in (*COUNTS, "base_failed", "host_rate", "kept")], *COUNTS, "base_failed", "host_rate", kept.alias("kept"))
