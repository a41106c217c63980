"""Pairing, completeness, matching of operating points and integrity rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligible_pairs(df: DataFrame, keys: list[str], side: str, candidate, anchor, matched: str, size: str, tolerance: float) -> DataFrame:
    """keys and reason, the first that holds: missing (a side is), unmatched, tolerance (sizes differ
    by more), or null for eligible pairs. One aggregation, no self-join."""
    at = lambda s, c: F.max(F.when(F.col(side) == F.lit(s), F.col(c)))
    p = df.groupBy(*keys).agg(at(candidate, size).alias("cs"), at(anchor, size).alias("as"), at(candidate, matched).alias("cm"), at(anchor, matched).alias("am"))
    reason = (
        F.when(F.expr("cs is null or `as` is null"), "missing").when(~(F.col("cm") & F.col("am")), "unmatched")
        .when(F.abs(F.col("cs") - F.col("as")) > tolerance * F.col("as"), "tolerance")
    )
    return p.select(*keys, reason.alias("reason"))


def common_subset(df: DataFrame, keys: list[str], member: str, members: list, where: Column | None = None) -> DataFrame:
    """keys for which every one of `members` has a row that qualifies."""
    ok = df.where(F.col(member).isin(members))
    ok = ok if where is None else ok.where(where)
    return ok.groupBy(*keys).agg(F.count_distinct(member).alias("n")).where(F.col("n") == len(members)).select(*keys)


def completeness(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, problem: missing (expected, absent), unexpected, or duplicate; complete keys have
    no row."""
    n = actual.groupBy(*keys).agg(F.count("*").alias("n"))
    e = expected.select(*keys).distinct().withColumn("__e", F.lit(True))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return e.join(n, keys, "full").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), problem.alias("problem")).where("problem is not null")


def brackets(points: DataFrame, keys: list[str], at: str, target: str) -> DataFrame:
    """points with a target column -> keys, target, low_at, high_at: the first neighbours in order
    of `at` between which the target lies."""
    a, t = F.col(at), F.col(target)
    g = points.groupBy(*keys, target).agg(F.max(F.when(a < t, a)).alias("__below"), F.min(F.when(a > t, a)).alias("__above"), F.count_if(a == t).alias("__on"))
    # On a point the pair that ends there comes first; at the lowest point the one that begins there.
    on, low = F.col("__on"), F.col("__below")
    g = g.withColumns({
        "low_at": F.when((on > 0) & low.isNull(), t).otherwise(low),
        "high_at": F.when((on > 0) & (low.isNotNull() | (on > 1)), t).otherwise(F.col("__above")),
    })
    return g.where("low_at is not null and high_at is not null").select(*keys, target, "low_at", "high_at")


def nearest(points: DataFrame, keys: list[str], at: str, parameter: str, target: str, log: bool = False) -> DataFrame:
    """keys, target, at, parameter of the nearest point; ties to the lower parameter."""
    gap = F.abs(F.ln(at) - F.ln(target)) if log else F.abs(F.col(at) - F.col(target))
    best = F.min(F.struct(F.round(gap, 9).alias("gap"), F.col(parameter).alias(parameter), F.col(at).alias(at))).alias("b")
    return points.groupBy(*keys, target).agg(best).select(*keys, target, f"b.{at}", f"b.{parameter}")


def drop_disturbed(df: DataFrame, group: list[str], disturbed: Column) -> DataFrame:
    """Rows of groups in which no row is disturbed: one bad observation rejects the whole group."""
    bad = df.where(disturbed).select(*group).distinct()
    return df.join(bad, group, "left_anti")


def contiguous(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """keys, n, ok: whether the indices are exactly 0 to n - 1."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), ((F.min(index) == 0) & (F.max(index) == F.count("*") - 1) & (F.count_distinct(index) == F.count("*"))).alias("ok")
    )


def digest_mismatches(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, digest) tables -> name, problem: absent, unlisted or different."""
    both = listed.select("name", F.col("digest").alias("l")).join(actual.select("name", F.col("digest").alias("a")), "name", "full")
    return both.select("name", F.when(F.col("a").isNull(), "absent").when(F.col("l").isNull(), "unlisted").when(F.col("a") != F.col("l"), "different").alias("problem")).where("problem is not null")


def forbidden_lines(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, line (from 1), found: the first match on every line with one."""
    lines = df.where(F.col(text).rlike(pattern)).select(key, F.posexplode(F.split(text, "\n")).alias("i", "s"))
    return lines.where(F.col("s").rlike(pattern)).select(key, (F.col("i") + 1).alias("line"), F.regexp_extract("s", f"({pattern})", 1).alias("found"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule (null counts as broken); one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return reduce(DataFrame.unionByName, [counts.select(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules]) if len(rules) < 2 else counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])).alias("r")).select("r.*")
