"""Intervals, paired comparisons, bootstrap and their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """keys and one column for each name of `at`: that percentile of value with linear interpolation;
    null and non-finite values don't count. Equal values are counted before the shuffle, places are
    found by running counts, and only the two values around a place are kept; groups that repeat few
    values move few rows."""
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    counted = df.select(*keys, v.alias("__v")).groupBy(*keys, "__v").agg(F.count("__v").alias("__c"))
    order = Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_last())
    run = counted.withColumns({"__end": F.sum("__c").over(order), "__n": F.sum("__c").over(Window.partitionBy(*keys))})
    low, holds = lambda p: F.floor(F.lit(p) * (F.col("__n") - 1)), lambda i: (F.col("__end") - F.col("__c") <= i) & (i < F.col("__end"))
    parts = []
    for name, p in at.items():
        parts += [F.max(F.when(holds(low(p)), F.col("__v"))).alias(f"__a_{name}"), F.max(F.when(holds(F.least(low(p) + 1, F.col("__n") - 1)), F.col("__v"))).alias(f"__b_{name}")]
    found = run.groupBy(*keys).agg(F.max("__n").alias("__n"), *parts)
    part = lambda p: F.lit(p) * (F.col("__n") - 1) - low(p)
    return found.select(*keys, *[(F.col(f"__a_{c}") + (F.col(f"__b_{c}") - F.col(f"__a_{c}")) * part(p)).alias(c) for c, p in at.items()])


def percentile_interval(df: DataFrame, keys: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """keys, low, high: two-sided percentiles."""
    return percentiles(df, keys, value, {"low": alpha / 2, "high": 1 - alpha / 2})


def median_ratio(df: DataFrame, keys: list[str], unit: str, side: str, value: str, candidate, anchor) -> DataFrame:
    """keys, units, ratio_pct, geo_ratio, least_ratio, most_ratio: medians by unit and side, then the
    ratio of their sums (not the mean of ratios) less one in percent, over units with both sides."""
    m = df.groupBy(*keys, unit, side).agg(F.median(value).alias("m"))
    both = (
        m.groupBy(*keys, unit).agg(F.max(F.when(F.col(side) == F.lit(candidate), F.col("m"))).alias("c"), F.max(F.when(F.col(side) == F.lit(anchor), F.col("m"))).alias("a"))
        .where("c is not null and a is not null")
    )
    r = F.col("c") / F.col("a")
    return both.groupBy(*keys).agg(
        F.count("*").alias("units"), ((F.sum("c") / F.sum("a") - 1) * 100).alias("ratio_pct"),
        F.exp(F.avg(F.ln(r))).alias("geo_ratio"), F.min(r).alias("least_ratio"), F.max(r).alias("most_ratio"),
    )


def won_tied_lost(df: DataFrame, keys: list[str], value: str, band: float = 1e-9) -> DataFrame:
    """keys, won (below -band), tied, lost, missing, median_value."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count_if(v < -band).alias("won"), F.count_if(F.abs(v) <= band).alias("tied"), F.count_if(v > band).alias("lost"),
        F.count_if(v.isNull()).alias("missing"), F.median(v).alias("median_value"),
    )


def conclusion(low: Column, high: Column, valid: Column, total: Column) -> Column:
    """Reads an interval: any invalid replicate leaves it open."""
    return (
        F.when(valid != total, "insufficient_bootstrap_overlap").when(high < 0, "lower_rate").when(low > 0, "higher_rate").otherwise("inconclusive")
    )


def drawn(n: str, *parts: str) -> Column:
    """A number below the SQL n that the parts decide: 60 bits of their MD5, so that any system that
    has MD5 draws the same."""
    text = ", ':', ".join(f"cast({p} as string)" for p in parts)
    return F.expr(f"pmod(cast(conv(substring(md5(concat({text})), 1, 15), 16, 10) as bigint), {n})")


#: Slots of a stratum that are drawn for together.
CHUNK = 4096


def _placed(units: DataFrame, stratum: str, unit: str, *more: str) -> DataFrame:
    """stratum, unit, `more`, place (from 0 in the order of units) and n, the stratum's size. One row a unit."""
    return units.select(stratum, unit, *more).withColumns({
        "place": F.expr(f"row_number() over (partition by {stratum} order by {unit}) - 1"), "n": F.expr(f"count(*) over (partition by {stratum})"),
    })


def _draws(units: DataFrame, stratum: str, replicates: int) -> DataFrame:
    """replicate, stratum, place: n draws from the places of each stratum of n units, made from the
    strata's sizes alone, in tasks of their own however few strata there are."""
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = units.groupBy(stratum).agg(F.count("*").alias("n"))
    chunks = sizes.select(stratum, "n", F.explode(F.expr(f"sequence(0L, n - 1, {CHUNK}L)")).alias("__from")).repartition(n, stratum, "__from")
    slots = chunks.select(stratum, "n", F.explode(F.expr(f"sequence(__from, least(__from + {CHUNK}, n) - 1)")).alias("slot"))
    draws = slots.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    return draws.select("replicate", stratum, drawn("n", "replicate", stratum, "slot").cast("int").alias("place"))


def stratified_draws(units: DataFrame, stratum: str, unit: str, replicates: int) -> DataFrame:
    """replicate, stratum, unit, weight: in each replicate each stratum of n units is drawn from n
    times with replacement, by a hash of (replicate, stratum, slot). Draws are counted before they
    are joined to units, so weights follow the multinomial distribution. Units are never broadcast:
    both sides grow with them."""
    placed = _placed(units, stratum, unit).select(stratum, unit, "place").hint("shuffle_hash")
    counted = _draws(units, stratum, replicates).groupBy("replicate", stratum, "place").agg(F.count("*").alias("weight"))
    return counted.join(placed, [stratum, "place"]).select("replicate", stratum, unit, "weight")


def nested_bootstrap(samples: DataFrame, stratum: str, unit: str, block: str, index: str, candidate: str, anchor: str, blocks: int, repetitions: int, replicates: int) -> DataFrame:
    """replicate, change_pct: paired bootstrap of nested timings. In each replicate units are drawn in
    their strata, for each drawn unit blocks, and in each drawn block repetitions; both sides use the
    same draws. A drawn unit gives the median of either side's times, and the change is that of the
    sums of medians. Samples have one row for each unit, block and index, both from 0, with both
    sides' times; drawn places without a row give no time."""
    placed = _placed(samples.select(stratum, unit).distinct(), stratum, unit)
    draws = placed.select(stratum, "n", F.col("place").alias("slot")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draws = draws.withColumn("place", drawn("n", "replicate", stratum, "slot").cast("int")).join(placed.select(stratum, "place", unit), [stratum, "place"])
    draws = draws.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("__block", drawn(str(blocks), "replicate", stratum, "slot", "b"))
    draws = draws.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1)))).withColumn("__index", drawn(str(repetitions), "replicate", stratum, "slot", "b", "r"))
    times = samples.select(F.col(unit).alias("__unit"), F.col(block).alias("__b"), F.col(index).alias("__i"), F.col(candidate).alias("__c"), F.col(anchor).alias("__a"))
    met = draws.join(times, (F.col(unit) == F.col("__unit")) & (F.col("__block") == F.col("__b")) & (F.col("__index") == F.col("__i")))
    medians = met.groupBy("replicate", stratum, "slot").agg(F.median("__c").alias("c"), F.median("__a").alias("a"))
    return medians.groupBy("replicate").agg(((F.sum("c") / F.sum("a") - 1) * 100).alias("change_pct"))


def bootstrap_means(units: DataFrame, stratum: str, unit: str, value: str, replicates: int) -> DataFrame:
    """replicate, mean: the mean of value over every replicate's draws. Each draw meets the value at
    its place once, in a join that broadcasts neither side, and only sums are grouped."""
    placed = _placed(units, stratum, unit, value).select(stratum, "place", value).hint("shuffle_hash")
    met = _draws(units, stratum, replicates).join(placed, [stratum, "place"])
    return met.groupBy("replicate").agg((F.sum(value) / F.count("*")).alias("mean"))
