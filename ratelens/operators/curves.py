"""Rate-quality curves: weighted aggregation, Pareto frontier, BD-rate and omission sensitivity.

Every operator is a fixed number of windows and group-bys over the caller's keys, so all curves of
a table are worked on at once and any number of them spreads over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE, OVERLAP = 1e-12, 1e-9


def mse_to_db(mse: Column) -> Column:
    """PSNR of 8-bit samples; infinite where the error is zero."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(65025.0) / mse))


def weighted_curve(df: DataFrame, keys: list[str], weight: str, value: str, size: str, axis: str = "plain") -> DataFrame:
    """keys, rate (8 sum(size) / sum(weight)) and quality (weighted mean of value). axis: "plain";
    "mse" pools errors first and turns the pooled one to dB; "negated" for lower-is-better values.
    Groups whose weights sum to zero have nulls."""
    total = F.sum(weight)
    mean = F.try_divide(F.sum(F.col(weight) * F.col(value)), total)
    quality = {"plain": mean, "mse": mse_to_db(mean), "negated": -mean}[axis]
    return df.groupBy(*keys).agg(F.try_divide(8 * F.sum(size), total).alias("rate"), quality.alias("quality"))


def pareto_frontier(df: DataFrame, keys: list[str], quality: str = "quality", rate: str = "rate") -> DataFrame:
    """keys, quality, rate of the points that are finite, of positive rate, undominated, and rise
    in rate with quality. Qualities within 1e-12 are one point, the one of the least rate."""
    p = df.select(*keys, F.col(quality).cast("double").alias("quality"), F.col(rate).cast("double").alias("rate"))
    p = p.where("not isnan(quality) and abs(quality) < double('Infinity') and rate > 0 and rate < double('Infinity')")
    # Of equal qualities only the least rate counts: summed before the windows, which see a row a quality.
    p = p.groupBy(*keys, "quality").agg(F.min("rate").alias("rate"))
    up = Window.partitionBy(*keys).orderBy("quality", "rate")
    p = p.withColumn("__new", F.coalesce((F.col("quality") - F.lag("quality").over(up) > TIE).cast("int"), F.lit(1)))
    p = p.withColumn("__spot", F.sum("__new").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.groupBy(*keys, "__spot").agg(F.min(F.struct("rate", "quality")).alias("__p")).select(*keys, "__p.quality", "__p.rate")
    before = (Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.col("quality").desc()).rowsBetween(*before)
    p = p.withColumn("__least", F.min("rate").over(down)).where("__least is null or rate < __least")
    up = Window.partitionBy(*keys).orderBy("quality").rowsBetween(*before)
    return p.withColumn("__most", F.max("rate").over(up)).where("__most is null or rate > __most").select(*keys, "quality", "rate")


def _segments(frontier: DataFrame, keys: list[str]) -> DataFrame:
    """Monotone cubic pieces of ln(rate) over quality: keys, x0, h and coefficients c0 to c3;
    curves of fewer than three points have none."""
    w = Window.partitionBy(*keys).orderBy("x")
    whole = Window.partitionBy(*keys)
    p = frontier.select(*keys, F.col("quality").alias("x"), F.ln("rate").alias("y"), F.count("*").over(whole).alias("n")).where("n >= 3")
    p = p.withColumns({"h": F.lead("x").over(w) - F.col("x"), "d": (F.lead("y").over(w) - F.col("y")) / (F.lead("x").over(w) - F.col("x"))})
    p = p.withColumns({"hp": F.lag("h").over(w), "dp": F.lag("d").over(w), "hn": F.lead("h").over(w), "dn": F.lead("d").over(w)})
    p = p.withColumns({"hpp": F.lag("h", 2).over(w), "dpp": F.lag("d", 2).over(w)})

    def end(h0: str, d0: str, h1: str, d1: str) -> str:
        m = f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
        return f"case when sign({m}) <> sign({d0}) then 0D when sign({d0}) <> sign({d1}) and abs({m}) > 3 * abs({d0}) then 3 * {d0} else {m} end"

    inner = "case when dp * d <= 0 then 0D else 3 * (hp + h) / ((2 * h + hp) / dp + (h + 2 * hp) / d) end"
    slope = f"case when hp is null then {end('h', 'd', 'hn', 'dn')} when h is null then {end('hp', 'dp', 'hpp', 'dpp')} else {inner} end"
    p = p.withColumn("m", F.expr(slope)).withColumn("m1", F.lead("m").over(w)).where("h is not null")
    return p.select(*keys, F.col("x").alias("x0"), "h", F.col("y").alias("c0"), F.col("m").alias("c1"), F.expr("(3 * d - 2 * m - m1) / h").alias("c2"), F.expr("(m + m1 - 2 * d) / (h * h)").alias("c3"))


def bd_rate(df: DataFrame, keys: list[str], curve: str, anchor, quality: str = "quality", rate: str = "rate") -> DataFrame:
    """keys, candidate, anchor, bd_rate_pct, low, high: the mean difference of ln(rate) of each
    curve against the anchor over their shared qualities, as a percentage; null where either has
    fewer than three frontier points or the overlap is 1e-9 or less. Negative: fewer bits."""
    front = pareto_frontier(df, [*keys, curve], quality, rate)
    span = front.groupBy(*keys, curve).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"), F.count("*").alias("n"))
    a = span.where(F.col(curve) == F.lit(anchor)).select(*keys, F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.col("n").alias("an"))
    pairs = df.select(*keys, curve).distinct().where(F.col(curve) != F.lit(anchor)).join(span, [*keys, curve], "left")
    pairs = pairs.join(a, keys, "left") if keys else pairs.crossJoin(F.broadcast(a))  # one row
    ok = "n >= 3 and an >= 3 and least(hi, ahi) - greatest(lo, alo) > 1e-9"
    pairs = pairs.withColumns({"low": F.expr(f"case when {ok} then greatest(lo, alo) end"), "high": F.expr(f"case when {ok} then least(hi, ahi) end")}).select(*keys, curve, "low", "high")
    seg = _segments(front, [*keys, curve])
    valid = pairs.where("low is not null")
    own = seg.join(valid, [*keys, curve])
    base = seg.where(F.col(curve) == F.lit(anchor)).drop(curve)
    other = base.join(valid, keys) if keys else base.crossJoin(valid)  # a few segments of one curve
    a_, b_ = "greatest(low, x0) - x0", "least(high, x0 + h) - x0"
    area = " + ".join(f"c{i} * (pow({b_}, {i + 1}) - pow({a_}, {i + 1})) / {i + 1}" for i in range(4))
    part = lambda t, s: t.where("x0 < high and x0 + h > low").select(*keys, curve, F.expr(f"{s} * ({area})").alias("v"))
    diff = part(own, 1).unionByName(part(other, -1)).groupBy(*keys, curve).agg(F.sum("v").alias("v"))
    return pairs.join(diff, [*keys, curve], "left").select(
        *keys, F.col(curve).alias("candidate"), F.lit(anchor).alias("anchor"),
        ((F.exp(F.col("v") / (F.col("high") - F.col("low"))) - 1) * 100).alias("bd_rate_pct"), "low", "high",
    )


def omission_sensitivity(df: DataFrame, keys: list[str], curve: str, point: str, omitted: list, anchor, **columns) -> DataFrame:
    """bd_rate() once for each omitted point, with the column omitted_point."""
    without = df.withColumn("omitted_point", F.explode(F.array(*map(F.lit, omitted)))).where(F.col(point) != F.col("omitted_point"))
    return bd_rate(without, [*keys, "omitted_point"], curve, anchor, **columns)
