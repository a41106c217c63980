"""Symbol statistics and ordered tokens: histograms, model normalisation, costs, deltas, runs and
contexts. All in windows and group-bys over the caller's keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 4096


def category(v: Column) -> Column:
    """Bits of the magnitude: 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v).cast("long"))))


def amplitude(v: Column) -> Column:
    """The value within its category; negatives in one's complement."""
    return F.when(v < 0, v + F.pow(F.lit(2), category(v)).cast("long") - 1).otherwise(v).cast("long")


def histogram(df: DataFrame, model: str, symbol: str, models: list) -> DataFrame:
    """model, symbol, n; a model of `models` without a symbol has the placeholder symbol 0, once."""
    n = df.groupBy(F.col(model).alias("model"), F.col(symbol).alias("symbol")).agg(F.count("*").alias("n"))
    domain = df.sparkSession.createDataFrame([(m,) for m in models], "model string")
    return F.broadcast(domain).join(n, "model", "left").select("model", F.coalesce("symbol", F.lit(0)).alias("symbol"), F.coalesce("n", F.lit(1)).alias("n"))


def normalise(counts: DataFrame, keys: list[str], symbol: str = "symbol", n: str = "n", scale: int = SCALE) -> DataFrame:
    """keys, symbol, n, freq, cum: frequencies of sum `scale`, at least 1 for a used symbol, by the
    largest remainder, ties to the lower symbol; cum is what precedes in symbol order. Models whose
    floors and ones already exceed the scale are balanced by normalise_counts() per group."""
    from ratelens.functions.models import normalise_counts

    whole = Window.partitionBy(*keys)
    c = counts.where(F.col(n) > 0).select(*keys, F.col(symbol).cast("int").alias("symbol"), F.col(n).cast("long").alias("n"))
    c = c.withColumn("total", F.sum("n").over(whole)).withColumn("base", F.greatest(F.lit(1), F.expr(f"n * {scale} div total")).cast("long"))
    c = c.withColumns({"short": F.lit(scale) - F.sum("base").over(whole), "score": F.col("n") * scale - F.col("base") * F.col("total")})
    c = c.withColumn("place", F.row_number().over(whole.orderBy(F.col("score").desc(), "symbol")))
    easy = c.where("short >= 0").select(*keys, "symbol", "n", (F.col("base") + (F.col("place") <= F.col("short")).cast("long")).alias("freq"))
    hard = c.where("short < 0").select(*keys, "symbol", "n")

    def run(pdf):
        pdf = pdf.sort_values("symbol")
        return pdf.assign(freq=normalise_counts(pdf["n"].tolist(), scale))

    out = easy.unionByName(hard.groupBy(*keys).applyInPandas(run, easy.schema))
    before = whole.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("cum", F.coalesce(F.sum("freq").over(before), F.lit(0)))


def cost_table(counts: DataFrame, keys: list[str], symbol: str = "symbol", n: str = "n") -> DataFrame:
    """keys, symbol, bits: -log2((n + 0.25) / (N + 0.25 K)) over a model's K symbols."""
    w = Window.partitionBy(*keys)
    p = (F.col(n) + 0.25) / (F.sum(n).over(w) + 0.25 * F.count("*").over(w))
    return counts.select(*keys, F.col(symbol), (-F.log2(p)).alias("bits"))


def differences(df: DataFrame, keys: list[str], order: list[str], value: str, span: Column | None = None) -> DataFrame:
    """df with delta to the previous value (the first: to 0), its bits and amplitude. With a span, a
    column that never falls in the order, each of a key's spans is a task of its own: what the span
    before ends with is carried over from one row a span."""
    if span is None:
        before = F.lag(value, 1, 0).over(Window.partitionBy(*keys).orderBy(*order))
        d = df.withColumn("delta", F.col(value) - before)
    else:
        own = df.withColumn("__span", span)
        last = own.groupBy(*keys, "__span").agg(F.max_by(value, F.struct(*order)).alias("__last"))
        carried = F.lag("__last", 1, 0).over(Window.partitionBy(*keys).orderBy("__span"))
        last = last.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*keys, "__span"])], carried.alias("__carried"))
        met = own.join(last, [own[c].eqNullSafe(last[f"__k{i}"]) for i, c in enumerate([*keys, "__span"])])
        inside = F.lag(value).over(Window.partitionBy(*keys, "__span").orderBy(*order))
        first = F.row_number().over(Window.partitionBy(*keys, "__span").orderBy(*order)) == 1
        d = met.select(*df.columns, (F.col(value) - F.when(first, F.col("__carried")).otherwise(inside)).alias("delta"))
    return d.withColumns({"bits": category(F.col("delta")), "amp": amplitude(F.col("delta"))})


def zero_run_tokens(df: DataFrame, keys: list[str], pos: str, value: str, length: int = 64) -> DataFrame:
    """keys, pos, sub, symbol, bits, amp: for each nonzero value at positions 1 to length - 1 as many
    0xF0 (sixteen zeros) as its run holds, then (run % 16) << 4 | bits; a 0 ends a block that doesn't
    end in a nonzero value. Sorted by (pos, sub) the tokens are the block's stream."""
    nz = df.where((F.col(value) != 0) & (F.col(pos) > 0)).select(*keys, F.col(pos).cast("int").alias("pos"), F.col(value).cast("long").alias("v"))
    nz = nz.withColumn("run", F.col("pos") - F.coalesce(F.lag("pos").over(Window.partitionBy(*keys).orderBy("pos")), F.lit(0)) - 1)
    value_tokens = nz.select(*keys, "pos", F.expr("run div 16").cast("int").alias("sub"), ((F.col("run") % 16) * 16 + category(F.col("v"))).cast("int").alias("symbol"), category(F.col("v")).cast("int").alias("bits"), amplitude(F.col("v")).alias("amp"))
    zeros = nz.where("run > 15").select(*keys, "pos", F.explode(F.expr("sequence(0, cast(run div 16 as int) - 1)")).alias("sub"), F.lit(0xF0).alias("symbol"), F.lit(0).alias("bits"), F.lit(0).cast("long").alias("amp"))
    last = df.groupBy(*keys).agg(F.max(F.when((F.col(value) != 0) & (F.col(pos) > 0), F.col(pos))).alias("last"))
    ends = last.where(f"last is null or last < {length - 1}").select(*keys, F.lit(length).alias("pos"), F.lit(0).alias("sub"), F.lit(0).alias("symbol"), F.lit(0).alias("bits"), F.lit(0).cast("long").alias("amp"))
    return value_tokens.union(zeros).union(ends)


def predicted_map(df: DataFrame, keys: list[str], row: str, column: str, level: str, initial: int, levels: int) -> DataFrame:
    """df with delta: the level less that of the left neighbour, else the top one, else the initial
    one, modulo the number of levels. The scan back is sequential; encoding is two lags."""
    left = F.lag(level).over(Window.partitionBy(*keys, row).orderBy(column))
    top = F.lag(level).over(Window.partitionBy(*keys, column).orderBy(row))
    return df.withColumn("delta", F.pmod(F.col(level) - F.coalesce(left, top, F.lit(initial)), F.lit(levels)))


def restored_map(df: DataFrame, keys: list[str], row: str, column: str, delta: str, initial: int, levels: int) -> DataFrame:
    """df with level, what predicted_map() took the delta of, for maps without holes: the scan goes down
    the first column and then along each row, so it is two running sums."""
    along = Window.partitionBy(*keys, row).orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = df.groupBy(*keys, row).agg(F.min_by(delta, column).alias("__first"))
    down = Window.partitionBy(*keys).orderBy(row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.select(*keys, row, (F.sum("__first").over(down) - F.col("__first")).alias("__top"))  # one row a map row
    level = F.pmod(F.lit(initial) + F.col("__top") + F.sum(delta).over(along), F.lit(levels))
    return df.join(ends, [*keys, row]).withColumn("level", level).drop("__top")


def mode_switches(df: DataFrame, keys: list[str], row: str, column: str, flag: str) -> DataFrame:
    """df with delta of a map of bits: the bit XOR that of the left neighbour, else the top one, else 0."""
    left = F.lag(flag).over(Window.partitionBy(*keys, row).orderBy(column))
    top = F.lag(flag).over(Window.partitionBy(*keys, column).orderBy(row))
    return df.withColumn("delta", F.col(flag).bitwiseXOR(F.coalesce(left, top, F.lit(0))))


def adaptive_choice(df: DataFrame, keys: list[str], order: list[str], symbol: str, symbols: int) -> DataFrame:
    """keys, n, fixed_bits, adaptive_bits and adaptive: what each model's symbols cost under its final
    frequencies and under counts of what came before (each symbol begins with one), and whether
    adapting saves over a bit, lest noise decide."""
    whole, seen = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(*order)
    own = Window.partitionBy(*keys, symbol)
    d = df.select(
        *keys, (F.count("*").over(own) / F.count("*").over(whole)).alias("__f"),
        (F.row_number().over(own.orderBy(*order)) / (F.row_number().over(seen) - 1 + symbols)).alias("__a"),
    )
    c = d.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(-F.log2("__f")).alias("fixed_bits"), F.sum(-F.log2("__a")).alias("adaptive_bits"))
    return c.withColumn("adaptive", (F.col("n") > 1) & (F.col("adaptive_bits") + 1 < F.col("fixed_bits")))


def contexts(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """zero_run_tokens() with band (of the position at which the token's run begins: from 6, 15, 28), active
    (previous category 3 or more; 0xF0 resets it) and model (band * 2 + active)."""
    w = Window.partitionBy(*keys).orderBy("pos", "sub")
    t = tokens.withColumn("__prev_pos", F.lag("pos", 1, 0).over(w)).withColumn("__from", F.max(F.when(F.col("sub") == 0, F.col("__prev_pos") + 1)).over(Window.partitionBy(*keys, "pos")))
    t = t.withColumn("at", F.col("__from") + 16 * F.col("sub"))
    t = t.withColumn("active", (F.coalesce(F.lag("bits").over(w), F.lit(0)) >= 3).cast("int"))
    band = (F.col("at") >= 6).cast("int") + (F.col("at") >= 15).cast("int") + (F.col("at") >= 28).cast("int")
    return t.withColumn("band", band).withColumn("model", F.col("band") * 2 + F.col("active")).drop("__prev_pos", "__from")
