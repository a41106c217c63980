"""Block operators on arrays: colour, transforms, quantisation, sampling, activity.

Expressions use higher-order functions over constant index tables, so they stay in the JVM; the
grid operators are group-bys and lags over (row, column)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# The base luma table of the image standard, in row order.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
# The base chroma table of the image standard, in row order: its upper left corner, 99 elsewhere.
CHROMA = [{(0, 0): 17, (0, 1): 18, (0, 2): 24, (0, 3): 47, (1, 0): 18, (1, 1): 21, (1, 2): 26, (1, 3): 66, (2, 0): 24, (2, 1): 26, (2, 2): 56, (3, 0): 47, (3, 1): 66}.get((r, c), 99) for r in range(8) for c in range(8)]


def zigzag(size: int = 8) -> list[int]:
    """Row-order index of each zig-zag position."""
    cells = [(r, c) for r in range(size) for c in range(size)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return [r * size + c for r, c in cells]


def _q16(x: float) -> int:
    return int(x * 65536 + 0.5)


# Luma and chroma weights of R, G and B.
WEIGHTS = ((0.299, 0.587, 0.114), (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312))


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> Column:
    """struct(y, cb, cr) of 8-bit samples in 16-bit fixed point, rounded and clamped."""
    out = []
    for name, w in zip(("y", "cb", "cr"), WEIGHTS):
        k = [_q16(abs(x)) * (1 if x >= 0 else -1) for x in w]
        offset = 32768 + (0 if name == "y" else 128 << 16)
        v = F.shiftright((r * k[0] + g * k[1] + b * k[2] + offset).cast("long"), 16)
        out.append(F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int").alias(name))
    return F.struct(*out)


def round_div(v: Column, d: int) -> Column:
    """Integer division that rounds halves away from zero."""
    return F.when(v < 0, -F.floor((-v + d // 2) / d)).otherwise(F.floor((v + d // 2) / d))


def scaled_table(quality: int, base: list[int] = LUMA) -> list[int]:
    f = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [max(1, min(255, (b * f + 50) // 100)) for b in base]


def _array(values: list) -> Column:
    return F.array(*map(F.lit, values))


def dct8(block: str) -> Column:
    """64 samples in row order -> orthonormal DCT-II coefficients in row order."""
    m = [[(math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]
    flat = ", ".join(f"{v!r}D" for row in m for v in row)
    # The block is bound once: Spark would paste its expression into each of its uses.
    rows = f"transform(sequence(0, 63), i -> aggregate(sequence(0, 7), 0D, (a, x) -> a + array({flat})[(i % 8) * 8 + x] * s[(i div 8) * 8 + x]))"
    both = f"transform(array({rows}), t -> transform(sequence(0, 63), i -> aggregate(sequence(0, 7), 0D, (a, y) -> a + array({flat})[(i div 8) * 8 + y] * t[y * 8 + i % 8])))[0]"
    return F.expr(f"transform(array({block}), s -> {both})[0]")


def hadamard(block: str, size: int = 8) -> Column:
    """size * size values in row order -> both-way Walsh-Hadamard transform, in row order."""
    n = size * size
    steps = ", ".join(str(1 << i) for i in range(n.bit_length() - 1))
    # Butterflies: sums and differences of places that differ in one bit of the row or column.
    turn = f"transform(sequence(0, {n - 1}), i -> if(i & k = 0, t[i] + t[i | k], t[i ^ k] - t[i]))"
    return F.expr(f"aggregate(array({steps}), cast({block} as array<bigint>), (t, k) -> {turn})")


def satd(block: str, size: int = 8) -> Column:
    return F.aggregate(F.transform(hadamard(block, size), F.abs), F.lit(0).cast("long"), lambda a, x: a + x)


def quantise(coefficients: str, table: list[int]) -> Column:
    """Integer coefficients in row order -> levels in zig-zag order, magnitudes rounded half up."""
    order, steps = _array(zigzag()), _array(table)
    level = lambda c, s: F.when(c < 0, -F.floor((-c + F.floor(s / 2)) / s)).otherwise(F.floor((c + F.floor(s / 2)) / s)).cast("int")
    return F.transform(order, lambda i: level(F.get(coefficients, i), F.get(steps, i)))


def nonzero_mask(levels: str) -> Column:
    """Bit p is set if position p isn't zero."""
    return F.expr(f"aggregate(transform({levels}, (x, p) -> if(x <> 0, shiftleft(1L, p), 0L)), 0L, (a, b) -> a | b)")


def downsample(grid: DataFrame, keys: list[str], row: str, column: str, value: str, width: int | Column, height: int | Column) -> DataFrame:
    """keys, row, column, value: rounded means of 2 x 2 cells; the last row or column counts twice
    where the size (a number, or a column of keys) is odd. Weights do the clamping, so it is one
    group-by."""
    def twice(c: str, n) -> Column:
        n = n if isinstance(n, Column) else F.lit(n)
        return F.when((F.col(c) == n - 1) & (n % 2 == 1), 2).otherwise(1)

    w = twice(column, width) * twice(row, height)
    g = grid.groupBy(*keys, F.expr(f"{row} div 2").alias("r2"), F.expr(f"{column} div 2").alias("c2")).agg(F.sum(F.col(value) * w).alias("s"), F.sum(w).alias("n"))
    return g.select(*keys, F.col("r2").alias(row), F.col("c2").alias(column), F.expr("(s + n div 2) div n").alias(value))


def upsample_row(grid: DataFrame, keys: list[str], row: str, column: str, value: str) -> DataFrame:
    """Each sample as two, weighted 3:1 with the nearer neighbour (the border repeats), times 4."""
    w = Window.partitionBy(*keys, row).orderBy(column)
    v = F.col(value)
    g = grid.withColumns({"__a": F.coalesce(F.lag(v).over(w), v), "__b": F.coalesce(F.lead(v).over(w), v)})
    pair = F.array(F.struct((F.col(column) * 2).alias(column), (3 * v + F.col("__a")).alias(value)), F.struct((F.col(column) * 2 + 1).alias(column), (3 * v + F.col("__b")).alias(value)))
    return g.select(*keys, row, F.explode(pair).alias("p")).select(*keys, row, f"p.{column}", f"p.{value}")


def activity(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, score, level: mean clipped second difference (at most 32) in 1/256, rounded, and its
    class: below 2, 8, 18 and from there."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = F.col(value) - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w)
    p = df.select(*keys, F.abs(d).alias("m")).withColumn("m", F.when(F.col("m") > 32, 32).otherwise(F.col("m")))
    s = p.groupBy(*keys).agg(F.sum("m").alias("s"), F.count("m").alias("n"))
    score = F.expr("case when n = 0 then 0 else cast((s * 256 + n div 2) div n as bigint) end")
    level = F.when(F.col("score") < 512, 0).when(F.col("score") < 2048, 1).when(F.col("score") < 4608, 2).otherwise(3)
    return s.select(*keys, score.alias("score")).withColumn("level", level)


def segments(df: DataFrame, keys: list[str], item: str, score: str) -> DataFrame:
    """keys, item, level, centre: four levels by rounded one-dimensional means, one group a task. A
    group is one image's regions; groups beyond memory belong to pre-aggregated scores."""
    from ratelens.functions.models import quantile_clusters

    def run(pdf):
        pdf = pdf.sort_values([score, item])
        centres, levels = quantile_clusters(pdf[score].astype(int).tolist())
        return pdf[[*keys, item]].assign(level=levels, centre=[centres[i] for i in levels])

    picked = df.select(*keys, item, F.col(score).cast("long").alias(score))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema if f.name != score)
    return picked.groupBy(*keys).applyInPandas(run, f"{schema}, level int, centre long")


def smooth(grid: DataFrame, keys: list[str], row: str, column: str, value: str, weight: int = 36) -> DataFrame:
    """keys, row, column, value moved towards the mean of the 3 x 3 cells around it, by 9 / weight of
    the way, rounded to the nearest (halves up); the border repeats. Two pairs of lags; sums of three
    in a row are taken first."""
    across = Window.partitionBy(*keys, row).orderBy(column)
    down = Window.partitionBy(*keys, column).orderBy(row)
    v = F.col(value)
    g = grid.withColumn("__h", F.coalesce(F.lag(v).over(across), v) + v + F.coalesce(F.lead(v).over(across), v))
    h = F.col("__h")
    delta = F.coalesce(F.lag(h).over(down), h) + h + F.coalesce(F.lead(h).over(down), h) - 9 * v
    return g.select(*keys, row, column, (v + F.floor((delta + weight // 2) / F.lit(weight))).cast("long").alias(value))


def errors(df: DataFrame, keys: list[str], reference: str, got: str) -> DataFrame:
    """keys, n, sse, mse and psnr_db (null where nothing differs) of values held against a reference."""
    d = (F.col(reference) - F.col(got)).cast("double")
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(d * d).alias("sse"))
    mse = F.col("sse") / F.col("n")
    return g.withColumn("mse", mse).withColumn("psnr_db", F.when(mse > 0, 10 * F.log10(F.lit(65025.0) / mse)))
