"""Scalar rules of the codec as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratelens.operators.blocks import LUMA, scaled_table

# Percent by adaptive level.
LEVEL_PERCENT = (90, 97, 108, 118)


def halves_up(n: Column, size: int) -> Column:
    """ceil(n / size) of positive integers."""
    return F.floor((n + size - 1) / size).cast("long")


def chroma_size(width: Column, height: Column, mode: Column) -> Column:
    """struct(cw, ch) for the modes 444, 422 and 420; null for others."""
    half = lambda v: halves_up(v, 2)
    return F.when(mode == 444, F.struct(width.cast("long").alias("cw"), height.cast("long").alias("ch"))).when(
        mode == 422, F.struct(half(width).alias("cw"), height.cast("long").alias("ch"))
    ).when(mode == 420, F.struct(half(width).alias("cw"), half(height).alias("ch")))


def filter_strength(quality: Column, plane: Column, level: Column) -> Column:
    """0 to 5 from quality 1 to 100, plane 0 to 2 and adaptive level 0 to 3; -1 outside."""
    base = F.floor((100 - quality + 19) / 20)
    s = F.when((level == 0) & (base > 1), base - 1).when(level == 3, base + 1).otherwise(base)
    s = F.when((plane != 0) & (s > 1), F.floor((s * 3 + 2) / 4)).otherwise(s)
    s = F.when(quality >= 96, 0).otherwise(F.least(s, F.lit(5)))
    bad = ~quality.between(1, 100) | ~plane.between(0, 2) | ~level.between(0, 3)
    return F.when(bad, -1).otherwise(s).cast("int")


def edge_threshold(quality: Column, level: Column) -> Column:
    percent = F.element_at(F.array(*map(F.lit, LEVEL_PERCENT)), level.cast("int") + 1)
    t = 3 + F.floor((100 - quality + 3) / 4)
    return F.greatest(F.lit(3), F.floor((t * percent + 50) / 100)).cast("int")


def quant_step(quality: Column, position: int = 0, base: list[int] = LUMA) -> Column:
    """The scaled table's entry at a position, by quality 1 to 100."""
    return F.element_at(F.array(*[F.lit(scaled_table(q, base)[position]) for q in range(1, 101)]), quality.cast("int"))


def intra_mode(packed: Column) -> Column:
    """struct(base, reference) of base + 10 * reference."""
    return F.struct((packed % 10).cast("int").alias("base"), F.floor(packed / 10).cast("int").alias("reference"))


def percentage(v: Column) -> Column:
    return F.coalesce(F.format_string("%+.2f%%", v), F.lit("N/A"))


def fnv1a(data: bytes, h: int = 14695981039346656037) -> int:
    """64-bit FNV-1a, unsigned; Catalyst's longs would overflow."""
    for b in data:
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h
