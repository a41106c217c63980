"""Processor use between snapshots of a host's processes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cpu_rates(snapshots: DataFrame, keys: list[str], at: str = "at", pid: str = "pid", started: str = "started", ticks: str = "ticks", hz: float = 100.0) -> DataFrame:
    """keys, pid, at, cores: the ticks used since the snapshot before, in cores, never below zero. A
    process that wasn't there before, or started anew under its number, has no rate. `at` is in seconds."""
    w = Window.partitionBy(*keys, pid, started).orderBy(at)
    rate = (F.col(ticks) - F.lag(ticks).over(w)) / (F.lit(hz) * (F.col(at) - F.lag(at).over(w)))
    return snapshots.select(*keys, pid, at, F.greatest(F.lit(0.0), rate).alias("cores"), F.lag(at).over(w).alias("__before")).where("__before is not null").drop("__before")


def disturbances(rates: DataFrame, keys: list[str], at: str = "at", one: float = 0.5, all_: float = 1.0) -> DataFrame:
    """keys, at, busy (processes of at least `one` core), cores (of all) and disturbed."""
    g = rates.groupBy(*keys, at).agg(F.count_if(F.col("cores") >= one).alias("busy"), F.sum("cores").alias("cores"))
    return g.withColumn("disturbed", (F.col("busy") > 0) | (F.col("cores") >= all_))
