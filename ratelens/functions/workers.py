"""Lets Python workers import this package wherever the driver found it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Puts the package's folder on the path of workers that are started from now on; on a cluster
    the package is installed or sent with the job, and a folder that isn't there does no harm."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths and ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, *paths) if p)
