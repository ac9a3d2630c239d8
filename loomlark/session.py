"""Spark session settings and shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def session(app: str = "loomlark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; sizes are left to the cluster's own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per context; nothing to do where PYTHONPATH names it."""
    context = spark.sparkContext
    here = str(ROOT.parent)
    if getattr(context, "_loomlark_shipped", False) or here in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="loomlark-"), "loomlark_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    context.addPyFile(path)
    context._loomlark_shipped = True


def spread(scan: DataFrame) -> DataFrame:
    """A scanned table for work that is heavy per row, dealt over the cluster's cores where it has files for a quarter of them at most and
    splits for no more than all: a file of one row group is one task's work, however many splits Spark makes of it. A table of many files or
    splits passes unchanged, so at scale nothing is shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() <= cores and 4 * len(scan.inputFiles()) <= cores else scan
