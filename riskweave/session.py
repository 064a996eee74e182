"""Session with the settings that the operators expect."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "riskweave", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins and coalesced partitions; ``conf`` with dots as double underscores."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, wherever they were started."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def checkpointed(spark: SparkSession) -> SparkSession:
    """The session with a checkpoint folder: that of ``spark.checkpoint.dir``; only where none is set and all runs on
    one machine, as in tests, a temporary one."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="riskweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return spark
