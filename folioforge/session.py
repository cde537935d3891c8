"""Spark session with the settings the library's results depend on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> SparkSession:
    """Tell local Python workers where this package lies; a cluster gets it with --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in (have := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, have)))
    return spark


def scratch(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share. Only a local master may do without that setting: it gets a temporary folder that goes with the process."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(scratch, "own", None)
        if base is None:
            base = scratch.own = tempfile.mkdtemp(prefix="folioforge-")
            atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/folioforge-{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks: UTC, adaptive execution, few shuffle partitions."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("folioforge")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())
