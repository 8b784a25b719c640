"""Session factory for tests, benchmarks and scripts; on a cluster the caller brings its own session."""

import os
from pathlib import Path

from pyspark.sql import SparkSession


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers that share this file system import the package; elsewhere it is shipped with --py-files."""
    here, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *paths])
    return spark


def local_session(cpus: int | None = None, name: str = "stratoplane", **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC and as many shuffle partitions as cores."""
    n = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{n}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(max(4, n)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STRATOPLANE_DRIVER_MEMORY", "6g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return with_package(spark)
