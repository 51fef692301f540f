"""Spark session settings for local work."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def local_session(name: str = "codegrove", cores: str | None = None, memory: str = "6g") -> SparkSession:
    """A local session; on a cluster the session is the caller's own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine serves a local session; on a cluster it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codegrove-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def local_path(spark: SparkSession, path: str) -> str | None:
    """A path as the machine's own file system names it, or None where another file system holds it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    scheme = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    return there.toUri().getPath() if scheme == "file" else None
