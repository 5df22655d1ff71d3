"""Session factory and the driver tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI semantics and adaptive execution; shuffle partitions are the cluster's to set."""
    builder = SparkSession.builder.appName("ledgerloom")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    return builder.config(map=settings | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; columns are pruned and filters pushed down by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_folders: dict[str, object] = {}


def _clean() -> None:
    """Removes this process's scratch tables; what the file system refuses stays."""
    for path, jvm in _folders.items():
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
        except Exception:  # noqa: BLE001 the JVM may be gone
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``); it is removed when the driver ends. A local
    master may do without that setting; on a cluster each executor would then write to a disk of its own."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints"
    own = f"{root}/ledgerloom/{context.applicationId}"
    if own not in _folders:
        if not _folders:
            atexit.register(_clean)
        _folders[own] = context._jvm
    return f"{own}/{name}-{uuid.uuid4().hex}"
