"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

ROOT = "clickweir.root"

# Settings that results or skew handling rely on. Partition counts and memory
# belong to the cluster and are left alone.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

def build_session(app_name: str = "clickweir", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> SparkSession:
    """Stream times are instants, table times are naive UTC; both agree only in a session whose zone is UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "+00:00", "Z"):
        raise RuntimeError(f"set spark.sql.session.timeZone to UTC, it is {zone}")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The storage root, a Hadoop path that every executor reaches: the cluster's ``spark.checkpoint.dir`` or, where
    that is unset, the caller's ``clickweir.root`` of the session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(ROOT, None)
    if not root:
        raise RuntimeError(f"set spark.checkpoint.dir, or {ROOT}, to a folder that every executor reaches")
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate, below a folder of this application's own."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediates. Results that are still to be read from them are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove intermediates that are read no more."""
    for text in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/clickweir/{spark.sparkContext.applicationId}"
