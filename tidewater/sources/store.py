"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder, noted by the scopes that are open."""
    path = f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"
    for paths in _SCOPES:
        paths.append(path)
    return path


@contextmanager
def scope() -> Iterator[list[str]]:
    """Collects the paths of the tables written inside, in order, so that they can be discarded."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.remove(paths)


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete written tables; a DataFrame that still reads one of them cannot be computed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back, cutting its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
