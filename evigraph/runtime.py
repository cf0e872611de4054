"""Session helpers: the shared folder, written copies, and file listings that any Spark file system answers."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def session(name: str, master: str | None = None, settings: dict[str, str] | None = None) -> Iterator[SparkSession]:
    """A session with adaptive plans and times in UTC, stopped at the end unless it was there before."""
    before = SparkSession.getActiveSession()
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", **(settings or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    try:
        yield spark
    finally:
        if before is None:
            spark.stop()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset and all run on this machine a folder of this session."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.evigraph.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="evigraph-shared-")
        spark.conf.set("spark.evigraph.shared.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read it back.

    The copy survives the loss of any executor, unlike cached or locally
    checkpointed blocks.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written copies that are removed once nothing reads them any more."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(df.sparkSession, name)
        self.paths.append((df.sparkSession, path))
        df.write.option("compression", "zstd").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def clear(self, keep: int = 0) -> None:
        """Remove all copies but the last ``keep``."""
        while len(self.paths) > keep:
            remove(*self.paths.pop(0))


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
