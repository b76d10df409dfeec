"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_SCOPE: ContextVar[str] = ContextVar("scope", default="")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder with a local master that has none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside have no generated method beyond 8,000 bytes, which the JVM would leave to its interpreter."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quarry/{_SCOPE.get()}{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, spares a second computation, and survives the loss of executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it, in any store that Spark writes."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def purge(spark: SparkSession) -> None:
    """Delete every stashed table of this shared folder. Call it when no result that reads one is still needed."""
    delete(spark, f"{shared_dir(spark)}/quarry")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stashed inside are deleted at the end: write or collect results before. Scopes may lie in each other."""
    before = _SCOPE.get()
    token = _SCOPE.set(f"{before}scratch-{uuid.uuid4().hex}/")
    try:
        yield
    finally:
        path = f"{shared_dir(spark)}/quarry/{_SCOPE.get()}"
        _SCOPE.reset(token)
        delete(spark, path)
