"""Parquet tables of a directory, and where jobs may put their intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[tuple[str, SparkSession]] = set()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``; columns and filters reach the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (a local test) a temporary folder is made.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new folder for an intermediate table, under one folder per application, which goes when the program ends.

    A program that is killed leaves it behind, under its application's id.
    """
    root = f"{shared_folder(spark)}/loomline-{spark.sparkContext.applicationId}"
    if not any(path == root for path, _ in _made):
        _made.add((root, spark))
    return f"{root}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(path: str, spark: SparkSession) -> None:
    """Delete a folder on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    for path, spark in _made:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            discard(path, spark)
