"""Writers, and tables staged between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="panelloom-")


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: the session's ``spark.checkpoint.dir``.

    A temporary folder stands in only on a local master that sets none; on a
    cluster a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def _session_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark).rstrip('/')}/panelloom/{spark.sparkContext.applicationId}"


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged inside the block when it ends."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            delete_folder(spark, path)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table to shared Parquet and read it back.

    Cuts the lineage, so that a costly input is computed once although several
    later branches read it, and lost executors do not bring the recomputation back.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete this session's staged tables; DataFrames read from them end with it."""
    delete_folder(spark, _session_folder(spark))


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Comma-separated with a header, NA for missing values and no row-name column."""
    df.write.mode(mode).csv(path, header=True, nullValue="NA")


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """One folder per value of ``by``.

    The rebalance hint brings a folder's rows together, to avoid many small files,
    and lets AQE split a folder that holds a large share of the rows.
    """
    out = df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).format(fmt)
    if fmt == "csv":
        out = out.option("header", True).option("nullValue", "NA")
    out.save(path)
