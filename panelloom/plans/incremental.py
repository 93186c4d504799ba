"""A series from a folder of files that grows: only files that are new or changed are parsed.

A store holds the parsed rows, one partition for each version of a file, and a manifest of the versions in force. What a
full join of the files adds, the missing cells of places that a file lacks, depends on all files and is made when
the series is read, so that a changed file never makes another file's partition stale.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators.joins import broadcast_checked
from panelloom.plans.ingest import POSITION, long_of_rows, rows_of_files
from panelloom.sources.delimited import files_of, plain_path
from panelloom.sources.sinks import delete_folder

ROWS = "label string, _values array<double>, source string"
MANIFEST = "at int, source string, files array<string>, periods array<struct<year:int,month:string>>"


@dataclass(frozen=True)
class Refreshed:
    """Numbers of tables that were parsed, found unchanged, and taken out because they are gone or changed."""

    parsed: int
    unchanged: int
    removed: int


def _versions(spark: SparkSession, tables: Sequence[Sequence[str]], label: str) -> list[str]:
    """A name for each table's present state: its files' paths, lengths and times of change, and the label column."""
    plain = [plain_path(spark, f) for table in tables for f in table]
    if not plain:
        return []
    # Without the content column a listing of the files is all that is read. It leaves out empty files.
    listed = spark.read.format("binaryFile").load(plain)
    state = {
        r["path"]: (r["length"], r["changed"])
        for r in listed.select(F.col("_metadata.file_path").alias("path"), "length", F.unix_micros("modificationTime").alias("changed")).collect()
    }
    texts = ["\n".join([label, *(f"{f} {state.get(f)}" for f in sorted(table))]) for table in tables]
    return [hashlib.sha256(t.encode()).hexdigest()[:32] for t in texts]


def _matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a glob, sorted."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    return sorted(f.getPath().toString() for f in found)


def _manifests(spark: SparkSession, store: str) -> list[str]:
    """Finished manifests, oldest first."""
    return [f.removesuffix("/_SUCCESS") for f in _matching(spark, f"{store}/manifest/*/_SUCCESS")]


def _in_force(spark: SparkSession, store: str) -> list:
    finished = _manifests(spark, store)
    return sorted(spark.read.schema(MANIFEST).parquet(finished[-1]).collect()) if finished else []


def refresh(
    spark: SparkSession, path: str | Sequence[str], store: str, label: str = "município"
) -> Refreshed:
    """Bring a store up to the ``;`` files of a directory, or to the listed files.

    A file counts as changed if its length or time of change is another. New versions are parsed in one scan and written to
    partitions of their own; then a new manifest is written, and only then are partitions that it does not name deleted. A
    run that dies before the manifest leaves the old state in force, and a repeated one overwrites what it left. Files without
    a header are noted and give no row. One refresh of a store at a time; read a series anew after it.
    """
    tables = files_of(spark, path)
    versions = _versions(spark, tables, label)
    before = {r["source"]: r["periods"] for r in _in_force(spark, store)}
    todo = [(t, v) for t, v in zip(tables, versions, strict=True) if v not in before]
    periods = dict(before)
    periods.update({v: None for _, v in todo})
    if todo:
        rows, found, read = rows_of_files(spark, [t for t, _ in todo], label)
        names = {tuple(t): v for t, v in todo}
        sources = [names[tuple(t)] for t in read]
        periods.update(zip(sources, found, strict=True))
        layout = spark.createDataFrame(list(enumerate(sources)), "_file int, source string")
        rows = rows.drop(POSITION).join(broadcast_checked(layout), "_file")
        rows.select(F.col(label).alias("label"), "_values", "source").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("source").parquet(f"{store}/rows")
    gone = before.keys() - set(versions)
    if todo or gone or not before:
        old = _manifests(spark, store)
        number = int(old[-1].rsplit("/", 1)[1]) + 1 if old else 0
        listed = [(i, v, list(t), periods[v]) for i, (t, v) in enumerate(zip(tables, versions, strict=True))]
        spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest/{number:08d}")
        stored = _matching(spark, f"{store}/rows/source=*")
        for folder in [*old, *(f for f in stored if f.rsplit("=", 1)[1] not in versions)]:
            delete_folder(spark, folder)
    return Refreshed(len(todo), len(tables) - len(todo), len(gone))


def stored_series(
    spark: SparkSession, store: str, name: str, duplicates: str = "auto", place: str = "cod_mun"
) -> DataFrame:
    """``ingest_series`` of the files that the store was last refreshed with, from their parsed rows."""
    live = [r for r in _in_force(spark, store) if r["periods"] is not None]
    layout = spark.createDataFrame([(i, r["source"]) for i, r in enumerate(live)], "_file int, source string")
    if live:
        parsed = spark.read.schema(ROWS).parquet(f"{store}/rows")
    else:
        parsed = spark.createDataFrame([], ROWS)
    # Only partitions that the manifest names are read.
    rows = parsed.join(broadcast_checked(layout), "source").select("label", "_file", "_values")
    periods = [[(p["year"], p["month"]) for p in r["periods"]] for r in live]
    return long_of_rows(rows, periods, list, name, "label", duplicates, place, None)
