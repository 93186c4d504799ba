"""Readers for the delimited file families a place x period panel is built from."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.functions.scalars import european_number, number_columns
from panelloom.operators.filters import text_after
from panelloom.operators.names import remove_from_names, set_names
from panelloom.sources.sinks import stage

LATIN1 = "ISO-8859-1"


def list_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> list[str]:
    """Files of a directory whose name fits a glob, sorted by name."""
    return sorted(spark.read.option("pathGlobFilter", pattern).text(path).inputFiles())


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ";",
    encoding: str = LATIN1,
    repair: Callable[[DataFrame], DataFrame] = remove_from_names,
    position: str | None = None,
) -> DataFrame:
    """One delimited file with a header, every column as text, header names repaired.

    Only the header line is read here; no pass over the data infers types. ``position`` names a column that sorts the
    rows as they stand in the file: (part, start of the split, row of the task). Its values are comparable within one
    run only, so store the table before it is read twice.
    """
    table = spark.read.csv(path, sep=sep, header=True, encoding=encoding, nullValue="NA")
    if position is None:
        return repair(table)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return repair(table.select("*", place.alias(position)))


def read_files(
    spark: SparkSession,
    paths: Sequence[str],
    sep: str = ";",
    encoding: str = LATIN1,
    position: str | None = None,
) -> list[DataFrame]:
    """One DataFrame per file, because the headers differ from file to file.

    Threads overlap the short jobs that fetch the header lines.
    """
    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(lambda p: read_delimited(spark, p, sep, encoding, position=position), paths))


def read_family(
    spark: SparkSession,
    path: str,
    pattern: str = "*.csv",
    sep: str = ";",
    encoding: str = LATIN1,
    position: str | None = None,
) -> list[DataFrame]:
    """``read_files`` over the files of a directory."""
    return read_files(spark, list_files(spark, path, pattern), sep, encoding, position)


def plain_path(spark: SparkSession, file: str) -> str:
    """A file's URI as a path that a reader takes: ``%20`` and the like decoded."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(file)).toString()


def first_lines(spark: SparkSession, files: Sequence[str], encoding: str = LATIN1) -> list[str]:
    """The first line that is not blank of every file, empty if there is none.

    The driver opens the files, eight at a time, and reads no further than that line; no job runs.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first(file: str) -> str:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(file))
        stream = path.getFileSystem(conf).open(path)
        codec = codecs.getCodec(path)
        if codec is not None:
            stream = codec.createInputStream(stream)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, encoding))
        try:
            line = reader.readLine()
            while line is not None and not line.strip():
                line = reader.readLine()
            return line or ""
        finally:
            reader.close()

    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(first, files))


def files_of(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.csv") -> list[list[str]]:
    """The files of each table: a table for each file of a directory, or for each listed path with all its files.

    Files are written as ``_metadata.file_path`` has them: URIs, without an empty host.
    """
    if isinstance(path, str):
        tables = [[f] for f in list_files(spark, path, pattern)]
    else:
        with ThreadPoolExecutor(8) as pool:
            tables = list(pool.map(lambda p: sorted(spark.read.text(p).inputFiles()), path))
    return [[re.sub(r"^(\w+):///", r"\1:/", f) for f in table] for table in tables]


def read_cells(
    spark: SparkSession,
    tables: Sequence[Sequence[str]],
    sep: str = ";",
    encoding: str = LATIN1,
    nulls: str = "NA",
) -> tuple[DataFrame, list[list[str]]]:
    """Tables of differing headers in one scan, and their headers: plan and jobs do not grow with the files.

    ``tables`` lists each table's files, as ``files_of`` does. Columns go by position, as text (``_c0``, ``_c1``, ... up to the widest header), next to ``file``, ``start`` (of the
    split) and ``row``, which together sort the rows as they stand, within one run. Headers are parsed by the quoting rules
    of the rows; an unnamed column is called ``_c`` and its number. The files of a table must share its header;
    a file without a line belongs to no table, and a table of such files has an empty header.
    """
    files = [f for table in tables for f in table]
    lines = dict(zip(files, first_lines(spark, files, encoding), strict=True))
    headers = []
    for table in tables:
        found = {lines[f] for f in table} - {""}
        if len(found) > 1:
            raise ValueError(f"{len(found)} different headers in {sorted(table)[0]} and the files beside it")
        names = next(csv.reader(found, delimiter=sep), [])
        headers.append([n if n and n != nulls else f"_c{i}" for i, n in enumerate(names)])
    schema = ", ".join(f"_c{i} STRING" for i in range(max(map(len, headers), default=0))) or "_c0 STRING"
    read = spark.read.schema(schema).option("header", True).option("sep", sep).option("nullValue", nulls)
    full = [plain_path(spark, f) for f in files if lines[f]]
    if not full:
        return spark.createDataFrame([], f"{schema}, file STRING, start BIGINT, row BIGINT"), headers
    scanned = read.option("encoding", encoding).csv(full).select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return scanned, headers


def read_handoff(spark: SparkSession, path: str, schema: str, pattern: str = "*.csv") -> DataFrame:
    """Comma-separated files with a header and NA for missing values, under a known schema."""
    return (
        spark.read.schema(schema)
        .option("pathGlobFilter", pattern)
        .csv(path, header=True, nullValue="NA", enforceSchema=False)
    )


def read_european(
    spark: SparkSession, path: str, names: Sequence[str], lower: str = "2015"
) -> DataFrame:
    """Annual table with decimal commas: positional names, years after ``lower``, numbers.

    Column 1 is the year as text (with a ``Total`` row), column 2 the measure;
    any further columns are dropped.
    """
    raw = spark.read.csv(path, sep=";", header=True, encoding=LATIN1)
    year, measure = names[:2]
    annual = text_after(set_names(raw, names).select(year, measure), year, lower)
    return annual.select(
        european_number(year).cast("int").alias(year), european_number(measure).alias(measure)
    )


def numbered_lines(spark: SparkSession, path: str, encoding: str = LATIN1) -> DataFrame:
    """Lines of one or more files (line, file, line_number from 1 in each file), counted in parallel.

    Each split numbers its own lines; the split sizes of a file are then summed to
    give every split its offset. The lines are stored with their split, because a
    second scan may cut the files elsewhere once executors have come or gone.
    """
    scanned = spark.read.text(path).select(
        F.decode(F.col("value").cast("binary"), encoding).alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
    )
    lines = stage(scanned, "lines")
    sizes = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    return lines.join(offsets, ["file", "split"]).select(
        "line", "file", (F.col("seq") - F.col("first") + F.col("offset") + 1).alias("line_number")
    )


def read_with_preamble(
    spark: SparkSession,
    path: str,
    skip: int,
    n_max: int | None = None,
    sep: str = ";",
    encoding: str = LATIN1,
) -> DataFrame:
    """Delimited files after ``skip`` lines each: the next line is the header, then ``n_max`` rows.

    The driver reads only the headers, which must be equal and are parsed by the same quoting
    rules as the rows. All columns are text.
    """
    numbered = numbered_lines(spark, path, encoding)
    headers = numbered.filter(F.col("line_number") == skip + 1).select("line").distinct().collect()
    if len(headers) != 1:
        raise ValueError(f"{len(headers)} different headers after {skip} lines of {path}")
    names = next(csv.reader([headers[0][0].rstrip("\r")], delimiter=sep))
    schema = ", ".join(f"_c{i} STRING" for i in range(len(names)))
    lines = numbered.filter(F.col("line_number") > skip + 1)
    if n_max is not None:
        lines = lines.filter(F.col("line_number") <= skip + 1 + n_max)
    cells = lines.select(F.from_csv("line", schema, {"sep": sep}).alias("r")).select("r.*")
    return cells.toDF(*names)


def guess_separator(
    spark: SparkSession,
    path: str,
    candidates: Sequence[str] = (",", "\t", "|", ";", ":", " "),
    sample: int = 100,
) -> str:
    """The candidate that splits the header, and most of the first ``sample`` lines like it.

    Separators inside quotes do not count. Of several candidates the one with most lines like the
    header wins, then the one with most fields. Raises if none splits the header, or
    if half of the lines or fewer agree with it.
    """
    lines = [re.sub(r'"[^"]*"', "", r[0]) for r in spark.read.text(path).take(sample) if r[0]]

    def score(sep: str) -> tuple[float, int]:
        fields = lines[0].count(sep)
        return (sum(line.count(sep) == fields for line in lines) / len(lines), fields) if fields else (0.0, 0)

    best = max(candidates, key=score) if lines else None
    if best is None or score(best)[0] <= 0.5:
        raise ValueError(f"no separator of {list(candidates)} fits the first lines of {path}")
    return best


def _by_name(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """The named columns as numbers, the others as they are, in file order."""
    numbers = dict(zip(numeric, number_columns(numeric)))
    return df.select(*[numbers.get(c, F.col(f"`{c}`")) for c in df.columns])


def read_detected(spark: SparkSession, path: str, numeric: Sequence[str]) -> DataFrame:
    """A delimited file whose separator is detected from its first lines.

    Columns are found by name, so further ones may stand anywhere; they stay text.
    """
    sep = guess_separator(spark, path)
    return _by_name(spark.read.csv(path, sep=sep, header=True, nullValue="NA"), numeric)


def read_events(
    spark: SparkSession, path: str, keys: Sequence[str] = ("year", "month_number")
) -> DataFrame:
    """Event table, kept as CSV or Parquet, with integer period keys."""
    if path.endswith(".csv"):
        events = _by_name(spark.read.csv(path, header=True, nullValue="NA"), keys)
    else:
        events = spark.read.parquet(path)
    return events.withColumns({k: F.col(k).cast("int") for k in keys})


def read_named_files(
    spark: SparkSession,
    path: str,
    schema: str,
    name_pattern: str = r"DN([A-Z]{2})([0-9]{4})",
    names: Sequence[str] = ("state", "year"),
    sep: str = ",",
) -> DataFrame:
    """All files below a directory in one scan; columns are also taken from the file path.

    The schema lists the columns in file order (a row-name column included). Group ``i`` of the pattern becomes column ``names[i]``, as text,
    or NULL if the path does not match.
    """
    rows = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(path, sep=sep, header=True, nullValue="NA")
    )
    source = F.col("_metadata.file_path")
    return rows.select(
        "*",
        *[
            F.when(source.rlike(name_pattern), F.regexp_extract(source, name_pattern, i + 1)).alias(n)
            for i, n in enumerate(names)
        ],
    )


def read_blank_header(
    spark: SparkSession,
    path: str,
    columns: int = 36,
    year_pattern: str = r"_([0-9]{4})(?:\.csv|/)",
) -> DataFrame:
    """Wide files without column names: a ``code - NAME`` label, then integer columns by position.

    The files share one layout, so they are one scan; the year is part of the path, NULL if it is not found.
    """
    fields = ["_c0 STRING", *[f"_c{i} INT" for i in range(1, columns + 1)]]
    rows = (
        spark.read.schema(", ".join(fields))
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(path, header=True)
    )
    year = F.regexp_extract(F.col("_metadata.file_path"), year_pattern, 1).try_cast("int")
    return rows.select("*", year.alias("year"))
