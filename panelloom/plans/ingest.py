"""From irregular files to long tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions.scalars import code_prefix, extract_first, number_columns, to_number
from panelloom.operators.filters import keep_known
from panelloom.operators.joins import broadcast_checked, fold_full, holds
from panelloom.operators.names import clean_names, drop_containing, lower_names
from panelloom.operators.reshape import pivot_longer_parsed
from panelloom.sources.delimited import files_of, plain_path, read_cells, read_delimited, read_with_preamble
from panelloom.sources.sinks import stage, write_csv, write_table


#: Column of ``read_delimited(position=...)`` from which ``series_long`` takes the order of the lines.
POSITION = "_position"


def _numeric(df: DataFrame, label: str) -> DataFrame:
    """Lower-case names, no totals columns, every column but the label (and the position) as a number."""
    table = drop_containing(lower_names(df), "total")
    kept = [c for c in table.columns if c in (label, POSITION)]
    return table.select(*kept, *number_columns(c for c in table.columns if c not in kept))


def year_in(name: str) -> int | None:
    """The first run of digits of a column name."""
    found = re.search("[0-9]+", name)
    return int(found[0]) if found else None


def month_in(name: str) -> str | None:
    """The first run of letters of a column name."""
    found = re.search("[a-zA-Z]+", name)
    return found[0] if found else None


PERIOD_NAMES = {"year": year_in, "month": month_in}


def _code(label: str) -> Column:
    """The place code in front of the label's name."""
    return to_number(extract_first(label, "[0-9]+")).cast("bigint")


def _with_code(df: DataFrame, label: str, place: str) -> DataFrame:
    """The code instead of the label, parsed once per place, not per cell."""
    return df.select(_code(label).alias(place), *[f"`{c}`" for c in df.columns if c != label])


def series_long(
    tables: list[DataFrame],
    name: str,
    label: str = "município",
    duplicates: str = "auto",
    place: str = "cod_mun",
    order: str | None = None,
) -> DataFrame:
    """Long table of one series from wide tables, one per file, keyed by the place label.

    As after a full join of the files on the label, a place absent from a file gets a
    missing cell for each of that file's periods. No wide table is built for it: the rows are
    stacked with their cells in arrays, and only the (label, file) pairs are grouped to find what is absent.
    A label that a file repeats multiplies its rows as that join does; ``duplicates="raise"`` fails the job instead.
    Totals columns go first, since every file repeats them.

    ``order`` names a column that sorts the rows as that join and the unpivoting would leave them: by the line of the place in
    the first file that has it, then by file and column. It needs tables with the column POSITION.
    """
    parts, periods = [], []
    for i, table in enumerate(tables):
        numeric = _numeric(table, label)
        cells = [c for c in numeric.columns if c not in (label, POSITION)]
        periods.append([(year_in(c), month_in(c)) for c in cells])
        values = F.array(*[F.col(f"`{c}`") for c in cells]).cast("array<double>")
        ids = [label, POSITION] if order else [label]
        parts.append(numeric.select(*ids, F.lit(i).alias("_file"), values.alias("_values")))
    rows = reduce(DataFrame.unionByName, parts)
    return long_of_rows(rows, periods, lambda: tables, name, label, duplicates, place, order)


def long_of_rows(
    rows: DataFrame,
    periods: list[list[tuple[int | None, str | None]]],
    tables: Callable[[], list[DataFrame]],
    name: str,
    label: str,
    duplicates: str,
    place: str,
    order: str | None,
) -> DataFrame:
    """``series_long`` from (label, _file, _values, POSITION): a row's cells in the order of its file's ``periods``."""
    spark, value = rows.sparkSession, f"vacc_{name}"
    rows = stage(keep_known(rows.withColumn(place, _code(label)), place), "rows")
    layout = spark.createDataFrame(
        list(enumerate(periods)), "_file int, _periods array<struct<year:int,month:string>>"
    )
    pairs = rows.groupBy(label, place, "_file").agg(F.count("*").alias("_n"))
    everywhere = F.sequence(F.lit(0), F.lit(len(periods) - 1))
    absent = pairs.groupBy(label, place).agg(F.collect_set("_file").alias("_files"))
    absent = absent.select(label, place, F.explode(F.array_except(everywhere, "_files")).alias("_file"))
    every = rows.drop(POSITION).unionByName(absent, allowMissingColumns=True)
    repeated = pairs.filter(F.col("_n") > 1)
    if not repeated.isEmpty():
        if duplicates == "raise":
            raise ValueError("series_long: a file repeats a place label")
        if order:
            return _long_of_joined(tables(), value, label, place, order)
        every = _multiplied(every, repeated, label)
    at = []
    if order:
        # Joined before the cells are taken apart; a label's first line is as many rows as labels, so never a broadcast.
        first = rows.groupBy(label).agg(F.min(F.struct("_file", POSITION)).alias("_first"))
        every, at = every.join(first.hint("merge"), label), ["_first"]
    cells = every.join(broadcast_checked(layout), "_file").select(
        label, place, "_file", "_values", *at, F.posexplode("_periods").alias("_column", "_p")
    )
    cell = F.element_at("_values", F.col("_column") + 1).alias(value)
    sorting = [F.struct("_first", "_file", "_column").alias(order)] if order else []
    return cells.select(cell, "_p.year", "_p.month", place, *sorting)


def _multiplied(rows: DataFrame, repeated: DataFrame, label: str) -> DataFrame:
    """Each row as often as a full join of the files on the label would give it.

    That is the product of the label's counts in the other files. Only labels that a file repeats are listed.
    """
    counts = F.collect_list("_n")
    listed = repeated.groupBy(label).agg(
        F.aggregate(counts, F.lit(1).cast("bigint"), lambda x, n: x * n).alias("_all"),
        F.map_from_entries(F.collect_list(F.struct("_file", "_n"))).alias("_own"),
    )
    own = F.coalesce(F.element_at("_own", F.col("_file")), F.lit(1).cast("bigint"))
    times = F.coalesce(F.expr("_all") / own, F.lit(1)).cast("bigint")
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), times))
    return rows.join(listed.hint("merge"), label, "left").withColumn("_copy", copies).select(*rows.columns)


def _long_of_joined(tables: list[DataFrame], value: str, label: str, place: str, order: str) -> DataFrame:
    """``series_long`` by full joins of the files, for the order of the rows when a file repeats a label.

    A joined row stands where its line of the first file does, then the second's; lines that a file lacks come last.
    """
    lines = [f"{POSITION}_{i}" for i in range(len(tables))]
    numeric = [_numeric(t, label).withColumnRenamed(POSITION, n) for t, n in zip(tables, lines, strict=True)]
    wide = fold_full(numeric, [label], "join")
    coded = keep_known(_with_code(wide, label, place), place)
    row = F.struct(*[x for n in lines for x in (F.col(n).isNull().alias(f"{n}_none"), F.col(n))])
    coded = coded.withColumn("_row", row).drop(*lines)
    at = {c: j for j, c in enumerate(c for c in coded.columns if c not in (place, "_row"))}
    long = pivot_longer_parsed(coded, [place, "_row"], {**PERIOD_NAMES, "_column": at.get}, value)
    return long.select(value, "year", "month", place, F.struct("_row", "_column").alias(order))


def _placed(header: list[str], label: str, file: str) -> tuple[int, list[int], list[tuple[int | None, str | None]]]:
    """Where the label stands in a header, and where its cells stand with their periods; totals are left out."""
    names = [c.replace("/", "", 1).lower() for c in header]
    if names.count(label) != 1:
        raise ValueError(f"{names.count(label)} columns {label} in {file}")
    cells = [i for i, c in enumerate(names) if c != label and "total" not in c]
    return names.index(label), cells, [(year_in(names[i]), month_in(names[i])) for i in cells]


def rows_of_files(
    spark: SparkSession, tables: Sequence[Sequence[str]], label: str
) -> tuple[DataFrame, list[list[tuple[int | None, str | None]]], list[Sequence[str]]]:
    """(label, POSITION, _file, _values) of all tables in one scan, the periods of each table's cells, and the tables.

    Tables without a header are left out; ``_file`` counts the others.
    """
    cells, headers = read_cells(spark, tables)
    read, places, periods = [], [], []
    for table, header in zip(tables, headers, strict=True):
        if header:
            at, values, when = _placed(header, label, table[0])
            places += [(f, len(read), part, at + 1, [i + 1 for i in values]) for part, f in enumerate(sorted(table))]
            periods.append(when)
            read.append(table)
    columns = [c for c in cells.columns if c.startswith("_c")]
    layout = spark.createDataFrame(places, "_path string, _file int, _part int, _label int, _cells array<int>")
    # The number of a table's part, not its path: every cell carries the position, and sorts send samples of it to the driver.
    position = F.struct("_part", "start", "row").alias(POSITION)
    texts, numbers = F.array(*columns), F.array(*number_columns(columns))
    rows = cells.select(F.col("file").alias("_path"), texts.alias("_texts"), numbers.alias("_numbers"), "start", "row")
    rows = rows.join(broadcast_checked(layout), "_path", "left")
    rows = rows.filter(holds(F.col("_file").isNotNull(), "rows_of_files: a file without a header")).select(
        F.element_at("_texts", F.col("_label")).alias(label),
        position,
        "_file",
        F.transform("_cells", lambda i: F.element_at("_numbers", i)).alias("_values"),
    )
    return rows, periods, read


def ingest_series(
    spark: SparkSession,
    name: str,
    path: str | Sequence[str],
    label: str = "município",
    duplicates: str = "auto",
    place: str = "cod_mun",
    order: str | None = None,
) -> DataFrame:
    """``series_long`` over the ``;`` files of a directory, or over the listed files, in one scan.

    The driver reads the headers; a table of them tells each row which of its columns are the label and the cells.
    """
    rows, periods, read = rows_of_files(spark, files_of(spark, path), label)
    if not order:
        rows = rows.drop(POSITION)

    def single() -> list[DataFrame]:
        return [read_delimited(spark, [plain_path(spark, f) for f in t], position=POSITION) for t in read]

    return long_of_rows(rows, periods, single, name, label, duplicates, place, order)


def ingest_all(
    spark: SparkSession,
    series: Mapping[str, str | Sequence[str]],
    output: str,
    fmt: str = "parquet",
    **options,
) -> None:
    """Run ``ingest_series`` for each (name, path) and write one table per series."""
    write = {"parquet": write_table, "csv": write_csv}[fmt]
    for name, path in series.items():
        write(ingest_series(spark, name, path, **options), f"{output}/{name}.{fmt}")


def annual_long(
    table: DataFrame, value: str = "vacc_cob_polio", label: str = "município", place: str = "cod_mun"
) -> DataFrame:
    """Annual doses by place from a wide table; a totals row stays, with a missing place."""
    coded = _with_code(_numeric(table, label), label, place)
    return pivot_longer_parsed(coded, [place], {"year": year_in}, value).select(value, "year", place)


def ingest_annual(spark: SparkSession, path: str, **options) -> DataFrame:
    return annual_long(read_delimited(spark, path), **options)


def denominator_long(
    table: DataFrame, label: str = "municipio", value: str = "pop", place: str = "cod_mun"
) -> DataFrame:
    """Population by year and place from a wide table with one column per year.

    Only lines whose label starts with a code are places; totals and notes below them go.
    """
    wide = clean_names(table)
    wide = wide.filter(F.col(label).rlike(r"^\s*[0-9]"))
    years = [c for c in wide.columns if c != label]
    numbers = wide.select(label, *number_columns(years))
    coded = _with_code(numbers, label, place)
    return pivot_longer_parsed(coded, [place], {"year": year_in}, value).select("year", place, value)


def ingest_denominator(
    spark: SparkSession, path: str, skip: int = 5, n_max: int | None = None, **options
) -> DataFrame:
    return denominator_long(read_with_preamble(spark, path, skip, n_max), **options)


def place_attributes(
    table: DataFrame, code: str = "id_municipio", digits: int = 6, place: str = "cod_mun"
) -> DataFrame:
    """Attribute table keyed by the shortened place code."""
    return table.withColumn(place, code_prefix(code, digits)).drop(code)
