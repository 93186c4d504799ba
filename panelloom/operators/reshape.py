"""Sorting, wide to long, and filling a long table out to its full grid."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.windows import nulls_last
from panelloom.operators.joins import holds


def arrange(df: DataFrame, *columns: str) -> DataFrame:
    """Ascending sort on several keys, missing values last (Spark puts them first)."""
    return df.orderBy(*nulls_last(columns))


def pivot_longer(
    df: DataFrame, ids: Sequence[str], names_to: str, values_to: str, value_type: str = "double"
) -> DataFrame:
    """Turn every column but ``ids`` into (name, value) rows; missing cells are kept."""
    values = [c for c in df.columns if c not in ids]
    cast = df.select(*ids, *[F.col(f"`{c}`").cast(value_type).alias(c) for c in values])
    return cast.unpivot(list(ids), values, names_to, values_to)


def pivot_longer_parsed(
    df: DataFrame,
    ids: Sequence[str],
    parse: Mapping[str, Callable[[str], object]],
    values_to: str,
) -> DataFrame:
    """``pivot_longer`` with the column names already taken apart.

    Each ``parse`` function turns a column name into a literal on the driver, so
    no regular expression runs per cell. The value columns must have one type.
    """
    values = [c for c in df.columns if c not in ids]
    cells = [
        part for c in values for part in (*[F.lit(f(c)) for f in parse.values()], F.col(f"`{c}`"))
    ]
    return df.select(*ids, F.stack(F.lit(len(values)), *cells).alias(*parse, values_to))


def fill_grid(
    long: DataFrame, by: Sequence[str], column: str, levels: Column | Sequence, value: str
) -> DataFrame:
    """Every (``by``, level) combination, with NULL where the long table has no row.

    ``levels`` is the list of period labels, or an array column such as a scalar
    subquery. The missing cells are generated from the distinct keys and merged
    by one aggregate; a repeated cell fails the job.
    """
    if not isinstance(levels, Column):
        levels = F.array(*[F.lit(v) for v in levels])
    kind = long.schema[value].dataType
    empty = (
        long.select(*by)
        .distinct()
        .select(*by, F.explode(levels).alias(column), F.lit(None).cast(kind).alias(value), F.lit(0).alias("_n"))
    )
    cells = long.select(*by, column, value, F.lit(1).alias("_n")).unionByName(empty)
    return (
        cells.groupBy(*by, column)
        .agg(F.max(value).alias(value), F.sum("_n").alias("_n"))
        .filter(holds(F.col("_n") <= 1, "fill_grid: a cell is repeated"))
        .drop("_n")
    )
