"""Row filters with NA rules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_members(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose value is in ``values``; missing values are dropped.

    An unbroken integer range becomes BETWEEN, which Parquet row groups can be
    skipped on.
    """
    listed = sorted(set(values))
    if listed and all(isinstance(v, int) for v in listed) and listed[-1] - listed[0] == len(listed) - 1:
        return df.filter(F.col(column).between(listed[0], listed[-1]))
    return df.filter(F.col(column).isin(*listed))


def keep_known(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN in the given (default: all) columns; Inf stays."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def text_after(df: DataFrame, column: str, lower: str, exclude: str = "Total") -> DataFrame:
    """Rows whose text sorts after ``lower`` and is not ``exclude``.

    The comparison is between strings, as for a year column that also holds a
    totals label; a numeric literal would make Spark cast the label and fail.
    """
    c = F.col(column)
    return df.filter((c > F.lit(lower)) & (c != F.lit(exclude)))


def keep_dates(
    df: DataFrame, column: str, first: dt.date | None, last: dt.date | None
) -> DataFrame:
    """Rows dated within the closed interval; an end left as None is open."""
    if first is not None:
        df = df.filter(F.col(column) >= F.lit(first))
    if last is not None:
        df = df.filter(F.col(column) <= F.lit(last))
    return df
