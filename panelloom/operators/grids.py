"""Parameter grids and literal calendars built by generators instead of cross joins."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def expand_years(df: DataFrame, first: Column | int, last: Column | int, alias: str = "year") -> DataFrame:
    """Repeat each row for every year of a closed range."""
    lo = first if isinstance(first, Column) else F.lit(first)
    hi = last if isinstance(last, Column) else F.lit(last)
    return df.withColumn(alias, F.explode(F.sequence(lo, hi)))


def year_state_grid(
    spark: SparkSession, years: Iterable[int], states: Sequence[str]
) -> DataFrame:
    """Every (year, state) pair of a parameter grid."""
    listed = sorted(set(years))
    base = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in states])).alias("state"))
    return base.select(F.explode(F.array(*[F.lit(y) for y in listed])).alias("year"), "state")


def event_dates(spark: SparkSession, dates: Sequence[dt.date], alias: str = "event_date") -> DataFrame:
    """A literal list of dates as a table; repeated dates stay repeated."""
    days = F.array(*[F.lit(d) for d in dates]).cast("array<date>")
    return spark.range(1).select(F.explode(days).alias(alias))
