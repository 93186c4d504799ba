"""Plot-ready monthly series computed from the panel."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.aggregates import columns_with_prefix, sum_by
from panelloom.functions.scalars import label, month_start
from panelloom.functions.windows import running_sum
from panelloom.operators.filters import complete_cases, keep_dates, keep_members
from panelloom.operators.joins import broadcast_checked
from panelloom.plans.panel import add_coverage, add_goals

YEARS = range(2016, 2022)


def doses_by_month(
    panel: DataFrame, years: Iterable[int] = YEARS, prefix: str = "vacc"
) -> DataFrame:
    """Sums of every dose column per calendar month, with the year as a category."""
    kept = keep_members(panel, "year", years)
    sums = sum_by(kept, ["year", "month_number"], columns_with_prefix(kept, prefix))
    return sums.withColumn("Ano", F.col("year").cast("string")).withColumn(
        "vacc_total_k", F.col("vacc_total") / 1000
    )


def coverage_series(
    panel: DataFrame,
    years: Iterable[int] = YEARS,
    group: str | None = None,
    labels: Mapping[int, str] | None = None,
    label_column: str = "Votos",
) -> DataFrame:
    """Monthly and year-to-date coverage over all places, optionally split by a 0/1 attribute.

    Incomplete rows (population-only months, places without the attribute) are
    dropped at the end, so that running sums see them as the sums do.
    """
    extra = [group] if group else []
    kept = keep_members(panel, "year", years)
    sums = sum_by(kept, ["year", "time", "month_number", *extra], ["vacc_total", "pop"])
    running = running_sum("vacc_total", ["year", *extra], ["time"])
    series = add_coverage(add_goals(sums).withColumn("vacc_accum", running))
    if group:
        names = labels or {1: f"{group} = 1", 0: f"{group} = 0"}
        series = series.withColumn(label_column, label(group, names))
    return complete_cases(series).withColumn("date", month_start("year", "month_number"))


def annotate_events(
    series: DataFrame, events: DataFrame, date: str = "date", event_date: str = "event_date"
) -> DataFrame:
    """Attach to each month the number of events in it and their days."""
    marks = (
        events.groupBy(F.trunc(event_date, "month").alias(date))
        .agg(
            F.count("*").alias("n_events"),
            F.array_sort(F.collect_set(F.dayofmonth(event_date))).alias("_days"),
        )
        .select(date, "n_events", F.array_join(F.transform("_days", lambda d: d.cast("string")), ",").alias("event_days"))
    )
    return series.join(broadcast_checked(marks), date, "left").withColumn(
        "n_events", F.coalesce("n_events", F.lit(0))
    )


def mark_cutoff(series: DataFrame, cutoff: dt.date, alias: str = "after", date: str = "date") -> DataFrame:
    """Whether a month is at or after a cutoff date."""
    return series.withColumn(alias, (F.col(date) >= F.lit(cutoff)).cast("int"))


def event_window(
    series: DataFrame, events: DataFrame, first: dt.date, last: dt.date
) -> DataFrame:
    """Months of the interval with the events that fall inside it."""
    inside = keep_dates(events, "event_date", first, last)
    return annotate_events(keep_dates(series, "date", first, last), inside)


def percent(series: DataFrame, column: str) -> DataFrame:
    return series.withColumn(column, F.col(column) * 100)
