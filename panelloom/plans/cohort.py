"""Population of an age range by month, from births."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.windows import running_sum_blocked
from panelloom.operators.reshape import fill_grid
from panelloom.sources.sinks import stage


def cohort_population(
    births: DataFrame, by: Sequence[str], born: str, youngest: int, oldest: int, alias: str = "pop"
) -> DataFrame:
    """(by, year, month_number, alias): those ``youngest`` to ``oldest`` full months old, in every month of the births.

    A birth counts from the month it reaches the lower age to the month in which it is ``oldest`` months old. Births are
    counted by month of birth first; each count is then added in the month of entry and taken off in the month of
    exit, and a running sum gives the population, so that nothing grows with the age range. Months run from the
    first to the last birth of the table, for every group; births without a date are left out, a missing group is a group.
    """
    if not 0 <= youngest <= oldest:
        raise ValueError(f"ages {youngest} to {oldest}")
    month = F.year(born) * 12 + F.month(born) - 1
    counts = births.filter(F.col(born).isNotNull()).groupBy(*by, month.alias("_month")).agg(F.count("*").alias("_n"))
    counts = stage(counts, "births")
    first, last = counts.agg(F.min("_month"), F.max("_month")).first()
    steps = F.array(
        F.struct((F.col("_month") + youngest).alias("_month"), F.col("_n").alias("_change")),
        F.struct((F.col("_month") + oldest + 1).alias("_month"), (-F.col("_n")).alias("_change")),
    )
    changes = counts.select(*by, F.explode(steps).alias("_s")).select(*by, "_s.*")
    changes = changes.groupBy(*by, "_month").agg(F.sum("_change").alias("_change"))
    # A group has cells for all months, also if its births enter only after the last.
    levels = list(range(first, last + 1)) if first is not None else []
    groups = counts.select(*by).distinct().select(*by, F.lit(first).cast("int").alias("_month"), F.lit(0).cast("bigint").alias("_change"))
    changes = changes.filter(F.col("_month").between(first, last)) if levels else changes.limit(0)
    changes = changes.unionByName(groups).groupBy(*by, "_month").agg(F.sum("_change").alias("_change"))
    every = fill_grid(changes, by, "_month", F.array(*[F.lit(m) for m in levels]).cast("array<int>"), "_change")
    summed = running_sum_blocked(every.fillna(0, ["_change"]), "_change", alias, by, ["_month"])
    year, number = F.floor(F.col("_month") / 12).cast("int"), F.pmod("_month", F.lit(12)) + 1
    return summed.select(*by, year.alias("year"), number.cast("int").alias("month_number"), alias)
