"""Running totals and the dense calendar index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.sources.sinks import stage


def nulls_last(columns: Sequence[str]) -> list[Column]:
    """Ascending sort keys with missing values at the end."""
    return [F.asc_nulls_last(c) for c in columns]


def running_sum(value: str, by: Sequence[str], order_by: Sequence[str]) -> Column:
    """Running sum that stays missing from the first missing value on.

    A ROWS frame keeps rows with equal order keys apart. Each ``by`` group goes
    through one task, so use it where groups are bounded (a year has at most 13
    month rows); ``running_sum_blocked`` handles unbounded groups.
    """
    w = (
        Window.partitionBy(*by)
        .orderBy(*nulls_last(order_by))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    missing = F.count_if(F.col(value).isNull()).over(w)
    return F.when(missing == 0, F.sum(value).over(w))


def running_sum_blocked(
    df: DataFrame,
    value: str,
    alias: str,
    by: Sequence[str],
    order_by: Sequence[str],
    blocks: int | None = None,
) -> DataFrame:
    """``running_sum`` for groups too large for one task.

    The rows are range-partitioned on group and order, which cuts a hot group
    into as many even blocks as its size needs, and stored with their block
    number. Totals per group and block combine map-side; a running sum over
    those few totals gives every block its opening balance, which enters the
    block as one extra leading row. ``blocks`` defaults to the shuffle partitions; as for any
    shuffle, set them so that a partition of the table fits a task.
    """
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(blocks, *nulls_last([*by, *order_by]))
    # Stored, because the block number must be the same in every later read.
    rows = stage(ranged.withColumn("_block", F.spark_partition_id()), "blocks")
    pieces = [*by, "_block"]
    totals = rows.groupBy(*pieces).agg(
        F.sum(value).alias("_total"), F.count_if(F.col(value).isNull()).alias("_missing")
    )
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select(
        *pieces,
        F.lit(0).alias("_row"),
        F.sum("_total").over(before).alias("_value"),
        F.coalesce(F.sum("_missing").over(before), F.lit(0)).alias("_missing"),
    )
    body = rows.select(
        "*",
        F.lit(1).alias("_row"),
        F.col(value).alias("_value"),
        F.col(value).isNull().cast("bigint").alias("_missing"),
    )
    w = (
        Window.partitionBy(*pieces)
        .orderBy("_row", *nulls_last(order_by))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = F.when(F.sum("_missing").over(w) == 0, F.sum("_value").over(w))
    return (
        body.unionByName(opening, allowMissingColumns=True)
        .withColumn(alias, total)
        .filter(F.col("_row") == 1)
        .drop("_row", "_block", "_value", "_missing")
    )


def row_numbers(
    df: DataFrame, alias: str, by: Sequence[str], order_by: Sequence[str], blocks: int | None = None
) -> DataFrame:
    """Rows of each group numbered 1, 2, 3, ... without a gap, first column of the result.

    The row names of an output file, if ``by`` says which file a row goes to. Rows that ``order_by`` leaves tied get different
    numbers in any order. Counts per range block give each block its first number, so that a large group is not one task's.
    """
    ones = running_sum_blocked(df.withColumn("_one", F.lit(1)), "_one", alias, by, order_by, blocks)
    return ones.select(alias, *[f"`{c}`" for c in df.columns])


def calendar_index(
    df: DataFrame, keys: Sequence[str] = ("year", "month_number"), alias: str = "time"
) -> DataFrame:
    """Distinct periods numbered 1, 2, 3, ... in order, missing parts last.

    The numbering window is global, but over distinct calendar periods only.
    """
    periods = df.select(*keys).distinct()
    return periods.withColumn(alias, F.row_number().over(Window.orderBy(*nulls_last(keys))))
