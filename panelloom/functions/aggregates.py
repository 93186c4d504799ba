"""Aggregates: NA-skipping sums, exact medians, correlation and least squares."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.student_t import two_sided_p, two_sided_quantile
from panelloom.functions.windows import running_sum_blocked

_FLOATING = (T.DoubleType, T.FloatType)
_MOMENTS = {"n": F.count, "mean": F.mean, "sd": F.stddev_samp}


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """Column names starting with ``prefix``, ignoring case, in table order."""
    return [c for c in df.columns if c.lower().startswith(prefix.lower())]


def without_nan(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL (aggregates skip NULL but not NaN)."""
    if isinstance(df.schema[name].dataType, _FLOATING):
        return F.when(~F.isnan(name), F.col(name))
    return F.col(name)


def na_sum(df: DataFrame, name: str) -> Column:
    """Sum that skips missing values; an all-missing group sums to 0, not NULL."""
    return F.coalesce(F.sum(without_nan(df, name)), F.lit(0)).alias(name)


def sum_by(df: DataFrame, keys: Sequence[str], measures: Iterable[str]) -> DataFrame:
    """NA-skipping sums of ``measures`` per key.

    Sums combine map-side, so a hot key costs one partial row per task.
    """
    return df.groupBy(*keys).agg(*[na_sum(df, m) for m in measures])


def summary_statistics(
    df: DataFrame, measures: Sequence[str], rank_error: float = 1e-3
) -> DataFrame:
    """Mean, sample standard deviation and exact median of each measure, one row per measure.

    The first pass takes the moments and, from a quantile sketch, a value range around each median of
    about ``4 * rank_error`` of the rows; the second counts the rows below and inside. Only
    the distinct values inside are ranked, in blocks, and the middle ranks read off. Should a sketch
    miss, or equal values on both sides keep its range wide, more values are ranked; the result is the same.
    """
    spark = df.sparkSession
    values = df.select(*[without_nan(df, m).cast("double").alias(m) for m in measures])
    around = F.array(F.lit(0.5 - 2 * rank_error), F.lit(0.5 + 2 * rank_error))
    sketch = lambda m: F.percentile_approx(m, around, int(1 / rank_error))
    first = values.agg(
        *[f(m).alias(f"{i}:{k}") for i, m in enumerate(measures) for k, f in _MOMENTS.items()],
        *[sketch(m).alias(f"{i}:range") for i, m in enumerate(measures)],
    ).first()
    sizes = [first[f"{i}:n"] for i in range(len(measures))]
    ranges = [first[f"{i}:range"] or [0.0, 0.0] for i in range(len(measures))]
    second = values.agg(
        *[F.count_if(F.col(m) < ranges[i][0]).alias(f"{i}:below") for i, m in enumerate(measures)],
        *[F.count_if(F.col(m).between(*ranges[i])).alias(f"{i}:inside") for i, m in enumerate(measures)],
    ).first()
    facts = []
    for i, m in enumerate(measures):
        low, high = (sizes[i] + 1) // 2, sizes[i] // 2 + 1
        below, inside = second[f"{i}:below"], second[f"{i}:inside"]
        if not below < low <= high <= below + inside:
            ranges[i], below = [float("-inf"), float("inf")], 0
        facts.append((m, first[f"{i}:mean"], first[f"{i}:sd"], *ranges[i], below, low, high))
    info = spark.createDataFrame(
        facts,
        "variable string, mean double, sd double, low double, high double,"
        " below bigint, first bigint, last bigint",
    )
    in_range = values.select(*[F.when(F.col(f[0]).between(f[3], f[4]), F.col(f[0])).alias(f[0]) for f in facts])
    counts = (
        in_range.unpivot([], list(measures), "variable", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("variable", "value")
        .agg(F.count("*").alias("rows"))
    )
    upto = running_sum_blocked(counts, "rows", "upto", ["variable"], ["value"])
    # info has one row per measure named by the caller, so its size is fixed.
    ranked = upto.join(F.broadcast(info.select("variable", "below", "first", "last")), "variable")
    at = F.col("below") + F.col("upto")
    medians = (
        ranked.groupBy("variable")
        .agg(
            F.min(F.when(at >= F.col("first"), F.col("value"))).alias("lo"),
            F.min(F.when(at >= F.col("last"), F.col("value"))).alias("hi"),
        )
        .select("variable", ((F.col("lo") + F.col("hi")) / 2).alias("median"))
    )
    return info.join(medians, "variable", "left").select("variable", "mean", "sd", "median")


def regression_moments(
    df: DataFrame, x: str, y: str, y_limits: tuple[float, float] | None = None
) -> DataFrame:
    """One row of sufficient statistics for the line of ``y`` on ``x``.

    Rows outside ``y_limits`` are removed first, as are pairs with a missing or
    non-finite member. Every statistic comes from one partial + final aggregate.
    """
    pairs = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if y_limits is not None:
        pairs = pairs.filter(F.col("y").between(*y_limits))
    finite = [(F.col(c) > float("-inf")) & (F.col(c) < float("inf")) for c in ("x", "y")]
    sums = pairs.filter(finite[0] & finite[1]).agg(
        F.count("*").alias("n"),
        F.regr_sxx("y", "x").alias("sxx"),
        F.regr_syy("y", "x").alias("syy"),
        F.regr_sxy("y", "x").alias("sxy"),
        F.avg("x").alias("mean_x"),
        F.avg("y").alias("mean_y"),
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
    )
    # corr() and regr_slope() fail under ANSI on a constant column; here they are missing.
    varies = F.col("sxx") > 0, F.col("syy") > 0
    r = F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))
    return (
        sums.withColumn("slope", F.when(varies[0], F.col("sxy") / F.col("sxx")))
        .withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("mean_x"))
        .withColumn("r", F.when(varies[0] & varies[1], F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))))
        .withColumn("r2", F.col("r") * F.col("r"))
    )


def correlation(
    df: DataFrame, x: str, y: str, y_limits: tuple[float, float] | None = None
) -> DataFrame:
    """Pearson correlation with its t statistic and p-value, plus the fitted line."""
    m = regression_moments(df, x, y, y_limits)
    r, n = F.col("r"), F.col("n")
    finite_t = F.when(F.abs(r) < 1, r * F.sqrt((n - 2) / (1 - r * r)))
    t = F.when(n > 2, finite_t.otherwise(r * float("inf")))
    return m.withColumn("t", t).select(
        "n", "r", "t", two_sided_p("t", n - 2).alias("p"), "slope", "intercept", "r2"
    )


def regression_band(
    df: DataFrame,
    x: str,
    y: str,
    y_limits: tuple[float, float] | None = None,
    level: float = 0.95,
    points: int = 80,
) -> DataFrame:
    """Fitted line with its standard error and confidence limits on an even x grid."""
    m = regression_moments(df, x, y, y_limits)
    grid = m.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("min_x") + (F.col("max_x") - F.col("min_x")) * F.col("step") / (points - 1)
    # The residual sum of squares is never negative but may round below zero.
    residual = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    spread = 1 / F.col("n") + F.pow(F.col("x") - F.col("mean_x"), 2) / F.col("sxx")
    usable = (F.col("n") > 2) & (F.col("sxx") > 0)
    return (
        grid.withColumn("x", at)
        .withColumn("fit", F.col("intercept") + F.col("slope") * F.col("x"))
        .withColumn("se", F.when(usable, F.sqrt(residual / (F.col("n") - 2) * spread)))
        .withColumn("margin", two_sided_quantile(F.lit(level), F.col("n") - 2) * F.col("se"))
        .select(
            "step",
            "x",
            "fit",
            "se",
            (F.col("fit") - F.col("margin")).alias("lower"),
            (F.col("fit") + F.col("margin")).alias("upper"),
        )
    )
