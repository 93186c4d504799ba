"""Stored quantile sketches: medians of any union of groups without reading the rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.aggregates import without_nan


def rank_error(k: int) -> float:
    """Half width of the range of ranks, as a share of the rows, that holds an estimate with 99 % confidence.

    The published bound of KLL sketches; it holds for merged ones too, and does not depend on the number of rows.
    """
    return 2.296 / k**0.9723


def quantile_sketches(df: DataFrame, keys: Sequence[str], measures: Sequence[str], k: int = 800) -> DataFrame:
    """One row per group: the keys, and for each measure its number of values ``n_<measure>`` and a binary sketch.

    Sketches combine map-side, so a hot group costs a few kilobytes a task. Missing values and NaN are skipped; a
    measure without a value in a group has 0 and no sketch. Larger ``k`` (8 to 65,535) gives a smaller ``rank_error``. The
    table is meant to be stored: rows of later periods are added as they come.
    """
    values = df.select(*keys, *[without_nan(df, m).cast("double").alias(m) for m in measures])
    found = values.groupBy(*keys).agg(
        *[F.count(m).alias(f"n_{m}") for m in measures],
        *[F.kll_sketch_agg_double(m, k).alias(m) for m in measures],
    )
    return found.withColumns({m: F.when(F.col(f"n_{m}") > 0, F.col(m)) for m in measures})


def merged_quantiles(
    sketches: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    probabilities: Sequence[float] = (0.5,),
) -> DataFrame:
    """(keys, variable, n, probability, estimate) of the groups' unions, from stored sketches alone.

    ``keys`` are some or none of the keys that the sketches were taken by; sketches that agree in them are merged.
    The rank of an estimate is off by ``rank_error(k)`` of the values at most, with 99 % confidence. Without a value the estimate
    is missing.
    """
    merged = sketches.groupBy(*keys).agg(
        *[F.coalesce(F.sum(f"n_{m}"), F.lit(0)).alias(f"n_{m}") for m in measures],
        *[F.kll_merge_agg_double(m).alias(m) for m in measures],
    )
    at = F.array(*[F.lit(float(p)) for p in probabilities])
    of = lambda m: F.when(F.col(f"n_{m}") > 0, F.kll_sketch_get_quantile_double(m, at))
    listed = [F.struct(F.lit(m).alias("variable"), F.col(f"n_{m}").alias("n"), of(m).alias("at")) for m in measures]
    found = merged.select(*keys, F.inline(F.array(*listed)))
    found = found.select(*keys, "variable", "n", "at", F.posexplode(at).alias("_i", "probability"))
    return found.select(*keys, "variable", "n", "probability", F.get("at", F.col("_i")).alias("estimate"))
