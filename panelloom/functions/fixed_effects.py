"""Least squares with place and period effects, standard errors clustered by place."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.sources.sinks import stage


def _cells(df: DataFrame, variables: Sequence[str], unit: str, period: str) -> DataFrame:
    """One row per unit: its periods, and in each the number of rows, the sums and the sums of products.

    Sums combine map-side per (unit, period); a unit has no more cells than there are periods, so its list is bounded.
    """
    pairs = combinations_with_replacement(range(len(variables)), 2)
    values = [F.col(v) for v in variables]
    cells = df.groupBy(unit, period).agg(
        F.count("*").cast("double").alias("n"),
        F.array(*[F.sum(v) for v in values]).alias("sums"),
        F.array(*[F.sum(values[i] * values[j]) for i, j in pairs]).alias("products"),
    )
    return cells.groupBy(unit).agg(F.collect_list(F.struct(F.col(period).alias("at"), "n", "sums", "products")).alias("cells"))


def _total(cells: Column | str, part) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda s, c: s + part(c))


def _effects(count: int, by_period: Column) -> list[Column]:
    """The unit's effect on each variable: the mean of what the period effects leave."""
    n = _total("cells", lambda c: c["n"])
    return [
        _total("cells", lambda c, v=v: c["sums"][v] - c["n"] * by_period[c["at"]][v]) / n for v in range(count)
    ]


def fixed_effects(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    unit: str,
    period: str,
    tolerance: float = 1e-10,
    rounds: int = 1000,
) -> DataFrame:
    """(term, estimate, std_error, t, n, clusters): ``y`` on ``xs`` net of unit and period effects.

    Unit and period means are taken out in turn until the period effects move by less than ``tolerance`` times the
    spread of their variable; ``rounds`` passes without that fail the job. A pass reads the stored cells once and combines
    map-side to one row per period; only these, the effects, reach the driver, so they are bounded by the number of
    periods. Rows with a missing or non-finite member are left out. The variance is the sandwich of scores
    summed by unit, times G / (G - 1) x (n - 1) / (n - k), k counting terms and period effects (unit effects are
    nested in the clusters). A term that the effects explain wholly has no estimate. An empty table gives rows of missing values.
    """
    variables, spark = [y, *xs], df.sparkSession
    numbers = [F.col(v).cast("double").alias(f"_{i}") for i, v in enumerate(variables)]
    names = [f"_{i}" for i in range(len(variables))]
    finite = [(F.abs(F.col(v)) < float("inf")) & ~F.isnan(v) for v in names]
    rows = df.select(F.col(unit).alias("_unit"), F.col(period).alias("_period"), *numbers)
    for condition in [F.col("_unit").isNotNull() & F.col("_period").isNotNull(), *finite]:
        rows = rows.filter(condition)
    units = stage(_cells(rows, names, "_unit", "_period"), "cells")
    cell = units.select(F.explode("cells").alias("c"))
    spreads = cell.groupBy("c.at").agg(
        F.sum("c.n"),
        *[F.sum(F.col("c.sums")[v]) for v in range(len(names))],
        *[F.sum(F.col("c.products")[j]) for j in range(len(names) * (len(names) + 1) // 2)],
    )
    seen = spreads.orderBy("at").collect()
    schema = "term string, estimate double, std_error double, t double, n bigint, clusters bigint"
    if not seen:
        return spark.createDataFrame([(x, None, None, None, 0, 0) for x in xs], schema)
    at, table = [r[0] for r in seen], np.array([r[1:] for r in seen], dtype=float)
    n, sums = table[:, 0], table[:, 1 : 1 + len(names)]
    squares = [k for k, (i, j) in enumerate(combinations_with_replacement(range(len(names)), 2)) if i == j]
    means = sums.sum(axis=0) / n.sum()
    spread = np.sqrt(np.maximum(table[:, 1 + len(names) :].sum(axis=0)[squares] / n.sum() - means**2, 0)) + 1e-300
    effects = np.zeros((len(at), len(names)))

    def literal() -> Column:
        rows_of = [F.array(*[F.lit(float(x)) for x in row]) for row in effects]
        return F.map_from_arrays(F.array(*[F.lit(a) for a in at]), F.array(*rows_of))

    for _ in range(rounds):
        own = units.select(F.array(*_effects(len(names), literal())).alias("own"), F.explode("cells").alias("c"))
        left = [F.sum(F.col("c.sums")[v] - F.col("c.n") * F.col("own")[v]) / F.sum("c.n") for v in range(len(names))]
        found = {r[0]: r[1:] for r in own.groupBy("c.at").agg(*left).collect()}
        new = np.array([found[a] for a in at], dtype=float)
        moved, effects = np.abs(new - effects).max(axis=0), new
        if np.all(moved <= tolerance * spread):
            break
    else:
        raise ValueError(f"fixed_effects: the effects still move after {rounds} rounds")

    # Sums of products of what the effects leave, by unit; the effects are constant inside a cell.
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    with_own = units.select("cells", F.array(*_effects(len(names), literal())).alias("own"))
    by_period = literal()

    def product(k: int, i: int, j: int) -> Column:
        def of(c: Column) -> Column:
            a, b = (F.col("own")[v] + by_period[c["at"]][v] for v in (i, j))
            return c["products"][k] - a * c["sums"][j] - b * c["sums"][i] + c["n"] * a * b

        return _total("cells", of)

    inner = with_own.select(*[product(k, i, j).alias(f"m{i}_{j}") for k, (i, j) in enumerate(pairs)])
    inner = stage(inner, "products")
    total = inner.agg(F.count("*"), *[F.sum(f"m{i}_{j}") for i, j in pairs]).first()
    clusters, gram = total[0], np.zeros((len(names), len(names)))
    for (i, j), x in zip(pairs, total[1:], strict=True):
        gram[i, j] = gram[j, i] = x
    free = [v for v in range(1, len(names)) if gram[v, v] > 1e-9 * n.sum() * spread[v] ** 2]
    estimate: dict[int, float] = {}
    errors: dict[int, float] = {}
    if free:
        xx = gram[np.ix_(free, free)]
        if np.linalg.matrix_rank(xx / np.sqrt(np.outer(np.diag(xx), np.diag(xx)))) < len(free):
            raise ValueError("fixed_effects: the terms are collinear")
        beta = np.linalg.solve(xx, gram[free, 0])
        pair = lambda i, j: F.col(f"m{min(i, j)}_{max(i, j)}")
        scores = [pair(0, i) - sum(pair(i, j) * float(b) for j, b in zip(free, beta, strict=True)) for i in free]
        scored = inner.select(*[s.alias(f"s{i}") for i, s in enumerate(scores)])
        both = [(i, j) for i in range(len(free)) for j in range(len(free))]
        meat = np.array(scored.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in both]).first(), dtype=float)
        inverse = np.linalg.inv(xx)
        k = len(free) + len(at)
        if clusters > 1 and n.sum() > k:
            scale = clusters / (clusters - 1) * (n.sum() - 1) / (n.sum() - k)
            variance = scale * inverse @ meat.reshape(len(free), len(free)) @ inverse
            errors = dict(zip(free, np.sqrt(np.maximum(np.diag(variance), 0)).tolist(), strict=True))
        estimate = dict(zip(free, beta.tolist(), strict=True))
    out = []
    for v, x in enumerate(xs, start=1):
        b, se = estimate.get(v), errors.get(v)
        out.append((x, b, se, b / se if b is not None and se else None, int(n.sum()), clusters))
    return spark.createDataFrame(out, schema)
