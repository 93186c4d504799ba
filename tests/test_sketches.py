"""Stored quantile sketches."""

import random
from bisect import bisect_left, bisect_right

import pytest

from panelloom.functions.sketches import merged_quantiles, quantile_sketches, rank_error


def off(values, estimate, p):
    """How far the ranks of an estimate are from the wanted one, as a share of the values."""
    values = sorted(values)
    low, high = bisect_left(values, estimate) / len(values), bisect_right(values, estimate) / len(values)
    return max(0.0, low - p, p - high)


@pytest.mark.parametrize("k", [100, 800])
def test_merged_ranks_are_within_the_bound(spark, tmp_path, k):
    rng = random.Random(k)
    data = [(m % 12, m % 3, rng.lognormvariate(0, 2), float(rng.randrange(5))) for m in range(40_000)]
    data += [(0, 0, 1.5, None)] * 20_000  # a hot group of one value
    rows = spark.createDataFrame(data, "month int, place int, x double, few double")
    path = str(tmp_path / "sketches")
    quantile_sketches(rows, ["month", "place"], ["x", "few"], k).write.parquet(path)
    stored = spark.read.parquet(path)
    wanted = (0.1, 0.5, 0.9)
    for keys, own in (([], lambda r, g: True), (["place"], lambda r, g: r[1] == g.place), (["month"], lambda r, g: r[0] == g.month)):
        found = merged_quantiles(stored, keys, ["x", "few"], wanted).collect()
        assert len(found) == len({r[:len(keys)] for r in found}) * 2 * len(wanted)
        for g in found:
            column = 2 if g.variable == "x" else 3
            values = [r[column] for r in data if own(r, g) and r[column] is not None]
            assert g.n == len(values)
            assert off(values, g.estimate, g.probability) <= 2 * rank_error(k)


def test_missing_values(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1, 2.0), (1, nan), (1, None), (2, None), (None, 7.0)], "g int, x double")
    sketches = quantile_sketches(rows, ["g"], ["x"])
    found = merged_quantiles(sketches, ["g"], ["x"]).collect()
    assert {(r.g, r.n, r.estimate) for r in found} == {(1, 1, 2.0), (2, 0, None), (None, 1, 7.0)}
    assert merged_quantiles(sketches, [], ["x"]).first()["n"] == 2
    assert [(r.n, r.estimate) for r in merged_quantiles(sketches.where("false"), [], ["x"]).collect()] == [(0, None)]
    assert quantile_sketches(rows.where("false"), ["g"], ["x"]).count() == 0


def test_size_of_a_sketch_does_not_grow_with_the_rows(spark):
    from pyspark.sql import functions as F

    size = lambda n: quantile_sketches(spark.range(n), [], ["id"]).select(F.length("id")).first()[0]
    assert size(2_000_000) < 1.5 * size(50_000)
