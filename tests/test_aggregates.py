import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from panelloom.functions import aggregates as A
from panelloom.functions import student_t as t
from tests.conftest import rows


def test_sum_of_all_missing_is_zero(spark):
    df = spark.createDataFrame(
        [(1, None, 2.0), (1, None, math.nan), (2, 3, None)], "k int, vacc_a bigint, Vacc_b double"
    )
    names = A.columns_with_prefix(df, "vacc")
    assert names == ["vacc_a", "Vacc_b"]
    assert rows(A.sum_by(df, ["k"], names)) == [(1, 0, 2.0), (2, 3, 0.0)]


def test_missing_key_is_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 5)], "k int, vacc bigint")
    assert rows(A.sum_by(df, ["k"], ["vacc"])) == [(1, 5), (None, 3)]


@pytest.mark.parametrize("size", [1, 2, 9, 500, 2001])
def test_summary_is_exact(spark, size):
    draw = random.Random(size)
    few = [float(draw.randint(0, 3)) for _ in range(size)]
    many = [draw.lognormvariate(0, 3) * draw.choice([-1, 1]) for _ in range(size)]
    data = [*zip(few, many), (None, math.nan)]
    df = spark.createDataFrame(data, "few double, many double")
    got = {r.variable: r for r in A.summary_statistics(df, ["few", "many"], 0.01).collect()}
    for name, values in (("few", few), ("many", many)):
        assert got[name]["median"] == statistics.median(values)
        assert got[name]["mean"] == pytest.approx(statistics.fmean(values))
        if size > 1:
            assert got[name]["sd"] == pytest.approx(statistics.stdev(values))


def test_summary_with_a_value_in_a_third_of_all_rows(spark):
    values = [7.0] * 1000 + [float(i) for i in range(-1000, 1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(8)
    assert A.summary_statistics(df, ["x"], 0.01).first()["median"] == statistics.median(values)


def test_summary_between_two_frequent_values(spark):
    values = [1.0] * 500 + [float(i) / 10 for i in range(11, 20)] + [2.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(8)
    assert A.summary_statistics(df, ["x"], 0.001).first()["median"] == statistics.median(values)


def test_summary_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    r = A.summary_statistics(df, ["x"]).first()
    assert (r["mean"], r["sd"], r["median"]) == (None, None, None)


def test_limits_censor_before_the_fit(spark):
    data = [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (4.0, 1000.0), (None, 1.0), (1.0, None), (math.nan, 1.0), (5.0, math.nan)]
    df = spark.createDataFrame(data, "x double, y double")
    r = A.correlation(df, "x", "y", (0, 150)).first()
    assert (r["n"], r["r"], r["slope"], r["intercept"], r["p"]) == (3, 1.0, 2.0, 0.0, 0.0)
    assert A.correlation(df, "x", "y").first()["n"] == 4


def test_correlation_against_known_values(spark):
    # Anscombe's first data set; its published fit is y = 3.00 + 0.500 x, r = 0.816, p = 0.00217.
    x = [10, 8, 13, 9, 11, 14, 6, 4, 12, 7, 5]
    y = [8.04, 6.95, 7.58, 8.81, 8.33, 9.96, 7.24, 4.26, 10.84, 4.82, 5.68]
    df = spark.createDataFrame([(float(a), b) for a, b in zip(x, y)], "x double, y double")
    r = A.correlation(df, "x", "y").first()
    assert r["r"] == pytest.approx(0.81642, abs=1e-5)
    assert r["t"] == pytest.approx(4.2415, abs=1e-4)
    assert r["p"] == pytest.approx(0.00217, abs=1e-5)
    assert r["intercept"] == pytest.approx(3.0001, abs=1e-4)
    band = A.regression_band(df, "x", "y", points=11).orderBy("step").collect()
    assert [b.x for b in band] == list(range(4, 15))
    mean = band[5]
    # At the mean of x the standard error is s / sqrt(n), with the published s = 1.237.
    assert mean.se == pytest.approx(1.2366 / math.sqrt(11), abs=1e-4)
    assert mean.upper - mean.fit == pytest.approx(2.262157 * mean.se, abs=1e-5)
    assert mean.fit - mean.lower == pytest.approx(mean.upper - mean.fit)


def test_student_t_tables():
    # Two-sided 5 % critical values from the usual printed tables.
    for freedom, want in ((1, 12.706), (2, 4.303), (5, 2.571), (10, 2.228), (30, 2.042), (120, 1.980)):
        assert t.quantile(0.95, freedom) == pytest.approx(want, abs=6e-4)
        assert t.tail(want, freedom) == pytest.approx(0.05, abs=1e-4)
    assert t.tail(0.0, 3) == 1.0
    assert t.tail(math.inf, 3) == 0.0


def test_constant_x_has_no_band(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    r = A.correlation(df, "x", "y").first()
    assert r["n"] == 3 and r["slope"] is None
    assert A.regression_band(df, "x", "y", points=3).filter(F.col("se").isNotNull()).count() == 0
