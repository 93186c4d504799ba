import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelloom.functions import scalars as S


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression.alias("o")).first().o


def test_to_number_gives_null_for_unreadable_text(spark):
    df = spark.createDataFrame(
        [("12",), (" 3.5 ",), ("1e3",), ("-",), ("Total",), ("",), (None,), ("1d",), ("2F",), ("Inf",)], "c string"
    )
    got = [r[0] for r in df.select(S.to_number("c")).collect()]
    assert got == [12.0, 3.5, 1000.0, None, None, None, None, None, None, math.inf]
    assert [r[0] for r in df.select(*S.number_columns(["c"])).collect()] == got


def test_european_number(spark):
    df = spark.createDataFrame([("1.234,5",), ("7",), ("1.000.000",), ("Total",)], "c string")
    assert [r[0] for r in df.select(S.european_number("c")).collect()] == [1234.5, 7.0, 1e6, None]


def test_extract_first_is_null_without_a_match(spark):
    df = spark.createDataFrame([("110001 ALTA",), ("Total",), (None,)], "c string")
    assert [r[0] for r in df.select(S.extract_first("c", "[0-9]+")).collect()] == ["110001", None, None]


def test_remove_first_takes_only_the_first(spark):
    df = spark.createDataFrame([("a/b/c",), ("abc",), ("/",), (None,)], "c string")
    assert [r[0] for r in df.select(S.remove_first("c", "/")).collect()] == ["ab/c", "abc", "", None]


def test_code_prefix(spark):
    df = spark.createDataFrame([(1100015,), (3550308,), (None,)], "c bigint")
    assert [r[0] for r in df.select(S.code_prefix("c")).collect()] == [110001, 355030, None]


def test_month_number_covers_all_months_and_nothing_else(spark):
    df = spark.createDataFrame([(m,) for m in (*S.MONTHS_PT, "may", None)], "c string")
    got = [r[0] for r in df.select(S.month_number("c")).collect()]
    assert got == [*range(1, 13), None, None]


def test_threshold_flag_counts_missing_as_zero(spark):
    df = spark.createDataFrame([(0.71,), (0.7,), (None,)], "c double")
    assert [r[0] for r in df.select(S.threshold_flag("c", 0.7)).collect()] == [1, 0, 0]


def test_label(spark):
    df = spark.createDataFrame([(1,), (0,), (2,), (None,)], "c int")
    assert [r[0] for r in df.select(S.label("c", {1: "more", 0: "less"})).collect()] == ["more", "less", None, None]


def test_month_start(spark):
    df = spark.createDataFrame([(2019, 1), (2019, None), (None, 2), (2019, 13)], "y int, m int")
    got = [r[0] for r in df.select(S.month_start("y", "m")).collect()]
    assert got == [dt.date(2019, 1, 1), None, None, None]


numbers = st.one_of(
    st.none(), st.sampled_from([0.0, -0.0, math.inf, -math.inf, math.nan]), st.floats(-1e6, 1e6, allow_subnormal=False)
)


def ieee(n, d):
    if n is None or d is None:
        return None
    if math.isnan(n) or math.isnan(d):
        return math.nan
    if d == 0:
        if n == 0:
            return math.nan
        return math.copysign(math.inf, n) * math.copysign(1.0, d)
    if math.isinf(n) and math.isinf(d):
        return math.nan
    return n / d


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(numbers, numbers), min_size=60, max_size=60))
def test_divide_follows_ieee(spark, pairs):
    df = spark.createDataFrame(pairs, "n double, d double")
    for (n, d), r in zip(pairs, df.select(S.divide("n", "d")).collect()):
        want = ieee(n, d)
        if want is None:
            assert r[0] is None
        elif math.isnan(want):
            assert math.isnan(r[0]), (n, d)
        else:
            assert r[0] == want, (n, d)


@pytest.mark.parametrize("n, d, want", [(1, 0, math.inf), (-1, 0, -math.inf), (6, 3, 2.0)])
def test_divide_integers(spark, n, d, want):
    df = spark.createDataFrame([(n, d)], "n int, d int")
    assert df.select(S.divide("n", "d")).first()[0] == want
    assert math.isnan(df.select(S.divide(F.lit(0), F.lit(0))).first()[0])
