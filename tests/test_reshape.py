import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelloom.operators import filters, grids, names
from panelloom.operators.reshape import arrange, fill_grid, pivot_longer, pivot_longer_parsed
from tests.conftest import rows


def test_name_repairs(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`Município` int, `2016/Jan/x` int, Total int, `SUBTOTAL2` int")
    fixed = names.drop_containing(names.lower_names(names.remove_from_names(df)), "Total")
    assert fixed.columns == ["município", "2016jan/x"]
    assert names.set_names(fixed, ["a", "b"]).columns == ["a", "b"]
    with pytest.raises(ValueError):
        names.set_names(fixed, ["a"])


@pytest.mark.parametrize(
    "raw, clean",
    [("Município", "municipio"), ("2016", "x2016"), ("2016/Jan", "x2016_jan"), ("Vote Share (%)", "vote_share_percent"), ("idMunicipio", "id_municipio"), ("Olho d'água #", "olho_dagua_number"), ("()", "x")],
)
def test_clean_name(raw, clean):
    assert names.clean_name(raw) == clean


def test_clean_names_numbers_repeats(spark):
    assert names.clean_names(spark.createDataFrame([(1, 2)], "`A b` int, `A.b` int")).columns == ["a_b", "a_b_2"]


def test_pivot_keeps_missing_cells(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", None, 4)], "p string, `2016jan` int, `2016fev` int")
    want = [("a", "2016fev", None), ("a", "2016jan", 1.0), ("b", "2016fev", 4.0), ("b", "2016jan", None)]
    assert rows(pivot_longer(df, ["p"], "date", "v")) == want
    parsed = pivot_longer_parsed(df, ["p"], {"y": lambda n: int(n[:4]), "m": lambda n: n[4:]}, "v")
    assert rows(parsed) == [("a", 2016, "fev", None), ("a", 2016, "jan", 1), ("b", 2016, "fev", 4), ("b", 2016, "jan", None)]


def test_fill_grid(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), (None, "y", None)], "p string, d string, v int")
    want = [("a", "x", 1), ("a", "y", None), ("b", "x", None), ("b", "y", 2), (None, "x", None), (None, "y", None)]
    assert rows(fill_grid(df, ["p"], "d", ["x", "y"], "v")) == want
    levels = df.agg(F.collect_set("d").alias("l")).scalar()
    assert rows(fill_grid(df, ["p"], "d", levels, "v")) == want
    with pytest.raises(PySparkException, match="cell is repeated"):
        fill_grid(df.union(df), ["p"], "d", ["x", "y"], "v").collect()


def test_text_filter_compares_strings(spark):
    df = spark.createDataFrame([("2014",), ("2016",), ("Total",), (None,), ("900",)], "year string")
    assert rows(filters.text_after(df, "year", "2015")) == [("2016",), ("900",)]


def test_members_drop_missing(spark):
    df = spark.createDataFrame([(2015,), (2016,), (2021,), (2022,), (None,)], "y int")
    assert rows(filters.keep_members(df, "y", range(2016, 2022))) == [(2016,), (2021,)]
    assert rows(filters.keep_members(df, "y", [2015, 2022])) == [(2015,), (2022,)]
    assert rows(filters.keep_members(df, "y", [])) == []


def test_complete_cases_drop_nan_and_keep_infinity(spark):
    df = spark.createDataFrame([(1.0, "a"), (math.nan, "b"), (math.inf, "c"), (None, "d"), (2.0, None)], "x double, s string")
    assert rows(filters.complete_cases(df), "s") == [("a",), ("c",)]
    assert filters.complete_cases(df, ["s"]).count() == 4


def test_date_limits_are_closed(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2020, 1, 1),), (d(2021, 12, 1),), (d(2022, 1, 1),), (None,)], "date date")
    assert filters.keep_dates(df, "date", d(2020, 1, 1), d(2021, 12, 1)).count() == 2
    assert filters.keep_dates(df, "date", None, d(2020, 1, 1)).count() == 1


def test_parameter_grid(spark):
    grid = grids.year_state_grid(spark, range(2006, 2021), [f"S{i}" for i in range(27)])
    assert grid.count() == 405 == grid.distinct().count()
    years = grids.expand_years(spark.range(2), 2006, 2008)
    assert rows(years) == [(i, y) for i in range(2) for y in (2006, 2007, 2008)]
    days = [dt.date(2021, 12, 7)] * 2
    assert grids.event_dates(spark, days).count() == 2
    assert grids.event_dates(spark, []).count() == 0


def test_arrange_puts_missing_last(spark):
    df = spark.createDataFrame([(None, 1), (2017, 1), (2016, None), (2016, 2)], "y int, m int")
    assert [tuple(r) for r in arrange(df, "y", "m").collect()] == [(2016, 2), (2016, None), (2017, 1), (None, 1)]
