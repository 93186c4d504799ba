"""The composite analyses on a hand-worked panel."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelloom import workload
from panelloom.plans import coverage as C
from panelloom.plans import ingest
from panelloom.plans import panel as P
from panelloom.plans.reconcile import reconcile
from tests.conftest import rows

PLACE = "cod_mun"


def series(spark):
    """Three series; place 1 lacks one cell of the oral series, place 2 has February only."""
    def make(name, data):
        return spark.createDataFrame(data, f"cod_mun int, year int, month string, {name} bigint")

    return [
        make("vacc_hx_3_dose", [(1, 2016, "jan", 1), (1, 2015, "jan", 99)]),
        make("vacc_vip_3_dose", [(1, 2016, "jan", 2), (1, 2016, "fev", 3), (1, 2016, "mar", 4), (2, 2016, "fev", 5)]),
        make("vacc_vop_3_dose", [(1, 2016, "jan", 10), (1, 2016, "mar", 30), (2, 2016, "fev", 20)]),
    ]


def population(spark):
    return spark.createDataFrame([(2016, 1, 120.0), (2016, 2, 0.0), (2016, 3, 60.0), (2014, 1, 1.0)], "year int, cod_mun int, pop double")


def attributes(spark):
    return spark.createDataFrame([(1, 0.75, 1), (2, 0.65, 0), (9, None, None)], "cod_mun int, share double, win int")


def events(spark):
    return spark.createDataFrame(
        [(2016, 2, dt.date(2016, 2, 3)), (2016, 2, dt.date(2016, 2, 9)), (2030, 1, dt.date(2030, 1, 1))],
        "year int, month_number int, event_date date",
    )


def build(spark, **options):
    base = P.monthly_base(series(spark))
    return P.build_panel(base, population(spark), attributes(spark), events(spark), **options)


def test_monthly_base(spark):
    got = P.monthly_base(series(spark))
    assert rows(got) == [
        (1, 2016, "fev", None, 3, None, 2),
        (1, 2016, "jan", 1, 2, 10, 1),
        (1, 2016, "mar", None, 4, 30, 3),
        (2, 2016, "fev", None, 5, 20, 2),
    ]


@pytest.mark.parametrize("duplicates", ["auto", "raise", "join"])
def test_panel_rows_and_values(spark, duplicates):
    panel = build(spark, event_mode="collapse", duplicates=duplicates)
    got = rows(panel, PLACE, "year", "month_number", "time", "pop", "vacc_total", "vacc_accum", "goal_accum", "share", "n_events", "flag_70", "flag_60")
    assert got == [
        (1, 2014, None, None, 1.0, None, None, None, 0.75, None, 1, 1),
        (1, 2016, 1, 1, 120.0, 12, 12, 10.0, 0.75, None, 1, 1),
        (1, 2016, 2, 2, 120.0, None, None, 20.0, 0.75, 2, 1, 1),
        (1, 2016, 3, 3, 120.0, 34, None, 30.0, 0.75, None, 1, 1),
        (2, 2016, 2, 2, 0.0, 25, 25, 0.0, 0.65, 2, 0, 1),
        (3, 2016, None, None, 60.0, None, None, None, None, None, 0, 0),
        (9, None, None, None, None, None, None, None, None, None, 0, 0),
        (None, 2030, 1, None, None, None, None, None, None, 1, 0, 0),
    ]
    ratios = {(r[PLACE], r.month_number): r for r in panel.collect()}
    assert ratios[1, 1].cob_month == 1.2 and ratios[1, 1].cob_accum == 1.2
    assert ratios[2, 2].cob_month == math.inf
    assert ratios[1, 2].cob_month is None


def test_events_multiply_rows_and_sums_in_parity_mode(spark):
    panel = build(spark)
    assert panel.count() == 10
    sums = {r.month_number: r for r in C.doses_by_month(panel, range(2016, 2022)).collect()}
    assert sums[2].vacc_vip_3_dose == 16 and sums[1].vacc_vip_3_dose == 2
    assert (sums[2].Ano, sums[2].vacc_total_k) == ("2016", 0.05)


def test_repeated_place_and_month_needs_join_mode(spark):
    base = P.monthly_base(series(spark))
    doubled = population(spark).union(population(spark).filter("cod_mun = 1 and year = 2016"))
    with pytest.raises(PySparkException, match="repeats a key"):
        P.build_panel(base, doubled, attributes(spark), events(spark), duplicates="raise").collect()
    panel = P.build_panel(base, doubled, attributes(spark), events(spark), event_mode="collapse")
    of_one = panel.filter("cod_mun = 1 and year = 2016")
    assert rows(of_one, "month_number") == [(1,), (1,), (2,), (2,), (3,), (3,)]
    # January's two copies accumulate one after the other; February is missing.
    assert rows(of_one.filter("month_number = 1"), "vacc_accum") == [(12,), (24,)]


def test_repeated_month_in_the_base_fails(spark):
    base = P.monthly_base(series(spark))
    doubled = base.union(base.filter("month = 'mar'"))
    with pytest.raises(PySparkException, match="repeats a month"):
        P.build_panel(doubled, population(spark), attributes(spark), events(spark), duplicates="raise").collect()
    panel = P.build_panel(doubled, population(spark), attributes(spark), events(spark), event_mode="collapse")
    assert panel.count() == build(spark, event_mode="collapse").count() + base.filter("month = 'mar'").count()


def test_national_series(spark):
    got = C.coverage_series(build(spark, event_mode="collapse"))
    # Population-only rows (no month) go at the end; February sums skip the missing cell of place 1.
    assert rows(got, "date", "time", "vacc_total", "pop", "vacc_accum") == [
        (dt.date(2016, 1, 1), 1, 12, 120.0, 12),
        (dt.date(2016, 2, 1), 2, 25, 120.0, 37),
        (dt.date(2016, 3, 1), 3, 34, 120.0, 71),
    ]
    last = got.filter("time = 3").first()
    assert (last.cob_month, last.cob_accum) == (3.4, 71 / 30)


def test_series_by_attribute(spark):
    got = C.coverage_series(build(spark, event_mode="collapse"), group="win", labels={1: "more", 0: "less"})
    assert rows(got, "win", "month_number", "vacc_total", "vacc_accum", "Votos") == [
        (0, 2, 25, 25, "less"), (1, 1, 12, 12, "more"), (1, 2, 0, 12, "more"), (1, 3, 34, 46, "more"),
    ]
    # A zero population gives an infinite ratio, which counts as complete.
    assert got.filter("win = 0").first().cob_month == math.inf


def test_running_sums_restart_each_year(spark):
    base = spark.createDataFrame(
        [(1, y, m, 1, 1, 1, n) for y in (2016, 2017) for n, m in ((1, "jan"), (2, "fev"))],
        "cod_mun int, year int, month string, vacc_hx_3_dose bigint, vacc_vip_3_dose bigint, vacc_vop_3_dose bigint, month_number int",
    )
    pop = spark.createDataFrame([(2016, 1, 12.0), (2017, 1, 12.0)], "year int, cod_mun int, pop double")
    panel = P.build_panel(base, pop, attributes(spark), events(spark), event_mode="collapse")
    assert rows(C.coverage_series(panel), "year", "month_number", "vacc_accum") == [
        (2016, 1, 2), (2016, 2, 4), (2017, 1, 2), (2017, 2, 4),
    ]


def test_event_marks_and_window(spark):
    series = spark.createDataFrame([(dt.date(2021, m, 1),) for m in (6, 7, 11, 12)], "date date")
    days = [dt.date(2021, 6, 9), dt.date(2021, 6, 17), dt.date(2021, 12, 2), dt.date(2021, 12, 7), dt.date(2021, 12, 7)]
    marks = spark.createDataFrame([(d,) for d in days], "event_date date")
    assert rows(C.annotate_events(series, marks), "date", "n_events", "event_days") == [
        (dt.date(2021, 6, 1), 2, "9,17"), (dt.date(2021, 7, 1), 0, None),
        (dt.date(2021, 11, 1), 0, None), (dt.date(2021, 12, 1), 3, "2,7"),
    ]
    # Marks after the last date of the axis are not drawn.
    window = C.event_window(series, marks, dt.date(2021, 7, 1), dt.date(2021, 12, 1))
    assert rows(window, "n_events") == [(0,), (0,), (0,)]
    assert rows(C.mark_cutoff(series, dt.date(2021, 11, 1)), "after") == [(0,), (0,), (1,), (1,)]
    assert rows(C.percent(spark.createDataFrame([(0.5,)], "x double"), "x")) == [(50.0,)]


@pytest.mark.parametrize("duplicates", ["auto", "raise", "join"])
def test_reconciliation_keeps_both_sides(spark, duplicates):
    base = P.monthly_base(series(spark))
    annual = spark.createDataFrame([(2016, 1, 50.0), (2016, None, 70.0), (2015, 1, 0.0)], "year int, cod_mun int, vacc_cob_polio double")
    got = reconcile(base, annual, ["year", PLACE], thousands=True, duplicates=duplicates)
    assert rows(got, "year", PLACE, "vacc_hx_3_dose", "vacc_total", "vacc_cob_polio", "diff_vacc", "perc_diff", "vacc_cob_polio_k") == [
        (2015, 1, None, None, 0.0, None, None, 0.0),
        (2016, 1, 1, 49, 50.0, -1.0, -2.0, 0.05),
        (2016, 2, 0, 25, None, None, None, None),
        (2016, None, None, None, 70.0, None, None, 0.07),
    ]


def test_months_add_up_to_the_year(spark):
    panel = build(spark, event_mode="collapse")
    complete = panel.filter("vacc_accum is not null").groupBy("year", PLACE).agg(
        F.sum("vacc_total").alias("months"), F.max("vacc_accum").alias("last")
    )
    assert all(r.months == r.last for r in complete.filter("cod_mun = 2").collect())


def test_event_without_a_month_matches_rows_without_a_month(spark):
    odd = events(spark).union(spark.createDataFrame([(2016, None, dt.date(2016, 7, 7))], events(spark).schema))
    base = P.monthly_base(series(spark))
    panel = P.build_panel(base, population(spark), attributes(spark), odd, event_mode="collapse")
    matched = panel.filter("month_number is null and year = 2016")
    assert rows(matched, PLACE, "event_date") == [(3, dt.date(2016, 7, 7))]


def test_running_doses_follow_the_files(spark, tmp_path):
    """Cells in the order of a full join of the files on the label: lines of the first, then those only later files have."""
    header = "Município;2016/Fev;2016/Jan;Total"
    files = {
        "a.csv": [header, "12 Two;1;2;3", "11 One;10;20;30", "13 Three;5;6;11"],
        "b.csv": ["Município;2016/Mar;Total", "11 ONE;100;100", "12 Two;7;7", "14 Four;8;8"],
    }
    for name, lines in files.items():
        (tmp_path / name).write_bytes("\n".join(lines).encode("latin-1"))
    long = ingest.ingest_series(spark, "x", str(tmp_path), order="at").orderBy("at").collect()
    expected = [
        (12, "fev", 1), (12, "jan", 2), (12, "mar", 7), (11, "fev", 10), (11, "jan", 20), (11, "mar", None),
        (13, "fev", 5), (13, "jan", 6), (13, "mar", None), (11, "fev", None), (11, "jan", None), (11, "mar", 100),
        (14, "fev", None), (14, "jan", None), (14, "mar", 8),
    ]
    assert [(r.cod_mun, r.month, r.vacc_x) for r in long] == expected
    base = P.monthly_base([ingest.ingest_series(spark, "x", str(tmp_path), order="at")])
    total = P._accumulate_any(base.withColumnRenamed("vacc_x", "vacc_total"), "cod_mun", ["at"])
    running = {(r.cod_mun, r.month, r.vacc_total): r.vacc_accum for r in total.collect()}
    assert running[(12, "fev", 1)] == 1 and running[(12, "jan", 2)] == 3 and running[(12, "mar", 7)] == 10
    assert running[(11, "jan", 20)] == 30 and running[(11, "mar", 100)] is None


def test_order_when_a_file_repeats_a_label(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Município;2016/Jan\n11 A;1\n12 B;2\n11 A;3\n", "latin-1")
    (tmp_path / "b.csv").write_text("Município;2016/Fev\n13 C;4\n11 A;5\n11 A;6\n", "latin-1")
    long = ingest.ingest_series(spark, "x", str(tmp_path), order="at").orderBy("at").collect()
    assert [(r.cod_mun, r.vacc_x) for r in long] == [
        (11, 1), (11, 5), (11, 1), (11, 6), (12, 2), (12, None), (11, 3), (11, 5), (11, 3), (11, 6), (13, None), (13, 4),
    ]


def test_order_of_lines_is_joined_before_the_cells_and_never_broadcast(spark):
    """A label's first line is as many rows as labels: by its compressed files Spark sent it to the driver."""
    tables = [
        spark.createDataFrame(lines, f"`município` string, _position long, `{year}jan` string, `{year}fev` string")
        for year, lines in ((2001, [("2 b", 1, "3", "4"), ("1 a", 2, "5", None)]), (2002, [("1 a", 1, "6", "7"), ("3 c", 2, "8", "9")]))
    ]
    long = ingest.series_long(tables, "x", place="unit", order="at")
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= 1
    found = [(r.unit, r.year, r.month, r.vacc_x) for r in long.orderBy("at").collect()]
    assert found == [
        (2, 2001, "jan", 3), (2, 2001, "fev", 4), (2, 2002, "jan", None), (2, 2002, "fev", None),
        (1, 2001, "jan", 5), (1, 2001, "fev", None), (1, 2002, "jan", 6), (1, 2002, "fev", 7),
        (3, 2001, "jan", None), (3, 2001, "fev", None), (3, 2002, "jan", 8), (3, 2002, "fev", 9),
    ]


def test_order_of_cells_holds_numbers_and_no_path(spark, tmp_path):
    """Every cell carries its place, and a sort sends samples of it to the driver: a file's path there was most of both."""
    parts = {"a/part-1.csv": ("Jan", "13 C;3"), "a/part-0.csv": ("Jan", "12 B;1", "11 A;2"), "b/part-0.csv": ("Fev", "14 D;4", "11 A;5")}
    for name, (month, *lines) in parts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join([f"Município;2016/{month}", *lines]) + "\n", "latin-1")
    long = ingest.ingest_series(spark, "x", [str(tmp_path / "a"), str(tmp_path / "b")], order="at")
    assert "string" not in long.schema["at"].dataType.simpleString()
    assert [(r.cod_mun, r.month, r.vacc_x) for r in long.orderBy("at").collect()] == [
        (12, "jan", 1), (12, "fev", None), (11, "jan", 2), (11, "fev", 5), (13, "jan", 3), (13, "fev", None),
        (14, "jan", None), (14, "fev", 4),
    ]


def test_sorted_files_sample_no_labels_to_the_driver(spark):
    lines = spark.range(1000).select(F.concat(F.lit("p"), (F.col("id") * 7919 % 1000).cast("string")).alias("label"))
    one = workload.sorted_parts(lines, 1000, "label")
    assert "rangepartitioning" not in one._jdf.queryExecution().executedPlan().toString()
    several = workload.sorted_parts(lines, 3 * workload.LINES_OF_PART - 1, "label")
    assert (one.rdd.getNumPartitions(), several.rdd.getNumPartitions()) == (1, 3)
    expected = sorted(f"p{i}" for i in range(1000))
    assert [r.label for r in one.collect()] == expected and [r.label for r in several.collect()] == expected
