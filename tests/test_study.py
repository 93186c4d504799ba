import datetime as dt

import pytest

from panelloom.plans.study import Settings, run
from tests.conftest import rows
from tests.test_sources import PREAMBLE, put

MONTHS = ("Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez")
PLACES = {"110001 ALTA": 1, "110002 SÃO JOÃO": 2}


def write_inputs(root):
    """Two places; each month's doses are the place's number times the series weight."""
    for name, weight in (("vop", 3), ("vip", 2), ("hx", 1)):
        for year in (2015, 2016, 2021):
            header = ";".join(["Município", *[f"{year}/{m}" for m in MONTHS], "Total"])
            lines = [";".join([p, *[str(k * weight)] * 12, str(12 * k * weight)]) for p, k in PLACES.items()]
            put(root / "monthly" / name, f"{name}_{year}.csv", "\n".join([header, *lines]) + "\n")
    cv = root / "annual"
    put(cv, "national.csv", "Ano;Doses;Total\n2015;1;1\n2016;180,0;1\n2021;1.800,0;1\nTotal;1;1\n")
    put(cv, "places.csv", "Município;2016;2021;Total\n110001 ALTA;60;61;1\n110002 SÃO JOÃO;120;118;1\nTotal;180;179;1\n")
    lines = [f"{p};{120 * k};{240 * k}" for p, k in PLACES.items()]
    put(root, "population.csv", PREAMBLE + "Município;2016;2021\n" + "\n".join(lines) + "\nTotal;1;1\nFonte\n")
    put(root, "votes.csv", "id_municipio;perc_bolso;win_bolso\n1100015;0.71;1\n1100023;0.3;0\n")
    put(root, "events.csv", "year,month_number,event_date\n2021,6,2021-06-09\n2021,6,2021-06-17\n")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("input")
    write_inputs(root)
    return run(spark, str(root), str(tmp_path_factory.mktemp("output")), Settings())


def test_panel(tables):
    panel = tables["panel"]
    # 2 places x 24 months, and June 2021 once more because it has two events.
    assert panel.count() == 50
    june = panel.filter("year = 2021 and month_number = 6 and cod_mun = 110002").first()
    assert (june.vacc_total, june.vacc_accum, june.pop, june.time) == (10, 60, 480, 18)
    assert (june.cob_month, june.cob_accum) == (0.25, 0.25)
    assert rows(panel.select("cod_mun", "bolso_70", "bolso_60").distinct()) == [(110001, 1, 1), (110002, 0, 0)]


def test_year_filter_skips_folders(tables):
    plan = tables["panel"].filter("year between 2016 and 2021")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_reconciliation(tables):
    assert rows(tables["reconciled_national"], "year", "vacc_total", "diff_vacc", "perc_diff") == [
        (2016, 180, 0, 0), (2021, 180, -1620, -90),
    ]
    assert rows(tables["reconciled_places"], "year", "cod_mun", "diff_vacc") == [
        (2016, 110001, 0), (2016, 110002, 0), (2016, None, None),
        (2021, 110001, -1), (2021, 110002, 2), (2021, None, None),
    ]
    assert tables["correlation"].first()["n"] == 4
    assert tables["regression_band"].count() == 80


def test_series(tables):
    months = tables["coverage_month"]
    assert months.count() == 24
    assert rows(months.select("year", "cob_month").distinct()) == [(2016, 50.0), (2021, 25.0)]
    # The two events double June, and with it the doses accumulated from then on.
    late = tables["coverage"].filter("year = 2021 and month_number in (5, 6, 7)")
    assert rows(late, "month_number", "vacc_accum") == [(5, 75), (6, 105), (7, 120)]
    groups = tables["coverage_accum_by_group"].filter("month_number = 5 and year = 2016")
    assert rows(groups, "win_bolso", "cob_accum", "after") == [(0, 50.0, 0), (1, 50.0, 0)]
    assert tables["doses_by_month"].filter("vacc_total_k = 0.03").count() == 1
    assert rows(tables["summary"], "variable", "median") == [("vacc_vip_3_dose", 3.0), ("vacc_vop_3_dose", 4.5)]


def test_event_marks(tables):
    marks = tables["coverage_events"].filter("n_events > 0")
    # Only 2021 has data; marks after 2021-12-01 lie outside the axis.
    assert rows(marks, "date", "n_events", "event_days") == [
        (dt.date(2021, 1, 1), 1, "22"), (dt.date(2021, 2, 1), 1, "11"), (dt.date(2021, 3, 1), 1, "4"),
        (dt.date(2021, 6, 1), 2, "9,17"), (dt.date(2021, 9, 1), 1, "2"),
    ]
