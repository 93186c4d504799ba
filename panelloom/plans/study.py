"""The whole analysis, from the input folder to one table per figure."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from panelloom.functions.aggregates import correlation, regression_band, summary_statistics
from panelloom.operators.filters import keep_dates
from panelloom.operators.grids import event_dates
from panelloom.plans import coverage, ingest
from panelloom.plans.panel import build_panel, monthly_base
from panelloom.plans.reconcile import reconcile
from panelloom.sources.delimited import read_detected, read_european, read_events
from panelloom.sources.sinks import scratch_scope, write_partitioned, write_table


@dataclass(frozen=True)
class Settings:
    """File layout, column names and limits.

    Default column names, flags, labels, years, limits and event days are fixed values
    of the study; the paths are only a layout.
    """

    series: Mapping[str, str] = field(
        default_factory=lambda: {
            "vop_3_dose": "monthly/vop",
            "vip_3_dose": "monthly/vip",
            "hx_3_dose": "monthly/hx",
        }
    )
    national: str = "annual/national.csv"
    annual: str = "annual/places.csv"
    population: str = "population.csv"
    attributes: str = "votes.csv"
    events: str = "events.csv"
    skip: int = 5
    n_max: int | None = None
    code: str = "id_municipio"
    place: str = "cod_mun"
    second: str = "vacc_cob_polio"
    share: str = "perc_bolso"
    group: str = "win_bolso"
    flags: Mapping[str, float] = field(default_factory=lambda: {"bolso_70": 0.7, "bolso_60": 0.6})
    labels: Mapping[int, str] = field(
        default_factory=lambda: {
            1: "Mais que 50% dos votos para Bolsonaro",
            0: "Menos que 50% dos votos para Bolsonaro",
        }
    )
    after: int = 2015
    years: Sequence[int] = range(2016, 2022)
    y_limits: tuple[float, float] = (0, 150)
    cutoff: dt.date = dt.date(2019, 1, 1)
    limits: tuple[dt.date, dt.date] = (dt.date(2016, 1, 1), dt.date(2021, 12, 1))
    event_limits: tuple[dt.date, dt.date] = (dt.date(2020, 1, 1), dt.date(2021, 12, 1))
    event_days: Sequence[dt.date] = (
        dt.date(2020, 12, 17),
        dt.date(2021, 1, 22),
        dt.date(2021, 2, 11),
        dt.date(2021, 3, 4),
        dt.date(2021, 6, 9),
        dt.date(2021, 6, 17),
        dt.date(2021, 9, 2),
        dt.date(2021, 12, 2),
        dt.date(2021, 12, 7),
        dt.date(2021, 12, 7),
        dt.date(2021, 12, 24),
    )
    event_mode: str = "parity"
    duplicates: str = "auto"


def run(
    spark: SparkSession, root: str, output: str, settings: Settings | None = None
) -> dict[str, DataFrame]:
    """Write every table of the analysis below ``output`` and return them.

    Each stage reads the stored tables of the stages before it, so the raw files are
    parsed once and the panel is computed once for all the series drawn from it. What is staged in between
    is deleted at the end.
    """
    with scratch_scope(spark):
        return _run(spark, root, output, settings or Settings())


def _run(spark: SparkSession, root: str, output: str, s: Settings) -> dict[str, DataFrame]:
    tables: dict[str, DataFrame] = {}

    def put(name: str, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        path = f"{output}/{name}"
        if by:
            write_partitioned(df, path, by, mode="overwrite")
        else:
            write_table(df, path, mode="overwrite")
        tables[name] = spark.read.schema(df.schema).parquet(path).select(*df.columns)
        return tables[name]

    doses = [
        put(f"series_{name}", ingest.ingest_series(spark, name, f"{root}/{path}", duplicates=s.duplicates, place=s.place))
        for name, path in s.series.items()
    ]
    # Folders per year: the year filters of the series then skip whole folders.
    base = put("base", monthly_base(doses, s.after, s.place, s.duplicates), ["year"])
    population = ingest.ingest_denominator(spark, f"{root}/{s.population}", s.skip, s.n_max, place=s.place)
    votes = ingest.place_attributes(
        read_detected(spark, f"{root}/{s.attributes}", (s.share, s.group)), s.code, place=s.place
    )
    speeches = put("events", read_events(spark, f"{root}/{s.events}"))
    panel = put(
        "panel",
        build_panel(
            base, population, votes, speeches,
            place=s.place, share=s.share, flags=s.flags, event_mode=s.event_mode, duplicates=s.duplicates,
        ),
        ["year"],
    )

    names = ("year", s.second, "total")
    national = read_european(spark, f"{root}/{s.national}", names, str(s.after))
    annual = ingest.ingest_annual(spark, f"{root}/{s.annual}", value=s.second, place=s.place)
    put("reconciled_national", reconcile(base, national, ["year"], s.second, duplicates=s.duplicates))
    sources = put(
        "reconciled_places",
        reconcile(base, annual, ["year", s.place], s.second, thousands=True, duplicates=s.duplicates),
    )
    pairs = (sources, "vacc_total_k", f"{s.second}_k", s.y_limits)
    put("correlation", correlation(*pairs))
    put("regression_band", regression_band(*pairs))
    put("summary", summary_statistics(panel, ["vacc_vip_3_dose", "vacc_vop_3_dose"]))

    put("doses_by_month", coverage.doses_by_month(panel, s.years))
    series = put("coverage", coverage.mark_cutoff(coverage.coverage_series(panel, s.years), s.cutoff))
    by_group = coverage.coverage_series(panel, s.years, s.group, s.labels)
    by_group = put("coverage_by_group", coverage.mark_cutoff(by_group, s.cutoff))
    put("coverage_month", coverage.percent(keep_dates(series, "date", *s.limits), "cob_month"))
    put("coverage_accum", coverage.percent(series, "cob_accum"))
    put("coverage_month_by_group", coverage.percent(by_group, "cob_month"))
    put("coverage_accum_by_group", coverage.percent(by_group, "cob_accum"))
    marked = coverage.event_window(series, event_dates(spark, s.event_days), *s.event_limits)
    put("coverage_events", coverage.percent(marked, "cob_month"))
    return tables
