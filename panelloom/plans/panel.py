"""The place x month panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.scalars import divide, month_number, threshold_flag
from panelloom.functions.windows import (
    calendar_index,
    nulls_last,
    running_sum,
    running_sum_blocked,
)
from panelloom.operators.joins import (
    attach_events,
    attach_unique,
    broadcast_checked,
    fold_full,
    full_join,
    holds,
    null_safe_join,
    repeats_key,
)
from panelloom.sources.sinks import stage

PERIOD = ["year", "month_number"]
MONTH_ORDER = ["month_number", "month"]


def monthly_base(
    series: Sequence[DataFrame],
    after: int = 2015,
    place: str = "cod_mun",
    duplicates: str = "auto",
) -> DataFrame:
    """Several monthly series side by side, with the month as a number.

    The year is a key of every series, so the year filter is applied to each of
    them: Catalyst does not push it through a full join.
    """
    recent = [s.filter(F.col("year") > after) for s in series]
    folded = fold_full(recent, [place, "year", "month"], duplicates)
    return folded.withColumn("month_number", month_number("month"))


def add_goals(df: DataFrame) -> DataFrame:
    """Monthly and year-to-date targets: a twelfth of the population per month."""
    return df.withColumn("goal_month", divide("pop", F.lit(12))).withColumn(
        "goal_accum", F.col("goal_month") * F.col("month_number")
    )


def add_coverage(df: DataFrame) -> DataFrame:
    return df.withColumn("cob_accum", divide("vacc_accum", "goal_accum")).withColumn(
        "cob_month", divide("vacc_total", "goal_month")
    )


def _accumulate_any(df: DataFrame, place: str, order: Sequence[str] = ()) -> DataFrame:
    """Running doses when a place and month may repeat without bound.

    Rows that ``order`` (by default the month) leaves in a tie go by a hash of the row.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*df.columns))
    order_by = [*(order or ["month_number"]), "_hash"]
    return running_sum_blocked(hashed, "vacc_total", "vacc_accum", ["year", place], order_by).drop("_hash")


def _accumulate_months(df: DataFrame, place: str, order: Sequence[str] = ()) -> DataFrame:
    """Running doses of a place's year; a repeated month fails the job."""
    by = ["year", place]
    month = F.struct(*MONTH_ORDER)
    before = F.lag(month).over(Window.partitionBy(*by).orderBy(*nulls_last(MONTH_ORDER)))
    running = running_sum("vacc_total", by, order or MONTH_ORDER)
    return (
        df.withColumns({"vacc_accum": running, "_before": before})
        .filter(holds(~F.col("_before").eqNullSafe(month), "build_panel: a place repeats a month"))
        .drop("_before")
    )


def build_panel(
    base: DataFrame,
    population: DataFrame,
    attributes: DataFrame,
    events: DataFrame,
    place: str = "cod_mun",
    share: str = "share",
    flags: Mapping[str, float] | None = None,
    total: Sequence[str] = ("vacc_vip_3_dose", "vacc_vop_3_dose"),
    event_mode: str = "parity",
    duplicates: str = "auto",
    order: Sequence[str] = (),
) -> DataFrame:
    """Monthly base with calendar index, population, goals, coverage, attributes and events.

    All joins are full outer: population-only, attribute-only and event-only rows
    stay, with missing months or places. ``base`` and ``events`` are read several
    times, so pass stored tables.

    With unique keys the base, the population and the
    attributes are each shuffled once, by place; both attachments and the
    running sum work on that one partitioning. If a key repeats, ``duplicates='auto'`` takes exact
    many-to-many joins instead, ``'raise'`` fails the job; ``'join'`` takes them in any case.

    Running doses go by month, or by the ``order`` columns of ``base``, missing ones last: with the order columns of
    the folded series they add up in the order in which the files list the cells, as the analysis does. These columns
    do not reach the panel.
    """
    flags = flags or {"flag_70": 0.7, "flag_60": 0.6}
    if duplicates == "auto":
        population, attributes = stage(population, "population"), stage(attributes, "attributes")
        claims = (base, ["year", place, *MONTH_ORDER]), (population, ["year", place]), (attributes, [place])
        duplicates = "join" if any(repeats_key(*c) for c in claims) else "raise"
    calendar = calendar_index(base, PERIOD)
    timed = null_safe_join(base, broadcast_checked(calendar), PERIOD, "left")
    unique = duplicates == "raise"
    if unique:
        timed, population, attributes = [
            t.repartition(place) for t in (timed, population, attributes)
        ]
        joined = attach_unique(timed, population, ["year", place], MONTH_ORDER)
    else:
        # Stored, because the general join reads its inputs more than once.
        timed, population, attributes = [stage(t) for t in (timed, population, attributes)]
        joined = full_join(timed, population, ["year", place])
    doses = joined.withColumn("vacc_total", sum((F.col(c) for c in total[1:]), F.col(total[0])))
    doses = add_goals(doses)
    if unique:
        covered = add_coverage(_accumulate_months(doses, place, order).drop(*order))
        described = attach_unique(covered, attributes, [place])
    else:
        covered = stage(add_coverage(_accumulate_any(doses, place, order).drop(*order)), "covered")
        described = full_join(covered, attributes, [place])
    dated = events.filter(" or ".join(f"{k} is null" for k in PERIOD)).isEmpty()
    if dated:
        # A full year and month occurs in the panel only if it occurs in the base.
        panel = attach_events(described, events, PERIOD, event_mode, calendar)
    else:
        panel = attach_events(stage(described, "panel"), events, PERIOD, event_mode)
    for name, threshold in flags.items():
        panel = panel.withColumn(name, threshold_flag(share, threshold))
    return panel
