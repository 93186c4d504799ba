"""The analyses run on the star-schema tables.

A supplier stands for a place, the shipped lines per return flag for three monthly
series, the lines ordered per year for the annual second source, their quantity
for the population, the share of discounted lines for the covariate, and days with
unusually many orders for the events. Queries of the panel and what follows from it start after the
year ``AFTER``, as the analysis does; the others read their tables whole.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions.aggregates import (
    columns_with_prefix,
    correlation,
    regression_band,
    sum_by,
    summary_statistics,
)
from panelloom.functions.fixed_effects import fixed_effects
from panelloom.functions.scalars import (
    MONTHS_PT,
    code_prefix,
    divide,
    european_number,
    extract_first,
    label,
    month_number,
    month_start,
    remove_first,
    threshold_flag,
    to_number,
)
from panelloom.functions.sketches import merged_quantiles, quantile_sketches, rank_error
from panelloom.functions.windows import calendar_index, row_numbers, running_sum_blocked
from panelloom.operators.filters import complete_cases, keep_dates, text_after
from panelloom.operators.grids import event_dates, expand_years, year_state_grid
from panelloom.operators.joins import attach_events, broadcast_checked, full_join
from panelloom.operators.reshape import arrange, fill_grid, pivot_longer
from panelloom.plans import coverage, ingest, reconcile
from panelloom.plans.cohort import cohort_population
from panelloom.plans.incremental import refresh, stored_series
from panelloom.plans.panel import build_panel, monthly_base
from panelloom.sources.delimited import (
    read_blank_header,
    read_detected,
    read_european,
    read_events,
    read_handoff,
    read_named_files,
    read_with_preamble,
)
from panelloom.sources.sinks import (
    scratch_path,
    stage,
    write_csv,
    write_partitioned,
    write_table,
)

PLACE = "unit"
AFTER = 1995
FIRST_DAY = dt.datetime(AFTER + 1, 1, 1)
YEARS = range(AFTER + 1, 2002)
SERIES = {"vacc_hx_3_dose": "R", "vacc_vip_3_dose": "A", "vacc_vop_3_dose": "N"}
FLAGS = {"flag_high": 0.58, "flag_mid": 0.56}
WIN = 0.55
LINES_OF_PART = 250_000
LABELS = {1: "More than 55% discounted", 0: "Less than 55% discounted"}
CUTOFF = dt.date(1999, 1, 1)
# Marker days; one is repeated and some fall after WINDOW ends.
MARKERS = [
    dt.date(*d)
    for d in (
        (1999, 2, 28), (1999, 8, 1), (1999, 8, 19), (2000, 1, 3), (2000, 1, 3), (2000, 5, 15), (2000, 5, 31),
        (2000, 10, 10), (2000, 12, 1), (2000, 12, 31), (2001, 3, 21),
    )
]
WINDOW = (dt.date(1999, 1, 1), dt.date(2000, 12, 1))
# The state codes of the parameter grid.
STATES = (
    "RO", "AC", "AM", "RR", "PA", "AP", "TO", "MA", "PI", "CE", "RN", "PB", "PE", "AL",
    "SE", "BA", "MG", "ES", "RJ", "SP", "PR", "SC", "RS", "MS", "MT", "GO", "DF",
)


# --- inputs ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS_PT]), number)


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.withColumns(
        {PLACE: F.col("l_suppkey"), "year": F.year("l_shipdate"), "month_number": F.month("l_shipdate")}
    )


def monthly_counts(lines: DataFrame) -> DataFrame:
    """All series in one pass; a place and month without lines in a series is missing there."""
    counts = [
        F.nullif(F.count_if(F.col("l_returnflag") == flag), F.lit(0)).alias(name)
        for name, flag in SERIES.items()
    ]
    return lines.groupBy(PLACE, "year", "month_number").agg(*counts)


def is_recent() -> Column:
    """After the year AFTER. A plain comparison with the date column reaches the Parquet scan; year() > n would not."""
    return F.col("l_shipdate") >= F.lit(FIRST_DAY).cast("timestamp_ntz")


def months_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three series side by side, over all years."""
    counts = monthly_counts(shipped(spark, sf_dir))
    return counts.select(PLACE, "year", month_name(F.col("month_number")).alias("month"), *SERIES, "month_number")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = monthly_counts(shipped(spark, sf_dir).filter(is_recent()))
    return counts.select(PLACE, "year", month_name(F.col("month_number")).alias("month"), *SERIES, "month_number")


def one_series(spark: SparkSession, sf_dir: str, name: str, recent: bool = False) -> DataFrame:
    lines = shipped(spark, sf_dir).filter(F.col("l_returnflag") == SERIES[name])
    if recent:
        lines = lines.filter(is_recent())
    counts = lines.groupBy(PLACE, "year", "month_number").agg(F.count("*").alias(name))
    return counts.select(PLACE, "year", month_name(F.col("month_number")).alias("month"), name)


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the year of their order; AQE splits the lines of a hot order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias(PLACE), "l_quantity")
    return lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(spark, sf_dir).groupBy("year", PLACE).agg(F.sum("l_quantity").cast("bigint").alias("pop"))


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(spark, sf_dir).groupBy("year", PLACE).agg(F.count("*").alias("vacc_cob_polio"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariate per place, unknown for places with a negative balance."""
    shares = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias(PLACE))
        .agg((F.count_if(F.col("l_discount") >= 0.05) / F.count("*")).alias("share"))
    )
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(PLACE), "s_acctbal")
    known = places.join(shares, PLACE, "left").withColumn(
        "share", F.when(F.col("s_acctbal") >= 0, F.col("share"))
    )
    return known.select(PLACE, "share", (F.col("share") >= WIN).cast("int").alias("win"))


def busy_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with more orders than the mean plus one and a half standard deviations."""
    days = (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("event_date"))
        .agg(F.count("*").alias("n"))
    )
    limit = days.agg((F.mean("n") + 1.5 * F.stddev_samp("n")).alias("limit"))
    return days.filter(F.col("n") > limit.scalar()).select(
        F.year("event_date").alias("year"), F.month("event_date").alias("month_number"), "event_date"
    )


def stored_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(base(spark, sf_dir), "base")


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(busy_days(spark, sf_dir), "events")


def panel(
    spark: SparkSession,
    sf_dir: str,
    event_mode: str = "parity",
    duplicates: str = "raise",
    months: DataFrame | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """The panel; its inputs are aggregates by their keys, so one that repeats a key is an error."""
    return build_panel(
        stored_base(spark, sf_dir) if months is None else stage(months, "base"),
        population(spark, sf_dir),
        attributes(spark, sf_dir),
        stored_events(spark, sf_dir),
        place=PLACE,
        flags=FLAGS,
        event_mode=event_mode,
        duplicates=duplicates,
        order=order,
    )


def panel_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel by the joins that allow repeated keys."""
    return panel(spark, sf_dir, duplicates="join")


def panel_from_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel on the fold of the three series."""
    return panel(spark, sf_dir, months=natural_full_fold(spark, sf_dir))


# --- ingest and sinks -----------------------------------------------------------------


def sorted_parts(df: DataFrame, n: int, column: str) -> DataFrame:
    """The ``n`` rows in order of a column, one part for so many rows.

    A sort into the session's shuffle partitions would send the driver 300 sampled keys for each, which are all keys of a
    file of tens of thousands of lines, and several files are written at once. One part needs no sample.
    """
    return df.repartitionByRange(1 + n // LINES_OF_PART, column).sortWithinPartitions(column)


def wide_files(
    spark: SparkSession, sf_dir: str, flags: Sequence[str], respelled: bool = False
) -> dict[str, list[str]]:
    """Write one wide ``;`` Latin-1 table per flag and year: labelled places, month columns, a total.

    With ``respelled`` the labels of even years are in capitals: to the ingest they are other places; the lines of a
    file then stand in the order of their labels.
    """
    months = [
        F.nullif(F.count_if(F.col("month_number") == i + 1), F.lit(0)).alias(m)
        for i, m in enumerate(MONTHS_PT)
    ]
    lines = shipped(spark, sf_dir).filter(F.col("l_returnflag").isin(*flags))
    counts = lines.groupBy("l_returnflag", PLACE, "year").agg(*months, F.count("*").alias("Total"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(PLACE), "s_name")
    name = F.when(F.lit(respelled) & (F.col("year") % 2 == 0), F.upper("s_name")).otherwise(F.col("s_name"))
    place = F.concat((F.col(PLACE) + 110000).cast("string"), F.lit(" "), name)
    path = scratch_path(spark, "wide")
    write_partitioned(
        counts.join(names.hint("merge"), PLACE).withColumn("Município", place).drop(PLACE, "s_name"), path, ["l_returnflag", "year"]
    )
    wide = spark.read.parquet(path)
    found = wide.groupBy("l_returnflag", "year").agg(F.count("*").alias("n")).collect()

    def write_file(flag: str, year: int, n: int) -> str:
        headed = [F.col(m).alias(f"{year}/{m.title()}") for m in MONTHS_PT]
        chosen = wide.filter((F.col("l_returnflag") == flag) & (F.col("year") == year))
        file = scratch_path(spark, f"wide-{flag}-{year}")
        if respelled:
            chosen = sorted_parts(chosen, n, "Município")
        chosen.select("Município", *headed, "Total").write.csv(
            file, sep=";", header=True, encoding="ISO-8859-1", nullValue="-"
        )
        return file

    with ThreadPoolExecutor(8) as pool:
        files = list(pool.map(lambda r: write_file(*r), found))
    return {f: [p for r, p in sorted(zip(found, files, strict=True)) if r[0] == f] for f in flags}


def series_from_files(spark, sf_dir):
    """The three series from their files, one below the other."""
    files = wide_files(spark, sf_dir, list(SERIES.values()))
    tables = [
        ingest.ingest_series(spark, "dose", files[flag], place=PLACE).withColumn("series", F.lit(name))
        for name, flag in SERIES.items()
    ]
    long = reduce(DataFrame.unionByName, tables)
    return long.withColumn("vacc_dose", F.col("vacc_dose").cast("bigint"))


def ingested_series(spark, sf_dir):
    """The whole ingest: every series from its files to its stored table."""
    files = wide_files(spark, sf_dir, list(SERIES.values()))
    output = scratch_path(spark, "ingested")
    series = {name: files[flag] for name, flag in SERIES.items()}
    ingest.ingest_all(spark, series, output, place=PLACE)
    tables = [
        spark.read.parquet(f"{output}/{name}.parquet").select(
            F.lit(name).alias("series"), PLACE, "year", "month", F.col(f"vacc_{name}").cast("bigint").alias("doses")
        )
        for name in SERIES
    ]
    return reduce(DataFrame.unionByName, tables)


def incremental_series(spark, sf_dir):
    """One series from a store that first knew all files but the last year's, and how many the second run parsed."""
    files = wide_files(spark, sf_dir, ["A"])["A"]
    store = scratch_path(spark, "store")
    refresh(spark, files[:-1], store)
    parsed = refresh(spark, files, store).parsed
    long = stored_series(spark, store, "vip_3_dose", place=PLACE)
    return long.withColumns({"vacc_vip_3_dose": F.col("vacc_vip_3_dose").cast("bigint"), "parsed": F.lit(parsed)})


RESPELLED_ORDER = ["_order_vip_3_dose", "_order_vop_3_dose"]


def _respelled(spark, sf_dir):
    """Two series from files that spell places two ways, folded: each spelling is a place, codes repeat."""
    files = wide_files(spark, sf_dir, ["A", "N"], respelled=True)
    series = [
        ingest.ingest_series(spark, name, files[flag], place=PLACE, order=f"_order_{name}")
        for name, flag in (("vip_3_dose", "A"), ("vop_3_dose", "N"))
    ]
    folded = monthly_base(series, after=AFTER, place=PLACE)
    return folded.withColumns({c: F.col(c).cast("bigint") for c in ("vacc_vip_3_dose", "vacc_vop_3_dose")})


def respelled_base(spark, sf_dir):
    return _respelled(spark, sf_dir).drop(*RESPELLED_ORDER)


def respelled_panel(spark, sf_dir):
    """The panel on such a base; running doses of the repeated months go in the order of the files' cells."""
    months = _respelled(spark, sf_dir).withColumn(PLACE, F.col(PLACE) - 110000)
    return panel(spark, sf_dir, duplicates="auto", months=months, order=RESPELLED_ORDER)


def annual_from_wide(spark, sf_dir):
    """Annual source in its wide form, with a totals row whose label holds no code."""
    counts = stage(annual(spark, sf_dir), "annual")
    first, last = counts.agg(F.min("year"), F.max("year")).first()
    years = [F.sum(F.when(F.col("year") == y, F.col("vacc_cob_polio"))).alias(str(y)) for y in range(first, last + 1)]
    labelled = counts.withColumn("Município", F.concat((F.col(PLACE) + 110000).cast("string"), F.lit(" PLACE")))
    per_place = labelled.groupBy("Município").agg(*years)
    total = counts.agg(*years).select(F.lit("Total").alias("Município"), "*")
    wide = per_place.unionByName(total).withColumn("Total", F.lit(0))
    long = ingest.annual_long(wide, place=PLACE)
    return long.withColumn("vacc_cob_polio", F.col("vacc_cob_polio").cast("bigint"))


def denominator_from_wide(spark, sf_dir):
    counts = stage(population(spark, sf_dir), "population")
    first, last = counts.agg(F.min("year"), F.max("year")).first()
    years = [F.sum(F.when(F.col("year") == y, F.col("pop"))).cast("string").alias(str(y)) for y in range(first, last + 1)]
    wide = (
        counts.withColumn("Município", F.concat((F.col(PLACE) + 110000).cast("string"), F.lit(" PLACE")))
        .groupBy("Município")
        .agg(*years)
    )
    return ingest.denominator_long(wide, place=PLACE).withColumn("pop", F.col("pop").cast("bigint"))


def preamble_file(spark, sf_dir):
    """Orders per customer segment and year as two files with a preamble and footnotes, read back.

    A file is written by one task; each holds a row per segment and nation of its half.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    per_customer = orders.groupBy("o_custkey", "year").agg(F.count("*").alias("n"))
    bounds = stage(per_customer, "per-customer")
    first, last = bounds.agg(F.min("year"), F.max("year")).first()
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")
    )
    years = [str(y) for y in range(first, last + 1)]
    cells = [
        F.coalesce(F.sum(F.when(F.col("year") == y, F.col("n"))).cast("string"), F.lit("-")).alias(str(y))
        for y in range(first, last + 1)
    ]
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    summed = bounds.join(customers, "o_custkey").groupBy("n_nationkey").agg(*cells)
    # A name with the separator in it, in quotes.
    label = F.concat(F.lit('"'), (F.col("n_nationkey") + 110000).cast("string"), F.lit("; "), "n_name", F.lit('"'))
    body = summed.join(nations, "n_nationkey").select(
        (F.col("n_nationkey") % 2).cast("int").alias("file"),
        (F.col("n_nationkey") + 100).cast("bigint").alias("at"),
        F.concat_ws(";", label, *years).alias("value"),
    )
    header = ";".join(['"Município"', *years])
    top = ["Residents", "Source: a; b", "", '"', "-", header]
    frame = [(f, i, t) for f in (0, 1) for i, t in enumerate(top)]
    frame += [(f, 2**31 + i, t) for f in (0, 1) for i, t in enumerate(("Total;1", "Source: 2001 census"))]
    lines = body.unionByName(spark.createDataFrame(frame, "file int, at bigint, value string"))
    path = scratch_path(spark, "preamble")
    ordered_lines = lines.repartition("file").sortWithinPartitions("file", "at")
    ordered_lines.select("value", "file").write.partitionBy("file").text(path)
    table_rows = read_with_preamble(spark, path, len(top) - 1, encoding="UTF-8")
    long = ingest.denominator_long(table_rows, place="nation")
    return long.withColumn("pop", F.col("pop").cast("bigint"))


def annual_european(spark, sf_dir):
    """National annual table with decimal commas, written and read back."""
    lines = shipped(spark, sf_dir)
    sums = lines.groupBy(F.col("year").cast("string").alias("Ano")).agg(F.sum("l_quantity").alias("q"))
    rows = sums.unionByName(sums.agg(F.lit("Total").alias("Ano"), F.sum("q").alias("q")))
    text = F.translate(F.format_number(F.col("q") / 8, 3), ",.", ".,")
    path = scratch_path(spark, "annual")
    rows.select("Ano", text.alias("Doses"), F.lit("0").alias("Total")).write.csv(
        path, sep=";", header=True, encoding="ISO-8859-1"
    )
    return read_european(spark, path, ("year", "vacc_cob_polio", "total"), lower=str(AFTER))


def handoff_csv(spark, sf_dir):
    path = scratch_path(spark, "handoff")
    write_csv(months_wide(spark, sf_dir), path)
    schema = f"{PLACE} bigint, year int, month string, " + ", ".join(f"{n} bigint" for n in SERIES)
    return read_handoff(spark, path, schema + ", month_number int")


def panel_parquet(spark, sf_dir):
    path = scratch_path(spark, "doses")
    write_table(coverage.doses_by_month(panel(spark, sf_dir), YEARS), path)
    return spark.read.parquet(path)


def states_of_customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("c_nationkey") + 1).alias("state"),
    )


def births_by_file(spark, sf_dir):
    """Orders written per (state, year) and read back with both taken from the folder name."""
    rows = table(spark, sf_dir, "orders").join(states_of_customers(spark, sf_dir), "o_custkey").select(
        "o_orderkey",
        "o_totalprice",
        F.concat(F.lit("DN"), "state", F.year("o_orderdate").cast("string")).alias("file"),
    )
    path = scratch_path(spark, "births")
    write_partitioned(rows, path, ["file"], fmt="csv")
    read = read_named_files(spark, path, "o_orderkey bigint, o_totalprice double")
    return read.withColumn("year", F.col("year").cast("int"))


def births_row_names(spark, sf_dir):
    """The same files with the rows of each numbered from 1, read back as the row-name column."""
    rows = table(spark, sf_dir, "orders").join(states_of_customers(spark, sf_dir), "o_custkey").select(
        F.concat(F.lit("DN"), "state", F.year("o_orderdate").cast("string")).alias("file"), "o_orderkey", "o_totalprice"
    )
    path = scratch_path(spark, "births")
    write_partitioned(row_numbers(rows, "row_name", ["file"], ["o_orderkey"]), path, ["file"], fmt="csv")
    read = read_named_files(spark, path, "row_name bigint, o_orderkey bigint, o_totalprice double")
    return read.withColumn("year", F.col("year").cast("int"))


def births_cohort(spark, sf_dir):
    """Orders of at most eleven full months of age, by state and month."""
    orders = table(spark, sf_dir, "orders").join(states_of_customers(spark, sf_dir), "o_custkey")
    return cohort_population(orders, ["state"], "o_orderdate", youngest=0, oldest=11)


def births_grid(spark, sf_dir):
    """Number of orders in every cell of the year x state grid, for all listed states."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    first, last = orders.agg(F.min("year"), F.max("year")).first()
    counts = orders.groupBy("o_custkey", "year").agg(F.count("*").alias("n"))
    per_state = (
        counts.join(states_of_customers(spark, sf_dir), "o_custkey")
        .groupBy("year", "state")
        .agg(F.sum("n").alias("n"))
    )
    grid = year_state_grid(spark, range(first, last + 1), STATES)
    return grid.join(per_state, ["year", "state"], "left")


def attributes_detected(spark, sf_dir):
    """Attributes written with tabs and seven-digit codes, read back with the separator detected."""
    code = ((F.col(PLACE) + 110000) * 10 + F.col(PLACE) % 10).alias("id")
    path = scratch_path(spark, "attributes")
    attributes(spark, sf_dir).select(code, "share", "win").write.csv(
        path, sep="\t", header=True, nullValue="NA"
    )
    votes = read_detected(spark, path, ("share", "win"))
    return ingest.place_attributes(votes, "id", place=PLACE)


def events_csv(spark, sf_dir):
    path = scratch_path(spark, "days") + ".csv"
    write_csv(busy_days(spark, sf_dir), path)
    return read_events(spark, path)


def blank_header_files(spark, sf_dir):
    """Wide yearly files of 36 unnamed columns: each month's three series side by side."""
    cells = [
        F.count_if((F.col("month_number") == m) & (F.col("l_returnflag") == flag)).alias(f"m{m}{flag}")
        for m in range(1, 13)
        for flag in SERIES.values()
    ]
    place = F.concat(F.col(PLACE).cast("string"), F.lit(" - PLACE")).alias("place")
    lines = shipped(spark, sf_dir)
    wide = lines.groupBy(PLACE, "year").agg(*cells)
    path = scratch_path(spark, "blank")
    names = [c for c in wide.columns if c not in (PLACE, "year")]
    rows = wide.select(place, *names, F.concat(F.lit("series_"), F.col("year").cast("string")).alias("file"))
    write_partitioned(rows, path, ["file"], fmt="csv")
    return read_blank_header(spark, path)


# --- scalar functions and filters -----------------------------------------------------


def text_scalars(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        extract_first(text, "[0-9]+").alias("first_number"),
        extract_first(text, "[a-zA-Z]+").alias("first_word"),
        F.md5(remove_first(text, "/")).alias("without_slash"),
        F.length(F.lower(text)).alias("lower_length"),
        to_number(extract_first(text, "[0-9]+")).alias("number"),
    )


def concat_na(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    both = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.select("doc_id", F.concat("source", F.lit("-"), F.col("quality").cast("string")).alias("tag"))


def month_lookup(spark, sf_dir):
    """Month abbreviations of two languages; those of the other language stay unmatched."""
    names = table(spark, sf_dir, "orders").select(F.lower(F.date_format("o_orderdate", "MMM")).alias("month"))
    return names.groupBy("month").agg(F.count("*").alias("n")).withColumn("month_number", month_number("month"))


def ieee_division(spark, sf_dir):
    q = divide("l_discount", "l_tax")
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", q.alias("q"))
    inf = F.col("q") == float("inf")
    return lines.groupBy("l_returnflag").agg(
        F.count_if(F.isnan("q")).alias("n_nan"),
        F.count_if(inf).alias("n_inf"),
        F.round(F.sum(F.when(~F.isnan("q") & ~inf, F.col("q"))), 4).alias("finite"),
    )


def unit_code_truncate(spark, sf_dir):
    """Seven-digit codes with a check digit cut to six."""
    code = (F.col("s_suppkey") + 110000) * 10 + F.col("s_suppkey") % 10
    coded = table(spark, sf_dir, "supplier").select(code.alias("code"), "s_acctbal")
    return coded.select("code", code_prefix("code").alias(PLACE), "s_acctbal")


def flags_and_labels(spark, sf_dir):
    places = attributes(spark, sf_dir)
    return places.select(
        "*",
        *[threshold_flag("share", limit).alias(name) for name, limit in FLAGS.items()],
        label("win", LABELS).alias("votes"),
    )


def text_year_filter(spark, sf_dir):
    """Yearly sums with a totals row, the year as text."""
    lines = shipped(spark, sf_dir)
    per_year = lines.groupBy(F.col("year").cast("string").alias("year")).agg(F.sum("l_quantity").alias("q"))
    rows = per_year.unionByName(per_year.agg(F.lit("Total").alias("year"), F.sum("q").alias("q")))
    kept = text_after(rows, "year", str(AFTER))
    return kept.select(to_number("year").alias("year"), F.col("q").cast("bigint").alias("q"))


def complete_case_counts(spark, sf_dir):
    """NaN ratios count as missing, infinite ones do not."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", divide("l_discount", "l_tax").alias("ratio"))
    return complete_cases(lines).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def date_limits(spark, sf_dir):
    months = base(spark, sf_dir).select(
        PLACE, "vacc_vop_3_dose", month_start("year", "month_number").alias("date")
    )
    return keep_dates(months, "date", *WINDOW)


def european_text(spark, sf_dir):
    prices = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.translate(F.format_number("o_totalprice", 2), ",.", ".,").alias("text")
    )
    return prices.select("o_orderkey", european_number("text").alias("price"))


# --- joins, grids, aggregates, windows ------------------------------------------------


def natural_full_fold(spark, sf_dir):
    series = [one_series(spark, sf_dir, n, recent=True) for n in SERIES]
    return monthly_base(series, after=AFTER, place=PLACE)


def fold_by_joins(spark, sf_dir):
    series = [one_series(spark, sf_dir, n, recent=True) for n in SERIES]
    return monthly_base(series, after=AFTER, place=PLACE, duplicates="join")


def null_key_full_join(spark, sf_dir):
    """Customers against segment totals; a different segment is the missing key on each side."""
    customers = table(spark, sf_dir, "customer")
    left = customers.select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "c_custkey")
    right = customers.groupBy(F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment")).agg(
        F.count("*").alias("n_customers")
    )
    return full_join(left, right, ["segment"], right_unique=True)


def order_lines_full(spark, sf_dir):
    """Orders with their lines; orders without lines and lines without an order stay."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity"
    )
    return full_join(orders, lines)


def calendar(spark, sf_dir):
    return calendar_index(shipped(spark, sf_dir))


def series_pivot(spark, sf_dir):
    """The three series, one below the other, missing cells kept."""
    wide = months_wide(spark, sf_dir).drop("month")
    return pivot_longer(wide, [PLACE, "year", "month_number"], "series", "doses", "bigint")


def densify_grid(spark, sf_dir):
    """Every place and month of each series, missing where it has no lines."""
    lines = shipped(spark, sf_dir)
    counts = lines.groupBy("l_returnflag", PLACE, "year", "month_number").agg(F.count("*").alias("doses"))
    date = F.concat(F.col("year").cast("string"), month_name(F.col("month_number"))).alias("date")
    dated = stage(counts.select("l_returnflag", PLACE, date, "doses"), "cells")
    levels = dated.agg(F.collect_set("date").alias("dates")).scalar()
    return fill_grid(dated, ["l_returnflag", PLACE], "date", levels, "doses")


def arranged_places(spark, sf_dir):
    """Places by their covariate, unknown ones last."""
    return arrange(attributes(spark, sf_dir), "win", "share", PLACE)


def year_nation_grid(spark, sf_dir):
    """Every year and nation with its number of orders, zero included."""
    orders = table(spark, sf_dir, "orders")
    # Counted per customer first, so that a hot customer reaches the join as a few rows; the one
    # scan of the orders also gives the range of years.
    counts = orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    counts = stage(counts, "counts")
    first, last = counts.agg(F.min("year"), F.max("year")).first()
    states = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    grid = expand_years(states, first, last)
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    per_state = (
        counts.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("n_nationkey", "year")
        .agg(F.sum("n").alias("n"))
    )
    return grid.join(per_state, ["n_nationkey", "year"], "left").select(
        "year", F.col("n_name").alias("state"), F.coalesce("n", F.lit(0)).alias("n")
    )


def prefix_sum_by_year(spark, sf_dir):
    months = base(spark, sf_dir)
    return sum_by(months, ["year"], columns_with_prefix(months, "vacc"))


def prefix_sum_by_unit_year(spark, sf_dir):
    months = base(spark, sf_dir)
    return sum_by(months, ["year", PLACE], columns_with_prefix(months, "vacc"))


def reconcile_national(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    per_order = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    second = (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("year")
        .agg(F.sum("n").alias("vacc_cob_polio"))
    )
    return reconcile.reconcile(base(spark, sf_dir), second, ["year"])


def reconcile_unit(spark, sf_dir):
    return reconcile.reconcile(
        base(spark, sf_dir), annual(spark, sf_dir), ["year", PLACE], thousands=True
    )


def reconcile_labels(spark, sf_dir):
    """An annual source with two labels that hold no code: their missing place repeats in each year."""
    counts = stage(annual(spark, sf_dir), "annual")
    totals = counts.groupBy("year").agg(F.sum("vacc_cob_polio").alias("vacc_cob_polio"))
    other = totals.select("year", F.lit(None).cast("bigint").alias(PLACE), "vacc_cob_polio")
    unknown = other.withColumn("vacc_cob_polio", F.lit(0).cast("bigint"))
    second = counts.unionByName(other).unionByName(unknown)
    return reconcile.reconcile(base(spark, sf_dir), second, ["year", PLACE])


# The annual totals of a place grow with its lines, not with the table.
Y_LIMITS = (0.0, 0.09)


def _moments(spark, sf_dir):
    return reconcile_unit(spark, sf_dir), "vacc_total_k", "vacc_cob_polio_k", Y_LIMITS


def source_correlation(spark, sf_dir):
    c = correlation(*_moments(spark, sf_dir))
    return c.select("n", *[F.round(v, 6).alias(v) for v in ("r", "t", "slope", "intercept", "r2")])


def correlation_p_value(spark, sf_dir):
    c = correlation(*_moments(spark, sf_dir))
    return c.select("n", F.round("r", 6).alias("r"), F.round("p", 9).alias("p"))


def band(spark, sf_dir):
    b = regression_band(*_moments(spark, sf_dir))
    return b.select("step", *[F.round(v, 6).alias(v) for v in ("x", "fit", "se")])


def band_limits(spark, sf_dir):
    b = regression_band(*_moments(spark, sf_dir))
    return b.select("step", *[F.round(v, 6).alias(v) for v in ("x", "fit", "se", "lower", "upper")])


def summary_stats(spark, sf_dir):
    rows = stage(panel(spark, sf_dir).select("vacc_vip_3_dose", "vacc_vop_3_dose"), "doses")
    stats = summary_statistics(rows, ["vacc_vip_3_dose", "vacc_vop_3_dose"])
    return stats.select("variable", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"), "median")


def median_of_prices(spark, sf_dir):
    """The exact median of continuous values, where few rows share one."""
    stats = summary_statistics(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_discount"])
    return stats.select("variable", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "median")


SKETCH_K = 800


def median_sketches(spark, sf_dir):
    """Yearly medians from sketches stored by month, and whether their ranks are within the stated error."""
    measures = ["l_extendedprice", "l_quantity"]
    lines = shipped(spark, sf_dir)
    path = scratch_path(spark, "sketches")
    write_table(quantile_sketches(lines, ["year", "month_number"], measures, SKETCH_K), path)
    medians = merged_quantiles(spark.read.parquet(path), ["year"], measures)
    # One row per year and measure, read by two branches.
    medians = stage(medians, "medians")
    values = lines.unpivot(["year"], measures, "variable", "value")
    known = values.join(broadcast_checked(medians.select("year", "variable", "estimate")), ["year", "variable"])
    ranks = known.groupBy("year", "variable").agg(
        F.count_if(F.col("value") < F.col("estimate")).alias("below"),
        F.count_if(F.col("value") <= F.col("estimate")).alias("upto"),
    )
    allowed = F.col("n") * (2 * rank_error(SKETCH_K))
    half = F.col("n") / 2
    within = (F.col("below") - allowed <= half) & (half <= F.col("upto") + allowed)
    return medians.join(ranks, ["year", "variable"]).select("year", "variable", "n", within.alias("within"))


def running_sum_na(spark, sf_dir):
    """Running cents per user; values of 200 and more are missing and end the sum."""
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "ts",
        F.when(F.col("value") < 200, F.round(F.col("value") * 100).cast("bigint")).alias("cents"),
    )
    total = running_sum_blocked(rows, "cents", "total", ["user_id"], ["ts", "event_id"])
    return total.select("event_id", "user_id", "cents", "total")


def event_fanout(spark, sf_dir):
    return attach_events(
        stored_base(spark, sf_dir), stored_events(spark, sf_dir), ["year", "month_number"]
    )


def event_collapse(spark, sf_dir):
    return attach_events(
        stored_base(spark, sf_dir), stored_events(spark, sf_dir), ["year", "month_number"], "collapse"
    )


# --- composite series -----------------------------------------------------------------


def doses_by_month(spark, sf_dir):
    return coverage.doses_by_month(panel(spark, sf_dir), YEARS)


def coverage_month(spark, sf_dir):
    series = coverage.coverage_series(panel(spark, sf_dir), YEARS)
    inside = keep_dates(series, "date", dt.date(YEARS[0], 1, 1), dt.date(YEARS[-1], 12, 1))
    return coverage.percent(coverage.mark_cutoff(inside, CUTOFF), "cob_month")


def coverage_accum(spark, sf_dir):
    series = coverage.coverage_series(panel(spark, sf_dir), YEARS)
    return coverage.percent(coverage.mark_cutoff(series, CUTOFF), "cob_accum")


def _by_group(spark, sf_dir):
    series = coverage.coverage_series(panel(spark, sf_dir), YEARS, "win", LABELS)
    return coverage.mark_cutoff(series, CUTOFF)


def coverage_month_by_group(spark, sf_dir):
    return coverage.percent(_by_group(spark, sf_dir), "cob_month")


def coverage_accum_by_group(spark, sf_dir):
    return coverage.percent(_by_group(spark, sf_dir), "cob_accum")


def event_overlay(spark, sf_dir):
    months = shipped(spark, sf_dir).groupBy(month_start("year", "month_number").alias("date")).agg(
        F.count("*").alias("n")
    )
    marked = coverage.annotate_events(months, event_dates(spark, MARKERS))
    return coverage.mark_cutoff(marked, CUTOFF)


def coverage_event_window(spark, sf_dir):
    series = coverage.coverage_series(panel(spark, sf_dir, "collapse"), YEARS)
    marked = coverage.event_window(series, event_dates(spark, MARKERS), *WINDOW)
    return coverage.percent(marked, "cob_month")


def place_and_year_effects(spark, sf_dir):
    """Lines shipped per place and year: the change from CUTOFF on in places of a high covariate against the others."""
    counts = shipped(spark, sf_dir).groupBy(PLACE, "year").agg(F.count("*").alias("lines"))
    counts = stage(counts, "counts")
    first, last = counts.agg(F.min("year"), F.max("year")).first()
    grid = fill_grid(counts, [PLACE], "year", list(range(first, last + 1)), "lines").fillna(0, ["lines"])
    treated = F.col("win") * (F.col("year") >= CUTOFF.year).cast("int")
    known = attributes(spark, sf_dir).filter(F.col("win").isNotNull())
    found = fixed_effects(grid.join(known, PLACE).withColumn("treated", treated), "lines", ["treated"], PLACE, "year")
    return found.select("term", *[F.round(c, 6).alias(c) for c in ("estimate", "std_error")], "n", "clusters")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "series_long": series_from_files,
    "ingest_all": ingested_series,
    "ingest_incremental": incremental_series,
    "respelled_fold": respelled_base,
    "respelled_panel": respelled_panel,
    "annual_long": annual_from_wide,
    "denominator_long": denominator_from_wide,
    "preamble_file": preamble_file,
    "annual_european": annual_european,
    "handoff_csv": handoff_csv,
    "panel_parquet": panel_parquet,
    "births_by_file": births_by_file,
    "births_row_names": births_row_names,
    "blank_header_files": blank_header_files,
    "attributes_detected": attributes_detected,
    "events_csv": events_csv,
    "text_scalars": text_scalars,
    "concat_na": concat_na,
    "month_lookup": month_lookup,
    "ieee_division": ieee_division,
    "unit_code_truncate": unit_code_truncate,
    "flags_and_labels": flags_and_labels,
    "text_year_filter": text_year_filter,
    "complete_cases": complete_case_counts,
    "date_limits": date_limits,
    "european_text": european_text,
    "months_in_one_pass": base,
    "natural_full_fold": natural_full_fold,
    "fold_by_joins": fold_by_joins,
    "null_key_full_join": null_key_full_join,
    "order_lines_full_join": order_lines_full,
    "calendar_index": calendar,
    "arranged_places": arranged_places,
    "densify_grid": densify_grid,
    "year_state_grid": year_nation_grid,
    "births_grid": births_grid,
    "births_cohort": births_cohort,
    "pivot_longer": series_pivot,
    "prefix_sum_by_year": prefix_sum_by_year,
    "prefix_sum_by_unit_year": prefix_sum_by_unit_year,
    "reconcile_national": reconcile_national,
    "reconcile_unit": reconcile_unit,
    "reconcile_labels": reconcile_labels,
    "place_attributes": attributes,
    "panel": panel,
    "panel_by_joins": panel_by_joins,
    "panel_from_series": panel_from_series,
    "running_sum_na": running_sum_na,
    "event_fanout": event_fanout,
    "event_collapse": event_collapse,
    "event_overlay": event_overlay,
    "doses_by_month": doses_by_month,
    "coverage_month": coverage_month,
    "coverage_accum": coverage_accum,
    "coverage_month_by_group": coverage_month_by_group,
    "coverage_accum_by_group": coverage_accum_by_group,
    "coverage_event_window": coverage_event_window,
    "source_correlation": source_correlation,
    "correlation_p_value": correlation_p_value,
    "regression_band": band,
    "regression_band_limits": band_limits,
    "place_and_year_effects": place_and_year_effects,
    "summary_stats": summary_stats,
    "median_of_prices": median_of_prices,
    "median_sketches": median_sketches,
}
