"""DuckDB statements that give the same tables as ``workload.QUERIES``."""

from __future__ import annotations

from panelloom.functions.scalars import MONTHS_PT
from panelloom.workload import (
    AFTER,
    CUTOFF,
    FLAGS,
    LABELS,
    MARKERS,
    SERIES,
    STATES,
    WIN,
    WINDOW,
    YEARS,
    Y_LIMITS,
)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_MONTHS = _list(MONTHS_PT)
_VACC = ", ".join(SERIES)


def _years(low: int, high: int) -> str:
    return f"between {low} and {high}"


SHIPPED = """shipped as (
  select l_suppkey as unit, cast(year(l_shipdate) as integer) as "year",
         cast(month(l_shipdate) as integer) as month_number, *
  from lineitem)"""

_WIDE = f"""select unit, "year", {_MONTHS}[month_number] as "month",
         {", ".join(f"nullif(count(*) filter (where l_returnflag = '{f}'), 0) as {n}" for n, f in SERIES.items())},
         month_number
  from shipped"""

ALL_MONTHS = f"""{SHIPPED}, months as ({_WIDE} group by unit, "year", month_number)"""

BASE = f"""{SHIPPED}, base as (
  {_WIDE} where "year" > {AFTER} group by unit, "year", month_number)"""

# Months of each series as its yearly files give them: every place and every year of the series.
FILED = f"""{SHIPPED}, cells as (
  select l_returnflag as flag, unit, "year", month_number, count(*) as n from shipped group by all),
filed as (
  select u.flag, u.unit, y."year", m.month_number
  from (select distinct flag, unit from cells) u join (select distinct flag, "year" from cells) y on u.flag = y.flag
    cross join (select cast(unnest(range(1, 13)) as integer) as month_number) m),
long as (
  select case g.flag {" ".join(f"when '{f}' then '{n}'" for n, f in SERIES.items())} end as series,
         n, g."year", {_MONTHS}[g.month_number] as "month", g.unit + 110000 as unit
  from filed g left join cells c
    on g.flag = c.flag and g.unit = c.unit and g."year" = c."year" and g.month_number = c.month_number)"""


def _respelled(flag: str, name: str) -> str:
    return f"""select u.unit, y."year", m.month_number, n as {name}, u.first * 100 + m.month_number as place_at
  from (select unit, "year" % 2 as spelling, min("year") as first from cells where flag = '{flag}' group by 1, 2) u
    cross join (select distinct "year" from cells where flag = '{flag}') y
    cross join (select cast(unnest(range(1, 13)) as integer) as month_number) m
    left join cells c on c.flag = '{flag}' and c.unit = u.unit and c."year" = y."year"
      and c.month_number = m.month_number and c."year" % 2 = u.spelling
  where y."year" > {AFTER}"""


# A place that files of even and odd years spell differently counts as two, with one code.
RESPELLED = f"""{SHIPPED}, cells as (
  select l_returnflag as flag, unit, "year", month_number, count(*) as n from shipped group by all),
vip as ({_respelled("A", "vacc_vip_3_dose")}), vop as ({_respelled("N", "vacc_vop_3_dose")}),
base as (
  select coalesce(a.unit, b.unit) as unit, coalesce(a."year", b."year") as "year",
         {_MONTHS}[coalesce(a.month_number, b.month_number)] as "month", vacc_vip_3_dose, vacc_vop_3_dose,
         coalesce(a.month_number, b.month_number) as month_number, a.place_at as vip_at, b.place_at as vop_at
  from vip a full join vop b on a.unit = b.unit and a."year" = b."year" and a.month_number = b.month_number)"""

ORDERED = """ordered as (
  select cast(year(o_orderdate) as integer) as "year", l_suppkey as unit, l_quantity
  from lineitem join orders on l_orderkey = o_orderkey)"""

POPULATION = """population as (
  select "year", unit, cast(sum(l_quantity) as bigint) as pop from ordered group by "year", unit)"""

ANNUAL = """annual as (
  select "year", unit, count(*) as vacc_cob_polio from ordered group by "year", unit)"""

ATTRIBUTES = f"""shares as (
  select l_suppkey, count(*) filter (where l_discount >= 0.05) / count(*) as share
  from lineitem group by l_suppkey),
known as (
  select s_suppkey as unit, case when s_acctbal >= 0 then share end as share
  from supplier left join shares on s_suppkey = l_suppkey),
attributes as (select unit, share, cast(share >= {WIN} as integer) as win from known)"""

EVENTS = """days as (
  select cast(o_orderdate as date) as event_date, count(*) as n from orders group by 1),
busy as (
  select cast(year(event_date) as integer) as "year", cast(month(event_date) as integer) as month_number, event_date
  from days where n > (select avg(n) + 1.5 * stddev_samp(n) from days)),
collapsed as (
  select "year", month_number, count(*) as n_events, min(event_date) as event_date
  from busy group by "year", month_number)"""

CALENDAR = """calendar as (
  select "year", month_number, cast(row_number() over (order by "year" nulls last, month_number nulls last) as integer) as "time"
  from (select distinct "year", month_number from base))"""


def _panel(
    events: str, extra: str = "", base: str = BASE, doses: str = _VACC, order: str = "month_number"
) -> str:
    flags = ", ".join(f"case when share > {t} then 1 else 0 end as {n}" for n, t in FLAGS.items())
    return f"""{base}, {ORDERED}, {POPULATION}, {ATTRIBUTES}, {EVENTS}, {CALENDAR},
timed as (
  select b.*, c."time" from base b left join calendar c
    on b."year" is not distinct from c."year" and b.month_number is not distinct from c.month_number),
joined as (
  select coalesce(t.unit, p.unit) as unit, coalesce(t."year", p."year") as "year", t."month", {doses},
         t.month_number, t."time", p.pop
  from timed t full join population p
    on t."year" is not distinct from p."year" and t.unit is not distinct from p.unit),
goals as (
  select *, vacc_vip_3_dose + vacc_vop_3_dose as vacc_total, pop / 12.0::double as goal_month,
         (pop / 12.0::double) * month_number as goal_accum
  from joined),
running as (
  select *, case when count(*) filter (where vacc_total is null) over w = 0
            then cast(sum(vacc_total) over w as bigint) end as vacc_accum
  from goals
  window w as (partition by "year", unit order by {order} nulls last
               rows between unbounded preceding and current row)),
covered as (
  select *, vacc_accum / goal_accum as cob_accum, vacc_total / goal_month as cob_month from running),
described as (
  select coalesce(r.unit, a.unit) as unit, r.* exclude (unit), a.share, a.win
  from covered r full join attributes a on r.unit is not distinct from a.unit),
panel as (
  select coalesce(d."year", e."year") as "year", coalesce(d.month_number, e.month_number) as month_number,
         d.* exclude ("year", month_number), e.* exclude ("year", month_number), {flags}
  from described d full join {events} e
    on d."year" is not distinct from e."year" and d.month_number is not distinct from e.month_number){extra}"""


def _series(events: str = "busy", group: str = "") -> str:
    key = f", {group}" if group else ""
    label = ", case " + " ".join(f"when win = {v} then '{t}'" for v, t in LABELS.items()) + ' end as "Votos"'
    return _panel(events) + f""",
sums as (
  select "year", "time", month_number{key},
         cast(coalesce(sum(vacc_total), 0) as bigint) as vacc_total, cast(coalesce(sum(pop), 0) as bigint) as pop
  from panel where "year" {_years(YEARS[0], YEARS[-1])} group by "year", "time", month_number{key}),
series as (
  select *, pop / 12.0::double as goal_month, (pop / 12.0::double) * month_number as goal_accum,
         cast(sum(vacc_total) over (partition by "year"{key} order by "time" nulls last
              rows between unbounded preceding and current row) as bigint) as vacc_accum{label if group else ""}
  from sums),
complete as (
  select *, vacc_accum / goal_accum as cob_accum, vacc_total / goal_month as cob_month,
         make_date("year", month_number, 1) as "date",
         cast(make_date("year", month_number, 1) >= date '{CUTOFF}' as integer) as "after"
  from series
  where columns(*) is not null)"""


def _percent(column: str) -> str:
    return f"select * replace ({column} * 100 as {column}) from complete"


_MARKS = f"""marked as (
  select cast(date_trunc('month', d) as date) as "date", count(*) as n_events,
         array_to_string(list_sort(list_distinct(list(day(d)))), ',') as event_days
  from (select unnest([{", ".join(f"date '{d}'" for d in MARKERS)}]) as d) {{where}} group by 1)"""

_RECONCILED = f"""with {BASE}, {ORDERED}, {ANNUAL}, sums as (
  select "year", unit, {", ".join(f"cast(coalesce(sum({n}), 0) as bigint) as {n}" for n in SERIES)}
  from base group by "year", unit),
both_sides as (
  select coalesce(s."year", a."year") as "year", coalesce(s.unit, a.unit) as unit, {_VACC}, a.vacc_cob_polio
  from sums s full join annual a
    on s."year" is not distinct from a."year" and s.unit is not distinct from a.unit),
reconciled as (
  select *, vacc_vip_3_dose + vacc_vop_3_dose as vacc_total,
         vacc_vip_3_dose + vacc_vop_3_dose - vacc_cob_polio as diff_vacc,
         ((vacc_vip_3_dose + vacc_vop_3_dose - vacc_cob_polio) / vacc_cob_polio) * 100 as perc_diff,
         (vacc_vip_3_dose + vacc_vop_3_dose) / 1000 as vacc_total_k, vacc_cob_polio / 1000 as vacc_cob_polio_k
  from both_sides)"""

_MOMENTS = f"""{_RECONCILED}, pairs as (
  select vacc_total_k as x, vacc_cob_polio_k as y from reconciled
  where vacc_cob_polio_k between {Y_LIMITS[0]} and {Y_LIMITS[1]} and vacc_total_k is not null),
moments as (
  select count(*) as n, corr(x, y) as r, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept,
         regr_r2(y, x) as r2, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, regr_sxy(y, x) as sxy,
         avg(x) as mean_x, min(x) as min_x, max(x) as max_x
  from pairs)"""


_BAND = f"""{_MOMENTS}, grid as (
  select cast(unnest(range(80)) as integer) as step, * from moments),
points as (select *, min_x + (max_x - min_x) * step / 79 as x from grid),
line as (
  select step, x, intercept + slope * x as fit,
    sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1 / n + (x - mean_x) ** 2 / sxx)) as se from points)"""


def _tail(t: str, v: str) -> str:
    """Two-sided tail of Student's t for whole degrees of freedom: a finite sum in the angle atan(t / sqrt(v))."""
    angle, rest = f"atan(abs({t}) / sqrt({v}))", f"({v}) / (({v}) + ({t}) * ({t}))"
    even = (
        f"sin({angle}) * list_sum(list_transform(range(({v}) // 2),"
        f" lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * ({rest}) ** k))"
    )
    odd = (
        f"2 / pi() * ({angle} + sin({angle}) * cos({angle}) * coalesce(list_sum(list_transform(range((({v}) - 1) // 2),"
        f" lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * ({rest}) ** k)), 0))"
    )
    return f"(1 - case when ({v}) % 2 = 0 then {even} else {odd} end)"


def _blank_cells() -> str:
    cells = [
        f"cast(count(*) filter (where month_number = {m} and l_returnflag = '{f}') as integer)"
        for m in range(1, 13)
        for f in SERIES.values()
    ]
    return ", ".join(f'{c} as "_c{i + 1}"' for i, c in enumerate(cells))


def _one_series(flag: str, name: str) -> str:
    return f"""select unit, "year", {_MONTHS}[month_number] as "month", count(*) as {name}
      from shipped where l_returnflag = '{flag}' group by unit, "year", month_number"""


def _dose_sums(keys: str) -> str:
    sums = ", ".join(f"cast(coalesce(sum({n}), 0) as bigint) as {n}" for n in SERIES)
    return f"with {BASE} select {keys}, {sums} from base group by {keys}"


_PANEL_SUMS = ", ".join(
    f"cast(coalesce(sum({n}), 0) as bigint) as {n}" for n in [*SERIES, "vacc_total", "vacc_accum"]
)
_DOSES = f"""with {_panel("busy")}, sums as (
  select "year", month_number, {_PANEL_SUMS} from panel
  where "year" {_years(YEARS[0], YEARS[-1])} group by "year", month_number)
select *, cast("year" as varchar) as "Ano", vacc_total / 1000 as vacc_total_k from sums"""

_FOLD = f"""with {SHIPPED},
{", ".join(f"s{i} as ({_one_series(f, n)})" for i, (n, f) in enumerate(SERIES.items()))},
two as (
  select coalesce(a.unit, b.unit) as unit, coalesce(a."year", b."year") as "year",
         coalesce(a."month", b."month") as "month", {", ".join(list(SERIES)[:2])}
  from s0 a full join s1 b on a.unit = b.unit and a."year" = b."year" and a."month" = b."month"),
three as (
  select coalesce(a.unit, b.unit) as unit, coalesce(a."year", b."year") as "year",
         coalesce(a."month", b."month") as "month", {_VACC}
  from two a full join s2 b on a.unit = b.unit and a."year" = b."year" and a."month" = b."month")
select *, cast(list_position({_MONTHS}, "month") as integer) as month_number from three where "year" > {AFTER}"""

_SUMMARY = " union all ".join(
    f"""select '{n}' as variable, round(avg({n}), 8) as mean, round(stddev_samp({n}), 8) as sd,
    median(cast({n} as double)) as median from panel"""
    for n in ("vacc_vip_3_dose", "vacc_vop_3_dose")
)

ORACLE: dict[str, str] = {
    "series_long": f"""with {FILED} select series, n as vacc_dose, "year", "month", unit from long""",
    "ingest_all": f"""with {FILED} select series, unit, "year", "month", n as doses from long""",
    "ingest_incremental": f"""with {FILED} select n as vacc_vip_3_dose, "year", "month", unit, 1 as parsed
from long where series = 'vacc_vip_3_dose'""",
    "respelled_fold": f"""with {RESPELLED} select * exclude (vip_at, vop_at) replace (unit + 110000 as unit) from base""",
    "respelled_panel": f"""with {_panel("busy", base=RESPELLED, doses="vacc_vip_3_dose, vacc_vop_3_dose, vip_at, vop_at", order="vip_at nulls last, vop_at")}
select * exclude (vip_at, vop_at) from panel""",
    "annual_long": f"""with {ORDERED}, {ANNUAL}, rows_ as (
  select unit + 110000 as unit, "year", vacc_cob_polio from annual),
labels_ as (select distinct unit from rows_), years_ as (select distinct "year" from rows_)
select vacc_cob_polio, y."year", l.unit from labels_ l cross join years_ y
  left join rows_ r on r.unit = l.unit and r."year" = y."year"
union all
select cast(sum(vacc_cob_polio) as bigint), "year", null from rows_ group by "year" """,
    "denominator_long": f"""with {ORDERED}, {POPULATION},
labels_ as (select distinct unit from population), years_ as (select distinct "year" from population)
select y."year", l.unit + 110000 as unit, pop from labels_ l cross join years_ y
  left join population p on p.unit = l.unit and p."year" = y."year" """,
    "preamble_file": """with o as (
  select cast(year(o_orderdate) as integer) as "year", c_nationkey, count(*) as n
  from orders join customer on o_custkey = c_custkey group by 1, 2),
years_ as (select distinct cast(year(o_orderdate) as integer) as "year" from orders)
select y."year", cast(k.c_nationkey + 110000 as bigint) as nation, n as pop
from (select distinct c_nationkey from o) k cross join years_ y
  left join o on o.c_nationkey = k.c_nationkey and o."year" = y."year" """,
    "annual_european": f"""with {SHIPPED}
select "year", sum(l_quantity) / 8 as vacc_cob_polio from shipped where "year" > {AFTER} group by "year" """,
    "handoff_csv": f"with {ALL_MONTHS} select * from months",
    "panel_parquet": _DOSES,
    "births_by_file": f"""select o_orderkey, o_totalprice, {_list(STATES)}[c_nationkey + 1] as state,
  cast(year(o_orderdate) as integer) as "year" from orders join customer on o_custkey = c_custkey""",
    "births_row_names": f"""select o_orderkey, o_totalprice, {_list(STATES)}[c_nationkey + 1] as state,
  cast(year(o_orderdate) as integer) as "year",
  row_number() over (partition by c_nationkey, year(o_orderdate) order by o_orderkey) as row_name
from orders join customer on o_custkey = c_custkey""",
    # Every place has a line for every year, so the estimate is the difference of differences of four means.
    "place_and_year_effects": f"""with {SHIPPED}, {ATTRIBUTES},
seen as (select unit, "year", count(*) as n from shipped group by unit, "year"),
years as (select unnest(range(min("year"), max("year") + 1)) as "year" from seen),
cells as (select u.unit, y."year", coalesce(n, 0) as lines, win, y."year" >= 1999 as late
  from (select distinct unit from seen) u cross join years y join attributes using (unit)
  left join seen s on s.unit = u.unit and s."year" = y."year" where win is not null),
effect as (select (avg(lines) filter (win = 1 and late) - avg(lines) filter (win = 1 and not late))
  - (avg(lines) filter (win = 0 and late) - avg(lines) filter (win = 0 and not late)) as b,
  count(*) as n, count(distinct unit) as clusters, count(distinct "year") as periods from cells),
inner_parts as (select unit, x - avg(x) over u - avg(x) over y + avg(x) over () as dx,
  lines - avg(lines) over u - avg(lines) over y + avg(lines) over () as dy
  from (select *, case when win = 1 and late then 1.0 else 0.0 end::double as x from cells)
  window u as (partition by unit), y as (partition by "year")),
scores as (select unit, sum(dx * (dy - b * dx)) as s, sum(dx * dx) as xx from inner_parts, effect group by unit)
select 'treated' as term, round(any_value(b), 6) as estimate,
  round(sqrt(sum(s * s) * any_value(clusters / (clusters - 1.0) * (n - 1.0) / (n - 1.0 - periods))) / sum(xx), 6) as std_error,
  any_value(n) as n, any_value(clusters) as clusters from scores, effect""",
    "births_cohort": f"""with born as (
  select {_list(STATES)}[c_nationkey + 1] as state, year(o_orderdate) * 12 + month(o_orderdate) - 1 as m
  from orders join customer on o_custkey = c_custkey),
ages as (select state, m + age as m from born, (select unnest(range(12)) as age)),
months as (select unnest(range(min(m), max(m) + 1)) as m from born),
counts as (select state, m, count(*) as n from ages group by state, m)
select state, cast(m // 12 as integer) as "year", cast(m % 12 + 1 as integer) as month_number, coalesce(n, 0) as pop
from (select distinct state from born) s cross join months left join counts using (state, m)""",
    "blank_header_files": f"""with {SHIPPED}
select cast(unit as varchar) || ' - PLACE' as "_c0", {_blank_cells()}, "year" from shipped group by unit, "year" """,
    "attributes_detected": f"""with {ATTRIBUTES}
select unit + 110000 as unit, share, cast(win as double) as win from attributes""",
    "events_csv": f"""with {EVENTS} select "year", month_number, cast(event_date as varchar) as event_date from busy""",
    "text_scalars": """select doc_id, nullif(regexp_extract("text", '[0-9]+'), '') as first_number,
  nullif(regexp_extract("text", '[a-zA-Z]+'), '') as first_word,
  md5(regexp_replace("text", '/', '')) as without_slash, cast(length(lower("text")) as integer) as lower_length,
  cast(nullif(regexp_extract("text", '[0-9]+'), '') as double) as number from documents""",
    "concat_na": """select d.doc_id, source || '-' || quality as tag
  from documents d left join labels l on d.doc_id = l.doc_id""",
    "month_lookup": f"""select "month", count(*) as n,
  cast(nullif(list_position({_MONTHS}, "month"), 0) as integer) as month_number
  from (select lower(strftime(o_orderdate, '%b')) as "month" from orders) group by "month" """,
    "ieee_division": """with q as (
  select l_returnflag, case when l_tax <> 0 then l_discount / l_tax end as q, l_discount, l_tax from lineitem)
select l_returnflag, count(*) filter (where l_tax = 0 and l_discount = 0) as n_nan,
  count(*) filter (where l_tax = 0 and l_discount > 0) as n_inf, round(sum(q), 4) as finite
from q group by l_returnflag""",
    "unit_code_truncate": """select (s_suppkey + 110000) * 10 + s_suppkey % 10 as code,
  cast(substr(cast((s_suppkey + 110000) * 10 + s_suppkey % 10 as varchar), 1, 6) as bigint) as unit, s_acctbal
  from supplier""",
    "flags_and_labels": f"""with {ATTRIBUTES}
select *, {", ".join(f"case when share > {t} then 1 else 0 end as {n}" for n, t in FLAGS.items())},
  case {" ".join(f"when win = {v} then '{t}'" for v, t in LABELS.items())} end as votes from attributes""",
    "text_year_filter": f"""with {SHIPPED}
select cast("year" as double) as "year", cast(sum(l_quantity) as bigint) as q
from shipped where "year" > {AFTER} group by "year" """,
    "complete_cases": """select l_returnflag, count(*) as n from lineitem
  where not (l_tax = 0 and l_discount = 0) group by l_returnflag""",
    "date_limits": f"""with {BASE} select unit, vacc_vop_3_dose, make_date("year", month_number, 1) as "date"
  from base where make_date("year", month_number, 1) between date '{WINDOW[0]}' and date '{WINDOW[1]}'""",
    "european_text": "select o_orderkey, round(o_totalprice, 2) as price from orders",
    "months_in_one_pass": f"with {BASE} select * from base",
    "natural_full_fold": _FOLD,
    "fold_by_joins": _FOLD,
    "null_key_full_join": """with l as (
  select nullif(c_mktsegment, 'BUILDING') as segment, c_custkey from customer),
r as (select nullif(c_mktsegment, 'MACHINERY') as segment, count(*) as n_customers from customer group by 1)
select coalesce(l.segment, r.segment) as segment, c_custkey, n_customers
from l full join r on l.segment is not distinct from r.segment""",
    "order_lines_full_join": """select coalesce(o_orderkey, l_orderkey) as o_orderkey, o_custkey, o_totalprice,
  l_partkey, l_quantity from orders full join lineitem on o_orderkey = l_orderkey""",
    "calendar_index": f"""with {SHIPPED}, periods as (select distinct "year", month_number from shipped)
select *, cast(row_number() over (order by "year", month_number) as integer) as "time" from periods""",
    "densify_grid": f"""with {SHIPPED}, cells as (
  select l_returnflag, unit, "year" || {_MONTHS}[month_number] as "date", count(*) as n
  from shipped group by all)
select u.l_returnflag, u.unit, d."date", n as doses
from (select distinct l_returnflag, unit from cells) u cross join (select distinct "date" from cells) d
  left join cells c on c.l_returnflag = u.l_returnflag and c.unit = u.unit and c."date" = d."date" """,
    "arranged_places": f"with {ATTRIBUTES} select * from attributes",
    "year_state_grid": """with o as (
  select cast(year(o_orderdate) as integer) as "year", c_nationkey from orders join customer on o_custkey = c_custkey),
bounds as (select min(year(o_orderdate)) as lo, max(year(o_orderdate)) as hi from orders),
grid as (select cast(unnest(range(lo, hi + 1)) as integer) as "year", n_nationkey, n_name from bounds, nation)
select g."year", n_name as state, count(c_nationkey) as n
from grid g left join o on o."year" = g."year" and c_nationkey = n_nationkey group by g."year", n_name""",
    "births_grid": f"""with o as (
  select cast(year(o_orderdate) as integer) as "year", {_list(STATES)}[c_nationkey + 1] as state, count(*) as n
  from orders join customer on o_custkey = c_custkey group by 1, 2),
bounds as (select min(year(o_orderdate)) as lo, max(year(o_orderdate)) as hi from orders),
grid as (
  select cast("year" as integer) as "year", state
  from (select unnest(range(lo, hi + 1)) as "year" from bounds), (select unnest({_list(STATES)}) as state))
select g."year", g.state, n from grid g left join o on o."year" = g."year" and o.state = g.state""",
    "pivot_longer": f"""with {ALL_MONTHS}
select unit, "year", month_number, series, doses from
  (select * exclude ("month") from months) unpivot include nulls (doses for series in ({_VACC}))""",
    "prefix_sum_by_year": _dose_sums('"year"'),
    "prefix_sum_by_unit_year": _dose_sums('"year", unit'),
    "reconcile_national": f"""with {BASE}, {ORDERED}, second as (
  select "year", count(*) as vacc_cob_polio from ordered group by "year"),
sums as (
  select "year", {", ".join(f"cast(coalesce(sum({n}), 0) as bigint) as {n}" for n in SERIES)} from base group by "year"),
both_sides as (
  select coalesce(s."year", a."year") as "year", {_VACC}, vacc_cob_polio
  from sums s full join second a on s."year" is not distinct from a."year")
select *, vacc_vip_3_dose + vacc_vop_3_dose as vacc_total,
  vacc_vip_3_dose + vacc_vop_3_dose - vacc_cob_polio as diff_vacc,
  ((vacc_vip_3_dose + vacc_vop_3_dose - vacc_cob_polio) / vacc_cob_polio) * 100 as perc_diff from both_sides""",
    "reconcile_unit": f"{_RECONCILED} select * from reconciled",
    "reconcile_labels": f"""{_RECONCILED}, plain as (
  select "year", unit, {_VACC}, vacc_cob_polio, vacc_total, diff_vacc, perc_diff from reconciled),
totals as (select "year", cast(sum(vacc_cob_polio) as bigint) as n from annual group by "year")
select * from plain
union all select "year", null, null, null, null, n, null, null, null from totals
union all select "year", null, null, null, null, 0, null, null, null from totals""",
    "place_attributes": f"with {ATTRIBUTES} select * from attributes",
    "panel": f"with {_panel('busy')} select * from panel",
    "panel_by_joins": f"with {_panel('busy')} select * from panel",
    "panel_from_series": f"with {_panel('busy')} select * from panel",
    "running_sum_na": """with e as (
  select event_id, user_id, ts, case when value < 200 then cast(round(value * 100) as bigint) end as cents from events)
select event_id, user_id, cents, case when count(*) filter (where cents is null) over w = 0
  then cast(sum(cents) over w as bigint) end as total
from e window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""",
    "event_fanout": f"""with {BASE}, {EVENTS}
select coalesce(b."year", e."year") as "year", coalesce(b.month_number, e.month_number) as month_number,
  b.* exclude ("year", month_number), event_date
from base b full join busy e on b."year" = e."year" and b.month_number = e.month_number""",
    "event_collapse": f"""with {BASE}, {EVENTS}
select coalesce(b."year", e."year") as "year", coalesce(b.month_number, e.month_number) as month_number,
  b.* exclude ("year", month_number), n_events, event_date
from base b full join collapsed e on b."year" = e."year" and b.month_number = e.month_number""",
    "event_overlay": f"""with {SHIPPED}, {_MARKS.format(where="")}, months as (
  select make_date("year", month_number, 1) as "date", count(*) as n from shipped group by 1)
select m."date", n, coalesce(n_events, 0) as n_events, event_days, cast(m."date" >= date '{CUTOFF}' as integer) as "after"
from months m left join marked k on m."date" = k."date" """,
    "doses_by_month": _DOSES,
    "coverage_month": f"with {_series()} {_percent('cob_month')}",
    "coverage_accum": f"with {_series()} {_percent('cob_accum')}",
    "coverage_month_by_group": f"with {_series(group='win')} {_percent('cob_month')}",
    "coverage_accum_by_group": f"with {_series(group='win')} {_percent('cob_accum')}",
    "coverage_event_window": f"""with {_series("collapsed")},
{_MARKS.format(where=f"where d between date '{WINDOW[0]}' and date '{WINDOW[1]}'")}
select c.* exclude ("after") replace (cob_month * 100 as cob_month), coalesce(n_events, 0) as n_events, event_days
from complete c left join marked k on c."date" = k."date"
where c."date" between date '{WINDOW[0]}' and date '{WINDOW[1]}'""",
    "source_correlation": f"""{_MOMENTS}
select n, round(r, 6) as r, round(r * sqrt((n - 2) / (1 - r * r)), 6) as t, round(slope, 6) as slope,
  round(intercept, 6) as intercept, round(r2, 6) as r2 from moments""",
    "correlation_p_value": f"""{_MOMENTS}, tested as (
  select n, r, r * sqrt((n - 2) / (1 - r * r)) as t from moments)
select n, round(r, 6) as r, round({_tail("t", "n - 2")}, 9) + 0.0 as p from tested""",
    "regression_band": f"""{_BAND}
select step, round(x, 6) as x, round(fit, 6) as fit, round(se, 6) as se from line""",
    "regression_band_limits": f"""{_BAND.replace("with ", "with recursive ", 1)},
halved as (
  select 0 as i, 0.0::double as lo, 13.0::double as hi, n - 2 as v from moments
  union all
  select i + 1, case when over then middle else lo end, case when over then hi else middle end, v
  from (select *, (lo + hi) / 2 as middle, {_tail("(lo + hi) / 2", "v")} > 0.05 as over from halved where i < 60)),
t as (select lo from halved where i = 60)
select step, round(x, 6) as x, round(fit, 6) as fit, round(se, 6) as se, round(fit - t.lo * se, 6) as lower,
  round(fit + t.lo * se, 6) as upper from line, t""",
    "summary_stats": f"with {_panel('busy')} {_SUMMARY}",
    "median_of_prices": """select 'l_extendedprice' as variable, round(avg(l_extendedprice), 6) as mean,
  round(stddev_samp(l_extendedprice), 6) as sd, median(l_extendedprice) as median from lineitem
union all
select 'l_discount', round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), median(l_discount) from lineitem""",
    "median_sketches": f"""with {SHIPPED}
select "year", 'l_extendedprice' as variable, count(l_extendedprice) as n, true as within from shipped group by 1
union all
select "year", 'l_quantity', count(l_quantity), true from shipped group by 1""",
}
