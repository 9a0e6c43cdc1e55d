"""SQL equivalents of the general problem queries, for DuckDB."""

from __future__ import annotations

HELD_DAILY = """
select ticker, cast(trade_date as date) as d, {cols} from stock_daily_real
where ticker is not null and trade_date is not null
qualify row_number() over (partition by ticker, cast(trade_date as date) order by created_at desc nulls last) = 1
"""

_TOTALS = """
held as (""" + HELD_DAILY.format(cols="case when isnan(volume) then null else volume end as volume, case when isnan(amount) then null else amount end as amount") + """),
span as (select ticker, min(d) as lo, max(d) as hi from held group by ticker),
days as (select ticker, lo, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as d from span),
filled as (select days.ticker, lo, days.d, coalesce(volume, 0) as v, coalesce(amount, 0) as a, case when volume is null then 0 else 1 end as has_v
           from days left join held on days.ticker = held.ticker and days.d = held.d),
totals as (select ticker, lo, d,
    sum(v) over w7 as v7, sum(v) over w30 as v30, sum(a) over w7 as a7, sum(a) over w30 as a30, sum(has_v) over w7 as n7
  from filled
  window w7 as (partition by ticker order by d rows between 6 preceding and current row),
         w30 as (partition by ticker order by d rows between 29 preceding and current row))
"""

P1_FOUND = "with " + _TOTALS + """, kinds as (
  select ticker, lo, d, 'volume' as field_name, v7 as t7, v30 as t30 from totals
  union all select ticker, lo, d, 'amount', a7, a30 from totals)
select ticker, strftime(d, '%Y-%m-%d') as trade_day, field_name, 'quiet' as kind from kinds where d >= lo + 29 and t7 = 0
union all
select ticker, strftime(d, '%Y-%m-%d'), field_name, 'surge' from kinds where d >= lo + 29 and 30 * t7 > 14 * t30
"""

P1_TOTALS = "with " + _TOTALS + """
select ticker, strftime(d, '%Y-%m-%d') as trade_day,
  v7 as volume_sum_7d, round(v7 / 7, 4) as volume_avg_7d, v30 as volume_sum_30d, round(v30 / 30, 4) as volume_avg_30d,
  a7 as amount_sum_7d, round(a7 / 7, 4) as amount_avg_7d, a30 as amount_sum_30d, round(a30 / 30, 4) as amount_avg_30d,
  cast(n7 as integer) as days_with_volume_7d
from totals
"""

P1_CORRECTED = "with " + _TOTALS + """
select ticker, strftime(d, '%Y-%m-%d') as trade_day, v7 as volume_sum_7d, v30 as volume_sum_30d, cast(n7 as integer) as days_with_volume_7d
from totals
"""

P2_FOUND = """
with ratios as (
  select distinct ticker, cast(trade_date as date) as d, 'pe' as field_name, pe as x from stock_fundamental where ticker is not null and trade_date is not null
  union select distinct ticker, cast(trade_date as date), 'pb', pb from stock_fundamental where ticker is not null and trade_date is not null),
good as (select ticker, d, field_name, case when x > 0 and x < 9999 and not isnan(x) then x end as u from ratios),
basis as (select distinct ticker, field_name from good where u is not null),
names as (
  select distinct uid, record_id, updated_at,
    case when lower(trim(factor_name)) in ('', 'nan', 'none', 'null', 'n/a', 'na', 'nil', '-', '--', '?', '??', 'unknown', 'undefined', 'missing', 'tbd', '无', '未知', '空') then null else trim(factor_name) end as nm
  from factor_lifecycle where uid is not null),
near as (
  select record_id, nm,
    last_value(nm ignore nulls) over (partition by uid order by updated_at, record_id rows between unbounded preceding and 1 preceding) as before,
    first_value(nm ignore nulls) over (partition by uid order by updated_at, record_id rows between 1 following and unbounded following) as after
  from names)
select distinct field_name, ticker || '|' || strftime(d, '%Y-%m-%d') as record_key, '' as filled
from good join basis using (ticker, field_name) where u is null
union
select 'factor_name', cast(record_id as varchar), coalesce(before, after) from near where nm is null and coalesce(before, after) is not null
"""

_DAY = r"""
coalesce(
  try_cast(case when regexp_full_match(trim({c}), '\d{{8}}([T ].*)?') then substr(trim({c}), 1, 4) || '-' || substr(trim({c}), 5, 2) || '-' || substr(trim({c}), 7, 2) end as date),
  try_cast(case when regexp_full_match(trim({c}), '\d{{4}}-\d{{1,2}}-\d{{1,2}}([T ].*)?') then regexp_extract(trim({c}), '^[0-9-]+') end as date),
  try_cast(case when regexp_full_match(trim({c}), '\d{{4}}/\d{{1,2}}/\d{{1,2}}([T ].*)?') then replace(regexp_extract(trim({c}), '^[0-9/]+'), '/', '-') end as date),
  case when regexp_full_match(trim({c}), '\d{{4}}[Qq][1-4]') then cast(last_day(make_date(cast(substr(trim({c}), 1, 4) as integer), cast(substr(trim({c}), 6, 1) as integer) * 3, 1)) as date) end)
"""

P3_FOUND = """
with q as (select distinct query_id, helper, ticker, """ + _DAY.format(c="target_date") + " as last, " + _DAY.format(c="start_date") + " as start, " + _DAY.format(c="period") + """ as period from pit_queries),
inc as (select distinct ticker, cast(f_ann_date as date) as ann, cast(end_date as date) as period from stock_income
  where report_type = '1' and f_ann_date is not null and end_date is not null and ticker is not null),
value as (select query_id, max(inc.ann) as ann, any_value(inc.period) as period from q join inc using (ticker, period) where helper = 'ValueQueryHelper' and inc.ann <= last group by query_id),
states as (select ticker, ann as known, max({'p': period, 'a': ann}) over (partition by ticker order by ann range between unbounded preceding and current row) as best from inc),
chain as (select distinct ticker, known, best from states),
steps as (select ticker, best, known, coalesce(lead(known) over (partition by ticker order by known), date '9999-01-01') as until from chain),
report as (select query_id, best from q join steps using (ticker) where helper = 'FinancialReportQueryHelper' and known <= last and last < until),
cont as (select query_id, best from q join steps using (ticker) where helper = 'ContinuousQueryHelper' and start <= last and known <= last and until > start)
select query_id, strftime(period, '%Y%m%d') as end_day, strftime(ann, '%Y%m%d') as f_ann_day from value
union select query_id, strftime(best.p, '%Y%m%d'), strftime(best.a, '%Y%m%d') from report
union select query_id, strftime(best.p, '%Y%m%d'), strftime(best.a, '%Y%m%d') from cont
"""

P6_FOUND = """
with held as (select ticker, trade_date, factor_name, factor_value from factor_values
  qualify row_number() over (partition by ticker, trade_date, factor_name order by written_at desc nulls last) = 1)
select factor_name, strftime(trade_date, '%Y-%m-%d') as trade_day,
  cast(row_number() over (partition by trade_date, factor_name order by factor_value desc, ticker) as integer) as rank_no, ticker
from held where factor_value is not null and not isnan(factor_value) and not isinf(factor_value) and ticker is not null
qualify rank_no <= 10
"""



def _effect_sql(name: str, rows: str, by: str, mean: str) -> str:
    """Tables name_g (sums of r by a column), name_c (variance components) and name (shrunken effects about a mean)."""
    return f"""{name}_g as (select field_name, {by}, count(r) as n, sum(r) as s, sum(r * r) as q from {rows} where r is not null group by 1, 2),
{name}_c as (select field_name, sum(s) / sum(n) as mean, sum(greatest(q - s * s / n, 0)) / greatest(sum(n) - count(*), 1) as noise, var_pop(s / n) as between_, avg(1.0 / n) as inverse from {name}_g group by 1),
{name} as (select field_name, {by}, (s - n * {mean}) / (n + noise / greatest(between_ - noise * inverse, noise * 1e-3, 1e-9)) as e from {name}_g join {name}_c using (field_name))"""


#: The mixed-effects prediction: time effects, group effects, both once more.
P2_FILLED = f"""
with wide as (select distinct ticker, cast(trade_date as date) as d, case when pe > 0 and pe < 9999 and not isnan(pe) then pe end as pe, case when pb > 0 and pb < 9999 and not isnan(pb) then pb end as pb
  from stock_fundamental where ticker is not null and trade_date is not null),
long as (select ticker, d, 'pe' as field_name, pe as x, ln(pe) as y from wide union all select ticker, d, 'pb', pb, ln(pb) from wide),
r1 as (select *, y as r from long), {_effect_sql('v1', 'r1', 'd', 'mean')}, mu as (select field_name, mean as mu from v1_c),
r2 as (select long.*, y - mu - coalesce(e, 0) as r from long join mu using (field_name) left join v1 using (field_name, d)), {_effect_sql('u1', 'r2', 'ticker', '0')},
r3 as (select long.*, y - mu - coalesce(e, 0) as r from long join mu using (field_name) left join u1 using (field_name, ticker)), {_effect_sql('v2', 'r3', 'd', '0')},
r4 as (select long.*, y - mu - coalesce(e, 0) as r from long join mu using (field_name) left join v2 using (field_name, d)), {_effect_sql('u2', 'r4', 'ticker', '0')}
select long.field_name, long.ticker, strftime(long.d, '%Y-%m-%d') as trade_day, round(coalesce(x, exp(mu + u2.e + coalesce(v2.e, 0))), 4) as value, x is null and u2.e is not null as filled
from long join mu using (field_name) left join u2 on u2.field_name = long.field_name and u2.ticker = long.ticker left join v2 on v2.field_name = long.field_name and v2.d = long.d
"""

ORACLES = {"p1_found": P1_FOUND, "p1_totals": P1_TOTALS, "p1_corrected": P1_CORRECTED, "p2_found": P2_FOUND, "p2_filled": P2_FILLED, "p3_found": P3_FOUND, "p6_found": P6_FOUND, "p5_ranges": "select cast(0 as bigint) as few, cast(0 as bigint) as unlike, cast(0 as bigint) as overlapping, cast(0 as bigint) as unsorted, cast(0 as bigint) as lost, cast(0 as bigint) as doubled"}
