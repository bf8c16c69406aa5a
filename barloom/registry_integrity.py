"""Queries of the audits, alignments and small connectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import integrity, intraday, snapshot
from barloom.plans import expr
from barloom.queries import QUERIES, SQL, rounded
from barloom.registry_markets import _ROWS, _SNAP, _UNI_SQL, NEW, OLD, _rows, snapshots, trades
from barloom.registry_panels import r, with_sql
from barloom.session import read_table
from barloom.sources import connectors, panels


def _pool(s, d):
    return panels.user_day(s, d).where("close is not null").select("code", "date", "ord")


def _attributes(s, d):
    """Attributes are known at every sixth row of the calendar, for the names that traded."""
    return panels.user_day(s, d).where("ord % 6 = 0 and close is not null").select(
        "code", F.col("ord").alias("anchor"), F.when(F.col("code") % 7 == 0, "*ST n").otherwise("n").alias("name"), F.when(F.col("code") % 5 == 0, 0.0).otherwise(F.col("close")).alias("float_cap"), F.lit("i").alias("industry")
    )


_FUNNEL = f"""with {panels.USER_DAY_SQL}, po as (select code, date, ord from panel where close is not null),
at as (select code, ord as anchor, case when code % 7 = 0 then '*ST n' else 'n' end as name, case when code % 5 = 0 then 0.0::double else close end as cap from panel where ord % 6 = 0 and close is not null),
jn as (select po.code, po.date, arg_max(name, anchor) as name, arg_max(cap, anchor) as cap, max(anchor) as anchor from po left join at_ on po.code = at_.code and po.ord - at_.anchor between 0 and 4 group by 1, 2),
fu as (select date, code, case when anchor is null then 'missing' when name ilike '*st%' or name ilike 'st%' then 'st' when cap is null or cap <= 0 then 'cap' else 'ok' end as status from jn)""".replace("\nat as", "\nat_ as")
QUERIES["attribute_funnel"] = lambda s, d: rounded(integrity.attribute_funnel(_pool(s, d), _attributes(s, d)))
SQL["attribute_funnel"] = _FUNNEL + " select date::varchar as date, code, status from fu"
QUERIES["attribute_audit"] = lambda s, d: rounded(integrity.funnel_audit(integrity.attribute_funnel(_pool(s, d), _attributes(s, d))))
SQL["attribute_audit"] = _FUNNEL + " select date::varchar as date, count(*) as eligible_count, count(*) filter (status = 'missing') as missing_count, count(*) filter (status = 'st') as st_count, count(*) filter (status = 'cap') as cap_count, count(*) filter (status = 'ok') as final_count from fu group by 1"
QUERIES["audit_reconciliation"] = lambda s, d: rounded(integrity.audit_adds_up(integrity.funnel_audit(integrity.attribute_funnel(_pool(s, d), _attributes(s, d)))))
SQL["audit_reconciliation"] = _FUNNEL + " select date::varchar as date, count(*) as eligible_count, 0::bigint as missing_count, 0::bigint as st_count, 0::bigint as cap_count, 0::bigint as final_count from fu where status not in ('missing', 'st', 'cap', 'ok') group by 1"
QUERIES["content_hash"] = lambda s, d: integrity.content_hash(read_table(s, d, "orders"), ["o_orderkey"], ["o_custkey", "o_orderstatus"])
_DIGEST = "sha256(concat_ws('|', coalesce(o_orderkey::varchar, '~'), coalesce(o_custkey::varchar, '~'), coalesce(o_orderstatus, '~')))"
SQL["content_hash"] = f"with h as (select {_DIGEST} as h from orders) select count(*) as \"rows\", sum(('0x' || h[1:12])::bigint)::varchar as low, sum(('0x' || h[13:24])::bigint)::varchar as high from h"


def _minutes(s, d):
    return panels.user_day_bars(s, d).select("code", "date", F.when(F.col("volume") >= 2, "ok").otherwise("too_few_minutes").alias("reason"))


QUERIES["pool_coverage"] = lambda s, d: rounded(integrity.coverage(_pool(s, d), _minutes(s, d)))
SQL["pool_coverage"] = f"with {panels.USER_DAY_SQL} select date::varchar as date, count(*) as pool, count(*) filter (volume >= 2) as covered, {r('count(*) filter (volume >= 2) / count(*)::double', 'share')} from panel where close is not null group by 1"
QUERIES["rank_constraints"] = lambda s, d: rounded(integrity.broken_ranks(intraday.dynamic_universe(panels.brand_week(s, d), 20).where("eligible or date < '1997-01-01'"), top=20))
SQL["rank_constraints"] = _UNI_SQL + """, e as (select date, count(*) as n, max(liquidity_rank)::int as most, count(distinct liquidity_rank) as ranks, count(distinct code) as codes from u where reason = '' or date < '1997-01-01' group by 1)
select date::varchar as date, n, most, ranks, codes from e where n <> most or n <> ranks or n <> codes or n > 20"""


def _side(s, d, where):
    return _rows(s, d, where).groupBy("code", "date").agg(F.max("value").alias("value"))


for _how, _join in (("full", "full"), ("inner", "inner")):
    QUERIES[f"axis_alignment_{_how}"] = lambda s, d, h=_how: rounded(integrity.aligned(_side(s, d, OLD), _side(s, d, NEW), h))
    SQL[f"axis_alignment_{_how}"] = f"with {_ROWS}, a as (select code, date, max(value) as v from ro where nw = 0 group by 1, 2), b as (select code, date, max(value) as v from ro where nw = 1 group by 1, 2) select code, date::varchar as date, {r('a.v', 'left_value')}, {r('b.v', 'right_value')} from a {_join} join b using (code, date)"
QUERIES["threshold_verdicts"] = lambda s, d: snapshots(s, d).groupBy("market").agg(F.avg("pe").alias("m")).select("market", integrity.verdict(F.col("m"), -10.0).alias("verdict"))
SQL["threshold_verdicts"] = f"with {_SNAP} select market, case when avg(pe) is null then 'unknown' when avg(pe) >= -10 then 'met' else 'missed' end as verdict from sn group by 1"


def _nav(s, d):
    return trades(s, d).groupBy("account", "date").agg(F.round(F.sum(F.col("notional").cast("decimal(18,4)")).cast("double"), 4).alias("nav"))


QUERIES["running_drawdown"] = lambda s, d: rounded(integrity.running_drawdown(_nav(s, d)))
SQL["running_drawdown"] = f"with n as (select 'a' as account, ts::date as date, round(sum(value::decimal(18,4))::double, 4) as nav from events where event_type in ('purchase', 'click') group by 2) select account, date::varchar as date, {r('nav')}, {r('nav / max(nav) over (order by date rows between unbounded preceding and current row) - 1', 'drawdown')} from n"
QUERIES["last_orders"] = lambda s, d: rounded(integrity.last_orders(trades(s, d)).select("account", "date", "seq", "side", "notional"))
SQL["last_orders"] = f"select 'a' as account, ts::date::varchar as date, event_id as seq, case when event_type = 'click' then 'buy' else 'sell' end as side, {r('value', 'notional')} from (select * from events where event_type in ('purchase', 'click') order by ts::date desc, event_id desc limit 30)"
QUERIES["account_visible_panel"] = lambda s, d: rounded(integrity.visible_panel(panels.user_day_bars(s, d), read_table(s, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("code"))).select("code", "date", "close"))
SQL["account_visible_panel"] = f"with {panels.USER_DAY_SQL} select code, date::varchar as date, {r('close')} from panel_b where code in (select c_custkey from customer where c_mktsegment <> 'BUILDING')"
QUERIES["listed_companies"] = lambda s, d: rounded(integrity.listed(snapshots(s, d), 100.0).select("code", "name", "mc"))
SQL["listed_companies"] = f"with {_SNAP} select code, name, {r('mc')} from sn where mc >= 100 qualify row_number() over (partition by code order by mc desc, name) = 1"
QUERIES["industry_load"] = lambda s, d: connectors.industries(snapshots(s, d).select(F.col("code").cast("string").alias("code"), F.lit("").alias("ind"), "sec"))
SQL["industry_load"] = f"with {_SNAP} select code::varchar as code, min(sec) as ind from sn group by 1"


def _lookup(s, d):
    left = read_table(s, d, "nation").select(F.concat(F.col("n_name"), F.lit(".B")).alias("code"))
    table = read_table(s, d, "nation").where("n_regionkey in (0, 1)").select(F.concat(F.col("n_name"), F.lit("-B")).alias("k"), "n_nationkey").unionByName(read_table(s, d, "nation").where("n_regionkey in (1, 2)").select(F.concat(F.col("n_name"), F.lit("B")).alias("k"), (F.col("n_nationkey") + 100).alias("n_nationkey")))
    table = table.toDF("k", "v")
    return snapshot.fallback_lookup(left, table, "k", [F.col("code"), F.replace("code", F.lit("."), F.lit("-")), F.replace("code", F.lit("."), F.lit(""))], "v").select("code", F.coalesce("v", F.lit(-1)).cast("bigint").alias("v"))


QUERIES["fallback_lookup"] = _lookup
SQL["fallback_lookup"] = "select n_name || '.B' as code, (case when n_regionkey in (0, 1) then n_nationkey when n_regionkey in (1, 2) then n_nationkey + 100 else -1 end)::bigint as v from nation"


def _vendor_rows(s, d):
    e = read_table(s, d, "events")
    return e.select(F.concat(F.lpad((F.col("user_id") * 7 % 1000).cast("string"), 6, "0"), F.lit(".SZ")).alias("thscode"), F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("time"), F.when(F.col("event_id") % 7 == 0, "--").otherwise(F.col("value").cast("string")).alias("close"))


QUERIES["history_normalise"] = lambda s, d: rounded(connectors.normalised_history(_vendor_rows(s, d)))
SQL["history_normalise"] = f"select lpad((user_id * 7 % 1000)::varchar, 6, '0') as code, ts::date::varchar as date, {r('value', 'close')} from events where event_id % 10 <> 0 and event_id % 7 <> 0"
_CUT = {"adv": "mean(amount, 20, 1)"}
QUERIES["market_panel_cut"] = lambda s, d: rounded(expr.evaluate(panels.brand_week(s, d), {"keep": "b2f(orderd(mean(amount, 20, 1)) <= 5)", "adv": _CUT["adv"]}, ["code", "date"]).where("keep = 1").drop("keep"))
SQL["market_panel_cut"] = with_sql({"keep": "b2f(orderd(mean(amount, 20, 1)) <= 5)", "adv": _CUT["adv"]}) + f" select code, date::varchar as date, {r('adv')} from result where keep = 1"
