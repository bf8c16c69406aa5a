"""Queries of whole workflows: comparisons of strategies, picks, factor sheets, vendor rows; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.alphas import FORMULAS
from barloom.operators import intraday, portfolio, research, signals, strategies, suite
from barloom.plans import expr
from barloom.queries import QUERIES, SQL, rounded
from barloom.registry_markets import _UNI_SQL, simulated_inputs
from barloom.registry_panels import _AVG, BACKTEST_SQL, MASK, r, weighted_panel, with_sql
from barloom.session import read_table
from barloom.sources import panels

# --- Strategies side by side -------------------------------------------------------------

_COMPARED = {"ma_cross": {}, "mean_reversion": {}, "momentum": {"top_n": 5}, "market_neutral": {"top_n": 5}, "equal_weight": {"top_n": 10}}
QUERIES["strategy_compare"] = lambda s, d: rounded(suite.compare(weighted_panel(s, d), _COMPARED))
_METRICS = """, dd as (select *, equity / max(equity) over (order by date rows between unbounded preceding and current row) - 1 as dd from bt),
a as (select count(*) as n, arg_max(equity, date) as e, stddev_pop(net) as sd, avg(net) as m, min(dd) as dd, sum(turnover) as t from dd)"""
_TAIL = BACKTEST_SQL.split("\nhd as", 1)[1]


def _metrics_sql(name: str, formula: str) -> str:
    base = with_sql({"weight": formula, "ret": "returns / 100"}) + ",\nhd as" + _TAIL + _METRICS
    return f"""select * from ({base} select '{name}' as strategy, {r('e - 1', 'total_return')}, {r('pow(e, 252.0::double / n) - 1', 'annual_return')}, {r('sd * sqrt(252)', 'annual_vol')}, {r('(pow(e, 252.0::double / n) - 1) / (nullif(sd, 0) * sqrt(252))', 'sharpe')},
 {r('dd', 'max_drawdown')}, {r('t * 252 / n', 'annual_turnover')}, {r('m * 252 / (nullif(sd, 0) * sqrt(252))', 'daily_sharpe')} from a)"""


SQL["strategy_compare"] = "\nunion all ".join(_metrics_sql(n, strategies.FORMULAS[n](**p)) for n, p in _COMPARED.items())


def _targets(s, d):
    panel, out = panels.brand_week(s, d), None
    for name, p in _COMPARED.items():
        own = suite.targets(panel, name, **p).withColumn("strategy", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


QUERIES["strategy_targets"] = lambda s, d: rounded(_targets(s, d))
SQL["strategy_targets"] = "\nunion all ".join(f"select * from ({with_sql({'weight': strategies.FORMULAS[n](**p)})} select '{n}' as strategy, code, {r('weight')} from result where date = (select max(date) from result) and weight <> 0)" for n, p in _COMPARED.items())

# --- Picks, from panel to list -----------------------------------------------------------

#: Factors of the price and volume of one date, or few.
_PICKED = [FORMULAS[n] for n in (3, 6, 12, 33, 41, 42, 53, 54, 101)]
QUERIES["composite_picks"] = lambda s, d: rounded(research.picks(panels.brand_week(s, d), _PICKED, MASK, 10, panels.brand_week(s, d).select("code", F.concat(F.lit("name of "), "code").alias("name"))))
_PICK = {"score": research.composite_formula(_PICKED), "inside": f"b2f({MASK})"}
SQL["composite_picks"] = with_sql(_PICK) + f""", sc as (select date, code, score, row_number() over (partition by date order by round(score, 9) desc, code) as rank from result where score is not null and inside = 1)
select date::varchar as date, code, 'alpha101_composite' as model, {r('score')}, rank::int as rank, true as eligible, '' as reason, 'name of ' || code as name from sc where date = (select max(date) from sc) and rank <= 10"""

# --- Intraday factors: sheet and pools ---------------------------------------------------

_SHEET = {"reversal": "-(close - delay(close, 1))", "liquidity": "rank(amount)"}
QUERIES["factor_sheet"] = lambda s, d: rounded(intraday.evaluate_factors(panels.brand_week(s, d), _SHEET, min_count=10))


def _sheet_sql(name: str, formula: str) -> str:
    base = with_sql({"factor": formula, "p": "if(open > 0, finite(open), null())", "forward": intraday.forward_open_return(5)})
    return f"""select * from ({base},
pr as (select * from result where isfinite(factor) and isfinite(forward)),
rk as (select date, {_AVG.format(k='date', c='factor')} / count(*) over (partition by date) as a, {_AVG.format(k='date', c='forward')} / count(*) over (partition by date) as b from pr),
ic as (select date, case when stddev_pop(a) * stddev_pop(b) > 1e-12 then covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) end as ic from rk group by date having count(*) >= 10),
iv as (select date, ic, ic - (select avg(ic) from ic) as d from ic where ic is not null),
lg as (select d, {', '.join(f'lag(d, {k}) over (order by date) as l{k}' for k in range(1, 5))} from iv),
nw as (select count(*) as n, sum(d * d) + {' + '.join(f'2 * (1 - {k} / 5.0::double) * coalesce(sum(d * l{k}), 0)' for k in range(1, 5))} as v from lg),
op as (select *, p / lag(p) over (partition by code order by date) - 1 as step, lead(p) over (partition by code order by date) as entry from result),
va as (select code, ord, count(*) over (partition by date) as n, row_number() over (partition by date order by round(factor, 9), code) as r from op where isfinite(factor) and entry is not null and ord + 6 <= (select max(ord) from op)),
al as (select code, ord as cohort, greatest(0, ((r - 1) * 5 + n - 2) // (n - 1) - 1)::int as bucket, unnest(range(ord + 2, ord + 7)) as ord from va where n >= 10),
ea as (select cohort, date, bucket, avg(step) as r from al join op using (code, ord) group by 1, 2, 3), co as (select date, bucket, avg(r) as ret from ea group by 1, 2), m as (select bucket, avg(ret) as m from co group by 1)
select '{name}' as factor, {r('avg(ic)', 'ic_mean')}, {r('stddev_samp(ic)', 'ic_std')}, {r('avg(ic) / stddev_samp(ic)', 'icir')}, {r('avg((round(ic, 12) > 0)::int::double)', 'positive_ic_rate')}, {r('(select (select avg(ic) from ic) / sqrt(greatest(v, 0) / n / n) from nw)', 'ic_nw_t')},
 {r('(select max(m) filter (bucket = 4) - max(m) filter (bucket = 0) from m)', 'q5_q1_mean')}, {r('(select corr(a, b) from (select rank() over (order by bucket) as a, rank() over (order by round(m, 12)) as b from m where m is not null))', 'monotonicity')} from iv)"""


SQL["factor_sheet"] = "\nunion all ".join(_sheet_sql(n, f) for n, f in _SHEET.items())
_FOUR = {"f_rskew": "close - delay(close, 1)", "f_cpv_mean": "volume", "f_cpv_std": "high - low", "f_smart": "vwap / close"}


def _pools(s, d):
    panel = panels.brand_week(s, d)
    factors = expr.evaluate(panel, _FOUR | {"cap": "mean(amount, 20)"}, ["code", "date", "ord", "ind"])
    # Attributes come every sixth week of the calendar, so the last of the six has expired.
    attributes = factors.where("ord % 6 = 0").select("date", "code", F.col("cap").alias("float_cap"), F.col("ind").alias("industry"))
    pool = intraday.dynamic_universe(panel, 20).where("eligible").select("date", "code")
    return intraday.preprocess_panels(factors.drop("cap", "ind"), pool, attributes, 10)


QUERIES["preprocess_panels"] = lambda s, d: rounded(_pools(s, d))


def _pool_sql() -> str:
    base = _UNI_SQL + ",\n" + expr.to_sql("panel", _FOUR | {"cap": "mean(amount, 20)"}, "code, date, ord, ind").replace("panel_", "pool_").replace("pool_b", "panel_b").replace("result as", "fa as") + """,
me as (select fa.*, aa.cap as float_cap, aa.ind as industry from fa join u on u.code = fa.code and u.date = fa.date and u.reason = '' left join (select code, ord, cap, ind from fa where ord % 6 = 0) aa on aa.code = fa.code and aa.ord = fa.ord - fa.ord % 6 where fa.ord % 6 <= 4 qualify count(*) over (partition by fa.date) >= 10)"""
    for f in _FOUR:
        base += f""",
us_{f} as (select code, date, industry, -{f} as y, ln(float_cap) as x from me where isfinite({f}) and float_cap > 0 and isfinite(float_cap) and industry is not null qualify count(*) over (partition by date) >= 10),
""" + expr.to_sql(f"us_{f}", {"y1": intraday._z(intraday.winsorised_mad("y"))}, "code, date, industry, x").replace("result as", f"zz_{f} as") + f""",
dm_{f} as (select *, y1 - avg(y1) over (partition by date, industry) as yd, x - avg(x) over (partition by date, industry) as xd from zz_{f}),
rs_{f} as (select *, yd - coalesce(sum(xd * yd) over (partition by date) / nullif(case when sum(xd * xd) over (partition by date) > 1e-18 then sum(xd * xd) over (partition by date) end, 0), 0) * xd as e from dm_{f}),
re_{f} as (select code, date, case when stddev_pop(e) over (partition by date) > 1e-10 then (e - avg(e) over (partition by date)) / stddev_pop(e) over (partition by date) end as {f} from rs_{f})"""
    joins = " ".join(f"left join re_{f} on re_{f}.code = me.code and re_{f}.date = me.date" for f in _FOUR)
    return f"{base} select me.code, me.date::varchar as date, {', '.join(r(f're_{f}.{f}', f) for f in _FOUR)} from me {joins}"


SQL["preprocess_panels"] = _pool_sql()

# --- The ledger of a simulation ----------------------------------------------------------

QUERIES["trade_ledger"] = lambda s, d: rounded(portfolio.trade_ledger(*simulated_inputs(s, d)))

# --- Vendor rows -------------------------------------------------------------------------


def _pages(s, d):
    o = read_table(s, d, "orders")
    item = F.struct(
        F.col("o_custkey").cast("string").alias("SECURITY_CODE"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("NOTICE_DATE"), F.date_format(F.trunc(F.to_date("o_orderdate"), "month"), "yyyy-MM-dd").alias("REPORT_DATE"),
        F.col("o_orderstatus").alias("PREDICT_TYPE"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("ADD_AMP_LOWER"), (F.col("o_totalprice") * 2).alias("ADD_AMP_UPPER"),
    )
    pages = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("data")).alias("result"))).alias("payload")).select("payload")
    return pages.unionByName(s.createDataFrame([('{"result": null}',), ("{}",), ("no page",), (None,)], "payload string"))


QUERIES["forecast_events"] = lambda s, d: rounded(signals.forecast_events(_pages(s, d)))
SQL["forecast_events"] = f"select lpad(o_custkey::varchar, 6, '0') as code, strftime(o_orderdate, '%Y-%m-%d') as notice_date, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as report_date, o_orderstatus as type, {r('case when o_orderkey % 3 > 0 then o_totalprice end', 'amp_lower')}, {r('o_totalprice * 2', 'amp_upper')} from orders"


def _quotes(s, d):
    e, k = read_table(s, d, "events"), F.col("event_id") % 11
    return e.select(
        F.concat(F.lpad(F.col("user_id").cast("string"), 6, "0"), F.when(k == 0, ".NY").otherwise(".SZ")).alias("thscode"), F.when(k == 1, "some day").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("time"),
        F.when(k == 2, "n/a").otherwise(F.col("value").cast("string")).alias("open"), F.when(k == 3, "0").when(k == 4, "Infinity").when(k == 5, None).otherwise((F.col("value") + 1).cast("string")).alias("close"), F.col("event_id").alias("seq"),
    )


QUERIES["adjusted_daily"] = lambda s, d: rounded(signals.adjusted_daily(_quotes(s, d), read_table(s, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"))))
SQL["adjusted_daily"] = f"select lpad(user_id::varchar, 6, '0') as code, ts::date::varchar as date, {r('arg_min(value, event_id)', 'open')}, {r('arg_min(value + 1, event_id)', 'close')} from events where event_id % 11 > 5 and user_id in (select c_custkey from customer) and value > 0 and value + 1 > 0 group by user_id, ts::date"
