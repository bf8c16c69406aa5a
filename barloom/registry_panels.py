"""Queries of the factor algebra, research and strategies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.alphas import FORMULAS, compute_all
from barloom.operators import research, strategies
from barloom.plans import expr
from barloom.queries import NUDGE, PANELS, QUERIES, SQL, formula_query, rounded, rounded_sql
from barloom.sources import panels

# --- The algebra, one query an operator, over a panel with missing days -----------------

for _name, _f in {
    "abs": "abs(open - close)", "log": "ln(volume)", "sign": "sgn(open - close)", "signedpower": "spow(open - close, 0.5)", "rank": "rank(close)", "scale": "scale(close - open)",
    "rank_sub": "rank(open) - rank(close)", "ew_min": "min2(open, close)", "ew_max": "max2(open, close)", "delay": "delay(close, 2)", "delta": "delta(close, 2)", "ts_sum": "sum(volume, 3)",
    "ts_product": "prod(volume, 3)", "ts_stddev": "std(close, 5)", "ts_min": "tmin(low, 4)", "ts_max": "tmax(high, 4)", "ts_argmin": "targmin(low, 5)", "ts_argmax": "targmax(high, 5)",
    "ts_rank": "trank(close, 5)", "decay_linear": "decay(close, 4)", "correlation": "corr(open, volume, 5)", "covariance": "cov(open, volume, 5)", "adv": "mean(amount, 4)", "safe_div": "close / (volume - 3)",
    "where": "if(delta(close, 1) > 0, close, -open)", "bool_to_float": "b2f(delta(close, 1) > 0)",
}.items():
    formula_query(f"operator_{_name}", {"value": _f}, "user_day")
formula_query("operator_indneutralize", {"value": "indn(close)"})
formula_query("panel_brand_week", {c: c for c in ("open", "high", "low", "close", "volume", "amount", "vwap", "returns")})
formula_query("panel_user_day", {c: c for c in ("open", "high", "low", "close", "volume", "amount", "vwap", "returns")}, "user_day")
formula_query("panel_vwap_lots", {"vwap": "amount / nz(volume * 100)"})
formula_query("panel_vwap_typical", {"vwap": "(high + low + close) / 3", "amount2": "(high + low + close) / 3 * volume"})
formula_query("returns_unfilled", {"value": "close / delay(close, 1) - 1"}, "user_day")

#: All factors at once; number 84 on a log scale, as in its own query.
_ALL = {f"alpha_{n}": f"sgn({f})*ln(1+abs({f}))" if n == 84 else f for n, f in FORMULAS.items()}


def _all_alphas(s, d):
    x = F.col("alpha_84")
    return rounded(compute_all(panels.brand_week(s, d)).withColumn("alpha_84", F.signum(x) * F.log(1 + F.abs(x))))


QUERIES["alphas_compute_all"] = _all_alphas
SQL["alphas_compute_all"] = f"with {panels.BRAND_WEEK_SQL},\n{expr.to_sql('panel', _ALL)}\n{rounded_sql(list(_ALL))}"

# --- Research --------------------------------------------------------------------------

MASK = research.liquidity_mask_formula()
FACTORS = [FORMULAS[n] for n in (6, 12, 53)]
formula_query("forward_return", {"value": research.FORWARD})
formula_query("liquidity_mask", {"eligible": f"b2f({MASK})"})
formula_query("apply_mask", {"value": research.masked(FORMULAS[101], MASK)})
formula_query("winsorized_zscore", {"value": research.winsorised_z("close")})
formula_query("composite", {"value": research.masked(research.composite_formula(FACTORS), MASK)})

_FF = {"factor": FORMULAS[6], "forward": research.FORWARD}


def _ff(spark, d, name="brand_week", formulas=_FF):
    return expr.evaluate(PANELS[name][0](spark, d), formulas, ["code", "date", "ord"])


def with_sql(formulas: dict[str, str], panel: str = "brand_week", keep: str = "code, date, ord") -> str:
    return f"with {PANELS[panel][1]},\n{expr.to_sql('panel', formulas, keep)}"


_PAIR_SQL = ",\npr as (select * from result where isfinite(factor) and isfinite(forward))"
_AVG = "(rank() over (partition by {k} order by round({c}, 9)) + (count(*) over (partition by {k}, round({c}, 9)) - 1) / 2.0)::double"
_IC_SQL = _PAIR_SQL + f""",
rk as (select date, {_AVG.format(k='date', c='factor')} / count(*) over (partition by date) as a, {_AVG.format(k='date', c='forward')} / count(*) over (partition by date) as b from pr),
ic as (select date, count(*) as n, case when stddev_pop(a) * stddev_pop(b) > 1e-12 then covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) end as ic from rk group by date having count(*) >= 5)"""


def r(c: str, alias: str | None = None, d: int = 6) -> str:
    return f"round({c} + {NUDGE}, {d}) + 0.0 as {alias or c}"


QUERIES["ic_series"] = lambda s, d: rounded(research.ic_series(_ff(s, d)))
SQL["ic_series"] = with_sql(_FF) + _IC_SQL + f" select date::varchar as date, n, {r('ic')} from ic"
QUERIES["ic_stats"] = lambda s, d: rounded(research.ic_stats(research.ic_series(_ff(s, d))))
SQL["ic_stats"] = with_sql(_FF) + _IC_SQL + f" select count(ic) as days, {r('avg(ic)', 'ic_mean')}, {r('stddev_samp(ic)', 'ic_std')}, {r('avg(ic) / stddev_samp(ic)', 'icir')} from ic"
_Q_SQL = _PAIR_SQL + """,
pl as (select date, forward, count(*) over (partition by date) as n, row_number() over (partition by date order by round(factor, 9), code) as r from pr),
q as (select date, greatest(0, ((r - 1) * 5 + n - 2) // (n - 1) - 1)::int as bucket, count(*) as n, avg(forward) as mean_return from pl where n >= 5 group by all)"""
QUERIES["quantile_returns"] = lambda s, d: rounded(research.quantile_returns(_ff(s, d)))
SQL["quantile_returns"] = with_sql(_FF) + _Q_SQL + f" select date::varchar as date, bucket, n, {r('mean_return')} from q"
QUERIES["long_short_stats"] = lambda s, d: rounded(research.long_short_stats(research.quantile_returns(_ff(s, d))))
SQL["long_short_stats"] = with_sql(_FF) + _Q_SQL + f""", ls as (select date, max(mean_return) filter (bucket = 4) - max(mean_return) filter (bucket = 0) as ls from q group by date)
select count(ls) as days, {r('avg(ls) * 252', 'ls_annual')}, {r('avg(ls) / stddev_samp(ls) * sqrt(252)', 'ls_sharpe')} from ls where ls is not null"""
QUERIES["top_turnover"] = lambda s, d: rounded(research.top_turnover(_ff(s, d)))
SQL["top_turnover"] = with_sql(_FF) + f""",
h as (select ord, code, row_number() over (partition by date order by round(factor, 9) desc, code) as r, count(*) over (partition by date) as n from result where factor is not null),
t as (select ord, code from h where n >= 5 and r <= greatest(1, n // 5)),
c as (select t.ord, sum(case when p.code is null then 1 else 0 end) / count(*)::double as t from t left join t p on p.code = t.code and p.ord + 1 = t.ord where t.ord > 0 group by t.ord)
select {r('avg(t)', 'turnover')}, count(*) as days from c"""
QUERIES["factor_evaluation"] = lambda s, d: rounded(research.evaluate_factor(panels.brand_week(s, d), _FF["factor"]))
SQL["factor_evaluation"] = with_sql(_FF) + _IC_SQL + _Q_SQL.replace(_PAIR_SQL, "") + f""", ls as (select date, max(mean_return) filter (bucket = 4) - max(mean_return) filter (bucket = 0) as ls from q group by date),
h as (select ord, code, row_number() over (partition by date order by round(factor, 9) desc, code) as r, count(*) over (partition by date) as n from result where factor is not null),
t as (select ord, code from h where n >= 5 and r <= greatest(1, n // 5)),
c as (select t.ord, sum(case when p.code is null then 1 else 0 end) / count(*)::double as t from t left join t p on p.code = t.code and p.ord + 1 = t.ord where t.ord > 0 group by t.ord)
select (select count(ic) from ic) as days, {r('(select avg(ic) from ic)', 'ic_mean')}, {r('(select stddev_samp(ic) from ic)', 'ic_std')}, {r('(select avg(ic) / stddev_samp(ic) from ic)', 'icir')},
 {r('(select avg(ls) * 252 from ls)', 'ls_annual')}, {r('(select avg(ls) / stddev_samp(ls) * sqrt(252) from ls)', 'ls_sharpe')}, {r('(select avg(t) from c)', 'turnover')}"""

# Several factors at once: factor, code, date, value, forward.
_MANY = {"f6": FORMULAS[6], "f12": FORMULAS[12], "f53": FORMULAS[53], "forward": research.FORWARD}
_MANY_Z = {f"z{n}": research.winsorised_z(FORMULAS[n]) for n in (6, 12, 53)}


def _long(df, names):
    return df.select("code", "date", "forward", F.explode(F.array(*[F.struct(F.lit(n).alias("factor_name"), F.col(n).alias("factor")) for n in names])).alias("x")).select("code", "date", "forward", "x.*")


def _ic_many(s, d):
    long = _long(_ff(s, d, formulas=_MANY), ["f6", "f12", "f53"])
    return research.ic_series(long, by=("factor_name", "date")).withColumnRenamed("factor_name", "factor")


def _weights(s, d):
    return research.rolling_ic_weights(_ic_many(s, d), panels.brand_week(s, d).select("date").distinct())


_MANY_SQL = with_sql(_MANY) + ",\nlong as (" + " union all ".join(f"select '{n}' as factor_name, code, date, {n} as factor, forward from result" for n in ("f6", "f12", "f53")) + f"""),
lpr as (select * from long where isfinite(factor) and isfinite(forward)),
lrk as (select factor_name, date, {_AVG.format(k='factor_name, date', c='factor')} / count(*) over (partition by factor_name, date) as a, {_AVG.format(k='factor_name, date', c='forward')} / count(*) over (partition by factor_name, date) as b from lpr),
lic as (select factor_name as factor, date, case when stddev_pop(a) * stddev_pop(b) > 1e-12 then covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) end as ic from lrk group by 1, 2 having count(*) >= 5),
lgr as (select f.factor, d.date, ic from (select distinct factor from lic) f cross join (select distinct date from panel_b) d left join lic on lic.factor = f.factor and lic.date = d.date),
lag15 as (select *, lag(ic, 15) over (partition by factor order by date) as l from lgr),
wt as (select factor, date, case when count(l) over w >= 60 then avg(l) over w end as weight from lag15 window w as (partition by factor order by date rows between 119 preceding and current row))"""
QUERIES["rolling_ic_weights"] = lambda s, d: rounded(_weights(s, d))
SQL["rolling_ic_weights"] = _MANY_SQL + f" select factor, date::varchar as date, {r('weight')} from wt"


def _weighted(s, d):
    z = expr.evaluate(panels.brand_week(s, d), _MANY_Z, ["code", "date"])
    long = z.select("code", "date", F.explode(F.array(*[F.struct(F.lit(f"f{n}").alias("factor"), F.col(f"z{n}").alias("z")) for n in (6, 12, 53)])).alias("x")).select("code", "date", "x.*")
    return research.ic_weighted(long, _weights(s, d))


QUERIES["ic_weighted_composite"] = lambda s, d: rounded(_weighted(s, d))
SQL["ic_weighted_composite"] = _MANY_SQL.replace("result", "result1") + ",\n" + expr.to_sql("panel", _MANY_Z).replace("panel_", "zz_").replace("zz_b", "panel_b") + ",\nlz as (" + " union all ".join(f"select 'f{n}' as factor, code, date, z{n} as z from result" for n in (6, 12, 53)) + f""")
select code, date::varchar as date, {r('sum(z * weight)', 'score')} from lz join wt using (factor, date) group by all"""

_SCORE = {"score": research.composite_formula(FACTORS)}
_SCORE_SQL = with_sql(_SCORE) + """,
sc as (select date, code, score, row_number() over (partition by date order by round(score, 9) desc, code) as rank from result where score is not null)"""
QUERIES["score_table"] = lambda s, d: rounded(research.score_table(_ff(s, d, formulas=_SCORE).withColumn("ok", F.col("score") > 0), "composite", eligible="ok"))
SQL["score_table"] = _SCORE_SQL + f" select date::varchar as date, code, 'composite' as model, {r('score')}, rank::int as rank, score > 0 as eligible, case when score > 0 then '' else 'filtered' end as reason from sc"
QUERIES["pick"] = lambda s, d: rounded(research.pick(research.score_table(_ff(s, d, formulas=_SCORE), "composite"), 10).select("date", "code", "score", "rank"))
SQL["pick"] = _SCORE_SQL + f" select date::varchar as date, code, {r('score')}, rank::int as rank from sc where date = (select max(date) from sc) and rank <= 10"
QUERIES["run_models"] = lambda s, d: rounded(research.run_models(panels.brand_week(s, d), {"m101": FORMULAS[101], "m6": FORMULAS[6]}).select("date", "code", "model", "score", "rank"))
SQL["run_models"] = with_sql({"m101": FORMULAS[101], "m6": FORMULAS[6]}) + ", l as (select 'm101' as model, code, date, m101 as score from result union all select 'm6', code, date, m6 from result)" + f" select date::varchar as date, code, model, {r('score')}, (row_number() over (partition by model, date order by round(score, 9) desc, code))::int as rank from l where score is not null"


def _signals(s, d):
    scores = research.pick(research.score_table(_ff(s, d, formulas=_SCORE), "composite"), 1000)
    held = scores.where(F.col("rank").between(4, 18)).select("code", F.lit(0.04).alias("current_weight")).unionByName(s.createDataFrame([("gone00", 0.03)], "code string, current_weight double"))
    return research.trade_signals(scores, held, 5, 15).withColumn("rank", F.coalesce("rank", F.lit(-1)))


QUERIES["trade_signals"] = lambda s, d: rounded(_signals(s, d))
SQL["trade_signals"] = _SCORE_SQL + f""", l as (select code, score, rank from sc where date = (select max(date) from sc)),
h as (select code, 0.04::double as w from l where rank between 4 and 18 union all select 'gone00', 0.03),
m as (select coalesce(l.code, h.code) as code, coalesce(w, 0) as w, score, rank, coalesce(rank <= 5, false) as top, h.code is not null and not coalesce(rank <= 5, false) and coalesce(rank <= 15, false) as kept from l full join h on l.code = h.code),
n as (select count(*) filter (top or kept) as n from m)
select (select max(date) from sc)::varchar as date, 'composite' as model, code, code as name, case when top and w > 0 then 'hold' when top then 'buy' when kept then 'hold' else 'sell' end as action, {r('w', 'current_weight')}, {r('case when top or kept then least(0.05, 1.0::double / n) else 0 end', 'target_weight')}, {r('score')}, coalesce(rank, -1)::int as rank,
 case when top then 'top_rank' when kept then 'inside_sell_buffer' else 'rank_below_sell_buffer' end as reason from m, n where top or kept or w > 0"""

_FUND = {"announce": "date", "eps": "value % 7 - 3", "bvps": "value / 10", "roe": "value % 13", "ocfps": "value % 5 - 2", "gross_margin": "value % 31", "rev_yoy": "value % 17 - 8", "profit_yoy": "value % 19 - 9"}
_FUND_FIELDS = ["eps", "bvps", "roe", "ocfps", "gross_margin", "rev_yoy", "profit_yoy"]


def fundamentals(s, d):
    e = panels.read_table(s, d, "events").where("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("code"), F.to_date("ts").alias("announce"), F.col("event_id").alias("seq"), *[F.expr(_FUND[f]).alias(f) for f in _FUND_FIELDS])


_FUND_SQL = "fr as (select user_id as code, ts::date as date, event_id, " + ", ".join(f"{_FUND[f]} as {f}" for f in _FUND_FIELDS) + " from events where event_type = 'purchase'),\nfo as (select code, date, " + ", ".join(f"arg_max({f}, event_id) as {f}" for f in _FUND_FIELDS) + " from fr group by 1, 2)"
QUERIES["fundamental_panel"] = lambda s, d: rounded(research.as_of(panels.user_day(s, d).select("code", "date"), fundamentals(s, d), _FUND_FIELDS))
_ASOF = "p.code, p.date, " + ", ".join(_FUND_FIELDS) + " from panel p asof left join fo on p.code = fo.code and p.date >= fo.date"
SQL["fundamental_panel"] = f"with {panels.USER_DAY_SQL},\n{_FUND_SQL}, result as (select {_ASOF})\n{rounded_sql(_FUND_FIELDS)}"
QUERIES["fundamental_factors"] = lambda s, d: rounded(research.fundamental_factors(research.as_of(panels.user_day(s, d).select("code", "date", "close"), fundamentals(s, d), _FUND_FIELDS)))
SQL["fundamental_factors"] = f"with {panels.USER_DAY_SQL},\n{_FUND_SQL}, j as (select close, {_ASOF}), result as (select code, date, bvps / nullif(close, 0) as f_bp, eps / nullif(close, 0) as f_ep, roe as f_roe, gross_margin as f_gm, ocfps / nullif(eps, 0) as f_ocfq, rev_yoy as f_revg, profit_yoy as f_profg from j)\n" + rounded_sql(["f_bp", "f_ep", "f_roe", "f_gm", "f_ocfq", "f_revg", "f_profg"])
QUERIES["as_of_bounded"] = lambda s, d: rounded(research.as_of(panels.user_day(s, d).select("code", "date", "ord"), fundamentals(s, d), ["eps"], max_rows=4).select("code", "date", "eps"))
SQL["as_of_bounded"] = f"""with {panels.USER_DAY_SQL},\n{_FUND_SQL}, fp as (select fo.*, (select min(ord) from panel where panel.date >= fo.date) as anchor from fo),
j as (select p.code, p.date, p.ord, anchor, eps from panel p asof left join fp on p.code = fp.code and p.date >= fp.date), result as (select code, date, case when ord - anchor <= 4 then eps end as eps from j)\n{rounded_sql(['eps'])}"""
QUERIES["newey_west"] = lambda s, d: rounded(research.newey_west(research.ic_series(_ff(s, d)).withColumnRenamed("ic", "value")))
SQL["newey_west"] = with_sql(_FF) + _IC_SQL + f""", v as (select date, ic - (select avg(ic) from ic) as d from ic where isfinite(ic)), l as (select d, {', '.join(f'lag(d, {k}) over (order by date) as l{k}' for k in range(1, 5))} from v),
t as (select count(*) as n, sum(d * d) + {' + '.join(f'2 * (1 - {k} / 5.0::double) * coalesce(sum(d * l{k}), 0)' for k in range(1, 5))} as v from l)
select n, {r('(select avg(ic) from ic)', 'mean')}, {r('(select avg(ic) from ic) / sqrt(greatest(v, 0) / n / n)', 't')} from t"""

# --- Strategies ------------------------------------------------------------------------

_STRATEGIES = {
    "ma_cross": strategies.ma_cross(), "mean_reversion": strategies.mean_reversion(), "momentum": strategies.momentum(5), "market_neutral": strategies.market_neutral(5),
    "equal_weight": strategies.equal_weight(10), "alpha_composite": strategies.composite(FACTORS, 10),
    "icir_weight": strategies.icir_weight(5, 120, 60, 5, (5, 10, 20)),
}
for _name, _f in _STRATEGIES.items():
    formula_query(f"strategy_{_name}", {"weight": _f})

_BT = {"weight": strategies.momentum(5), "ret": "returns / 100"}


def weighted_panel(s, d):
    return panels.brand_week(s, d).withColumn("returns", F.col("returns") / 100)


def weighted(s, d, name="momentum", **p):
    """Returns of these prices are wild; a hundredth of them keeps totals in range."""
    return strategies.weights(panels.brand_week(s, d), name, **(p or {"top_n": 5})).withColumn("returns", F.col("returns") / 100)


BACKTEST_SQL = with_sql(_BT) + """,
hd as (select code, date, ord, ret, weight, coalesce(lag(weight) over (partition by code order by date), 0) as held from result),
mv as (select *, coalesce(abs(held - lag(held) over (partition by code order by date)), 0) as moved from hd),
dy as (select date, sum(held * coalesce(ret, 0)) as gross, sum(moved) as turnover from mv group by date),
bt as (select date, gross, gross - turnover * 0.002::double as net, turnover, product(1 + gross - turnover * 0.002::double) over (order by date rows between unbounded preceding and current row) as equity from dy)"""
QUERIES["backtest"] = lambda s, d: rounded(strategies.backtest(weighted(s, d)))
SQL["backtest"] = BACKTEST_SQL + f" select date::varchar as date, {r('gross')}, {r('net')}, {r('turnover')}, {r('equity')} from bt"
QUERIES["strategy_metrics"] = lambda s, d: rounded(strategies.summary(strategies.backtest(weighted(s, d))))
SQL["strategy_metrics"] = BACKTEST_SQL + f""", dd as (select *, equity / max(equity) over (order by date rows between unbounded preceding and current row) - 1 as dd from bt),
a as (select count(*) as n, arg_max(equity, date) as e, stddev_pop(net) as sd, avg(net) as m, min(dd) as dd, sum(turnover) as t from dd)
select {r('e - 1', 'total_return')}, {r('pow(e, 252.0::double / n) - 1', 'annual_return')}, {r('sd * sqrt(252)', 'annual_vol')}, {r('(pow(e, 252.0::double / n) - 1) / (sd * sqrt(252))', 'sharpe')}, {r('dd', 'max_drawdown')}, {r('t * 252 / n', 'annual_turnover')}, {r('m * 252 / (sd * sqrt(252))', 'daily_sharpe')} from a"""
_LIVE_SQL = BACKTEST_SQL + """, be as (select date, coalesce(avg(ret), 0) as bench from result group by date),
lv as (select min(date) as live from hd where held <> 0),
ex as (select bt.date, net, bench, net - bench as excess from bt join be using (date), lv where bt.date >= live)"""

QUERIES["validation"] = lambda s, d: rounded(strategies.validate(weighted(s, d)))
SQL["validation"] = _LIVE_SQL + f""", a as (select min(date) as live_start, pow(product(1 + net), 252.0::double / count(*)) - 1 as s, pow(product(1 + bench), 252.0::double / count(*)) - 1 as b, avg(net) * 252 / (stddev_pop(net) * sqrt(252)) as sh, avg(excess) / stddev_pop(excess) * sqrt(count(*)) as t from ex),
fl as (select min(q / m - 1) as fall from (select q, max(q) over (order by date rows between unbounded preceding and current row) as m from (select date, product(1 + net) over (order by date rows between unbounded preceding and current row) as q from ex)))
select live_start::varchar as live_start, {r('s', 'strat_annual')}, {r('b', 'bench_annual')}, {r('sh', 'sharpe')}, {r('t', 't_stat')}, {r('s - b', 'excess_annual')}, {r('fall', 'max_drawdown')}, case when t >= 2 then 'beats' when t <= -2 then 'trails' else 'not significant' end as verdict from a, fl"""
QUERIES["yearly_table"] = lambda s, d: rounded(strategies.yearly(weighted(s, d)))
SQL["yearly_table"] = _LIVE_SQL + f""", y as (select year(date)::int as year, product(1 + net) - 1 as s, product(1 + bench) - 1 as b from bt join be using (date) group by 1)
select year, {r('s', 'strategy')}, {r('b', 'benchmark')}, {r('s - b', 'excess')} from y"""
_GRID = {"fast": [5, 10], "slow": [20, 40]}
QUERIES["parameter_grid"] = lambda s, d: rounded(strategies.grid(panels.brand_week(s, d), "ma_cross", _GRID))
_GRID_COMBOS = [{"fast": f, "slow": w} for f in (5, 10) for w in (20, 40)]
SQL["parameter_grid"] = with_sql({f"w{i}": strategies.ma_cross(**c) for i, c in enumerate(_GRID_COMBOS)} | {"ret": "returns"}) + ", lg as (" + " union all ".join(f"select '{str(c).replace(chr(39), chr(39) * 2)}' as params, code, date, ord, ret, w{i} as weight from result" for i, c in enumerate(_GRID_COMBOS)) + f"""),
hd as (select *, coalesce(lag(weight) over (partition by params, code order by date), 0) as held from lg), mv as (select *, coalesce(abs(held - lag(held) over (partition by params, code order by date)), 0) as moved from hd),
dy as (select params, date, ord, sum(held * coalesce(ret, 0)) - sum(moved) * 0.002::double as net from mv group by all), n as (select floor(count(distinct date) * 0.6) as k from panel),
a as (select params, avg(net) filter (ord < k) / nullif(stddev_pop(net) filter (ord < k), 0) * sqrt(252) as tr, avg(net) filter (ord >= k) / nullif(stddev_pop(net) filter (ord >= k), 0) * sqrt(252) as te from dy, n group by params),
b as (select params from a where tr is not null order by round(tr, 9) desc, params limit 1)
select params, {r('tr', 'train_sharpe')}, case when params in (from b) then {r('te').replace(' as te', '')} end as test_sharpe, params in (from b) as best, case when params in (from b) then te is null or te < 0 or te < 0.5 * tr end as overfit from a"""


def notices(s, d):
    e = panels.read_table(s, d, "events")
    return e.select(F.col("user_id").alias("code"), F.date_add(F.to_date("ts"), 1).alias("notice"), F.col("event_type").alias("kind"), F.col("event_id").alias("event"))


_NOTICE_SQL = "nt as (select user_id as code, ts::date + 1 as notice, event_type as kind, event_id as event from events),\nnp as (select nt.*, (select min(ord) from panel where date >= notice) as pos from nt)"
QUERIES["strategy_event_drift"] = lambda s, d: rounded(strategies.event_weights(panels.user_day(s, d), notices(s, d).where("kind <> 'error'"), 5))
SQL["strategy_event_drift"] = f"""with {panels.USER_DAY_SQL},\n{_NOTICE_SQL}, ac as (select distinct code, pos + k as ord from np, (select unnest(range(5)) as k) where kind <> 'error' and pos is not null),
jn as (select p.code, p.date, case when ac.code is null then 0.0::double else 1.0 end as a from panel p left join ac on p.code = ac.code and p.ord = ac.ord), result as (select code, date, coalesce(a / nullif(sum(a) over (partition by date), 0), 0) as weight from jn)\n{rounded_sql(['weight'])}"""
QUERIES["event_study"] = lambda s, d: rounded(strategies.event_study(panels.user_day(s, d), notices(s, d), 2, 5, 5))
SQL["event_study"] = f"""with {panels.USER_DAY_SQL},\n{_NOTICE_SQL}, ab as (select code, ord, returns - avg(returns) over (partition by date) as a from panel), ls as (select max(ord) as last from panel),
sp as (select kind, event, code, k, pos + k as ord from np, ls, (select unnest(range(-2, 6)) as k) where pos - 2 >= 1 and pos + 5 <= last),
e as (select kind, event, count(a) as n, sum(case when k < 0 then a else 0 end) as pre, sum(case when k = 0 then a else 0 end) as d0, sum(case when k > 0 then a else 0 end) as post from sp join ab using (code, ord) group by 1, 2 having count(a) = 8)
select kind, count(*) as n_events, {r('avg(pre)', 'car_pre')}, {r('avg(d0)', 'car_day0')}, {r('avg(post)', 'car_post')}, {r('avg(post) / (stddev_pop(post) / sqrt(count(*)))', 't_post')} from e group by kind having count(*) >= 5"""
