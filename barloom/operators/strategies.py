"""Weight generators, the vectorised backtest, its metrics, validation and parameter search.

The rule-based strategies are formulas over the panel; weights change on every
``rebalance``-th calendar row and are carried forward between.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.research import TRADING_DAYS, composite_formula
from barloom.plans.expr import evaluate


def _share(flag: str) -> str:
    """Equal weights over the names that hold."""
    return f"b2f({flag}) / nz(csum(b2f({flag})))"


def _on_schedule(weight: str, rebalance: int) -> str:
    return f"coalesce(ffill(if(mod(ord, {rebalance}) == 0, {weight}, null())), 0)"


def ma_cross(fast: int = 20, slow: int = 60) -> str:
    return f"coalesce({_share(f'mean(close, {fast}) > mean(close, {slow})')}, 0)"


def mean_reversion(window: int = 20, entry: float = -2.0, exit_: float = 0.0) -> str:
    z = f"(close - mean(close, {window})) / std(close, {window})"
    state = f"coalesce(ffill(if({z} < {entry}, 1, if({z} >= {exit_}, 0, null()))), 0) > 0"
    return f"coalesce({_share(state)}, 0)"


def _momentum(lookback: int, skip: int, rebalance: int) -> str:
    return f"if(mod(ord, {rebalance}) == 0, delay(close, {skip}) / delay(close, {lookback}) - 1, null())"


def momentum(top_n: int = 20, lookback: int = 252, skip: int = 21, rebalance: int = 21) -> str:
    return _on_schedule(_share(f"rankd({_momentum(lookback, skip, rebalance)}) <= {top_n}"), rebalance)


def market_neutral(top_n: int = 20, lookback: int = 252, skip: int = 21, rebalance: int = 21) -> str:
    mom = _momentum(lookback, skip, rebalance)
    high, low = f"(rankd({mom}) <= {top_n})", f"(rank_avg({mom}) <= {top_n} and not rankd({mom}) <= {top_n})"
    half = lambda f: f"coalesce(b2f({f}) / nz(2 * csum(b2f({f}))), 0)"
    return _on_schedule(f"{half(high)} - {half(low)}", rebalance)


def equal_weight(top_n: int = 500, rebalance: int = 5, window: int = 60) -> str:
    return _on_schedule(_share(f"rankd(if(mod(ord, {rebalance}) == 0, mean(amount, {window}, 1), null())) <= {top_n}"), rebalance)


def composite(factors: list[str], top_n: int = 50, rebalance: int = 5) -> str:
    return _on_schedule(_share(f"orderd({composite_formula(factors)}) <= {top_n}"), rebalance)


def feature_formulas(windows: tuple[int, int, int]) -> dict[str, str]:
    """Returns over three windows, volatility, and volume against its longer mean."""
    short = max(windows[0], 2)
    held = "ffill(close)"
    out = {f"ret{w}": f"{held} / delay({held}, {w}) - 1" for w in windows}
    return out | {"vol": f"std(returns, {short * 2})", "volu": f"mean(volume, {short}) / mean(volume, {short * 3})"}


def icir_weight(top_n: int = 30, train: int = 252, retrain: int = 5, horizon: int = 5, windows: tuple[int, int, int] = (21, 63, 126), least: int = 20) -> str:
    """Features weighted by the stability of their past rank correlation with forward returns.

    A date's correlation is the same on every row of the date, so its rolling mean and
    deviation run along each code like any other operator; they end where returns are known.
    """
    forward = f"rank_avg(finite(lead(close, {horizon}) / close - 1))"
    parts, known = [], []
    for f in feature_formulas(windows).values():
        f = f"finite({f})"
        a = f"rank_avg({f})"
        ic = f"(cmean(({a} - cmean({a})) * ({forward} - cmean({forward}))) / nz(round(cstd({a}) * cstd({forward}), 12)))"
        past, w = f"delay({ic}, {horizon + 1})", train - horizon
        n = f"count({past}, {w})"
        icir = f"(mean({past}, {w}, {least}) / nz(round(std({past}, {w}, {least}) * sqrt(({n} - 1) / nz({n})), 12)))"
        parts.append(f"if(isnull({icir}), 0, {icir} * (({f} - cmean({f})) / nz(cstds({f}))))")
        known.append(f"not isnull({icir})")
    score = f"({' + '.join(parts)})"
    due = f"ord >= {train} and mod(ord - {train}, {retrain}) == 0 and ({' or '.join(known)})"
    return f"coalesce(ffill(if({due}, {_share(f'orderd({score}) <= {top_n}')}, null())), 0)"


FORMULAS: dict[str, Callable[..., str]] = {f.__name__: f for f in (ma_cross, mean_reversion, momentum, market_neutral, equal_weight, icir_weight)}


def weights(panel: DataFrame, name: str, **params) -> DataFrame:
    """(code, date, ord, close, returns, weight) of a registered strategy."""
    return evaluate(panel, {"weight": FORMULAS[name](**params)}, ["code", "date", "ord", "close", "returns"])


# --- Events ----------------------------------------------------------------------------


def next_trading_day(notices: DataFrame, calendar: DataFrame) -> DataFrame:
    """``notices`` with the ordinal ``pos`` of the first calendar date at or after ``notice``."""
    days = notices.select(F.col("notice").alias("date")).distinct().withColumn("ord", F.lit(None).cast("bigint")).unionByName(calendar.select("date", "ord"))
    ahead = Window.orderBy(F.col("date").desc(), F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, 0)
    after = days.withColumn("pos", F.last("ord", ignorenulls=True).over(ahead)).where("ord is null").select(F.col("date").alias("notice"), "pos")
    return notices.join(F.broadcast(after), "notice")  # one row a distinct notice date


def event_weights(panel: DataFrame, notices: DataFrame, hold: int = 20) -> DataFrame:
    """Equal weight over names with a notice in the last ``hold`` rows."""
    placed = next_trading_day(notices, panel.select("date", "ord").distinct()).where("pos is not null")
    active = placed.select("code", F.explode(F.sequence("pos", F.col("pos") + hold - 1)).alias("ord")).distinct().withColumn("active", F.lit(1.0))
    joined = panel.select("code", "date", "ord").join(active, ["code", "ord"], "left").withColumn("active", F.coalesce("active", F.lit(0.0)))
    total = F.sum("active").over(Window.partitionBy("date"))
    return joined.select("code", "date", F.coalesce(F.col("active") / F.when(total != 0, total), F.lit(0.0)).alias("weight"))


def event_study(panel: DataFrame, notices: DataFrame, pre: int = 5, post: int = 20, min_events: int = 5) -> DataFrame:
    """Mean cumulative abnormal returns before, on and after notices of each kind (``notices``: code, notice, kind, event)."""
    day = Window.partitionBy("date")
    abnormal = panel.select("code", "ord", (F.col("returns") - F.avg("returns").over(day)).alias("a"))
    last = panel.agg(F.max("ord").alias("last"))
    placed = next_trading_day(notices, panel.select("date", "ord").distinct()).crossJoin(F.broadcast(last)).where((F.col("pos") - pre >= 1) & (F.col("pos") + post <= F.col("last")))
    spread = placed.select("kind", "event", "code", F.explode(F.sequence(F.lit(-pre), F.lit(post))).alias("k"), "pos").withColumn("ord", F.col("pos") + F.col("k"))
    part = lambda c: F.sum(F.when(c, F.col("a")).otherwise(0.0))
    each = spread.join(abnormal, ["code", "ord"]).groupBy("kind", "event").agg(F.count("a").alias("n"), part(F.col("k") < 0).alias("pre"), part(F.col("k") == 0).alias("day0"), part(F.col("k") > 0).alias("post")).where(F.col("n") == pre + post + 1)
    error = F.try_divide(F.stddev_pop("post"), F.sqrt(F.count(F.lit(1))))
    return each.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("pre").alias("car_pre"), F.avg("day0").alias("car_day0"), F.avg("post").alias("car_post"), F.when(error > 0, F.try_divide(F.avg("post"), error)).alias("t_post")
    ).where(F.col("n_events") >= min_events)


# --- Backtest --------------------------------------------------------------------------


def backtest(weighted: DataFrame, cost_bps: float = 20, slippage_bps: float = 0) -> DataFrame:
    """(date, gross, net, turnover, equity): weights of a row are held from the next row on.

    The per-date table is as long as the calendar; only it is ordered as a whole.
    """
    along = Window.partitionBy("code").orderBy("date")
    held = weighted.withColumn("held", F.coalesce(F.lag("weight").over(along), F.lit(0.0)))
    moved = held.withColumn("moved", F.coalesce(F.abs(F.col("held") - F.lag("held").over(along)), F.lit(0.0)))
    daily = moved.groupBy("date").agg(F.sum(F.col("held") * F.coalesce("returns", F.lit(0.0))).alias("gross"), F.sum("moved").alias("turnover"))
    net = daily.withColumn("net", F.col("gross") - F.col("turnover") * ((cost_bps + slippage_bps) / 1e4))
    return net.withColumn("equity", F.product(F.col("net") + 1.0).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).select("date", "gross", "net", "turnover", "equity")


def _total(x: Column) -> Column:
    return F.product(x + 1.0) - 1.0


def summary(result: DataFrame) -> DataFrame:
    """Total and annual return, volatility, Sharpe ratio, drawdown and turnover of a backtest."""
    peak = F.max("equity").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    base = result.withColumn("dd", F.col("equity") / peak - 1.0).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("equity", "date").alias("e"), F.stddev_pop("net").alias("sd"), F.avg("net").alias("m"), F.min("dd").alias("max_drawdown"), F.sum("turnover").alias("t")
    )
    annual, vol = F.pow("e", F.lit(TRADING_DAYS) / F.col("n")) - 1.0, F.col("sd") * F.sqrt(F.lit(float(TRADING_DAYS)))
    return base.select(
        (F.col("e") - 1.0).alias("total_return"), annual.alias("annual_return"), vol.alias("annual_vol"), F.when(vol > 0, F.try_divide(annual, vol)).alias("sharpe"), "max_drawdown",
        (F.col("t") * TRADING_DAYS / F.col("n")).alias("annual_turnover"), F.when(F.col("sd") > 0, F.try_divide(F.col("m") * TRADING_DAYS, vol)).alias("daily_sharpe"),
    )


def against_benchmark(weighted: DataFrame, cost_bps: float = 20) -> DataFrame:
    """(date, net, bench, excess) from the first day with a holding."""
    bench = weighted.groupBy("date").agg(F.coalesce(F.avg("returns"), F.lit(0.0)).alias("bench"))
    along = Window.partitionBy("code").orderBy("date")
    first = weighted.withColumn("held", F.lag("weight").over(along)).where("held <> 0").agg(F.min("date").alias("live"))
    both = backtest(weighted, cost_bps).select("date", "net").join(bench, "date").crossJoin(F.broadcast(first)).where("date >= live")
    return both.select("date", "net", "bench", (F.col("net") - F.col("bench")).alias("excess"))


def validate(weighted: DataFrame, cost_bps: float = 20) -> DataFrame:
    """Annual returns of strategy and equal-weighted benchmark, t-statistic of the excess, verdict."""
    live = against_benchmark(weighted, cost_bps)
    annual = lambda c: F.pow(_total(F.col(c)) + 1.0, F.lit(float(TRADING_DAYS)) / F.count(F.lit(1))) - 1.0
    t = F.when(F.stddev_pop("excess") > 0, F.try_divide(F.avg("excess"), F.stddev_pop("excess")) * F.sqrt(F.count(F.lit(1))))
    sharpe = F.when(F.stddev_pop("net") > 0, F.try_divide(F.avg("net") * TRADING_DAYS, F.stddev_pop("net") * F.sqrt(F.lit(float(TRADING_DAYS)))))
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    equity = live.withColumn("equity", F.product(F.col("net") + 1.0).over(so_far))
    fallen = equity.withColumn("fall", F.col("equity") / F.max("equity").over(so_far) - 1.0)
    out = fallen.agg(F.min("date").alias("live_start"), annual("net").alias("strat_annual"), annual("bench").alias("bench_annual"), sharpe.alias("sharpe"), t.alias("t_stat"), F.min("fall").alias("max_drawdown"))
    verdict = F.when(F.col("live_start").isNull(), "never held").when(F.col("t_stat").isNull(), "undecided").when(F.col("t_stat") >= 2, "beats").when(F.col("t_stat") <= -2, "trails").otherwise("not significant")
    return out.withColumn("excess_annual", F.col("strat_annual") - F.col("bench_annual")).withColumn("verdict", verdict)


def yearly(weighted: DataFrame, cost_bps: float = 20) -> DataFrame:
    bench = weighted.groupBy("date").agg(F.coalesce(F.avg("returns"), F.lit(0.0)).alias("bench"))
    both = backtest(weighted, cost_bps).select("date", "net").join(bench, "date")
    table = both.groupBy(F.year("date").alias("year")).agg(_total(F.col("net")).alias("strategy"), _total(F.col("bench")).alias("benchmark"))
    return table.withColumn("excess", F.col("strategy") - F.col("benchmark"))


def grid(panel: DataFrame, name: str, choices: dict[str, list], ratio: float = 0.6, allowed: Callable[[dict], bool] = lambda p: True, cost_bps: float = 20, weigh: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Daily Sharpe ratio of every allowed combination before the split date, and of the best one after it.

    The best is overfit where its ratio after the split is missing, negative or below half of that before.

    All combinations are formulas of one plan, so they share its shuffles.
    """
    combos = [c for c in (dict(zip(choices, v, strict=True)) for v in product(*choices.values())) if allowed(c)]
    if not combos:
        raise ValueError("no combination is allowed")
    if weigh:
        base = panel.select("code", "date", "ord", "returns")
        long = reduce(DataFrame.unionByName, [base.join(weigh(**c), ["code", "date"]).withColumn("params", F.lit(str(c))) for c in combos])
        return _scored(panel, long, ratio, cost_bps)
    many = evaluate(panel, {f"w{i}": FORMULAS[name](**c) for i, c in enumerate(combos)}, ["code", "date", "ord", "returns"])
    long = many.select("code", "date", "ord", "returns", F.explode(F.array(*[F.struct(F.lit(str(c)).alias("params"), F.col(f"w{i}").alias("weight")) for i, c in enumerate(combos)])).alias("x")).select("code", "date", "ord", "returns", "x.*")
    return _scored(panel, long, ratio, cost_bps)


def _scored(panel: DataFrame, long: DataFrame, ratio: float, cost_bps: float) -> DataFrame:
    """The table of :func:`grid` from the weights of every combination, one below the other."""
    along = Window.partitionBy("params", "code").orderBy("date")
    held = long.withColumn("held", F.coalesce(F.lag("weight").over(along), F.lit(0.0)))
    moved = held.withColumn("moved", F.coalesce(F.abs(F.col("held") - F.lag("held").over(along)), F.lit(0.0)))
    daily = moved.groupBy("params", "date", "ord").agg(F.sum(F.col("held") * F.coalesce("returns", F.lit(0.0))).alias("gross"), F.sum("moved").alias("t")).withColumn("net", F.col("gross") - F.col("t") * (cost_bps / 1e4))
    dates = panel.agg(F.count_distinct("date").alias("dates"))
    split = daily.crossJoin(F.broadcast(dates)).withColumn("early", F.col("ord") < F.floor(F.col("dates") * ratio))  # one row
    sharpe = F.when(F.stddev_pop("net") > 0, F.try_divide(F.avg("net"), F.stddev_pop("net")) * F.sqrt(F.lit(float(TRADING_DAYS))))
    scored = split.where("early").groupBy("params").agg(sharpe.alias("train_sharpe"))
    best = F.row_number().over(Window.orderBy(F.round("train_sharpe", 9).desc_nulls_last(), "params")) == 1  # one row a combination
    ranked = scored.withColumn("best", best & F.col("train_sharpe").isNotNull())
    # Only the best combination meets the rest of the dates, once.
    held_out = split.where("not early").join(F.broadcast(ranked.where("best").select("params")), "params").groupBy("params").agg(sharpe.alias("test_sharpe"))
    sound = (F.col("test_sharpe") >= 0) & (F.col("test_sharpe") >= F.col("train_sharpe") * 0.5)
    return ranked.join(held_out, "params", "left").withColumn("overfit", F.when(F.col("best"), ~F.coalesce(sound, F.lit(False))))
