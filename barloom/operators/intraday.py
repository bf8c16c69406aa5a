"""Minute bars to daily factors: cleaning, three factors, neutralising, cohorts, universes.

Bars are long rows ``(code, date, time, close, volume, amount)``.  Daily results are one
shuffle by (code, date); cross-sections one more by date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.research import MAD_SCALE, bucket, ic_series, ic_stats, newey_west
from barloom.plans.expr import RANK_DECIMALS, evaluate
from barloom.session import durable

SESSIONS = (("09:30:00", "11:30:00"), ("13:00:00", "15:00:00"))


def in_session(time: str, sessions: tuple[tuple[str, str], ...] = SESSIONS):
    clock = F.date_format(time, "HH:mm:ss")
    out = F.lit(False)
    for a, z in sessions:
        out = out | clock.between(a, z)
    return out


def usable_minutes(bars: DataFrame, sessions: tuple[tuple[str, str], ...] = SESSIONS) -> DataFrame:
    """Rows inside the sessions, finite, price above zero, no negative size; all rows of a time."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return bars.where(in_session("time", sessions) & good("close") & good("volume") & good("amount") & (F.col("close") > 0) & (F.col("volume") >= 0) & (F.col("amount") >= 0))


def clean_minutes(bars: DataFrame, sessions: tuple[tuple[str, str], ...] = SESSIONS) -> DataFrame:
    """Last row of each (code, time) by ``seq``; then those that :func:`usable_minutes` keeps."""
    last = Window.partitionBy("code", "time").orderBy(F.col("seq").desc())
    return usable_minutes(bars.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r"), sessions)


def minute_quality(cleaned: DataFrame, seen: DataFrame, daily: DataFrame, min_rows: int = 200, min_trades: int = 30, tolerance: float = 0.02) -> DataFrame:
    """Verdict for each (code, date) that was seen at all: ok, too few minutes, too few trades, or amounts that differ."""
    counted = cleaned.groupBy("code", "date").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("volume") > 0, 1).otherwise(0)).alias("traded"), F.sum("amount").alias("total"))
    joined = seen.select("code", "date").distinct().join(counted, ["code", "date"], "left").join(daily.select("code", "date", F.col("amount").alias("expected")), ["code", "date"], "left")
    n, traded, total = F.coalesce("n", F.lit(0)), F.coalesce("traded", F.lit(0)), F.coalesce("total", F.lit(0.0))
    error = F.when(F.col("expected") > 0, F.try_divide(F.abs(total - F.col("expected")), F.col("expected")))
    reason = F.when(n < min_rows, "too_few_minutes").when(traded < min_trades, "too_few_trades").when(error.isNull() | (error > tolerance), "amount_mismatch").otherwise("ok")
    return joined.select("code", "date", n.alias("minute_count"), error.alias("amount_relative_error"), reason.alias("reason"))


def day_factors(bars: DataFrame, share: float = 0.2) -> DataFrame:
    """(code, date, rskew, cpv, smart): skewness of returns, price-volume correlation, smart-money price ratio."""
    day = Window.partitionBy("code", "date")
    r = bars.withColumn("r", F.ln(F.col("close") / F.lag("close").over(day.orderBy("time"))))
    smart = F.when((F.col("volume") > 0) & F.col("r").isNotNull(), F.try_divide(F.abs("r"), F.sqrt("volume")))
    ranked = r.withColumn("s", F.round(smart, 12))
    order = day.orderBy(F.col("s").desc_nulls_last(), "time")
    before = F.coalesce(F.sum(F.when(F.col("s").isNotNull(), F.col("volume"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    target = share * F.sum(F.when(F.col("volume") > 0, F.col("volume"))).over(day)
    taken = ranked.withColumn("smart", F.col("s").isNotNull() & (before < target))
    traded = F.col("volume") > 0
    on = lambda c, x: F.when(c, F.col(x))
    sums = taken.groupBy("code", "date").agg(
        F.count("r").alias("n"), F.sum(F.col("r") * F.col("r")).alias("r2"), F.sum(F.col("r") * F.col("r") * F.col("r")).alias("r3"),
        F.sum(F.when(traded, 1).otherwise(0)).alias("trades"), F.covar_pop(on(traded, "close"), on(traded, "volume")).alias("cov"), F.stddev_pop(on(traded, "close")).alias("sc"), F.stddev_pop(on(traded, "volume")).alias("sv"),
        F.sum(on(traded, "amount")).alias("all_amount"), F.sum(on(traded, "volume")).alias("all_volume"), F.sum(on(F.col("smart"), "amount")).alias("smart_amount"), F.sum(on(F.col("smart"), "volume")).alias("smart_volume"),
    )
    skew = F.when(F.col("r2") > 0, F.try_divide(F.sqrt("n") * F.col("r3"), F.pow("r2", F.lit(1.5))))
    cpv = F.when((F.col("trades") >= 2) & (F.col("sc") > 0) & (F.col("sv") > 0), F.try_divide(F.col("cov"), F.col("sc") * F.col("sv")))
    q = F.when(F.col("all_amount") > 0, F.try_divide(F.try_divide(F.col("smart_amount"), F.col("smart_volume")), F.try_divide(F.col("all_amount"), F.col("all_volume"))))
    return sums.select("code", "date", skew.alias("rskew"), cpv.alias("cpv"), q.alias("smart"))


def rolling_factors(daily: DataFrame, window: int = 20, least: int = 15) -> DataFrame:
    """Means (and the deviation of cpv) over the last rows of the requested calendar; ``daily`` is dense."""
    w = f"{window}, {least}"
    return evaluate(daily, {"f_rskew": f"mean(rskew, {w})", "f_cpv_mean": f"mean(cpv, {w})", "f_cpv_std": f"std(cpv, {w})", "f_smart": f"mean(smart, {w})"}, ["code", "date", "ord"])


def _z(x: str) -> str:
    return f"({x} - cmean({x})) / nz(round(cstd({x}), 12))"


def winsorised_mad(x: str, limit: float = 5.0) -> str:
    """Clip at the median +- limit scaled deviations; no deviation leaves values alone."""
    m = f"cmedian({x})"
    reach = f"({limit * MAD_SCALE} * cmedian(abs({x} - {m})))"
    return f"if({reach} > 0, min2(max2({x}, {m} - {reach}), {m} + {reach}), {x})"


def neutralised(frame: DataFrame, value: str, cap: str = "float_cap", industry: str = "industry", min_count: int = 400) -> DataFrame:
    """Residual z-score of a value on log cap and industry, by date, without leaving SQL.

    With a constant and industry dummies in the regression, its residual is that of the
    industry-demeaned value on the industry-demeaned log cap (Frisch, Waugh and Lovell).
    """
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")) & (F.col(cap) > 0) & (F.col(cap) < float("inf")) & F.col(industry).isNotNull()
    use = frame.where(ok).select("code", "date", F.col(value).alias("y"), F.ln(cap).alias("x"), F.col(industry).alias("industry"))
    use = use.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date"))).where(F.col("n") >= min_count).drop("n")
    z = evaluate(use, {"y": _z(winsorised_mad("y"))}, ["code", "date", "x", "industry"])
    group = Window.partitionBy("date", "industry")
    d = z.withColumn("yd", F.col("y") - F.avg("y").over(group)).withColumn("xd", F.col("x") - F.avg("x").over(group))
    day = Window.partitionBy("date")
    slope = F.try_divide(F.sum(F.col("xd") * F.col("yd")).over(day), F.when(F.sum(F.col("xd") * F.col("xd")).over(day) > 1e-18, F.sum(F.col("xd") * F.col("xd")).over(day)))
    e = d.withColumn("b", F.coalesce(slope, F.lit(0.0))).withColumn("e", F.col("yd") - F.col("b") * F.col("xd"))
    spread = F.stddev_pop("e").over(day)
    return e.select("code", "date", F.when(spread > 1e-10, (F.col("e") - F.avg("e").over(day)) / spread).alias("z"))


def composed_score(z: DataFrame) -> DataFrame:
    """(code, date, score): mean of three scores, the second re-standardised; missing if any is."""
    return evaluate(z, {"score": f"(f_rskew + {_z('((f_cpv_mean + f_cpv_std) / 2)')} + f_smart) / 3"}, ["code", "date"])


#: The sign of each factor, and how many calendar rows an anchor's attributes hold.
DIRECTIONS = {"f_rskew": -1.0, "f_cpv_mean": -1.0, "f_cpv_std": -1.0, "f_smart": -1.0}
ANCHOR_ROWS = 4


def preprocess_panels(factors: DataFrame, pool: DataFrame, attributes: DataFrame, min_count: int = 400) -> DataFrame:
    """(code, date, four scores): factors turned their way and neutralised inside each date's pool.

    ``factors`` has code, date, ord and the four columns; ``attributes`` (date, code,
    float_cap, industry) count from their date, the latest one for all codes, for
    ``ANCHOR_ROWS`` rows of the calendar.  Dates with a smaller pool have no scores.
    """
    missing = set(DIRECTIONS) - set(factors.columns)
    if missing:
        raise ValueError(f"missing required factors: {', '.join(sorted(missing))}")
    days = factors.select("date", "ord").distinct()
    marks = days.select("date", "ord", F.lit(1).alias("day")).unionByName(attributes.select("date").distinct().select("date", F.lit(None).cast("bigint").alias("ord"), F.lit(0).alias("day")))
    so_far = Window.orderBy("date", "day").rowsBetween(Window.unboundedPreceding, 0)  # a calendar and its anchors
    anchored = marks.withColumn("anchor", F.max(F.when(F.col("day") == 0, F.col("date"))).over(so_far)).where("day = 1 and anchor is not null")
    anchored = anchored.withColumn("since", F.col("ord") - F.min("ord").over(Window.partitionBy("anchor"))).where(F.col("since") <= ANCHOR_ROWS).select("date", "anchor")
    members = factors.join(pool.select("date", "code").distinct(), ["date", "code"], "left_semi").join(F.broadcast(anchored), "date")  # one row a date
    full = members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date"))).where(F.col("n") >= min_count)
    known = full.join(attributes.select(F.col("date").alias("anchor"), "code", "float_cap", "industry"), ["anchor", "code"], "left")
    known = durable(known.select("code", "date", "float_cap", "industry", *[(F.col(f) * d).alias(f) for f, d in DIRECTIONS.items()]), "pool-factors")
    out = known.select("code", "date")
    for f in DIRECTIONS:
        out = out.join(neutralised(known, f, min_count=min_count).withColumnRenamed("z", f), ["code", "date"], "left")
    return out


def evaluate_factors(panel: DataFrame, factors: dict[str, str], q: int = 5, horizon: int = 5, min_count: int = 400) -> DataFrame:
    """A row for each factor (formula): information coefficient against open-to-open returns, its t-statistic, spread and order of buckets."""
    rows = []
    for name, formula in factors.items():
        df = durable(evaluate(panel, {"factor": formula, "forward": forward_open_return(horizon)}, ["code", "date", "ord"]), "factor")
        ic = durable(ic_series(df, min_count=min_count).where("ic is not null"), "ic")
        cohorts = durable(quantile_cohorts(df.select("code", "date", "factor"), panel, q, horizon, min_count), "cohorts")
        mean = lambda b: F.avg(F.when(F.col("bucket") == b, F.col("return")))
        spread = cohorts.agg((mean(q - 1) - mean(0)).alias("q5_q1_mean"))
        positive = ic.agg(F.avg((F.round("ic", 12) > 0).cast("double")).alias("positive_ic_rate"))
        t = newey_west(ic.withColumnRenamed("ic", "value")).select(F.col("t").alias("ic_nw_t"))
        row = ic_stats(ic).drop("days")
        for part in (positive, t, spread, monotonicity(cohorts)):
            row = row.crossJoin(part)  # one row each
        rows.append(row.withColumn("factor", F.lit(name)))
    return reduce(DataFrame.unionByName, rows)


def forward_open_return(horizon: int = 5) -> str:
    price = "if(open > 0, finite(open), null())"
    return f"lead({price}, {horizon + 1}) / lead({price}, 1) - 1"


def quantile_cohorts(factor: DataFrame, panel: DataFrame, q: int = 5, horizon: int = 5, min_count: int = 400) -> DataFrame:
    """(date, bucket, return): mean over the cohorts that are alive of their equal-weighted open-to-open returns."""
    opens = evaluate(panel, {"p": "if(open > 0, finite(open), null())"}, ["code", "date", "ord"])
    opens = evaluate(opens, {"step": "p / delay(p, 1) - 1", "entry": "lead(p, 1)"}, ["code", "date", "ord"])
    last = panel.agg(F.max("ord").alias("last"))
    valid = factor.where(F.col("factor").isNotNull() & ~F.isnan("factor") & (F.abs(F.col("factor")) < float("inf"))).join(opens.select("code", "date", "ord", "entry"), ["code", "date"])
    valid = valid.where("entry is not null").crossJoin(F.broadcast(last)).where(F.col("ord") + 1 + horizon <= F.col("last"))
    day = Window.partitionBy("date")
    placed = valid.select("code", "ord", F.count(F.lit(1)).over(day).alias("n"), F.row_number().over(day.orderBy(F.round("factor", RANK_DECIMALS), "code")).alias("r")).where(F.col("n") >= max(min_count, q))
    alive = placed.select("code", F.col("ord").alias("cohort"), bucket(F.col("r"), F.col("n"), q).alias("bucket"), F.explode(F.sequence(F.col("ord") + 2, F.col("ord") + 1 + horizon)).alias("ord"))
    each = alive.join(opens.select("code", "ord", "date", "step"), ["code", "ord"]).groupBy("cohort", "date", "bucket").agg(F.avg("step").alias("r"))
    return each.groupBy("date", "bucket").agg(F.avg("r").alias("return"))


def monotonicity(cohorts: DataFrame) -> DataFrame:
    """Rank correlation of the bucket number with the bucket's mean return."""
    means = cohorts.groupBy("bucket").agg(F.avg("return").alias("m")).where("m is not null")
    every = Window.partitionBy(F.lit(1))  # one row a bucket
    ranked = means.select(F.rank().over(every.orderBy("bucket")).cast("double").alias("a"), F.rank().over(every.orderBy(F.round("m", 12))).cast("double").alias("b"))
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    return ranked.agg(F.when(F.count(F.lit(1)) >= 2, F.when(spread > 0, F.try_divide(F.covar_pop("a", "b"), spread))).alias("monotonicity"))


def dynamic_universe(panel: DataFrame, top: int = 500, window: int = 20, min_age: int = 60) -> DataFrame:
    """(date, code, adv, liquidity_rank, eligible, reason): yesterday's liquidity ranks, then age and trading filters without refilling."""
    v = evaluate(panel, {"adv": f"delay(mean(amount, {window}), 1)", "age": "cumsum(b2f(coalesce(volume, 0) > 0))", "traded": "b2f(coalesce(volume, 0) > 0)"}, ["code", "date"])
    order = Window.partitionBy("date").orderBy(F.round("adv", RANK_DECIMALS).desc(), "code")
    ranked = v.where("adv is not null").withColumn("liquidity_rank", F.row_number().over(order)).where(F.col("liquidity_rank") <= top)
    reason = F.when(F.col("age") < min_age, "age").when(F.col("traded") == 0, "suspended").otherwise("")
    return ranked.select("date", "code", "adv", "liquidity_rank", (reason == "").alias("eligible"), reason.alias("reason"))


def universe_audit(universe: DataFrame) -> DataFrame:
    of = lambda r: F.sum(F.when(F.col("reason") == r, 1).otherwise(0)).cast("bigint")
    return universe.groupBy("date").agg(F.count(F.lit(1)).alias("ranked_count"), of("age").alias("age_exclusions"), of("suspended").alias("suspension_exclusions"), of("").alias("daily_eligible_count"))


def build_targets(score: DataFrame, pool: DataFrame, every: int = 5, top_n: int = 50, min_count: int = 400) -> DataFrame:
    """(date, ord, code, weight): equal weights of the best names every few rows from the first full day on."""
    ok = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs(F.col("score")) < float("inf"))
    valid = score.where(ok).join(pool.select("date", "code"), ["date", "code"], "left_semi")
    day = Window.partitionBy("date")
    full = valid.withColumn("n", F.count(F.lit(1)).over(day)).where(F.col("n") >= min_count)
    anchor = full.agg(F.min("ord").alias("anchor"))
    placed = full.crossJoin(F.broadcast(anchor)).where((F.col("ord") - F.col("anchor")) % every == 0).withColumn("r", F.row_number().over(day.orderBy(F.round("score", RANK_DECIMALS).desc(), "code"))).where(F.col("r") <= top_n)
    return placed.select("date", "ord", "code", (F.lit(1.0) / F.count(F.lit(1)).over(day)).alias("weight"))


def benchmark_targets(pool: DataFrame, dates: DataFrame) -> DataFrame:
    members = pool.join(F.broadcast(dates.select("date").distinct()), "date", "left_semi")
    return members.select("date", "code", (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("date"))).alias("weight"))


def price_limits(raw: DataFrame) -> DataFrame:
    """Whether buying and selling are blocked by a one-price day, or by the lack of a usable price before."""
    before = F.lag("close").over(Window.partitionBy("code").orderBy("date"))
    prices = [F.round(c, 2) for c in ("open", "high", "low", "close")]
    p = raw.withColumn("before", before).withColumn("one", (prices[0] == prices[1]) & (prices[1] == prices[2]) & (prices[2] == prices[3]))
    usable = (F.col("before") > 0) & (F.col("before") < float("inf"))
    complete = F.col("one").isNotNull()
    up, down = prices[3] >= F.col("before") * 1.045 - 1e-12, prices[3] <= F.col("before") * 0.955 + 1e-12
    no = ~F.coalesce(usable & complete, F.lit(False))
    return p.select("code", "date", F.when(no, True).when(~F.col("one"), False).when(up, True).when(down, False).otherwise(True).alias("buy_blocked"), F.when(no, True).when(~F.col("one"), False).when(up, False).when(down, True).otherwise(True).alias("sell_blocked"))
