"""Factor research over dense panels: masks, information coefficients, buckets, composites, scores, signals.

Functions take a panel with one row for each (code, date) and the columns they name, and
return long DataFrames.  Everything across a date is one shuffle by date; everything
along a code is one shuffle by code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.expr import RANK_DECIMALS, evaluate, pct_rank
from barloom.session import durable

#: Median absolute deviation to standard deviation of a normal law.
MAD_SCALE = 1.4826
TRADING_DAYS = 252
FORWARD = "lead(close, 1) / close - 1"


def liquidity_mask_formula(min_days: int = 60, adv_window: int = 20, drop: float = 0.2) -> str:
    """Traded today, listed long enough, and not among the least liquid."""
    adv = f"mean(amount, {adv_window}, 1)"
    parts = ["coalesce(volume, 0) > 0"]
    if min_days > 0:
        parts.append(f"cumsum(b2f(coalesce(volume, 0) > 0)) > {min_days}")
    if drop > 0:
        parts.append(f"{adv} >= cpct({adv}, {drop})")
    return " and ".join(f"({p})" for p in parts)


def liquidity_mask(panel: DataFrame, excluded: list[str] | None = None, **options) -> DataFrame:
    masked = evaluate(panel, {"eligible": liquidity_mask_formula(**options)}, ["code", "date"])
    return masked.withColumn("eligible", F.col("eligible") & ~F.col("code").isin(excluded)) if excluded else masked


def winsorised_z(x: str, limit: float = 3.0) -> str:
    """Clip at the median +- limit scaled deviations, then a population z-score."""
    middle = f"cmedian({x})"
    mad = f"cmedian(abs({x} - {middle}))"
    clipped = f"min2(max2({x}, {middle} - {limit * MAD_SCALE} * {mad}), {middle} + {limit * MAD_SCALE} * {mad})"
    return f"({clipped} - cmean({clipped})) / nz(round(cstd({clipped}), 12))"


def composite_formula(factors: list[str], weights: list[float] | None = None) -> str:
    """Sum of z-scores over all codes; missing only where every factor is."""
    zs = [winsorised_z(f) for f in factors]
    weights = weights or [1.0] * len(zs)
    total = " + ".join(f"{w} * coalesce({z}, 0)" for w, z in zip(weights, zs, strict=True))
    return f"if({' and '.join(f'isnull({z})' for z in zs)}, null(), {total})"


def masked(formula: str, mask: str) -> str:
    return f"if({mask}, {formula}, null())"


def _pairs(df: DataFrame, factor: str, forward: str) -> DataFrame:
    """Rows where both sides are finite."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.where(ok(factor) & ok(forward))


def ic_series(df: DataFrame, factor: str = "factor", forward: str = "forward", by: tuple[str, ...] = ("date",), min_count: int = 5) -> DataFrame:
    """Rank correlation of factor and forward return, per date (and other keys)."""
    day = Window.partitionBy(*by)
    average = lambda c: pct_rank(F.round(c, RANK_DECIMALS), day.orderBy(F.round(c, RANK_DECIMALS)), day)
    ranked = _pairs(df, factor, forward).select(*by, average(factor).alias("a"), average(forward).alias("b"))
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    corr = F.when(spread > 1e-12, F.try_divide(F.covar_pop("a", "b"), spread))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), corr.alias("ic")).where(F.col("n") >= min_count)


def ic_stats(ic: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return ic.groupBy(*by).agg(
        F.count("ic").alias("days"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"),
        F.when(F.stddev_samp("ic") > 0, F.try_divide(F.avg("ic"), F.stddev_samp("ic"))).alias("icir"),
    )


def bucket(position: Column, count: Column, q: int) -> Column:
    """Quantile bucket (0 to q-1) of the value in the given place among ``count``, with interpolated edges."""
    return F.greatest(F.lit(0), F.floor(F.try_divide((position - 1) * q + count - 2, count - 1)) - 1).cast("int")


def quantile_returns(df: DataFrame, factor: str = "factor", forward: str = "forward", q: int = 5) -> DataFrame:
    """(date, bucket, n, mean forward return); dates with fewer than q names are left out."""
    day = Window.partitionBy("date")
    placed = _pairs(df, factor, forward).select(
        "date", "code", F.col(forward).alias("forward"), F.count(F.lit(1)).over(day).alias("n"), F.row_number().over(day.orderBy(F.round(factor, RANK_DECIMALS), "code")).alias("r")
    ).where(F.col("n") >= q)
    return placed.withColumn("bucket", bucket(F.col("r"), F.col("n"), q)).groupBy("date", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("forward").alias("mean_return"))


def long_short_stats(buckets: DataFrame, q: int = 5) -> DataFrame:
    spread = buckets.groupBy("date").agg((F.max(F.when(F.col("bucket") == q - 1, F.col("mean_return"))) - F.max(F.when(F.col("bucket") == 0, F.col("mean_return")))).alias("ls")).where("ls is not null")
    mean, std = F.avg("ls"), F.stddev_samp("ls")
    return spread.agg(F.count(F.lit(1)).alias("days"), (mean * TRADING_DAYS).alias("ls_annual"), F.when(std > 0, F.try_divide(mean, std) * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("ls_sharpe"))


def top_turnover(df: DataFrame, factor: str = "factor", q: int = 5) -> DataFrame:
    """Mean share of new names in the top bucket from one date of the calendar to the next."""
    day = Window.partitionBy("date")
    held = df.where(F.col(factor).isNotNull()).select("ord", "code", F.row_number().over(day.orderBy(F.round(factor, RANK_DECIMALS).desc(), "code")).alias("r"), F.count(F.lit(1)).over(day).alias("n"))
    top = held.where((F.col("n") >= q) & (F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / q)))).select("ord", "code")
    before = top.select((F.col("ord") + 1).alias("ord"), "code", F.lit(1).alias("was"))
    daily = top.where("ord > 0").join(before, ["ord", "code"], "left").groupBy("ord").agg((F.sum(F.when(F.col("was").isNull(), 1).otherwise(0)) / F.count(F.lit(1))).alias("t"))
    return daily.agg(F.avg("t").alias("turnover"), F.count(F.lit(1)).alias("days"))


def evaluate_factor(panel: DataFrame, formula: str, mask: str | None = None, q: int = 5) -> DataFrame:
    """One row on a factor: information coefficient, long-short returns, turnover.  The formula is worked out once and written."""
    shown = masked(formula, mask) if mask else formula
    df = durable(evaluate(panel, {"factor": shown, "forward": FORWARD}, ["code", "date", "ord"]), "factor")
    parts = [ic_stats(ic_series(df)), long_short_stats(quantile_returns(df, q=q), q).drop("days"), top_turnover(df, q=q).drop("days")]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


def rolling_ic_weights(ic: DataFrame, calendar: DataFrame, window: int = 120, lag: int = 15, min_periods: int | None = None) -> DataFrame:
    """(factor, date, weight): mean of past information coefficients, late enough to be known."""
    least = max(20, window // 2) if min_periods is None else min_periods
    grid = ic.select("factor").distinct().crossJoin(F.broadcast(calendar.select("date")))
    series = grid.join(ic.select("factor", "date", "ic"), ["factor", "date"], "left").withColumnRenamed("factor", "code")
    return evaluate(series, {"weight": f"mean(delay(ic, {lag}), {window}, {least})"}, ["code", "date"]).withColumnRenamed("code", "factor")


def ic_weighted(factors: DataFrame, weights: DataFrame) -> DataFrame:
    """(code, date, score) from long factors (factor, code, date, z) and their weights by date."""
    part = factors.join(weights, ["factor", "date"]).withColumn("p", F.col("z") * F.col("weight"))
    return part.groupBy("code", "date").agg(F.sum("p").alias("score"))


def as_of(left: DataFrame, right: DataFrame, values: list[str], right_date: str = "announce", max_rows: int | None = None) -> DataFrame:
    """Latest ``right`` row of the code on or before each ``left`` date (of equal dates, the last by ``seq``).

    One union and one window; with ``max_rows`` an anchor counts for that many later
    calendar rows only (``left`` then needs ``ord``).
    """
    one = right.where(F.col(right_date).isNotNull()).groupBy("code", F.col(right_date).alias("date")).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("seq"))).alias(v) for v in values])
    own = [c for c in left.columns if c not in ("code", "date")]
    both = left.select("code", "date", *own, *[F.lit(None).cast(one.schema[v].dataType).alias(v) for v in values], F.lit(1).alias("__left"), F.lit(None).cast("bigint").alias("__at")).unionByName(
        one.select("code", "date", *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in own], *values, F.lit(0).alias("__left"), F.lit(None).cast("bigint").alias("__at"))
    )
    past = Window.partitionBy("code").orderBy("date", "__left").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.select("code", "date", *own, "__left", *[F.last(v, ignorenulls=True).over(past).alias(v) for v in values], F.last(F.when(F.col("__left") == 0, F.col("date")), ignorenulls=True).over(past).alias("__from"))
    out = filled.where("__left = 1")
    if max_rows is None:
        return out.select("code", "date", *own, *values)
    # The anchor's place is the first calendar row at or after it.
    first = F.min(F.when(F.col("__from").isNotNull(), F.col("ord"))).over(Window.partitionBy("code", "__from"))
    fresh = F.col("__from").isNotNull() & (F.col("ord") - first <= max_rows)
    return out.withColumn("__fresh", fresh).select("code", "date", *own, *[F.when(F.col("__fresh"), F.col(v)).alias(v) for v in values])


def fundamental_factors(df: DataFrame) -> DataFrame:
    """Seven ratios from point-in-time fundamentals and the close."""
    over = lambda a, b: F.try_divide(F.col(a), F.when(F.col(b) != 0, F.col(b)))
    return df.select(
        "code", "date", over("bvps", "close").alias("f_bp"), over("eps", "close").alias("f_ep"), F.col("roe").alias("f_roe"), F.col("gross_margin").alias("f_gm"),
        over("ocfps", "eps").alias("f_ocfq"), F.col("rev_yoy").alias("f_revg"), F.col("profit_yoy").alias("f_profg"),
    )


def padded(code: Column) -> Column:
    """At least six characters, zeros in front."""
    text = code.cast("string")
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def score_table(df: DataFrame, model: str, score: str = "score", eligible: str | None = None) -> DataFrame:
    """Scores as long rows with a rank by date; codes are padded to six digits."""
    order = Window.partitionBy("date").orderBy(F.round(score, RANK_DECIMALS).desc(), "code")
    ok = F.col(eligible) if eligible else F.lit(True)
    return df.where(F.col(score).isNotNull()).select(
        "date", padded(F.col("code")).alias("code"), F.lit(model).alias("model"), F.col(score).alias("score"), F.row_number().over(order).alias("rank"), ok.alias("eligible"),
        F.when(ok, F.lit("")).otherwise("filtered").alias("reason"),
    )


def run_models(panel: DataFrame, models: dict[str, str]) -> DataFrame:
    """Score tables of several models (name to formula), one below the other."""
    if not models:
        raise ValueError("no model given")
    scored = evaluate(panel, {f"m{i}": f for i, f in enumerate(models.values())}, ["code", "date"])
    out = None
    for i, name in enumerate(models):
        own = score_table(scored.select("code", "date", F.col(f"m{i}").alias("score")), name)
        out = own if out is None else out.unionByName(own)
    return out


def picks(panel: DataFrame, factors: list[str], mask: str | None = None, top: int = 101, names: DataFrame | None = None, model: str = "alpha101_composite") -> DataFrame:
    """The best names of the last date by the composite of ``factors`` over names inside ``mask``, from panel to list."""
    scored = evaluate(panel, {"score": composite_formula(factors), "inside": f"b2f({mask or liquidity_mask_formula()})"}, ["code", "date"])
    table = pick(score_table(scored.where("inside = 1"), model), top)
    return table if names is None else table.join(names.select(padded(F.col("code")).alias("code"), "name").dropDuplicates(["code"]), "code", "left")


def pick(scores: DataFrame, n: int = 50) -> DataFrame:
    """The best ``n`` of the last date."""
    last = scores.agg(F.max("date").alias("date"))
    return scores.join(F.broadcast(last), "date").where(F.col("rank") <= n)


def trade_signals(scores: DataFrame, positions: DataFrame, buy_top: int = 20, sell_below: int = 60, max_weight: float = 0.05) -> DataFrame:
    """Buy, hold and sell rows from one date's scores and the current weights (code, current_weight)."""
    held = positions.select("code", F.col("current_weight").cast("double").alias("current_weight"))
    both = scores.where("eligible").join(held, "code", "full").withColumn("current_weight", F.coalesce("current_weight", F.lit(0.0)))
    chosen = F.coalesce(F.col("rank") <= buy_top, F.lit(False))
    marked = both.join(held.select("code", F.lit(True).alias("__owned")), "code", "left").withColumn("__owned", F.coalesce("__owned", F.lit(False))).withColumn("__top", chosen)
    marked = marked.withColumn("__kept", F.col("__owned") & ~F.col("__top") & F.coalesce(F.col("rank") <= sell_below, F.lit(False)))
    targets = marked.agg(F.sum(F.when(F.col("__top") | F.col("__kept"), 1).otherwise(0)).alias("__n"))
    sized = marked.crossJoin(F.broadcast(targets)).withColumn("__w", F.least(F.lit(max_weight), F.try_divide(F.lit(1.0), F.col("__n"))))
    action = F.when(F.col("__top") & (F.col("current_weight") > 0), "hold").when(F.col("__top"), "buy").when(F.col("__kept"), "hold").when(F.col("current_weight") > 0, "sell")
    reason = F.when(F.col("__top"), "top_rank").when(F.col("__kept"), "inside_sell_buffer").when(F.col("current_weight") > 0, "rank_below_sell_buffer")
    out = sized.withColumn("action", action).withColumn("reason", reason).where("action is not null")
    # Positions without a score take the scores' date and model, and their code as a name.
    told = [c for c in ("date", "model") if c in scores.columns]
    if told:
        one = scores.agg(*[F.max(c).alias(f"__{c}") for c in told])
        out = out.crossJoin(F.broadcast(one)).select("*", *[F.col(f"__{c}").alias(f"__its_{c}") for c in told])  # one row
    columns = [F.col(f"__its_{c}").alias(c) for c in told] + [F.col("code"), F.coalesce("name", "code").alias("name") if "name" in scores.columns else F.col("code").alias("name")]
    return out.select(*columns, "action", "current_weight", F.when(F.col("__top") | F.col("__kept"), F.col("__w")).otherwise(0.0).alias("target_weight"), "score", "rank", "reason")


def newey_west(series: DataFrame, value: str = "value", order: str = "date", lags: int = 4) -> DataFrame:
    """t-statistic of a mean with Bartlett weights: the series is lagged, never self-joined."""
    clean = series.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    mean = clean.agg(F.avg(value).alias("__m"), F.count(F.lit(1)).alias("__n"))
    along = Window.orderBy(order)
    centred = clean.crossJoin(F.broadcast(mean)).withColumn("__d", F.col(value) - F.col("__m"))
    lagged = centred.select("__m", "__n", "__d", *[F.lag("__d", k).over(along).alias(f"__l{k}") for k in range(1, lags + 1)])
    total = F.sum(F.col("__d") * F.col("__d"))
    for k in range(1, lags + 1):
        total = total + F.coalesce(F.sum(F.col("__d") * F.col(f"__l{k}")), F.lit(0.0)) * (2 * (1 - k / (lags + 1)))
    out = lagged.agg(F.coalesce(F.max("__n"), F.lit(0)).alias("n"), F.max("__m").alias("mean"), total.alias("__v"))
    error = F.sqrt(F.greatest(F.col("__v"), F.lit(0.0)) / F.col("n") / F.col("n"))
    return out.select("n", "mean", F.when((F.col("n") >= 2) & (error > 0), F.try_divide(F.col("mean"), error)).alias("t"))
