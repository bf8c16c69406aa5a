"""Signals of one day: heat lists, attention rules, today's score; and the vendor rows that they are made of."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import text
from barloom.plans.expr import RANK_DECIMALS, pct_rank

#: Names on a list, weights of the three ranks, names of today's score.
LISTED, ATTENTION, TODAY = 20, (0.5, 0.3, 0.2), 101


def _percentile(x: str, descending: bool = False) -> Column:
    every = Window.partitionBy(F.lit(1))  # candidates of one day
    key = F.round(x, RANK_DECIMALS)
    return pct_rank(key, every.orderBy(key.desc() if descending else key), every)


def attention(candidates: DataFrame, min_age: int = 5) -> DataFrame:
    """Candidates (code, name, now, past, age, rise, float_a, shares) that qualify, with three percentile ranks."""
    listed = ~text.is_special_treatment(F.col("name")) & (F.col("age") >= min_age) & (F.col("now") > 0) & (F.col("past") > 0) & (F.col("float_a") / F.col("shares") <= 1)
    found = candidates.where(listed).select("code", "rise", (F.col("now") / F.col("past") - 1).alias("momentum"), (F.col("float_a") / F.col("shares")).alias("ratio"))
    return found.select("*", _percentile("rise").alias("p1"), _percentile("momentum").alias("p2"), _percentile("ratio", True).alias("p3"))


def attention_weighted(candidates: DataFrame, top: int = LISTED) -> DataFrame:
    score = sum((w * F.col(p) for w, p in zip(ATTENTION, ("p1", "p2", "p3"), strict=True)), F.lit(0.0))
    return attention(candidates).withColumn("score", score).orderBy(F.round("score", 9).desc(), F.col("rise").desc(), "code").limit(min(top, LISTED)).select("code", "score")


def attention_funnel(candidates: DataFrame, top: int = LISTED) -> DataFrame:
    """Of those that rose, the half with the smallest float; then by the rise of attention."""
    every = Window.partitionBy(F.lit(1))
    placed = attention(candidates).where("momentum > 0").withColumn("r", F.row_number().over(every.orderBy(F.round("ratio", 9), "code"))).withColumn("n", F.count(F.lit(1)).over(every))
    return placed.where(F.col("r") <= F.ceil(F.col("n") / 2)).orderBy(F.col("rise").desc(), "code").limit(min(top, LISTED)).select("code", F.col("rise").alias("score"))


def heat(rows: DataFrame, code: str = "code", value: str = "value", top: int = LISTED) -> DataFrame:
    """(ticker, factor_value): the hottest tickers that a vendor's rows name, each at its highest finite value."""
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf"))
    named = rows.where(finite).select(text.extracted_ticker(F.col(code)).alias("ticker"), F.col(value).alias("v")).where("ticker is not null")
    return named.groupBy("ticker").agg(F.max("v").alias("factor_value")).orderBy(F.col("factor_value").desc(), "ticker").limit(top)


def normalised_spot(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Vendor quotations with ``code`` (from ``thscode``), ``close`` (from ``latest``) and, where missing, ``name``."""
    out = rows.withColumnRenamed("latest", "close") if "latest" in rows.columns else rows
    if "code" not in out.columns:
        out = out.withColumn("code", F.substring(F.col("thscode").cast("string"), 1, 6))
    out = out.withColumn("code", text.padded_code(F.col("code")))
    if names is None or "name" in out.columns:
        return out
    return out.join(names.select(text.padded_code(F.col("code")).alias("code"), "name").dropDuplicates(["code"]), "code", "left")


def score_today(spot: DataFrame, top: int = TODAY) -> DataFrame:
    """(rank, code, ..., alpha101, score): one day's quotations by formula 101, as a percentile of those that moved."""
    missing = {"code", "open", "high", "low", "close"} - set(spot.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    prices = ("open", "high", "low", "close")
    typed = spot.select(*[c for c in spot.columns if c not in prices], *[F.expr(f"try_cast({c} as double)").alias(c) for c in prices]).dropna(subset=list(prices)).where("high > low")
    scored = typed.withColumn("alpha101", (F.col("close") - F.col("open")) / (F.col("high") - F.col("low") + 0.001)).withColumn("score", F.round(_percentile("alpha101") * 100, 2))
    order = [F.col("score").desc(), F.col("alpha101").desc(), F.col("code")]
    return scored.orderBy(*order).limit(top).select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("rank"), *scored.columns)


def batches(codes: Iterable[str], size: int) -> Iterator[list[str]]:
    """Requests of at most ``size`` codes."""
    if size < 1:
        raise ValueError("a batch holds at least one code")
    own = list(codes)
    yield from (own[k : k + size] for k in range(0, len(own), size))


def adjusted_daily(rows: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """(code, date, open, close) of vendor rows (thscode, time, open, close, seq): usable ones, the first of each code and date."""
    typed = rows.select(
        text.strict_code(F.col("thscode")).alias("code"), F.expr("try_cast(left(time, 10) as date)").alias("date"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in ("open", "close")], "seq"
    )
    ok = F.col("code").isNotNull() & F.col("date").isNotNull()
    for c in ("open", "close"):
        ok &= (F.col(c) > 0) & (F.col(c) < float("inf"))
    kept = typed.where(ok)
    if codes is not None:
        kept = kept.join(codes.select("code").distinct(), "code", "left_semi")
    return kept.groupBy("code", "date").agg(F.min_by(F.struct("open", "close"), "seq").alias("x")).select("code", "date", "x.open", "x.close")


_PAGE = "result struct<data: array<struct<SECURITY_CODE: string, NOTICE_DATE: string, REPORT_DATE: string, PREDICT_TYPE: string, ADD_AMP_LOWER: double, ADD_AMP_UPPER: double>>>"


def forecast_events(pages: DataFrame, column: str = "payload") -> DataFrame:
    """(code, notice_date, report_date, type, amp_lower, amp_upper): a row for each notice of JSON pages; pages without any give none."""
    one = pages.select(F.explode(F.from_json(column, _PAGE)["result"]["data"]).alias("x"))
    return one.select(
        text.padded_code(F.col("x.SECURITY_CODE")).alias("code"), F.substring("x.NOTICE_DATE", 1, 10).alias("notice_date"), F.substring("x.REPORT_DATE", 1, 10).alias("report_date"),
        F.col("x.PREDICT_TYPE").alias("type"), F.col("x.ADD_AMP_LOWER").alias("amp_lower"), F.col("x.ADD_AMP_UPPER").alias("amp_upper"),
    )
