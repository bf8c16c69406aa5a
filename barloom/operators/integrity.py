"""Audits and validations: exclusive funnels, coverage, content hashes, constraints, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.text import is_special_treatment


def attribute_funnel(pool: DataFrame, attributes: DataFrame, max_rows: int = 4) -> DataFrame:
    """(date, code, status): pool names by the first reason that excludes them, from the latest attributes that are fresh enough.

    ``attributes``: code, anchor (a calendar ordinal), name, float_cap, industry.
    Anchors are few, so they are spread over the rows that they can serve and joined by equality.
    """
    served = attributes.withColumn("ord", F.explode(F.sequence("anchor", F.col("anchor") + max_rows)))
    latest = served.groupBy("code", "ord").agg(F.max_by(F.struct("name", "float_cap", "industry"), "anchor").alias("a"))
    joined = pool.join(latest, ["code", "ord"], "left")
    cap = F.col("a.float_cap")
    status = F.when(F.col("a").isNull(), "missing").when(is_special_treatment(F.col("a.name")), "st").when(cap.isNull() | F.isnan(cap) | (cap <= 0) | (cap == float("inf")), "cap").otherwise("ok")
    return joined.select("date", "code", status.alias("status"))


def funnel_audit(funnel: DataFrame) -> DataFrame:
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("bigint")
    return funnel.groupBy("date").agg(F.count(F.lit(1)).alias("eligible_count"), n("missing").alias("missing_count"), n("st").alias("st_count"), n("cap").alias("cap_count"), n("ok").alias("final_count"))


def audit_adds_up(audit: DataFrame) -> DataFrame:
    """Dates whose exclusions don't reconcile; there should be none."""
    return audit.where(F.col("eligible_count") != F.col("missing_count") + F.col("st_count") + F.col("cap_count") + F.col("final_count"))


def content_hash(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One hash of all rows that doesn't depend on their order: row digests are added up in two parts."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in [*keys, *values]])
    digest = F.sha2(text, 256)
    part = lambda a: F.sum(F.conv(F.substring(digest, a, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count(F.lit(1)).alias("rows"), part(1).alias("low"), part(13).alias("high"))


def coverage(pool: DataFrame, minutes: DataFrame) -> DataFrame:
    """Share of the pool, by date, that has accepted minute bars."""
    have = minutes.where("reason = 'ok'").select("date", "code", F.lit(1).alias("have"))
    return pool.select("date", "code").join(have, ["date", "code"], "left").groupBy("date").agg(F.count(F.lit(1)).alias("pool"), F.count("have").alias("covered"), (F.count("have") / F.count(F.lit(1))).alias("share"))


def broken_ranks(pool: DataFrame, rank: str = "liquidity_rank", top: int = 500) -> DataFrame:
    """Dates whose ranks aren't 1 to n without gaps, with n at most ``top``, or that have a code twice."""
    n = F.count(F.lit(1))
    each = pool.groupBy("date").agg(n.alias("n"), F.max(rank).alias("most"), F.count_distinct(rank).alias("ranks"), F.count_distinct("code").alias("codes"))
    return each.where((F.col("n") != F.col("most")) | (F.col("n") != F.col("ranks")) | (F.col("n") != F.col("codes")) | (F.col("n") > top))


def aligned(left: DataFrame, right: DataFrame, how: str = "full") -> DataFrame:
    """Two panels on common axes: the union of their keys, or those that both have."""
    return left.withColumnRenamed("value", "left_value").join(right.withColumnRenamed("value", "right_value"), ["code", "date"], how)


def verdict(value: Column, least: float) -> Column:
    return F.when(value.isNull() | F.isnan(value), "unknown").when(value >= least, "met").otherwise("missed")


def running_drawdown(series: DataFrame, value: str = "nav") -> DataFrame:
    """Drawdown from the highest value so far, by account."""
    peak = F.max(value).over(Window.partitionBy("account").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return series.select("account", "date", value, (F.try_divide(F.col(value), peak) - 1).alias("drawdown"))


def last_orders(orders: DataFrame, n: int = 30) -> DataFrame:
    """The latest ``n`` orders of each account."""
    order = Window.partitionBy("account").orderBy(F.col("date").desc(), F.col("seq").desc())
    return orders.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def visible_panel(panel: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of the names that an account may see."""
    return panel.join(F.broadcast(allowed.select("code").distinct()), "code", "left_semi")


def listed(records: DataFrame, least_cap: float) -> DataFrame:
    """Companies over a market cap, without second counters of a listed share, each once."""
    first = Window.partitionBy("code").orderBy(F.col("mc").desc_nulls_last(), "name")
    return records.where(F.col("mc") >= least_cap).where(~F.coalesce(F.col("name").rlike(r"-R$|[-]WR$"), F.lit(False))).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
