"""Snapshot analytics: market tables by date, day-over-day changes, quantile limits, retention, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of a currency for one US dollar.
PER_DOLLAR = {"USD": 1.0, "HKD": 7.80, "CNY": 7.15}
KEPT_DATES = 100


def in_dollars(amount: Column, currency: Column) -> Column:
    rate = F.create_map(*[F.lit(x) for kv in PER_DOLLAR.items() for x in kv])
    return amount / F.try_element_at(rate, currency)


def recent_dates(snapshots: DataFrame, n: int = 90) -> DataFrame:
    return snapshots.select("date").distinct().orderBy(F.col("date").desc()).limit(n)


def companies(snapshots: DataFrame) -> DataFrame:
    """Every (market, code) with the name it had first."""
    return snapshots.groupBy("market", "code").agg(F.min_by("name", F.struct("date", "name")).alias("name"))


def cap_changes(snapshots: DataFrame) -> DataFrame:
    """Relative change of the cap against the date before in the union of all dates; missing if the company wasn't there."""
    dates = snapshots.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))
    placed = snapshots.join(F.broadcast(dates), "date")
    along = Window.partitionBy("market", "code").orderBy("i")
    before = F.when(F.lag("i").over(along) == F.col("i") - 1, F.lag("mc").over(along))
    return placed.select("date", "market", "code", "mc", (F.try_divide(F.col("mc"), F.when(before != 0, before)) - 1).alias("change"))


def is_loss(pe: Column) -> Column:
    return ~F.coalesce(pe > 0, F.lit(False))


def pe_limits(snapshots: DataFrame) -> DataFrame:
    """The 2nd and 98th percentiles of positive ratios by date, kept to a readable range."""
    at = lambda p: F.percentile(F.when(F.col("pe") > 0, F.col("pe")), F.lit(p))
    raw = snapshots.groupBy("date").agg(at(0.02).alias("a"), at(0.98).alias("z"))
    low = F.greatest(F.lit(1.0), F.col("a"))
    return raw.select("date", low.alias("low"), F.greatest(F.least(F.lit(500.0), F.col("z")), low * 2).alias("high"))


def scales(snapshots: DataFrame) -> DataFrame:
    """Radius by square root, height by clamped logarithm, colour by decimal logarithm of the cap."""
    return snapshots.select("date", "market", "code", F.sqrt("mc").alias("radius"), F.ln(F.greatest(F.lit(1.0), F.least(F.lit(500.0), F.coalesce("pe", F.lit(1.0))))).alias("height"), F.log10(F.greatest(F.lit(1.0), F.col("mc"))).alias("colour"))


def status_counts(snapshots: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return snapshots.groupBy("date", "market").agg(F.count(F.lit(1)).alias("n"), n(is_loss(F.col("pe"))).alias("losses"), n(F.col("mc") > 0).alias("with_cap"))


def sector_counts(snapshots: DataFrame) -> DataFrame:
    """Companies by sector on the last date of each market."""
    last = snapshots.groupBy("market").agg(F.max("date").alias("date"))
    return snapshots.join(F.broadcast(last), ["market", "date"]).groupBy("market", "sec").agg(F.count(F.lit(1)).alias("n"))


def common_date(snapshots: DataFrame, markets: list[str]) -> DataFrame:
    """The last date on which all the markets have data."""
    return snapshots.where(F.col("market").isin(markets)).groupBy("date").agg(F.count_distinct("market").alias("k")).where(F.col("k") == len(markets)).agg(F.max("date").alias("date"))


def retained(snapshots: DataFrame, keep: int = KEPT_DATES) -> DataFrame:
    """Rows of the last ``keep`` dates of each market."""
    dates = snapshots.select("market", "date").distinct().withColumn("r", F.row_number().over(Window.partitionBy("market").orderBy(F.col("date").desc()))).where(F.col("r") <= keep).drop("r")
    return snapshots.join(F.broadcast(dates), ["market", "date"], "left_semi")


def mapped_industries(records: DataFrame, native: DataFrame, groups: DataFrame, overrides: DataFrame) -> DataFrame:
    """Native industry to group and sector; a code's own entry wins."""
    own = overrides.select("code", F.col("group").alias("own_group"))
    joined = records.join(F.broadcast(native.select("industry", F.col("group").alias("native_group"))), "industry", "left").join(F.broadcast(own), "code", "left")
    named = joined.withColumn("group", F.coalesce("own_group", "native_group", F.lit("unknown"))).drop("own_group", "native_group")
    return named.join(F.broadcast(groups.select("group", "sector")), "group", "left").withColumn("sector", F.coalesce("sector", F.lit("unknown")))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows, one a key: the new one, and of several the last by ``seq``."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.col("__new").desc(), F.col("seq").desc())
    return both.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r", "__new")


def appended(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows, one a key: the first."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy("__new", "seq")
    return both.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r", "__new")


def combined_first(base: DataFrame, extra: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Base values, holes filled from the extra table."""
    other = extra.select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    return base.select(*keys, *values).join(other, keys, "full").select(*keys, *[F.coalesce(v, f"__{v}").alias(v) for v in values])


def fallback_lookup(left: DataFrame, table: DataFrame, key: str, variants: list[Column], value: str) -> DataFrame:
    """First hit of several spellings of a key, in order."""
    out = left
    for i, v in enumerate(variants):
        one = table.select(F.col(key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        out = out.withColumn(f"__w{i}", v).join(F.broadcast(one), F.col(f"__w{i}") == F.col(f"__k{i}"), "left")
    hit = F.coalesce(*[F.col(f"__v{i}") for i in range(len(variants))])
    return out.select(*left.columns, hit.alias(value))
