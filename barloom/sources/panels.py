"""Dense panels from long tables, as DataFrames and as SQL.

A panel has one row for each pair of a code and a date of its calendar:
``code, date, ord, open, high, low, close, volume, amount, vwap, returns[, ind]``.
``ord`` numbers the dates from 0.  The grid is made from distinct codes and distinct
dates, both small next to the bars; missing bars are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.plans.expr import nz, safe_div
from barloom.session import read_table, remembered

BARS = ("open", "high", "low", "close", "volume", "amount")
VWAP_RULES = ("lots", "shares", "typical")


def calendar(bars: DataFrame) -> DataFrame:
    """Distinct dates with their ordinal.  One row a date, so one partition is enough for the numbering."""
    return bars.select("date").where("date is not null").distinct().withColumn("ord", (F.row_number().over(Window.orderBy("date")) - 1).cast("bigint"))


def densify(bars: DataFrame, values: list[str] | None = None) -> DataFrame:
    """The full grid of codes and dates, left-joined with the bars."""
    values = values or [c for c in bars.columns if c not in ("code", "date")]
    codes = bars.select("code").where("code is not null").distinct()
    grid = codes.crossJoin(F.broadcast(calendar(bars)))  # a calendar has some thousand rows at most
    return grid.join(bars.select("code", "date", *values), ["code", "date"], "left")


def with_vwap(panel: DataFrame, rule: str) -> DataFrame:
    """Add ``vwap`` by one of three conventions (and ``amount``, where it isn't given)."""
    volume = nz(F.col("volume"))
    if rule == "lots":
        return panel.withColumn("vwap", F.try_divide(F.col("amount"), volume * 100))
    if rule == "shares":
        return panel.withColumn("vwap", F.try_divide(F.col("amount"), volume))
    if rule == "typical":
        typical = panel.withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3)
        return typical.withColumn("amount", F.col("vwap") * F.col("volume"))
    raise ValueError(f"unknown vwap rule {rule!r}")


def with_returns(panel: DataFrame, fill: bool = True) -> DataFrame:
    """Add ``returns``: relative change of the close, missing closes filled forward unless told not to."""
    along = Window.partitionBy("code").orderBy("date")
    close: Column = F.last("close", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)) if fill else F.col("close")
    held = panel.withColumn("__c", close)
    return held.withColumn("returns", safe_div(F.col("__c"), F.lag("__c").over(along)) - 1).drop("__c")


def build_panel(bars: DataFrame, rule: str = "shares", industries: DataFrame | None = None) -> DataFrame:
    """Long bars (code, date, open, high, low, close, volume, amount) as a dense panel."""
    cast = [F.expr(f"try_cast({c} as double)").alias(c) for c in BARS if c in bars.columns]
    panel = with_returns(with_vwap(densify(bars.select("code", "date", *cast)), rule))
    if industries is not None:
        panel = panel.join(F.broadcast(industries.select("code", "ind").dropDuplicates(["code"])), "code", "left").withColumn("ind", F.coalesce("ind", F.lit("UNKNOWN")))
    return panel


def order_key(time: str, ident: Column) -> Column:
    """Time and id as one number, so that first and last values need no sort before the shuffle.

    Fields of the time are read as they are written; the session's time zone has no part.
    ``ident`` stays below 10**17.
    """
    seconds = (F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400 + F.hour(time) * 3_600 + F.minute(time) * 60).cast("bigint")
    micros = seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), F.col(time)) * 1_000_000).cast("bigint")
    return (micros.cast("decimal(20,0)") * F.lit(10**17).cast("decimal(18,0)")).cast("decimal(38,0)") + ident.cast("decimal(18,0)")


# --- Panels over the driver's tables --------------------------------------------------
# Bars are far fewer than the rows that they are made of, and a panel reads them three
# times (codes, dates, values): they are written first.  The panel is written too, and
# every query of the application over the same tables starts from that.


def brand_week_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a brand's unit price by week of shipping."""
    line = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("code"))
    trade = line.join(part, "l_partkey").select(
        "code", F.trunc(F.to_date("l_shipdate"), "week").alias("date"), order_key("l_shipdate", F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("at"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity", "l_extendedprice",
    )
    return trade.groupBy("code", "date").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"),
        F.sum("l_quantity").cast("double").alias("volume"), F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("amount"),
    )


def brand_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("code")).distinct()
    return brands.withColumn("ind", F.concat(F.lit("g"), (F.regexp_extract("code", r"(\d+)$", 1).cast("int") % 5).cast("string")))


def brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part")]
    bars = remembered(spark, "brand-week-bars", sources, lambda: brand_week_bars(spark, sf_dir))
    return remembered(spark, "brand-week", sources, lambda: build_panel(bars, "shares", brand_industries(spark, sf_dir)))


def user_day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a user's event values by day."""
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("code"), F.to_date("ts").alias("date"), order_key("ts", F.col("event_id")).alias("at"), "value")
    return e.groupBy("code", "date").agg(
        F.min_by("value", "at").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "at").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("amount"),
    )


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [f"{sf_dir}/events.parquet"]
    bars = remembered(spark, "user-day-bars", sources, lambda: user_day_bars(spark, sf_dir))
    return remembered(spark, "user-day", sources, lambda: build_panel(bars, "shares"))


_DENSE = """
{p}_d as (select c.code, d.date, d.ord, b.open, b.high, b.low, b.close, b.volume, b.amount
  from (select distinct code from {p}_b) c cross join (select date, row_number() over (order by date) - 1 as ord from (select distinct date from {p}_b)) d
  left join {p}_b b on b.code = c.code and b.date = d.date),
{p}_c as (select *, amount / nullif(volume, 0) as vwap, last_value(close ignore nulls) over (partition by code order by date rows between unbounded preceding and current row) as held from {p}_d),
{p} as (select * exclude (held), case when p <> 0 then held / p when p = 0 and held > 0 then 'inf'::double when p = 0 and held < 0 then '-inf'::double end - 1 as returns{ind}
  from (select *, lag(held) over (partition by code order by date) as p from {p}_c))"""

BRAND_WEEK_SQL = """panel_t as (select p_brand as code, date_trunc('week', l_shipdate)::date as date, l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity as price, l_quantity, l_extendedprice
  from lineitem join part on p_partkey = l_partkey),
panel_b as (select code, date, arg_min(price, (l_shipdate, l_orderkey, l_linenumber)) as open, max(price) as high, min(price) as low,
  arg_max(price, (l_shipdate, l_orderkey, l_linenumber)) as close, sum(l_quantity)::double as volume, sum(l_extendedprice::decimal(18,4))::double as amount from panel_t group by 1, 2),""" + _DENSE.format(
    p="panel", ind=", 'g' || (regexp_extract(code, '(\\d+)$', 1)::int % 5) as ind"
)

USER_DAY_SQL = """panel_b as (select user_id as code, ts::date as date, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low,
  arg_max(value, (ts, event_id)) as close, count(*)::double as volume, sum(value::decimal(18,4))::double as amount from events group by 1, 2),""" + _DENSE.format(p="panel", ind="")
