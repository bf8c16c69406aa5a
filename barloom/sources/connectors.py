"""Readers and normalisers for the shapes that market data arrives in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.text import is_share, padded_code, strict_code

SNAPSHOT = T.StructType([T.StructField(n, T.StringType() if n in ("code", "name", "cur", "ind", "sec", "g") else T.DoubleType()) for n in ("code", "name", "pe", "mc", "rev", "profit", "cur", "ind", "sec", "g")])
VENDOR = "array<struct<thscode:string,time:array<string>,table:map<string,array<double>>>>"


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """A bar cache; the format follows the suffix (Parquet, CSV or JSON lines)."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.csv(path, header=True, schema="code string, date date, open double, high double, low double, close double, volume double, amount double")
    if kind in ("json", "jsonl"):
        return spark.read.json(path, schema="code string, date date, open double, high double, low double, close double, volume double, amount double")
    if kind != "parquet":
        raise ValueError(f"unsupported cache {path!r}")
    return spark.read.parquet(path)


def read_snapshot(spark: SparkSession, path: str, market: str, date: str) -> DataFrame:
    return spark.read.json(path, schema=SNAPSHOT, multiLine=True).withColumn("market", F.lit(market)).withColumn("date", F.lit(date).cast("date"))


def latest_date(manifest: DataFrame) -> DataFrame:
    """Last of the dates of a manifest ``{"dates": [...]}``."""
    return manifest.select(F.array_max("dates").alias("date"))


def normalised_history(raw: DataFrame) -> DataFrame:
    """Vendor rows to bars: strict codes, numbers where they parse, rows without date or close dropped."""
    numbers = [F.expr(f"try_cast({c} as double)").alias(c) for c in ("open", "high", "low", "close", "volume", "amount") if c in raw.columns]
    out = raw.select(strict_code(F.col("thscode")).alias("code"), F.expr("try_cast(time as date)").alias("date"), *numbers)
    return out.dropna(subset=["code", "date", "close"])


def flatten_vendor(payload: DataFrame, column: str = "tables") -> DataFrame:
    """Nested tables with ragged lists to one row a time; short lists are padded with NULL."""
    one = payload.select(F.explode(column).alias("t"))
    names = F.map_keys("t.table")
    spread = one.select("t", F.posexplode("t.time").alias("i", "time"), names.alias("names"))
    return spread.select(F.col("t.thscode").alias("thscode"), "time", F.transform_values("t.table", lambda k, v: F.get(v, F.col("i"))).alias("values"))


def code_pool(rows: DataFrame, column: str = "code", name: str | None = None) -> DataFrame:
    """Padded codes of supported shares, each once; with ``name`` the first name of each, in order, as ``name``."""
    own = rows.select(padded_code(F.col(column)).alias("code"), *([F.col(name).alias("name")] if name else []))
    kept = own.where(is_share(F.col("code")))
    return kept.groupBy("code").agg(F.min("name").alias("name")) if name else kept.distinct()


#: What the columns of a pool file may be called.
POOL_NAMES = {"code": ("code", "\u4ee3\u7801"), "name": ("name", "\u540d\u79f0", "name_cn")}


def read_code_pool(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) from a CSV (with a header) or JSON file (records), whatever its columns are called."""
    rows = spark.read.option("multiLine", True).json(path) if path.endswith(".json") else spark.read.option("header", True).csv(path)
    found = {want: next((c for c in rows.columns if c.strip().lower() in names), None) for want, names in POOL_NAMES.items()}
    if not found["code"]:
        raise ValueError(f"no column of codes in {path}")
    named = rows.withColumnRenamed(found["code"], "code")
    return code_pool(named, "code", found["name"] or "code")


def wide_to_long(wide: DataFrame, keys: list[str], name: str = "code", value: str = "value") -> DataFrame:
    """One row for each key and column; columns that are empty everywhere leave no rows."""
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], name, value).where(F.col(value).isNotNull())


def industries(records: DataFrame) -> DataFrame:
    """First of the industry columns that is there, one row a code."""
    present = [c for c in ("ind", "sec", "g") if c in records.columns]
    pick: Column = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in present])
    first = Window.partitionBy("code").orderBy(F.col("ind").isNull(), "ind")
    return records.select("code", pick.alias("ind")).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def top_liquid(bars: DataFrame, n: int, days: int = 60) -> DataFrame:
    """Bars of the ``n`` codes with the highest mean amount over the last dates."""
    last = bars.select("date").distinct().orderBy(F.col("date").desc()).limit(days)
    best = bars.join(F.broadcast(last), "date", "left_semi").groupBy("code").agg(F.avg("amount").alias("a")).where("a is not null").orderBy(F.round("a", 9).desc(), "code").limit(n)
    return bars.join(F.broadcast(best.select("code")), "code", "left_semi")


def pending(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumable fetch still has to get."""
    return wanted.join(cached.select(*keys).distinct(), keys, "left_anti")


def quarter_ends(start: Column, end: Column) -> Column:
    """Array of the quarter ends from ``start`` to ``end``."""
    days = F.transform(F.sequence(F.trunc(start, "quarter"), end, F.expr("interval 3 months")), lambda d: F.last_day(F.add_months(d, 2)))
    return F.filter(days, lambda d: (d >= start) & (d <= end))


def one_row_a_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that break a one-to-one merge."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
