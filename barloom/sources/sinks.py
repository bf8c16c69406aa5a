"""Writers: tables, keyed upserts, partitions that are replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.operators.snapshot import upserted


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def write_bars(df: DataFrame, path: str) -> None:
    """Bars by day: only the days in ``df`` are replaced, and a day's files appear together."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def write_snapshot(df: DataFrame, path: str, least: int) -> None:
    """A snapshot, unless it has suspiciously few rows."""
    n = df.count()
    if n < least:
        raise ValueError(f"only {n} rows; at least {least} are expected")
    df.write.mode("overwrite").json(path)


def upsert(new: DataFrame, path: str, keys: list[str]) -> None:
    """Merge rows into a Parquet table by key.  The merged table is written beside the old one and then takes its place."""
    spark = new.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    merged = upserted(spark.read.parquet(path), new, keys) if fs.exists(hadoop(path)) else upserted(new.limit(0), new, keys)
    beside, behind = f"{path}.new", f"{path}.old"
    merged.write.mode("overwrite").parquet(beside)
    if fs.exists(hadoop(path)):
        fs.delete(hadoop(behind), True)
        fs.rename(hadoop(path), hadoop(behind))
    fs.rename(hadoop(beside), hadoop(path))
    fs.delete(hadoop(behind), True)
