"""Registry of the library's queries: each a Spark query and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.alphas import FORMULAS
from barloom.plans import expr
from barloom.sources import panels

Query = Callable[[SparkSession, str], DataFrame]
DECIMALS = 6
#: Added before rounding: keeps round decimals and binary fractions off the edges between two results.
NUDGE = 2.3e-8
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """Doubles rounded, without negative zero, and dates as text, as the oracles have them."""
    kinds = {"double": lambda c: F.round(F.col(c) + NUDGE, decimals) + F.lit(0.0), "date": lambda c: F.col(c).cast("string")}
    return df.select(*[kinds.get(t, F.col)(c).alias(c) for c, t in df.dtypes])


def rounded_sql(columns: list[str], source: str = "result", keys: str = "code, date::varchar as date", decimals: int = DECIMALS) -> str:
    return f"select {keys}, " + ", ".join(f"round({c} + {NUDGE}, {decimals}) + 0.0 as {c}" for c in columns) + f" from {source}"


PANELS: dict[str, tuple[Query, str]] = {"brand_week": (panels.brand_week, panels.BRAND_WEEK_SQL), "user_day": (panels.user_day, panels.USER_DAY_SQL)}


def formula_query(name: str, formulas: dict[str, str], panel: str = "brand_week") -> None:
    """Register formulas over a panel, and the same formulas as SQL."""
    build, sql = PANELS[panel]
    QUERIES[name] = lambda spark, sf_dir: rounded(expr.evaluate(build(spark, sf_dir), formulas, ["code", "date"]))
    SQL[name] = f"with {sql},\n{expr.to_sql('panel', formulas)}\n{rounded_sql(list(formulas))}"


for _number, _formula in FORMULAS.items():
    # Number 84 is a power with values up to 1e164: on a log scale, so that the last digits don't decide.
    formula_query(f"alpha_{_number:03d}", {"value": f"sgn({_formula})*ln(1+abs({_formula}))" if _number == 84 else _formula})
