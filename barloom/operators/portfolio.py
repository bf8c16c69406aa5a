"""Path-dependent parts: the event-driven simulation, the daily account step, account replay.

What happens on a day depends on the cash and shares that the days before left, so a
portfolio is folded in order.  Portfolios are independent: each is a group of its own,
and its rows are its targets and the prices of the names it can hold.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.research import newey_west
from barloom.session import ship_package

#: Amounts of money and shares below this are none.
TINY = 1e-9
SIMULATED = "portfolio string, date date, nav double, returns double, turnover double, cost double, trades long"
LEDGER = "portfolio string, signal_date date, date date, seq long, code string, side string, shares double, price double, notional double, cost double, status string"


class Book(NamedTuple):
    """What a fold of a portfolio gives: worth before and after trading, and the money moved into each code, by day."""

    before: np.ndarray
    nav: np.ndarray
    flow: np.ndarray


def run_book(price: np.ndarray, mark: np.ndarray, no_buy: np.ndarray, no_sell: np.ndarray, aims: np.ndarray, cost_bps: float = 20) -> Book:
    """Fold a portfolio that starts with 1 in cash; all arguments are (day, code) tables.

    ``aims`` holds target weights on days that set some (NaN elsewhere); they are traded
    toward at the next day's price.  Names without a price, or blocked on the side that they
    would trade, are left alone.  Sales come first; purchases share what cash there is, fees
    included.
    """
    rate, days = cost_bps / 1e4, len(price)
    tradable = np.isfinite(price) & (price > 0)
    price, mark = np.where(tradable, price, 1.0), np.where(np.isfinite(mark) & (mark > 0), mark, 0.0)
    asked = np.isfinite(aims)
    cash, shares = 1.0, np.zeros(price.shape[1])
    book = Book(np.empty(days), np.empty(days), np.zeros(price.shape))
    for t in range(days):
        book.before[t] = cash + shares @ mark[t]
        if t and asked[t - 1].any():
            own = shares * price[t]
            gap = np.where(asked[t - 1], aims[t - 1], 0.0) * book.before[t] - own
            out = np.where(tradable[t] & ~no_sell[t], np.clip(-gap, 0.0, own), 0.0)
            cash += out.sum() * (1 - rate)
            into = np.where(tradable[t] & ~no_buy[t] & asked[t - 1], np.maximum(gap, 0.0), 0.0)
            needed = into.sum() * (1 + rate)
            into *= min(1.0, cash / needed) if needed > 0 else 0.0
            cash -= into.sum() * (1 + rate)
            book.flow[t] = into - out
            shares += book.flow[t] / price[t]
        book.nav[t] = cash + shares @ mark[t]
    return book


def _grids(targets: DataFrame, prices: DataFrame, limits: DataFrame) -> DataFrame:
    """A dense (date, code) grid of each portfolio: its names, their prices, marks and blocks, and its targets."""
    along = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    price = F.when((F.col("open") > 0) & (F.col("open") < float("inf")), F.col("open"))
    quotes = prices.withColumn("price", price).withColumn("mark", F.last("price", ignorenulls=True).over(along)).join(limits, ["code", "date"], "left")
    names = targets.select("portfolio", "code").distinct()
    rows = names.join(quotes, "code").join(targets.select("portfolio", "date", "code", "weight"), ["portfolio", "date", "code"], "left")
    return rows.select("portfolio", "date", "ord", "code", "price", "mark", F.coalesce("buy_blocked", F.lit(True)).alias("no_buy"), F.coalesce("sell_blocked", F.lit(True)).alias("no_sell"), "weight")


def _folded(frame: pd.DataFrame, cost_bps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, Book]:
    """Dates, codes and prices of a portfolio's grid, and its book."""
    frame = frame.sort_values(["ord", "code"])
    shape = (frame["date"].nunique(), frame["code"].nunique())
    table = lambda c, kind: frame[c].to_numpy(kind).reshape(shape)
    price = table("price", float)
    book = run_book(price, table("mark", float), table("no_buy", bool), table("no_sell", bool), table("weight", float), cost_bps)
    return table("date", object)[:, 0], table("code", object)[0], price, book


def simulate(targets: DataFrame, prices: DataFrame, limits: DataFrame, cost_bps: float = 20) -> DataFrame:
    """Simulate every portfolio of ``targets(portfolio, date, code, weight)`` over dense ``prices(code, date, ord, open)``."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        dates, _, _, book = _folded(frame, cost_bps)
        moved = np.abs(book.flow).sum(1)
        out = {
            "portfolio": frame["portfolio"].iloc[0], "date": dates, "nav": book.nav, "returns": np.append(0.0, book.nav[1:] / book.nav[:-1] - 1),
            "turnover": np.divide(moved, book.before, out=np.full(len(moved), np.nan), where=book.before > 0), "cost": moved * cost_bps / 1e4, "trades": (book.flow != 0).sum(1),
        }
        return pd.DataFrame(out)

    ship_package(targets.sparkSession)
    return _grids(targets, prices, limits).groupBy("portfolio").applyInPandas(run, SIMULATED)


def trade_ledger(targets: DataFrame, prices: DataFrame, limits: DataFrame, cost_bps: float = 20) -> DataFrame:
    """The trades behind :func:`simulate`, numbered in order: sales of a day before its purchases, each side by code."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        dates, codes, price, book = _folded(frame, cost_bps)
        day, name = np.nonzero(book.flow)
        flow = book.flow[day, name]
        turn = np.lexsort((name, flow > 0, day))
        day, name, flow = day[turn], name[turn], flow[turn]
        amount, at = np.abs(flow), price[day, name]
        out = {
            "portfolio": frame["portfolio"].iloc[0], "signal_date": dates[day - 1], "date": dates[day], "seq": np.arange(len(day)), "code": codes[name], "side": np.where(flow > 0, "buy", "sell"),
            "shares": amount / at, "price": at, "notional": amount, "cost": amount * cost_bps / 1e4, "status": "filled",
        }
        return pd.DataFrame(out)

    ship_package(targets.sparkSession)
    return _grids(targets, prices, limits).groupBy("portfolio").applyInPandas(run, LEDGER)


def portfolio_metrics(strategy: DataFrame, benchmark: DataFrame, days: int = 252) -> DataFrame:
    """Totals, annual returns, Sharpe and information ratio, drawdown, monthly win rate, turnover, t-statistic of the excess."""
    both = strategy.select("date", F.col("returns").alias("s"), "turnover").join(benchmark.select("date", F.col("returns").alias("b")), "date").where("s is not null and b is not null and not isnan(s) and not isnan(b)")
    both = both.withColumn("equity", F.product(F.col("s") + 1.0).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("dd", F.col("equity") / F.max("equity").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    month = both.groupBy(F.date_trunc("month", "date").alias("m")).agg(F.product(F.col("s") + 1.0).alias("s"), F.product(F.col("b") + 1.0).alias("b")).agg(F.avg(F.when(F.col("s") > F.col("b"), 1.0).otherwise(0.0)).alias("monthly_win_rate"))
    total: dict[str, Column] = {k: F.product(F.col(k) + 1.0) - 1.0 for k in ("s", "b")}
    n = F.count(F.lit(1))
    annual = {k: F.pow(v + 1.0, F.lit(float(days)) / n) - 1.0 for k, v in total.items()}
    ratio = lambda x: F.when(F.stddev_pop(x) > 0, F.try_divide(F.avg(x), F.stddev_pop(x)) * F.sqrt(F.lit(float(days))))
    out = both.agg(
        total["s"].alias("strategy_total"), total["b"].alias("benchmark_total"), annual["s"].alias("strategy_annual"), annual["b"].alias("benchmark_annual"), ratio(F.col("s")).alias("sharpe"),
        ratio(F.col("s") - F.col("b")).alias("information_ratio"), F.min("dd").alias("max_drawdown"), (F.sum("turnover") * days / n).alias("annual_turnover"),
    )
    t = newey_west(both.select("date", (F.col("s") - F.col("b")).alias("value"))).select(F.col("t").alias("excess_nw_t"))
    return out.withColumn("annual_excess", F.col("strategy_annual") - F.col("benchmark_annual")).crossJoin(month).crossJoin(t)  # one row each


# --- The daily account -------------------------------------------------------------------


class Day(NamedTuple):
    """What an account sees of a date: series by code, and the weights that its strategy would set."""

    date: str
    close: pd.Series
    mark: pd.Series
    bench_return: float
    targets: pd.Series


@dataclass
class Account:
    """A paper account: cash, shares by code, a benchmark of the same capital, weights to fill on the next day."""

    cash: float
    bench: float
    shares: dict[str, float] = field(default_factory=dict)
    due: dict[str, float] | None = None
    age: int | None = None
    seen: str | None = None

    @classmethod
    def of(cls, capital: float) -> Account:
        return cls(capital, capital)

    def worth(self, mark: pd.Series) -> float:
        """Value of the shares that have a price."""
        known = mark.reindex(list(self.shares)).astype(float)
        return float((known.where(known.gt(0) & np.isfinite(known), 0.0) * pd.Series(self.shares, dtype=float)).sum())

    def fill(self, day: Day, cost_bps: float) -> pd.DataFrame:
        """Trade toward the weights that are due, at the day's prices; names without one wait for the next weights."""
        total, aims, own = self.cash + self.worth(day.mark), pd.Series(self.due, dtype=float), pd.Series(self.shares, dtype=float)
        book = pd.DataFrame({"own": own, "aim": aims}).fillna(0.0).sort_index()
        book["price"] = day.close.reindex(book.index).astype(float)
        book = book[book["price"].gt(0) & np.isfinite(book["price"])]
        book["value"] = book["aim"] * total - book["own"] * book["price"]
        book = book[book["value"].abs() >= TINY]
        book["cost"] = book["value"].abs() * cost_bps / 1e4
        self.cash -= float((book["value"] + book["cost"]).sum())
        left = own.add(book["value"] / book["price"], fill_value=0.0)
        self.shares, self.due = left[left.abs() >= TINY].to_dict(), None
        sides = np.where(book["value"] > 0, "buy", "sell")
        return pd.DataFrame({"date": day.date, "ticker": book.index, "side": sides, "shares": (book["value"] / book["price"]).round(4), "price": book["price"].round(4), "value": book["value"].round(2), "cost": book["cost"].round(2)})

    @property
    def idle(self) -> bool:
        """Whether weights were never set."""
        return self.age is None

    def rebalance_due(self, every: int) -> bool:
        return self.idle or self.age >= every

    def advance(self, day: Day, every: int, cost_bps: float = 10) -> tuple[dict | None, pd.DataFrame]:
        """Fill, value, and set weights if it is time; (row of the day, orders).  A date at or before the last changes nothing."""
        if self.seen is not None and day.date <= self.seen:
            return None, pd.DataFrame()
        orders = pd.DataFrame() if self.due is None else self.fill(day, cost_bps)
        held = self.worth(day.mark)
        self.bench *= 1 + day.bench_return
        self.seen, self.age = day.date, None if self.idle else self.age + 1
        aims = day.targets.dropna()
        aims = aims[aims != 0]
        if len(aims) and self.rebalance_due(every):
            self.due, self.age = aims.to_dict(), 0
        return {"date": day.date, "nav": round(self.cash + held, 2), "cash": round(self.cash, 2), "positions_value": round(held, 2), "bench_nav": round(self.bench, 2)}, orders


ACCOUNT_DAYS = "account string, date string, nav double, cash double, positions_value double, bench_nav double, orders long"


def fold_days(account: Account, frame: pd.DataFrame, rebalance: int, cost_bps: float) -> pd.DataFrame:
    """Move an account through the dates of ``frame`` that it hasn't seen; one row a day."""
    rows = []
    for date, g in frame.groupby("date", sort=True):
        g = g.set_index("code")
        row, orders = account.advance(Day(str(date), g["close"], g["mark"], float(g["bench_return"].iloc[0]), g["weight"].astype(float)), rebalance, cost_bps)
        if row:
            rows.append({"account": g["account"].iloc[0], **row, "orders": len(orders)})
    return pd.DataFrame(rows, columns=["account", "date", "nav", "cash", "positions_value", "bench_nav", "orders"])


def run_accounts(days: DataFrame, capital: float = 100_000.0, rebalance: int = 5, cost_bps: float = 10) -> DataFrame:
    """Fold accounts over ``days(account, date, code, close, mark, bench_return, weight)``; accounts are independent."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return fold_days(Account.of(capital), frame, rebalance, cost_bps)

    ship_package(days.sparkSession)
    return days.groupBy("account").applyInPandas(run, ACCOUNT_DAYS)


def replay(trades: DataFrame, capital: float) -> DataFrame:
    """Cash and shares after each trade of an account, from signed flows (``seq`` orders trades)."""
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    so_far = lambda *p: Window.partitionBy(*p).orderBy("date", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return trades.select(
        "account", "date", "seq", "code", (capital - F.sum(sign * F.col("notional") + F.col("cost")).over(so_far("account"))).alias("cash"), F.sum(sign * F.col("shares")).over(so_far("account", "code")).alias("shares")
    )
