"""Formulas against pandas, on a panel with gaps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from barloom.functions.alphas import FORMULAS, NEEDS_INDUSTRY, compute_all
from barloom.plans import expr
from barloom.sources import panels


@pytest.fixture(scope="module")
def wide():
    r = np.random.default_rng(3)
    dates, codes = pd.date_range("2020-01-01", periods=40), list("abcdef")
    out = {f: pd.DataFrame(r.uniform(5, 50, (40, 6)).round(2), dates, codes) for f in ("open", "close", "volume")}
    hole = r.random((40, 6)) < 0.06
    return {f: v.mask(hole) for f, v in out.items()}


@pytest.fixture(scope="module")
def panel(spark, wide):
    long = pd.concat({f: v.stack(future_stack=True) for f, v in wide.items()}, axis=1).rename_axis(["date", "code"]).reset_index()
    long["date"] = long["date"].dt.date
    long["ord"] = long.groupby("code").cumcount()
    rows = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in t) for t in long.itertuples(index=False)]
    return spark.createDataFrame(rows, "date date, code string, open double, close double, volume double, ord long").cache()


def run(panel, formula):
    got = expr.evaluate(panel, {"v": formula}, ["code", "date"]).toPandas()
    out = got.pivot(index="date", columns="code", values="v").astype(float)
    out.index = pd.to_datetime(out.index)
    return out


def windows(frame, d, f):
    return frame.rolling(d).apply(f, raw=True)


CASES = {
    "rank(close)": lambda w: w["close"].rank(axis=1, pct=True),
    "delay(close, 3)": lambda w: w["close"].shift(3),
    "delta(close, 2)": lambda w: w["close"] - w["close"].shift(2),
    "sum(close, 4)": lambda w: w["close"].rolling(4).sum(),
    "mean(close, 4, 1)": lambda w: w["close"].rolling(4, min_periods=1).mean(),
    "std(close, 5)": lambda w: w["close"].rolling(5).std(),
    "prod(close, 3)": lambda w: windows(w["close"], 3, np.prod),
    "tmin(close, 4)": lambda w: w["close"].rolling(4).min(),
    "tmax(close, 4)": lambda w: w["close"].rolling(4).max(),
    "targmin(close, 5)": lambda w: windows(w["close"], 5, np.argmin),
    "targmax(close, 5)": lambda w: windows(w["close"], 5, np.argmax),
    "trank(close, 5)": lambda w: windows(w["close"], 5, lambda x: ((x < x[-1]).sum() + ((x == x[-1]).sum() + 1) / 2) / 5),
    "decay(close, 4)": lambda w: windows(w["close"], 4, lambda x: (x * np.arange(1, 5)).sum() / 10),
    "corr(open, close, 6)": lambda w: w["open"].rolling(6).corr(w["close"]),
    "cov(open, close, 6)": lambda w: w["open"].rolling(6).cov(w["close"]),
    "scale(close - open)": lambda w: (w["close"] - w["open"]).div((w["close"] - w["open"]).abs().sum(axis=1), axis=0),
    "min2(open, close)": lambda w: np.minimum(w["open"], w["close"]),
    "if(delta(close, 1) > 0, close, -1)": lambda w: w["close"].where(w["close"].diff() > 0, -1.0),
    "b2f(delta(close, 1) > 0)": lambda w: (w["close"].diff() > 0).astype(float),
    "rank(corr(rank(open), rank(close), 4))": lambda w: w["open"].rank(axis=1, pct=True).rolling(4).corr(w["close"].rank(axis=1, pct=True)).round(9).rank(axis=1, pct=True),
}


@pytest.mark.parametrize("formula", CASES)
def test_operator_matches_pandas(panel, wide, formula):
    got, want = run(panel, formula), CASES[formula](wide).astype(float)
    assert (got.isna() == want.isna()).all().all()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-8, atol=1e-9, equal_nan=True)


def test_division_gives_infinities_and_missing_stays_missing(spark):
    rows = [("a", 0, 1.0, 0.0), ("a", 1, -1.0, 0.0), ("a", 2, 0.0, 0.0), ("a", 3, 1.0, None), ("a", 4, 6.0, 3.0)]
    df = spark.createDataFrame(rows, "code string, date int, x double, y double")
    got = [r.v for r in expr.evaluate(df, {"v": "x / y"}).orderBy("date").collect()]
    assert got == [math.inf, -math.inf, None, None, 2.0]


def test_warm_up_rows_take_the_else_branch(panel):
    got = run(panel, "if(mean(close, 20) < close, 5, -1)")
    assert (got.iloc[:19] == -1).all().all()


def test_formulas_share_shuffles(panel):
    many = {f"a{n}": FORMULAS[n] for n in (3, 6, 44) if "high" not in FORMULAS[n]}
    plan = expr.evaluate(panel, many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= expr.exchanges(expr.parse(f) for f in many.values()) + 1


def test_every_alpha_parses_and_knows_its_history():
    assert len(FORMULAS) == 100 and 56 not in FORMULAS and len(NEEDS_INDUSTRY) == 18
    assert all(expr.windows_of(expr.parse(f)) >= 0 for f in FORMULAS.values())
    assert expr.windows_of(expr.parse(FORMULAS[101])) == 0 and expr.windows_of(expr.parse(FORMULAS[24])) == 199


def test_alpha_101_by_hand(spark):
    df = spark.createDataFrame([("a", 0, 10.0, 12.0, 9.0, 11.0)], "code string, date int, open double, high double, low double, close double")
    assert compute_all(df, [101]).first()["alpha_101"] == pytest.approx(1 / 3.001)


def test_panel_is_dense_and_fills_closes(spark):
    bars = spark.createDataFrame([("a", "2020-01-01", 1.0, 10.0), ("a", "2020-01-03", 2.0, 20.0), ("b", "2020-01-02", 5.0, 0.0)], "code string, date string, close double, volume double")
    bars = bars.selectExpr("code", "to_date(date) date", "close open", "close high", "close low", "close", "volume", "close * volume amount")
    rows = {(r.code, str(r.date)): r for r in panels.build_panel(bars).collect()}
    assert len(rows) == 6
    assert rows["a", "2020-01-02"].returns == 0 and rows["a", "2020-01-03"].returns == 1
    assert rows["b", "2020-01-02"].vwap is None and rows["b", "2020-01-01"].close is None and rows["b", "2020-01-02"].returns is None


def test_typical_vwap_replaces_amount(spark):
    df = spark.createDataFrame([("a", 0, 3.0, 1.0, 2.0, 10.0)], "code string, date int, high double, low double, close double, volume double")
    assert panels.with_vwap(df, "typical").first().amount == 20.0
    with pytest.raises(ValueError):
        panels.with_vwap(df, "other")


def test_written_layouts_change_nothing(spark, monkeypatch):
    from barloom.functions import alphas

    r = np.random.default_rng(6)
    rows = [(c, d, *(float(x) for x in r.uniform(5, 50, 8)), f"g{i % 2}") for d in range(30) for i, c in enumerate("abcde")]
    full = spark.createDataFrame(rows, "code string, date int, open double, high double, low double, close double, volume double, amount double, vwap double, returns double, ind string")
    numbers = [3, 13, 15, 31, 44, 50, 100]
    plain = {(x.code, x.date): x for x in compute_all(full, numbers).collect()}
    monkeypatch.setattr(alphas, "SETTLED_FROM", 3)
    for x in compute_all(full, numbers).collect():
        for n in numbers:
            a, b = x[f"alpha_{n}"], plain[x.code, x.date][f"alpha_{n}"]
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-12)
