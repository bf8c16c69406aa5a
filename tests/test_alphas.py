"""All hundred factors against pandas, with neither the library's parser nor its schedulers.

The formulas are Python expressions; here Python evaluates them over (date, code) tables.
What they are compared with is the SQL that the driver compares with Spark.
"""

from __future__ import annotations

import ast

import numpy as np
import pandas as pd
import pytest

from barloom.functions.alphas import FORMULAS, NEEDS_INDUSTRY, look_back
from barloom.plans import expr

DATES, CODES = 330, 10


@pytest.fixture(scope="module")
def panel():
    r = np.random.default_rng(101)
    index, columns = pd.date_range("2020-01-01", periods=DATES), [f"c{i}" for i in range(CODES)]
    frame = lambda x: pd.DataFrame(x, index=index, columns=columns)
    close = np.exp(np.cumsum(r.normal(0, 0.03, (DATES, CODES)), 0)) * 20
    open_ = close * np.exp(r.normal(0, 0.02, close.shape))
    high, low = np.maximum(open_, close) * (1 + r.uniform(0.001, 0.03, close.shape)), np.minimum(open_, close) * (1 - r.uniform(0.001, 0.03, close.shape))
    volume = np.exp(r.normal(10, 1, close.shape))
    vwap = (open_ + high + low + close) / 4
    out = {"open": open_, "high": high, "low": low, "close": close, "volume": volume, "amount": volume * vwap, "vwap": vwap, "returns": close / np.vstack([np.full(CODES, np.nan), close[:-1]]) - 1}
    gone = r.random(close.shape) < 0.001
    for name, x in out.items():
        x[gone] = np.nan
    return {k: frame(v) for k, v in out.items()}, pd.Series([f"g{i % 3}" for i in range(CODES)], index=columns)


def table(x, like):
    return x if isinstance(x, pd.DataFrame) else pd.DataFrame(float(x), index=like.index, columns=like.columns)


class Names(dict):
    """What the formulas may say, in pandas."""

    def __init__(self, fields, industry):
        like = fields["close"]
        full = lambda x: table(x, like)
        finite = lambda x: full(x).replace([np.inf, -np.inf], np.nan)
        rolled = lambda x, d: finite(x).rolling(int(d), min_periods=int(d))
        frame = lambda v: pd.DataFrame(v, index=like.index, columns=like.columns)

        def each_window(x, d, f):
            x, d, out = full(x).to_numpy(), int(d), np.full(like.shape, np.nan)
            view = np.lib.stride_tricks.sliding_window_view(x, d, axis=0)
            with np.errstate(all="ignore"):
                out[d - 1 :] = np.where(np.isnan(view).any(-1), np.nan, f(view))
            return frame(out)

        def both_windows(x, y, d, f):
            x, y, d, out = finite(x).to_numpy(), finite(y).to_numpy(), int(d), np.full(like.shape, np.nan)
            a, b = (np.lib.stride_tricks.sliding_window_view(v, d, axis=0) for v in (x, y))
            with np.errstate(all="ignore"):
                out[d - 1 :] = f(a - a.mean(-1, keepdims=True), b - b.mean(-1, keepdims=True), d)
            return frame(out)

        def correlation(a, b, d):
            spread = np.sqrt((a * a).mean(-1)) * np.sqrt((b * b).mean(-1))
            return np.where(spread > 1e-14, (a * b).mean(-1) / spread, np.nan)

        def percentile_in_window(v):
            v = v.round(9)
            last = v[..., -1:]
            return ((v < last).sum(-1) + ((v == last).sum(-1) + 1) / 2) / v.shape[-1]

        def compared(x, y, f):
            return f(full(x).round(9), full(y).round(9)) & full(x).notna() & full(y).notna()

        def divided(x, y):
            with np.errstate(all="ignore"):
                return full(x) / full(y)

        def neutral(x):
            x = full(x)
            return x - x.T.groupby(industry).transform("mean").T

        def decayed(x, d):
            d, out = int(d), 0
            for k in range(d):
                out = out + full(x).shift(k) * ((d - k) / (d * (d + 1) / 2))
            return out

        def logged(x):
            with np.errstate(all="ignore"):
                return np.log(full(x))

        super().__init__(
            fields, divided=divided, compared=compared, LT=lambda a, b: a < b, GT=lambda a, b: a > b, EQ=lambda a, b: a == b, either=lambda a, b: a | b,
            rank=lambda x: full(x).round(9).rank(axis=1, pct=True), scale=lambda x: full(x).div(full(x).abs().sum(axis=1).replace(0, np.nan), axis=0), indn=neutral,
            delay=lambda x, d: full(x).shift(int(d)), delta=lambda x, d: full(x) - full(x).shift(int(d)), decay=decayed,
            sum=lambda x, d: rolled(x, d).sum(), mean=lambda x, d: rolled(x, d).mean(), std=lambda x, d: each_window(finite(x), d, lambda v: v.std(-1, ddof=1)), tmin=lambda x, d: rolled(x, d).min(), tmax=lambda x, d: rolled(x, d).max(),
            prod=lambda x, d: each_window(x, d, lambda v: v.prod(-1)), trank=lambda x, d: each_window(x, d, percentile_in_window),
            targmax=lambda x, d: each_window(x, d, lambda v: v.round(9).argmax(-1).astype(float)), targmin=lambda x, d: each_window(x, d, lambda v: v.round(9).argmin(-1).astype(float)),
            corr=lambda x, y, d: both_windows(x, y, d, correlation), cov=lambda x, y, d: both_windows(x, y, d, lambda a, b, n: (a * b).sum(-1) / (n - 1)),
            abs=lambda x: full(x).abs(), sgn=lambda x: np.sign(full(x)), ln=logged, spow=lambda x, a: np.sign(full(x)) * full(x).abs() ** a, power=lambda x, a: np.power(full(x), full(a)),
            min2=lambda x, y: np.minimum(full(x), full(y)), max2=lambda x, y: np.maximum(full(x), full(y)), b2f=lambda x: x.astype(float), iff=lambda c, a, b: full(a).where(c, full(b)),
        )

    def __missing__(self, name):
        return self["mean"](self["amount"], int(name.removeprefix("adv")))


class Spelled(ast.NodeTransformer):
    """Operators that pandas has no like of, as calls."""

    def call(self, name, *args):
        return ast.Call(ast.Name(name, ast.Load()), list(args), [])

    def visit_Compare(self, e):
        self.generic_visit(e)
        return self.call("compared", e.left, e.comparators[0], ast.Name({ast.Lt: "LT", ast.Gt: "GT", ast.Eq: "EQ"}[type(e.ops[0])], ast.Load()))

    def visit_BoolOp(self, e):
        self.generic_visit(e)
        assert isinstance(e.op, ast.Or) and len(e.values) == 2
        return self.call("either", *e.values)

    def visit_BinOp(self, e):
        self.generic_visit(e)
        name = {ast.Div: "divided", ast.Pow: "power"}.get(type(e.op))
        return self.call(name, e.left, e.right) if name else e


def in_pandas(formula, names):
    code = Spelled().visit(ast.parse(formula.replace("^", "**").replace("if(", "iff("), mode="eval"))
    return table(eval(compile(ast.fix_missing_locations(code), "formula", "eval"), {}, names), names["close"])


def test_every_factor_equals_pandas(panel):
    duckdb = pytest.importorskip("duckdb")
    fields, industry = panel
    names = Names(*panel)
    long = pd.concat({k: v.stack(future_stack=True) for k, v in fields.items()}, axis=1).rename_axis(["date", "code"]).reset_index()
    long["ind"], long["ord"] = long["code"].map(industry), long["date"].rank(method="dense").astype(int) - 1
    con = duckdb.connect()
    con.register("panel", long)
    numbers, different, empty = list(FORMULAS), {}, []
    for at in range(0, len(numbers), 10):
        some = numbers[at : at + 10]
        got = con.sql(f"with {expr.to_sql('panel', {f'a{n}': FORMULAS[n] for n in some})} select * from result").df().set_index(["date", "code"])
        for n in some:
            want = in_pandas(FORMULAS[n], names).to_numpy()
            mine = got[f"a{n}"].astype(float).unstack().reindex(index=fields["close"].index, columns=fields["close"].columns).to_numpy()
            with np.errstate(all="ignore"):
                same = (np.isnan(want) & np.isnan(mine)) | np.isclose(mine, want, rtol=1e-6, atol=1e-8) | (mine == want)
            if np.isnan(want[look_back(n) + 1 :]).all():
                empty.append(n)
            if not same.all():
                different[n] = round(1 - same.mean(), 4)
    assert set(NEEDS_INDUSTRY) < set(FORMULAS) and len(numbers) == 100
    assert not different, different
