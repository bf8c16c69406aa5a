"""Every strategy under one name: weights, one run, a comparison, the targets of the last date, parameter searches."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.alphas import FORMULAS as ALPHAS
from barloom.functions.alphas import NEEDS_INDUSTRY
from barloom.operators import learned, strategies
from barloom.plans.expr import evaluate

#: Choices that are searched, and what a choice has to meet.
GRIDS = {
    "ma_cross": {"fast": [10, 20, 50], "slow": [60, 120, 200]},
    "mean_reversion": {"window": [10, 20, 40], "entry": [-1.5, -2.0, -2.5]},
    "momentum": {"top_n": [10, 20, 40], "lookback": [126, 252]},
    "market_neutral": {"top_n": [10, 20, 40]},
    "pairs": {"n_pairs": [3, 5, 10], "window": [10, 20, 40]},
    "ml": {"top_n": [10, 20], "horizon": [10, 21]},
    "elastic_net": {"alpha": [0.001, 0.005, 0.02], "top_n": [20, 30]},
    "icir_weight": {"top_n": [20, 30], "horizon": [5, 10]},
    "lasso": {"alpha": [0.001, 0.005, 0.02], "top_n": [10, 20]},
}
CONSTRAINTS: dict[str, Callable[[dict], bool]] = {"ma_cross": lambda p: p["fast"] < p["slow"]}


def _formula(make: Callable[..., str]) -> Callable[..., DataFrame]:
    return lambda panel, **p: evaluate(panel, {"weight": make(**p)}, ["code", "date"])


def _composite(panel: DataFrame, factors: Iterable[int] | None = None, **p) -> DataFrame:
    able = [ALPHAS[n] for n in factors or ALPHAS if "ind" in panel.columns or n not in NEEDS_INDUSTRY]
    return evaluate(panel, {"weight": strategies.composite(able, **p)}, ["code", "date"])


def _event(panel: DataFrame, notices: DataFrame | None = None, hold: int = 20) -> DataFrame:
    if notices is None:
        raise ValueError("pead needs notices")
    return strategies.event_weights(panel, notices, hold).select("code", "date", "weight")


#: (panel, **params) to (code, date, weight).
STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    **{name: _formula(make) for name, make in strategies.FORMULAS.items()},
    **{kind: partial(learned.weights, kind=kind) for kind in learned.DEFAULTS},
    "alpha101_composite": _composite, "pairs": learned.pairs, "pead": _event,
}


def weights(panel: DataFrame, name: str, **params) -> DataFrame:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name](panel, **params)


def run_one(panel: DataFrame, name: str, cost_bps: float = 20, **params) -> DataFrame:
    """The backtest of a strategy: (date, gross, net, turnover, equity)."""
    return strategies.backtest(weights(panel, name, **params).join(panel.select("code", "date", "returns"), ["code", "date"]), cost_bps)


def compare(panel: DataFrame, params: dict[str, dict] | None = None, cost_bps: float = 20) -> DataFrame:
    """A row of metrics for each strategy; all that need nothing but the panel, if none are named."""
    chosen = {n: {} for n in sorted(STRATEGIES) if n != "pead"} if params is None else params
    rows = [strategies.summary(run_one(panel, n, cost_bps, **p)).withColumn("strategy", F.lit(n)) for n, p in chosen.items()]
    return reduce(DataFrame.unionByName, rows)


def targets(panel: DataFrame, name: str, override: dict[str, float] | None = None, **params) -> DataFrame:
    """(code, weight) that a strategy wants after the panel's last date; ``override`` stands in for one that the panel can't give."""
    if override is not None:
        return panel.sparkSession.createDataFrame(sorted(override.items()), "code string, weight double")
    last = panel.agg(F.max("date").alias("date"))
    return weights(panel, name, **params).join(F.broadcast(last), "date").where("weight <> 0").select("code", "weight")  # one row


def search(panel: DataFrame, name: str, **options) -> DataFrame:
    """:func:`strategies.grid` over the strategy's own choices; strategies that aren't formulas are run one choice at a time."""
    if name not in GRIDS:
        raise ValueError(f"no choices for {name!r}")
    return strategies.grid(panel, name, GRIDS[name], allowed=CONSTRAINTS.get(name, lambda p: True), weigh=None if name in strategies.FORMULAS else partial(weights, panel, name), **options)
