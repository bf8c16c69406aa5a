"""Strategies that learn from a moving window of the panel, and pairs.

Features are panel formulas.  Each retraining date is a group of its own: the rows of
its window (and the date itself) are sent to one task, so dates are fitted in parallel.
The windows overlap, so a row is sent to ``train / retrain`` groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.strategies import feature_formulas
from barloom.plans.expr import evaluate
from barloom.session import ship_package

#: What each strategy is run with.
DEFAULTS = {
    "ml": {"top_n": 20, "train": 504, "retrain": 21, "horizon": 21, "windows": (21, 63, 126), "alpha": 0.0, "l1": 0.0},
    "elastic_net": {"top_n": 30, "train": 240, "retrain": 20, "horizon": 20, "windows": (21, 63, 126), "alpha": 0.005, "l1": 0.5},
    "lasso": {"top_n": 20, "train": 252, "retrain": 10, "horizon": 10, "windows": (21, 63, 126), "alpha": 0.005, "l1": 1.0},
}
#: Codes whose returns meet in one product of two blocks.
PAIR_BLOCK = 2_000
#: The fewest rows that a model learns from.
LEAST = 30


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients and intercept: summed logistic loss plus half the squared coefficients over ``c``, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], 1 / c), 0.0)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty * w
        step = np.linalg.lstsq((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), gradient, rcond=None)[0]
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


def fit_elastic(x: np.ndarray, y: np.ndarray, alpha: float, l1: float, rounds: int = 1000) -> np.ndarray:
    """Coefficients and intercept of mean squared error halved plus an elastic penalty, by coordinate descent."""
    mx, my = x.mean(0), y.mean()
    xc, r, n = x - mx, y - my, len(y)
    square, w = (xc**2).sum(0) / n, np.zeros(x.shape[1])
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            if square[j] == 0:
                continue
            old = w[j]
            rho = xc[:, j] @ r / n + square[j] * old
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / (square[j] + alpha * (1 - l1))
            if w[j] != old:
                r = r - xc[:, j] * (w[j] - old)
                most = max(most, abs(w[j] - old))
        if most < 1e-10:
            break
    return np.append(w, my - mx @ w)


def prepared(panel: DataFrame, kind: str, horizon: int, windows: tuple[int, int, int]) -> tuple[DataFrame, list[str]]:
    """(code, ord, features, aim): what a model of the kind learns from, complete rows only but for the aim.

    Regressions take everything as deviations of its date; the classifier takes features as
    they are, and its aim is whether the return to come is above the date's median.
    """
    names = list(feature_formulas(windows))
    data = evaluate(panel, feature_formulas(windows) | {"aim": f"finite(lead(close, {horizon}) / close - 1)"}, ["code", "date", "ord"])
    data = data.select("code", "ord", "aim", *[F.when(F.abs(F.col(n)) < float("inf"), F.col(n)).alias(n) for n in names])
    day = Window.partitionBy("ord")
    if kind == "ml":
        data = data.withColumn("aim", (F.col("aim") > F.median("aim").over(day)).cast("double"))
    else:
        deviation = lambda n: F.coalesce((F.col(n) - F.avg(n).over(day)) / F.nullif(F.stddev_samp(n).over(day), F.lit(0.0)), F.col(n) * 0.0)
        data = data.select("code", "ord", *[deviation(n).alias(n) for n in [*names, "aim"]])
    return data.dropna(subset=names), names


def fitted(x: np.ndarray, y: np.ndarray, kind: str, alpha: float, l1: float) -> np.ndarray | None:
    """Coefficients and intercept of a model of the kind; None with too little to learn from."""
    if len(y) < LEAST or (kind == "ml" and y.min() == y.max()):
        return None
    return fit_logistic(x, y) if kind == "ml" else fit_elastic(x, y, alpha, l1)


def weights(panel: DataFrame, kind: str, **params) -> DataFrame:
    """(code, date, weight) of a learned strategy; ``params`` replace those of ``DEFAULTS``.

    On row ``train`` and every ``retrain`` rows from there a model learns from the ``train``
    rows before whose returns over ``horizon`` rows are known; the ``top_n`` names that it
    ranks first on that row are held in equal parts until the next.
    """
    if kind not in DEFAULTS:
        raise ValueError(f"unknown kind {kind!r}")
    p = DEFAULTS[kind] | params
    data, names = prepared(panel, kind, p["horizon"], tuple(p["windows"]))
    train, retrain, horizon = p["train"], p["retrain"], p["horizon"]
    # Rows are sent to the dates that learn from them, and to their own if it is one: those have no part, others their aim.
    low, high = F.greatest(F.lit(0), F.ceil((F.col("ord") + horizon + 1 - train) / retrain)), F.floor(F.col("ord") / retrain)
    of = F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))
    learn = data.where("aim is not null").withColumn("turn", of).withColumn("at", F.lit(train) + F.col("turn") * retrain).drop("turn").where((F.col("ord") >= F.col("at") - train) & (F.col("ord") < F.col("at") - horizon))
    rank = data.where((F.col("ord") >= train) & ((F.col("ord") - train) % retrain == 0)).withColumn("at", F.col("ord")).withColumn("aim", F.lit(None).cast("double"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ord", "code"])
        past = frame["aim"].notna().to_numpy()
        x = frame[names].to_numpy(float)
        model = fitted(x[past], frame.loc[past, "aim"].to_numpy(float), kind, p["alpha"], p["l1"])
        now = frame.loc[~past, ["code"]]
        if model is None or now.empty:
            return pd.DataFrame({"ord": pd.Series(dtype="int64"), "code": now["code"].head(0), "w": pd.Series(dtype=float)})
        best = now["code"].to_numpy()[np.argsort(-(x[~past] @ model[:-1]), kind="stable")[: p["top_n"]]]
        return pd.DataFrame({"ord": int(key[0]), "code": best, "w": 1.0 / len(best)})

    ship_package(panel.sparkSession)
    code = panel.schema["code"].dataType.simpleString()
    chosen = learn.unionByName(rank).groupBy("at").applyInPandas(run, f"ord long, code {code}, w double")
    days = F.broadcast(chosen.select("ord").distinct().withColumn("__set", F.lit(1)))  # one row a retraining date
    placed = panel.select("code", "date", "ord").join(chosen, ["code", "ord"], "left").join(days, "ord", "left")
    set_ = F.when(F.col("__set") == 1, F.coalesce("w", F.lit(0.0)))
    held = F.last(set_, ignorenulls=True).over(Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return placed.select("code", "date", F.coalesce(held, F.lit(0.0)).alias("weight"))


def _partners(frame: pd.DataFrame, n: int) -> pd.DataFrame:
    """The ``n`` best partners, in the other block, of each code of a block."""
    mine, theirs = frame[frame["side"] == 0], frame[frame["side"] == 1]
    if mine.empty or theirs.empty:
        return pd.DataFrame({"a": [], "b": [], "c": []})
    c = np.stack(mine["z"].to_list()) @ np.stack(theirs["z"].to_list()).T
    a, b = mine["code"].to_numpy(), theirs["code"].to_numpy()
    c = np.where(a[:, None] == b, -np.inf, c).round(9)
    out = []
    for i in range(len(a)):
        best = np.lexsort((np.maximum(b, a[i]), np.minimum(b, a[i]), -c[i]))[:n]
        out += [(a[i], b[k], c[i, k]) for k in best if np.isfinite(c[i, k])]
    return pd.DataFrame(out, columns=["a", "b", "c"])


def top_pairs(panel: DataFrame, n: int, train: int) -> list[tuple[str, str]]:
    """Disjoint pairs of codes with the highest correlation of returns over the first rows.

    Only codes without a gap take part.  A pair that is chosen is among the first ``2 n - 1``
    of either code, as no more names are taken before it; so each code gives that many rows,
    from products of blocks of standardised returns, and not all pairs are listed.
    """
    early = panel.where((F.col("ord") > 0) & (F.col("ord") < train))
    series = early.groupBy("code").agg(F.count("close").alias("n"), F.count("returns").alias("m"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "returns"))), lambda x: x["returns"]).alias("r"))
    first = panel.where((F.col("ord") == 0) & F.col("close").isNotNull()).select("code")
    whole = series.where((F.col("n") == train - 1) & (F.col("m") == train - 1)).join(first, "code", "left_semi").select(F.col("code").cast("string").alias("code"), "r")
    blocks = -(-whole.count() // PAIR_BLOCK)
    if not blocks:
        return []
    block = F.pmod(F.xxhash64("code"), F.lit(blocks))

    def standard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = np.stack(b["r"].to_list()) if len(b) else np.empty((0, 1))
            d = r - r.mean(1, keepdims=True)
            size = np.sqrt((d**2).sum(1, keepdims=True))
            keep = size[:, 0] > 0
            yield pd.DataFrame({"code": b["code"].to_numpy()[keep], "block": b["block"].to_numpy()[keep], "z": list((d / np.where(size > 0, size, 1.0))[keep])})

    z = whole.withColumn("block", block).mapInPandas(standard, "code string, block long, z array<double>")
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    tasks = z.select("code", "z", F.col("block").alias("i"), others.alias("j"), F.lit(0).alias("side")).unionByName(z.select("code", "z", F.col("block").alias("j"), others.alias("i"), F.lit(1).alias("side")))
    most = 2 * n - 1
    near = tasks.groupBy("i", "j").applyInPandas(lambda f: _partners(f, most), "a string, b string, c double")
    order = Window.partitionBy("a").orderBy(F.desc("c"), F.least("a", "b"), F.greatest("a", "b"))
    best = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "c").distinct()
    out: list[tuple[str, str]] = []
    for row in best.orderBy(F.desc("c"), "a", "b").toLocalIterator():  # read a page at a time, and only until n pairs are found
        if not {row["a"], row["b"]} & {c for pair in out for c in pair}:
            out.append((row["a"], row["b"]))
            if len(out) == n:
                break
    return out


def pairs(panel: DataFrame, n_pairs: int = 5, train: int = 252, window: int = 20, entry: float = 2.0, exit_: float = 0.5) -> DataFrame:
    """(code, date, weight): spread of the logs of each pair, traded on its rolling z-score."""
    ship_package(panel.sparkSession)
    chosen = top_pairs(panel, n_pairs, train)
    flat = panel.select("code", "date", F.lit(0.0).alias("weight"))
    if not chosen:
        return flat
    table = F.broadcast(panel.sparkSession.createDataFrame(chosen, "a string, b string"))
    log = panel.select("date", "ord", F.col("code").cast("string").alias("code"), F.ln("close").alias("l"))
    both = table.join(log.select("date", "ord", F.col("code").alias("a"), F.col("l").alias("la")), "a").join(log.select("ord", F.col("code").alias("b"), F.col("l").alias("lb")), ["b", "ord"])
    early = F.col("ord") < train
    of = lambda c: F.when(early, F.col(c))
    beta = both.groupBy("a", "b").agg(F.regr_slope(of("la"), of("lb")).alias("beta"))
    spread = both.join(F.broadcast(beta), ["a", "b"]).select("a", "b", F.concat_ws("|", "a", "b").alias("code"), "date", F.col("ord").cast("double").alias("ord"), (F.col("la") - F.col("beta") * F.col("lb")).alias("spread"))
    z = f"((spread - mean(spread, {window})) / std(spread, {window}))"
    state = evaluate(spread, {"state": f"coalesce(ffill(if(ord < {train}, 0, if({z} > {entry}, -1, if({z} < {-entry}, 1, if(abs({z}) < {exit_}, 0, null()))))), 0)"}, ["a", "b", "date"])
    legs = state.select("date", F.col("a").alias("code"), (F.col("state") * 0.5 / n_pairs).alias("w")).unionByName(state.select("date", F.col("b").alias("code"), (-F.col("state") * 0.5 / n_pairs).alias("w")))
    total = legs.groupBy("code", "date").agg(F.sum("w").alias("w"))
    return flat.join(total, ["code", "date"], "left").select("code", "date", F.coalesce("w", "weight").alias("weight"))
