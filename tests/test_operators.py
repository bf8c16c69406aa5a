"""Research, strategy, intraday, portfolio, snapshot and text operators on hand-made rows."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import text
from barloom.operators import intraday, learned, portfolio, research, snapshot, strategies
from barloom.sources import connectors, sinks


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


@pytest.mark.parametrize("q", [2, 4, 5])
def test_buckets_equal_interpolated_quantiles(spark, q):
    for n in (q, 7, 23, 100):
        got = [r.b for r in spark.range(1, n + 1).select(F.col("id"), research.bucket(F.col("id"), F.lit(n), q).alias("b")).orderBy("id").collect()]
        assert got == list(pd.qcut(pd.Series(range(1, n + 1)), q, labels=False))


def test_perfect_factor_has_ic_one_and_constant_side_none(spark):
    rows = [(day(d), c, float(i), float(i) * (1 if d else 0)) for d in range(2) for i, c in enumerate("abcdef")]
    ic = {r.date: r.ic for r in research.ic_series(spark.createDataFrame(rows, "date date, code string, factor double, forward double")).collect()}
    assert ic[day(1)] == pytest.approx(1.0) and ic[day(0)] is None


def test_too_few_pairs_leave_no_row(spark):
    rows = [(day(0), c, 1.0 * i, None if i < 3 else 1.0 * i) for i, c in enumerate("abcdef")]
    assert research.ic_series(spark.createDataFrame(rows, "date date, code string, factor double, forward double")).count() == 0


def test_as_of_takes_the_last_announcement_and_expires(spark):
    left = spark.createDataFrame([("a", day(i), i) for i in range(8)], "code string, date date, ord long")
    right = spark.createDataFrame([("a", day(1), 1, 5.0), ("a", day(1), 2, 6.0), ("a", None, 3, 9.0)], "code string, announce date, seq long, v double")
    assert [r.v for r in research.as_of(left, right, ["v"]).orderBy("date").collect()] == [None] + [6.0] * 7
    assert [r.v for r in research.as_of(left, right, ["v"], max_rows=4).orderBy("date").collect()] == [None] + [6.0] * 5 + [None] * 2


def test_newey_west_by_hand(spark):
    x = np.random.default_rng(1).normal(0.1, 1, 60)
    d = x - x.mean()
    v = d @ d / 60 + sum(2 * (1 - k / 5) * (d[k:] @ d[:-k]) / 60 for k in range(1, 5))
    got = research.newey_west(spark.createDataFrame([(day(i), float(a)) for i, a in enumerate(x)], "date date, value double")).first()
    assert got.t == pytest.approx(x.mean() / math.sqrt(v / 60))


def test_backtest_trades_on_the_next_row(spark):
    rows = [("a", day(0), 1.0, 0.0), ("a", day(1), 1.0, 0.1), ("a", day(2), 0.0, 0.2), ("a", day(3), 0.0, 0.5)]
    got = strategies.backtest(spark.createDataFrame(rows, "code string, date date, weight double, returns double"), cost_bps=0).orderBy("date").collect()
    assert [round(r.gross, 9) for r in got] == [0.0, 0.1, 0.2, 0.0]
    assert [r.turnover for r in got] == [0.0, 1.0, 0.0, 1.0]
    assert got[-1].equity == pytest.approx(1.1 * 1.2)


def test_notice_on_a_holiday_counts_from_the_next_trading_day(spark):
    calendar = spark.createDataFrame([(day(0), 0), (day(3), 1)], "date date, ord long")
    notices = spark.createDataFrame([("a", day(1)), ("b", day(0)), ("c", day(9))], "code string, notice date")
    assert {r.code: r.pos for r in strategies.next_trading_day(notices, calendar).collect()} == {"a": 1, "b": 0, "c": None}


def test_trade_signals(spark):
    scores = spark.createDataFrame([("a", 3.0, 1, True), ("b", 2.0, 2, True), ("c", 1.0, 3, True), ("d", 0.0, 4, True)], "code string, score double, rank int, eligible boolean")
    held = spark.createDataFrame([("b", 0.1), ("d", 0.2), ("z", 0.3)], "code string, current_weight double")
    got = {r.code: (r.action, r.reason, r.target_weight) for r in research.trade_signals(scores, held, 1, 3, 0.4).collect()}
    assert got == {"a": ("buy", "top_rank", 0.4), "b": ("hold", "inside_sell_buffer", 0.4), "d": ("sell", "rank_below_sell_buffer", 0.0), "z": ("sell", "rank_below_sell_buffer", 0.0)}


def test_day_factors_match_plain_python(spark):
    r = np.random.default_rng(5)
    n = 60
    close, volume = np.exp(np.cumsum(r.normal(0, 0.01, n))) * 10, r.integers(0, 50, n).astype(float)
    times = [dt.datetime(2024, 1, 2, 9, 30) + dt.timedelta(minutes=i) for i in range(n)]
    bars = spark.createDataFrame([("a", times[i].date(), times[i], float(close[i]), float(volume[i]), float(close[i] * volume[i])) for i in range(n)], "code string, date date, time timestamp, close double, volume double, amount double")
    got = intraday.day_factors(bars).first()
    ret = np.log(close[1:] / close[:-1])
    assert got.rskew == pytest.approx(math.sqrt(n - 1) * (ret**3).sum() / (ret**2).sum() ** 1.5)
    t = volume > 0
    assert got.cpv == pytest.approx(np.corrcoef(close[t], volume[t])[0, 1])
    rows = sorted((-abs(ret[i - 1]) / math.sqrt(volume[i]), i) for i in range(1, n) if volume[i] > 0)
    target, seen, smart = 0.2 * volume.sum(), 0.0, []
    for _, i in rows:
        if seen < target:
            smart.append(i)
        seen += volume[i]
    want = ((close * volume)[smart].sum() / volume[smart].sum()) / ((close * volume).sum() / volume.sum())
    assert got.smart == pytest.approx(want)


def test_sessions_are_closed_intervals(spark):
    at = ["09:29:59", "09:30:00", "11:30:00", "11:30:01", "13:00:00", "15:00:00", "15:00:01"]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(f"2024-01-02 {x}"),) for x in at], "time timestamp")
    assert [r.ok for r in df.select(intraday.in_session("time").alias("ok")).collect()] == [False, True, True, False, True, True, False]


def test_neutralised_equals_least_squares(spark):
    r = np.random.default_rng(2)
    n = 60
    y, cap, ind = r.normal(size=n), r.uniform(1, 100, n), [f"i{k % 5}" for k in range(n)]
    got = {x.code: x.z for x in intraday.neutralised(spark.createDataFrame([(f"c{i:02d}", day(0), float(y[i]), float(cap[i]), ind[i]) for i in range(n)], "code string, date date, y double, float_cap double, industry string"), "y", min_count=10).collect()}
    m = np.median(y)
    mad = np.median(abs(y - m))
    c = np.clip(y, m - 5 * 1.4826 * mad, m + 5 * 1.4826 * mad)
    z = (c - c.mean()) / c.std()
    a = np.column_stack([np.ones(n), np.log(cap)] + [[float(i == k) for i in ind] for k in sorted(set(ind))[1:]])
    e = z - a @ np.linalg.lstsq(a, z, rcond=None)[0]
    np.testing.assert_allclose([got[f"c{i:02d}"] for i in range(n)], (e - e.mean()) / e.std(), atol=1e-9)


def test_price_limits(spark):
    rows = [("a", day(0), 10.0, 10.0, 10.0, 10.0), ("a", day(1), 10.5, 10.5, 10.5, 10.5), ("a", day(2), 10.0, 10.0, 10.0, 10.0), ("a", day(3), 9.5, 9.6, 9.4, 9.5), ("a", day(4), 9.6, 9.6, 9.6, 9.6)]
    got = intraday.price_limits(spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double")).orderBy("date").collect()
    assert [(r.buy_blocked, r.sell_blocked) for r in got] == [(True, True), (True, False), (False, True), (False, False), (True, True)]


def book(days, cost_bps=20.0):
    """``run_book`` over (price, mark, buying blocked, selling blocked) and targets by code, one pair a day."""
    codes = sorted(days[0][0])
    table = lambda f, kind=float: np.array([[f(q, t, c) for c in codes] for q, t in days], kind)
    return portfolio.run_book(
        table(lambda q, t, c: q[c][0]), table(lambda q, t, c: q[c][1]), table(lambda q, t, c: q[c][2], bool), table(lambda q, t, c: q[c][3], bool), table(lambda q, t, c: (t or {}).get(c, math.nan)), cost_bps
    )


def test_simulation_sells_before_it_buys_and_scales_to_cash():
    quotes = lambda a, b: {"a": (a, a, False, False), "b": (b, b, False, False)}
    out = book([(quotes(1.0, 1.0), {"a": 1.0}), (quotes(1.0, 1.0), {"b": 1.0}), (quotes(2.0, 1.0), None), (quotes(2.0, 3.0), None)], 0)
    np.testing.assert_allclose(out.nav, [1.0, 1.0, 2.0, 6.0])
    assert [(f != 0).sum() for f in out.flow] == [0, 1, 2, 0]
    costly = book([(quotes(1.0, 1.0), {"a": 1.0}), (quotes(1.0, 1.0), None)], 100)
    assert costly.nav[1] == pytest.approx(1 / 1.01)


def test_blocked_and_unpriced_names_are_left_alone():
    q = {"a": (1.0, 1.0, True, False), "b": (math.nan, 1.0, False, False)}
    out = book([(q, {"a": 0.5, "b": 0.5}), (q, None)])
    assert out.nav.tolist() == [1.0, 1.0] and not out.flow.any()


def plain_fold(days, rate):
    """The rules of the simulation, one name and one trade at a time."""
    cash, held, last, navs, trades = 1.0, {}, None, [], []
    for k, (quotes, target) in enumerate(days):
        before = cash + sum(held[c] * quotes[c][1] for c in held)
        if last:
            priced = [c for c in sorted(quotes) if quotes[c][0] == quotes[c][0]]
            for c in priced:
                over = held.get(c, 0.0) * quotes[c][0] - last.get(c, 0.0) * before
                if over > 0 and not quotes[c][3]:
                    held[c] -= over / quotes[c][0]
                    cash += over - over * rate
                    trades.append((k, c, "sell", over))
            short = {c: last[c] * before - held.get(c, 0.0) * quotes[c][0] for c in priced if c in last and not quotes[c][2]}
            short = {c: x for c, x in short.items() if x > 0}
            need = sum(short.values()) * (1 + rate)
            share = 1.0 if need <= cash else cash / need
            for c, x in short.items():
                held[c] = held.get(c, 0.0) + x * share / quotes[c][0]
                cash -= x * share * (1 + rate)
                trades.append((k, c, "buy", x * share))
        navs.append(cash + sum(held[c] * quotes[c][1] for c in held))
        last = target
    return navs, trades


def random_days(r, n=40, codes="abcde"):
    days, mark = [], dict.fromkeys(codes, 1.0)
    for _ in range(n):
        quotes = {}
        for c in codes:
            price = math.nan if r.random() < 0.15 else float(mark[c] * math.exp(r.normal(0, 0.1)))
            mark[c] = mark[c] if price != price else price
            quotes[c] = (price, mark[c], bool(r.random() < 0.1), bool(r.random() < 0.1))
        chosen = [c for c in codes if r.random() < 0.6]
        days.append((quotes, {c: 1.0 / len(chosen) for c in chosen} if chosen and r.random() < 0.4 else None))
    return days


@pytest.mark.parametrize("seed", range(5))
def test_simulation_brute_force(seed):
    days = random_days(np.random.default_rng(seed))
    out, (navs, trades) = book(days, 20), plain_fold(days, 0.002)
    np.testing.assert_allclose(out.nav, navs, rtol=1e-12)
    want = np.zeros_like(out.flow)
    for k, c, side, x in trades:
        want[k, "abcde".index(c)] += x if side == "buy" else -x
    np.testing.assert_allclose(out.flow, want, atol=1e-12)


def test_ledger_replays_to_the_simulation(spark):
    """Cash and shares from the ledger alone, valued at the marks, are the simulated worth."""
    days = random_days(np.random.default_rng(9), 30)
    prices = spark.createDataFrame([(c, day(k), k, None if q[c][0] != q[c][0] else q[c][0]) for k, (q, _) in enumerate(days) for c in q], "code string, date date, ord long, open double")
    limits = spark.createDataFrame([(c, day(k), q[c][2], q[c][3]) for k, (q, _) in enumerate(days) for c in q], "code string, date date, buy_blocked boolean, sell_blocked boolean")
    targets = spark.createDataFrame([("p", day(k), c, w) for k, (_, t) in enumerate(days) for c, w in (t or {}).items()], "portfolio string, date date, code string, weight double")
    navs = {r.date: r for r in portfolio.simulate(targets, prices, limits).collect()}
    ledger = portfolio.trade_ledger(targets, prices, limits)
    replayed = portfolio.replay(ledger.withColumnRenamed("portfolio", "account"), 1.0).orderBy("seq").collect()
    rows, cash, held = ledger.orderBy("seq").collect(), 1.0, {}
    assert sum(r.trades for r in navs.values()) == len(rows) > 20 and {r.status for r in rows} == {"filled"}
    at = 0
    for k, (q, _) in enumerate(days):
        while at < len(rows) and rows[at].date == day(k):
            assert rows[at].signal_date == day(k - 1) and rows[at].notional == pytest.approx(rows[at].shares * rows[at].price)
            cash, held[rows[at].code] = replayed[at].cash, replayed[at].shares
            at += 1
        # Names without a first price have no mark yet, and can't be held.
        assert navs[day(k)].nav == pytest.approx(cash + sum(n * q[c][1] for c, n in held.items()))


def account_day(date, close, mark, bench, targets):
    s = lambda x: pd.Series(x, dtype=float)
    return portfolio.Day(date, s(close), s(mark), bench, s(targets))


def test_account_is_idempotent_and_counts_to_the_rebalance():
    a = portfolio.Account.of(1000.0)
    row, orders = a.advance(account_day("d1", {"a": 10.0}, {"a": 10.0}, 0.0, {"a": 1.0}), 2, 0)
    assert row["nav"] == 1000 and orders.empty and a.due == {"a": 1.0}
    row, orders = a.advance(account_day("d1", {"a": 99.0}, {"a": 99.0}, 0.5, {"a": 1.0}), 2, 0)
    assert row is None and orders.empty and a == portfolio.Account(1000.0, 1000.0, {}, {"a": 1.0}, 0, "d1")
    row, orders = a.advance(account_day("d2", {"a": 10.0}, {"a": 10.0}, 0.1, {"a": 0.5}), 2, 0)
    assert orders["shares"].tolist() == [100] and a.due is None and row["bench_nav"] == 1100
    row, _ = a.advance(account_day("d3", {"a": math.nan}, {"a": 12.0}, 0.0, {"a": 0.5}), 2, 0)
    assert row["nav"] == 1200 and a.due == {"a": 0.5}


@pytest.mark.parametrize("seed", range(4))
def test_account_brute_force(seed):
    """Against the rules written out one name at a time."""
    r = np.random.default_rng(seed)
    days = random_days(r, 60)
    a, cash, held, due, age, bench = portfolio.Account.of(1000.0), 1000.0, {}, None, None, 1000.0
    for k, (q, target) in enumerate(days):
        worth = lambda: sum(n * q[c][1] for c, n in held.items())  # noqa: B023, E731
        orders = []
        if due is not None:
            total = cash + worth()
            for c in sorted({*due, *held}):
                price = q[c][0]
                change = due.get(c, 0.0) * total - held.get(c, 0.0) * price
                if price == price and abs(change) >= 1e-9:
                    held[c] = held.get(c, 0.0) + change / price
                    cash -= change + abs(change) * 0.001
                    orders.append((c, "buy" if change > 0 else "sell", round(change, 2)))
                    if abs(held[c]) < 1e-9:
                        del held[c]
            due = None
        bench *= 1.001
        age = None if age is None else age + 1
        if target and (age is None or age >= 3):
            due, age = target, 0
        row, got = a.advance(account_day(f"{k:03d}", {c: x[0] for c, x in q.items()}, {c: x[1] for c, x in q.items()}, 0.001, target or {}), 3, 10)
        assert (row["nav"], row["cash"], row["bench_nav"]) == pytest.approx((cash + worth(), cash, bench), abs=0.011)
        assert [] == orders == got.to_dict("records") or [(o["ticker"], o["side"], o["value"]) for o in got.to_dict("records")] == orders


def test_replay_keeps_cash_and_shares(spark):
    rows = [("x", day(0), 1, "a", "buy", 2.0, 20.0, 1.0), ("x", day(1), 2, "a", "sell", 1.0, 15.0, 1.0)]
    got = portfolio.replay(spark.createDataFrame(rows, "account string, date date, seq long, code string, side string, shares double, notional double, cost double"), 100.0).orderBy("seq").collect()
    assert [(r.cash, r.shares) for r in got] == [(79.0, 2.0), (93.0, 1.0)]


def test_learned_fits():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 3))
    w = learned.fit_elastic(x, x @ [1.0, 0.0, -2.0] + 0.5, 1e-6, 1.0)
    np.testing.assert_allclose(w, [1, 0, -2, 0.5], atol=1e-4)
    assert learned.fit_elastic(x, x[:, 0], 10.0, 1.0)[:3].tolist() == [0, 0, 0]
    y = (x[:, 0] > 0).astype(float)
    v = learned.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ v[:-1] + v[-1])))
    np.testing.assert_allclose(x.T @ (p - y) + v[:-1], 0, atol=1e-6)  # the penalised optimum


def learning_panel(spark, n=140, codes=12, seed=4):
    r = np.random.default_rng(seed)
    close = np.exp(np.cumsum(r.normal(0, 0.02, (n, codes)), 0)) * 10
    volume = r.integers(1, 100, (n, codes)).astype(float)
    close[r.random((n, codes)) < 0.02] = np.nan
    frame = pd.DataFrame(close, columns=[f"c{i:02d}" for i in range(codes)])
    rows = [(c, day(k), k, None if x != x else float(x), float(volume[k, i])) for i, c in enumerate(frame) for k, x in enumerate(frame[c])]
    panel = spark.createDataFrame(rows, "code string, date date, ord long, close double, volume double")
    from barloom.sources.panels import with_returns

    return with_returns(panel), frame, pd.DataFrame(volume, columns=frame.columns)


@pytest.mark.parametrize("kind", ["ml", "lasso", "elastic_net"])
def test_learned_weights_brute_force(spark, kind):
    """The whole strategy in pandas, with the optimum of its model found by a general minimiser's conditions."""
    panel, close, volume = learning_panel(spark)
    p = {"top_n": 4, "train": 60, "retrain": 20, "horizon": 5, "windows": (3, 6, 9), "alpha": 0.02}
    held, got = close.ffill(), {}
    for r in learned.weights(panel, kind, **p).collect():
        got[r.date, r.code] = r.weight
    feats = [held / held.shift(w) - 1 for w in (3, 6, 9)] + [held.pct_change().rolling(6).std(), volume.rolling(3).mean() / volume.rolling(9).mean()]
    forward = close.shift(-5) / close - 1
    z = lambda f: f.sub(f.mean(axis=1), axis=0).div(f.std(axis=1), axis=0).fillna(0.0).where(f.notna())
    if kind != "ml":
        feats, forward = [z(f) for f in feats], z(forward)
        y = forward
    else:
        y = forward.gt(forward.median(axis=1), axis=0).astype(float).where(forward.notna())
    x = np.stack([f.to_numpy() for f in feats], -1)
    row, seen = pd.Series(0.0, index=close.columns), 0
    for t in range(len(close)):
        if t >= 60 and (t - 60) % 20 == 0:
            past = slice(t - 60, t - 5)
            a, b = x[past].reshape(-1, 5), y.to_numpy()[past].ravel()
            ok = ~np.isnan(a).any(1) & ~np.isnan(b)
            a, b = a[ok], b[ok]
            w = learned.fitted(a, b, kind, 0.02, 1.0 if kind == "lasso" else 0.5)
            score = a @ w[:-1] + w[-1]
            slope = a.T @ (1 / (1 + np.exp(-score)) - b) + w[:-1] if kind == "ml" else a.T @ (score - b) / len(b) + 0.02 * (0 if kind == "lasso" else 0.5) * w[:-1]
            limit = 0 if kind == "ml" else 0.02 * (1.0 if kind == "lasso" else 0.5)
            assert all(abs(g) <= limit + 1e-6 if v == 0 else abs(g + limit * np.sign(v)) < 1e-6 for g, v in zip(slope, w[:-1], strict=True))  # the optimum
            now = pd.Series(x[t] @ w[:-1], index=close.columns).dropna().sort_values(ascending=False, kind="stable").head(4).index
            row = pd.Series(0.0, index=close.columns)
            row[now] = 0.25
            seen += 1
        assert [got[day(t), c] for c in close.columns] == pytest.approx(row.tolist()), t
    assert seen == 4


def test_pairs_brute_force(spark):
    r = np.random.default_rng(8)
    n = 120
    base = np.cumsum(r.normal(0, 0.01, (n, 2)), 0)
    series = {"a": base[:, 0], "b": base[:, 0] + r.normal(0, 0.005, n), "c": base[:, 1], "d": base[:, 1] * 1.5 + r.normal(0, 0.005, n), "e": np.cumsum(r.normal(0, 0.02, n))}
    close = pd.DataFrame({k: np.exp(v) * 20 for k, v in series.items()})
    rows = [(c, day(k), k, float(x)) for c in close for k, x in enumerate(close[c])]
    from barloom.sources.panels import with_returns

    panel = with_returns(spark.createDataFrame(rows, "code string, date date, ord long, close double"))
    got = {(x.date, x.code): x.weight for x in learned.pairs(panel, 2, 60, 10, 1.5, 0.5).collect()}
    corr, order = close.pct_change().iloc[1:60].corr(), []
    for _, x, y in sorted((-corr.loc[x, y], x, y) for x in close for y in close if x < y):
        if not {x, y} & {c for p in order for c in p} and len(order) < 2:
            order.append((x, y))
    want = pd.DataFrame(0.0, index=close.index, columns=close.columns)
    for x, y in order:
        lx, ly = np.log(close[x]), np.log(close[y])
        spread = lx - np.polyfit(ly[:60], lx[:60], 1)[0] * ly
        score = (spread - spread.rolling(10).mean()) / spread.rolling(10).std()
        state = 0.0
        for t in range(n):
            v = score[t]
            state = 0.0 if t < 60 else -1.0 if v > 1.5 else 1.0 if v < -1.5 else 0.0 if abs(v) < 0.5 else state
            want.loc[t, x] += state * 0.25
            want.loc[t, y] -= state * 0.25
    assert [got[day(t), c] for t in range(n) for c in close] == pytest.approx(want.to_numpy().ravel().tolist())
    assert (want != 0).to_numpy().any()


def test_changes_need_the_date_before(spark):
    rows = [(day(0), "m", "a", 10.0), (day(1), "m", "b", 5.0), (day(2), "m", "a", 20.0), (day(2), "m", "b", 6.0)]
    got = {(r.code, r.date): r.change for r in snapshot.cap_changes(spark.createDataFrame(rows, "date date, market string, code string, mc double")).collect()}
    assert got["a", day(2)] is None and got["b", day(2)] == pytest.approx(0.2)


def test_pe_limits_are_clamped(spark):
    df = spark.createDataFrame([(day(0), float(x)) for x in (0.1, 0.2, 0.3, -5.0)], "date date, pe double")
    assert tuple(snapshot.pe_limits(df).first())[1:] == (1.0, 2.0)


def test_upsert_and_append_keep_the_right_row(spark):
    old, new = (spark.createDataFrame(x, "k string, seq long, v int") for x in ([("a", 1, 1), ("b", 2, 2)], [("b", 3, 3), ("b", 4, 4), ("c", 5, 5)]))
    assert {r.k: r.v for r in snapshot.upserted(old, new, ["k"]).collect()} == {"a": 1, "b": 4, "c": 5}
    assert {r.k: r.v for r in snapshot.appended(old, new, ["k"]).collect()} == {"a": 1, "b": 2, "c": 5}


def test_fallback_lookup_takes_the_first_spelling(spark):
    left = spark.createDataFrame([("BRK.B",), ("X",)], "code string")
    table = spark.createDataFrame([("BRK-B", 1), ("BRKB", 2)], "code string, v int")
    got = snapshot.fallback_lookup(left, table, "code", [F.col("code"), F.replace("code", F.lit("."), F.lit("-")), F.replace("code", F.lit("."), F.lit(""))], "v")
    assert {r.code: r.v for r in got.collect()} == {"BRK.B": 1, "X": None}


def test_text_rules(spark):
    df = spark.createDataFrame([("600000.sh",), ("600000.XX",), (None,), ("12",)], "x string")
    assert [r.c for r in df.select(text.strict_code(F.col("x")).alias("c")).collect()] == ["600000", None, None, None]
    hide = lambda m, **k: spark.createDataFrame([(m,)], "m string").select(text.redacted(F.col("m"), **k).alias("m")).first().m
    for message, secret in [
        ("authorization: Basic dXNlcjpwYXNz; failed", "dXNl"), ("abcdefghij.klmnopqrst.uvwxyz0", "klmno"), ("x" * 24, "xx"), ("{'authorization': Basic short}", "short"), ('{"authorization": Token other}', "other"),
        ("authorization='Bearer zz yy' on", "yy"), ("refresh_token=one access_token: two", "one"), ("known7 here", "known7"), ("Bearer a~b/c+d=", "a~b"),
    ]:
        once = hide(message, secrets=("known7",))
        assert secret not in once and "[REDACTED]" in once and "[REDACTED]]" not in once and hide(once) == once
    assert hide("ab cd " + "y" * 23) == "ab cd " + "y" * 23
    said = 'x access_token="abc def" password: hunter2 Bearer a.b-c  ' + "k" * 40
    out = spark.createDataFrame([(said,)], "m string").select(text.redacted(F.col("m")).alias("m")).first().m
    assert "abc" not in out and "hunter2" not in out and "a.b-c" not in out and "kkk" not in out and "  " not in out
    assert len(spark.createDataFrame([("y " * 900,)], "m string").select(text.redacted(F.col("m")).alias("m")).first().m) == 300


def test_vendor_lists_are_padded(spark):
    df = spark.sql("select array(named_struct('thscode', 'a', 'time', array('t1', 't2'), 'table', map('v', array(1.0d, 2.0d), 'w', array(3.0d)))) as tables")
    got = connectors.flatten_vendor(df).orderBy("time").collect()
    assert [(r.time, r["values"]) for r in got] == [("t1", {"v": 1.0, "w": 3.0}), ("t2", {"v": 2.0, "w": None})]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "k string, seq long, v double")
    sinks.upsert(df, str(tmp_path / "t"), ["k"])
    sinks.upsert(spark.createDataFrame([("b", 3, 9.0)], "k string, seq long, v double"), str(tmp_path / "t"), ["k"])
    assert {r.k: r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"a": 1.0, "b": 9.0}
    bars = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-02")], "code string, date string")
    sinks.write_bars(bars, str(tmp_path / "bars"))
    sinks.write_bars(spark.createDataFrame([("b", "2024-01-02")], "code string, date string"), str(tmp_path / "bars"))
    assert sorted((r.code, str(r.date)) for r in spark.read.parquet(str(tmp_path / "bars")).collect()) == [("a", "2024-01-01"), ("b", "2024-01-02")]
    with pytest.raises(ValueError):
        sinks.write_snapshot(df, str(tmp_path / "s"), 10)
    sinks.write_csv(df, str(tmp_path / "c"))
