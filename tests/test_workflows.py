"""Signals, the suite of strategies, pools of codes, remembered tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import intraday, signals, suite
from barloom.session import remembered
from barloom.sources import connectors


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def test_batches():
    assert list(signals.batches("abcde", 2)) == [["a", "b"], ["c", "d"], ["e"]] and list(signals.batches([], 3)) == []
    with pytest.raises(ValueError):
        list(signals.batches("ab", 0))


def test_score_today(spark):
    rows = [("600000.SH", "10", "11", "9", "10.5"), ("1.SZ", "10", "11", "9", "9.5"), ("000002.SZ", "10", "10", "10", "10"), ("000003.SZ", "x", "11", "9", "10"), ("000004.SZ", "10", "11", "9", "10.5")]
    spot = signals.normalised_spot(spark.createDataFrame(rows, "thscode string, open string, high string, low string, latest string"), spark.createDataFrame([("600000", "Bank")], "code string, name string"))
    got = signals.score_today(spot).orderBy("rank").collect()
    assert [(r["rank"], r.code, r.score, r.name) for r in got] == [(1, "000004", 83.33, None), (2, "600000", 83.33, "Bank"), (3, "001.SZ", 33.33, None)]
    with pytest.raises(ValueError, match="missing columns: close"):
        signals.score_today(spot.drop("close"))


def test_code_pool_files(spark, tmp_path):
    (tmp_path / "pool.csv").write_text("代码,名称\n1,One\n900901,B\n920001,New\n830001,No\n1,One\n", encoding="utf-8")
    (tmp_path / "pool.json").write_text('[{"code": "600000", "name_cn": "Bank"}, {"code": "300001", "name_cn": null}]')
    assert {tuple(r) for r in connectors.read_code_pool(spark, str(tmp_path / "pool.csv")).collect()} == {("000001", "One"), ("900901", "B"), ("920001", "New")}
    assert {tuple(r) for r in connectors.read_code_pool(spark, str(tmp_path / "pool.json")).collect()} == {("600000", "Bank"), ("300001", None)}
    (tmp_path / "bad.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        connectors.read_code_pool(spark, str(tmp_path / "bad.csv"))


def test_unknown_strategies_are_refused(spark):
    empty = spark.createDataFrame([], "code string, date date, ord long, close double, returns double")
    for call in (suite.weights, suite.targets):
        with pytest.raises(ValueError, match="unknown strategy"):
            call(empty, "astrology")
    with pytest.raises(ValueError, match="notices"):
        suite.weights(empty, "pead")
    assert {r.code: r.weight for r in suite.targets(empty, "pead", override={"a": 0.5}).collect()} == {"a": 0.5}
    assert set(suite.GRIDS) < set(suite.STRATEGIES) and not suite.CONSTRAINTS["ma_cross"]({"fast": 50, "slow": 50})


def test_searches_of_strategies_that_learn_and_that_don_t(spark):
    rows = [(c, day(k), k, 10.0 + ((k * (i + 3)) % 7) + i, 100.0 + k, 0.01 * ((k * (i + 2)) % 5 - 2)) for i, c in enumerate("abcdef") for k in range(60)]
    panel = spark.createDataFrame(rows, "code string, date date, ord long, close double, volume double, returns double")
    from barloom.operators.strategies import grid

    own = lambda fast, slow: suite.weights(panel, "ma_cross", fast=fast, slow=slow)
    choices = {"fast": [2, 9], "slow": [5, 8]}
    a, b = (sorted(map(tuple, grid(panel, "ma_cross", choices, allowed=suite.CONSTRAINTS["ma_cross"], weigh=w).select("params", F.round("train_sharpe", 9), F.round("test_sharpe", 9), "best", "overfit").collect())) for w in (None, own))
    assert a == b and len(a) == 2 and sum(r[3] for r in a) == 1
    assert all((r[2] is None) == (not r[3]) == (r[4] is None) for r in a)  # the holdout is for the best alone


def test_attributes_expire(spark):
    codes = [f"c{i:02d}" for i in range(12)]
    factors = spark.createDataFrame([(c, day(k), k, float(i * (k + 1) % 7), 1.0 * i, 2.0 * i * i, float(i % 5)) for i, c in enumerate(codes) for k in range(8)], "code string, date date, ord long, f_rskew double, f_cpv_mean double, f_cpv_std double, f_smart double")
    pool = factors.select("date", "code")
    attributes = spark.createDataFrame([(day(1), c, 10.0 + i, f"g{i % 2}") for i, c in enumerate(codes)], "date date, code string, float_cap double, industry string")
    got = intraday.preprocess_panels(factors, pool, attributes, 10)
    assert {r.date for r in got.where("f_smart is not null").select("date").distinct().collect()} == {day(k) for k in range(1, 6)}
    with pytest.raises(ValueError, match="f_smart"):
        intraday.preprocess_panels(factors.drop("f_smart"), pool, attributes, 10)


def test_remembered_tables_follow_their_sources(spark, tmp_path):
    path, built = str(tmp_path / "t.parquet"), []

    def build():
        built.append(1)
        return spark.read.parquet(path)

    spark.range(3).write.parquet(path)
    assert [remembered(spark, "t", [path], build).count() for _ in range(2)] == [3, 3] and len(built) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert remembered(spark, "t", [path], build).count() == 5 and len(built) == 2
