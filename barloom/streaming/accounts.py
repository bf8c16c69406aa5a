"""Paper accounts as a stateful stream: each batch of days moves every account on from where it stood."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.portfolio import ACCOUNT_DAYS, Account, fold_days
from barloom.session import ship_package


def account_stream(days: DataFrame, capital: float = 100_000.0, rebalance: int = 5, cost_bps: float = 10) -> DataFrame:
    """Rows of every new day of each account of a stream of ``account, date, code, close, mark, bench_return, weight``.

    The state is the account itself (cash, shares, pending targets, counters).  Days that
    an account has seen, delivered again, change nothing; a day has to be in one batch.
    """

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Account(**json.loads(state.get[0])) if state.exists else Account.of(capital)
        yield fold_days(own, pd.concat(list(frames)), rebalance, cost_bps)
        state.update((json.dumps(asdict(own)),))

    ship_package(days.sparkSession)
    return days.groupBy("account").applyInPandasWithState(step, ACCOUNT_DAYS, "state string", "append", GroupStateTimeout.NoTimeout)
