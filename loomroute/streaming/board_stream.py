"""The board as streaming state: actions arrive in micro-batches, each episode's board is kept between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomroute.operators.board import OUT, Board, replay_rows


def replay_stream(log: DataFrame, budget: int, idle: int | None = None) -> DataFrame:
    """Like ``operators.board.replay`` on a stream of (episode, seq, turn, verb, mid, cand).

    Actions of an episode must arrive in order of seq over micro-batches; within one they are sorted. With ``idle``, an
    episode without an action for so many milliseconds is over: its state goes, and a later action would begin a new
    board. A stream that runs for long needs it; one that ends by itself must go without (empty batches follow each other).
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        board = Board.load(state.get[0]) if state.exists else Board(budget)
        pool = pd.concat(list(batches)).sort_values("seq")
        rows = replay_rows(board, pool[["episode", "seq", "turn", "verb", "mid", "cand"]].itertuples(index=False, name=None))
        state.update((board.dump(),))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(rows, columns=["episode", "seq", "accepted", "code", "budget_left", "n_open", "n_dead"])

    return log.groupBy("episode").applyInPandasWithState(run, OUT, "board string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
