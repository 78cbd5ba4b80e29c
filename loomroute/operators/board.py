"""The board: a keyed state machine over an ordered action log, with budget, commitments and cascades.

State of one episode: molecules (status open, expanded, closed, dead), the candidates committed to, the budget
left. Actions: ``open`` pays one unit and attaches the menu; ``rank`` commits the named candidates of an
expanded molecule; ``dead`` marks it and withdraws what depends on it; ``terminate`` ends the episode. An
action that breaks a rule is rejected with a code and changes nothing. Two actions on one molecule in one turn:
the second is rejected.

The machine is plain Python with a state that can be saved and loaded, so the same code replays a log in a
batch job (one group an episode) and runs as streaming state.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame

OUT = "episode long, seq long, accepted boolean, code string, budget_left long, n_open long, n_dead long"


class Board:
    def __init__(self, budget: int) -> None:
        self.left = budget
        self.status: dict[str, str] = {}
        self.committed: dict[str, list[int]] = {}
        self.parents: dict[str, list[str]] = {}
        self.turn = None
        self.acted: set[str] = set()
        self.ended = False

    def dump(self) -> str:
        return json.dumps([self.left, self.status, self.committed, self.parents, self.turn, sorted(self.acted), self.ended])

    @classmethod
    def load(cls, saved: str) -> Board:
        b = cls(0)
        b.left, b.status, b.committed, b.parents, b.turn, acted, b.ended = json.loads(saved)
        b.acted = set(acted)
        return b

    def apply(self, turn: int, verb: str, mid: str, cand: int) -> str | None:
        """Null if accepted, else the code of the rule that the action breaks."""
        if self.ended:
            return "after_end"
        if turn != self.turn:
            self.turn, self.acted = turn, set()
        if verb == "terminate":
            self.ended = True
            return None
        if mid in self.acted:
            return "twice_in_turn"
        rule = getattr(self, f"_{verb}", None)
        code = rule(mid, cand) if rule else "unknown_verb"
        if code is None:
            self.acted.add(mid)
        return code

    def _open(self, mid: str, cand: int) -> str | None:
        if self.status.get(mid) in ("expanded", "dead"):
            return "not_open"
        if self.left <= 0:
            return "budget"
        self.left -= 1
        self.status[mid] = "expanded"
        return None

    def _rank(self, mid: str, cand: int) -> str | None:
        if self.status.get(mid) != "expanded":
            return "not_expanded"
        if cand in self.committed.get(mid, []):
            return "repeated_candidate"
        piece = f"{mid}.{cand}"
        if mid.startswith(piece):
            return "cycle"
        self.committed.setdefault(mid, []).append(cand)
        self.status.setdefault(piece, "open")
        self.parents.setdefault(piece, []).append(mid)
        return None

    def _dead(self, mid: str, cand: int) -> str | None:
        if self.status.get(mid) == "dead":
            return "already_dead"
        if mid not in self.status:
            return "unknown_molecule"
        falling = [mid]
        while falling:
            m = falling.pop()
            self.status[m] = "dead"
            for parent in self.parents.get(m, []):
                c = int(m.rsplit(".", 1)[1])
                if c in self.committed.get(parent, []):
                    self.committed[parent].remove(c)
                    if not self.committed[parent] and self.left <= 0 and self.status[parent] != "dead":
                        falling.append(parent)
        return None

    def counts(self) -> tuple[int, int]:
        values = list(self.status.values())
        return sum(v == "open" for v in values), sum(v == "dead" for v in values)


def replay_rows(board: Board, rows: Iterable[tuple]) -> list[tuple]:
    """rows: (episode, seq, turn, verb, mid, cand) in order."""
    out = []
    for episode, seq, turn, verb, mid, cand in rows:
        code = board.apply(int(turn), verb, mid, int(cand))
        out.append((episode, seq, code is None, code, board.left, *board.counts()))
    return out


def replay(log: DataFrame, budget: int) -> DataFrame:
    """A row for each action of (episode, seq, turn, verb, mid, cand); an episode is one group, in order of seq."""

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("seq")
        rows = replay_rows(Board(budget), pool[["episode", "seq", "turn", "verb", "mid", "cand"]].itertuples(index=False, name=None))
        return pd.DataFrame(rows, columns=["episode", "seq", "accepted", "code", "budget_left", "n_open", "n_dead"])

    return log.select("episode", "seq", "turn", "verb", "mid", "cand").groupBy("episode").applyInPandas(run, OUT)
