"""Record checks on made-up records: an order is a record, and its key says what is wrong with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.operators import records

from .roles import table

_FIRST = "Turn 0. Expansion budget: 5 of 5 left.\n\nNeeds an expansion\n  <mol m0>CCO</mol>"
_SECOND = "<mol m0/> came back with 2 candidate disconnections.\n\nTurn 1. Expansion budget: {b} of 5 left.\n\nReady to rank\n  <mol m0/> has 2 candidates:\n    <c0>A* + B</c0>\n    <c1>C</c1>\n"
_THIRD = "Route **r1** under <mol m0/> is open\n\nTurn {t}. Expansion budget: 4 of 5 left.\nNothing is open."
#: What the kinds of records break, worked out by hand.
_BROKEN = {
    0: {},
    1: {"state/budget": 2},
    2: {"state/expand_target_not_open": 1, "state/expansion_not_echoed": 1},
    3: {"state/candidate_missing": 1},
    4: {"gold/tree_has_extra_children": 1},
    5: {"gold/unfinished": 1, "state/rank_without_successor": 1},
    6: {"format/assistant_shape_or_grammar": 1, "state/turn_index": 1, "gold/done_premature": 1, "gold/done_leaf_not_buyable": 1},
    7: {"gold/committed_children_mismatch": 1, "format/think_empty": 1, "state/route_not_opened": 1},
}


def _values(broken: dict) -> str:
    return ", ".join(f"({k}, '{code}', {n})" for k, codes in broken.items() for code, n in codes.items())


@query("record_issues", f"SELECT o_orderkey AS record, code, CAST(n AS BIGINT) AS n FROM orders JOIN (VALUES {_values(_BROKEN)}) AS v(kind, code, n) ON kind = o_orderkey % 8")
def record_issues(spark, sf):
    """Form, budget, menu and tree of every record's turns."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record"), (F.col("o_orderkey") % 8).alias("k"))
    k = F.col("k")
    text = lambda c: c.cast("string")
    turn = lambda i, user, kind, mol, top, think=F.lit("so"): F.struct(F.lit(i).alias("i"), user.alias("user"), kind.alias("kind"), mol.alias("mol"), top.cast("int").alias("top"), think.alias("think"))
    none = F.lit(None).cast("string")
    second = F.replace(F.lit(_SECOND), F.lit("{b}"), text(F.when(k == 1, 5).otherwise(4)))
    third = F.replace(F.when(k == 7, F.replace(F.lit(_THIRD), F.lit("under <mol m0/>"), F.lit("under <mol m5/>"))).otherwise(F.lit(_THIRD)), F.lit("{t}"), text(F.when(k == 6, 9).otherwise(2)))
    turns = F.array(
        turn(0, F.lit(_FIRST), F.lit("single"), F.when(k == 2, "m9").otherwise("m0"), F.lit(None)),
        turn(1, second, F.when(k != 6, F.lit("rank")), F.when(k != 6, F.lit("m0")), F.when(k == 3, 7).when(k == 7, 1).otherwise(0), F.when(k == 7, " ").otherwise("so")),
        turn(2, third, F.lit("done"), none, F.lit(None)),
    )
    turns = o.select("record", F.explode(F.when(k == 5, F.slice(turns, 1, 2)).otherwise(turns)).alias("t")).select("record", "t.*")
    node = lambda mol, status: F.struct(F.lit(mol).alias("mol"), status.alias("status"))
    nodes = o.select("record", F.explode(F.array(node("m0", F.lit("committed")), node("A", F.lit("buyable")), node("B", F.when(k == 6, "open").otherwise("buyable")))).alias("x")).select("record", "x.*")
    children = F.when(k == 4, F.array(F.lit("A"), F.lit("B"), F.lit("C"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    edges = o.select("record", F.lit("m0").alias("parent"), F.explode(children).alias("child"))
    return records.turn_issues(turns, nodes, edges)


_BOARD = "Budget: 3 of 50 left\nr1  top·c2  1 of 2 closed\nOPEN 2\n  m1 under r1\n    <c0 q.5>x</c0>\n    <c1 q.4>y</c1>\n  m2 under r1\nCLOSED none\n"
_BOARD_COUNTS = {
    0: {"n_turns": 3, "n_calls": 2, "n_items": 3, "n_final": 1},
    1: {"n_turns": 3, "n_calls": 2, "n_items": 3, "n_final": 1, "state/mid_not_open": 1, "final/no_route": 1},
    2: {"n_turns": 3, "n_calls": 2, "n_items": 3, "n_final": 1, "state/candidate_off_screen": 1, "action/two_actions_one_molecule": 1},
    3: {"n_turns": 3, "n_calls": 2, "n_items": 1, "n_final": 1, "action/unparsed": 1, "state/no_board": 1},
    4: {"n_turns": 3, "n_calls": 2, "n_items": 3, "n_final": 1, "n_unsupervised": 1},
}


@query("board_record_issues", f"SELECT o_orderkey AS record, code, CAST(n AS BIGINT) AS n FROM orders JOIN (VALUES {_values(_BOARD_COUNTS)}) AS v(kind, code, n) ON kind = o_orderkey % 5")
def board_record_issues(spark, sf):
    """Calls of board episodes against the board last shown; all counts worked out by hand."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record"), (F.col("o_orderkey") % 5).alias("k"))
    k = F.col("k")
    item = lambda kind, mid, order: F.struct(F.lit(kind).alias("type"), mid.alias("mid"), order.alias("order"))
    empty = F.array().cast("array<int>")
    none = F.lit(None).cast("string")
    first = F.array(item("rank", F.lit("m1"), F.when(k == 2, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1)))), item("open", F.when(k == 1, "zz").when(k == 2, "m1").otherwise("m2"), empty))
    second = F.array(item("done", none, empty))
    turn = lambda i, board, items, supervised, final: F.struct(F.lit(i).alias("i"), board.alias("board"), items.alias("items"), supervised.alias("supervised"), final.alias("final"))
    turns = F.array(
        turn(0, F.when(k != 3, F.lit(_BOARD)), F.when(k != 3, first), k != 4, none),
        turn(1, none, second, F.lit(True), none),
        turn(2, none, F.lit(None).cast("array<struct<type:string,mid:string,order:array<int>>>"), F.lit(True), F.when(k == 1, "Nothing to give.").otherwise("Handing over 2 routes.")),
    )
    return records.board_issues(o.select("record", F.explode(turns).alias("t")).select("record", "t.*"))
