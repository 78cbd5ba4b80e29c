"""Queries on which candidate or route comes next. Boards are suppliers modulo 20, molecules are parts, candidates are their lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.operators import graph, picks

from .q_graph import _CAND, _HELD, _NODES
from .roles import table

_ORDER = "l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_quantity, l_returnflag, l_linestatus"
_OFFERS = f"""offers AS (SELECT l_suppkey % 20 AS board, l_partkey AS mid, row_number() OVER (PARTITION BY l_suppkey % 20, l_partkey ORDER BY {_ORDER}) - 1 AS idx,
  CASE WHEN l_linenumber < 7 THEN l_discount END AS signal, CASE WHEN l_tax >= 0.04 THEN round(l_discount + l_tax, 2) END AS value, l_returnflag = 'R' AS tried, l_linenumber <> 5 AS acyclic,
  l_quantity > 10 AS recorded, l_linestatus = 'F' AS labelled_dead FROM lineitem)"""
_FLOORS = "floors AS (SELECT s_suppkey AS board, 0.1 AS floor FROM supplier WHERE s_suppkey BETWEEN 1 AND 9)"


def _offers(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("board", F.col("l_suppkey") % 20)
    idx = F.row_number().over(Window.partitionBy("board", "l_partkey").orderBy(*_ORDER.split(", "))) - 1
    return line.select(
        "board",
        F.col("l_partkey").alias("mid"),
        idx.alias("idx"),
        F.when(F.col("l_linenumber") < 7, F.col("l_discount")).alias("signal"),
        F.when(F.col("l_tax") >= 0.04, F.round(F.col("l_discount") + F.col("l_tax"), 2)).alias("value"),
        (F.col("l_returnflag") == "R").alias("tried"),
        (F.col("l_linenumber") != 5).alias("acyclic"),
        (F.col("l_quantity") > 10).alias("recorded"),
        (F.col("l_linestatus") == "F").alias("labelled_dead"),
    )


def _floors(spark, sf):
    return table(spark, sf, "supplier").where("s_suppkey BETWEEN 1 AND 9").select(F.col("s_suppkey").alias("board"), F.lit(0.1).alias("floor"))


def _best(where: str, first: str = "") -> str:
    return f"SELECT board, mid, idx, signal FROM offers o WHERE signal IS NOT NULL AND {where} QUALIFY row_number() OVER (PARTITION BY board, mid ORDER BY {first}signal DESC, idx) = 1"


@query("greedy_pick", f"WITH {_OFFERS} " + _best("NOT tried AND acyclic"))
def greedy_pick(spark, sf):
    return picks.greedy(_offers(spark, sf))


_TRAP = "NOT tried AND acyclic AND value IS NULL"


@query("trap_pick", f"WITH {_OFFERS} " + _best(_TRAP + " AND recorded", "labelled_dead DESC, "))
def trap_pick(spark, sf):
    """Two passes as one order: recorded dead ends first, then anything that does not close."""
    return picks.trap(_offers(spark, sf))


_PIECES = """pieces AS (SELECT board, mid, idx, mid % 3 AS left_, (mid + idx + k) % 4 = 0 AS in_stock, (mid * 7 + idx + k) % 5 <> 0 AS has_menu, CASE WHEN (idx + k) % 3 > 0 THEN (mid * 13 + idx * 3 + k) % 10 / 100.0 END AS top
  FROM offers, (VALUES (0), (1)) AS r(k))"""
_READABLE = "EXISTS (SELECT 1 FROM r WHERE r.board = o.board AND r.mid = o.mid AND r.idx = o.idx)"
_SHOWN = """r AS (SELECT board, mid, idx FROM pieces GROUP BY board, mid, idx HAVING bool_or(NOT in_stock AND (left_ <= 1 OR (has_menu AND coalesce(top, 0) < 0.05))) AND NOT bool_or(NOT in_stock AND left_ > 1 AND NOT has_menu))"""


def _pieces(spark, sf):
    p = _offers(spark, sf).select("board", "mid", "idx", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    mix = lambda m, i: F.col("mid") * m + F.col("idx") * i + F.col("k")
    return p.select(
        "board",
        "mid",
        "idx",
        (F.col("mid") % 3).alias("left"),
        (mix(1, 1) % 4 == 0).alias("in_stock"),
        (mix(7, 1) % 5 != 0).alias("has_menu"),
        F.when((F.col("idx") + F.col("k")) % 3 > 0, mix(13, 3) % 10 / 100.0).alias("top"),
    )


@query("readable_trap_pick", f"WITH {_OFFERS}, {_PIECES}, {_SHOWN} " + _best(f"{_TRAP} AND {_READABLE}"))
def readable_trap_pick(spark, sf):
    """Only failures that show one level down: no level left, or a piece's own menu below the cutoff."""
    return picks.readable_trap(_offers(spark, sf), _pieces(spark, sf), 0.05)


@query(
    "mistake_pick",
    f"WITH {_OFFERS}, {_PIECES}, {_SHOWN}, g AS ({_best('NOT tried AND acyclic')}), t AS ({_best(_TRAP + ' AND recorded', 'labelled_dead DESC, ')}), q AS ({_best(f'{_TRAP} AND {_READABLE}')}) "
    "SELECT 'greedy' AS mode, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM g UNION ALL SELECT 'trap', count(*), CAST(sum(idx) AS BIGINT) FROM t UNION ALL SELECT 'readable', count(*), CAST(sum(idx) AS BIGINT) FROM q",
)
def mistake_pick(spark, sf):
    """The three modes side by side."""
    parts = [picks.mistake(m, _offers(spark, sf), _pieces(spark, sf), 0.05).agg(F.count(F.lit(1)).alias("n"), F.sum("idx").cast("long").alias("idx_sum")).select(F.lit(m).alias("mode"), "n", "idx_sum") for m in ("greedy", "trap", "readable")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "rank_labels",
    f"""WITH {_OFFERS}, {_FLOORS},
p AS (SELECT *, row_number() OVER (PARTITION BY board, mid ORDER BY value DESC, idx) AS place FROM offers WHERE value IS NOT NULL),
v AS (SELECT p.*, row_number() OVER (PARTITION BY p.board, mid ORDER BY place) AS shown, value > coalesce(floor, -1) AS above FROM p LEFT JOIN floors USING (board) WHERE idx < 3),
k AS (SELECT board, mid, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY place) AS ranking FROM v WHERE (above OR shown = 1) AND shown <= 2 GROUP BY board, mid)
SELECT m.board, m.mid, coalesce(ranking, '') AS ranking, NOT EXISTS (SELECT 1 FROM v WHERE v.board = m.board AND v.mid = m.mid AND v.place = 1) AS lost FROM (SELECT DISTINCT board, mid FROM p) m LEFT JOIN k USING (board, mid)""",
)
def rank_labels(spark, sf):
    """Labels of the ranking turn: on screen, above the floor or else the best, capped; and whether the window cost the best one."""
    out = picks.rank_labels(_offers(spark, sf), _floors(spark, sf), 3, 2)
    return out.select("board", "mid", F.array_join(F.transform("order", lambda x: x.cast("string")), ",").alias("ranking"), "lost")


@query(
    "branch_order",
    f"""WITH {_OFFERS}, l AS (SELECT board, mid, list(idx ORDER BY value DESC, idx) AS o, list(idx ORDER BY idx) FILTER (recorded) AS w FROM offers WHERE value IS NOT NULL GROUP BY board, mid),
s AS (SELECT board, mid, list_concat(list_filter(o, lambda x: list_contains(coalesce(w, []), x)), list_filter(o, lambda x: NOT list_contains(coalesce(w, []), x))) AS a, greatest(1, len(coalesce(w, []))) AS n FROM l)
SELECT board, mid, array_to_string(a, ',') AS ranking, n AS committed FROM s""",
)
def branch_order(spark, sf):
    """Candidates that queued routes want go first and are all committed."""
    o = _offers(spark, sf).where("value IS NOT NULL").groupBy("board", "mid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "idx"))), lambda x: x["idx"]).alias("o"), F.collect_list(F.when(F.col("recorded"), F.col("idx"))).alias("w")
    )
    b = o.select("board", "mid", picks.branch_order(F.col("o"), F.col("w")).alias("b"))
    return b.select("board", "mid", F.array_join(F.transform("b.order", lambda x: x.cast("string")), ",").alias("ranking"), F.col("b.commit").cast("long").alias("committed"))


@query(
    "continuation",
    f"""WITH {_OFFERS}, {_FLOORS}, m AS (SELECT DISTINCT board, mid, mid AS place, mid % 4 <> 0 AS rankable FROM offers)
SELECT o.board, o.mid, idx, value FROM offers o JOIN m ON m.board = o.board AND m.mid = o.mid JOIN floors f ON f.board = o.board WHERE rankable AND NOT tried AND idx < 3 AND value > floor
QUALIFY row_number() OVER (PARTITION BY o.board ORDER BY value DESC, place, idx) = 1""",
)
def continuation(spark, sf):
    """The one candidate of a board that could still beat its best route."""
    o = _offers(spark, sf)
    m = o.select("board", "mid").distinct().withColumn("place", F.col("mid")).withColumn("rankable", F.col("mid") % 4 != 0)
    return picks.continuation(o, m, _floors(spark, sf), 3)


_QUEUE = "queue AS (SELECT o_custkey % 50 AS board, o_orderkey AS place, o_custkey || '|' || o_orderpriority AS key, o_orderstatus <> 'P' AS ready, o_totalprice > 300000 AS claimed FROM orders)"
_HELD_KEYS = "held AS (SELECT DISTINCT c_custkey % 50 AS board, c_custkey || '|1-URGENT' AS key FROM customer WHERE c_acctbal > 0)"


def _queue(spark, sf):
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 50).alias("board"), F.col("o_orderkey").alias("place"), F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("key"), (F.col("o_orderstatus") != "P").alias("ready"), (F.col("o_totalprice") > 300000).alias("claimed"))


def _held_keys(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 0").select((F.col("c_custkey") % 50).alias("board"), F.concat_ws("|", F.col("c_custkey").cast("string"), F.lit("1-URGENT")).alias("key"))


@query(
    "claim_step",
    f"""WITH {_QUEUE}, {_HELD_KEYS}, r AS (SELECT board, key, min(place) AS place FROM queue q WHERE ready AND NOT claimed AND NOT EXISTS (SELECT 1 FROM held h WHERE h.board = q.board AND h.key = q.key) GROUP BY board, key)
SELECT board, place, key FROM r QUALIFY row_number() OVER (PARTITION BY board ORDER BY place) <= 1 + board % 4""",
)
def claim_step(spark, sf):
    """Queued routes that the board can make, by step set once, within its room."""
    q = _queue(spark, sf)
    return picks.claims(q, _held_keys(spark, sf), q.select("board").distinct().withColumn("room", 1 + F.col("board") % 4))


@query(
    "route_open_step",
    """WITH n AS (SELECT o_custkey % 50 AS board, o_orderkey AS place, l_linenumber AS step, l_partkey AS mid, l_partkey % 3 = 0 AS has_menu, o_orderstatus = 'P' AS blocked FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT board, mid, min(row(place, step)) AS need FROM n WHERE NOT blocked AND NOT has_menu GROUP BY board, mid)
SELECT board, mid, row_number() OVER (PARTITION BY board ORDER BY need, mid) AS k FROM f QUALIFY k <= 4""",
)
def route_open_step(spark, sf):
    """Molecules that unclaimed routes still need a menu for, in order of need."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    needs = j.select((F.col("o_custkey") % 50).alias("board"), F.col("o_orderkey").alias("place"), F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("mid"), (F.col("l_partkey") % 3 == 0).alias("has_menu"), (F.col("o_orderstatus") == "P").alias("blocked"))
    return picks.opens(needs, 4)


@query(
    "next_route_step",
    """WITH p AS (SELECT o_custkey AS board, o_orderkey AS place, l_linenumber AS depth, l_partkey AS mid, l_partkey % 3 > 0 AS has_menu, CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 7 END AS idx, l_returnflag <> 'R' AS acyclic FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber > 1),
s AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY board, place ORDER BY depth, mid, has_menu, idx NULLS FIRST, acyclic) = 1)
SELECT board, place, mid, CASE WHEN has_menu THEN 'rank' ELSE 'open' END AS verb, CASE WHEN has_menu THEN idx END AS idx FROM s WHERE NOT has_menu OR (idx < 5 AND acyclic) QUALIFY row_number() OVER (PARTITION BY board ORDER BY place) = 1""",
)
def next_route_step(spark, sf):
    """One move toward the first queued route whose shallowest difference can be acted on."""
    j = table(spark, sf, "lineitem").where("l_linenumber > 1").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    points = j.select(
        F.col("o_custkey").alias("board"), F.col("o_orderkey").alias("place"), F.col("l_linenumber").alias("depth"), F.col("l_partkey").alias("mid"), (F.col("l_partkey") % 3 > 0).alias("has_menu"),
        F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey") % 7).alias("idx"), (F.col("l_returnflag") != "R").alias("acyclic"),
    )
    return picks.next_moves(points, 5)


@query(
    "free_route_step",
    f"""WITH {_HELD_KEYS}, w AS (SELECT o_custkey % 50 AS board, o_custkey || '|' || o_orderpriority AS key, l_orderkey AS step, l_partkey AS mid, l_suppkey AS idx, CASE WHEN l_tax > 0.01 THEN l_discount END AS signal,
  l_returnflag = 'R' AS tried, l_linenumber <> 5 AS acyclic, l_quantity > 25 AS all_bought FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
o AS (SELECT * FROM w WHERE NOT tried AND acyclic AND all_bought AND NOT EXISTS (SELECT 1 FROM held h WHERE h.board = w.board AND h.key = w.key) QUALIFY row_number() OVER (PARTITION BY board, key ORDER BY step, mid, idx, signal NULLS FIRST) = 1)
SELECT board, key, mid, idx, row_number() OVER (PARTITION BY board ORDER BY signal DESC NULLS LAST, step, mid, idx) AS k FROM o QUALIFY k <= 3""",
)
def free_route_step(spark, sf):
    """Routes that a swap to purchasable pieces makes for nothing, the best of each board."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    swaps = j.select(
        (F.col("o_custkey") % 50).alias("board"), F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("key"), F.col("l_orderkey").alias("at"), F.col("l_partkey").alias("mid"), F.col("l_suppkey").alias("idx"),
        F.when(F.col("l_tax") > 0.01, F.col("l_discount")).alias("signal"), (F.col("l_returnflag") == "R").alias("tried"), (F.col("l_linenumber") != 5).alias("acyclic"), (F.col("l_quantity") > 25).alias("all_bought"),
    )
    return picks.free_routes(swaps, _held_keys(spark, sf), 3)


_COVER = """c{i} AS (SELECT n.node, n.held OR {i} = 0 OR (EXISTS (SELECT 1 FROM cand c WHERE c.node = n.node) AND NOT EXISTS (SELECT 1 FROM top3 t JOIN c{j} w ON w.node = t.piece WHERE t.node = n.node AND NOT w.covered)) AS covered FROM nodes n)"""


@query(
    "coverable",
    "WITH " + ", ".join([_CAND, _HELD, _NODES, "top3 AS (SELECT node, piece FROM cand QUALIFY row_number() OVER (PARTITION BY node ORDER BY signal DESC, candidate) <= 3)", "c0 AS (SELECT node, true AS covered FROM nodes)", *[_COVER.format(i=i, j=i - 1) for i in range(1, 5)]]) + " SELECT node, covered FROM c4",
)
def coverable(spark, sf):
    """Whether the recording reaches everything below a molecule within four levels."""
    p = table(spark, sf, "part").where("p_partkey > 1")
    cand = p.select(F.floor(F.col("p_partkey") / 2).alias("node"), (F.col("p_partkey") % 2).alias("candidate"), F.col("p_retailprice").alias("signal"), F.array("p_partkey").alias("pieces"))
    stock = table(spark, sf, "part").where("p_size <= 12").select(F.col("p_partkey").alias("node"))
    return graph.coverable(cand, stock, 4)


@query(
    "in_recording",
    "WITH " + ", ".join([_CAND, _HELD, _NODES, "top3 AS (SELECT node, piece FROM cand QUALIFY row_number() OVER (PARTITION BY node ORDER BY signal DESC, candidate) <= 3)", "c0 AS (SELECT node, true AS covered FROM nodes)", *[_COVER.format(i=i, j=i - 1) for i in range(1, 4)]])
    + " SELECT c.node, c.candidate, bool_and(w.covered) AS playable FROM cand c JOIN c3 w ON w.node = c.piece GROUP BY c.node, c.candidate",
)
def in_recording(spark, sf):
    """Whether a candidate's whole subtree can be played: all of its pieces are covered one level less deep."""
    p = table(spark, sf, "part").where("p_partkey > 1")
    cand = p.select(F.floor(F.col("p_partkey") / 2).alias("node"), (F.col("p_partkey") % 2).alias("candidate"), F.col("p_retailprice").alias("signal"), F.array("p_partkey").alias("pieces"))
    stock = table(spark, sf, "part").where("p_size <= 12").select(F.col("p_partkey").alias("node"))
    covered = graph.coverable(cand, stock, 3).withColumnRenamed("node", "piece")
    return cand.select("node", "candidate", F.explode("pieces").alias("piece")).join(covered, "piece").groupBy("node", "candidate").agg((F.min(F.col("covered").cast("int")) == 1).alias("playable"))


@query(
    "cuts_by_size",
    "SELECT l_orderkey AS route, l_partkey AS cut, row_number() OVER (PARTITION BY l_orderkey ORDER BY least(l_linenumber, l_quantity) DESC, greatest(l_linenumber, l_quantity) DESC, l_partkey) AS place FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem)",
)
def cuts_by_size(spark, sf):
    """Cut proposals ordered by the size of their smaller fragment."""
    c = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").distinct()
    cuts = c.select(F.col("l_orderkey").alias("route"), F.col("l_partkey").alias("cut"), F.array(F.col("l_linenumber").cast("double"), "l_quantity").alias("sizes"))
    return picks.cuts_by_size(cuts, ["route"], "sizes").select("route", "cut", "place")
