"""Graph queries on the heap tree over part keys: the parent of k is k div 2, keys 0 and 1 are roots."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.operators import graph

from .roles import table

_EDGES = "edges AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1)"
_UP = "up(node, ancestor, distance) AS (SELECT child, parent, CAST(1 AS BIGINT) FROM edges UNION ALL SELECT up.node, e.parent, up.distance + 1 FROM up JOIN edges e ON e.child = up.ancestor)"


def _edges(spark, sf):
    return table(spark, sf, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent"))


@query("ancestors", f"WITH RECURSIVE {_EDGES}, {_UP} SELECT * FROM up")
def ancestors(spark, sf):
    return graph.ancestors(_edges(spark, sf))


@query(
    "longest_chain",
    f"WITH RECURSIVE {_EDGES}, {_UP}, n AS (SELECT child AS node FROM edges UNION SELECT parent FROM edges) SELECT n.node, coalesce(max(distance), 0) AS depth FROM n LEFT JOIN up ON up.ancestor = n.node GROUP BY n.node",
)
def longest_chain(spark, sf):
    return graph.longest_chain(_edges(spark, sf))


@query("leaf_walk", f"WITH RECURSIVE {_EDGES}, {_UP} SELECT ancestor AS root, node AS leaf FROM up WHERE node NOT IN (SELECT parent FROM edges)")
def leaf_walk(spark, sf):
    return graph.leaf_walk(_edges(spark, sf))


@query(
    "cycle_candidates",
    f"WITH RECURSIVE {_EDGES}, {_UP}, offers AS (SELECT DISTINCT l_partkey AS node, l_suppkey AS piece FROM lineitem) SELECT o.node, o.piece FROM offers o WHERE o.node = o.piece OR EXISTS (SELECT 1 FROM up WHERE up.node = o.node AND up.ancestor = o.piece)",
)
def cycle_candidates(spark, sf):
    offers = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("piece")).distinct()
    return graph.cycle_candidates(offers, graph.ancestors(_edges(spark, sf)))


#: Rounds of the max-min value, and its SQL unrolled over as many.
LEVELS = 10
_CAND = "cand AS (SELECT p_partkey // 2 AS node, p_partkey % 2 AS candidate, p_retailprice AS signal, p_partkey AS piece FROM part WHERE p_partkey > 1)"
_HELD = "held AS (SELECT p_partkey AS node FROM part WHERE p_size <= 12)"
_NODES = "nodes AS (SELECT node, node IN (SELECT node FROM held) AS held FROM (SELECT node FROM cand UNION SELECT piece FROM cand))"
_V0 = "v0 AS (SELECT node, held, CASE WHEN held THEN 1e18 ELSE -1e18 END AS value FROM nodes)"
_VN = """v{i} AS (SELECT n.node, n.held, CASE WHEN n.held THEN 1e18 ELSE coalesce(m.v, -1e18) END AS value FROM nodes n LEFT JOIN
 (SELECT c.node, max(least(c.signal, w.value)) AS v FROM cand c JOIN v{j} w ON w.node = c.piece GROUP BY c.node) m ON m.node = n.node)"""


@query(
    "maxmin_dp",
    "WITH " + ", ".join([_CAND, _HELD, _NODES, _V0, *[_VN.format(i=i, j=i - 1) for i in range(1, LEVELS + 1)]]) + f" SELECT node, CAST(value AS DOUBLE) AS value FROM v{LEVELS}",
)
def maxmin_dp(spark, sf):
    """Best achievable worst step of each molecule within ten levels."""
    p = table(spark, sf, "part").where("p_partkey > 1")
    cand = p.select(F.floor(F.col("p_partkey") / 2).alias("node"), (F.col("p_partkey") % 2).alias("candidate"), F.col("p_retailprice").alias("signal"), F.array("p_partkey").alias("pieces"))
    stock = table(spark, sf, "part").where("p_size <= 12").select(F.col("p_partkey").alias("node"))
    return graph.maxmin(cand, stock, LEVELS)


_CLOSE = """c{i} AS (SELECT node, level FROM c{j} UNION ALL SELECT r.node, CAST({i} AS BIGINT) FROM (SELECT node FROM rx GROUP BY node HAVING bool_and(piece IN (SELECT node FROM c{j}))) r WHERE r.node NOT IN (SELECT node FROM c{j}))"""


@query(
    "settle_fixpoint",
    "WITH rx AS (SELECT p_partkey // 2 AS node, p_partkey AS piece FROM part WHERE p_partkey > 1), c0 AS (SELECT p_partkey AS node, CAST(0 AS BIGINT) AS level FROM part WHERE p_size <= 40), "
    + ", ".join(_CLOSE.format(i=i, j=i - 1) for i in range(1, 21))
    + " SELECT node, level FROM c20",
)
def settle_fixpoint(spark, sf):
    """Molecules close when all pieces of their reaction have; rounds until nothing changes."""
    p = table(spark, sf, "part")
    rx = p.where("p_partkey > 1").groupBy(F.floor(F.col("p_partkey") / 2).alias("node")).agg(F.collect_list("p_partkey").alias("pieces")).withColumn("reaction", F.lit(0))
    return graph.settle(rx, p.where("p_size <= 40").select(F.col("p_partkey").alias("node")))


_DIE = "d{i} AS (SELECT node FROM d{j} UNION SELECT node FROM rx GROUP BY node HAVING bool_and(piece IN (SELECT node FROM d{j}))  )"


@query(
    "dead_cascade",
    "WITH rx AS (SELECT p_partkey // 2 AS node, p_partkey AS piece FROM part WHERE p_partkey > 1), d0 AS (SELECT p_partkey AS node FROM part WHERE p_size > 40), "
    + ", ".join(_DIE.format(i=i, j=i - 1) for i in range(1, 21))
    + " SELECT node FROM d20",
)
def dead_cascade(spark, sf):
    """Each piece is a reaction of its own here: a molecule dies when all of its reactions have failed."""
    p = table(spark, sf, "part")
    rx = p.where("p_partkey > 1").select(F.floor(F.col("p_partkey") / 2).alias("node"), F.col("p_partkey").alias("reaction"), F.array("p_partkey").alias("pieces"))
    return graph.dead(rx, p.where("p_size > 40").select(F.col("p_partkey").alias("node")))


@query(
    "route_tree_lines",
    "WITH RECURSIVE n AS (SELECT n_nationkey, n_name, n_regionkey FROM nation), w(region, line, depth, path) AS (SELECT r_regionkey, r_name, 0, r_name FROM region UNION ALL SELECT w.region, n.n_name, 1, w.path || '/' || n.n_name FROM w JOIN n ON n.n_regionkey = w.region AND w.depth = 0) SELECT region, string_agg(repeat('  ', depth) || line, chr(10) ORDER BY path) AS tree, count(*) AS n_lines FROM w GROUP BY region",
)
def route_tree_lines(spark, sf):
    """A nested tree as indented text, in path order."""
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    root = r.select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("line"), F.lit(0).alias("depth"), F.col("r_name").alias("path"))
    below = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_regionkey"), "n_name", F.lit(1), F.concat("r_name", F.lit("/"), "n_name"))
    lines = root.union(below).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("path", "depth", "line"))).alias("a"))
    return lines.select("region", F.array_join(F.transform("a", lambda x: F.concat(F.repeat(F.lit("  "), x["depth"]), x["line"])), "\n").alias("tree"), F.size("a").cast("long").alias("n_lines"))
