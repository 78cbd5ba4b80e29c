"""Queries on fields of text and on what boards look up. Molecules are parts, boards suppliers modulo 20, routes orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.functions import fields
from loomroute.operators import lookups

from .q_drafts import _case
from .roles import table
from .workspace import new_folder, save

_CHOICES = _case("o_orderkey % 6", ["qm·c0 vg·c9", "qm·c1", "qm·c1 qm·c2", "qm c1", "", "a·c10  b·c2"])
_SIGNALS = _case("o_orderkey % 4", ["q.374 rt1 p—", "p.1p.25", "none", "q1 rt— d.05"])
_VALUES = _case("o_orderkey % 5", [".374, -, 2", "0.5", "a, .2", "rt1, —", "-1.5,+2,.75"])


@query(
    "text_fields",
    """WITH v AS (SELECT * FROM (VALUES (0, 'qm=0,vg=9'), (1, 'qm=1'), (5, 'a=10,b=2')) AS t(k, c)), s AS (SELECT * FROM (VALUES (0, 'q=0.374,rt=1.0'), (1, 'p=0.25'), (2, ''), (3, 'd=0.05,q=1.0')) AS t(k, s)),
n AS (SELECT * FROM (VALUES (0, '0.374,null,2.0'), (1, '0.5'), (2, NULL), (3, '1.0,null'), (4, '-1.5,2.0,0.75')) AS t(k, n))
SELECT o_orderkey AS turn, v.c AS choices, s.s AS signals, n.n AS numbers FROM orders LEFT JOIN v ON v.k = o_orderkey % 6 JOIN s ON s.k = o_orderkey % 4 JOIN n ON n.k = o_orderkey % 5""",
)
def text_fields(spark, sf):
    """Choices, signals and value lists read from text; the readings of the texts are worked out by hand in the SQL."""
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("turn"), fields.choices(F.expr(_CHOICES)).alias("c"), fields.signals(F.expr(_SIGNALS)).alias("s"), fields.values(F.expr(_VALUES)).alias("n"))
    return o.select("turn", shown("c").alias("choices"), shown("s").alias("signals"), F.array_join(F.transform("n", lambda x: x.cast("string")), ",", "null").alias("numbers"))


_SAID = _case("o_orderkey % 4", ["The Ullmann coupling of the aryl iodide", "a plain substitution", "C–O is broken. ", "  Wittig   olefination.. "])
_CLASS = _case("o_custkey % 3", ["Ullmann-Goldberg Substitution aryl alcohol", "Wittig Olefination", "General synthesis"])
_CLAUSE = _case("o_orderkey % 3", ["m1 under r1, m2 | two rival branches, one per parent r7: 1 of 2 closed", "all three cuts wait for zz9", "Both | the four pieces; a1 first"])


@query(
    "text_claims",
    """WITH c AS (SELECT *, o_orderkey % 4 AS k, o_custkey % 3 AS j FROM orders)
SELECT o_orderkey AS turn, (k = 0 AND j = 0) OR (k = 3 AND j = 1) AS agrees, CASE WHEN o_custkey % 2 = 0 THEN k IN (0, 2) ELSE true END AS bond, (VALUES_.t) AS loose, A.t AS argument
FROM c JOIN (VALUES (0, 'the ullmann coupling of the aryl iodide'), (1, 'a plain substitution'), (2, 'c–o is broken'), (3, 'wittig olefination')) AS VALUES_(i, t) ON VALUES_.i = k
JOIN (VALUES (0, 'rival branches per parent led1_2'), (1, 'cuts wait for'), (2, 'pieces first')) AS A(i, t) ON A.i = o_orderkey % 3""",
)
def text_claims(spark, sf):
    """Class words, bonds (as letters, so CO is read in COUPLING), loose forms and arguments of clauses; worked out by hand in the SQL."""
    bonds = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("C-O"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("turn"), fields.class_agrees(F.expr(_SAID), F.array(F.expr(_CLASS))).alias("agrees"), fields.names_bond(F.expr(_SAID), bonds).alias("bond"), fields.loose(F.expr(_SAID)).alias("loose"), fields.argument(F.expr(_CLAUSE)).alias("argument")
    )


@query(
    "step_families",
    """SELECT l_orderkey AS route, l_linenumber AS n, CASE WHEN l_suppkey % 3 = 0 THEN 'Suzuki ' || l_returnflag || ', Z' WHEN l_suppkey % 3 = 1 THEN 'unnamed: ' || CASE WHEN l_partkey % 2 = 0 THEN 'C-C' ELSE '—' END || ' formed / C-N, C-O broken' ELSE 'no mapping' END AS family FROM lineitem""",
)
def step_families(spark, sf):
    """The kind of each step: earned names, else bonds, else nothing measured."""
    empty = F.array().cast("array<string>")
    formed = F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("C-C"))).otherwise(empty)
    tier = F.when(F.col("l_suppkey") % 3 == 0, "applies+makes").otherwise("applies")
    f = fields.family(tier, F.array(F.lit("Z"), F.concat(F.lit("Suzuki "), "l_returnflag")), F.col("l_suppkey") % 3 == 1, formed, F.array(F.lit("C-O"), F.lit("C-N")))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("n"), f.alias("family"))


@query(
    "split_shapes",
    """WITH p AS (SELECT l_orderkey AS route, CASE WHEN l_suppkey % 4 > 0 THEN 's' || l_suppkey % 4 END AS scaffold, CAST(l_quantity AS BIGINT) AS heavy, CAST(l_linenumber AS BIGINT) AS rings FROM lineitem),
g AS (SELECT route, bool_or(scaffold = 's' || route % 4) AS kept, sum(heavy) AS hs, sum(rings) AS rs, min(heavy) AS lo, max(heavy) AS hi, count(*) AS n, string_agg(CAST(heavy AS VARCHAR), ',' ORDER BY heavy DESC) AS f FROM p GROUP BY route)
SELECT route, route % 4 > 0 AND coalesce(kept, false) AS scaffold_kept, CAST(rs AS BIGINT) AS rings_precursors, CAST(100 - hs AS BIGINT) AS heavy_balance, f AS fragments, CASE WHEN n > 1 THEN floor(lo / CAST(greatest(hi, 1) AS DOUBLE) * 100 + 0.5) / 100 ELSE 0.0 END AS size_ratio FROM g""",
)
def split_shapes(spark, sf):
    """What each cut does to skeleton, rings and sizes."""
    piece = F.struct(F.when(F.col("l_suppkey") % 4 > 0, F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string"))).alias("scaffold"), F.col("l_quantity").cast("long").alias("heavy"), F.col("l_linenumber").cast("long").alias("rings"))
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("route")).agg(F.collect_list(piece).alias("pieces"))
    own = F.when(F.col("route") % 4 > 0, F.concat(F.lit("s"), (F.col("route") % 4).cast("string")))
    s = g.select("route", fields.split_shape(own, F.lit(100).cast("long"), F.lit(1), F.col("pieces")).alias("s"))
    return s.select("route", "s.scaffold_kept", "s.rings_precursors", "s.heavy_balance", F.array_join(F.transform("s.fragments", lambda x: x.cast("string")), ",").alias("fragments"), "s.size_ratio")


@query("world_info", "SELECT DISTINCT l_partkey AS molecule, coalesce(p_size <= 20, false) AS in_stock, CASE WHEN p_partkey % 3 > 0 THEN round(ln(p_retailprice), 4) END AS ln_price FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def world_info(spark, sf):
    """Stock and price of each molecule asked for; the price does not depend on stock."""
    p = table(spark, sf, "part")
    asked = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("molecule"))
    out = lookups.info(asked, p.where("p_size <= 20").select(F.col("p_partkey").alias("molecule")), p.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("molecule"), F.log("p_retailprice").alias("ln_price")))
    return out.select("molecule", "in_stock", F.round("ln_price", 4).alias("ln_price"))


_POOL = "pool AS (SELECT DISTINCT l_partkey AS product, l_linenumber AS rank, l_suppkey AS key FROM lineitem)"


@query("filtered_menu", f"WITH {_POOL} SELECT product, row_number() OVER (PARTITION BY product ORDER BY rank, key) - 1 AS idx, key FROM pool WHERE key % 3 > 0 QUALIFY idx < 4")
def filtered_menu(spark, sf):
    """The board's filter goes before the cut to the best few."""
    pool = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("product"), F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("key")).distinct()
    return lookups.menu(pool, 4, F.col("key") % 3 > 0).select("product", F.col("idx").cast("long").alias("idx"), "key")


@query("cache_slice", f"WITH {_POOL} SELECT product, row_number() OVER (PARTITION BY product ORDER BY rank, key) - 1 AS idx, key FROM pool QUALIFY idx < 2")
def cache_slice(spark, sf):
    """The first rows of a cached menu."""
    pool = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("product"), F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("key")).distinct()
    return lookups.menu(pool, 2).select("product", F.col("idx").cast("long").alias("idx"), "key")


@query(
    "draw_cache_load",
    "SELECT l_orderkey AS product, l_linenumber AS cand, string_agg(CAST(l_suppkey AS VARCHAR), '.' ORDER BY l_suppkey) AS reactants FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem) GROUP BY ALL HAVING bool_and(l_suppkey % 5 > 0)",
)
def draw_cache_load(spark, sf):
    """Candidates with an unreadable reactant go when a cache is loaded; reactants are sorted."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("product"), F.col("l_linenumber").alias("cand")).agg(F.collect_set("l_suppkey").alias("reactants"))
    valid = table(spark, sf, "supplier").where("s_suppkey % 5 > 0").select(F.col("s_suppkey").alias("molecule"))
    out = lookups.valid_cache(rows, valid)
    return out.select("product", "cand", F.array_join(F.transform("reactants", lambda x: x.cast("string")), ".").alias("reactants"))


@query(
    "evidence_tiers",
    """WITH a AS (SELECT DISTINCT l_partkey AS key FROM lineitem), m AS (SELECT p_partkey AS key, 1.0 AS v FROM part WHERE p_size < 10), c AS (SELECT p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN 2.0 END AS v FROM part WHERE p_size < 30 AND p_partkey % 7 > 0), l AS (SELECT p_partkey AS key, 3.0 AS v FROM part WHERE p_partkey % 2 = 0)
SELECT key, CAST(coalesce(m.v, c.v, l.v) AS DOUBLE) AS value, CASE WHEN m.v IS NOT NULL THEN 'memory' WHEN c.v IS NOT NULL THEN 'cache' WHEN l.v IS NOT NULL THEN 'live' END AS source FROM a LEFT JOIN m USING (key) LEFT JOIN c USING (key) LEFT JOIN l USING (key)""",
)
def evidence_tiers(spark, sf):
    """Memory, then cache, then live; a cache row that is marked as not valid counts as missing."""
    p = table(spark, sf, "part").withColumn("key", F.col("p_partkey"))
    cache = lookups.checked(p.where("p_size < 30").withColumn("value", F.when(F.col("p_size") % 2 == 0, 2.0)), F.col("key") % 7 == 0)
    caches = {"memory": p.where("p_size < 10").withColumn("value", F.lit(1.0)), "cache": cache, "live": p.where("p_partkey % 2 = 0").withColumn("value", F.lit(3.0))}
    return lookups.tiers(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key")), "key", "value", caches)


@query(
    "live_agreement",
    """WITH l AS (SELECT p_partkey AS key, p_size % 3 AS v FROM part WHERE p_partkey % 2 = 0 ORDER BY p_partkey LIMIT 30), c AS (SELECT p_partkey AS key, p_size % 4 AS v FROM part WHERE p_partkey % 3 = 0)
SELECT count(*) FILTER (l.key IS NOT NULL AND c.key IS NOT NULL AND l.v = c.v) AS agree, count(*) FILTER (l.key IS NOT NULL AND c.key IS NOT NULL AND l.v <> c.v) AS differ, count(*) FILTER (c.key IS NULL) AS new, count(*) FILTER (l.key IS NULL) AS fallback FROM l FULL JOIN c ON l.key = c.key""",
)
def live_agreement(spark, sf):
    """Live menus against cached ones within a call budget."""
    p = table(spark, sf, "part")
    live = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), (F.col("p_size") % 3).alias("v"))
    return lookups.agreement(live, p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"), (F.col("p_size") % 4).alias("v")), "key", "v", 30)


@query("ambiguous_candidates", "SELECT l_orderkey AS turn, l_linenumber AS cand FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1")
def ambiguous_candidates(spark, sf):
    return lookups.ambiguous(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("turn"), F.col("l_partkey").alias("mid"), F.col("l_linenumber").alias("cand")))


@query(
    "rows_with_facts",
    "WITH m AS (SELECT DISTINCT l_orderkey AS turn, l_partkey AS mid, l_linenumber AS cand FROM lineitem) SELECT turn, mid, cand, CASE WHEN p_size < 25 THEN p_brand END AS fact FROM m LEFT JOIN part ON p_partkey = mid",
)
def rows_with_facts(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("turn"), F.col("l_partkey").alias("mid"), F.col("l_linenumber").alias("cand")).distinct()
    p = table(spark, sf, "part").where("p_size < 25")
    facts = m.join(p, F.col("mid") == F.col("p_partkey")).select("turn", "mid", "cand", F.col("p_brand").alias("fact"))
    return lookups.rows_with_facts(m, facts)


@query(
    "fields_in_order",
    "WITH a AS (SELECT l_orderkey AS turn, list(DISTINCT l_linenumber ORDER BY l_linenumber DESC) AS o, list(DISTINCT CAST(l_suppkey % 9 AS INT) ORDER BY CAST(l_suppkey % 9 AS INT)) AS d FROM lineitem GROUP BY l_orderkey) SELECT turn, array_to_string(list_concat(o, list_filter(d, lambda x: NOT list_contains(o, x))), ',') AS field FROM a",
)
def fields_in_order(spark, sf):
    """Ranked candidates first, then those described, each once."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("turn")).agg(F.sort_array(F.collect_set("l_linenumber"), False).alias("o"), F.sort_array(F.collect_set((F.col("l_suppkey") % 9).cast("int"))).alias("d"))
    return g.select("turn", F.array_join(F.transform(lookups.field_of(F.col("o"), F.col("d")), lambda x: x.cast("string")), ",").alias("field"))


@query("route_map", "SELECT l_orderkey AS route, l_partkey % 5 AS product, arg_max(l_suppkey, (l_linenumber, l_suppkey)) AS reactants FROM lineitem GROUP BY ALL")
def route_map(spark, sf):
    """Product to reactants of each route; the last step of a product counts."""
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route"), (F.col("l_partkey") % 5).alias("product"), F.col("l_suppkey").alias("reactants"), F.struct("l_linenumber", "l_suppkey").alias("pos"))
    return lookups.route_map(s)


_MOLS = "m AS (SELECT DISTINCT l_suppkey % 20 AS board, l_partkey AS mid, l_partkey % 6 AS depth FROM lineitem)"


@query(
    "dead_reasons",
    f"""WITH {_MOLS}, o AS (SELECT l_suppkey % 20 AS board, l_partkey AS mid, max(CASE WHEN l_linenumber < 6 THEN l_discount ELSE 0 END) AS best, bool_or(l_returnflag = 'R') AS f, bool_and(l_returnflag IN ('R', 'A')) AS t FROM lineitem WHERE l_quantity > 10 GROUP BY ALL),
r AS (SELECT m.board, m.mid, CASE WHEN depth >= 5 THEN 'floor' WHEN best < 0.03 THEN 'cutoff' WHEN f AND t THEN 'exhausted' END AS reason FROM m LEFT JOIN o ON o.board = m.board AND o.mid = m.mid) SELECT * FROM r WHERE reason IS NOT NULL""",
)
def dead_reasons(spark, sf):
    """Which reason to give a molecule up holds: no level left, a menu below the cut, everything tried and failed."""
    line = table(spark, sf, "lineitem").withColumn("board", F.col("l_suppkey") % 20).withColumn("mid", F.col("l_partkey"))
    m = line.select("board", "mid", (F.col("mid") % 6).alias("depth")).distinct()
    o = line.where("l_quantity > 10").select("board", "mid", F.when(F.col("l_linenumber") < 6, F.col("l_discount")).alias("signal"), (F.col("l_returnflag") == "A").alias("tried"), (F.col("l_returnflag") == "R").alias("failed"))
    return lookups.dead_reasons(m, o, 5, 0.03)


@query(
    "open_molecules",
    f"""WITH {_MOLS}, s AS (SELECT DISTINCT l_suppkey % 20 AS board, l_partkey AS mid FROM lineitem WHERE l_linestatus = 'O')
SELECT board, mid, row_number() OVER (PARTITION BY board ORDER BY depth, mid) AS place FROM m WHERE mid % 4 > 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.board = m.board AND s.mid = m.mid)""",
)
def open_molecules(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("board", F.col("l_suppkey") % 20).withColumn("mid", F.col("l_partkey"))
    m = line.select("board", "mid", (F.col("mid") % 6).alias("first_seen"), F.when(F.col("mid") % 4 > 0, "open").otherwise("closed").alias("status")).distinct()
    return lookups.open_molecules(m, line.select("board", "mid", F.when(F.col("l_linestatus") == "O", "open").otherwise("solved").alias("status")))


@query("closed_leaves", f"WITH {_MOLS} SELECT board, mid, 5 - depth AS levels_left FROM m JOIN part ON p_partkey = mid WHERE p_size <= 20 AND mid % 4 = 0")
def closed_leaves(spark, sf):
    """Purchasable molecules banked so far, with the levels left below them."""
    line = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("board"), F.col("l_partkey").alias("mid")).distinct()
    stock = table(spark, sf, "part").where("p_size <= 20").select(F.col("p_partkey").alias("mid"))
    return line.join(stock, "mid", "left_semi").where("mid % 4 = 0").select("board", "mid", (5 - F.col("mid") % 6).alias("levels_left"))


@query("board_route_floor", "SELECT o_custkey AS board, max(w) AS floor FROM (SELECT o_custkey, l_orderkey, min(CASE WHEN l_linenumber < 6 THEN l_discount END) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY o_custkey")
def board_route_floor(spark, sf):
    """The best route's weakest step of each board."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lookups.route_floor(j.select(F.col("o_custkey").alias("board"), F.col("l_orderkey").alias("route"), F.when(F.col("l_linenumber") < 6, F.col("l_discount")).alias("signal")))


@query("leaf_cost", "SELECT l_orderkey AS route, CASE WHEN bool_and(l_partkey % 9 > 0) THEN round(sum(l_extendedprice), 2) END AS cost FROM lineitem GROUP BY l_orderkey")
def leaf_cost(spark, sf):
    leaves = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route"), F.when(F.col("l_partkey") % 9 > 0, F.log("l_extendedprice")).alias("ln_price"))
    return lookups.route_cost(leaves).select("route", F.round("cost", 2).alias("cost"))


@query(
    "route_audit",
    """WITH s AS (SELECT l_orderkey AS route, l_linenumber % 7 = 0 OR l_suppkey % 11 = 0 AS skip, 10 + l_partkey % 9 AS c, l_partkey % 4 AS n, (5 + l_suppkey % 7) + l_linenumber + CASE WHEN l_suppkey % 3 = 0 THEN 6 ELSE 0 END AS pc, l_suppkey % 3 AS pn FROM lineitem)
SELECT route, count(*) FILTER (NOT skip) AS scored, count(*) FILTER (NOT skip AND (pc < c OR pn < n)) AS violating, count(*) FILTER (skip) AS skipped, count(*) FILTER (NOT skip) > 0 AND count(*) FILTER (NOT skip AND (pc < c OR pn < n)) = 0 AS valid FROM s GROUP BY route""",
)
def route_audit(spark, sf):
    """Steps whose pieces lack atoms of the product, and routes without any."""
    count = lambda **e: F.create_map(*[F.lit(x) if isinstance(x, str) else x for pair in e.items() for x in pair])
    product = F.when(F.col("l_linenumber") % 7 != 0, count(C=10 + F.col("l_partkey") % 9, N=F.col("l_partkey") % 4))
    one = F.when(F.col("l_suppkey") % 11 != 0, count(C=5 + F.col("l_suppkey") % 7 + F.col("l_linenumber"), N=F.col("l_suppkey") % 3))
    two = count(C=F.when(F.col("l_suppkey") % 3 == 0, 6).otherwise(0).cast("long"))
    return lookups.conserved(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route"), product.alias("product"), F.array(one, two).alias("pieces")))


@query(
    "load_arms",
    """WITH e AS (SELECT 'search' AS arm, o_custkey AS target, 0 AS part, o_orderkey AS step, o_orderpriority AS key FROM orders UNION ALL SELECT 'board', o_custkey, 0, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'board', o_custkey, 1, o_orderkey, o_orderpriority FROM orders),
f AS (SELECT arm, target, key, min(row(part, step)) AS first FROM e WHERE target NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY ALL)
SELECT arm, target, row_number() OVER (PARTITION BY arm, target ORDER BY first, key) AS place, key FROM f""",
)
def load_arms(spark, sf):
    """Arms of two layouts as one table: reported routes before pooled ones, step sets once, targets in stock left out."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("target"), F.lit(0).alias("part"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("key"), "o_orderstatus")
    reported, pooled = o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.drop("o_orderstatus").withColumn("part", F.lit(1))
    stock = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("target"))
    return lookups.load_arms({"search": o.drop("o_orderstatus"), "board": reported.unionByName(pooled)}, stock)


def _claimed(spark, sf):
    line = table(spark, sf, "lineitem")
    steps = line.groupBy(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("step")).agg(F.concat(F.lit("m"), F.min("l_partkey").cast("string")).alias("product"), F.array_sort(F.collect_set(F.concat(F.lit("p"), (F.col("l_suppkey") % 6).cast("string")))).alias("pieces"))
    return steps


_CLAIMED = "st AS (SELECT l_orderkey AS route, l_linenumber AS step, 'm' || min(l_partkey) AS product, list(DISTINCT 'p' || l_suppkey % 6 ORDER BY 'p' || l_suppkey % 6) AS pieces FROM lineitem GROUP BY ALL)"


@query("steps_block", f"WITH {_CLAIMED} SELECT route, 'STEPS' || chr(10) || string_agg('  ' || product || ' ←r' || step || '— ' || array_to_string(pieces, ' · '), chr(10) ORDER BY step) AS text FROM st WHERE step % 3 > 0 GROUP BY route")
def steps_block(spark, sf):
    """All steps that the claimed routes use, once, as text."""
    steps = _claimed(spark, sf)
    routes = steps.where("step % 3 > 0").select("route", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("label"), "step")
    return lookups.step_lines(routes, steps, ["route"])


@query("flow_lines", f"WITH {_CLAIMED} SELECT route, string_agg('  ' || array_to_string(pieces, ' + ') || ' →r' || step || ' ' || product, chr(10) ORDER BY step % 4 DESC, step) AS text FROM st GROUP BY route")
def flow_lines(spark, sf):
    """A route written in the direction it is run."""
    return lookups.flow_lines(_claimed(spark, sf).withColumn("depth", F.col("step") % 4))


@query("claimed_merge_points", f"WITH {_CLAIMED}, p AS (SELECT route, step, unnest(pieces) AS molecule FROM st WHERE step % 3 > 0) SELECT route, molecule, count(DISTINCT step) AS n_parents FROM p GROUP BY ALL HAVING count(DISTINCT step) > 1")
def claimed_merge_points(spark, sf):
    """Molecules that several steps of the claimed routes share."""
    steps = _claimed(spark, sf)
    return lookups.merge_points(steps.where("step % 3 > 0").select("route", "step"), steps, ["route"])


@query(
    "id_pools",
    """WITH l AS (SELECT unnest(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')) AS a), s AS (SELECT a FROM l UNION ALL SELECT CAST(unnest(generate_series(0, 9)) AS VARCHAR)), p AS (SELECT l.a || s.a AS id FROM l, s)
SELECT n_nationkey AS seed, row_number() OVER (PARTITION BY n_nationkey ORDER BY md5(n_nationkey || ':' || id), id) AS place, id FROM nation, p QUALIFY place <= 40""",
)
def id_pools(spark, sf):
    """Short ids in an order of each seed's own."""
    return lookups.id_pool(table(spark, sf, "nation").select(F.col("n_nationkey").alias("seed")))


@query("known_keys", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN lower(p_name) ELSE p_name END AS key, p_size % 3 > 0 AND p_size % 2 = 0 AND lower(p_name) = lower(p_name) AS same FROM part")
def known_keys(spark, sf):
    """Keys with the raw string where no canonical form is known; two forms are the same only if both are known."""
    p = table(spark, sf, "part")
    canonical = F.when(F.col("p_size") % 3 > 0, F.lower("p_name"))
    other = F.when(F.col("p_size") % 2 == 0, F.lower("p_name"))
    return p.select("p_partkey", lookups.known_key(canonical, F.col("p_name")).alias("key"), lookups.same(canonical, other).alias("same"))


@query("records_of_targets", "SELECT o_orderkey, o_custkey AS target FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def records_of_targets(spark, sf):
    """Point lookups of a run's records by target."""
    run = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("target"))
    return lookups.records_of(run, table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("target")))


@query("targets_in_order", "SELECT c_custkey AS target, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer")
def targets_in_order(spark, sf):
    """A target list with each line's place: lines are numbered within their file part, and the parts' sizes shift them."""
    path = new_folder(spark, "targets")
    listed = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("value"))
    listed.repartitionByRange(4, F.col("value").cast("long")).sortWithinPartitions(F.col("value").cast("long")).write.text(path)
    lines = spark.read.text(path).select(F.col("value").cast("long").alias("target"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    lines = save(lines, "target_lines")
    # Files are named in order; a file's lines come in the order of their ids.
    within = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    start = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a file
    return lines.withColumn("within", within).join(F.broadcast(start.select("file", "start")), "file").select("target", (F.col("start") + F.col("within")).alias("place"))
