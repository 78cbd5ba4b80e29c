"""Diversity and cache queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.functions import keys
from loomroute.operators import caches, diversity, routes

from .q_routes import _keyed
from .roles import MOLECULES, STEPS, molecules, sql, steps, table

_DISC = (STEPS, "disc AS (SELECT arm, target, route, CAST(product % 200 AS VARCHAR) || '>>' || CAST(reactant % 10 AS VARCHAR) AS d, model FROM steps)")


def _disc(spark, sf):
    s = steps(spark, sf)
    return s.select("arm", "target", "route", "model", "p", F.concat((F.col("product") % 200).cast("string"), F.lit(">>"), (F.col("reactant") % 10).cast("string")).alias("d"))


@query(
    "arm_diversity",
    sql(
        *_DISC,
        "pr AS (SELECT arm, count(*) AS per_route FROM (SELECT DISTINCT arm, route, d FROM disc) GROUP BY arm)",
        "pt AS (SELECT arm, count(*) AS per_target, count(DISTINCT target) AS targets FROM (SELECT DISTINCT arm, target, d FROM disc) GROUP BY arm)",
        "ds AS (SELECT arm, count(DISTINCT d) AS distinct_d, count(DISTINCT route) AS n_routes FROM disc GROUP BY arm)",
        "SELECT arm, targets, n_routes, per_route, per_target, distinct_d, round(1 - per_target / CAST(per_route AS DOUBLE), 4) AS overlap, round(1 - distinct_d / CAST(per_target AS DOUBLE), 4) AS reuse FROM pr JOIN pt USING (arm) JOIN ds USING (arm)",
    ),
)
def arm_diversity(spark, sf):
    """Distinct disconnections per route, per target and overall; overlap among routes, reuse among targets."""
    d = _disc(spark, sf)
    r = d.groupBy("arm").agg(
        F.count_distinct("target").alias("targets"), F.count_distinct("route").alias("n_routes"), F.count_distinct("route", "d").alias("per_route"), F.count_distinct("target", "d").alias("per_target"), F.count_distinct("d").alias("distinct_d")
    )
    return r.withColumn("overlap", F.round(1 - F.col("per_target") / F.col("per_route"), 4)).withColumn("reuse", F.round(1 - F.col("distinct_d") / F.col("per_target"), 4))


@query(
    "class_entropy",
    sql(
        STEPS,
        "c AS (SELECT arm, p_type AS kind, count(*) AS n FROM steps JOIN part ON product = p_partkey GROUP BY arm, p_type)",
        "t AS (SELECT arm, sum(n) AS total, count(*) AS classes FROM c GROUP BY arm)",
        "h AS (SELECT c.arm, max(classes) AS classes, sum(-(n / CAST(total AS DOUBLE)) * ln(n / CAST(total AS DOUBLE))) AS h FROM c JOIN t ON c.arm = t.arm GROUP BY c.arm)",
        "SELECT arm, classes, CASE WHEN classes <= 1 THEN 0.0 ELSE round(h / ln(classes), 4) END AS normal_entropy, CASE WHEN classes <= 1 THEN CAST(classes AS DOUBLE) ELSE round(exp(h), 4) END AS effective FROM h",
    ),
)
def class_entropy(spark, sf):
    m = molecules(spark, sf).select("molecule", "kind")
    s = steps(spark, sf)
    c = s.join(m, s["product"] == m["molecule"]).groupBy("arm", "kind").agg(F.count(F.lit(1)).alias("n"))
    return diversity.entropy(c, ["arm"]).select("arm", "classes", F.round("normal_entropy", 4).alias("normal_entropy"), F.round("effective", 4).alias("effective"))


@query(
    "length_bands",
    sql(
        STEPS,
        "l AS (SELECT arm, route, count(*) AS n FROM steps GROUP BY arm, route)",
        "SELECT arm, CASE WHEN n <= 2 THEN '1-2' WHEN n <= 4 THEN '3-4' WHEN n <= 6 THEN '5-6' ELSE '7+' END AS band, count(*) AS n_routes, CAST(sum(n) AS BIGINT) AS n_steps FROM l GROUP BY 1, 2 HAVING count(*) >= 5",
    ),
)
def length_bands(spark, sf):
    n = steps(spark, sf).groupBy("arm", "route").agg(F.count(F.lit(1)).alias("n"))
    band = F.when(F.col("n") <= 2, "1-2").when(F.col("n") <= 4, "3-4").when(F.col("n") <= 6, "5-6").otherwise("7+")
    return n.groupBy("arm", band.alias("band")).agg(F.count(F.lit(1)).alias("n_routes"), F.sum("n").alias("n_steps")).where("n_routes >= 5")


@query(
    "matched_universe",
    sql(
        STEPS,
        "u AS (SELECT target FROM steps GROUP BY target HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM steps))",
        "SELECT arm, count(DISTINCT target) AS targets, count(DISTINCT route) AS n_routes FROM steps WHERE target IN (SELECT target FROM u) GROUP BY arm",
    ),
)
def matched_universe(spark, sf):
    """Only targets that every arm has attempted."""
    s = steps(spark, sf)
    n = s.select("arm").distinct().count()
    both = s.groupBy("target").agg(F.count_distinct("arm").alias("n")).where(F.col("n") == n)
    return s.join(both, "target", "left_semi").groupBy("arm").agg(F.count_distinct("target").alias("targets"), F.count_distinct("route").alias("n_routes"))


@query(
    "top1_share",
    sql(*_DISC, "c AS (SELECT arm, d, count(*) AS n FROM disc GROUP BY arm, d)", "SELECT arm, count(*) AS n_classes, max(n) AS top, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS top_share FROM c GROUP BY arm"),
)
def top1_share(spark, sf):
    c = _disc(spark, sf).groupBy("arm", "d").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("arm").agg(F.count(F.lit(1)).alias("n_classes"), F.max("n").alias("top"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"))


@query(
    "pairwise_jaccard",
    sql(
        STEPS,
        "i AS (SELECT DISTINCT target, route, product % 50 AS item FROM steps)",
        "z AS (SELECT target, route, count(*) AS n FROM i GROUP BY target, route)",
        "x AS (SELECT a.target, a.route AS r1, b.route AS r2, count(*) AS m FROM i a JOIN i b ON a.target = b.target AND a.item = b.item AND a.route < b.route GROUP BY 1, 2, 3)",
        "d AS (SELECT a.target, 1 - coalesce(m, 0) / CAST(a.n + b.n - coalesce(m, 0) AS DOUBLE) AS d FROM z a JOIN z b ON a.target = b.target AND a.route < b.route LEFT JOIN x ON x.target = a.target AND x.r1 = a.route AND x.r2 = b.route)",
        "SELECT target, count(*) AS n_pairs, round(avg(d), 4) AS distance FROM d GROUP BY target",
    ),
)
def pairwise_jaccard(spark, sf):
    """Mean Jaccard distance of leaf sets over the pairs of each target's pool."""
    sets = steps(spark, sf).groupBy("target", "route").agg(F.collect_set(F.col("product") % 50).alias("items"))
    out = diversity.mean_pairwise(sets, "target", "route", keys.jaccard_distance(F.col("a.items"), F.col("b.items")))
    return out.select("target", "n_pairs", F.round("distance", 4).alias("distance"))


def _sign_word(column="embedding"):
    """64 sign bits of a vector as a long."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(F.when(F.element_at(column, i) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


_BITS = "b AS (SELECT vec_id, label, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding] AS bits FROM embeddings)"


@query(
    "pairwise_tanimoto",
    sql(
        STEPS,
        "w AS (SELECT target, route, bit_or(CAST(1 AS BIGINT) << CAST(product % 62 AS INTEGER)) AS w FROM steps GROUP BY target, route)",
        "s AS (SELECT a.target, bit_count(a.w & b.w) / CAST(bit_count(a.w | b.w) AS DOUBLE) AS t FROM w a JOIN w b ON a.target = b.target AND a.route < b.route)",
        "SELECT target, count(*) AS n_pairs, round(avg(t), 4) AS similarity FROM s GROUP BY target",
    ),
)
def pairwise_tanimoto(spark, sf):
    """Mean Tanimoto similarity of route fingerprints (OR of hashed molecule bits) over the pairs of each target's pool."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("product") % 62).cast("int"))
    w = steps(spark, sf).groupBy("target", "route").agg(F.bit_or(bit).alias("w"))
    out = diversity.mean_pairwise(w, "target", "route", keys.tanimoto(F.col("a.w"), F.col("b.w")))
    return out.select("target", "n_pairs", F.round("distance", 4).alias("similarity"))


@query(
    "route_fp_or",
    sql(_BITS, "u AS (SELECT label, i, max(bits[i]) AS bit FROM b, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY label, i)", "SELECT label, CAST(sum(bit) AS BIGINT) AS bits_set FROM u GROUP BY label"),
)
def route_fp_or(spark, sf):
    """Fingerprint of a set: bitwise OR of its members' words."""
    e = table(spark, sf, "embeddings").select("label", _sign_word().alias("w"))
    return e.groupBy("label").agg(F.bit_count(F.bit_or("w")).cast("long").alias("bits_set"))


@query("cluster_routes")
def cluster_routes(spark, sf):
    """Greedy clusters against growing unions; checked against a plain loop in the tests."""
    sets = steps(spark, sf).groupBy("target", "route").agg(F.array_sort(F.collect_set(F.col("product") % 6)).alias("items"))
    return diversity.cluster(sets, "target", "route", "items", 0.5)


@query(
    "diverse_pick",
    sql(
        STEPS,
        "r AS (SELECT target, route, min(p) AS p, count(*) % 3 + 1 AS front, string_agg(DISTINCT CAST(product % 3 AS VARCHAR), '.' ORDER BY CAST(product % 3 AS VARCHAR)) AS leaf FROM steps GROUP BY target, route)",
        "f AS (SELECT *, row_number() OVER (PARTITION BY target, leaf ORDER BY front, p DESC, route) = 1 AS fresh FROM r WHERE front <= 2)",
        "o AS (SELECT target, route, row_number() OVER (PARTITION BY target ORDER BY fresh DESC, front, p DESC, route) AS place FROM f)",
        "SELECT * FROM o WHERE place <= 4",
    ),
)
def diverse_pick(spark, sf):
    leaf = F.array_join(F.array_sort(F.collect_set((F.col("product") % 3).cast("string"))), ".").alias("leaf")
    r = steps(spark, sf).groupBy("target", "route").agg(F.min("p").alias("p"), (F.count(F.lit(1)) % 3 + 1).alias("front"), leaf).withColumn("down", -F.col("p"))
    return diversity.pick_diverse(r, "target", "route", "leaf", ["front", "down", "route"], 4)


_BASE = "base AS (SELECT p_partkey AS key, CASE WHEN p_retailprice <= 1400 THEN p_retailprice END AS value FROM part WHERE p_size <= 33)"
_OVER = "over_ AS (SELECT p_partkey AS key, CASE WHEN p_retailprice <= 1200 THEN p_retailprice * 2 END AS value FROM part WHERE p_size > 25)"
_UNI = "universe AS (SELECT DISTINCT l_partkey AS key FROM lineitem)"


def _base(spark, sf):
    p = table(spark, sf, "part")
    return p.where("p_size <= 33").select(F.col("p_partkey").alias("key"), F.when(F.col("p_retailprice") <= 1400, F.col("p_retailprice")).alias("value"))


def _over(spark, sf):
    p = table(spark, sf, "part")
    return p.where("p_size > 25").select(F.col("p_partkey").alias("key"), F.when(F.col("p_retailprice") <= 1200, F.col("p_retailprice") * 2).alias("value"))


def _universe(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"))


@query("cache_fill_need", sql(_BASE, _UNI, "SELECT key FROM universe WHERE key NOT IN (SELECT key FROM base)"))
def cache_fill_need(spark, sf):
    return caches.need(_universe(spark, sf), _base(spark, sf), "key")


@query("cache_merge", sql(_BASE, _OVER, "SELECT key, value FROM base UNION ALL SELECT key, value FROM over_ WHERE key NOT IN (SELECT key FROM base)"))
def cache_merge(spark, sf):
    """The first writer wins, also with a failure."""
    return caches.merge([_base(spark, sf), _over(spark, sf)], "key")


@query("cache_merge_last", sql(_BASE, _OVER, "SELECT key, value FROM over_ UNION ALL SELECT key, value FROM base WHERE key NOT IN (SELECT key FROM over_)"))
def cache_merge_last(spark, sf):
    return caches.merge([_base(spark, sf), _over(spark, sf)], "key", first_wins=False)


@query("cache_overlay", sql(_BASE, _OVER, "SELECT coalesce(b.key, o.key) AS key, CASE WHEN o.key IS NOT NULL THEN o.value ELSE b.value END AS value FROM base b FULL OUTER JOIN over_ o ON b.key = o.key"))
def cache_overlay(spark, sf):
    return caches.overlay(_base(spark, sf), _over(spark, sf), "key", "value")


@query("coverage_report", sql(_BASE, _UNI, "SELECT count(*) AS wanted, count(b.key) AS cached, count(b.value) AS valued, (SELECT count(*) FROM base) AS cache_size FROM universe u LEFT JOIN base b ON u.key = b.key"))
def coverage_report(spark, sf):
    return caches.coverage(_universe(spark, sf), _base(spark, sf), "key", "value")


@query(
    "three_spelling_lookup",
    sql(
        "r AS (SELECT l_orderkey AS route, l_linenumber AS n, l_partkey AS a, l_partkey + 1 AS b, l_partkey + 2 AS c FROM lineitem)",
        _BASE,
        """SELECT route, CAST(r.n AS BIGINT) AS n, a, CASE WHEN x.key IS NOT NULL THEN x.value WHEN y.key IS NOT NULL THEN y.value WHEN z.key IS NOT NULL THEN z.value END AS value,
 CAST(CASE WHEN x.key IS NOT NULL THEN 0 WHEN y.key IS NOT NULL THEN 1 WHEN z.key IS NOT NULL THEN 2 END AS BIGINT) AS spelling FROM r LEFT JOIN base x ON r.a = x.key LEFT JOIN base y ON r.b = y.key LEFT JOIN base z ON r.c = z.key""",
    ),
)
def three_spelling_lookup(spark, sf):
    line = table(spark, sf, "lineitem")
    r = line.select(F.col("l_orderkey").alias("route"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("a"), (F.col("l_partkey") + 1).alias("b"), (F.col("l_partkey") + 2).alias("c"))
    return caches.lookup_spellings(r, _base(spark, sf), ["a", "b", "c"], "key", "value").select("route", "n", "a", "value", "spelling")


@query(
    "positional_join_check",
    sql(
        STEPS,
        "menu AS (SELECT product, reactant, row_number() OVER (PARTITION BY product ORDER BY reactant) - 1 AS idx FROM (SELECT DISTINCT product, reactant FROM steps))",
        "graph AS (SELECT product, reactant, row_number() OVER (PARTITION BY product ORDER BY n DESC, reactant) AS rank FROM (SELECT product, reactant, count(*) AS n FROM steps GROUP BY 1, 2))",
        "SELECT g.product, count(*) FILTER (g.reactant = m.reactant) AS agrees, count(*) FILTER (g.reactant <> m.reactant) AS differs FROM graph g JOIN menu m ON g.product = m.product AND g.rank - 1 = m.idx GROUP BY g.product",
    ),
)
def positional_join_check(spark, sf):
    """Rank r of a graph against menu index r - 1, verified by comparing what stands there."""
    s = steps(spark, sf)
    n = s.groupBy("product", "reactant").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("product")
    menu = n.select("product", F.col("reactant").alias("other"), F.row_number().over(own.orderBy("reactant")).alias("place"))
    graph = n.select("product", "reactant", F.row_number().over(own.orderBy(F.col("n").desc(), "reactant")).alias("place"))
    j = graph.join(menu, ["product", "place"])
    return j.groupBy("product").agg(F.count_if(F.col("reactant") == F.col("other")).alias("agrees"), F.count_if(F.col("reactant") != F.col("other")).alias("differs"))


@query(
    "candidate_label",
    sql(
        STEPS,
        MOLECULES,
        "menu AS (SELECT DISTINCT product, reactant FROM steps)",
        "tried AS (SELECT product, reactant, bool_or(gold) AS used FROM steps WHERE p >= 0.05 GROUP BY product, reactant)",
        "SELECT product, reactant, CASE WHEN used THEN 'used' WHEN NOT used THEN 'dead' ELSE 'unexpanded' END AS label FROM menu LEFT JOIN tried USING (product, reactant)",
    ),
)
def candidate_label(spark, sf):
    s = steps(spark, sf)
    tried = s.where("p >= 0.05").groupBy("product", "reactant").agg(F.max("gold").alias("used"))
    label = F.when(F.col("used"), "used").when(~F.col("used"), "dead").otherwise("unexpanded")
    return s.select("product", "reactant").distinct().join(tried, ["product", "reactant"], "left").select("product", "reactant", label.alias("label"))


@query("set_hash_pool_first", sql(
    STEPS,
    "k AS (SELECT target, route, string_agg(DISTINCT CAST(product % 4 AS VARCHAR), '.' ORDER BY CAST(product % 4 AS VARCHAR)) AS leaf_key FROM steps GROUP BY target, route)",
    "SELECT target, route, leaf_key FROM (SELECT *, row_number() OVER (PARTITION BY target, leaf_key ORDER BY route) AS n FROM k) WHERE n = 1",
))
def set_hash_pool_first(spark, sf):
    """One route per leaf set, the first in emit order."""
    k = steps(spark, sf).groupBy("target", "route").agg(F.array_join(F.array_sort(F.collect_set((F.col("product") % 4).cast("string"))), ".").alias("leaf_key"))
    return routes.keep_first(k, ["target"], "leaf_key", [F.col("route")])


@query("route_key_overlap", sql(
    STEPS,
    "sk AS (SELECT route, CAST(product AS VARCHAR) || '>>' || CAST(reactant % 5 AS VARCHAR) AS k, min(arm) OVER (PARTITION BY route) AS arm FROM steps)",
    "SELECT arm, count(*) AS n_steps, count(DISTINCT k) AS n_keys FROM sk GROUP BY arm",
))
def route_key_overlap(spark, sf):
    k = _keyed(spark, sf).select("arm", F.explode("k").alias("k"))
    return k.groupBy("arm").agg(F.count(F.lit(1)).alias("n_steps"), F.count_distinct("k").alias("n_keys"))
