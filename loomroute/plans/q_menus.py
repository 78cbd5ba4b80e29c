"""Menus, universes, permutations and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomroute.catalog import query

from .roles import STEPS, sql, steps, table


@query("score_universe", sql(STEPS, "m AS (SELECT product AS x FROM steps UNION SELECT reactant FROM steps), r AS (SELECT DISTINCT product, reactant FROM steps)", "SELECT (SELECT count(*) FROM m) AS molecules, (SELECT count(*) FROM r) AS reactions"))
def score_universe(spark, sf):
    """Distinct molecules and reactions to be scored."""
    s = steps(spark, sf)
    m = s.select(F.explode(F.array(F.col("product").cast("long"), F.col("reactant").cast("long"))).alias("x"))
    counts = s.agg(F.count_distinct("product", "reactant").alias("reactions"))
    return m.agg(F.count_distinct("x").alias("molecules")).join(F.broadcast(counts)).select("molecules", "reactions")  # one row each


@query(
    "match_candidate",
    sql(
        STEPS,
        "sets AS (SELECT target, route, string_agg(DISTINCT CAST(product % 8 AS VARCHAR), '.' ORDER BY CAST(product % 8 AS VARCHAR)) AS k FROM steps GROUP BY target, route)",
        "menu AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY route) - 1 AS idx FROM sets)",
        "SELECT a.target, a.route, min(b.idx) AS first_idx FROM sets a JOIN menu b ON a.target = b.target AND a.k = b.k GROUP BY a.target, a.route",
    ),
)
def match_candidate(spark, sf):
    """First menu index whose sorted reactants equal the wanted ones: an equi-join on the sorted set."""
    k = F.array_join(F.array_sort(F.collect_set((F.col("product") % 8).cast("string"))), ".")
    sets = steps(spark, sf).groupBy("target", "route").agg(k.alias("k"))
    idx = (F.row_number().over(Window.partitionBy("target").orderBy("route")) - 1).cast("long")
    first = sets.withColumn("idx", idx).groupBy("target", "k").agg(F.min("idx").alias("first_idx"))
    return sets.join(first, ["target", "k"]).select("target", "route", "first_idx")


@query(
    "permuted_menu",
    sql(
        STEPS,
        "menu AS (SELECT product, reactant, row_number() OVER (PARTITION BY product ORDER BY reactant) - 1 AS old_idx FROM (SELECT DISTINCT product, reactant FROM steps))",
        "w AS (SELECT *, CASE WHEN old_idx < 5 THEN row_number() OVER (PARTITION BY product, old_idx < 5 ORDER BY md5('3:' || product || ':' || old_idx)) - 1 ELSE old_idx END AS new_idx FROM menu)",
        "SELECT product, reactant, old_idx, new_idx FROM w",
    ),
)
def permuted_menu(spark, sf):
    """The same menus under a new numbering: the first five entries in hash order, the tail as it was."""
    menu = steps(spark, sf).select("product", "reactant").distinct()
    menu = menu.withColumn("old_idx", (F.row_number().over(Window.partitionBy("product").orderBy("reactant")) - 1).cast("long")).withColumn("head", F.col("old_idx") < 5)
    h = F.md5(F.concat_ws(":", F.lit("3"), F.col("product").cast("string"), F.col("old_idx").cast("string")))
    new = (F.row_number().over(Window.partitionBy("product", "head").orderBy(h)) - 1).cast("long")
    return menu.select("product", "reactant", "old_idx", F.when(F.col("head"), new).otherwise(F.col("old_idx")).alias("new_idx"))


@query(
    "divergence",
    sql(STEPS, "m AS (SELECT route, pos, product FROM steps WHERE p < 0.05)", "SELECT route, arg_min(product, pos) AS molecule, min(pos) AS depth FROM m GROUP BY route"),
)
def divergence(spark, sf):
    """The shallowest molecule whose wanted step is not applied."""
    return steps(spark, sf).where("p < 0.05").groupBy("route").agg(F.min_by("product", "pos").alias("molecule"), F.min("pos").alias("depth"))


@query(
    "feas_rank",
    sql(
        STEPS,
        "a AS (SELECT target, route, avg(p) AS a, CASE WHEN max(rt) < 7 THEN -max(rt) END AS b, -sum(price) AS c FROM steps GROUP BY target, route)",
        "v AS (SELECT target, route, a, coalesce(b, min(b) OVER (PARTITION BY target) - 1, 0) AS b, c FROM a)",
        """r AS (SELECT target, route, rank() OVER (PARTITION BY target ORDER BY round(a, 9)) + (count(*) OVER (PARTITION BY target, round(a, 9)) - 1) / 2.0 + rank() OVER (PARTITION BY target ORDER BY b) + (count(*) OVER (PARTITION BY target, b) - 1) / 2.0
 + rank() OVER (PARTITION BY target ORDER BY round(c, 2)) + (count(*) OVER (PARTITION BY target, round(c, 2)) - 1) / 2.0 AS s FROM v)""",
        "SELECT target, route, row_number() OVER (PARTITION BY target ORDER BY s DESC, route) AS place FROM r",
    ),
)
def feas_rank(spark, sf):
    """Routes by the mean of three percentile ranks; a missing value ranks below the worst."""
    g = steps(spark, sf).groupBy("target", "route").agg(F.round(F.avg("p"), 9).alias("a"), F.max("rt").alias("m"), F.round(-F.sum("price"), 2).alias("c"))
    own = Window.partitionBy("target")
    g = g.withColumn("b", F.when(F.col("m") < 7, -F.col("m")))
    g = g.withColumn("b", F.coalesce("b", F.min("b").over(own) - 1, F.lit(0)))
    total = F.lit(0.0)
    for c in ("a", "b", "c"):
        total = total + F.rank().over(own.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("target", c)) - 1) / 2.0
    g = g.withColumn("s", total)
    return g.select("target", "route", F.row_number().over(own.orderBy(F.col("s").desc(), "route")).cast("long").alias("place"))


@query(
    "model_health",
    "WITH cfg(model, enabled) AS (VALUES ('R', true), ('N', true), ('A', true), ('X', true), ('Y', false)) SELECT c.model, count(l_orderkey) AS answers, count(l_orderkey) > 0 AS ok, CASE WHEN count(l_orderkey) = 0 THEN 'no_answer' END AS error FROM cfg c LEFT JOIN lineitem ON l_returnflag = c.model WHERE enabled GROUP BY c.model",
)
def model_health(spark, sf):
    """One status row for each enabled model; a silent model is a typed error, not a failure."""
    cfg = spark.createDataFrame([("R", True), ("N", True), ("A", True), ("X", True), ("Y", False)], "model string, enabled boolean").where("enabled")
    n = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    answers = F.coalesce("n", F.lit(0).cast("long"))
    return cfg.join(n, "model", "left").select("model", answers.alias("answers"), (answers > 0).alias("ok"), F.when(answers == 0, "no_answer").alias("error"))


@query(
    "templates_by_name",
    "WITH b AS (SELECT p_brand AS name, p_type AS template, count(*) AS occurrence, max(length(p_name)) AS specificity FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY occurrence DESC, specificity DESC, template) AS k FROM b), t AS (SELECT *, row_number() OVER (ORDER BY occurrence DESC, specificity DESC, name) AS place FROM r WHERE k = 1) SELECT name, template, occurrence, place FROM t WHERE place <= 10",
)
def templates_by_name(spark, sf):
    """The best entry of each name, then the top ten: the limit is the feature."""
    b = table(spark, sf, "part").groupBy(F.col("p_brand").alias("name"), F.col("p_type").alias("template")).agg(F.count(F.lit(1)).alias("occurrence"), F.max(F.length("p_name")).alias("specificity"))
    best = b.groupBy("name").agg(F.min_by(F.struct("template", "occurrence", "specificity"), F.struct(-F.col("occurrence"), -F.col("specificity"), "template")).alias("t")).select("name", "t.*")
    top = best.orderBy(F.col("occurrence").desc(), F.col("specificity").desc(), "name").limit(10)
    place = F.row_number().over(Window.orderBy(F.col("occurrence").desc(), F.col("specificity").desc(), "name")).cast("long")  # ten rows
    return top.withColumn("place", place).select("name", "template", "occurrence", "place")


@query(
    "routes_capped",
    sql(STEPS, "r AS (SELECT target, route, sum(price) AS cost FROM steps GROUP BY target, route), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(cost, 2), route) AS n, count(*) OVER (PARTITION BY target) AS every FROM r)", "SELECT target, count(*) AS extracted, max(every) > 5 AS truncated FROM k WHERE n <= 5 GROUP BY target"),
)
def routes_capped(spark, sf):
    """Cost-ordered extraction up to the cap, one more asked for to tell capped from ended."""
    r = steps(spark, sf).groupBy("target", "route").agg(F.round(F.sum("price"), 2).alias("cost"))
    k = r.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("cost", "route"))).where("n <= 6")
    return k.groupBy("target").agg(F.count_if(F.col("n") <= 5).alias("extracted"), (F.max("n") > 5).alias("truncated"))


@query(
    "live_against_cache",
    sql(
        STEPS,
        "live AS (SELECT product, min(CASE WHEN model = 'R' THEN reactant END) AS a FROM steps GROUP BY product), cached AS (SELECT product, min(CASE WHEN model <> 'N' THEN reactant END) AS b FROM steps GROUP BY product)",
        "SELECT count(*) AS asked, count(*) FILTER (a IS NOT DISTINCT FROM b) AS agree, count(*) FILTER (a IS DISTINCT FROM b) AS differ FROM live JOIN cached USING (product)",
    ),
)
def live_against_cache(spark, sf):
    """Null-safe agreement of live answers with cached ones."""
    s = steps(spark, sf)
    g = s.groupBy("product").agg(F.min(F.when(F.col("model") == "R", F.col("reactant"))).alias("a"), F.min(F.when(F.col("model") != "N", F.col("reactant"))).alias("b"))
    same = F.col("a").eqNullSafe(F.col("b"))
    return g.agg(F.count(F.lit(1)).alias("asked"), F.count_if(same).alias("agree"), F.count_if(~same).alias("differ"))


@query(
    "first_turn_of_reaction",
    sql(STEPS, "SELECT target, product, reactant, min(route) AS first_route, arg_min(model, (route, pos)) AS family, count(*) AS n FROM steps GROUP BY target, product, reactant"),
)
def first_turn_of_reaction(spark, sf):
    """Steps already applied, with the family of the turn that showed them first."""
    return steps(spark, sf).groupBy("target", "product", "reactant").agg(F.min("route").alias("first_route"), F.min_by("model", F.struct("route", "pos")).alias("family"), F.count(F.lit(1)).alias("n"))


@query(
    "merge_points",
    sql(STEPS, "e AS (SELECT DISTINCT target, route, product FROM steps)", "SELECT target, product, count(*) AS used_by FROM e GROUP BY target, product HAVING count(*) > 1"),
)
def merge_points(spark, sf):
    """Molecules that several routes of a target share."""
    return steps(spark, sf).groupBy("target", "product").agg(F.count_distinct("route").alias("used_by")).where("used_by > 1")


@query(
    "axis_anchors",
    sql(STEPS, "SELECT arm, count(*) AS n, round(avg(CASE WHEN p >= 0.05 THEN 1.0 ELSE 0.0 END), 4) AS above_cut, round(avg(p), 4) AS mean_p, round(avg(CASE WHEN rt BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END), 4) AS recovered, count(*) FILTER (price > 50000) AS clipped FROM steps GROUP BY arm"),
)
def axis_anchors(spark, sf):
    """Distribution report of the score caches."""
    s = steps(spark, sf)
    return s.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("p") >= 0.05, 1.0).otherwise(0.0)), 4).alias("above_cut"), F.round(F.avg("p"), 4).alias("mean_p"), F.round(F.avg(F.when(F.col("rt").between(1, 5), 1.0).otherwise(0.0)), 4).alias("recovered"), F.count_if(F.col("price") > 50000).alias("clipped")
    )
