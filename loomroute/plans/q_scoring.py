"""Scoring terms and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.functions import keys, scores

from .roles import MOLECULES, STEPS, molecules, sql, steps, table


@query(
    "feasibility_terms",
    sql(
        STEPS,
        "t AS (SELECT route, pos, greatest(coalesce(p, 0.05), 0.05) AS pt, CASE WHEN rt BETWEEN 1 AND 5 THEN (6 - rt) / 5.0 ELSE 0.05 END AS rt_, least(1.0, greatest(0.05, (ln(100000.0) - ln(price)) / (ln(100000.0) - ln(30.0)))) AS ct FROM steps)",
        "SELECT route, pos, round(pt, 4) AS p_term, round(rt_, 4) AS rt_term, round(ct, 4) AS price_term, round(pow(pt * rt_ * ct, 1.0 / 3), 4) AS geometric, round((pt + rt_ + ct) / 3, 4) AS arithmetic FROM t",
    ),
)
def feasibility_terms(spark, sf):
    """Floors, rank map and log price term with their geometric and arithmetic means."""
    t = steps(spark, sf).select("route", "pos", keys.plausibility_term("p").alias("pt"), keys.rank_term("rt").alias("rt_"), keys.price_term("price").alias("ct"))
    return t.select(
        "route", "pos", F.round("pt", 4).alias("p_term"), F.round("rt_", 4).alias("rt_term"), F.round("ct", 4).alias("price_term"), F.round(F.pow(F.col("pt") * F.col("rt_") * F.col("ct"), F.lit(1.0 / 3)), 4).alias("geometric"), F.round((F.col("pt") + F.col("rt_") + F.col("ct")) / 3, 4).alias("arithmetic")
    )


@query(
    "edge_cost_and_reward",
    sql(
        STEPS,
        "f AS (SELECT route, greatest(p, 0.05) AS f, p FROM steps)",
        "SELECT route, round(sum(-ln(least(greatest(p, 1e-10), 0.999)) - 0.5 * ln(f)), 4) AS cost, round(pow(exp(avg(ln(f))), 0.5), 4) AS reward, round(avg(-ln(f)), 4) AS mean_nlf FROM f GROUP BY route",
    ),
)
def edge_cost_and_reward(spark, sf):
    """Search cost of a route's edges and its reward."""
    f = steps(spark, sf).select("route", F.greatest("p", F.lit(0.05)).alias("f"), "p")
    cost = -F.log(F.least(F.greatest("p", F.lit(1e-10)), F.lit(0.999))) - 0.5 * F.log("f")
    return f.groupBy("route").agg(F.round(F.sum(cost), 4).alias("cost"), F.round(F.pow(F.exp(F.avg(F.log("f"))), F.lit(0.5)), 4).alias("reward"), F.round(F.avg(-F.log("f")), 4).alias("mean_nlf"))


_LN = "((p_partkey * 7919) % 1000003) / 1000003.0 * 20 - 4"


@query(
    "price_string",
    f"""WITH v AS (SELECT p_partkey AS molecule, {_LN} AS v, exp({_LN}) AS d FROM part)
SELECT molecule, CASE WHEN v >= 15 THEN '$3.3M+' WHEN d >= 1000000 THEN printf('$%.1fM', d / 1000000) WHEN d >= 10000 THEN printf('$%.0fk', d / 1000) WHEN d >= 1000 THEN printf('$%.1fk', d / 1000)
 WHEN d >= 10 THEN printf('$%.0f', d) WHEN d >= 1 THEN printf('$%.1f', d) ELSE printf('$%.2f', d) END AS shown, replace(printf('$%.3f', least(1.0, greatest(0.0, (v - 2.5) / 9))), '$0.', '$.') AS normalised FROM v""",
)
def price_string(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("molecule"), ((F.col("p_partkey") * 7919) % 1000003 / 1000003.0 * 20 - 4).alias("v"))
    return v.select("molecule", keys.price_string("v").alias("shown"), keys.cost_string("v").alias("normalised"))


@query(
    "complexity_score",
    """WITH f AS (SELECT p_partkey AS molecule, 1 + p_size / 8.0 AS sa, p_partkey % 3 + 1.5 * (p_partkey % 2) + 1.5 * (p_size % 2) AS rings, (p_retailprice % 100) / 100 AS sp3, CASE WHEN p_size > 45 THEN 1.0 ELSE 0.0 END AS macro, length(p_name) % 9 AS stereo FROM part),
r AS (SELECT molecule, least(1.0, greatest(0.0, (sa - 2.5) / 4)) AS a, least(1.0, greatest(0.0, rings / 4.0)) AS b, least(1.0, greatest(0.0, (sp3 - 0.2) / 0.7)) AS c, macro, least(1.0, stereo / 6.0) AS e FROM f),
s AS (SELECT molecule, 100 * (0.45 * a + 0.25 * b + 0.15 * c + 0.10 * macro + 0.05 * e) AS score FROM r)
SELECT molecule, round(score, 4) AS score, CASE WHEN score < 10 THEN 'single_step' WHEN score < 30 THEN 'single_then_escalate' ELSE 'multi_step_search' END AS decision FROM s""",
)
def complexity_score(spark, sf):
    """Weighted ramps and the decision by thresholds; the structural counts are stand-ins on the part table."""
    f = table(spark, sf, "part").select(
        F.col("p_partkey").alias("molecule"),
        (1 + F.col("p_size") / 8.0).alias("sa"),
        (F.col("p_partkey") % 3).alias("fused"),
        (F.col("p_partkey") % 2).alias("bridged"),
        (F.col("p_size") % 2).alias("spiro"),
        (F.col("p_retailprice") % 100 / 100).alias("sp3"),
        (F.col("p_size") > 45).alias("macrocycle"),
        (F.length("p_name") % 9).alias("stereo"),
    )
    s = f.select("molecule", scores.complexity("sa", "fused", "bridged", "spiro", "sp3", "macrocycle", "stereo").alias("s"))
    return s.select("molecule", F.round("s", 4).alias("score"), scores.complexity_decision("s").alias("decision"))


@query(
    "routing_decision",
    sql(
        STEPS,
        MOLECULES,
        "c AS (SELECT target, route, avg(CASE WHEN in_stock THEN 1.0 ELSE 0.0 END) AS frac FROM steps JOIN molecules ON product = molecule GROUP BY target, route)",
        "b AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY frac DESC, route) AS k, count(*) OVER (PARTITION BY target) AS offered FROM c)",
        "SELECT c_custkey AS target, route, round(frac, 4) AS frac, CASE WHEN route IS NULL THEN 'multi_step_search' WHEN frac = 1 THEN 'single_step' WHEN frac > 0 THEN 'single_then_escalate' ELSE 'multi_step_search' END AS decision FROM customer LEFT JOIN (SELECT * FROM b WHERE k = 1) ON target = c_custkey",
    ),
)
def routing_decision(spark, sf):
    """First full hit, else the best partial one, else search."""
    s, m = steps(spark, sf), molecules(spark, sf).select("molecule", "in_stock")
    c = s.join(m, s["product"] == m["molecule"]).groupBy("target", "route").agg(F.avg(F.when(F.col("in_stock"), 1.0).otherwise(0.0)).alias("frac"))
    best = c.groupBy("target").agg(F.max_by(F.struct("route", "frac"), F.struct(F.col("frac"), -F.col("route"))).alias("b")).select("target", "b.*")
    every = table(spark, sf, "customer").select(F.col("c_custkey").alias("target"))
    decision = F.when(F.col("route").isNull(), "multi_step_search").when(F.col("frac") == 1, "single_step").when(F.col("frac") > 0, "single_then_escalate").otherwise("multi_step_search")
    return every.join(best, "target", "left").select("target", "route", F.round("frac", 4).alias("frac"), decision.alias("decision"))


@query(
    "atom_conservation",
    sql(
        STEPS,
        "w AS (SELECT s.route, s.pos, p_type FROM steps s JOIN part ON product = p_partkey)",
        "have AS (SELECT route, pos, p_type, count(*) AS n FROM (SELECT b.route, a.pos, b.p_type FROM w a JOIN w b ON a.route = b.route AND b.pos <= a.pos + 1 AND b.pos <> a.pos) GROUP BY 1, 2, 3)",
        "need AS (SELECT route, pos, p_type, 1 AS n FROM w)",
        "t AS (SELECT need.route, need.pos, coalesce(have.n, 0) >= need.n AS ok FROM need LEFT JOIN have ON have.route = need.route AND have.pos = need.pos AND have.p_type = need.p_type)",
        "SELECT route, count(*) AS scored, count(*) FILTER (NOT ok) AS violating, count(*) FILTER (NOT ok) = 0 AS valid FROM t GROUP BY route",
    ),
)
def atom_conservation(spark, sf):
    """Multiset containment: what a step needs against what the steps up to the next one hold."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("product"), "p_type")
    w = steps(spark, sf).select("route", "pos", "product").join(part, "product")
    kinds = w.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("pos", "p_type"))).alias("all"))
    step = kinds.select("route", "all", F.explode("all").alias("own"))
    n = F.size(F.filter("all", lambda x: (x["pos"] <= F.col("own.pos") + 1) & (x["pos"] != F.col("own.pos")) & (x["p_type"] == F.col("own.p_type"))))
    return step.withColumn("ok", n >= 1).groupBy("route").agg(F.count(F.lit(1)).alias("scored"), F.count_if(~F.col("ok")).alias("violating"), (F.count_if(~F.col("ok")) == 0).alias("valid"))


@query(
    "price_note",
    sql(
        STEPS,
        "m AS (SELECT product, min(price) AS low, max(price) AS high, min_by(price, (p * -1, pos, route)) AS taken, count(*) AS n FROM steps GROUP BY product)",
        "SELECT product, n, low, high, taken, taken <= low AND high >= 3 * low AS cheapest_and_spread FROM m",
    ),
)
def price_note(spark, sf):
    """The taken cut is at its menu's minimum (ties allowed) and the spread is at least threefold."""
    s = steps(spark, sf)
    taken = F.min_by("price", F.struct(-F.col("p"), F.col("pos"), F.col("route")))
    m = s.groupBy("product").agg(F.min("price").alias("low"), F.max("price").alias("high"), taken.alias("taken"), F.count(F.lit(1)).alias("n"))
    return m.select("product", "n", "low", "high", "taken", ((F.col("taken") <= F.col("low")) & (F.col("high") >= 3 * F.col("low"))).alias("cheapest_and_spread"))


@query(
    "worse_than_head",
    sql(
        STEPS,
        "h AS (SELECT route, pos, p, rt, price, first_value(p) OVER w AS hp, first_value(rt) OVER w AS hr, first_value(price) OVER w AS hc FROM steps WINDOW w AS (PARTITION BY route ORDER BY pos))",
        "SELECT route, pos, concat_ws(',', CASE WHEN p < hp THEN 'p' END, CASE WHEN rt > hr THEN 'rt' END, CASE WHEN price > hc THEN 'price' END) AS worse_on FROM h WHERE pos > 1",
    ),
)
def worse_than_head(spark, sf):
    """Axes on which a candidate is worse than its menu's head."""
    w = Window.partitionBy("route").orderBy("pos")
    h = steps(spark, sf).select("route", "pos", "p", "rt", "price", F.first("p").over(w).alias("hp"), F.first("rt").over(w).alias("hr"), F.first("price").over(w).alias("hc"))
    worse = F.concat_ws(",", F.when(F.col("p") < F.col("hp"), "p"), F.when(F.col("rt") > F.col("hr"), "rt"), F.when(F.col("price") > F.col("hc"), "price"))
    return h.where("pos > 1").select("route", "pos", worse.alias("worse_on"))


@query(
    "menu_tail",
    sql(STEPS, "m AS (SELECT product, p, row_number() OVER (PARTITION BY product ORDER BY p DESC, route, pos) - 1 AS idx FROM steps)", "SELECT product, count(*) FILTER (idx >= 3) AS hidden, max(p) FILTER (idx >= 3) AS best_hidden FROM m GROUP BY product"),
)
def menu_tail(spark, sf):
    """How many candidates lie behind the fold, and the best of them."""
    w = Window.partitionBy("product").orderBy(F.col("p").desc(), "route", "pos")
    m = steps(spark, sf).withColumn("idx", F.row_number().over(w) - 1)
    return m.groupBy("product").agg(F.count_if(F.col("idx") >= 3).alias("hidden"), F.max(F.when(F.col("idx") >= 3, F.col("p"))).alias("best_hidden"))
