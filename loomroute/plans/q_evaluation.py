"""The evaluation table: budget cut, stock gate, leaf-set dedup, axes, front, representative, imputed summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.operators import pareto, quantiles, routes

from .roles import CUT, MOLECULES, PRICE_CAP, RANK_CUT, STEPS, molecules, sql, steps, table
from .workspace import save

ROUTE_CAP = 200


def route_table(spark: SparkSession, sf: str) -> DataFrame:
    """One row a route: target, arm, made, gold, axes, leaf key and whether all of its products are in stock.

    Stock is joined to the steps first, so the join on the order and the grouping by route share one exchange.
    """
    s = steps(spark, sf)
    held = molecules(spark, sf).where("in_stock").select(F.col("molecule").alias("product"), F.lit(1).alias("held"))
    tagged = s.join(held, "product", "left")
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    return tagged.groupBy("route").agg(
        F.min("target").alias("target"),
        F.min("arm").alias("arm"),
        F.min("made").alias("made"),
        F.max("gold").alias("gold"),
        share(F.col("p") >= CUT).alias("p_share"),
        share(F.col("rt") <= RANK_CUT).alias("rt5_miss"),
        F.sum("price").alias("cost"),
        F.array_join(F.array_sort(F.collect_set(F.col("product").cast("string"))), ".").alias("leaf_key"),
        (F.count("held") == F.count(F.lit(1))).alias("solved"),
    )


def pools(spark: SparkSession, sf: str) -> DataFrame:
    """Solved routes with stamps: the budget at which a route is found is its place among the arm's routes of the target.

    Everything after the stamp is grouped by target and arm at least, so the window's exchange is the last big one.
    """
    w = Window.partitionBy("target", "arm").orderBy("made", "route")
    return route_table(spark, sf).withColumn("stamp", F.row_number().over(w).cast("long")).where("solved")


def scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round(routes.composite("p_share", "rt5_miss", F.col("cost"), PRICE_CAP), 9))


def representatives(pool: DataFrame, group: list[str]) -> DataFrame:
    """The best route of each group: leaf sets once, the first ROUTE_CAP of them scored, front, highest composite, earliest on ties.

    ``n_routes`` counts all leaf sets. Only the scored ones are gathered, so a group's array, in which the front is
    found without a self-join, is bounded.
    """
    row = F.struct("stamp", "route", "p_share", "rt5_miss", "cost", "score")
    once = scored(pool).groupBy(*group, "leaf_key").agg(F.min(row).alias("r"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("r.stamp", "r.route"))
    pooled = once.withColumn("place", place).groupBy(*group).agg(F.count(F.lit(1)).alias("n_routes"), F.array_sort(F.collect_list(F.when(F.col("place") <= ROUTE_CAP, F.col("r")))).alias("pool"))
    axes = lambda x: {"p": x["p_share"], "rt": x["rt5_miss"], "c": -x["cost"]}
    front = F.filter("pool", lambda a: ~F.exists("pool", lambda b: pareto.dominates(axes(b), axes(a), "worst")))
    best = F.array_max(F.transform(front, lambda x: F.struct(x["score"], -x["stamp"], x.alias("r"))))["r"]
    return pooled.select(*group, "n_routes", best.alias("r")).select(*group, "n_routes", "r.route", "r.p_share", "r.rt5_miss", "r.cost", "r.score")


def summary(reps: DataFrame, group: list[str], n_targets, impute) -> DataFrame:
    """Per group over all N targets; unsolved ones count as 0, 0 and the price cap if imputed, else they are left out."""
    reps = save(reps.withColumn("cents", F.round(F.col("cost") * 100).cast("long")), "representatives")
    clipped = F.log(F.greatest(F.least(F.col("cost"), F.lit(PRICE_CAP)), F.lit(1e-9)))
    n, solved = n_targets, F.count(F.lit(1))
    denominator = F.when(impute, n).otherwise(solved)
    missing = F.when(impute, (n - F.count("cost")) * F.log(F.lit(PRICE_CAP))).otherwise(F.lit(0.0))
    logs = F.when(impute, F.sum(clipped)).otherwise(F.sum(F.log("cost")))
    table = reps.groupBy(*group).agg(
        solved.alias("solved"),
        F.round(100.0 * solved / n, 4).alias("success"),
        F.round(F.sum("n_routes") / denominator, 4).alias("routes"),
        F.round(F.sum("p_share") / denominator, 4).alias("plausible"),
        F.round(F.sum("rt5_miss") / denominator, 4).alias("recovered"),
        F.round(F.exp((logs + missing) / denominator), 2).alias("price"),
    )
    middle = quantiles.medians(reps, group, "cents").withColumn("median_price", F.col("median") / 100).drop("median")
    return table.join(middle, group, "left")


_POOL = (
    STEPS,
    MOLECULES,
    "lacking AS (SELECT DISTINCT route FROM steps WHERE product NOT IN (SELECT molecule FROM molecules WHERE in_stock))",
    f"""axes AS (SELECT route, min(target) AS target, min(arm) AS arm, min(made) AS made, bool_or(gold) AS gold, avg(CASE WHEN p >= {CUT} THEN 1.0 ELSE 0.0 END) AS p_share,
       avg(CASE WHEN rt <= {RANK_CUT} THEN 1.0 ELSE 0.0 END) AS rt5, sum(price) AS cost, string_agg(DISTINCT CAST(product AS VARCHAR), '.' ORDER BY CAST(product AS VARCHAR)) AS leaf_key FROM steps GROUP BY route)""",
    "stamped AS (SELECT *, row_number() OVER (PARTITION BY target, arm ORDER BY made, route) AS stamp FROM axes)",
    "pool AS (SELECT * FROM stamped WHERE route NOT IN (SELECT route FROM lacking))",
)


def _reps(group: str, source: str) -> tuple[str, ...]:
    same = " AND ".join(f"a.{g.strip()} = b.{g.strip()}" for g in group.split(","))
    return (
        f"deduped AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY stamp, route) AS k2 FROM (SELECT *, row_number() OVER (PARTITION BY {group}, leaf_key ORDER BY stamp, route) AS k1 FROM {source}) WHERE k1 = 1)",
        f"capped AS (SELECT *, round((p_share + rt5 + 1 - ln(1 + least(greatest(cost, 0), {PRICE_CAP})) / ln(1 + {PRICE_CAP})) / 3, 9) AS score FROM deduped WHERE k2 <= {ROUTE_CAP})",
        f"""front AS (SELECT * FROM capped a WHERE NOT EXISTS (SELECT 1 FROM capped b WHERE {same} AND b.p_share >= a.p_share AND b.rt5 >= a.rt5 AND b.cost <= a.cost
       AND (b.p_share > a.p_share OR b.rt5 > a.rt5 OR b.cost < a.cost)))""",
        f"sized AS (SELECT {group}, count(*) AS n_routes FROM deduped GROUP BY {group})",
        f"reps AS (SELECT f.*, n_routes FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, stamp) AS pick FROM front) f JOIN sized USING ({group}) WHERE pick = 1)",
    )


_IMPUTED = f"""count(*) AS solved, round(100.0 * count(*) / n, 4) AS success, round(sum(n_routes) / CAST(n AS DOUBLE), 4) AS routes,
 round(sum(p_share) / n, 4) AS plausible, round(sum(rt5) / n, 4) AS recovered,
 round(exp((sum(ln(greatest(least(cost, {PRICE_CAP}), 1e-9))) + (n - count(cost)) * ln({PRICE_CAP})) / n), 2) AS price, median(CAST(round(cost * 100) AS BIGINT)) / 100 AS median_price"""
_PLAIN = """count(*) AS solved, round(100.0 * count(*) / n, 4) AS success, round(sum(n_routes) / CAST(count(*) AS DOUBLE), 4) AS routes,
 round(sum(p_share) / count(*), 4) AS plausible, round(sum(rt5) / count(*), 4) AS recovered, round(exp(sum(ln(cost)) / count(*)), 2) AS price, median(CAST(round(cost * 100) AS BIGINT)) / 100 AS median_price"""


@query(
    "main_table_by_arm",
    sql(*_POOL, *_reps("target, arm", "(SELECT * FROM pool WHERE stamp <= 3)"), "nn AS (SELECT count(*) AS n FROM customer)", f"SELECT arm, {_IMPUTED} FROM reps, nn GROUP BY arm, n"),
)
def main_table_by_arm(spark, sf):
    n = F.lit(table(spark, sf, "customer").count())
    reps = representatives(pools(spark, sf).where("stamp <= 3"), ["target", "arm"])
    return summary(reps, ["arm"], n, F.lit(True))


@query(
    "main_table_grid",
    sql(
        *_POOL,
        "grid AS (SELECT * FROM (VALUES (1), (2), (50)) AS g(budget))",
        "budgeted AS (SELECT * FROM pool JOIN grid ON stamp <= budget)",
        *_reps("target, arm, budget", "budgeted"),
        "nn AS (SELECT count(*) AS n FROM customer)",
        f"SELECT arm, CAST(budget AS BIGINT) AS budget, true AS imputed, {_IMPUTED} FROM reps, nn GROUP BY arm, budget, n UNION ALL SELECT arm, CAST(budget AS BIGINT) AS budget, false AS imputed, {_PLAIN} FROM reps, nn GROUP BY arm, budget, n",
    ),
)
def main_table_grid(spark, sf):
    """All cells of budget and imputation as one job: a route is copied to each budget that it was found within."""
    n = F.lit(table(spark, sf, "customer").count())
    budgets = F.filter(F.array(*[F.lit(b).cast("long") for b in (1, 2, 50)]), lambda b: F.col("stamp") <= b)
    reps = representatives(pools(spark, sf).withColumn("budget", F.explode(budgets)), ["target", "arm", "budget"])
    reps = reps.withColumn("imputed", F.explode(F.array(F.lit(True), F.lit(False))))
    return summary(reps, ["arm", "budget", "imputed"], n, F.col("imputed"))


@query(
    "better_than_ref",
    sql(
        *_POOL,
        *_reps("target, arm", "pool"),
        f"gold AS (SELECT target, max(round((p_share + rt5 + 1 - ln(1 + least(greatest(cost, 0), {PRICE_CAP})) / ln(1 + {PRICE_CAP})) / 3, 9)) AS gold_score FROM axes WHERE gold GROUP BY target)",
        "with_gold AS (SELECT count(*) AS n_gold FROM gold)",
        "SELECT arm, n_gold, count(*) FILTER (score > gold_score) AS beaten, round(100.0 * count(*) FILTER (score > gold_score) / n_gold, 4) AS better_than_ref FROM reps JOIN gold USING (target), with_gold GROUP BY arm, n_gold",
    ),
)
def better_than_ref(spark, sf):
    """Share of the targets with a reference route whose representative scores strictly higher than the best reference."""
    gold = scored(route_table(spark, sf).where("gold")).groupBy("target").agg(F.max("score").alias("gold_score"))
    n = F.lit(gold.count()).cast("long")
    reps = representatives(pools(spark, sf), ["target", "arm"]).join(gold, "target")
    beaten = F.count_if(F.col("score") > F.col("gold_score"))
    return reps.groupBy("arm").agg(F.max(n).alias("n_gold"), beaten.alias("beaten"), F.round(100.0 * beaten / F.max(n), 4).alias("better_than_ref"))


_RUNS = "runs AS (SELECT o_custkey AS target, o_orderpriority AS run, o_orderkey AS route, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS found_at FROM orders)"


def _runs(spark, sf):
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_custkey").alias("target"), F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("route"), F.row_number().over(w).cast("long").alias("found_at"))


_SPEND = """spend AS (SELECT o_custkey AS target, o_orderpriority AS run, count(*) + 1.0 AS cost FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2 UNION ALL SELECT c_custkey, '9-NOTHING FOUND', 1.5 FROM customer WHERE c_custkey % 3 = 0)"""


@query(
    "runs_end_to_end",
    sql(
        _RUNS,
        _SPEND,
        "u AS (SELECT target, run FROM runs UNION SELECT target, run FROM spend)",
        "c AS (SELECT u.target, u.run, coalesce(s.cost, (SELECT max(found_at) FROM runs r WHERE r.target = u.target AND r.run = u.run), 0) AS cost, count(*) OVER (PARTITION BY u.target) AS n_runs FROM u LEFT JOIN spend s ON s.target = u.target AND s.run = u.run)",
        "t AS (SELECT * FROM c, (SELECT unnest(generate_series(0, 19)) AS draw) WHERE n_runs > 1 OR draw = 0)",
        "o AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY target, draw ORDER BY md5(target || ':' || run || ':' || draw), run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t)",
        "n AS (SELECT o.target, draw, n_runs, count(*) FILTER (start + found_at <= 6) AS n_routes FROM o LEFT JOIN runs r ON r.target = o.target AND r.run = o.run GROUP BY o.target, draw, n_runs)",
        "k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n_routes, draw) AS place FROM n)",
        "SELECT target, draw, n_routes FROM k WHERE place = CASE WHEN n_runs > 1 THEN 11 ELSE 1 END AND n_routes > 0",
    ),
)
def runs_end_to_end(spark, sf):
    """Independent runs laid end to end on one budget axis in twenty hash orders; the draw of middle size counts."""
    spent = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("target"), F.col("o_orderpriority").alias("run")).agg((F.count(F.lit(1)) + 1.0).alias("cost"))
    idle = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("target"), F.lit("9-NOTHING FOUND").alias("run"), F.lit(1.5).alias("cost"))
    return routes.end_to_end(_runs(spark, sf), spent.unionByName(idle), 6)


@query(
    "spend_table",
    sql(
        "calls AS (SELECT o_orderpriority AS run, o_custkey AS target, max(coalesce(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice / 1000 AS BIGINT) END, CAST(o_orderkey % 100 AS BIGINT))) AS cost FROM orders GROUP BY 1, 2)",
        "ordered AS (SELECT run, cost, row_number() OVER (PARTITION BY run ORDER BY cost) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM calls)",
        "SELECT run, max(n) AS n, max(cost) FILTER (i = n // 2) AS median, max(cost) FILTER (i = CAST(floor(0.9 * n) AS BIGINT)) AS p90, max(cost) AS most, round(avg(cost), 4) AS mean FROM ordered GROUP BY run",
    ),
)
def spend_table(spark, sf):
    """Spend of each run over targets: the larger of the recorded calls, with a fallback; quantiles by index rule."""
    o = table(spark, sf, "orders")
    recorded = F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 1000).cast("long"))
    cost = F.max(F.coalesce(recorded, (F.col("o_orderkey") % 100).cast("long"))).alias("cost")
    calls = o.groupBy(F.col("o_orderpriority").alias("run"), F.col("o_custkey").alias("target")).agg(cost)
    calls = save(calls, "calls")
    at = quantiles.at_positions(calls, ["run"], "cost", {"median": lambda n: F.floor(n / 2), "p90": lambda n: F.floor(0.9 * n)})
    totals = calls.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("cost").alias("most"), F.round(F.avg("cost"), 4).alias("mean"))
    return totals.join(at, "run").select("run", "n", "median", "p90", "most", "mean")


@query(
    "incomplete_run_refusal",
    "SELECT o_orderpriority AS run, count(DISTINCT o_custkey) AS targets, max(n) AS needed, count(DISTINCT o_custkey) >= 0.6 * max(n) AS accepted FROM orders, (SELECT count(*) AS n FROM customer) GROUP BY 1",
)
def incomplete_run_refusal(spark, sf):
    """A run that covers too few of the benchmark's targets is refused."""
    n = table(spark, sf, "customer").count()
    got = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.count_distinct("o_custkey").alias("targets"))
    return got.select("run", "targets", F.lit(n).cast("long").alias("needed"), (F.col("targets") >= 0.6 * n).alias("accepted"))


@query(
    "zip_stamp_cut",
    "SELECT l_orderkey AS route, l_partkey AS item, CAST(l_linenumber AS BIGINT) AS stamp, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2, 3",
)
def zip_stamp_cut(spark, sf):
    """Parallel arrays of items and stamps: zipped by position, cut at the budget; an item without a stamp goes."""
    line = table(spark, sf, "lineitem")
    rows = line.groupBy(F.col("l_orderkey").alias("route")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    rows = rows.select("route", F.transform("a", lambda x: x["l_partkey"]).alias("items"), F.transform("a", lambda x: x["l_linenumber"]).alias("stamps"))
    pairs = rows.select("route", F.explode(F.arrays_zip("items", "stamps")).alias("z")).where(F.col("z.stamps") <= 2)
    return pairs.groupBy("route", F.col("z.items").alias("item"), F.col("z.stamps").cast("long").alias("stamp")).agg(F.count(F.lit(1)).alias("n"))
