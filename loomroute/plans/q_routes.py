"""Routes: identity, pooling, axes, presence flags, label summaries, fronts and ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.functions import keys
from loomroute.operators import pareto, routes

from .roles import CUT, MOLECULES, PRICE_CAP, RANK_CUT, STEPS, molecules, sql, steps, table


@query(
    "rxn_key_variants",
    sql(
        STEPS,
        """k AS (SELECT route, product, string_agg(CAST(reactant AS VARCHAR), '.' ORDER BY pos) AS given, string_agg(CAST(reactant AS VARCHAR), '.' ORDER BY CAST(reactant AS VARCHAR)) AS sorted,
       string_agg(DISTINCT CAST(reactant AS VARCHAR), '.' ORDER BY CAST(reactant AS VARCHAR)) AS stored FROM (SELECT route, product % 20 AS product, reactant, pos FROM steps) GROUP BY route, product)""",
        "SELECT route, CAST(product AS VARCHAR) || '>>' || given AS given_key, CAST(product AS VARCHAR) || '>>' || sorted AS sorted_key, CAST(product AS VARCHAR) || '>>' || stored AS stored_key FROM k",
    ),
)
def rxn_key_variants(spark, sf):
    """The three spellings of a step's key: as given, sorted, sorted and distinct."""
    s = steps(spark, sf).withColumn("product", F.col("product") % 20)
    g = s.groupBy("route", "product").agg(F.array_sort(F.collect_list(F.struct("pos", "reactant"))).alias("r"))
    g = g.withColumn("r", F.transform("r", lambda x: x["reactant"]))
    return g.select("route", keys.given_key("product", "r").alias("given_key"), keys.step_key("product", "r", distinct=False).alias("sorted_key"), keys.step_key("product", "r").alias("stored_key"))


_KEYS = (
    STEPS,
    "sk AS (SELECT target, route, pos, model, arm, made, CAST(product AS VARCHAR) || '>>' || CAST(reactant % 5 AS VARCHAR) AS k FROM (SELECT *, 0 AS z FROM steps))",
    "idk AS (SELECT route, min(target) AS target, min(arm) AS arm, sha256(string_agg(k, '|' ORDER BY pos)) AS seq_key, sha256(string_agg(DISTINCT k, '|' ORDER BY k)) AS set_key FROM sk GROUP BY route)",
)


def _keyed(spark, sf):
    s = steps(spark, sf).withColumn("k", F.concat(F.col("product").cast("string"), F.lit(">>"), (F.col("reactant") % 5).cast("string")))
    g = s.groupBy("route").agg(F.min("target").alias("target"), F.min("arm").alias("arm"), F.array_sort(F.collect_list(F.struct("pos", "k"))).alias("a"))
    g = g.withColumn("k", F.transform("a", lambda x: x["k"])).drop("a")
    return g.withColumn("seq_key", keys.seq_key("k")).withColumn("set_key", keys.set_key("k"))


def _pooled_sql(key: str) -> str:
    return sql(
        *_KEYS,
        "inst AS (SELECT *, route AS rank, arm AS source FROM idk)",
        f"SELECT target, {key} AS key, min(rank) AS first_rank, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n_instances FROM inst GROUP BY target, {key}",
    )


def _pooled(spark, sf, key):
    inst = _keyed(spark, sf).select("target", key, F.col("route").alias("rank"), F.col("arm").alias("source"))
    return routes.pool(inst, key).select("target", F.col(key).alias("key"), "first_rank", F.array_join("sources", ",").alias("sources"), "n_instances")


@query("pool_dedup_seq", _pooled_sql("seq_key"))
def pool_dedup_seq(spark, sf):
    return _pooled(spark, sf, "seq_key")


@query("pool_dedup_set", _pooled_sql("set_key"))
def pool_dedup_set(spark, sf):
    return _pooled(spark, sf, "set_key")


@query(
    "seq_set_inflation",
    sql(*_KEYS, "SELECT arm, count(*) AS instances, count(DISTINCT seq_key) AS seqs, count(DISTINCT set_key) AS sets, round(count(DISTINCT seq_key) / CAST(count(DISTINCT set_key) AS DOUBLE), 4) AS inflation FROM idk GROUP BY arm"),
)
def seq_set_inflation(spark, sf):
    """Distinct ordered keys over distinct order-blind keys."""
    return _keyed(spark, sf).groupBy("arm").agg(
        F.count(F.lit(1)).alias("instances"), F.count_distinct("seq_key").alias("seqs"), F.count_distinct("set_key").alias("sets"), F.round(F.count_distinct("seq_key") / F.count_distinct("set_key"), 4).alias("inflation")
    )


@query(
    "source_uniqueness",
    sql(STEPS, "m AS (SELECT product, reactant, count(DISTINCT model) AS n, min(model) AS model FROM steps GROUP BY product, reactant)", "SELECT model, count(*) AS only_here FROM m WHERE n = 1 GROUP BY model"),
)
def source_uniqueness(spark, sf):
    """Disconnections that one model alone has found."""
    m = steps(spark, sf).groupBy("product", "reactant").agg(F.count_distinct("model").alias("n"), F.min("model").alias("model"))
    return m.where("n = 1").groupBy("model").agg(F.count(F.lit(1)).alias("only_here"))


@query(
    "gold_prefix",
    sql(
        STEPS,
        "items AS (SELECT DISTINCT target, route, gold, product % 40 AS item FROM steps)",
        "sizes AS (SELECT target, route, count(*) AS n FROM items WHERE gold GROUP BY target, route)",
        "pairs AS (SELECT a.target, a.route, g.route AS gold_route FROM (SELECT DISTINCT target, route FROM items) a JOIN sizes g ON a.target = g.target)",
        "shared AS (SELECT a.target, a.route, b.route AS gold_route, count(*) AS m FROM items a JOIN items b ON a.target = b.target AND a.item = b.item AND b.gold GROUP BY 1, 2, 3)",
        "SELECT p.target, p.route, round(max(coalesce(m, 0) / CAST(n AS DOUBLE)), 4) AS gold_prefix FROM pairs p JOIN sizes s ON p.target = s.target AND p.gold_route = s.route LEFT JOIN shared x ON x.target = p.target AND x.route = p.route AND x.gold_route = p.gold_route GROUP BY p.target, p.route",
    ),
)
def gold_prefix(spark, sf):
    s = steps(spark, sf).withColumn("item", F.col("product") % 40)
    sets = s.groupBy("target", "route").agg(F.collect_set("item").alias("keys"), F.max("gold").alias("gold"))
    return routes.gold_prefix(sets, sets.where("gold")).select("target", "route", F.round("gold_prefix", 4).alias("gold_prefix"))


_NULLED = "nulled AS (SELECT route, pos, CASE WHEN product % 17 <> 0 THEN p END AS p, CASE WHEN product % 13 <> 0 THEN rt END AS rt, CASE WHEN product % 11 <> 0 THEN price END AS price FROM steps)"


def _nulled(spark, sf):
    return steps(spark, sf).select(
        "route", "pos", F.when(F.col("product") % 17 != 0, F.col("p")).alias("p"), F.when(F.col("product") % 13 != 0, F.col("rt")).alias("rt"), F.when(F.col("product") % 11 != 0, F.col("price")).alias("price")
    )


def _axes_sql(source: str) -> str:
    def whole(c, value):
        return f"CASE WHEN count({c}) = count(*) THEN {value} END"

    return f"""axes AS (SELECT route, count(*) AS n_steps, {whole('p', f'avg(CASE WHEN p >= {CUT} THEN 1.0 ELSE 0.0 END)')} AS p_share, {whole('p', 'min(p)')} AS p_min, {whole('p', 'median(p)')} AS p_median,
  {whole('p', f'bool_and(p >= {CUT})')} AS p_all, {whole('rt', 'avg(CASE WHEN rt <= 1 THEN 1.0 ELSE 0.0 END)')} AS rt1, {whole('rt', f'avg(CASE WHEN rt <= {RANK_CUT} THEN 1.0 ELSE 0.0 END)')} AS rt5,
  avg(CASE WHEN rt <= {RANK_CUT} THEN 1.0 ELSE 0.0 END) AS rt5_miss, {whole('price', 'sum(price)')} AS cost, sum(price) AS cost_known, count(*) FILTER (price IS NULL) AS n_unpriced FROM {source} GROUP BY route)"""


_AXES_OUT = "SELECT route, n_steps, round(p_share, 4) AS p_share, p_min, round(p_median, 4) AS p_median, p_all, round(rt1, 4) AS rt1, round(rt5, 4) AS rt5, round(rt5_miss, 4) AS rt5_miss, round(cost, 2) AS cost, round(cost_known, 2) AS cost_known, n_unpriced FROM axes"


def _axes_out(df):
    r = lambda c, n=4: F.round(c, n).alias(c)
    return df.select("route", "n_steps", r("p_share"), "p_min", r("p_median"), "p_all", r("rt1"), r("rt5"), r("rt5_miss"), r("cost", 2), r("cost_known", 2), "n_unpriced")


@query("route_axes", sql(STEPS, _axes_sql("steps"), _AXES_OUT))
def route_axes(spark, sf):
    return _axes_out(routes.axes(steps(spark, sf), CUT, RANK_CUT))


@query("route_axes_nulls", sql(STEPS, _NULLED, _axes_sql("nulled"), _AXES_OUT))
def route_axes_nulls(spark, sf):
    """The same with missing values: null where any step lacks one, or counted as failures."""
    return _axes_out(routes.axes(_nulled(spark, sf), CUT, RANK_CUT))


@query(
    "step_tags",
    sql(
        STEPS,
        "cache AS (SELECT product, reactant, true AS present, CASE WHEN min(rt) <= 5 THEN min(rt) END AS rank FROM steps WHERE model <> 'N' GROUP BY product, reactant)",
        "SELECT s.route, s.pos, s.product, s.reactant, coalesce(present, false) AS asked, rank, CASE WHEN present IS NULL THEN 'rt?' WHEN rank IS NULL THEN 'rt-' ELSE 'rt' || rank END AS shown FROM steps s LEFT JOIN cache c ON s.product = c.product AND s.reactant = c.reactant",
    ),
)
def step_tags(spark, sf):
    """Steps with cached values; never asked, asked without success and a value stay apart."""
    s = steps(spark, sf)
    least = F.min("rt")
    cache = s.where("model <> 'N'").groupBy("product", "reactant").agg(F.lit(True).alias("present"), F.when(least <= 5, least).alias("rank"))
    out = s.join(cache, ["product", "reactant"], "left").withColumn("asked", F.coalesce("present", F.lit(False)))
    return out.select("route", "pos", "product", "reactant", "asked", "rank", keys.recovered("rank", F.col("asked")).alias("shown"))


@query(
    "leaf_tags",
    sql(STEPS, MOLECULES, "lv AS (SELECT DISTINCT route, product AS leaf FROM steps)", "SELECT route, leaf, in_stock, price, CAST(size AS BIGINT) AS size FROM lv LEFT JOIN molecules ON leaf = molecule"),
)
def leaf_tags(spark, sf):
    leaf = steps(spark, sf).select("route", F.col("product").alias("leaf")).distinct()
    m = molecules(spark, sf)
    return leaf.join(m, leaf["leaf"] == m["molecule"], "left").select("route", "leaf", "in_stock", "price", F.col("size").cast("long").alias("size"))


@query(
    "label_summary_sets",
    sql(
        STEPS,
        "src AS (SELECT DISTINCT route, model, arm FROM steps)",
        "ax AS (SELECT route, avg(p) AS p FROM steps GROUP BY route)",
        "SELECT model, arm, CAST(grouping(model) * 2 + grouping(arm) AS BIGINT) AS level, count(*) AS n, round(avg(p), 4) AS p FROM src JOIN ax USING (route) GROUP BY GROUPING SETS ((), (model), (arm))",
    ),
)
def label_summary_sets(spark, sf):
    """One pass for all group kinds; a route with two models belongs to both."""
    s = steps(spark, sf)
    j = s.select("route", "model", "arm").distinct().join(s.groupBy("route").agg(F.avg("p").alias("p")), "route")
    return j.groupingSets([[], ["model"], ["arm"]], "model", "arm").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 4).alias("p")).select("model", "arm", "level", "n", "p")


_VEC = (STEPS, _NULLED, "vec AS (SELECT n.route, any_value(s.target) AS target, min(n.p) AS a, max(n.rt) AS b, sum(n.price) AS c FROM nulled n JOIN steps s ON n.route = s.route AND n.pos = s.pos GROUP BY n.route QUALIFY row_number() OVER (PARTITION BY any_value(s.target) ORDER BY n.route) <= 500)")
_GROUP_AXES = {"a": "max", "b": "min", "c": "min"}


def _vectors(spark, sf):
    s = steps(spark, sf)
    n = _nulled(spark, sf).groupBy("route").agg(F.min("p").alias("a"), F.max("rt").alias("b"), F.sum("price").alias("c"))
    return routes.extracted(n.join(s.groupBy("route").agg(F.min("target").alias("target")), "route"), ["target"], ["route"])


_SHARED = """coalesce(y.a >= x.a - 1e-9, true) AND coalesce(y.b <= x.b + 1e-9, true) AND coalesce(y.c <= x.c + 1e-9, true)
 AND (coalesce(y.a > x.a + 1e-9, false) OR coalesce(y.b < x.b - 1e-9, false) OR coalesce(y.c < x.c - 1e-9, false))"""


def _front_sql(null_rule: str) -> str:
    if null_rule == "exclude":
        src, ge = "(SELECT * FROM vec WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)", "y.a >= x.a AND y.b <= x.b AND y.c <= x.c AND (y.a > x.a OR y.b < x.b OR y.c < x.c)"
    elif null_rule == "worst":
        src = "(SELECT route, target, a, b, c, coalesce(a, -1e18) AS u, coalesce(-b, -1e18) AS v, coalesce(-c, -1e18) AS w FROM vec)"
        ge = "y.u >= x.u AND y.v >= x.v AND y.w >= x.w AND (y.u > x.u OR y.v > x.v OR y.w > x.w)"
    else:
        src = "vec"
        ge = _SHARED
    return sql(*_VEC, f"src AS (SELECT * FROM {src})", f"SELECT route, target FROM src x WHERE NOT EXISTS (SELECT 1 FROM src y WHERE y.target = x.target AND {ge})")


@query("pareto_front", _front_sql("exclude"))
def pareto_front(spark, sf):
    return pareto.front(_vectors(spark, sf), ["target"], _GROUP_AXES, "exclude").select("route", "target")


@query("pareto_front_null_worst", _front_sql("worst"))
def pareto_front_null_worst(spark, sf):
    return pareto.front(_vectors(spark, sf), ["target"], _GROUP_AXES, "worst").select("route", "target")


@query("pareto_front_shared_axes", _front_sql("shared"))
def pareto_front_shared_axes(spark, sf):
    return pareto.front(_vectors(spark, sf), ["target"], _GROUP_AXES, "shared").select("route", "target")


@query(
    "pareto_ranks",
    "WITH RECURSIVE "
    + ",\n".join(_VEC)
    + """,
ok AS (SELECT target, route, a, b, c FROM vec WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
dom AS (SELECT x.route AS beaten, y.route AS by FROM ok x JOIN ok y ON y.target = x.target AND y.a >= x.a AND y.b <= x.b AND y.c <= x.c AND (y.a > x.a OR y.b < x.b OR y.c < x.c)),
chain(route, level) AS (SELECT route, 1 FROM ok UNION SELECT dom.beaten, chain.level + 1 FROM chain JOIN dom ON dom.by = chain.route)
SELECT v.target, v.route, CAST(max(level) AS BIGINT) AS front FROM vec v LEFT JOIN chain USING (route) GROUP BY v.target, v.route""",
)
def pareto_ranks(spark, sf):
    """Fronts by peeling; the front of a row is the longest chain of rows that dominate it, plus one."""
    return pareto.ranks(_vectors(spark, sf).select("target", "route", "a", "b", "c"), ["target"], "route", _GROUP_AXES).select("target", "route", "front")


@query(
    "dominated_by",
    sql(
        *_VEC,
        f"SELECT x.target, x.route, string_agg(CAST(y.route AS VARCHAR), ',' ORDER BY y.route) AS by_routes, count(*) AS n_by FROM vec x JOIN vec y ON y.target = x.target AND {_SHARED} GROUP BY x.target, x.route",
    ),
)
def dominated_by(spark, sf):
    out = pareto.dominators(_vectors(spark, sf), ["target"], "route", _GROUP_AXES, "shared")
    return out.select("target", "route", F.array_join(F.transform("by", lambda x: x.cast("string")), ",").alias("by_routes"), "n_by")


@query(
    "percentile_composite",
    sql(
        STEPS,
        """r AS (SELECT route, pos, (rank() OVER (PARTITION BY route ORDER BY p) + (count(*) OVER (PARTITION BY route, p) - 1) / 2.0 - 1) AS rp,
  (rank() OVER (PARTITION BY route ORDER BY rt DESC) + (count(*) OVER (PARTITION BY route, rt) - 1) / 2.0 - 1) AS rr,
  (rank() OVER (PARTITION BY route ORDER BY price DESC) + (count(*) OVER (PARTITION BY route, price) - 1) / 2.0 - 1) AS rc, count(*) OVER (PARTITION BY route) AS n FROM steps)""",
        "c AS (SELECT route, pos, n, CASE WHEN n = 1 THEN 1.0 ELSE (rp + rr + rc) / 3.0 / (n - 1) END AS pct FROM r)",
        "SELECT route, pos, round(pct, 4) AS pct, round(greatest(pct, 1.0 / (2 * greatest(n - 1, 1))), 4) AS floored FROM c",
    ),
)
def percentile_composite(spark, sf):
    """Mean of average-rank percentiles over three axes within each menu, and the same with a floor."""
    own = Window.partitionBy("route")

    def average_rank(column, order):
        return F.rank().over(own.orderBy(order)).cast("double") + (F.count(F.lit(1)).over(Window.partitionBy("route", column)) - 1) / 2.0 - 1

    s = steps(spark, sf).withColumn("n", F.count(F.lit(1)).over(own))
    total = average_rank("p", F.col("p")) + average_rank("rt", F.col("rt").desc()) + average_rank("price", F.col("price").desc())
    pct = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(total / 3.0 / (F.col("n") - 1))
    s = s.withColumn("pct", pct)
    return s.select("route", "pos", F.round("pct", 4).alias("pct"), F.round(F.greatest("pct", 1.0 / (2 * F.greatest(F.col("n") - 1, F.lit(1)))), 4).alias("floored"))


@query(
    "tie_bucket_order",
    sql(
        STEPS,
        "b AS (SELECT route, pos, CAST(floor(p * 100 + 0.5) AS BIGINT) // 2 AS bucket, rt, price, model FROM steps)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY bucket DESC, rt, price, pos) AS place, max(bucket) OVER (PARTITION BY route) AS top FROM b)",
        "t AS (SELECT route, count(*) AS tied, count(DISTINCT rt) AS n_rt, count(DISTINCT round(price, 2)) AS n_price FROM o WHERE bucket = top GROUP BY route)",
        "SELECT o.route, o.pos AS leader, tied, CASE WHEN tied = 1 THEN 'value' WHEN n_rt > 1 THEN 'rt' WHEN n_price > 1 THEN 'price' ELSE 'order' END AS decided_by FROM o JOIN t USING (route) WHERE place = 1",
    ),
)
def tie_bucket_order(spark, sf):
    """Candidates ordered by bucketed value with tie-breaks; which axis decided among the tied leaders."""
    b = steps(spark, sf).withColumn("bucket", F.floor(F.floor(F.col("p") * 100 + 0.5) / 2))
    own = Window.partitionBy("route")
    o = b.withColumn("place", F.row_number().over(own.orderBy(F.col("bucket").desc(), "rt", "price", "pos"))).withColumn("top", F.max("bucket").over(own))
    t = o.where("bucket = top").groupBy("route").agg(F.count(F.lit(1)).alias("tied"), F.count_distinct("rt").alias("n_rt"), F.count_distinct(F.round("price", 2)).alias("n_price"))
    decided = F.when(F.col("tied") == 1, "value").when(F.col("n_rt") > 1, "rt").when(F.col("n_price") > 1, "price").otherwise("order")
    return o.where("place = 1").join(t, "route").select("route", F.col("pos").alias("leader"), "tied", decided.alias("decided_by"))


@query(
    "representative_score",
    sql(STEPS, _axes_sql("steps"), f"SELECT route, round((coalesce(p_share, 0) + coalesce(rt5_miss, 0) + 1 - ln(1 + least(greatest(cost, 0), {PRICE_CAP})) / ln(1 + {PRICE_CAP})) / 3, 4) AS score FROM axes"),
)
def representative_score(spark, sf):
    a = routes.axes(steps(spark, sf), CUT, RANK_CUT)
    return a.select("route", F.round(routes.composite("p_share", "rt5_miss", F.col("cost"), PRICE_CAP), 4).alias("score"))


@query(
    "menu_topk_after_filter",
    sql(STEPS, "f AS (SELECT product, reactant, max(p) AS q FROM steps WHERE p >= 0.05 GROUP BY product, reactant)", "r AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY q DESC, reactant) AS place FROM f)", "SELECT product, reactant, q, place FROM r WHERE place <= 3"),
)
def menu_topk_after_filter(spark, sf):
    """The board-dependent filter comes first, then the cut to the top k."""
    f = steps(spark, sf).where("p >= 0.05").groupBy("product", "reactant").agg(F.max("p").alias("q"))
    w = Window.partitionBy("product").orderBy(F.col("q").desc(), "reactant")
    return f.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("product", "reactant", "q", "place")


@query(
    "stock_membership",
    "SELECT l_partkey AS molecule, count(*) AS n, CASE WHEN bool_and(p_partkey IS NULL) THEN NULL ELSE bool_or(p_size <= 40) END AS in_stock FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def stock_membership(spark, sf):
    """Three-valued: in stock, not in stock, not known."""
    m = molecules(spark, sf)
    line = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return line.join(m, line["part"] == m["molecule"], "left").select(F.col("part").alias("molecule"), "n", "in_stock")


@query(
    "route_closed_on_stock",
    sql(STEPS, MOLECULES, "SELECT s.route, bool_and(coalesce(in_stock, false)) AS closed FROM steps s LEFT JOIN molecules ON product = molecule GROUP BY s.route"),
)
def route_closed_on_stock(spark, sf):
    s = steps(spark, sf)
    ok = routes.solved(s, molecules(spark, sf).where("in_stock").select("molecule")).withColumn("closed", F.lit(True))
    return s.select("route").distinct().join(ok, "route", "left").select("route", F.coalesce("closed", F.lit(False)).alias("closed"))
