"""Routes: axes per route, pooling over sources, identity and gold overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomroute.functions.keys import log_utility

#: Routes that extraction hands on for a target (fixed value).
EXTRACTED = 500
#: Orders of a target's runs that are tried (fixed value).
DRAWS = 20


def axes(steps: DataFrame, cut: float, rank_cut: int) -> DataFrame:
    """Per route over (route, pos, p, rt, price): shares, minimum, median and costs, each null if a step lacks the value.

    ``*_miss`` counts a missing value as a failure instead; ``cost_known`` sums the priced steps only.
    """
    all_of = lambda c, value: F.when(F.count(c) == F.count(F.lit(1)), value)
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    return steps.groupBy("route").agg(
        F.count(F.lit(1)).alias("n_steps"),
        all_of("p", share(F.col("p") >= cut)).alias("p_share"),
        all_of("p", F.min("p")).alias("p_min"),
        all_of("p", F.median("p")).alias("p_median"),
        all_of("p", F.min((F.col("p") >= cut).cast("int")) == 1).alias("p_all"),
        all_of("rt", share(F.col("rt") <= 1)).alias("rt1"),
        all_of("rt", share(F.col("rt") <= rank_cut)).alias("rt5"),
        share(F.col("rt") <= rank_cut).alias("rt5_miss"),
        all_of("price", F.sum("price")).alias("cost"),
        F.sum("price").alias("cost_known"),
        F.count_if(F.col("price").isNull()).alias("n_unpriced"),
    )


def composite(p, rt, cost, cap: float):
    """Mean of three utilities; a missing one counts as 0."""
    zero = F.lit(0.0)
    return (F.coalesce(F.col(p), zero) + F.coalesce(F.col(rt), zero) + log_utility(cost, cap)) / 3.0


def keep_first(df: DataFrame, group: list[str], key: str, order: list) -> DataFrame:
    """One row of each (group, key): the first in ``order``."""
    w = Window.partitionBy(*group, key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def extracted(df: DataFrame, group: list[str], order: list, most: int = EXTRACTED) -> DataFrame:
    """The first ``most`` rows of each group: a search hands on at most so many routes of a target."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def solved(steps: DataFrame, stock: DataFrame) -> DataFrame:
    """Routes all of whose products are in ``stock`` (molecule)."""
    lacking = steps.join(stock, steps["product"] == stock["molecule"], "left_anti").select("route").distinct()
    return steps.select("route").distinct().join(lacking, "route", "left_anti")


def pool(instances: DataFrame, key: str) -> DataFrame:
    """Pool (target, key, source, rank): best rank, sources and models of each distinct route."""
    return instances.groupBy("target", key).agg(F.min("rank").alias("first_rank"), F.array_sort(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("n_instances"))


def end_to_end(found: DataFrame, spend: DataFrame, budget: float, draws: int = DRAWS) -> DataFrame:
    """(target, draw, n_routes): independent runs of a target laid one after the other on one budget axis.

    ``found`` (target, run, route, found_at) are stamps within a run, ``spend`` (target, run, cost) what each run used;
    a run without an entry used its last stamp, and a run that found nothing still used its cost. The order of the
    runs is arbitrary, so ``draws`` orders (by hash) are tried and the one of middle size counts, the smaller draw on
    ties. A target with one run is cut by its own stamps. Targets without a route within the budget have no row.
    """
    last = found.groupBy("target", "run").agg(F.max("found_at").cast("double").alias("last"))
    runs = last.join(spend.select("target", "run", F.col("cost").cast("double").alias("cost")), ["target", "run"], "full")
    runs = runs.withColumn("cost", F.coalesce("cost", "last", F.lit(0.0))).withColumn("n_runs", F.count(F.lit(1)).over(Window.partitionBy("target")))
    tried = runs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.when(F.col("n_runs") > 1, draws - 1).otherwise(0))))
    shuffled = F.md5(F.concat_ws(":", F.col("target").cast("string"), F.col("run").cast("string"), F.col("draw").cast("string")))
    before = Window.partitionBy("target", "draw").orderBy(shuffled, "run").rowsBetween(Window.unboundedPreceding, -1)
    starts = tried.withColumn("start", F.coalesce(F.sum("cost").over(before), F.lit(0.0))).select("target", "run", "draw", "n_runs", "start")
    within = starts.join(found, ["target", "run"], "left").groupBy("target", "draw", "n_runs").agg(F.count_if(F.col("start") + F.col("found_at") <= budget).alias("n_routes"))
    place = F.row_number().over(Window.partitionBy("target").orderBy("n_routes", "draw"))
    middle = within.withColumn("place", place).where((F.col("place") == F.when(F.col("n_runs") > 1, draws // 2 + 1).otherwise(1)) & (F.col("n_routes") > 0))
    return middle.select("target", F.col("draw").cast("long").alias("draw"), "n_routes")


def gold_prefix(sets: DataFrame, gold: DataFrame) -> DataFrame:
    """(target, route, gold_prefix): largest share of a gold route's steps that the route has. Both have (target, route, keys)."""
    g = gold.select("target", F.col("route").alias("gold_route"), F.col("keys").alias("gold_keys"))
    share = F.size(F.array_intersect("keys", "gold_keys")).cast("double") / F.size("gold_keys")
    return sets.join(g, "target").groupBy("target", "route").agg(F.max(share).alias("gold_prefix"))
