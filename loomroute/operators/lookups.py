"""What a board knows of molecules and steps: menus, stock and prices, evidence by tiers of caches, scope of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def info(molecules: DataFrame, stock: DataFrame, prices: DataFrame) -> DataFrame:
    """(molecule, in_stock, ln_price): a price does not depend on stock, and null stays null."""
    held = stock.select("molecule").distinct().withColumn("in_stock", F.lit(True))
    return molecules.select("molecule").distinct().join(held, "molecule", "left").join(prices.select("molecule", "ln_price"), "molecule", "left").select("molecule", F.coalesce("in_stock", F.lit(False)).alias("in_stock"), "ln_price")


def menu(pool: DataFrame, top: int, keep: Column | None = None) -> DataFrame:
    """(product, idx, ...): the first ``top`` of each product's pool by ``rank`` after the filter, numbered from 0."""
    own = pool if keep is None else pool.where(keep)
    k = F.row_number().over(Window.partitionBy("product").orderBy("rank", "key")) - 1
    return own.withColumn("idx", k).where(F.col("idx") < top)


def valid_cache(rows: DataFrame, valid: DataFrame) -> DataFrame:
    """Cached candidates (product, cand, reactants) all of whose reactants are valid (molecule), reactants sorted."""
    parts = rows.select("product", "cand", F.explode("reactants").alias("molecule"))
    bad = parts.join(valid.select("molecule").distinct(), "molecule", "left_anti").select("product", "cand").distinct()
    return rows.join(bad, ["product", "cand"], "left_anti").withColumn("reactants", F.array_sort("reactants"))


def tiers(asked: DataFrame, key: str, value: str, caches: dict[str, DataFrame]) -> DataFrame:
    """(key, value, source): the first of the caches, in order, that has a value; null and no source where none has."""
    out = asked.select(key).distinct()
    for name, cache in caches.items():
        out = out.join(cache.select(key, F.col(value).alias(f"_{name}")), key, "left")
    first = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in caches])
    return out.select(key, F.coalesce(*[F.col(f"_{n}") for n in caches]).alias(value), first.alias("source"))


def agreement(live: DataFrame, cached: DataFrame, key: str, value: str, budget: int) -> DataFrame:
    """One row: of the first ``budget`` live answers by key, how many equal the cache, differ from it or are new; the rest fall back."""
    first = live.select(key, F.col(value).alias("_live")).orderBy(key).limit(budget).withColumn("asked", F.lit(True))  # budget rows at most
    every = cached.select(key, F.col(value).alias("_old")).join(first, key, "full")
    return every.agg(
        F.count_if(F.col("asked") & F.col("_old").isNotNull() & F.col("_live").eqNullSafe(F.col("_old"))).alias("agree"),
        F.count_if(F.col("asked") & F.col("_old").isNotNull() & ~F.col("_live").eqNullSafe(F.col("_old"))).alias("differ"),
        F.count_if(F.col("asked") & F.col("_old").isNull()).alias("new"),
        F.count_if(F.col("asked").isNull()).alias("fallback"),
    )


def checked(cache: DataFrame, bad: Column) -> DataFrame:
    """A cache without the rows that carry an error or are marked as not valid: they count as missing."""
    return cache.where(~F.coalesce(bad, F.lit(False)))


def rows_with_facts(menus: DataFrame, facts: DataFrame) -> DataFrame:
    """Menu rows (turn, mid, cand) with their facts, which may be missing."""
    return menus.join(facts, ["turn", "mid", "cand"], "left")


def ambiguous(menus: DataFrame) -> DataFrame:
    """(turn, cand): candidate numbers that more than one molecule of the turn offers."""
    return menus.groupBy("turn", "cand").agg(F.count_distinct("mid").alias("n")).where("n > 1").select("turn", "cand")


def field_of(order: Column, described: Column) -> Column:
    """Ranked candidates, then described ones, each once."""
    return F.array_distinct(F.concat(order, described))


def route_map(steps: DataFrame) -> DataFrame:
    """(route, product, reactants): the last step of a product counts."""
    return steps.groupBy("route", "product").agg(F.max_by("reactants", "pos").alias("reactants"))


def dead_reasons(molecules: DataFrame, offers: DataFrame, max_depth: int, cutoff: float | None) -> DataFrame:
    """(board, mid, reason): floor, cutoff or exhausted, in this order, for those one holds for.

    ``molecules`` (board, mid, depth), ``offers`` (board, mid, signal, tried, failed) are what their menus show.
    """
    seen = offers.groupBy("board", "mid").agg(F.max(F.coalesce("signal", F.lit(0.0))).alias("best"), F.max(F.col("failed").cast("int")).alias("any_failed"), F.min((F.col("failed") | F.col("tried")).cast("int")).alias("all_tried"))
    reason = F.when(max_depth - F.col("depth") <= 0, "floor")
    if cutoff is not None:
        reason = reason.when(F.col("best") < cutoff, "cutoff")
    reason = reason.when((F.col("any_failed") == 1) & (F.col("all_tried") == 1), "exhausted")
    return molecules.join(seen, ["board", "mid"], "left").withColumn("reason", reason).where("reason IS NOT NULL").select("board", "mid", "reason")


def open_molecules(molecules: DataFrame, steps: DataFrame) -> DataFrame:
    """(board, mid, place): molecules still owed a decision, in first-seen order: open, and no step of theirs is open. steps: (board, mid, status)."""
    owed = steps.where("status = 'open'").select("board", "mid").distinct()
    left = molecules.where("status = 'open'").join(owed, ["board", "mid"], "left_anti")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("board").orderBy("first_seen", "mid")).cast("long")).select("board", "mid", "place")


def route_floor(steps: DataFrame) -> DataFrame:
    """(board, floor): the best over routes of their weakest signal (board, route, signal); a route without any signal gives none."""
    return steps.groupBy("board", "route").agg(F.min("signal").alias("weakest")).groupBy("board").agg(F.max("weakest").alias("floor"))


def route_cost(leaves: DataFrame) -> DataFrame:
    """(route, cost): the sum of leaf prices (route, ln_price), null if any is unknown."""
    return leaves.groupBy("route").agg(F.when(F.count("ln_price") == F.count(F.lit(1)), F.sum(F.exp("ln_price"))).alias("cost"))


def conserved(steps: DataFrame) -> DataFrame:
    """(route, scored, violating, skipped, valid): steps (route, product, pieces) with element counts as maps, null if unreadable.

    A step is violating if its pieces lack atoms of an element that the product has; a route is valid if some step
    was scored and none violates.
    """
    elements = F.map_keys("product")
    have = lambda e: F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + F.coalesce(p[e], F.lit(0)))
    readable = F.col("product").isNotNull() & F.forall("pieces", lambda p: p.isNotNull())
    bad = readable & F.exists(elements, lambda e: have(e) < F.col("product")[e])
    g = steps.groupBy("route").agg(F.count_if(readable).alias("scored"), F.count_if(bad).alias("violating"), F.count_if(~readable).alias("skipped"))
    return g.withColumn("valid", (F.col("scored") > 0) & (F.col("violating") == 0))


def load_arms(sources: dict[str, DataFrame], in_stock: DataFrame) -> DataFrame:
    """(arm, target, place, key): routes of several layouts in their own order, equal step sets once, targets in stock left out.

    Each source has (target, part, at, key): ``part`` orders lists that follow each other (reported, then pooled).
    """
    every = reduce(DataFrame.unionByName, [s.select(F.lit(arm).alias("arm"), "target", "part", "at", "key") for arm, s in sources.items()])
    own = every.join(in_stock.select("target").distinct(), "target", "left_anti").groupBy("arm", "target", "key").agg(F.min(F.struct("part", "at")).alias("first"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("arm", "target").orderBy("first", "key")).cast("long")).select("arm", "target", "place", "key")


def step_lines(routes: DataFrame, steps: DataFrame, key: list[str]) -> DataFrame:
    """(key, text): every step that the routes use, once, in the order the steps were made.

    ``routes`` (key, route, step), ``steps`` (key, step, product, pieces).
    """
    used = routes.select(*key, "step").distinct()
    line = F.concat(F.lit("  "), F.col("product"), F.lit(" ←r"), F.col("step").cast("string"), F.lit("— "), F.array_join("pieces", " · "))
    g = used.join(steps, [*key, "step"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))).alias("a"))
    return g.select(*key, F.concat(F.lit("STEPS\n"), F.array_join(F.transform("a", lambda x: x["line"]), "\n")).alias("text"))


def flow_lines(steps: DataFrame) -> DataFrame:
    """(route, text): a route in the direction it is run, deepest steps first; steps: (route, step, depth, product, pieces)."""
    line = F.concat(F.lit("  "), F.array_join("pieces", " + "), F.lit(" →r"), F.col("step").cast("string"), F.lit(" "), F.col("product"))
    g = steps.groupBy("route").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "step", line.alias("line")))).alias("a"))
    return g.select("route", F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("text"))


def merge_points(routes: DataFrame, steps: DataFrame, key: list[str]) -> DataFrame:
    """(key, molecule, n_parents): molecules that more than one step of the claimed routes asks for."""
    used = routes.select(*key, "step").distinct().join(steps, [*key, "step"]).select(*key, "step", F.explode("pieces").alias("molecule"))
    return used.groupBy(*key, "molecule").agg(F.count_distinct("step").alias("n_parents")).where("n_parents > 1")


def id_pool(seeds: DataFrame, letters: str = "abcdefghijklmnopqrstuvwxyz", most: int = 40) -> DataFrame:
    """(seed, place, id): the first ``most`` two-character ids of each seed, a letter and then a letter or digit, in an order of the seed's own."""
    second = letters + "0123456789"
    pool = F.explode(F.array(*[F.lit(a + b) for a in letters for b in second]))
    ids = seeds.select("seed").distinct().select("seed", pool.alias("id"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.md5(F.concat_ws(":", F.col("seed").cast("string"), "id")), "id"))
    return ids.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("seed", "place", "id")


def known_key(canonical: Column, raw: Column) -> Column:
    """The canonical form, or the string itself where there is none: a target is never dropped."""
    return F.coalesce(canonical, raw)


def same(a: Column, b: Column) -> Column:
    """Whether two canonical forms are known and equal."""
    return F.coalesce(a == b, F.lit(False))


def records_of(run: DataFrame, targets: DataFrame) -> DataFrame:
    """The records of the given targets: a semi-join, which Parquet's row-group statistics prune for a literal target."""
    return run.join(targets.select("target").distinct(), "target", "left_semi")
