"""Recursion over AND-OR graphs, round by round, until nothing changes.

Each round is a few joins and aggregates on distributed tables that look only at what the round before added.
Its result is written, so a lost executor never recomputes the rounds before, and the table of the round before
goes. A graph that has a cycle where none may be is an error, never an incomplete result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomroute.plans.workspace import Rounds, save

WORST, BEST = -1e18, 1e18


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, distance) of a forest of (child, parent), all of them; self loops are left out.

    Distances double from round to round: pairs at the largest distance known are continued by all pairs known.
    A node that is its own ancestor raises ValueError.
    """
    pairs = edges.where("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance"))
    known = [save(pairs.distinct(), "closure")]
    reach = 1
    while True:
        every = reduce(DataFrame.unionByName, known)
        far = known[-1].where(F.col("distance") == reach).select("node", F.col("ancestor").alias("via"), F.col("distance").alias("d"))
        on = every.select(F.col("node").alias("via"), "ancestor", "distance")
        more = save(far.join(on, "via").select("node", "ancestor", (F.col("d") + F.col("distance")).alias("distance")), "closure")
        if more.isEmpty():
            return every
        if not more.where("node = ancestor").isEmpty():
            raise ValueError("the edges hold a cycle")
        known.append(more)
        reach *= 2


def longest_chain(edges: DataFrame) -> DataFrame:
    """(node, depth): the number of levels below each node, leaves have 0."""
    below = ancestors(edges).groupBy(F.col("ancestor").alias("node")).agg(F.max("distance").alias("depth"))
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    return nodes.join(below, "node", "left").select("node", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def leaf_walk(edges: DataFrame) -> DataFrame:
    """(root, leaf): the childless nodes below each node."""
    inner = edges.where("child <> parent").select(F.col("parent").alias("node")).distinct()
    return ancestors(edges).join(inner, "node", "left_anti").select(F.col("ancestor").alias("root"), F.col("node").alias("leaf"))


def cycle_candidates(offers: DataFrame, closure: DataFrame) -> DataFrame:
    """Offers (node, piece) whose piece is the node itself or one of its ancestors."""
    a = closure.select("node", F.col("ancestor").alias("piece")).withColumn("_up", F.lit(True))
    return offers.join(a, ["node", "piece"], "left").where(F.col("_up") | (F.col("node") == F.col("piece"))).drop("_up")


def maxmin(candidates: DataFrame, stock: DataFrame, levels: int) -> DataFrame:
    """(node, value) after ``levels`` rounds, or fewer if a round changes nothing.

    ``candidates``: (node, candidate, signal, pieces). A node in stock (node) is worth the best; otherwise the
    largest over its candidates of the smaller of the candidate's signal and its worst piece. A node with no
    candidate, or none that closes within the levels, is worth the worst. A null signal is the worst. Values only
    rise, so after the first round only nodes with a candidate whose piece has just risen are looked at.
    """
    pieces = candidates.select("node", "candidate", F.coalesce("signal", F.lit(WORST)).alias("signal"), F.explode("pieces").alias("piece"))
    nodes = candidates.select("node").union(pieces.select("piece")).distinct()
    start = nodes.join(stock.select("node").withColumn("_in", F.lit(True)), "node", "left")
    held = F.coalesce("_in", F.lit(False))
    rounds = Rounds("values")
    # rose: whether the round before changed the value.
    state = rounds.save(start.select("node", held.alias("held"), F.when(F.col("_in"), BEST).otherwise(WORST).alias("value"), held.alias("rose")))
    for _ in range(levels):
        touched = pieces.join(state.where("rose").select(F.col("node").alias("piece")), "piece", "left_semi").select("node", "candidate").distinct()
        own = pieces.join(touched, ["node", "candidate"], "left_semi")
        of_piece = state.select(F.col("node").alias("piece"), F.col("value").alias("piece_value"))
        worth = own.join(of_piece, "piece").groupBy("node", "candidate").agg(F.least(F.first("signal"), F.min("piece_value")).alias("v")).groupBy("node").agg(F.max("v").alias("v"))
        after = F.when(F.col("held"), F.col("value")).otherwise(F.greatest("value", "v"))
        state = rounds.save(state.join(worth, "node", "left").select("node", "held", after.alias("value"), (after > F.col("value")).alias("rose")))
        if state.where("rose").isEmpty():
            break
    return state.select("node", "value")


def coverable(candidates: DataFrame, stock: DataFrame, levels: int, width: int = 3) -> DataFrame:
    """(node, covered) of nodes: whether everything that the best ``width`` candidates reach within the levels has a menu.

    ``candidates``: (node, candidate, signal, pieces). Stock ends a branch, and so do the levels; a node without a
    candidate is a gap in the recording. Coverage only falls from round to round, and rounds end when none does.
    """
    w = Window.partitionBy("node").orderBy(F.coalesce("signal", F.lit(0.0)).desc(), "candidate")
    top = candidates.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= width).select("node", F.explode("pieces").alias("piece")).distinct()
    nodes = candidates.select("node").union(candidates.select(F.explode("pieces"))).distinct()
    held = stock.select("node").distinct().withColumn("held", F.lit(True))
    menus = candidates.select("node").distinct().withColumn("menu", F.lit(True))
    start = nodes.join(held, "node", "left").join(menus, "node", "left").select("node", F.coalesce("held", F.lit(False)).alias("held"), F.coalesce("menu", F.lit(False)).alias("menu"))
    rounds = Rounds("covered")
    state = rounds.save(start.withColumn("covered", F.lit(True)).withColumn("fell", F.lit(False)))
    for level in range(levels):
        lost = state.where("fell").select(F.col("node").alias("piece"))
        hit = top.join(lost, "piece", "left_semi").select("node").distinct().withColumn("hit", F.lit(True))
        now = state.join(hit, "node", "left")
        gap = ~F.col("menu") if level == 0 else F.lit(False)
        after = F.col("covered") & (F.col("held") | ~(gap | F.coalesce("hit", F.lit(False))))
        state = rounds.save(now.select("node", "held", "menu", after.alias("covered"), (F.col("covered") & ~after).alias("fell")))
        if state.where("fell").isEmpty():
            break
    return state.select("node", "covered")


def settle(reactions: DataFrame, closed: DataFrame) -> DataFrame:
    """(node, level): nodes that close. ``reactions``: (node, reaction, pieces); a node closes when all pieces of one of its reactions have.

    ``closed`` (node) holds level 0. Rounds end when nothing new closes. A reaction without pieces closes nothing.
    """
    pieces = reactions.select("node", "reaction", F.explode("pieces").alias("piece")).distinct()
    new = save(closed.select("node").distinct().withColumn("level", F.lit(0).cast("long")), "closed")
    levels, open_pieces, waits = [new], Rounds("open_pieces"), Rounds("waiting")
    missing = pieces
    waiting = pieces.select("node", "reaction").distinct()
    while True:
        # Both tables only shrink: pieces not closed yet, and reactions of nodes not closed yet.
        gone = new.select("node")
        missing = open_pieces.save(missing.join(gone.withColumnRenamed("node", "piece"), "piece", "left_anti").join(gone, "node", "left_anti"))
        waiting = waits.save(waiting.join(gone, "node", "left_anti"))
        ready = waiting.join(missing.select("node", "reaction").distinct(), ["node", "reaction"], "left_anti")
        new = save(ready.select("node").distinct().withColumn("level", F.lit(len(levels)).cast("long")), "closed")
        if new.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(new)


def dead(reactions: DataFrame, dead_nodes: DataFrame) -> DataFrame:
    """(node): dead nodes with all that die of them: a reaction fails with any dead piece, a node with all its reactions failed."""
    pieces = reactions.select("node", "reaction", F.explode("pieces").alias("piece")).distinct()
    new = save(dead_nodes.select("node").distinct(), "dead")
    found, alive = [new], Rounds("alive_reactions")
    living = pieces.select("node", "reaction").distinct()
    while True:
        # Only reactions with a piece that has just died fail; only their nodes can die of it.
        failed = pieces.join(new.select(F.col("node").alias("piece")), "piece", "left_semi").select("node", "reaction").distinct()
        before = living.join(new, "node", "left_anti")
        living = alive.save(before.join(failed, ["node", "reaction"], "left_anti"))
        hurt = failed.select("node").distinct()
        lost = hurt.join(living.select("node").distinct(), "node", "left_anti").join(reduce(DataFrame.union, found), "node", "left_anti")
        new = save(lost, "dead")
        if new.isEmpty():
            return reduce(DataFrame.union, found)
        found.append(new)
