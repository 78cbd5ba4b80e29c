"""Which candidate, molecule or route is taken next, for all boards at once.

Offers are the candidates of molecules on boards: (board, mid, idx, signal, value, tried, acyclic, recorded,
labelled_dead). ``value`` is the max-min value, null where the candidate does not close; ``tried`` are candidates
applied or failed before. Each pick is one aggregate per (board, mid), so a molecule's menu is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOLECULE = ["board", "mid"]


def _highest(offers: DataFrame, *first: Column) -> DataFrame:
    """(board, mid, idx, signal): the largest of ``first`` and the signal, the smallest number on ties; no signal, no pick."""
    best = F.max(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(first)], F.col("signal"), (-F.col("idx")).alias("less"))).alias("best")
    return offers.where("signal IS NOT NULL").groupBy(*MOLECULE).agg(best).select(*MOLECULE, (-F.col("best.less")).alias("idx"), "best.signal")


def greedy(offers: DataFrame) -> DataFrame:
    """The best signal among candidates that are untried and close no cycle."""
    return _highest(offers.where("NOT tried AND acyclic"))


def trap(offers: DataFrame) -> DataFrame:
    """The best signal among those that do not close but can be played from the recording; recorded dead ends first."""
    return _highest(offers.where("NOT tried AND acyclic AND value IS NULL AND recorded"), F.col("labelled_dead").cast("int"))


def readable(pieces: DataFrame, cutoff: float | None) -> DataFrame:
    """(board, mid, idx): candidates whose failure shows a turn later.

    ``pieces``: (board, mid, idx, left, in_stock, has_menu, top), a row for each reactant; ``left`` are the levels
    left at the molecule. A piece out of stock shows it if no level remains for it, or if its own menu's best
    signal lies below the cutoff; where levels remain, a piece without a menu hides it.
    """
    waits = ~F.col("in_stock")
    last = F.col("left") - 1 <= 0
    below = F.lit(False) if cutoff is None else F.coalesce("top", F.lit(0.0)) < cutoff
    shows = F.max((waits & (last | (F.col("has_menu") & below))).cast("int"))
    hides = F.max((waits & ~last & ~F.col("has_menu")).cast("int"))
    return pieces.groupBy(*MOLECULE, "idx").agg(shows.alias("shows"), hides.alias("hides")).where("shows = 1 AND hides = 0").select(*MOLECULE, "idx")


def readable_trap(offers: DataFrame, pieces: DataFrame, cutoff: float | None) -> DataFrame:
    own = offers.where("NOT tried AND acyclic AND value IS NULL")
    return _highest(own.join(readable(pieces, cutoff), [*MOLECULE, "idx"], "left_semi"))


def mistake(mode: str, offers: DataFrame, pieces: DataFrame, cutoff: float | None) -> DataFrame:
    """The candidate that a rollout takes instead of the labelled one."""
    if mode == "readable":
        return readable_trap(offers, pieces, cutoff)
    return trap(offers) if mode == "trap" else greedy(offers)


def rank_labels(offers: DataFrame, floors: DataFrame, window: int, most: int) -> DataFrame:
    """(board, mid, order, lost): closing candidates by value, those on screen (idx < window) and above the board's floor.

    Without any above the floor the best one stays; ``floors`` (board, floor) lists boards that have a route.
    ``lost`` tells that the best candidate of all is not on screen. At most ``most`` are listed.
    """
    place = F.row_number().over(Window.partitionBy(*MOLECULE).orderBy(F.col("value").desc(), "idx"))
    ranked = offers.where("value IS NOT NULL").withColumn("place", place).join(floors, "board", "left")
    seen = F.col("idx") < window
    # Place among those on screen, then among those that stay.
    ranked = ranked.withColumn("shown", F.sum(seen.cast("int")).over(Window.partitionBy(*MOLECULE).orderBy("place")))
    stays = seen & (F.col("floor").isNull() | (F.col("value") > F.col("floor")) | (F.col("shown") == 1)) & (F.col("shown") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.when(stays, F.struct("place", "idx")))), lambda x: x["idx"])
    return ranked.groupBy(*MOLECULE).agg(listed.alias("order"), (F.min(F.when(seen, F.col("place"))).isNull() | (F.min(F.when(seen, F.col("place"))) > 1)).alias("lost"))


def branch_order(order: Column, wanted: Column) -> Column:
    """(order, commit): candidates that queued routes want come first, in the order's own order, and all of them are committed; else one."""
    first = F.array_intersect(order, F.coalesce(wanted, F.array().cast("array<int>")))
    return F.struct(F.concat(first, F.array_except(order, first)).alias("order"), F.greatest(F.size(first), F.lit(1)).alias("commit"))


def continuation(offers: DataFrame, molecules: DataFrame, floors: DataFrame, window: int) -> DataFrame:
    """(board, mid, idx, value): the best untried closing candidate strictly above the board's floor.

    ``molecules`` (board, mid, place, rankable): only molecules that are neither dead nor owe a piece are looked at;
    equal values go to the earlier molecule, then to the smaller number.
    """
    above = offers.where((F.col("idx") < window) & ~F.col("tried")).join(molecules.where("rankable"), MOLECULE).join(floors, "board").where("value > floor")
    best = F.max(F.struct("value", (-F.col("place")).alias("early"), (-F.col("idx")).alias("less"), "mid")).alias("best")
    return above.groupBy("board").agg(best).select("board", "best.mid", (-F.col("best.less")).alias("idx"), "best.value")


def claims(queue: DataFrame, held: DataFrame, room: DataFrame) -> DataFrame:
    """(board, place, key): queued routes to claim now, in queue order, within the board's room.

    ``queue`` (board, place, key, ready, claimed), ``held`` (board, key) are step sets that the board has, ``room``
    (board, room). Of queued routes with equal step sets the first counts.
    """
    ready = queue.where("ready AND NOT claimed").groupBy("board", "key").agg(F.min("place").alias("place")).join(held.select("board", "key").distinct(), ["board", "key"], "left_anti")
    k = F.row_number().over(Window.partitionBy("board").orderBy("place"))
    return ready.join(room, "board").withColumn("k", k).where("k <= room").select("board", "place", "key")


def opens(needs: DataFrame, most: int) -> DataFrame:
    """(board, mid, k): the first ``most`` molecules that unclaimed routes still need a menu for; needs: (board, place, at, mid, has_menu, blocked)."""
    own = needs.where("NOT blocked AND NOT has_menu").groupBy("board", "mid").agg(F.min(F.struct("place", "at")).alias("first"))
    k = F.row_number().over(Window.partitionBy("board").orderBy("first.place", "first.at", "mid"))
    return own.withColumn("k", k).where(F.col("k") <= most).select("board", "mid", F.col("k").cast("long").alias("k"))


def next_moves(points: DataFrame, window: int) -> DataFrame:
    """(board, place, mid, verb, idx): the move toward the first queued route that can still be reached.

    ``points`` (board, place, depth, mid, has_menu, idx, acyclic): where a queued route differs from what is built;
    its shallowest point counts. A route whose point shows a menu without its candidate (idx null), off screen or
    closing a cycle is passed over.
    """
    names = ("depth", "mid", "has_menu", "idx", "acyclic")
    shallow = points.groupBy("board", "place").agg(F.min(F.struct(*names)).alias("p")).select("board", "place", *[f"p.{n}" for n in names])
    ok = shallow.where(~F.col("has_menu") | (F.col("idx").isNotNull() & (F.col("idx") < window) & F.col("acyclic")))
    first = ok.groupBy("board").agg(F.min(F.struct("place", "mid", "has_menu", "idx")).alias("p")).select("board", "p.*")
    return first.select("board", "place", "mid", F.when(F.col("has_menu"), "rank").otherwise("open").alias("verb"), F.when(F.col("has_menu"), F.col("idx")).alias("idx"))


def free_routes(swaps: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """(board, key, mid, idx, k): the best ``most`` new routes made by swapping in a candidate whose pieces can all be bought.

    ``swaps`` (board, key, at, mid, idx, signal, tried, acyclic, all_bought); of equal step sets the first swap counts,
    a swap without a signal comes last.
    """
    new = swaps.where("NOT tried AND acyclic AND all_bought").join(held.select("board", "key").distinct(), ["board", "key"], "left_anti")
    once = new.groupBy("board", "key").agg(F.min(F.struct("at", "mid", "idx", "signal")).alias("s")).select("board", "key", "s.*")
    k = F.row_number().over(Window.partitionBy("board").orderBy(F.col("signal").desc_nulls_last(), "at", "mid", "idx"))
    return once.withColumn("k", k).where(F.col("k") <= most).select("board", "key", "mid", "idx", F.col("k").cast("long").alias("k"))


def cuts_by_size(cuts: DataFrame, key: list[str], sizes: str) -> DataFrame:
    """Cut proposals of each key with their place: the larger the smaller fragment, the earlier."""
    w = Window.partitionBy(*key).orderBy(F.array_min(sizes).desc(), F.array_max(sizes).desc(), "cut")
    return cuts.withColumn("place", F.row_number().over(w).cast("long"))
