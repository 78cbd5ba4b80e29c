"""Board text: reading ids and menus, writing candidate lines, and aligned training arrays of an episode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomroute.functions import keys


def open_block(text: Column) -> Column:
    """The lines between ``OPEN`` and the next block."""
    return F.regexp_extract(text, r"(?ms)^OPEN[^\n]*\n(.*?)(?=^[A-Z]{3,}|\z)", 1)


def open_ids(text: Column) -> Column:
    """Ids of the OPEN block, in order: lines indented by two."""
    return F.regexp_extract_all(open_block(text), F.lit(r"(?m)^  ([A-Za-z0-9]+)\b"), F.lit(1))


def ledger_ids(text: Column) -> Column:
    """Molecules of the ledger rows ``rN  mid.cK ...``."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^r\d+\s+([A-Za-z0-9]+)\W?c\d+"), F.lit(1))


def actionable_ids(text: Column) -> Column:
    return F.array_union(open_ids(text), ledger_ids(text))


def menu_sizes(text: Column) -> Column:
    """id -> number of its candidate lines, which are indented by four."""
    lines = F.split(open_block(text), "\n")
    heads = F.filter(F.transform(lines, lambda x, i: F.struct(F.regexp_extract(x, r"^  ([A-Za-z0-9]+)\b", 1).alias("id"), i.alias("at"))), lambda h: h["id"] != "")
    after = lambda h: F.coalesce(F.array_min(F.transform(F.filter(heads, lambda g: g["at"] > h["at"]), lambda g: g["at"])), F.size(lines))
    count = lambda h: F.size(F.filter(F.slice(lines, h["at"] + 1, after(h) - h["at"]), lambda x: x.rlike(r"^    <?c\d+")))
    return F.map_from_entries(F.transform(heads, lambda h: F.struct(h["id"], count(h))))


def budget(text: Column) -> Column:
    """(left, of) of the header line; null where it is missing."""
    pattern = r"(?i)budget:?\s+(\d+)\s+of\s+(\d+)"
    return F.struct(F.regexp_extract(text, pattern, 1).try_cast("int").alias("left"), F.regexp_extract(text, pattern, 2).try_cast("int").alias("of"))


def candidate_line(index: Column, q: Column, rank: Column, asked: Column, prices: Column, show: Callable[[Column], Column] | None = None) -> Column:
    """One menu line; the total cost only if every piece has a price, signals that are missing are skipped.

    ``show`` writes the total in dollars; without it, the price string of its logarithm is taken.
    """
    whole = F.forall(prices, lambda p: p.isNotNull()) & (F.size(prices) > 0)
    total = F.when(whole, F.aggregate(prices, F.lit(0.0), lambda a, p: a + p))
    shown = F.when(total.isNotNull(), show(total) if show else keys.price_string(F.log(total)))
    return F.concat_ws(" ", F.concat(F.lit("c"), index.cast("string")), F.when(q.isNotNull(), F.concat(F.lit("q"), keys.short_number(q))), keys.recovered(rank, asked), shown)


def aligned_arrays(messages: DataFrame, episode: str, order: str, tokens: str, supervised: str) -> DataFrame:
    """(episode, input_ids, labels, spans, positions), shifted by one.

    ``labels`` holds the next token where its message is supervised, else -100; ``spans`` numbers the supervised
    messages of an episode from 0 (-1 elsewhere). All arrays are one shorter than the token stream.
    """
    own = Window.partitionBy(episode).orderBy(order, tokens, supervised).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col(supervised).cast("int")).over(own), F.lit(0)).cast("int")
    part = F.struct(F.col(order).alias("at"), F.col(tokens).alias("t"), F.col(supervised).alias("s"), F.col("_before").alias("n"))
    g = messages.withColumn("_before", before).groupBy(episode).agg(F.array_sort(F.collect_list(part)).alias("m"))
    flat = lambda value: F.flatten(F.transform("m", value))
    ids = flat(lambda x: x["t"])
    labels = flat(lambda x: F.transform(x["t"], lambda t: F.when(x["s"], t).otherwise(F.lit(-100))))
    spans = flat(lambda x: F.transform(x["t"], lambda t: F.when(x["s"], x["n"]).otherwise(F.lit(-1))))
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return g.select(
        episode,
        F.slice(ids, F.lit(1), n).alias("input_ids"),
        F.slice(labels, F.lit(2), n).alias("labels"),
        F.slice(spans, F.lit(2), n).alias("spans"),
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")).alias("positions"),
    )


def padded(array: Column, length: int, filler: int) -> Column:
    """The array filled up to ``length``."""
    return F.concat(array, F.array_repeat(F.lit(filler), F.greatest(F.lit(length) - F.size(array), F.lit(0))))
