"""Corpus preparation: issue codes, splits, probes, packing, role metrics, repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomroute.plans.workspace import save

from . import quantiles


def issues(rules: dict[str, Column]) -> Column:
    """Codes of the rules that hold, each once, in the rules' order; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]))


def split_share(df: DataFrame, unit: str, share: float, seed: int = 0) -> DataFrame:
    """``part`` = valid for the units with the smallest hash, max(1, floor(n * share)) of them; else train. Units stay whole.

    The hash of the last valid unit is found from counts, so nothing is sorted as a whole; only units that share its
    first eight digits are put in order.
    """
    units = df.select(unit).distinct().withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(unit).cast("string"))))
    units = save(units.withColumn("_head", F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")), "units")
    total = units.count()
    if not total:
        return df.withColumn("part", F.lit("train"))
    n = max(1, int(total * share))
    edge = quantiles.at_positions(units, [], "_head", {"edge": lambda _: F.lit(n - 1)}, cell=1 << 20).first()["edge"]
    below = units.where(F.col("_head") < edge)
    last = units.where(F.col("_head") == edge).orderBy("_h", unit).limit(n - below.count())  # units that share 32 bits
    chosen = below.unionByName(last).select(unit).withColumn("_valid", F.lit(True))
    return df.join(chosen, unit, "left").withColumn("part", F.when(F.col("_valid"), "valid").otherwise("train")).drop("_valid")


def stratified(df: DataFrame, stratum: str, unit: str, per: int, seed: int = 0) -> DataFrame:
    """``per`` rows of each stratum in seeded hash order."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(unit).cast("string"))), unit)
    return df.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= per)


def pack(df: DataFrame, stream: str, order: str, length: str, room: int) -> DataFrame:
    """(stream, order, pack, offset): samples in order fill packs of ``room``; the next pack begins when one does not fit.

    Samples longer than a pack are dropped whole (pack -1). Each place depends on the ones before it in the same
    stream (a data-parallel rank), so a stream is one sorted run; it is walked batch by batch, and only the open
    pack is kept in memory.
    """

    def run(batches):
        now, pack_no, used = None, 0, 0
        for rows in batches:
            packs, offsets = [], []
            for own, n in zip(rows[stream], rows[length]):
                if own != now:
                    now, pack_no, used = own, 0, 0
                if n > room:
                    packs.append(-1)
                    offsets.append(0)
                    continue
                if used + n > room:
                    pack_no, used = pack_no + 1, 0
                packs.append(pack_no)
                offsets.append(used)
                used += n
            yield rows.assign(pack=packs, offset=offsets)

    k = dict(df.dtypes)
    runs = df.select(stream, order, length).where(F.col(stream).isNotNull()).repartition(stream).sortWithinPartitions(stream, order)
    return runs.mapInPandas(run, f"`{stream}` {k[stream]}, `{order}` {k[order]}, `{length}` {k[length]}, pack long, offset long")


def packing_stats(packed: DataFrame, length: str, room: int) -> DataFrame:
    """Dropped, used and padded shares over all packs."""
    inside = F.col("pack") >= 0
    tokens = F.sum(F.when(inside, F.col(length)).otherwise(0))
    per = packed.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.count_if(~inside).alias("dropped"), tokens.alias("tokens"), F.max("pack").alias("last"))
    packs = F.greatest(F.col("last") + 1, F.lit(0))
    return per.agg(
        F.sum("n").alias("samples"),
        F.sum("dropped").alias("dropped"),
        F.sum(packs).alias("packs"),
        F.round(F.sum("dropped") / F.greatest(F.sum("n"), F.lit(1)), 4).alias("dropped_share"),
        F.round(1 - F.sum("tokens") / F.greatest(F.sum(packs) * room, F.lit(1)), 4).alias("padded_share"),
    )


def role_metrics(tokens: DataFrame) -> DataFrame:
    """Over (role, nll, correct, valid): loss, accuracy and share of the valid tokens per role."""
    ok = tokens.where("valid")
    total = ok.agg(F.count(F.lit(1)).alias("_all"))
    per = ok.groupBy("role").agg(F.count(F.lit(1)).alias("tokens"), F.avg("nll").alias("loss"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return per.join(F.broadcast(total)).withColumn("share", F.col("tokens") / F.greatest("_all", F.lit(1))).drop("_all")  # one row


def span_exact(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """A span is exact if all of its valid tokens are correct; spans without valid tokens are left out."""
    return tokens.where("valid").groupBy(*keys).agg(F.min(F.col("correct").cast("int")).alias("exact"), F.count(F.lit(1)).alias("tokens"))


def word_bags(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, word, n): lower-cased words with their counts."""
    word = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[^\s.,;:!?()\"']+"), F.lit(0)))
    return texts.select(*keys, word.alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def repetition(texts: DataFrame, episode: str, turn: str, text: str, least: float) -> DataFrame:
    """(episode, turn, overlap, repeats): the largest share of a turn's words found, as a bag, in one earlier turn."""
    bags = word_bags(texts, [episode, turn], text)
    size = bags.groupBy(episode, turn).agg(F.sum("n").alias("size"))
    a, b = bags.alias("a"), bags.alias("b")
    same = (F.col(f"a.{episode}") == F.col(f"b.{episode}")) & (F.col("a.word") == F.col("b.word")) & (F.col(f"b.{turn}") < F.col(f"a.{turn}"))
    shared = a.join(b, same).groupBy(F.col(f"a.{episode}").alias(episode), F.col(f"a.{turn}").alias(turn), F.col(f"b.{turn}").alias("_earlier")).agg(F.sum(F.least("a.n", "b.n")).alias("m"))
    best = shared.groupBy(episode, turn).agg(F.max("m").alias("m"))
    out = size.join(best, [episode, turn], "left").withColumn("overlap", F.coalesce(F.col("m"), F.lit(0)).cast("double") / F.col("size"))
    return out.select(episode, turn, "overlap", (F.col("overlap") >= least).alias("repeats"))
