"""Score caches as tables (key, value): a key with a null value was asked and failed, an absent key was never asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def need(universe: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys of the universe that were never asked."""
    return universe.select(key).distinct().join(cache, key, "left_anti")


def merge(parts: list[DataFrame], key: str, first_wins: bool = True) -> DataFrame:
    """One row a key: of the first part that has it, or of the last."""
    tagged = None
    for i, part in enumerate(parts):
        one = part.withColumn("_part", F.lit(i if first_wins else -i))
        tagged = one if tagged is None else tagged.unionByName(one)
    others = [c for c in tagged.columns if c not in (key, "_part")]
    best = tagged.groupBy(key).agg(F.min_by(F.struct(*others), F.struct("_part", *others)).alias("v"))
    return best.select(key, *[F.col(f"v.{c}").alias(c) for c in others])


def overlay(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """The overlay's value where it has the key, even a null one; else the base's."""
    b, o = base.select(key, F.col(value).alias("_base")), over.select(key, F.col(value).alias("_over"), F.lit(True).alias("_has"))
    joined = b.join(o, key, "full_outer")
    return joined.select(key, F.when(F.col("_has"), F.col("_over")).otherwise(F.col("_base")).alias(value))


def coverage(universe: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys wanted, cached, cached with a value, size of the cache."""
    wanted = universe.select(key).distinct().join(cache.withColumn("_has", F.lit(True)), key, "left")
    size = cache.agg(F.count(F.lit(1)).alias("cache_size"))
    return wanted.agg(F.count(F.lit(1)).alias("wanted"), F.count("_has").alias("cached"), F.count(value).alias("valued")).crossJoin(F.broadcast(size))  # one row each


def lookup_spellings(rows: DataFrame, cache: DataFrame, spellings: list[str], key: str, value: str) -> DataFrame:
    """The value under the first spelling that the cache has, and which one that was (null: none)."""
    out = rows
    found = F.lit(None).cast("int")
    got = F.lit(None)
    for i, s in enumerate(spellings):
        side = cache.select(F.col(key).alias(s), F.col(value).alias(f"_v{i}"), F.lit(True).alias(f"_h{i}"))
        out = out.join(side, s, "left")
    for i in reversed(range(len(spellings))):
        got = F.when(F.col(f"_h{i}"), F.col(f"_v{i}")).otherwise(got)
        found = F.when(F.col(f"_h{i}"), F.lit(i)).otherwise(found)
    helpers = [c for i in range(len(spellings)) for c in (f"_v{i}", f"_h{i}")]
    return out.withColumn(value, got).withColumn("spelling", found.cast("long")).drop(*helpers)


def newest(versions: DataFrame, key: str, stamp: str) -> DataFrame:
    """Upsert result: the row with the highest stamp of each key."""
    w = Window.partitionBy(key).orderBy(F.col(stamp).desc())
    return versions.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
