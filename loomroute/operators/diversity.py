"""Diversity of route sets: distinct disconnections, entropy, pairwise distances, greedy selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entropy(counts: DataFrame, group: list[str], n: str = "n") -> DataFrame:
    """(group, classes, normal_entropy, effective): H / ln k and exp(H); (0, k) for one class or none."""
    total = counts.groupBy(*group).agg(F.sum(n).alias("_all"))
    p = F.col(n).cast("double") / F.col("_all")
    h = counts.join(total, group).groupBy(*group).agg(F.count_if(F.col(n) > 0).alias("classes"), F.sum(F.when(F.col(n) > 0, -p * F.log(p)).otherwise(0.0)).alias("h"))
    flat = F.col("classes") <= 1
    return h.select(*group, "classes", F.when(flat, 0.0).otherwise(F.col("h") / F.log("classes")).alias("normal_entropy"), F.when(flat, F.col("classes").cast("double")).otherwise(F.exp("h")).alias("effective"))


def pairs(sets: DataFrame, group: str, key: str) -> DataFrame:
    """Unordered pairs within a group as columns a.* and b.*; an equi-join on the group, whose pools are bounded."""
    a, b = sets.alias("a"), sets.alias("b")
    return a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))


def mean_pairwise(sets: DataFrame, group: str, key: str, distance: Column) -> DataFrame:
    """(group, n_pairs, distance): mean over pairs; ``distance`` is over a.* and b.*."""
    return pairs(sets, group, key).groupBy(F.col(f"a.{group}").alias(group)).agg(F.count(distance).alias("n_pairs"), F.avg(distance).alias("distance"))


def cluster(sets: DataFrame, group: str, key: str, items: str, threshold: float = 0.5) -> DataFrame:
    """(group, key, cluster): single pass in key order; a set joins the first cluster whose growing union it overlaps enough.

    Each decision depends on the ones before, so a group (one target's pool) is one pandas call.
    """

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(key)
        unions: list[set] = []
        out = []
        for own in pool[items]:
            own = set(own)
            for i, union in enumerate(unions):
                every = len(own | union)
                if every and len(own & union) / every >= threshold:
                    union |= own
                    out.append(i)
                    break
            else:
                unions.append(own)
                out.append(len(unions) - 1)
        return pd.DataFrame({group: pool[group], key: pool[key], "cluster": out})

    kinds = dict(sets.dtypes)
    return sets.select(group, key, items).groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, cluster long")


def pick_diverse(rows: DataFrame, group: str, key: str, leaf: str, order: list[str], n: int, pool_rank: int = 2) -> DataFrame:
    """(group, key, place): fronts up to ``pool_rank`` in order, each leaf set once, then filled up in order to n.

    Greedy keeping by equal keys needs no loop: new leaf sets come first, repeats after them.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    inside = rows.where(F.col("front") <= pool_rank)
    marked = inside.withColumn("_first", F.row_number().over(Window.partitionBy(group, leaf).orderBy(*order)) == 1)
    placed = marked.withColumn("place", F.row_number().over(w.orderBy(F.col("_first").desc(), *order)).cast("long"))
    return placed.where(F.col("place") <= n).select(group, key, "place")
