"""Consensus of several models' ranked candidates.

A candidate is (product, key, backend, rank). A null rank counts as 0, the best; a candidate without a key is
left out. Of a backend's repeats the best rank stays. Votes, reciprocal rank fusion and first-place votes are
sums of the backends' weights (1 where none is given), the mean reciprocal rank is not weighted, and all of it is
one aggregation per (product, key). Figures are rounded before they order anything, as they are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
BACKBONES = ("vote", "rrf", "plurality", "single", "union")


def _weight(weights: dict[str, float] | None) -> Column:
    given = [F.lit(x) for pair in (weights or {}).items() for x in (pair[0], float(pair[1]))]
    return F.coalesce(F.element_at(F.create_map(*given), F.col("backend")), F.lit(1.0)) if given else F.lit(1.0)


def _best(candidates: DataFrame) -> DataFrame:
    named = candidates.where(F.col("key").isNotNull())
    return named.groupBy("product", "key", "backend").agg(F.min(F.coalesce("rank", F.lit(0))).alias("rank"))


def answered(candidates: DataFrame) -> DataFrame:
    """(product, backend) of the backends that gave any candidate."""
    return candidates.select("product", "backend").distinct()


def aggregate(candidates: DataFrame, weights: dict[str, float] | None = None, ok: DataFrame | None = None, pinned: DataFrame | None = None) -> DataFrame:
    """(product, key, votes, n_backends, mrr, best_rank, rrf, plurality, agreement, score, own_rank).

    ``ok`` (product, backend): the backends that answered, with or without candidates; agreement is the share of
    them that propose the key. ``own_rank`` is the rank given by the product's ``pinned`` backend (product, pin).
    """
    best = _best(candidates)
    asked = (ok if ok is not None else answered(candidates)).groupBy("product").agg(F.count_distinct("backend").alias("n_ok"))
    w = _weight(weights)
    own = F.lit(None).cast("long")
    if pinned is not None:
        best = best.join(pinned, "product")
        own = F.min(F.when(F.col("backend") == F.col("pin"), F.col("rank")))
    out = best.groupBy("product", "key").agg(
        F.sum(w).alias("v"),
        F.count(F.lit(1)).alias("n_backends"),
        F.avg(1.0 / (F.col("rank") + 1)).alias("m"),
        F.min("rank").alias("best_rank"),
        F.round(F.sum(w / (RRF_K + F.col("rank"))), 6).alias("rrf"),
        F.round(F.sum(F.when(F.col("rank") == 0, w).otherwise(0.0)), 4).alias("plurality"),
        own.alias("own_rank"),
    )
    return out.join(asked, "product").select(
        "product",
        "key",
        F.round("v", 4).alias("votes"),
        "n_backends",
        F.round("m", 4).alias("mrr"),
        "best_rank",
        "rrf",
        "plurality",
        F.round(F.col("n_backends") / F.col("n_ok"), 4).alias("agreement"),
        F.round(F.col("v") + F.col("m"), 6).alias("score"),
        "own_rank",
    )


def pins(candidates: DataFrame, pinned: str | None, weights: dict[str, float] | None = None, priority: tuple[str, ...] = (), ok: DataFrame | None = None) -> DataFrame:
    """(product, pin): the backend that ``single`` listens to. A named one must have answered, else the product has none.

    None or ``auto``: the answering backend of the largest weight, then the earliest in ``priority``, then by name.
    """
    seen = ok if ok is not None else answered(candidates)
    if pinned and pinned != "auto":
        return seen.where(F.col("backend") == pinned).select("product", F.col("backend").alias("pin")).distinct()
    place = F.coalesce(*[F.when(F.col("backend") == b, F.lit(i)) for i, b in enumerate(priority)], F.lit(len(priority)))
    return seen.groupBy("product").agg(F.min_by("backend", F.struct(-_weight(weights), place, F.col("backend"))).alias("pin"))


def rank(candidates: DataFrame, backbone: str, top_k: int = 10, pinned: str | None = None, weights: dict[str, float] | None = None, priority: tuple[str, ...] = (), ok: DataFrame | None = None) -> DataFrame:
    """Candidates of each product in the backbone's order, ``place`` from 1 to top_k (at least 1).

    ``vote``: votes plus mean reciprocal rank. ``rrf`` and ``union``: fused reciprocal ranks. ``plurality``:
    first-place votes, then fused ranks. ``single``: the candidates of one backend in its own order, with the
    figures of all backends. Further ties go to the better best rank (vote, rrf, union), then to the key.
    """
    if backbone not in BACKBONES:
        raise ValueError(f"backbone {backbone!r} is not one of {BACKBONES}")
    if backbone == "single":
        found = aggregate(candidates, weights, ok, pins(candidates, pinned, weights, priority, ok)).where(F.col("own_rank").isNotNull())
        order = [F.col("own_rank")]
    else:
        found = aggregate(candidates, weights, ok)
        order = {
            "vote": [F.col("score").desc(), F.col("best_rank")],
            "rrf": [F.col("rrf").desc(), F.col("best_rank")],
            "union": [F.col("rrf").desc(), F.col("best_rank")],
            "plurality": [F.col("plurality").desc(), F.col("rrf").desc()],
        }[backbone]
    w = Window.partitionBy("product").orderBy(*order, F.col("key"))
    return found.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= max(top_k, 1))


def agreement_gate(candidates: DataFrame, tau: int, ok: DataFrame | None = None) -> DataFrame:
    """(product, n_ok, key, agreement, abstained): how many backends put the most frequent first pick first.

    A backend's first pick is its candidate of rank 0 (the smallest key of several); a backend without one gives
    no pick. With ``tau`` above 0 a product abstains if fewer than ``tau`` backends agree.
    """
    top = _best(candidates).where("rank = 0").groupBy("product", "backend").agg(F.min("key").alias("key"))
    tops = top.groupBy("product", "key").agg(F.count(F.lit(1)).alias("n"))
    lead = tops.groupBy("product").agg(F.min(F.struct((-F.col("n")).alias("less"), "key")).alias("lead")).select("product", "lead.key", (-F.col("lead.less")).alias("n"))
    asked = (ok if ok is not None else answered(candidates)).groupBy("product").agg(F.count_distinct("backend").alias("n_ok"))
    agreement = F.coalesce("n", F.lit(0).cast("long"))
    return asked.join(lead, "product", "left").select("product", "n_ok", "key", agreement.alias("agreement"), (F.lit(tau > 0) & (agreement < tau)).alias("abstained"))


def mass_guard(candidates: DataFrame, weight: str, whole: str, slack: float) -> DataFrame:
    """Candidates whose product weighs at most ``slack`` more than their parts; unknown weights fail."""
    return candidates.where(F.coalesce(F.col(whole) - F.col(weight) <= slack, F.lit(False)))


def normalised_weights(candidates: DataFrame) -> DataFrame:
    """Weight: score, else rrf, else votes, else 1/(position+1); then shares of each product's total."""
    raw = F.coalesce("score", "rrf", F.col("votes").cast("double"), 1.0 / (F.col("position") + 1))
    return candidates.withColumn("weight", raw / F.sum(raw).over(Window.partitionBy("product")))


def roundtrip_filter(candidates: DataFrame, matched: str, mode: str) -> DataFrame:
    """``off``: as is; ``soft``: matched first, else in order; ``hard``: matched only, unless a product has none."""
    w = Window.partitionBy("product")
    if mode == "hard":
        candidates = candidates.withColumn("_any", F.max(F.col(matched).cast("int")).over(w)).where(F.col(matched) | (F.col("_any") == 0)).drop("_any")
    first = [F.col(matched).desc()] if mode == "soft" else []
    return candidates.withColumn("place_after", F.row_number().over(w.orderBy(*first, "place")).cast("long"))
