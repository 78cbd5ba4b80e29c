"""Consensus queries: candidates are the suppliers offered for a part by each return flag, ranked by price."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.operators import consensus

from .roles import table

TOP = 5


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    return line.select(F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("backend"), (F.col("l_linenumber") - 1).alias("rank"))


CANDIDATES = "cand AS (SELECT l_partkey AS product, l_suppkey AS key, l_returnflag AS backend, l_linenumber - 1 AS rank FROM lineitem)"
BEST = "best AS (SELECT product, key, backend, min(coalesce(rank, 0)) AS rank, CASE backend WHEN {first} ELSE 1.0 END AS w FROM cand GROUP BY product, key, backend)"
PLAIN = BEST.format(first="'-' THEN 0.0")
#: Weights of the weighted queries; the third backend keeps the default of 1.
WEIGHTS = {"A": 0.5, "N": 2.0}
WEIGHTED = BEST.format(first="'A' THEN 0.5 WHEN 'N' THEN 2.0")
AGG = """agg AS (
  SELECT b.product, b.key, CAST(round(sum(w), 4) AS DOUBLE) AS votes, count(*) AS n_backends, round(avg(1.0 / (rank + 1)), 4) AS mrr, min(rank) AS best_rank, round(sum(CAST(w AS DOUBLE) / (60 + rank)), 6) AS rrf,
         CAST(round(coalesce(sum(w) FILTER (rank = 0), 0), 4) AS DOUBLE) AS plurality, round(sum(w) + avg(1.0 / (rank + 1)), 6) AS score, max(n_ok) AS n_ok, min(rank) FILTER (backend = pin) AS own_rank
  FROM best b JOIN (SELECT product, count(DISTINCT backend) AS n_ok, {pin} AS pin FROM cand GROUP BY product) n USING (product) GROUP BY b.product, b.key)"""
_SHOWN = "product, key, votes, n_backends, mrr, best_rank, rrf, plurality, round(n_backends / CAST(n_ok AS DOUBLE), 4) AS agreement, score, place"


def _sql(order: str, best: str = PLAIN, pin: str = "NULL", where: str = "true") -> str:
    return f"""WITH {CANDIDATES}, {best}, {AGG.format(pin=pin)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY {order}, key) AS place FROM agg WHERE {where})
SELECT {_SHOWN} FROM ranked WHERE place <= {TOP}"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("product", "key", "votes", "n_backends", "mrr", "best_rank", "rrf", "plurality", "agreement", "score", "place")


@query("consensus_vote", _sql("score DESC, best_rank"))
def consensus_vote(spark, sf):
    return _shown(consensus.rank(candidates(spark, sf), "vote", TOP))


@query("consensus_rrf", _sql("rrf DESC, best_rank"))
def consensus_rrf(spark, sf):
    return _shown(consensus.rank(candidates(spark, sf), "rrf", TOP))


@query("consensus_plurality", _sql("plurality DESC, rrf DESC"))
def consensus_plurality(spark, sf):
    return _shown(consensus.rank(candidates(spark, sf), "plurality", TOP))


@query("consensus_single", _sql("own_rank", pin="'R'", where="own_rank IS NOT NULL"))
def consensus_single(spark, sf):
    """Candidates of one named backend; products it did not answer for give nothing."""
    return _shown(consensus.rank(candidates(spark, sf), "single", TOP, pinned="R"))


@query("consensus_single_auto", _sql("own_rank", WEIGHTED, "min_by(backend, CASE backend WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END)", "own_rank IS NOT NULL"))
def consensus_single_auto(spark, sf):
    """The answering backend of the largest weight speaks for each product."""
    return _shown(consensus.rank(candidates(spark, sf), "single", TOP, weights=WEIGHTS, priority=("R", "A")))


@query("consensus_union", _sql("rrf DESC, best_rank"))
def consensus_union(spark, sf):
    return _shown(consensus.rank(candidates(spark, sf), "union", TOP))


@query("consensus_weighted", _sql("score DESC, best_rank", WEIGHTED))
def consensus_weighted(spark, sf):
    return _shown(consensus.rank(candidates(spark, sf), "vote", TOP, weights=WEIGHTS))


@query(
    "agreement_gate",
    f"""WITH {CANDIDATES}, {PLAIN},
top AS (SELECT product, backend, min(key) AS key FROM best WHERE rank = 0 GROUP BY product, backend),
tops AS (SELECT product, key, count(*) AS n, row_number() OVER (PARTITION BY product ORDER BY count(*) DESC, key) AS k FROM top GROUP BY product, key),
ok AS (SELECT product, count(DISTINCT backend) AS n_ok FROM cand GROUP BY product)
SELECT product, n_ok, key, coalesce(n, 0) AS agreement, coalesce(n, 0) < 2 AS abstained FROM ok LEFT JOIN (SELECT * FROM tops WHERE k = 1) USING (product)""",
)
def agreement_gate(spark, sf):
    return consensus.agreement_gate(candidates(spark, sf), 2)


@query(
    "mass_guard",
    """SELECT l_returnflag AS backend, count(*) AS offered, count(*) FILTER (p_size - l_quantity <= 10) AS kept, count(*) FILTER (NOT (coalesce(p_size - l_quantity <= 10, false))) AS rejected
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag""",
)
def mass_guard(spark, sf):
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    offered = line.join(part, line["l_partkey"] == part["p_partkey"], "left").select(F.col("l_returnflag").alias("backend"), "l_quantity", "p_size")
    kept = consensus.mass_guard(offered, "l_quantity", "p_size", 10).groupBy("backend").agg(F.count(F.lit(1)).alias("kept"))
    counts = offered.groupBy("backend").agg(F.count(F.lit(1)).alias("offered"))
    return counts.join(kept, "backend", "left").select("backend", "offered", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), (F.col("offered") - F.coalesce("kept", F.lit(0))).alias("rejected"))


_VOTED = f"""WITH {CANDIDATES}, {PLAIN}, {AGG.format(pin='NULL')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY score DESC, best_rank, key) AS place, votes > 1 AS matched FROM agg)
"""


def _voted(spark, sf):
    return consensus.rank(candidates(spark, sf), "vote", 1_000_000).withColumn("matched", F.col("votes") > 1)


@query("soft_roundtrip", _VOTED + "SELECT product, key, place, matched, row_number() OVER (PARTITION BY product ORDER BY matched DESC, place) AS place_after FROM ranked")
def soft_roundtrip(spark, sf):
    return consensus.roundtrip_filter(_voted(spark, sf), "matched", "soft").select("product", "key", "place", "matched", "place_after")


@query(
    "hard_roundtrip",
    _VOTED + """, kept AS (SELECT * FROM (SELECT *, max(CAST(matched AS INT)) OVER (PARTITION BY product) AS any_match FROM ranked) WHERE matched OR any_match = 0)
SELECT product, key, place, matched, row_number() OVER (PARTITION BY product ORDER BY place) AS place_after FROM kept""",
)
def hard_roundtrip(spark, sf):
    return consensus.roundtrip_filter(_voted(spark, sf), "matched", "hard").select("product", "key", "place", "matched", "place_after")


@query(
    "menu_weights",
    _VOTED + """, raw AS (SELECT product, key, place, coalesce(CASE WHEN votes > 1 THEN score END, CASE WHEN best_rank < 3 THEN rrf END, CASE WHEN best_rank < 5 THEN CAST(votes AS DOUBLE) END, 1.0 / place) AS w FROM ranked)
SELECT product, key, place, round(w / sum(w) OVER (PARTITION BY product), 4) AS weight FROM raw""",
)
def menu_weights(spark, sf):
    seen = _voted(spark, sf).select(
        "product", "key", "place", (F.col("place") - 1).alias("position"), F.when(F.col("votes") > 1, F.col("score")).alias("score"), F.when(F.col("best_rank") < 3, F.col("rrf")).alias("rrf"), F.when(F.col("best_rank") < 5, F.col("votes")).alias("votes")
    )
    return consensus.normalised_weights(seen).select("product", "key", "place", F.round("weight", 4).alias("weight"))
