"""Actions of an agent: a line grammar, a JSON form, comparison of two actions, rates from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERBS = ("open", "rank", "dead", "done", "terminate", "single")
REASONS = ("floor", "cutoff", "exhausted")
#: Schema of the JSON form.
SCHEMA = "actions array<struct<type:string,mid:string,`order`:array<int>,take:int,reason:string,mids:array<string>>>"


def parse_line(text: Column) -> Column:
    """``open X``, ``rank X c0,c1``, ``dead X reason``, ``done a.c0 b.c9``, ``terminate``: verb, id, candidates; null if none fits."""
    t = F.trim(text)
    verb = F.regexp_extract(t, r"^(open|rank|dead|done|terminate|single)\b", 1)
    mid = F.regexp_extract(t, r"^\w+\s+([A-Za-z0-9]+)", 1)
    cands = F.transform(F.regexp_extract_all(t, F.lit(r"\bc(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    shaped = (
        F.when(verb.isin("open", "single"), t.rlike(r"^\w+\s+[A-Za-z0-9]+$"))
        .when(verb == "rank", t.rlike(r"^rank\s+[A-Za-z0-9]+\s+c\d+(,c\d+)*$"))
        .when(verb == "dead", t.rlike(r"^dead\s+[A-Za-z0-9]+\s+(floor|cutoff|exhausted)$"))
        .when(verb == "done", t.rlike(r"^done(\s+[A-Za-z0-9]+\.c\d+)*$"))
        .when(verb == "terminate", t == "terminate")
        .otherwise(F.lit(False))
    )
    return F.when(shaped, F.struct(verb.alias("verb"), F.nullif(mid, F.lit("")).alias("mid"), cands.alias("cands")))


def reject_json(payload: Column) -> Column:
    """The first reason for which a JSON payload is not a valid call; null if it is valid."""
    p = F.from_json(payload, SCHEMA)
    a = p["actions"]
    bad = lambda test: F.exists(a, lambda x: F.coalesce(test(x), F.lit(False)))
    return (
        F.when(p.isNull() | a.isNull(), "not_json")
        .when(F.size(a) == 0, "empty")
        .when(F.exists(a, lambda x: F.coalesce(~x["type"].isin(*VERBS), F.lit(True))), "unknown_verb")
        .when(bad(lambda x: (x["type"] == "rank") & (x["order"].isNull() | (F.size(x["order"]) == 0))), "rank_without_order")
        .when(bad(lambda x: (x["type"] == "rank") & (F.size(F.array_distinct(x["order"])) < F.size(x["order"]))), "repeated_candidate")
        .when(bad(lambda x: x["type"].isin("open", "rank", "dead") & x["mid"].isNull()), "missing_molecule")
        .when(bad(lambda x: (x["type"] == "dead") & ~F.coalesce(x["reason"].isin(*REASONS), F.lit(False))), "unknown_reason")
    )


def compare(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Field-by-field comparison of (key, verb, mid, cands); a prediction that is absent or unparsable fails all."""
    g = gold.select(key, *[F.col(c).alias(f"g_{c}") for c in ("verb", "mid", "cands")])
    j = g.join(predicted.select(key, "verb", "mid", "cands"), key, "left")
    no = F.lit(False)
    parsed = F.col("verb").isNotNull()
    return j.select(
        key,
        parsed.alias("parsed"),
        F.coalesce(F.col("verb") == F.col("g_verb"), no).alias("verb_ok"),
        F.coalesce(F.col("mid").eqNullSafe(F.col("g_mid")) & parsed, no).alias("mid_ok"),
        F.coalesce(F.get("cands", F.lit(0)).eqNullSafe(F.get("g_cands", F.lit(0))) & parsed, no).alias("head_ok"),
        F.coalesce(F.array_sort("cands") == F.array_sort("g_cands"), no).alias("set_ok"),
        F.coalesce((F.col("cands") == F.col("g_cands")) & (F.col("verb") == F.col("g_verb")) & F.col("mid").eqNullSafe(F.col("g_mid")), no).alias("exact"),
    )


def rates(compared: DataFrame, flags: list[str], group: list[str]) -> DataFrame:
    """Counts are summed first and divided last."""
    sums = compared.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    return sums.select(*group, "n", *[F.round(F.col(f) / F.greatest("n", F.lit(1)), 4).alias(f) for f in flags])
