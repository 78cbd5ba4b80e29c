"""Token losses over arrays of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label of positions that are not trained (fixed value).
IGNORED = -100


def cross_entropy(scores: Column, label: Column) -> Column:
    """Negative log-likelihood of ``label`` (from 0) under the softmax of ``scores``; zero for ignored labels.

    The largest score is taken out first, so no exponential overflows.
    """
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))
    return F.when(label == IGNORED, 0.0).otherwise(top + F.log(total) - F.get(scores, label).cast("double"))


def role_losses(tokens: DataFrame, group: list[str]) -> DataFrame:
    """(group, role, tokens, loss, accuracy, share) over (group, role, nll, correct, label); ignored labels count nowhere."""
    ok = tokens.where(F.col("label") != IGNORED)
    per = ok.groupBy(*group, "role").agg(F.count(F.lit(1)).alias("tokens"), F.avg("nll").alias("loss"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    every = per.groupBy(*group).agg(F.sum("tokens").alias("_all"))
    return per.join(every, group).withColumn("share", F.col("tokens") / F.col("_all")).drop("_all")


def action_exact(tokens: DataFrame, group: list[str], span: str) -> DataFrame:
    """(group, spans, exact): spans with a trained token, and the share of them whose trained tokens are all right."""
    own = tokens.where((F.col("label") != IGNORED) & (F.col(span) >= 0)).groupBy(*group, span).agg(F.min(F.col("correct").cast("int")).alias("ok"))
    return own.groupBy(*group).agg(F.count(F.lit(1)).alias("spans"), F.avg("ok").alias("exact"))
