"""Readers of plan-data files as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object a line, blank lines skipped. ``strict`` fails on a bad line, else it is dropped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def run_routes(run: DataFrame, budget: float | None = None) -> DataFrame:
    """(target, place, steps, stamp): routes paired by position with their stamps; beyond the budget, or without a stamp, they go.

    Without a budget the run was cut when it was written and every route stays.
    """
    zipped = run.select("target", F.posexplode(F.arrays_zip(F.col("routes").alias("steps"), F.col("found_at_calls").alias("stamp"))).alias("place", "z"))
    out = zipped.select("target", "place", "z.steps", "z.stamp").where(F.col("steps").isNotNull())
    return out if budget is None else out.where(F.col("stamp") <= budget)


def board_routes(run: DataFrame, budget: float) -> tuple[DataFrame, DataFrame]:
    """Routes within the budget of distinct molecules, union first; and the count of those left out for a missing stamp."""
    every = run.select("target", F.posexplode(F.concat(F.coalesce("routes_union", F.array()), F.coalesce("routes", F.array()))).alias("place", "r")).select("target", "place", "r.*")
    unstamped = every.where(F.col("found_at_unique").isNull() & F.col("found_at_calls").isNotNull()).agg(F.count(F.lit(1)).alias("unstamped"))
    return every.where(F.col("found_at_unique") <= budget), unstamped


def require_targets(run: DataFrame, need: int) -> DataFrame:
    """The run, if it covers at least ``need`` targets; an incomplete one is refused."""
    got = run.select("target").distinct().count()
    if got < need:
        raise ValueError(f"the run has {got} of {need} targets")
    return run


def candidate_routes(pooled: DataFrame) -> DataFrame:
    """Selected routes in order of (pareto_rank, first_rank), a missing rank as 99; ``place`` is the order within a target."""
    order = Window.partitionBy("target").orderBy(F.coalesce("pareto_rank", F.lit(99)), F.coalesce("first_rank", F.lit(99)))
    return pooled.where("sft_candidate").withColumn("place", F.row_number().over(order))


def menu(spark: SparkSession, path: str) -> DataFrame:
    """(product, idx, reactants, q) of a menu cache: one JSON object whose lists are [[reactants, q], ...]."""
    text = spark.read.text(path, wholetext=True)
    listed = F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("product", "menu")
    rows = text.select(listed).select("product", F.posexplode("menu").alias("idx", "pair"))
    reactants = F.array_sort(F.from_json(F.element_at("pair", 1), "array<string>"))
    return rows.select("product", "idx", reactants.alias("reactants"), F.element_at("pair", 2).cast("double").alias("q"))


def score_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, present) of a JSON object of nullable numbers: a null value is data."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,double>")).alias("key", "value")).withColumn("present", F.lit(True))


def prices(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(molecule, price) from CSV tables; rows without a number are skipped, the last file in order of name wins."""
    rows = spark.read.schema(schemas.PRICE).csv(paths, header=True).select(F.col("smi_can").alias("molecule"), F.expr("try_cast(price AS DOUBLE)").alias("price"), F.input_file_name().alias("file"))
    return rows.where("price IS NOT NULL").groupBy("molecule").agg(F.max_by("price", "file").alias("price"))


def stock(spark: SparkSession, path: str) -> DataFrame:
    """(molecule): one key a line."""
    return spark.read.text(path).select(F.trim("value").alias("molecule")).where("molecule <> ''").distinct()


def templates_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated template corpus; it must have the column retro_template."""
    df = spark.read.csv(path, sep="\t", header=True)
    if "retro_template" not in df.columns:
        raise ValueError("the file has no column retro_template")
    return df.where(F.col("retro_template").contains(">>"))


def named_reactions(spark: SparkSession, path: str) -> DataFrame:
    """(name, smarts) of a JSON-lines corpus; rows without a reaction arrow are skipped."""
    return jsonl(spark, path, "name string, smarts string", strict=False).where(F.col("smarts").contains(">>"))


def spend(spark: SparkSession, path: str) -> DataFrame:
    """(target, run, cost) of a JSON map target -> run -> cost."""
    text = spark.read.text(path, wholetext=True)
    outer = text.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("target", "runs"))
    return outer.select("target", F.explode("runs").alias("run", "cost"))
