"""Files written by the writers and read back by the readers: each query returns what came back, its SQL what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.sources import readers, schemas, writers

from .roles import table
from .workspace import new_folder


def _lines(df: DataFrame, line, name: str) -> str:
    path = new_folder(df.sparkSession, name)
    df.select(line.alias("value")).write.text(path)
    return path


def _objects(rows: DataFrame, part: str, key, value, name: str) -> str:
    """One JSON object a file, a file for each value of ``part``: the layout of cache files."""
    path = new_folder(rows.sparkSession, name)
    entries = F.map_from_entries(F.collect_list(F.struct(key, value)))
    rows.groupBy(F.col(part).alias("part")).agg(F.to_json(entries, {"ignoreNullFields": "false"}).alias("value")).write.partitionBy("part").text(path)
    return path


@query("read_json_lines", "SELECT o_orderkey AS key, o_orderpriority AS name, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 5 > 1")
def read_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Blank and broken lines of a JSON-lines file are skipped."""
    o = table(spark, sf, "orders")
    good = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("name"), F.round("o_totalprice", 2).alias("price")))
    line = F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 5 == 1, '{"key": 1, "name": "cut').otherwise(good)
    return readers.jsonl(spark, _lines(o, line, "lines"), "key long, name string, price double", strict=False)


def _runs(spark, sf) -> DataFrame:
    """Run records: a customer's orders as routes of one step, their places as stamps; some stamps are missing."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    step = F.array(F.struct(F.col("o_orderpriority").alias("product"), F.array(F.col("o_orderkey").cast("string")).alias("reactants")))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", step.alias("s")))).alias("a"))
    stamps = F.transform("a", lambda x, i: F.when(x["o_orderkey"] % 4 > 0, i + 1.0))
    return g.select(F.col("o_custkey").cast("string").alias("target"), F.transform("a", lambda x: x["s"]).alias("routes"), stamps.alias("found_at_calls"))


_RUN = "r AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)"


@query("read_run_routes", f"WITH {_RUN} SELECT CAST(o_custkey AS VARCHAR) AS target, CAST(k - 1 AS INT) AS place, o_orderpriority AS product, CAST(k AS DOUBLE) AS stamp FROM r WHERE o_orderkey % 4 > 0 AND k <= 5")
def read_run_routes(spark, sf):
    """Routes of a run file paired with their stamps; a missing stamp or one beyond the budget drops the route."""
    path = new_folder(spark, "runs")
    writers.jsonl(_runs(spark, sf), path)
    run = readers.require_targets(readers.jsonl(spark, path, schemas.RUN), 1)
    return readers.run_routes(run, 5).select("target", "place", F.col("steps")[0]["product"].alias("product"), "stamp")


@query("read_board_routes", f"WITH {_RUN}, u AS (SELECT *, 0 AS part FROM r WHERE o_orderkey % 2 = 0 UNION ALL SELECT *, 1 FROM r) SELECT CAST(o_custkey AS VARCHAR) AS target, part = 0 AS from_union, CAST(k AS DOUBLE) AS found_at_unique, count(*) AS n FROM u WHERE o_orderkey % 3 > 0 AND k <= 4 GROUP BY ALL")
def read_board_routes(spark, sf):
    """A board run's pooled routes, then the reported ones, within the budget of distinct molecules."""
    o = table(spark, sf, "orders")
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"))
    route = lambda key, i, union: F.struct(F.array().cast(f"array<{schemas.STEP}>").alias("steps"), F.lit(9.0).alias("found_at_calls"), F.when(key % 3 > 0, i + 1.0).alias("found_at_unique"), F.lit(union).alias("found_at_episode"))
    numbered = F.transform("a", lambda x, i: F.struct(x.alias("key"), i.alias("i")))
    union = F.transform(F.filter(numbered, lambda x: x["key"] % 2 == 0), lambda x: route(x["key"], x["i"], 0))
    every = F.transform(numbered, lambda x: route(x["key"], x["i"], 1))
    path = new_folder(spark, "board")
    writers.jsonl(g.select(F.col("o_custkey").cast("string").alias("target"), every.alias("routes"), union.alias("routes_union")), path)
    kept, _ = readers.board_routes(readers.jsonl(spark, path, schemas.BOARD), 4)
    return kept.groupBy("target", (F.col("found_at_episode") == 0).alias("from_union"), "found_at_unique").agg(F.count(F.lit(1)).alias("n"))


@query(
    "read_candidate_routes",
    "SELECT CAST(o_custkey AS VARCHAR) AS target, CAST(o_orderkey AS DOUBLE) AS stamp, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END, 99), o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'P'",
)
def read_candidate_routes(spark, sf):
    """Selected pooled routes in order of front and rank, a missing front last."""
    o = table(spark, sf, "orders")
    pooled = o.select(
        F.col("o_custkey").cast("string").alias("target"), F.array().cast(f"array<{schemas.STEP}>").alias("steps"), F.array().cast("array<array<string>>").alias("sources"), F.col("o_orderkey").cast("double").alias("found_at_calls"),
        F.col("o_orderkey").cast("int").alias("first_rank"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 3).cast("int").alias("pareto_rank"), (F.col("o_orderstatus") != "P").alias("sft_candidate"),
    )
    path = new_folder(spark, "pooled")
    writers.jsonl(pooled, path)
    read = readers.jsonl(spark, path, schemas.POOLED)
    # A first rank over 99 comes after a missing one; the made-up ranks are order keys, so only order within them counts.
    return readers.candidate_routes(read).select("target", F.col("found_at_calls").alias("stamp"), F.col("place").cast("long").alias("place"))


@query("read_menu", "SELECT CAST(l_partkey AS VARCHAR) AS product, row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey) - 1 AS idx, least(CAST(l_suppkey AS VARCHAR), 'z' || l_suppkey % 3) || '.' || greatest(CAST(l_suppkey AS VARCHAR), 'z' || l_suppkey % 3) AS reactants, q FROM (SELECT l_partkey, l_suppkey, max(l_discount) AS q FROM lineitem GROUP BY ALL)")
def read_menu(spark, sf):
    """Menu caches, one JSON object a file: lists of reactants and confidence become rows, reactants sorted."""
    m = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_discount").alias("q"))
    pair = F.array(F.to_json(F.array(F.concat(F.lit("z"), (F.col("l_suppkey") % 3).cast("string")), F.col("l_suppkey").cast("string"))), F.col("q").cast("string"))
    listed = m.groupBy("l_partkey").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("q")).alias("n"), "l_suppkey", pair.alias("p")))), lambda x: x["p"]).alias("menu"))
    path = _objects(listed.withColumn("part", F.col("l_partkey") % 16), "part", F.col("l_partkey").cast("string"), F.col("menu"), "menus")
    return readers.menu(spark, path).select("product", F.col("idx").cast("long").alias("idx"), F.array_join("reactants", ".").alias("reactants"), "q")


@query("read_score_cache", "SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_size > 10 THEN p_retailprice END AS value, true AS present FROM part")
def read_score_cache(spark, sf):
    """A null in a score cache is data: asked, and failed."""
    p = table(spark, sf, "part").withColumn("part", F.col("p_partkey") % 8)
    return readers.score_cache(spark, _objects(p, "part", F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 10, F.col("p_retailprice")), "scores"))


@query("read_prices", "SELECT 'm' || p_partkey AS molecule, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS price FROM part WHERE p_partkey % 5 > 0 OR p_partkey % 2 = 0")
def read_prices(spark, sf):
    """Price tables: rows without a number are skipped, the later file wins."""
    p = table(spark, sf, "part").withColumn("smi_can", F.concat(F.lit("m"), F.col("p_partkey").cast("string")))
    base = new_folder(spark, "prices")
    p.select("smi_can", F.when(F.col("p_partkey") % 5 > 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("price")).write.csv(f"{base}/a", header=True)
    p.where("p_partkey % 2 = 0").select("smi_can", (F.col("p_retailprice") + 1).cast("string").alias("price")).write.csv(f"{base}/b", header=True)
    return readers.prices(spark, [f"{base}/a", f"{base}/b"])


@query("read_stock", "SELECT DISTINCT 'm' || l_partkey AS molecule FROM lineitem")
def read_stock(spark, sf):
    """One key a line, blanks trimmed, each key once."""
    line = table(spark, sf, "lineitem")
    key = F.when(F.col("l_linenumber") > 1, F.concat(F.lit("  m"), F.col("l_partkey").cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("m"), F.col("l_partkey").cast("string")))
    return readers.stock(spark, _lines(line.select(F.explode(F.array(key, F.lit("  "))).alias("k")), F.col("k"), "stock"))


@query("read_templates", "SELECT p_brand || '>>' || p_type AS retro_template, CAST(p_size AS VARCHAR) AS occurrence FROM part WHERE p_size % 4 > 0")
def read_templates(spark, sf):
    """A tab-separated template corpus; rows without a reaction arrow are left out."""
    p = table(spark, sf, "part")
    path = new_folder(spark, "templates")
    arrow = F.when(F.col("p_size") % 4 > 0, ">>").otherwise(">")
    p.select(F.concat("p_brand", arrow, F.col("p_type")).alias("retro_template"), F.col("p_size").alias("occurrence")).write.csv(path, sep="\t", header=True)
    return readers.templates_tsv(spark, path)


@query("read_named_reactions", "SELECT p_brand AS name, p_type || '>>' AS smarts FROM part WHERE p_size % 3 > 0")
def read_named_reactions(spark, sf):
    p = table(spark, sf, "part")
    good = F.to_json(F.struct(F.col("p_brand").alias("name"), F.concat("p_type", F.when(F.col("p_size") % 3 == 1, ">>").otherwise(">>")).alias("smarts")))
    line = F.when(F.col("p_size") % 3 > 0, good).when(F.col("p_size") % 2 == 0, '{"name": "no arrow", "smarts": "C"}').otherwise("{")
    return readers.named_reactions(spark, _lines(p, line, "named"))


@query("read_spend", "SELECT CAST(o_custkey AS VARCHAR) AS target, o_orderpriority AS run, CAST(count(*) AS DOUBLE) AS cost FROM orders GROUP BY ALL")
def read_spend(spark, sf):
    """Spend of each target and run from nested JSON maps."""
    cost = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("cost"))
    runs = cost.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "cost"))).alias("runs")).withColumn("part", F.col("o_custkey") % 8)
    return readers.spend(spark, _objects(runs, "part", F.col("o_custkey").cast("string"), F.col("runs"), "spend"))


@query("write_json_lines", "SELECT count(*) AS rows_written FROM orders")
def write_json_lines(spark, sf):
    """The number of rows that a JSON-lines write reports, read back from the file."""
    n = writers.jsonl(table(spark, sf, "orders"), new_folder(spark, "orders"))
    return spark.range(1).select(F.lit(n).cast("long").alias("rows_written"))


@query("write_merged_cache", "SELECT count(*) FILTER (p_size > 20) AS kept, count(*) FILTER (p_size <= 20 AND p_partkey % 3 > 0) AS added FROM part")
def write_merged_cache(spark, sf):
    """Shard caches folded into a new version of the base: what is there stays, what is new is added."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("value"), "p_size")
    shards = [p.where(f"key % 3 = {i}").select("key", (F.col("value") + 1).alias("value")) for i in (1, 2)]
    r = writers.merged_cache(p.where("p_size > 20").select("key", "value"), shards, "key", new_folder(spark, "cache"))
    return spark.range(1).select(F.lit(r["kept"]).cast("long").alias("kept"), F.lit(r["added"]).cast("long").alias("added"))


@query("write_draws", "SELECT p_partkey AS key, p_retailprice AS value FROM part WHERE p_size <= 30")
def write_draws(spark, sf):
    """Draws appended in two rounds; keys that the read-only base covers are left out."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("value"), "p_size")
    covered, path = p.where("p_size > 30").select("key"), new_folder(spark, "draws")
    for parity in (0, 1):
        writers.append_draws(p.where(f"key % 2 = {parity}").select("key", "value"), covered, "key", path)
    return spark.read.parquet(path)


@query("write_slim", "SELECT o_orderkey, o_orderstatus FROM orders")
def write_slim(spark, sf):
    """Only the fields that training reads."""
    path = new_folder(spark, "slim")
    writers.slim(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "no_such_field"]).write.parquet(path)
    return spark.read.parquet(path)
