"""The roles of the domain read from the star-schema tables, as DataFrames and as SQL for the oracles.

target: customer; route: order; step: line; product: part; reactant: supplier; plausibility: discount;
round-trip rank: line number; price: extended or retail price; stock: parts of size up to 40; model: return
flag; arm: order priority; gold: finished orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STOCK_SIZE = 40
CUT = 0.05
RANK_CUT = 5
PRICE_CAP = 100_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame) -> DataFrame:
    """The rows of a table as read, with their place in its files as ``at``."""
    return df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))


def running(value: str, *keys: str) -> Column:
    """Sum of the group's values up to this row, in the order of ``at``; the last one is the group's sum.

    Sums of doubles depend on their order. A plain sum takes that of the tasks that read the rows; this is the order of
    the files on any cluster, which is also what the SQL sums by on one thread. No task holds a group.
    """
    return F.sum(value).over(Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def steps(spark: SparkSession, sf_dir: str, at: bool = False) -> DataFrame:
    """(target, route, pos, product, reactant, p, rt, price, model, arm, made, gold), and the line's place if asked."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    line = placed(line) if at else line
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag")
    ranked = line.withColumn("pos", F.row_number().over(order))
    return ranked.join(orders, ranked["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("target"),
        F.col("l_orderkey").alias("route"),
        F.col("pos").cast("long").alias("pos"),
        F.col("l_partkey").alias("product"),
        F.col("l_suppkey").alias("reactant"),
        F.col("l_discount").alias("p"),
        F.col("l_linenumber").alias("rt"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("model"),
        F.col("o_orderpriority").alias("arm"),
        F.col("o_orderdate").alias("made"),
        (F.col("o_orderstatus") == "F").alias("gold"),
        *["at"] * at,
    )


STEPS = """steps AS (
  SELECT o_custkey AS target, l_orderkey AS route,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_returnflag) AS pos,
         l_partkey AS product, l_suppkey AS reactant, l_discount AS p, l_linenumber AS rt, l_extendedprice AS price,
         l_returnflag AS model, o_orderpriority AS arm, o_orderdate AS made, o_orderstatus = 'F' AS gold
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(molecule, in_stock, price, size, kind)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("molecule"), (F.col("p_size") <= STOCK_SIZE).alias("in_stock"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name")
    )


MOLECULES = f"""molecules AS (
  SELECT p_partkey AS molecule, p_size <= {STOCK_SIZE} AS in_stock, p_retailprice AS price, p_size AS size, p_type AS kind, p_brand AS brand, p_name AS name FROM part)"""


def sql(*parts: str) -> str:
    """CTEs and the final select as one statement."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
