"""Exact values at positions of a sorted column, by counts.

Two passes: rows are counted by cell of the value, the cells that hold the wanted positions are found from running
sums over cells, and only their rows are counted by value. A task never sorts or holds a group's rows: what a
window runs over is the number of cells, then the number of different values of a cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 4096


def at_positions(df: DataFrame, group: list[str], value: str, positions: dict[str, Callable[[Column], Column]], cell: int = CELL) -> DataFrame:
    """(group, names): the values at positions (from 0, as functions of the group's row count) of a whole-number column.

    Rows with a null value are left out. ``df`` is read twice, so it should be a table or a saved result.
    """
    rows = df.select(*group, F.col(value).cast("long").alias("_value")).where("_value IS NOT NULL").withColumn("_cell", F.floor(F.col("_value") / cell))
    own = Window.partitionBy(*group)
    cells = rows.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("_to", F.sum("_n").over(own.orderBy("_cell"))).withColumn("_all", F.sum("_n").over(own))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("_all")).cast("long").alias("at")) for name, place in positions.items()]))
    wanted = cells.withColumn("_w", wanted).where("_w.at >= _to - _n AND _w.at < _to").select(*group, "_cell", "_w.name", (F.col("_w.at") - F.col("_to") + F.col("_n")).alias("_at"))
    within = rows.join(wanted.select(*group, "_cell").distinct(), [*group, "_cell"], "left_semi").groupBy(*group, "_cell", "_value").agg(F.count(F.lit(1)).alias("_k"))
    within = within.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*group, "_cell").orderBy("_value")))
    found = within.join(wanted, [*group, "_cell"]).where("_at >= _upto - _k AND _at < _upto")
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("name") == name, F.col("_value"))).alias(name) for name in positions])


def medians(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, median): the mean of the two middle values."""
    middle = at_positions(df, group, value, {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)})
    return middle.select(*group, ((F.col("_low") + F.col("_high")) / 2).alias("median"))
