"""What the services answer, as queries: uniform candidates of any backend, one-step proposals, board text, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import board_text, consensus, turn_text

ROW = "struct<molecules:array<string>,smiles:string,precursors:array<string>,score:double,confidence:double,rank:int,role:string>"
RESPONSE = f"error string, candidates array<{ROW}>, predictions array<{ROW}>, precursors array<{ROW}>"


def normalized(responses: DataFrame) -> DataFrame:
    """(key, backend, rank, molecules, score, role) of backends' JSON answers (key, backend, body).

    Candidates stand under one of three names; their molecules in a list or in one string with dots; the score under one
    of two names; a missing rank is the place in the list. Answers with an error and rows without molecules give nothing.
    """
    r = responses.select("key", "backend", F.from_json("body", RESPONSE).alias("r")).where("r IS NOT NULL AND r.error IS NULL")
    listed = F.coalesce("r.candidates", F.when(F.size("r.predictions") > 0, F.col("r.predictions")), "r.precursors")
    c = r.select("key", "backend", F.posexplode(listed).alias("at", "c"))
    split = F.filter(F.split("c.smiles", r"\.", -1), lambda x: x != "")
    molecules = F.coalesce(F.when(F.size("c.molecules") > 0, F.col("c.molecules")), F.when(F.size("c.precursors") > 0, F.col("c.precursors")), split)
    out = c.select("key", "backend", F.coalesce("c.rank", "at").alias("rank"), molecules.alias("molecules"), F.coalesce("c.score", "c.confidence").alias("score"), F.col("c.role").alias("role"))
    return out.where(F.size("molecules") > 0)


def single_step(candidates: DataFrame, in_stock: DataFrame, backbone: str, top_k: int, **how) -> DataFrame:
    """Proposals of each product in the backbone's order, with the share of their pieces in stock (product, key, share)."""
    ranked = consensus.rank(candidates, backbone, top_k, **how)
    return ranked.join(in_stock, ["product", "key"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))


def annotations(rows: DataFrame) -> DataFrame:
    """(key, note): the key under any of its three names; the first note of a key in file order stays."""
    named = rows.withColumn("key", F.coalesce("key", "smiles", "rxn_key")).where("key IS NOT NULL")
    return named.groupBy("key").agg(F.min_by("note", "line").alias("note"))


def enabled(models: DataFrame, task: str) -> DataFrame:
    """Models that are switched on for the task, in order of name."""
    return models.where(F.col("on") & F.array_contains("tasks", task)).orderBy("model")


def axis_key(axis: str, signal: Column, ln_prices: Column) -> Column:
    """A key that sorts better candidates first: cost low, rank low with unknown ones last, other signals high; null cannot be ordered."""
    if axis == "cost":
        whole = (F.size(ln_prices) > 0) & F.forall(ln_prices, lambda p: p.isNotNull())
        total = F.log(F.aggregate(ln_prices, F.lit(0.0), lambda a, p: a + F.exp(p)))
        return F.when(whole, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (total - 2.5) / 9.0)), 3))
    if axis == "rt":
        return F.coalesce(signal.cast("double"), F.lit(float("inf")))
    return -signal.cast("double")


def board_page(steps: DataFrame, open_molecules: DataFrame, menus: DataFrame, closed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(board, text): budget, ledger, open molecules with their menus, and what is closed.

    ``steps`` (board, step, parent, cand, status, n_closed, n_pieces), ``open_molecules`` (board, place, mid, under),
    ``menus`` (board, mid, idx, line), ``closed`` (board, mid), ``budgets`` (board, left, total).
    """
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "")
    row = turn_text.ledger_row(F.concat(F.lit("r"), F.col("step").cast("string")), F.col("parent"), F.col("cand"), F.col("status"), F.col("n_closed"), F.col("n_pieces"))
    ledger = steps.groupBy("board").agg(joined(F.array_sort(F.collect_list(F.struct("step", F.concat(row, F.lit("\n")).alias("line"))))).alias("ledger"))
    lines = menus.groupBy("board", "mid").agg(joined(F.array_sort(F.collect_list(F.struct("idx", F.concat(F.lit("    "), "line", F.lit("\n")).alias("line"))))).alias("menu"))
    head = F.concat(F.lit("  "), "mid", F.lit(" under "), "under", F.lit("\n"), F.coalesce("menu", F.lit("")))
    opened = open_molecules.join(lines, ["board", "mid"], "left").groupBy("board").agg(F.count(F.lit(1)).alias("n"), joined(F.array_sort(F.collect_list(F.struct("place", head.alias("line"))))).alias("open"))
    done = closed.groupBy("board").agg(F.array_join(F.array_sort(F.collect_set("mid")), " ").alias("closed"))
    b = budgets.join(ledger, "board", "left").join(opened, "board", "left").join(done, "board", "left")
    text = F.concat(
        F.lit("Budget: "), F.col("left").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" left\n"), F.coalesce("ledger", F.lit("")),
        F.lit("OPEN "), F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit("\n"), F.coalesce("open", F.lit("")), F.lit("CLOSED "), F.coalesce("closed", F.lit("none")), F.lit("\n"),
    )
    return b.select("board", text.alias("text"))


def page_carries(pages: DataFrame, open_molecules: DataFrame) -> DataFrame:
    """(board, carries): whether the open molecules read back from the text are those of the board, in order."""
    own = open_molecules.groupBy("board").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "mid"))), lambda x: x["mid"]).alias("mids"))
    j = pages.join(own, "board", "left")
    return j.select("board", (board_text.open_ids(F.col("text")) == F.coalesce("mids", F.array().cast("array<string>"))).alias("carries"))


def chat_messages(turns: DataFrame, developer: str) -> DataFrame:
    """(episode, messages): a developer message, then each turn's board, call and analysis, in order.

    ``turns``: (episode, i, board, thinking, call). The last turn has no call: its thinking is the final answer.
    """
    last = F.lead("i").over(Window.partitionBy("episode").orderBy("i")).isNull()
    said = lambda role, content, thinking, call: F.struct(F.lit(role).alias("role"), content.alias("content"), thinking.alias("thinking"), call.alias("call"))
    none = F.lit(None).cast("string")
    reply = F.when(F.col("last") | F.col("call").isNull(), said("assistant", F.col("thinking"), none, none)).otherwise(said("assistant", none, F.col("thinking"), F.col("call")))
    pair = F.array_compact(F.array(F.when(F.col("board").isNotNull(), said("user", F.col("board"), none, none)), reply))
    g = turns.withColumn("last", last).groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("i", pair.alias("m")))).alias("a"))
    return g.select("episode", F.concat(F.array(said("developer", F.lit(developer), none, none)), F.flatten(F.transform("a", lambda x: x["m"]))).alias("messages"))
