"""Checks of training records, turn by turn: form, actions, budget, menus, and the tree that the record should build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import board_text

# Lines of a state message.
HEADER = r"(?m)^Turn (\d+)\. Expansion budget: (-?\d+) of (-?\d+) left\.$"
ECHO = r"\A<mol (\S+)/> came back with (\d+) candidate disconnections\."
READY = r"(?m)^  <mol (\S+)/> [^\n]*?\d+ candidates:\n((?:    <c\d+>[^\n]*(?:\n|\z))*)"
CANDIDATE = r"(?m)^    <c(\d+)>(.*?)</c\d+>$"
ROUTE_OPEN = r"(?m)^Route \*\*(\S+)\*\* under <mol (\S+)/> is open"
NOTHING_OPEN = r"(?m)^Nothing is open\.$"
NEEDS = "Needs an expansion"
HANDED = r"Handing over (\d+) route"


def open_ids(user: Column) -> Column:
    """Molecules listed under the heading of those that need an expansion."""
    block = F.when(F.instr(user, NEEDS) > 0, F.substring(user, F.instr(user, NEEDS), F.length(user))).otherwise("")
    return F.array_union(F.regexp_extract_all(block, F.lit(r"<mol (\S+?)/>"), F.lit(1)), F.regexp_extract_all(block, F.lit(r"<mol (\S+?)>.*?</mol>"), F.lit(1)))


def candidates(user: Column, mol: Column) -> Column:
    """(cand, fragments) of the molecule's menu in a state message; null without one. A star of a fragment is left out."""
    menus = F.arrays_zip(F.regexp_extract_all(user, F.lit(READY), F.lit(1)).alias("m"), F.regexp_extract_all(user, F.lit(READY), F.lit(2)).alias("b"))
    block = F.get(F.filter(menus, lambda x: x["m"] == mol), F.lit(0))["b"]
    rows = F.arrays_zip(F.regexp_extract_all(block, F.lit(CANDIDATE), F.lit(1)).alias("c"), F.regexp_extract_all(block, F.lit(CANDIDATE), F.lit(2)).alias("f"))
    pieces = lambda f: F.transform(F.split(f, r" \+ ", -1), lambda x: F.regexp_replace(F.trim(x), r"\*+$", ""))
    return F.when(block.isNotNull(), F.transform(rows, lambda r: F.struct(r["c"].cast("int").alias("cand"), pieces(r["f"]).alias("pieces"))))


def turn_issues(turns: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(record, code, n): what each record breaks, and how often.

    ``turns`` (record, i, user, kind, mol, top, think): the parsed action is single, rank or done, null if it could not be
    read. ``nodes`` (record, mol, status) and ``edges`` (record, parent, child) are the tree.
    """
    own = Window.partitionBy("record").orderBy("i")
    t = turns.withColumn("next_user", F.lead("user").over(own)).withColumn("last", F.lead("i").over(own).isNull())
    found = lambda pattern, group, c="user": F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))
    t = t.withColumn("at", found(HEADER, 1).cast("int")).withColumn("budget", found(HEADER, 2).cast("int"))
    # The budget of the last turn that had a header, and whether the turn before this one spent one.
    t = t.withColumn("before", F.last("budget", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))).withColumn("spent", F.coalesce(F.lag("kind").over(own) == "single", F.lit(False)).cast("int"))
    children = edges.groupBy(F.col("record"), F.col("parent").alias("mol")).agg(F.array_sort(F.collect_list("child")).alias("children"))
    inner = edges.select("record", F.col("parent").alias("mol")).distinct().withColumn("inner", F.lit(True))
    tree = nodes.join(inner, ["record", "mol"], "left").groupBy("record").agg(
        F.max((~F.col("status").isin("buyable", "committed")).cast("int")).alias("unresolved"), F.max((F.col("inner").isNull() & (F.col("status") != "buyable")).cast("int")).alias("bad_leaf")
    )
    t = t.join(children, ["record", "mol"], "left").join(tree, "record", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
    menu = candidates(F.col("user"), F.col("mol"))
    t = t.withColumn("menu", menu).withColumn("chosen", F.array_sort(F.get(F.filter("menu", lambda c: c["cand"] == F.col("top")), F.lit(0))["pieces"]))
    kind, header = F.col("kind"), F.col("budget").isNotNull()
    single, rank, done = (F.coalesce(kind == k, F.lit(False)) for k in ("single", "rank", "done"))
    placed = rank & F.col("chosen").isNotNull()
    subset = F.size(F.array_except("chosen", "children")) == 0
    whole = subset & (F.size(F.array_except("children", "chosen")) == 0)
    same = F.col("chosen") == F.col("children")
    rules = {
        "format/assistant_shape_or_grammar": kind.isNull(),
        "format/think_empty": kind.isNotNull() & (F.trim(F.coalesce("think", F.lit(""))) == ""),
        "gold/unfinished": F.col("last") & ~done,
        "state/done_not_last": ~F.col("last") & done,
        "state/turn_header_missing": ~header,
        "state/turn_index": header & (F.col("at") != F.col("i")),
        "state/budget_overspent": header & (F.col("budget") < 0),
        "state/budget": header & F.col("before").isNotNull() & (F.col("budget") != F.col("before") - F.col("spent")),
        "state/expand_target_not_open": single & ~F.array_contains(open_ids(F.col("user")), F.col("mol")),
        "state/expansion_not_echoed": single & ~F.col("last") & ~F.coalesce(found(ECHO, 1, "next_user") == F.col("mol"), F.lit(False)),
        "state/expansion_without_successor": single & F.col("last"),
        "state/rank_target_not_ready": rank & F.col("menu").isNull(),
        "state/candidate_missing": rank & F.col("menu").isNotNull() & F.col("chosen").isNull(),
        "gold/duplicate_piece": placed & ~same & whole,
        "gold/tree_has_extra_children": placed & ~same & ~whole & subset,
        "gold/committed_children_mismatch": placed & ~same & ~subset,
        "state/route_not_opened": placed & ~F.col("last") & ~F.coalesce(found(ROUTE_OPEN, 2, "next_user") == F.col("mol"), F.lit(False)),
        "state/rank_without_successor": placed & F.col("last"),
        "gold/done_premature": done & (F.coalesce("unresolved", F.lit(0)) == 1),
        "gold/done_leaf_not_buyable": done & (F.coalesce("bad_leaf", F.lit(0)) == 1),
        "state/done_while_open": done & ~F.col("user").rlike(NOTHING_OPEN),
    }
    codes = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]))
    return t.select("record", F.explode(codes).alias("code")).groupBy("record", "code").agg(F.count(F.lit(1)).alias("n"))


def board_issues(turns: DataFrame) -> DataFrame:
    """(record, code, n) of board episodes: turns (record, i, board, items, supervised, final).

    ``board`` is the text of a turn that shows one, else null and the last one shown counts; ``items`` are structs
    (type, mid, order), null if the call could not be read; ``final`` is the hand-over text of the last turn.
    """
    shown = F.last("board", ignorenulls=True).over(Window.partitionBy("record").orderBy("i"))
    t = turns.withColumn("shown", shown).withColumn("ids", board_text.actionable_ids(F.col("shown"))).withColumn("sizes", board_text.menu_sizes(F.col("shown")))
    call = F.col("final").isNull()
    read = call & F.col("items").isNotNull()
    judged = read & F.col("supervised") & F.col("shown").isNotNull()
    acting = F.filter("items", lambda x: x["type"] != "done")
    off = lambda x: F.coalesce(F.exists(x["order"], lambda c: c >= F.col("sizes")[x["mid"]]) & (F.col("sizes")[x["mid"]] > 0), F.lit(False))
    mids = F.filter(F.transform("items", lambda x: x["mid"]), lambda m: m.isNotNull())
    one = lambda test: F.when(F.coalesce(test, F.lit(False)), 1).otherwise(0)
    counts = {
        "n_turns": F.lit(1),
        "n_final": one(~call),
        "final/no_route": one(~call & (F.coalesce(F.regexp_extract("final", HANDED, 1).try_cast("int"), F.lit(0)) < 1)),
        "n_calls": one(call),
        "action/unparsed": one(call & F.col("items").isNull()),
        "n_items": F.when(read, F.size("items")).otherwise(0),
        "n_unsupervised": one(read & ~F.col("supervised")),
        "state/no_board": one(read & F.col("supervised") & F.col("shown").isNull()),
        "state/mid_not_open": F.when(judged, F.size(F.filter(acting, lambda x: ~F.coalesce(F.array_contains("ids", x["mid"]), F.lit(False))))).otherwise(0),
        "state/candidate_off_screen": F.when(judged, F.size(F.filter(acting, off))).otherwise(0),
        "action/two_actions_one_molecule": one(judged & (F.size(F.array_distinct(mids)) != F.size(mids))),
    }
    rows = F.array(*[F.struct(F.lit(code).alias("code"), n.cast("long").alias("n")) for code, n in counts.items()])
    return t.select("record", F.explode(rows).alias("x")).where("x.n > 0").groupBy("record", "x.code").agg(F.sum("x.n").alias("n"))
