"""Turns as text and back: action lines and their JSON, ledgers, declared orders, blocks of drafts, repairs.

An action is a struct (type, mid, order, take, reason, choices, mids, candidates); fields that a type does not use are null.
``choices`` and ``candidates`` are arrays of (mid, ...) structs, so their order is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTION = "struct<type:string,mid:string,order:array<int>,take:int,reason:string,choices:array<struct<mid:string,cand:int>>,mids:array<string>,candidates:array<struct<mid:string,cands:array<int>>>>"
# The sentence of each reason for giving a molecule up, and the patterns of a draft's lines.
CUT_ROW = r"(?i)^\s*c(\d+)\s*\|\s*bond\s*:\s*(.*?)\s*\|\s*reaction\s*:\s*(.*?)\s*\|\s*what it does\s*:\s*(.*?)\s*$"
ADDRESS = r"^(?:DISCONNECTIONS|DECIDING)\s+(\S+)"
CONJOINED = r"(?i)\bc\d\b(?:\s*,\s*c\d\b)*\s*(?:,\s*)?(?:and|or|nor)\s+c\d\b"
COMPARATIVE = r"(?i)\b(than|over|against|unlike|versus|vs\.?|compared|beats?|ahead of|rather than|instead of|where(?:as)?)\b"
TARGETED = ("open", "analyze", "rank", "done")


def _cands(order: Column, glue: str) -> Column:
    return F.array_join(F.transform(order, lambda c: F.concat(F.lit("c"), c.cast("string"))), glue)


def action_line(a: Column) -> Column:
    """One line of the ``act`` block."""
    pairs = F.array_join(F.transform(a["choices"], lambda p: F.concat(p["mid"], F.lit("·c"), p["cand"].cast("string"))), " ")
    looked = F.concat(
        F.transform(F.coalesce(a["candidates"], F.array().cast("array<struct<mid:string,cands:array<int>>>")), lambda p: F.concat(p["mid"], F.lit(" "), _cands(p["cands"], " "))), F.coalesce(a["mids"], F.array().cast("array<string>"))
    )
    return (
        F.when(a["type"] == "open", F.concat(F.lit("open "), a["mid"]))
        .when(a["type"] == "rank", F.concat(F.lit("rank "), a["mid"], F.lit(" "), _cands(a["order"], " ")))
        .when(a["type"] == "dead", F.concat(F.lit("dead "), a["mid"], F.lit("   reason: "), a["reason"]))
        .when(a["type"] == "done", F.concat(F.lit("done "), pairs))
        .when(a["type"] == "analyze", F.concat(F.lit("analyze "), F.array_join(looked, "   ")))
        .when(a["type"] == "terminate", F.lit("terminate"))
    )


def _quoted(text: Column) -> Column:
    """A JSON string, characters beyond ASCII as they are."""
    escaped = F.regexp_replace(F.regexp_replace(text, r"([\\\"])", r"\\$1"), "\n", r"\\n")
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def action_json(a: Column) -> Column:
    """The same action as JSON, keys in a fixed order, a space after each comma and colon; ``take`` is always stated."""
    numbers = lambda x: F.concat(F.lit("["), F.array_join(F.transform(x, lambda c: c.cast("string")), ", "), F.lit("]"))
    mid = F.concat(F.lit('"mid": '), _quoted(a["mid"]))
    chosen = F.array_join(F.transform(a["choices"], lambda p: F.concat(_quoted(p["mid"]), F.lit(": "), p["cand"].cast("string"))), ", ")
    looked = F.array_join(F.transform(a["candidates"], lambda p: F.concat(_quoted(p["mid"]), F.lit(": "), numbers(p["cands"]))), ", ")
    whole = F.array_join(F.transform(a["mids"], _quoted), ", ")
    body = (
        F.when(a["type"] == "open", mid)
        .when(a["type"] == "rank", F.concat(mid, F.lit(', "order": '), numbers(a["order"]), F.lit(', "take": '), F.greatest(F.coalesce(a["take"], F.lit(1)), F.lit(1)).cast("string")))
        .when(a["type"] == "dead", F.concat(mid, F.lit(', "reason": '), _quoted(a["reason"])))
        .when(a["type"] == "done", F.concat(F.lit('"choices": {'), chosen, F.lit("}")))
        .when(a["type"] == "analyze", F.concat_ws(", ", F.when(F.size(a["mids"]) > 0, F.concat(F.lit('"mids": ['), whole, F.lit("]"))), F.when(F.size(a["candidates"]) > 0, F.concat(F.lit('"candidates": {'), looked, F.lit("}")))))
    )
    head = F.concat(F.lit('{"type": '), _quoted(a["type"]))
    return F.when(F.coalesce(body, F.lit("")) == "", F.concat(head, F.lit("}"))).otherwise(F.concat(head, F.lit(", "), body, F.lit("}")))


def payload(actions: Column) -> Column:
    """All actions of a call as its JSON argument."""
    return F.concat(F.lit('{"actions": ['), F.array_join(F.transform(actions, action_json), ", "), F.lit("]}"))


def decision_line(actions: Column) -> Column:
    """A turn's call as one ledger line."""

    def bit(a: Column) -> Column:
        order = _cands(F.coalesce(a["order"], F.array().cast("array<int>")), " > ")
        done = F.array_join(F.transform(a["choices"], lambda p: F.concat(p["mid"], F.lit(":c"), p["cand"].cast("string"))), ", ")
        return (
            F.when(a["type"] == "rank", F.concat(F.lit("rank "), a["mid"], F.lit(" -> "), F.when(order != "", order).otherwise("(nothing)")))
            .when(a["type"] == "done", F.concat(F.lit("done "), F.coalesce(done, F.lit(""))))
            .when(a["type"] == "final", F.lit("hand over"))
            .when(a["mid"].isNotNull(), F.concat_ws(" ", a["type"], a["mid"]))
            .otherwise(a["type"])
        )

    return F.coalesce(F.nullif(F.array_join(F.transform(actions, bit), "; "), F.lit("")), F.lit("(no call)"))


def _ranks(actions: Column) -> Column:
    return F.filter(actions, lambda a: (F.lower(a["type"]) == "rank") & F.coalesce(a["mid"] != "", F.lit(False)))


def _last_by_mid(entries: Column) -> Column:
    """A map of (mid, value) structs; the last of a molecule counts."""
    mids = F.array_distinct(F.transform(entries, lambda e: e["mid"]))
    return F.map_from_entries(F.transform(mids, lambda m: F.struct(m, F.element_at(F.filter(entries, lambda e: e["mid"] == m), -1)["value"])))


def ranked_orders(actions: Column) -> Column:
    """mid -> the order its rank action declares."""
    return _last_by_mid(F.transform(_ranks(actions), lambda a: F.struct(a["mid"].alias("mid"), F.coalesce(a["order"], F.array().cast("array<int>")).alias("value"))))


def takes(actions: Column) -> Column:
    """mid -> how many of its order the call commits, at least one."""
    return _last_by_mid(F.transform(_ranks(actions), lambda a: F.struct(a["mid"].alias("mid"), F.greatest(F.coalesce(a["take"], F.lit(1)), F.lit(1)).alias("value"))))


def action_targets(turns: DataFrame, key: list[str]) -> DataFrame:
    """(key, type, mids): the molecules that each kind of action of a turn was applied to, sorted."""
    a = turns.select(*key, F.explode("actions").alias("a")).where(F.col("a.type").isin(*TARGETED))
    empty = F.array().cast("array<string>")
    mids = F.concat(F.array_compact(F.array("a.mid")), F.coalesce("a.mids", empty), F.coalesce(F.transform("a.candidates", lambda p: p["mid"]), empty), F.coalesce(F.transform("a.choices", lambda p: p["mid"]), empty))
    return a.select(*key, "a.type", F.explode(mids).alias("mid")).groupBy(*key, "type").agg(F.array_sort(F.collect_set("mid")).alias("mids"))


def wanted(asked: DataFrame, menus: DataFrame) -> DataFrame:
    """(key, mid, cands) of analyze requests: (key, mid, whole, cands); a whole one is its menu (key, mid, cand), a named one its own numbers.

    A molecule asked for both ways is analysed whole; a whole request of a molecule without a menu asks for nothing.
    """
    named = asked.where("NOT whole").select("key", "mid", F.explode("cands").alias("cand"), F.lit(False).alias("whole"))
    every = asked.where("whole").select("key", "mid").distinct().join(menus, ["key", "mid"]).select("key", "mid", "cand", F.lit(True).alias("whole"))
    both = named.unionByName(every).groupBy("key", "mid").agg(F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("cand")))).alias("all"), F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("cand")))).alias("some"))
    return both.select("key", "mid", F.when(F.size("all") > 0, F.col("all")).otherwise(F.col("some")).alias("cands"))


def cut_rows(body: Column) -> Column:
    """The table rows of a block (cand, bond, reaction, does) in order."""
    lines = F.filter(F.split(body, r"\r?\n", -1), lambda x: x.rlike(CUT_ROW))
    part = lambda x, i: F.regexp_extract(x, CUT_ROW, i)
    return F.transform(lines, lambda x: F.struct(part(x, 1).cast("int").alias("cand"), part(x, 2).alias("bond"), part(x, 3).alias("reaction"), part(x, 4).alias("does")))


def bad_cut_lines(body: Column) -> Column:
    """Lines of a block that are neither rows nor blank."""
    return F.transform(F.filter(F.split(body, r"\r?\n", -1), lambda x: x.rlike(r"\S") & ~x.rlike(CUT_ROW)), lambda x: F.trim(x))


def block_mid(where: Column) -> Column:
    """The molecule that a finding's address names; null for findings on the whole turn."""
    return F.nullif(F.regexp_extract(F.trim(where), ADDRESS, 1), F.lit(""))


def blocks_by_mid(blocks: DataFrame, key: list[str]) -> DataFrame:
    """(key, mid, text): the blocks about a molecule joined in page order; blocks: (key, at, name, mid, text)."""
    own = blocks.where("name IN ('disconnections', 'deciding') AND mid IS NOT NULL AND mid <> ''")
    g = own.groupBy(*key, "mid").agg(F.array_sort(F.collect_list(F.struct("at", F.rtrim("text", F.lit("\n")).alias("text")))).alias("a"))
    return g.select(*key, "mid", F.array_join(F.filter(F.transform("a", lambda x: x["text"]), lambda t: t != ""), "\n").alias("text"))


def blanked_fields(text: Column, field: str = "reaction") -> Column:
    """The text with the values of ``field:`` blanked, everything else kept."""
    return F.regexp_replace(text, rf"(?i)({field}\s*:)[^|\n]*(?=\|)", "$1 ")


def spread_claims(clause: Column) -> Column:
    """A claim on several candidates at once as one claim for each; none where the clause compares."""
    run = F.regexp_extract(clause, f"({CONJOINED[4:]})", 1)
    after = F.regexp_extract(clause, rf"(?:{CONJOINED[4:]})((?:(?!\bc\d\b).)*)", 1)
    named = F.array_sort(F.array_distinct(F.regexp_extract_all(run, F.lit(r"\bc(\d)\b"), F.lit(1))))
    said = F.concat(F.lit("c{}"), after)
    one = lambda c: F.concat(F.regexp_replace(F.trim(F.replace(said, F.lit("{}"), c)), r"[.;,\s]+$", ""), F.lit("."))
    return F.when((run == "") | clause.rlike(COMPARATIVE) | (F.size(named) < 2), F.array().cast("array<string>")).otherwise(F.transform(named, one))


def draft_badness(fatal: Column, fact_fatal: Column, leaks: list[str], style: list[str]) -> Column:
    """3 for a leak, 2 for a false claim, 1 for a broken form, 0 for style alone; the lowest draft is kept."""
    has = lambda codes: F.size(F.array_intersect(fatal, F.array(*[F.lit(c) for c in codes]))) > 0
    rest = F.array_except(fatal, F.array(*[F.lit(c) for c in style]))
    return F.when(has(leaks), 3).when(F.size(fact_fatal) > 0, 2).when(F.size(rest) > 0, 1).otherwise(0)


def repair_text(violations: DataFrame, key: list[str], most: int = 8) -> DataFrame:
    """(key, text): the first ``most`` findings (key, no, where_, detail, fix) as lines, addressed by block."""
    tidy = F.regexp_replace(F.coalesce("fix", F.lit("")), r"\.+$", "")
    line = F.concat(F.lit("- "), F.coalesce("where_", F.lit("document")), F.lit(": "), F.col("detail"), F.lit("."), F.when(tidy != "", F.concat(F.lit(" "), tidy, F.lit("."))).otherwise(""))
    g = violations.where(F.col("no") <= most).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))).alias("a"))
    return g.select(*key, F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("text"))


def label_quotes(drafts: DataFrame, labels: DataFrame) -> DataFrame:
    """(turn, label): labels (turn, label) of more than three characters that the draft quotes."""
    own = labels.where(F.length("label") > 3).select("turn", "label").distinct()
    return drafts.join(own, "turn").where(F.lower("text").contains(F.lower("label"))).select("turn", "label")


def cycle_described(rows: DataFrame, traps: DataFrame) -> DataFrame:
    """(turn, mid, cand): rows of a draft (turn, mid, cand) that describe a candidate which brings an ancestor back."""
    return rows.select("turn", "mid", "cand").distinct().join(traps.select("turn", "mid", "cand").distinct(), ["turn", "mid", "cand"], "left_semi")


def bond_pairs(field: Column) -> Column:
    """Element pairs such as C-O, each sorted within itself, distinct and sorted."""
    pairs = F.arrays_zip(F.regexp_extract_all(field, F.lit(r"\b([A-Z][a-z]?)-([A-Z][a-z]?)\b"), F.lit(1)).alias("a"), F.regexp_extract_all(field, F.lit(r"\b([A-Z][a-z]?)-([A-Z][a-z]?)\b"), F.lit(2)).alias("b"))
    return F.array_sort(F.array_distinct(F.transform(pairs, lambda p: F.concat_ws("-", F.least(p["a"], p["b"]), F.greatest(p["a"], p["b"])))))


def bond_findings(said: DataFrame, measured: DataFrame) -> DataFrame:
    """(turn, cand, side, code, pair): pairs said of a side that were not measured there, and measured ones left out where any was said.

    Both have (turn, cand, side, pairs). Candidates without a measurement are silent.
    """
    real = measured.select("turn", "cand", "side", F.col("pairs").alias("real"))
    known = measured.select("turn", "cand").distinct()
    j = said.join(known, ["turn", "cand"], "left_semi").join(real, ["turn", "cand", "side"], "left").withColumn("real", F.coalesce("real", F.array().cast("array<string>")))
    wrong = F.transform(F.array_except("pairs", "real"), lambda p: F.struct(F.lit("bond_pair_wrong").alias("code"), p.alias("pair")))
    left = F.when(F.size("pairs") > 0, F.transform(F.array_except("real", "pairs"), lambda p: F.struct(F.lit("bond_pair_missing").alias("code"), p.alias("pair")))).otherwise(F.array().cast("array<struct<code:string,pair:string>>"))
    return j.select("turn", "cand", "side", F.explode(F.concat(wrong, left)).alias("v")).select("turn", "cand", "side", "v.code", "v.pair")


def ledger_row(rid: Column, parent: Column, cand: Column, status: Column, n_closed: Column, n_pieces: Column) -> Column:
    """One applied reaction: its molecule and candidate, and how much of it is closed."""
    state = F.when(status == "failed", F.lit("FAILED")).otherwise(F.concat(n_closed.cast("string"), F.lit(" of "), n_pieces.cast("string"), F.lit(" closed"), F.when(status == "solved", F.lit("  solved")).otherwise("")))
    return F.concat(rid, F.lit("  "), parent, F.lit("·c"), cand.cast("string"), F.lit("  "), state)
