"""Rules that hold what a draft says against the tables of its turn. Each gives (turn, code, detail).

Drafts are (turn, text). A rule that lacks the facts it needs stays silent. Vocabularies are fixed lists that the
caller gives; each word is looked for by a pattern of its own in one projection, so nothing is joined to find words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomroute.functions.fields import loose
from loomroute.functions.keys import price_string, short_number

# Phrases that make a claim.
WEAK_PURCHASE = r"(?i)\b(purchasable|buyable|commercial|off the shelf|already banked)\b"
STRONG_PURCHASE = (
    r"(?i)(both .{0,40}(?:purchasable|buyable|cheap)|all (?:of them |the pieces |fragments )?(?:are )?(?:purchasable|buyable)"
    r"|every (?:piece|fragment|leaf) (?:is |reaches )(?:purchasable|buyable|purchasable material)|the AND closes on arrival|closes? on arrival)"
)
SAYS_BREAK = r"(?i)\b(opens? the (?:\w+ )?ring|changes? the skeleton|breaks? the (?:ring|skeleton)|builds? the (?:ring|skeleton)|ring[- ]forming|ring[- ]opening)\b"
SAYS_KEEP = r"(?i)\b(keeps? (?:the |all )?(?:\w+ )?(?:rings?|skeleton) intact|skeleton (?:is )?kept|leaves the skeleton|without touching the (?:\w+ )?(?:ring|skeleton|framework))\b"
RING_PAIR = r"rings?\s+(\d+)\s*(?:<-|from)\s*(\d+)"
ATOMS = r"\b(\d{1,3})[- ](?:heavy[- ]|)atom\b"
CARBON_UNIT = r"\bC(\d)\s+(?:unit|building block|fragment|source)\b"
ROUTE_FLOOR = r"\broute ([A-Z])\b[^.;]{0,60}?(0?\.\d+|1\.0+)"
OVER_ONE = r"\b(?:weakest|floor|rates? (?:it )?at|sits at)\D{0,12}(\d\.\d+)"
CHEAPEST = r"(?i)\broute ([A-Z])\b[^.;]{0,70}?\b(?:is )?(?:also )?the cheapest|\bthe cheapest[^.;]{0,30}?\bis route ([A-Z])\b"
CHEAPER = r"(?i)\b([A-Z]) is cheaper\b|\bcheaper still[^.;]{0,20}?\b([A-Z])\b|\b([A-Z])\b[^.;]{0,20}?\bis cheaper still"
WOULD_NOT = r"(?i)\b([A-Z]) is the one I would not claim|\bI would not claim ([A-Z])\b"
TOGETHER = r"(?im)opening together\s*:\s*(.+?)\s*$"
UNDER = r"(?i)\b([a-z]{1,2}[0-9]*)\s+under\s+(r[0-9]+)\b"
QUANTITY = r"(?i)\b(both|all (?:two|three|four|five)|the (?:two|three|four|five))\b"
SAME_STEP = r"(?i)\b(same (?:step|reaction|disconnection|cut)|one (?:step|reaction|disconnection)|both pieces of|co-?precursors?|the step (?:owes|still owes)|pieces (?:that )?r[0-9]+ (?:still )?owes)\b"
OTHER_STEP = (
    r"(?i)\b(different (?:steps?|reactions?|disconnections?|cuts?|branch(?:es)?)|two (?:different )?(?:disconnections?|cuts?|routes?|branches)"
    r"|separate branch(?:es)?|rival|competing|alternative (?:cuts?|disconnections?|routes?))\b"
)
SENTENCE = r"(?<=[.;!?])\s+"
NUMBERS = {"both": 2, "two": 2, "three": 3, "four": 4, "five": 5}


def spoken(text: Column, words: list[str], plural: bool = False) -> Column:
    """The words of the list that the text holds as words of their own, in the list's order."""
    end = "s?" if plural else ""
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)\b{re.escape(w)}{end}\b"), F.lit(w)) for w in words]))


def _found(pattern: str, group: int, text: str = "text") -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))


def _row(code, detail) -> list[Column]:
    code = F.lit(code) if isinstance(code, str) else code
    return [F.col("turn"), code.alias("code"), detail.alias("detail")]


def named(drafts: DataFrame, taken: DataFrame, facts: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Reaction names must be earned: facts (turn, cand, tier, names) of the taken candidates (turn, cand) and of those the text names.

    Names of tier ``applies+makes`` are earned, those of ``applies`` alone get a code of their own. ``aliases`` maps
    a word to the part of a recorded name that it stands for.
    """
    spoke = drafts.select("turn", F.explode(F.transform(_found(r"\bc(\d)\b", 1), lambda x: x.cast("int"))).alias("cand"))
    want = taken.select("turn", F.col("cand").cast("int").alias("cand")).union(spoke).distinct()
    judged = facts.where("tier IS NOT NULL").join(want, ["turn", "cand"], "left_semi")
    lowered = F.transform("names", F.lower)
    of = lambda tier: F.flatten(F.collect_list(F.when(F.col("tier") == tier, lowered)))
    known = judged.groupBy("turn").agg(of("applies+makes").alias("earned"), of("applies").alias("partly"))
    alias = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    said = drafts.join(known, "turn").select("turn", "earned", "partly", F.explode(spoken(F.col("text"), list(aliases))).alias("word")).withColumn("key", alias[F.col("word")])
    has = lambda names: F.exists(names, lambda n: n.contains(F.col("key")) | n.contains(F.col("word")))
    return said.where(~has("earned")).select(*_row(F.when(has("partly"), "named_applies_only").otherwise("named_unearned"), F.col("word")))


def named_conflict(drafts: DataFrame, classes: dict[str, list[str]], exclusive: list[tuple[str, str]]) -> DataFrame:
    """Two classes in one sentence that cannot both describe one step."""
    sentences = drafts.select("turn", F.explode(F.split("text", SENTENCE, -1)).alias("text"))
    both = lambda a, b: (F.size(spoken(F.col("text"), classes[a])) > 0) & (F.size(spoken(F.col("text"), classes[b])) > 0)
    clashes = F.array_compact(F.array(*[F.when(both(a, b), F.lit(f"{a}/{b}")) for a, b in exclusive]))
    return sentences.select("turn", F.explode(clashes).alias("pair")).distinct().select(*_row("named_conflict", F.col("pair")))


def absent_words(drafts: DataFrame, present: DataFrame, vocabulary: dict[str, str], code: str) -> DataFrame:
    """Words for something that no molecule of the turn has. ``vocabulary``: word -> signature; ``present``: (turn, signature)."""
    held = present.groupBy("turn").agg(F.collect_set("signature").alias("held"))
    signature = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    said = drafts.join(held, "turn").select("turn", "held", F.explode(spoken(F.col("text"), list(vocabulary), plural=True)).alias("word"))
    return said.where(~F.array_contains("held", signature[F.col("word")])).select(*_row(code, F.col("word")))


def purchasable(drafts: DataFrame, taken: DataFrame) -> DataFrame:
    """Claims that pieces can be bought. taken: (turn, mid, cand, buyable), an array of flags for the candidate's pieces."""
    j = drafts.join(taken, "turn").where(F.col("text").rlike(WEAK_PURCHASE) | F.col("text").rlike(STRONG_PURCHASE)).where(F.size("buyable") > 0)
    n = F.size(F.filter("buyable", lambda b: b))
    code = F.when(n == 0, "purchasable/none").when(F.col("text").rlike(STRONG_PURCHASE) & (n < F.size("buyable")), "purchasable/some")
    return j.withColumn("code", code).where("code IS NOT NULL").select(*_row(F.col("code"), F.format_string("%s·c%d", "mid", "cand")))


def shape(drafts: DataFrame, taken: DataFrame) -> DataFrame:
    """Skeleton and ring claims. taken: (turn, mid, cand, kept, rings_product, rings_precursors); unknown ``kept`` is silent."""
    j = drafts.join(taken.where("kept IS NOT NULL"), "turn")
    breaks, keeps = F.col("text").rlike(SAYS_BREAK), F.col("text").rlike(SAYS_KEEP)
    at = F.format_string("%s·c%d", "mid", "cand")
    pairs = F.arrays_zip(_found(RING_PAIR, 1).alias("a"), _found(RING_PAIR, 2).alias("b"))
    wrong = F.filter(pairs, lambda p: (p["a"].cast("int") != F.col("rings_product")) | (p["b"].cast("int") != F.col("rings_precursors")))
    codes = F.array_compact(F.concat(
        F.array(F.when(F.col("kept") & breaks & ~keeps, F.struct(F.lit("shape/break").alias("code"), at.alias("detail"))), F.when(~F.col("kept") & keeps & ~breaks, F.struct(F.lit("shape/keep").alias("code"), at.alias("detail")))),
        F.transform(wrong, lambda p: F.struct(F.lit("shape/rings").alias("code"), F.concat(p["a"], F.lit("<-"), p["b"]).alias("detail"))),
    ))
    return j.select("turn", F.explode(codes).alias("v")).select("turn", "v.code", "v.detail").distinct()


def counts(drafts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``N-atom`` must be the heavy-atom count of a molecule of the turn, ``CN unit`` the carbons of a small one. sizes: (turn, heavy, carbons)."""
    known = sizes.groupBy("turn").agg(F.collect_set("heavy").alias("heavies"), F.collect_set(F.when(F.col("heavy") <= 8, F.col("carbons"))).alias("small"))
    j = drafts.join(known, "turn")
    off = lambda pattern, held, code: F.transform(F.filter(F.transform(_found(pattern, 1), lambda x: x.cast("int")), lambda n: (F.size(held) > 0) & ~F.array_contains(held, n)), lambda n: F.struct(F.lit(code).alias("code"), n.cast("string").alias("detail")))
    every = F.concat(off(ATOMS, "heavies", "count/atoms"), off(CARBON_UNIT, "small", "count/carbons"))
    return j.select("turn", F.explode(every).alias("v")).select("turn", "v.code", "v.detail").distinct()


def route_floor(drafts: DataFrame, routes: DataFrame, tolerance: float = 5e-3) -> DataFrame:
    """A route's quoted floor against its weakest step (turn, route, weakest), and a plausibility quoted above 1."""
    listed = routes.where("weakest IS NOT NULL")
    said = drafts.select("turn", F.explode(F.arrays_zip(_found(ROUTE_FLOOR, 1).alias("route"), _found(ROUTE_FLOOR, 2).alias("v"))).alias("s")).select("turn", "s.route", "s.v")
    off = said.join(listed, ["turn", "route"]).where(F.abs(F.col("v").cast("double") - F.col("weakest")) > tolerance).select(*_row("route_floor", F.concat_ws(" ", "route", "v")))
    over = drafts.join(listed.select("turn").distinct(), "turn", "left_semi").select("turn", F.explode(_found(OVER_ONE, 1)).alias("v")).where("CAST(v AS DOUBLE) > 1")
    return off.unionByName(over.select(*_row("route_floor/over_one", F.col("v")))).distinct()


def _either(pattern: str, groups: int) -> Column:
    """The letters that the groups of each match hold, upper-cased; a match fills one group."""
    zipped = F.arrays_zip(*[_found(pattern, i).alias(f"g{i}") for i in range(1, groups + 1)])
    return F.transform(zipped, lambda z: F.upper(F.concat(*[z[f"g{i}"] for i in range(1, groups + 1)])))


def handover(drafts: DataFrame, routes: DataFrame) -> DataFrame:
    """A route called the cheapest with another called cheaper, and a claimed route (turn, route) that is disowned."""
    d = drafts.select("turn", F.get(_either(CHEAPEST, 2), F.lit(0)).alias("first"), _either(CHEAPER, 3).alias("cheaper"), _either(WOULD_NOT, 2).alias("refused"))
    other = F.get(F.filter("cheaper", lambda x: x != F.col("first")), F.lit(0))
    two = d.where(F.col("first").isNotNull() & other.isNotNull()).select(*_row("handover/cheapest", F.concat(F.col("first"), F.lit("<"), other)))
    disowned = d.select("turn", F.explode("refused").alias("route")).join(routes.select("turn", F.upper("route").alias("route")).distinct(), ["turn", "route"]).select(*_row("handover/disowned", F.col("route")))
    return two.unionByName(disowned).distinct()


def open_together(drafts: DataFrame, opened: DataFrame, molecules: DataFrame) -> DataFrame:
    """The clause of a turn that opens several molecules. opened: (turn, mid); molecules: (turn, mid, under).

    Missing or unearned clauses, ids that are not opened or left out, a wrong parent reaction, a wrong count, and the
    wrong relation (one step or different steps).
    """
    call = opened.groupBy("turn").agg(F.array_sort(F.collect_set("mid")).alias("opened"))
    board = molecules.groupBy("turn").agg(F.map_from_entries(F.collect_set(F.struct("mid", F.coalesce("under", F.lit(""))))).alias("mols"))
    d = drafts.join(call, "turn", "left").join(board, "turn", "left")
    d = d.withColumn("opened", F.coalesce("opened", F.array().cast("array<string>"))).withColumn("mols", F.coalesce("mols", F.create_map().cast("map<string,string>")))
    d = d.withColumn("clause", F.regexp_extract("text", TOGETHER, 1)).withColumn("n", F.size("opened"))
    head = F.split("clause", r"\|", -1)[0]
    tokens = F.array_distinct(F.regexp_extract_all(head, F.lit(r"\b([a-z]{1,2}[0-9]*)\b"), F.lit(1)))
    d = d.withColumn("said", F.filter(tokens, lambda t: F.map_contains_key("mols", t) | (t.rlike(r"^[a-z]{1,2}[0-9]+$") & ~t.rlike(r"^[rc][0-9]+$"))))
    under = F.arrays_zip(_found(UNDER, 1, "clause").alias("mid"), _found(UNDER, 2, "clause").alias("rid"))
    real = lambda u: F.lower(F.col("mols")[u["mid"]])
    misplaced = F.filter(under, lambda u: F.coalesce(real(u) != "", F.lit(False)) & (F.lower(u["rid"]) != real(u)))
    word = F.regexp_replace(F.get(F.transform(_found(QUANTITY, 1, "clause"), F.lower), F.lit(0)), r"^(all|the) ", "")
    said_n = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])[word]
    parents = F.array_distinct(F.filter(F.transform(F.filter("opened", lambda m: F.map_contains_key("mols", m)), lambda m: F.col("mols")[m]), lambda u: u != ""))
    same, other = F.col("clause").rlike(SAME_STEP), F.col("clause").rlike(OTHER_STEP)
    several, has = F.col("n") >= 2, F.col("clause") != ""
    v = lambda test, code, detail=F.lit(""): F.when(test, F.struct(F.lit(f"open_together/{code}").alias("code"), detail.alias("detail")))
    full = several & has
    left_out = F.array_except("opened", "said")
    rows = F.concat(
        F.array(v(~several & has, "unearned"), v(several & ~has, "missing"), v(full & (F.size(left_out) > 0), "incomplete", F.array_join(left_out, ",")), v(full & (said_n != F.col("n")), "count", word)),
        F.array(v(full & (F.size(parents) > 1) & same & ~other, "relation", F.lit("one")), v(full & (F.size(parents) == 1) & other & ~same, "relation", F.lit("different"))),
        F.when(full, F.transform(F.array_except("said", "opened"), lambda m: F.struct(F.lit("open_together/wrong").alias("code"), m.alias("detail")))).otherwise(F.array().cast("array<struct<code:string,detail:string>>")),
        F.when(full, F.transform(misplaced, lambda u: F.struct(F.lit("open_together/under").alias("code"), u["mid"].alias("detail")))).otherwise(F.array().cast("array<struct<code:string,detail:string>>")),
    )
    return d.select("turn", F.explode(F.array_compact(rows)).alias("v")).select("turn", "v.code", "v.detail").distinct()


def open_named(drafts: DataFrame, history: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """At an opening turn a reaction name must have been used before: history (turn, text) are earlier texts and this turn's facts."""
    held = history.groupBy("turn").agg(F.concat_ws(" ", F.collect_list(F.lower("text"))).alias("before"))
    alias = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    low = F.lower("text")
    words = F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in sorted(aliases)]))
    said = drafts.join(held, "turn", "left").select("turn", F.coalesce("before", F.lit("")).alias("before"), F.explode(words).alias("word"))
    return said.where(~F.col("before").contains(F.col("word")) & ~F.col("before").contains(alias[F.col("word")])).select(*_row("open_named_uncited", F.col("word")))


def ending(text: Column) -> Column:
    """The last two sentences."""
    s = F.filter(F.transform(F.split(text, SENTENCE, -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.slice(s, F.greatest(F.size(s) - 1, F.lit(1)), 2), " ")


def stock_close(turns: DataFrame, least_turns: int = 6, least_words: int = 5, share: float = 0.8) -> DataFrame:
    """(episode, turn, hits, before): turns that end as at least half of the earlier turns of the episode do, four at least.

    Endings are compared as word bags, each different bag of an episode once; earlier turns are counted by a running
    sum for each bag. So the work grows with the turns and with the square of an episode's different endings only.
    No side is broadcast: by the files' sizes the planner takes bags of any number for small.
    """
    words = F.sort_array(F.regexp_extract_all(F.lower(ending(F.coalesce("text", F.lit("")))), F.lit(r"[a-z]{4,}"), F.lit(0)))
    own = Window.partitionBy("episode")
    t = turns.select("episode", "turn", F.array_join(words, " ").alias("words")).where("turn IS NOT NULL")
    t = t.withColumn("bag", F.dense_rank().over(own.orderBy("words"))).withColumn("before", F.row_number().over(own.orderBy("turn", "words")).cast("long") - 1)
    # A word's repeats become different entries, so that the entries two bags share are the smaller counts added up.
    split = F.split("words", " ")
    entries = F.transform(split, lambda w, i: F.concat_ws(" ", w, (i + 1 - F.array_position(split, w)).cast("string")))
    # Taken by turn, so that this reads the same columns as the rows below and Spark deals the turns out once.
    bags = t.where("words <> ''").groupBy("episode", "bag").agg(F.min_by("words", "turn").alias("words")).select("episode", "bag", entries.alias("entries"))
    a, b = bags.select("episode", F.col("bag").alias("for"), F.col("entries").alias("a")).where(F.size("a") >= least_words), bags.withColumnRenamed("entries", "b")
    alike = a.join(b.hint("merge"), "episode").where(F.size("b") >= share * F.size("a")).where(F.size(F.array_intersect("a", "b")) >= share * F.size("a"))
    counted = alike.groupBy("episode", "bag").agg(F.collect_list("for").alias("for"))
    # Each turn counts for all bags like its own, after it has asked for its own bag's count.
    rows = F.concat(F.array(F.struct("bag", F.lit(0).alias("n"))), F.transform("for", lambda x: F.struct(x.alias("bag"), F.lit(1).alias("n"))))
    rows = t.join(counted.hint("merge"), ["episode", "bag"]).select("episode", "turn", "before", F.explode(rows).alias("r")).select("episode", "turn", "before", "r.*")
    hits = F.sum("n").over(Window.partitionBy("episode", "bag").orderBy("turn", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("hits", hits).where("n = 0").where((F.col("before") >= least_turns) & (F.col("hits") >= F.greatest(F.lit(4), F.floor(F.col("before") / 2))))
    return out.select("episode", "turn", "hits", "before")


def target_phrases(phrases: DataFrame, target_words: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(episode, turn, code, detail): phrases for the target (episode, turn, phrase) over an episode.

    A phrase is accepted if it names no word of the vocabulary that the target lacks (episode, word). The first
    accepted one is the episode's; every later phrase must be the same, white space, case and a last stop aside.
    """
    held = target_words.groupBy("episode").agg(F.collect_set("word").alias("held"))
    p = phrases.where("phrase <> ''").join(held, "episode", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    p = p.withColumn("wrong", F.array_except(spoken(F.col("phrase"), vocabulary, plural=True), "held")).withColumn("form", loose(F.col("phrase")))
    before = Window.partitionBy("episode").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("own", F.first(F.when(F.size("wrong") == 0, F.col("form")), ignorenulls=True).over(before))
    wrong = p.where("own IS NULL").select("episode", "turn", F.lit("target_identity").alias("code"), F.explode(F.array_sort("wrong")).alias("detail"))
    return wrong.unionByName(p.where("own IS NOT NULL AND form <> own").select("episode", "turn", F.lit("target_drift").alias("code"), F.col("own").alias("detail")))


def delta_words(pieces: DataFrame, targets: DataFrame) -> DataFrame:
    """(turn, only, both): words (turn, word) of the pieces that the target lacks, and words that both have, sorted."""
    a = pieces.groupBy("turn").agg(F.collect_set("word").alias("a"))
    b = targets.groupBy("turn").agg(F.collect_set("word").alias("b"))
    j = a.join(b, "turn", "left").withColumn("b", F.coalesce("b", F.array().cast("array<string>")))
    return j.select("turn", F.array_sort(F.array_except("a", "b")).alias("only"), F.array_sort(F.array_intersect("a", "b")).alias("both"))


def delta_absent(drafts: DataFrame, pieces: DataFrame, targets: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Groups named as missing in the target that neither the turn's pieces nor the target have; silent without pieces."""
    held = pieces.select("turn", "word").unionByName(targets.select("turn", "word")).groupBy("turn").agg(F.collect_set("word").alias("held"))
    judged = drafts.join(pieces.select("turn").distinct(), "turn", "left_semi").join(held, "turn")
    return judged.select("turn", F.explode(F.array_except(spoken(F.col("text"), vocabulary, plural=True), "held")).alias("word")).select(*_row("delta_absent", F.col("word")))


def printed_prices(pieces: DataFrame) -> DataFrame:
    """(turn, shown): every price that a turn prints: of pieces (turn, cand, ln_price), and of candidates whose pieces all have one."""
    one = pieces.where("ln_price IS NOT NULL").select("turn", price_string("ln_price").alias("shown"))
    whole = pieces.groupBy("turn", "cand").agg(F.when(F.count("ln_price") == F.count(F.lit(1)), F.log(F.sum(F.exp("ln_price")))).alias("total")).where("total IS NOT NULL")
    return one.unionByName(whole.select("turn", price_string("total").alias("shown"))).distinct()


def episode_turns(messages: DataFrame) -> DataFrame:
    """(episode, turn, env, call, reason): turns of an episode's messages (episode, i, role, recipient, supervised, content).

    A user or tool message opens a turn. An unsupervised call is a refused one: it and the tool's reply to it belong to
    the turn that is open, and the reply is its reason. The last supervised call of a turn is its call; turns without
    one are left out.
    """
    own = Window.partitionBy("episode").orderBy("i")
    called = (F.col("role") == "assistant") & F.col("recipient").isNotNull()
    refused = called & (F.col("supervised") == F.lit(False))
    m = messages.withColumn("refused", refused)
    # A tool message answers a refused call if that was the message before it.
    m = m.withColumn("answers", (F.col("role") == "tool") & F.coalesce(F.lag("refused").over(own), F.lit(False)))
    opens = F.col("role").isin("user", "tool") & ~F.col("answers")
    m = m.withColumn("opens", opens).withColumn("turn", F.sum(opens.cast("int")).over(own)).where("turn > 0")
    g = m.groupBy("episode", "turn").agg(
        F.max(F.when(F.col("opens"), F.col("content"))).alias("env"), F.max_by(F.when(called & ~F.col("refused"), F.col("content")), F.when(called & ~F.col("refused"), F.col("i"))).alias("call"), F.max_by(F.when(F.col("answers"), F.col("content")), F.when(F.col("answers"), F.col("i"))).alias("reason")
    )
    return g.where("call IS NOT NULL")


def route_line(n_steps: Column, weakest: Column, weakest_at: Column, n_back: Column, n_asked: Column, worst: Column, n_leaves: Column, ln_cost: Column | None, cost: Column | None = None) -> Column:
    """A route's figures in one line: weakest plausibility, recovered steps, leaves and cost, as text or by its logarithm."""
    if cost is None:
        cost = F.when(ln_cost.isNotNull(), price_string(ln_cost))
    return F.concat_ws(
        " · ",
        F.concat(n_steps.cast("string"), F.lit(" steps")),
        F.when(weakest.isNotNull(), F.concat(F.lit("weakest p"), short_number(weakest), F.lit(" at r"), weakest_at.cast("string"))),
        F.when(n_asked > 0, F.concat(F.lit("rt "), n_back.cast("string"), F.lit("/"), n_asked.cast("string"), F.lit(" back"), F.when(n_back > 0, F.concat(F.lit(", worst "), worst.cast("string"))).otherwise(""))),
        F.concat(n_leaves.cast("string"), F.lit(" leaves")),
        F.coalesce(cost, F.lit("$?")),
    )
