"""Turn text, declared orders, blocks, repairs and token losses. A turn is an order, its actions are its lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.operators import losses, turn_text

from .roles import table

_TYPES = ("open", "rank", "done", "analyze", "dead", "terminate", "final")
_TYPE = "CASE l_linenumber WHEN 1 THEN 'open' WHEN 2 THEN 'rank' WHEN 3 THEN 'done' WHEN 4 THEN 'analyze' WHEN 5 THEN 'dead' WHEN 6 THEN 'terminate' ELSE 'final' END"
_LINES = f"""l AS (SELECT DISTINCT l_orderkey AS turn, l_linenumber AS n, {_TYPE} AS type, 'm' || l_partkey AS mid, CAST(l_suppkey % 4 AS INT) AS a, CAST(4 + l_suppkey % 3 AS INT) AS b FROM lineitem),
acts AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY n, mid, a, b) AS place FROM l)"""


def _acts(spark, sf):
    line = table(spark, sf, "lineitem")
    own = line.select(
        F.col("l_orderkey").alias("turn"), F.col("l_linenumber").alias("n"), F.expr(_TYPE).alias("type"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("mid"),
        (F.col("l_suppkey") % 4).cast("int").alias("a"), (4 + F.col("l_suppkey") % 3).cast("int").alias("b"),
    ).distinct()
    return own.withColumn("place", F.row_number().over(Window.partitionBy("turn").orderBy("n", "mid", "a", "b")))


def _turns(spark, sf):
    """(turn, actions): the actions as structs, in order."""
    t = F.col("type")
    only = lambda types, c: F.when(t.isin(*types), c)
    action = F.struct(
        t.alias("type"),
        only(("open", "rank", "dead"), F.col("mid")).alias("mid"),
        only(("rank",), F.array("a", "b")).alias("order"),
        only(("rank",), F.when(F.col("b") > 4, F.col("b") - 4)).alias("take"),
        only(("dead",), F.when(F.col("a") > 1, "floor").otherwise('says "no"')).alias("reason"),
        only(("done",), F.array(F.struct(F.col("mid").alias("mid"), F.col("a").alias("cand")), F.struct(F.lit("z1").alias("mid"), F.col("b").alias("cand")))).alias("choices"),
        only(("analyze",), F.when(F.col("a") > 1, F.array("mid")).otherwise(F.array().cast("array<string>"))).alias("mids"),
        only(("analyze",), F.when(F.col("b") > 4, F.array(F.struct(F.lit("q7").alias("mid"), F.array("a", "b").alias("cands")))).otherwise(F.array().cast("array<struct<mid:string,cands:array<int>>>"))).alias("candidates"),
    ).cast(turn_text.ACTION)
    g = _acts(spark, sf).groupBy("turn").agg(F.array_sort(F.collect_list(F.struct("place", action.alias("action")))).alias("x"))
    return g.select("turn", F.transform("x", lambda x: x["action"]).alias("actions"))


@query(
    "act_lines",
    f"""WITH {_LINES} SELECT turn, string_agg(CASE type WHEN 'open' THEN 'open ' || mid WHEN 'rank' THEN 'rank ' || mid || ' c' || a || ' c' || b WHEN 'dead' THEN 'dead ' || mid || '   reason: ' || CASE WHEN a > 1 THEN 'floor' ELSE 'says "no"' END
 WHEN 'done' THEN 'done ' || mid || '·c' || a || ' z1·c' || b WHEN 'analyze' THEN 'analyze ' || concat_ws('   ', CASE WHEN b > 4 THEN 'q7 c' || a || ' c' || b END, CASE WHEN a > 1 THEN mid END) WHEN 'terminate' THEN 'terminate' END, chr(10) ORDER BY place) AS act
FROM acts WHERE type <> 'final' GROUP BY turn""",
)
def act_lines(spark, sf):
    """The act block of a call: one line an action."""
    t = _turns(spark, sf).withColumn("actions", F.filter("actions", lambda a: a["type"] != "final")).where(F.size("actions") > 0)
    return t.select("turn", F.array_join(F.transform("actions", turn_text.action_line), "\n").alias("act"))




@query(
    "act_payload",
    f"""WITH {_LINES}, j AS (SELECT turn, place, CASE type WHEN 'open' THEN '{{"type": "open", "mid": "' || mid || '"}}' WHEN 'rank' THEN '{{"type": "rank", "mid": "' || mid || '", "order": [' || a || ', ' || b || '], "take": ' || greatest(1, b - 4) || '}}'
 WHEN 'dead' THEN '{{"type": "dead", "mid": "' || mid || '", "reason": "' || CASE WHEN a > 1 THEN 'floor' ELSE 'says \\"no\\"' END || '"}}' WHEN 'done' THEN '{{"type": "done", "choices": {{"' || mid || '": ' || a || ', "z1": ' || b || '}}}}'
 WHEN 'analyze' THEN '{{' || concat_ws(', ', '"type": "analyze"', CASE WHEN a > 1 THEN '"mids": ["' || mid || '"]' END, CASE WHEN b > 4 THEN '"candidates": {{"q7": [' || a || ', ' || b || ']}}' END) || '}}' ELSE '{{"type": "' || type || '"}}' END AS x FROM acts)
SELECT turn, '{{"actions": [' || string_agg(x, ', ' ORDER BY place) || ']}}' AS payload FROM j GROUP BY turn""",
)
def act_payload(spark, sf):
    """The call's JSON argument, keys and spacing fixed."""
    return _turns(spark, sf).select("turn", turn_text.payload(F.col("actions")).alias("payload"))


@query(
    "decision_ledger",
    f"""WITH {_LINES} SELECT turn, string_agg(CASE type WHEN 'rank' THEN 'rank ' || mid || ' -> c' || a || ' > c' || b WHEN 'done' THEN 'done ' || mid || ':c' || a || ', z1:c' || b WHEN 'final' THEN 'hand over'
 WHEN 'open' THEN 'open ' || mid WHEN 'dead' THEN 'dead ' || mid ELSE type END, '; ' ORDER BY place) AS line FROM acts GROUP BY turn""",
)
def decision_ledger(spark, sf):
    return _turns(spark, sf).select("turn", turn_text.decision_line(F.col("actions")).alias("line"))


@query(
    "declared_orders",
    f"""WITH {_LINES}, k AS (SELECT turn, mid, a, b FROM acts WHERE type = 'rank' QUALIFY row_number() OVER (PARTITION BY turn, mid ORDER BY place DESC) = 1)
SELECT turn, mid, a || ',' || b AS ranking, CAST(greatest(1, b - 4) AS INT) AS take FROM k""",
)
def declared_orders(spark, sf):
    """What each rank action declares and commits; of several on a molecule the last counts."""
    t = _turns(spark, sf)
    o = t.select("turn", F.explode(turn_text.ranked_orders(F.col("actions"))).alias("mid", "o"))
    k = t.select("turn", F.explode(turn_text.takes(F.col("actions"))).alias("mid", "take"))
    return o.join(k, ["turn", "mid"]).select("turn", "mid", F.array_join(F.transform("o", lambda x: x.cast("string")), ",").alias("ranking"), "take")


@query(
    "action_targets",
    f"""WITH {_LINES}, m AS (SELECT turn, type, mid FROM acts WHERE type IN ('open', 'rank', 'done') OR (type = 'analyze' AND a > 1) UNION SELECT turn, type, 'z1' FROM acts WHERE type = 'done' UNION SELECT turn, type, 'q7' FROM acts WHERE type = 'analyze' AND b > 4)
SELECT turn, type, string_agg(DISTINCT mid, ',' ORDER BY mid) AS mids FROM m GROUP BY turn, type""",
)
def action_targets(spark, sf):
    return turn_text.action_targets(_turns(spark, sf), ["turn"]).select("turn", "type", F.array_join("mids", ",").alias("mids"))


@query(
    "analyze_wanted",
    f"""WITH {_LINES}, asked AS (SELECT turn AS key, mid, a, b, a > 1 AS whole FROM acts WHERE type = 'analyze'), menus AS (SELECT DISTINCT l_orderkey AS key, 'm' || l_partkey AS mid, CAST(l_quantity % 6 AS INT) AS cand FROM lineitem WHERE l_suppkey % 2 = 0),
e AS (SELECT key, mid, cand, 1 AS w FROM asked JOIN menus USING (key, mid) WHERE whole UNION SELECT key, mid, a, 0 FROM asked WHERE NOT whole UNION SELECT key, mid, b, 0 FROM asked WHERE NOT whole)
SELECT key, mid, string_agg(CAST(cand AS VARCHAR), ',' ORDER BY cand) AS cands FROM e WHERE w = (SELECT max(w) FROM e x WHERE x.key = e.key AND x.mid = e.mid) GROUP BY key, mid""",
)
def analyze_wanted(spark, sf):
    """Analyze requests spelled out: whole menus and named candidates."""
    asked = _acts(spark, sf).where("type = 'analyze'").select(F.col("turn").alias("key"), "mid", (F.col("a") > 1).alias("whole"), F.array("a", "b").alias("cands"))
    menus = table(spark, sf, "lineitem").where("l_suppkey % 2 = 0").select(F.col("l_orderkey").alias("key"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("mid"), (F.col("l_quantity") % 6).cast("int").alias("cand")).distinct()
    return turn_text.wanted(asked, menus).select("key", "mid", F.array_join(F.transform("cands", lambda c: c.cast("string")), ",").alias("cands"))


_ROW = "'c' || l_linenumber || ' | bond: ' || CASE l_suppkey % 3 WHEN 0 THEN 'C-O and N-C broken' WHEN 1 THEN 'C-C formed' ELSE '' END || ' | reaction: Class ' || l_returnflag || ' | what it does: joins ' || l_partkey"
_BODY = f"string_agg(CASE WHEN l_quantity > 45 THEN 'not a row ' || l_partkey ELSE {_ROW} END, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity)"


def _bodies(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity").distinct()
    text = F.expr(f"CASE WHEN l_quantity > 45 THEN 'not a row ' || l_partkey ELSE {_ROW} END")
    g = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", text.alias("t")))).alias("a"))
    return g.select(F.col("l_orderkey").alias("turn"), F.array_join(F.transform("a", lambda x: x["t"]), "\n").alias("body"))


_DISTINCT = "u AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity FROM lineitem)"


@query(
    "cut_rows",
    f"""WITH {_DISTINCT} SELECT l_orderkey AS turn, CAST(l_linenumber AS INT) AS cand, CASE l_suppkey % 3 WHEN 0 THEN 'C-O and N-C broken' WHEN 1 THEN 'C-C formed' ELSE '' END AS bond, 'Class ' || l_returnflag AS reaction, 'joins ' || l_partkey AS does FROM u WHERE l_quantity <= 45""",
)
def cut_rows(spark, sf):
    """Rows of the disconnection table read back from a block's text."""
    return _bodies(spark, sf).select("turn", F.explode(turn_text.cut_rows(F.col("body"))).alias("r")).select("turn", "r.cand", "r.bond", "r.reaction", "r.does")


@query("bad_cut_lines", f"WITH {_DISTINCT} SELECT l_orderkey AS turn, 'not a row ' || l_partkey AS line FROM u WHERE l_quantity > 45")
def bad_cut_lines(spark, sf):
    return _bodies(spark, sf).select("turn", F.explode(turn_text.bad_cut_lines(F.col("body"))).alias("line"))


@query("blanked_fields", f"WITH {_DISTINCT}, b AS (SELECT l_orderkey AS turn, {_BODY} AS body FROM u GROUP BY l_orderkey) SELECT turn, regexp_replace(body, 'reaction: Class . [|]', 'reaction: |', 'g') AS text FROM b")
def blanked_fields(spark, sf):
    """Drafts with their class fields blanked, for checks that must not read names as claims."""
    return _bodies(spark, sf).select("turn", turn_text.blanked_fields(F.col("body")).alias("text"))


@query(
    "bond_findings",
    f"""WITH {_DISTINCT}, said AS (SELECT DISTINCT l_orderkey AS turn, l_linenumber AS cand, CASE l_suppkey % 3 WHEN 1 THEN 'formed' ELSE 'broken' END AS side, CASE l_suppkey % 3 WHEN 0 THEN ['C-N', 'C-O'] WHEN 1 THEN ['C-C'] ELSE [] END AS p FROM u),
real AS (SELECT DISTINCT l_orderkey AS turn, l_linenumber AS cand, CASE l_partkey % 2 WHEN 1 THEN 'formed' ELSE 'broken' END AS side, CASE l_partkey % 4 WHEN 0 THEN ['C-O'] WHEN 1 THEN ['C-C', 'N-N'] ELSE ['C-N', 'C-O', 'C-S'] END AS r FROM u WHERE l_quantity < 25),
one AS (SELECT turn, cand, side, list_distinct(flatten(list(p))) AS p FROM said GROUP BY turn, cand, side), rone AS (SELECT turn, cand, side, list_distinct(flatten(list(r))) AS r FROM real GROUP BY turn, cand, side),
j AS (SELECT o.turn, o.cand, o.side, p, coalesce(r, []) AS r FROM one o LEFT JOIN rone USING (turn, cand, side) WHERE EXISTS (SELECT 1 FROM real x WHERE x.turn = o.turn AND x.cand = o.cand))
SELECT turn, CAST(cand AS INT) AS cand, side, 'bond_pair_wrong' AS code, unnest(list_filter(p, lambda x: NOT list_contains(r, x))) AS pair FROM j
UNION ALL SELECT turn, CAST(cand AS INT), side, 'bond_pair_missing', unnest(list_filter(r, lambda x: NOT list_contains(p, x))) FROM j WHERE len(p) > 0""",
)
def bond_findings(spark, sf):
    """Bond pairs read from a row's field against measured ones."""
    u = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("turn"), F.col("l_linenumber").alias("cand"), "l_suppkey", "l_partkey", "l_quantity").distinct()
    merged = lambda df: df.groupBy("turn", "cand", "side").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    field = F.expr("CASE l_suppkey % 3 WHEN 0 THEN 'O-C and N-C broken' WHEN 1 THEN 'C-C formed at C2' ELSE 'nothing' END")
    said = u.select("turn", "cand", F.expr("CASE l_suppkey % 3 WHEN 1 THEN 'formed' ELSE 'broken' END").alias("side"), turn_text.bond_pairs(field).alias("pairs"))
    real = F.expr("CASE l_partkey % 4 WHEN 0 THEN array('C-O') WHEN 1 THEN array('C-C', 'N-N') ELSE array('C-N', 'C-O', 'C-S') END")
    measured = u.where("l_quantity < 25").select("turn", "cand", F.expr("CASE l_partkey % 2 WHEN 1 THEN 'formed' ELSE 'broken' END").alias("side"), real.alias("pairs"))
    return turn_text.bond_findings(merged(said), merged(measured))


@query(
    "blocks_by_mid",
    """WITH b AS (SELECT DISTINCT l_orderkey AS turn, l_linenumber AS step, CASE l_linenumber % 3 WHEN 0 THEN 'molecule' WHEN 1 THEN 'disconnections' ELSE 'deciding' END AS name, CASE WHEN l_suppkey % 4 > 0 THEN 'm' || l_partkey % 3 END AS mid, 'B' || l_partkey AS text FROM lineitem)
SELECT turn, mid, string_agg(text, chr(10) ORDER BY step, text) AS text FROM b WHERE name <> 'molecule' AND mid IS NOT NULL GROUP BY turn, mid""",
)
def blocks_by_mid(spark, sf):
    """A molecule's blocks of a draft, joined in order."""
    b = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("turn"), F.col("l_linenumber").alias("at"), F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'molecule' WHEN 1 THEN 'disconnections' ELSE 'deciding' END").alias("name"),
        F.expr("CASE WHEN l_suppkey % 4 > 0 THEN 'm' || l_partkey % 3 END").alias("mid"), F.expr("'B' || l_partkey || char(10)").alias("text"),
    ).distinct()
    return turn_text.blocks_by_mid(b, ["turn"])


_CLAIM = "CASE o_orderkey % 5 WHEN 0 THEN 'c0 and c2 read forwards, c7 does not' WHEN 1 THEN 'c1, c3 or c4 fall below the cut.' WHEN 2 THEN 'c1 and c2 beat c0' WHEN 3 THEN 'c5 stands alone' ELSE 'so c2 and c2 agree;' END"


@query(
    "spread_claims",
    """WITH v AS (SELECT * FROM (VALUES (0, 'c0 read forwards.'), (0, 'c2 read forwards.'), (1, 'c1 fall below the cut.'), (1, 'c3 fall below the cut.'), (1, 'c4 fall below the cut.')) AS t(k, claim))
SELECT o_orderkey AS turn, claim FROM orders JOIN v ON k = o_orderkey % 5""",
)
def spread_claims(spark, sf):
    """A claim on several candidates becomes one claim each, bounded by candidates outside the list; worked out by hand in the SQL."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("turn"), F.explode(turn_text.spread_claims(F.expr(_CLAIM))).alias("claim"))


_CODES = "CASE o_orderkey % 6 WHEN 0 THEN {o}'leak_phrase', 'jargon'{c} WHEN 1 THEN {o}'jargon'{c} WHEN 2 THEN {o}'schema'{c} ELSE {o}{c} END"


@query(
    "draft_badness",
    """SELECT o_orderkey AS turn, CAST(CASE WHEN o_orderkey % 6 = 0 THEN 3 WHEN o_custkey % 3 = 0 THEN 2 WHEN o_orderkey % 6 = 2 THEN 1 ELSE 0 END AS INT) AS badness FROM orders""",
)
def draft_badness(spark, sf):
    """Tiers of a rejected draft: leaks, false claims, broken form, style."""
    fatal = F.expr(_CODES.format(o="array(", c=")")).cast("array<string>")
    facts = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("numbers"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("turn"), turn_text.draft_badness(fatal, facts, ["leak_phrase", "atom_index"], ["jargon"]).alias("badness"))


@query(
    "repair_text",
    """WITH v AS (SELECT DISTINCT l_orderkey AS turn, l_linenumber, l_partkey, CASE WHEN l_suppkey % 3 > 0 THEN 'DECIDING m' || l_partkey END AS w, CASE WHEN l_suppkey % 2 = 0 THEN 'use m' || l_suppkey || '.' END AS fix FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY l_linenumber, l_partkey, w NULLS FIRST, fix NULLS FIRST) AS no FROM v)
SELECT turn, string_agg('- ' || coalesce(w, 'document') || ': says ' || l_partkey || '.' || CASE WHEN fix IS NULL THEN '' ELSE ' ' || rtrim(fix, '.') || '.' END, chr(10) ORDER BY no) AS text FROM n WHERE no <= 3 GROUP BY turn""",
)
def repair_text(spark, sf):
    """The correction handed back: the first findings by block, with what to write instead."""
    v = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("turn"), "l_linenumber", "l_partkey", F.expr("CASE WHEN l_suppkey % 3 > 0 THEN 'DECIDING m' || l_partkey END").alias("where_"), F.expr("CASE WHEN l_suppkey % 2 = 0 THEN 'use m' || l_suppkey || '.' END").alias("fix")
    ).distinct()
    no = F.row_number().over(Window.partitionBy("turn").orderBy("l_linenumber", "l_partkey", "where_", "fix"))
    return turn_text.repair_text(v.withColumn("no", no).withColumn("detail", F.concat(F.lit("says "), F.col("l_partkey").cast("string"))), ["turn"], 3)


@query("finding_mid", "SELECT DISTINCT l_orderkey AS turn, l_partkey, CASE WHEN l_suppkey % 3 > 0 THEN 'm' || l_partkey END AS mid FROM lineitem")
def finding_mid(spark, sf):
    """The molecule that a finding is about, from its address."""
    where = F.expr("CASE l_suppkey % 3 WHEN 0 THEN 'document' WHEN 1 THEN ' DECIDING m' || l_partkey || ' slot' ELSE 'DISCONNECTIONS m' || l_partkey END")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("turn"), "l_partkey", turn_text.block_mid(where).alias("mid")).distinct()


@query(
    "label_quotes",
    """WITH d AS (SELECT o_orderkey AS turn, 'The label is TAKE c' || o_orderkey % 4 || ', on' AS text FROM orders), m AS (SELECT DISTINCT l_orderkey AS turn, CASE WHEN l_linenumber = 7 THEN 'on' ELSE 'take c' || l_linenumber END AS label FROM lineitem)
SELECT turn, label FROM d JOIN m USING (turn) WHERE label = 'take c' || turn % 4""",
)
def label_quotes(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("turn"), F.concat(F.lit("The label is TAKE c"), (F.col("o_orderkey") % 4).cast("string"), F.lit(", on")).alias("text"))
    m = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("turn"), F.when(F.col("l_linenumber") == 7, "on").otherwise(F.concat(F.lit("take c"), F.col("l_linenumber").cast("string"))).alias("label"))
    return turn_text.label_quotes(d, m)


@query(
    "cycle_described",
    "SELECT DISTINCT l_orderkey AS turn, l_partkey AS mid, l_linenumber AS cand FROM lineitem WHERE l_quantity > 5 AND EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size % 7 = l_linenumber)",
)
def cycle_described(spark, sf):
    """Rows that describe a candidate which the board would refuse."""
    line = table(spark, sf, "lineitem")
    rows = line.where("l_quantity > 5").select(F.col("l_orderkey").alias("turn"), F.col("l_partkey").alias("mid"), F.col("l_linenumber").alias("cand"))
    traps = line.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).where("p_size % 7 = l_linenumber").select(F.col("l_orderkey").alias("turn"), F.col("l_partkey").alias("mid"), F.col("l_linenumber").alias("cand"))
    return turn_text.cycle_described(rows, traps)


@query(
    "ledger_rows",
    """SELECT l_orderkey AS route, l_linenumber AS n, 'r' || l_linenumber || '  m' || l_partkey || '·c' || l_suppkey || '  ' || CASE l_returnflag WHEN 'R' THEN 'FAILED' WHEN 'A' THEN CAST(l_quantity AS BIGINT) % 3 || ' of 2 closed' ELSE CAST(l_quantity AS BIGINT) % 3 || ' of 2 closed  solved' END AS line FROM lineitem""",
)
def ledger_rows(spark, sf):
    status = F.expr("CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'open' ELSE 'solved' END")
    line = table(spark, sf, "lineitem")
    text = lambda c: F.col(c).cast("string")
    return line.select(
        F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("n"), turn_text.ledger_row(F.concat(F.lit("r"), text("l_linenumber")), F.concat(F.lit("m"), text("l_partkey")), F.col("l_suppkey"), status, F.col("l_quantity").cast("long") % 3, F.lit(2)).alias("line")
    )


_TOKENS = "t AS (SELECT vec_id, label, embedding AS e, CASE WHEN vec_id % 5 = 0 THEN -100 ELSE vec_id % len(embedding) END AS y FROM embeddings)"
_NLL = "n AS (SELECT vec_id, label, y, CASE WHEN y = -100 THEN 0.0 ELSE list_max(e) + ln(list_sum([exp(CAST(x AS DOUBLE) - list_max(e)) FOR x IN e])) - CAST(e[y + 1] AS DOUBLE) END AS nll, e[y + 1] = list_max(e) AS correct FROM t)"


def _tokens(spark, sf):
    t = table(spark, sf, "embeddings").withColumn("y", F.when(F.col("vec_id") % 5 == 0, -100).otherwise(F.col("vec_id") % F.size("embedding")).cast("int"))
    nll = losses.cross_entropy(F.col("embedding"), F.col("y"))
    right = F.when(F.col("y") >= 0, F.get("embedding", F.col("y")) == F.array_max("embedding"))
    return t.select("vec_id", F.col("label").alias("role"), F.col("y").alias("label"), nll.alias("nll"), right.alias("correct"), (F.col("vec_id") % 40 - 1).alias("span"))


@query("token_cross_entropy", f"WITH {_TOKENS}, {_NLL} SELECT vec_id, round(nll, 5) AS nll FROM n")
def token_cross_entropy(spark, sf):
    """Negative log-likelihood of each position's label."""
    return _tokens(spark, sf).select("vec_id", F.round("nll", 5).alias("nll"))


@query(
    "role_losses",
    f"WITH {_TOKENS}, {_NLL}, k AS (SELECT count(*) AS total FROM n WHERE y <> -100) SELECT label AS role, count(*) AS tokens, round(avg(nll), 5) AS loss, round(avg(CAST(correct AS DOUBLE)), 5) AS accuracy, round(count(*) / CAST(max(total) AS DOUBLE), 5) AS share FROM n, k WHERE y <> -100 GROUP BY label",
)
def role_losses(spark, sf):
    r = losses.role_losses(_tokens(spark, sf).withColumn("all", F.lit(1)), ["all"])
    return r.select("role", "tokens", F.round("loss", 5).alias("loss"), F.round("accuracy", 5).alias("accuracy"), F.round("share", 5).alias("share"))


@query(
    "action_exact",
    f"WITH {_TOKENS}, {_NLL}, s AS (SELECT vec_id % 40 - 1 AS span, bool_and(correct) AS ok FROM n WHERE y <> -100 AND vec_id % 40 >= 1 GROUP BY 1) SELECT count(*) AS spans, round(avg(CAST(ok AS DOUBLE)), 5) AS exact FROM s",
)
def action_exact(spark, sf):
    """Share of the action spans that are right as a whole."""
    return losses.action_exact(_tokens(spark, sf).withColumn("all", F.lit(1)), ["all"], "span").select("spans", F.round("exact", 5).alias("exact"))
