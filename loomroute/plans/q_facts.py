"""Drafts held against facts, board text and training arrays. Drafts are written from the steps of a route."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.functions import keys
from loomroute.operators import board_text, factcheck

from .roles import STEPS, sql, steps, table

_MENU = "menu AS (SELECT route, pos - 1 AS cand, p, CAST(rt AS DOUBLE) / 8 AS q, CASE WHEN rt <= 5 THEN rt END AS rt, rt <> 7 AS asked, price, product FROM steps)"
_TEXT = "Here c0 is below the cut. Now c1 clears the cut; c0 reads forward but c1 is not recovered. Only one reads forward, all 3 read forward. By the highest q we take c1."


def _menu(spark, sf):
    s = steps(spark, sf)
    return s.select("route", (F.col("pos") - 1).alias("cand"), "p", (F.col("rt").cast("double") / 8).alias("q"), F.when(F.col("rt") <= 5, F.col("rt")).alias("rt"), (F.col("rt") != 7).alias("asked"), "price", "product")


def _drafts(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("route"), F.lit(_TEXT).alias("text"))


_RULES = {
    "cutoff": """SELECT route, 'cutoff/below' AS code, 'c0' AS detail FROM menu WHERE cand = 0 AND p >= 0.05 UNION ALL SELECT route, 'cutoff/above', 'c1' FROM menu WHERE cand = 1 AND p < 0.05""",
    "recovery": """SELECT route, 'rt/yes' AS code, 'c0' AS detail FROM menu WHERE cand = 0 AND rt IS NULL AND asked UNION ALL SELECT route, 'rt/no', 'c1' FROM menu WHERE cand = 1 AND rt IS NOT NULL AND asked""",
    "quantifier": """SELECT route, CASE WHEN n > 1 THEN 'quantifier/only_one' ELSE 'quantifier/all' END AS code, CAST(n AS VARCHAR) AS detail FROM (SELECT route, count(*) FILTER (rt = 1) AS n FROM menu GROUP BY route) WHERE n > 1 OR n < 3""",
    "argmax": """SELECT m.route, 'q_argmax' AS code, 'c1' AS detail FROM menu m JOIN (SELECT route, max(q) AS best FROM menu GROUP BY route) b ON m.route = b.route WHERE cand = 1 AND q < best""",
}


def _violations(spark, sf):
    d, m = _drafts(spark, sf), _menu(spark, sf)
    taken = m.where("cand = 1").select("route", "cand")
    return {
        "cutoff": factcheck.cutoff(d, m, "route", "text"),
        "recovery": factcheck.recovery(d, m, "route", "text"),
        "quantifier": factcheck.quantifier(d, m, "route", "text"),
        "argmax": factcheck.argues_from_best(d, m, taken, "route", "text"),
    }


def _register(rule: str) -> None:
    @query(f"fact_{rule}", sql(STEPS, _MENU, _RULES[rule]))
    def run(spark, sf):
        return _violations(spark, sf)[rule]


for _rule in _RULES:
    _register(_rule)


_ALL = "viol AS (" + " UNION ".join(f"SELECT * FROM ({r})" for r in _RULES.values()) + "), numbered AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY code, detail) AS no FROM viol)"


@query("fact_check", sql(STEPS, _MENU, _ALL, "SELECT route, code, detail, no FROM numbered"))
def fact_check(spark, sf):
    """All rules together, each finding once."""
    return factcheck.check(list(_violations(spark, sf).values()), "route")


@query("fact_describe", sql(STEPS, _MENU, _ALL, "SELECT route, string_agg(code || ': ' || detail, '; ' ORDER BY no) AS text FROM numbered WHERE no <= 6 GROUP BY route"))
def fact_describe(spark, sf):
    return factcheck.describe(fact_check(spark, sf), "route")


@query(
    "fact_quoted",
    sql(STEPS, _MENU, "SELECT route, 'quoted_q' AS code, '.376' AS detail FROM (SELECT DISTINCT route FROM menu) r WHERE NOT EXISTS (SELECT 1 FROM menu m WHERE m.route = r.route AND abs(m.q - 0.376) <= 0.0005) UNION ALL SELECT route, 'quoted_q', '.2503' FROM (SELECT DISTINCT route FROM menu) r WHERE NOT EXISTS (SELECT 1 FROM menu m WHERE m.route = r.route AND abs(m.q - 0.2503) <= 0.0005)"),
)
def fact_quoted(spark, sf):
    """Quoted values against the menu, within the tolerance."""
    m = _menu(spark, sf)
    d = m.select("route").distinct().withColumn("text", F.lit("First q.376, then q .2503, again q.376."))
    return factcheck.quoted_values(d, m, "route", "text")


@query(
    "fact_completeness",
    sql(STEPS, "st AS (SELECT route, count(*) FILTER (p < 0.03) AS n_open, count(*) AS spent FROM steps GROUP BY route)", "SELECT route, CASE WHEN n_open > 0 THEN 'complete/open_left' ELSE 'complete/budget_left' END AS code, CAST(n_open AS VARCHAR) AS detail FROM st WHERE n_open > 0 OR spent * 2 < 7"),
)
def fact_completeness(spark, sf):
    state = steps(spark, sf).groupBy("route").agg(F.count_if(F.col("p") < 0.03).alias("n_open"), F.count(F.lit(1)).alias("spent")).withColumn("budget", F.lit(7))
    d = state.select("route").withColumn("text", F.lit("Everything is closed, and nothing can beat these routes."))
    return factcheck.completeness(d, state, "route", "text")


@query(
    "fact_action_match",
    sql(STEPS, _MENU, "t AS (SELECT route, arg_max(cand, (p, cand)) AS cand FROM menu GROUP BY route)", "SELECT route, 'action/other_candidate' AS code, 'c2' AS detail FROM t WHERE cand <> 2"),
)
def fact_action_match(spark, sf):
    """The last endorsement against the taken candidate."""
    taken = _menu(spark, sf).groupBy("route").agg(F.max_by("cand", F.struct("p", "cand")).alias("cand"))
    d = taken.select("route").withColumn("text", F.lit("I prefer c0. Both c1 and c3 look fine; still we take c2. c4 is worse."))
    return factcheck.action_match(d, taken, "route", "text")


_BOARD = """lines AS (SELECT route, pos, '  m' || pos || ' under r1' || chr(10) || CASE WHEN rt > 2 THEN '    c0 q.5' || chr(10) ELSE '' END || CASE WHEN rt > 4 THEN '    <c1 q.4>x</c1>' || chr(10) ELSE '' END AS line FROM steps)"""


def _boards(spark, sf):
    line = F.concat(
        F.lit("  m"), F.col("pos").cast("string"), F.lit(" under r1\n"), F.when(F.col("rt") > 2, "    c0 q.5\n").otherwise(""), F.when(F.col("rt") > 4, "    <c1 q.4>x</c1>\n").otherwise("")
    )
    g = steps(spark, sf).groupBy("route").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("a"), F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit("Budget: "), F.col("n").cast("string"), F.lit(" of 50 left\nr1  top·c2  1 of 2 closed\nOPEN 1\n"), F.array_join(F.transform("a", lambda x: x["line"]), ""), F.lit("CLOSED none\n"))
    return g.select("route", text.alias("board"))


@query(
    "board_reading",
    sql(STEPS, "SELECT route, count(*) AS budget_left, string_agg('m' || pos, ',' ORDER BY pos) AS open_ids, string_agg('m' || pos, ',' ORDER BY pos) || ',top' AS actionable, CAST(sum(CASE WHEN rt > 4 THEN 2 WHEN rt > 2 THEN 1 ELSE 0 END) AS BIGINT) AS offered FROM steps GROUP BY route"),
)
def board_reading(spark, sf):
    """Ids, menus and budget read back from board text."""
    b = F.col("board")
    sizes = F.aggregate(F.map_values(board_text.menu_sizes(b)), F.lit(0).cast("long"), lambda a, x: a + x)
    return _boards(spark, sf).select(
        "route", board_text.budget(b)["left"].cast("long").alias("budget_left"), F.array_join(board_text.open_ids(b), ",").alias("open_ids"), F.array_join(board_text.actionable_ids(b), ",").alias("actionable"), sizes.alias("offered")
    )


@query(
    "candidate_lines",
    sql(
        STEPS,
        _MENU,
        "l AS (SELECT product, cand, q, rt, asked, CASE WHEN price > 20000 THEN price END AS price, route FROM menu)",
        "SELECT route, cand, 'c' || cand || ' q' || regexp_replace(printf('%.3f', q), '^0', '') || ' ' || CASE WHEN NOT asked THEN 'rt?' WHEN rt IS NULL THEN 'rt-' ELSE 'rt' || rt END || CASE WHEN price IS NULL THEN '' ELSE ' ' || printf('$%.0fk', price / 1000) END AS line FROM l",
    ),
)
def candidate_lines(spark, sf):
    """Menu lines; the total only where all prices are known."""
    m = _menu(spark, sf)
    price = F.array(F.when(F.col("price") > 20000, F.col("price")))
    return m.select("route", "cand", board_text.candidate_line(F.col("cand"), F.col("q"), F.col("rt"), F.col("asked"), price, keys.dollars_string).alias("line"))


@query(
    "aligned_arrays",
    """WITH t AS (SELECT conv_id, turn, role = 'assistant' AS s, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) AS i, length(unnest(string_split(coalesce(text, ''), ' '))) AS tok FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS place, count(*) OVER (PARTITION BY conv_id) AS total FROM t),
k AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS spans FROM conversations GROUP BY conv_id)
SELECT n.conv_id, max(total) - 1 AS n_ids, CAST(sum(tok) FILTER (place < total) AS BIGINT) AS id_sum, CAST(sum(tok) FILTER (s AND place > 1) AS BIGINT) AS label_sum, count(*) FILTER (s AND place > 1) AS n_labels, max(k.spans) - 1 AS last_span FROM n JOIN k ON n.conv_id = k.conv_id GROUP BY n.conv_id""",
)
def aligned_arrays(spark, sf):
    """Token, label and span arrays of an episode, shifted by one; digests of them."""
    c = table(spark, sf, "conversations")
    tokens = F.transform(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda w: F.length(w))
    m = c.select("conv_id", "turn", tokens.alias("tokens"), (F.col("role") == "assistant").alias("s"))
    a = board_text.aligned_arrays(m, "conv_id", "turn", "tokens", "s")
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda acc, v: acc + v)
    labels = F.filter("labels", lambda v: v != -100)
    return a.select(
        "conv_id",
        F.size("input_ids").cast("long").alias("n_ids"),
        total(F.col("input_ids")).alias("id_sum"),
        F.when(F.size(labels) > 0, total(labels)).alias("label_sum"),
        F.size(labels).cast("long").alias("n_labels"),
        F.array_max("spans").cast("long").alias("last_span"),
    )
