"""Text and action queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.functions import keys, smiles
from loomroute.operators import actions, claims

from .roles import STEPS, running, sql, steps, table

_LINES = """lines AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'open m' || user_id WHEN 'view' THEN 'rank m' || user_id || ' c' || (event_id % 4) || ',c' || (event_id % 4 + 1)
 WHEN 'purchase' THEN 'done a.c' || (event_id % 9) ELSE CASE WHEN value > 50 THEN 'dead m' || user_id || ' cutoff' ELSE event_type END END AS line FROM events)"""


def _lines(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    mid = F.concat(F.lit("m"), F.col("user_id").cast("string"))
    line = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("open "), mid))
        .when(F.col("event_type") == "view", F.concat(F.lit("rank "), mid, F.lit(" c"), (i % 4).cast("string"), F.lit(",c"), (i % 4 + 1).cast("string")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("done a.c"), (i % 9).cast("string")))
        .otherwise(F.when(F.col("value") > 50, F.concat(F.lit("dead "), mid, F.lit(" cutoff"))).otherwise(F.col("event_type")))
    )
    return e.select("event_id", "user_id", line.alias("line"))


@query(
    "action_grammar",
    sql(
        _LINES,
        r"""SELECT event_id, CASE WHEN regexp_matches(line, '^open\s+[A-Za-z0-9]+$') THEN 'open' WHEN regexp_matches(line, '^rank\s+[A-Za-z0-9]+\s+c\d+(,c\d+)*$') THEN 'rank' WHEN regexp_matches(line, '^dead\s+[A-Za-z0-9]+\s+(floor|cutoff|exhausted)$') THEN 'dead' WHEN regexp_matches(line, '^done(\s+[A-Za-z0-9]+\.c\d+)*$') THEN 'done' END AS verb,
 CASE WHEN regexp_matches(line, '^(open|rank|dead)\s') THEN regexp_extract(line, '^\w+\s+([A-Za-z0-9]+)', 1) WHEN starts_with(line, 'done ') THEN 'a' END AS mid, CAST(CASE WHEN regexp_matches(line, '^(open|rank|dead|done)\s') THEN len(regexp_extract_all(line, '\bc(\d+)', 1)) END AS BIGINT) AS n_cands FROM lines""",
    ),
)
def action_grammar(spark, sf):
    p = _lines(spark, sf).withColumn("a", actions.parse_line(F.col("line")))
    return p.select("event_id", "a.verb", "a.mid", F.when(F.col("a").isNotNull(), F.size("a.cands")).cast("long").alias("n_cands"))


_PAYLOAD = """pay AS (SELECT event_id, event_type, value, CASE event_type WHEN 'click' THEN '{"actions":[{"type":"open","mid":"m' || user_id || '"}]}' WHEN 'view' THEN '{"actions":[{"type":"rank","mid":"m1","order":[' || (event_id % 3) || ',' || (event_id % 2) || ']}]}'
 WHEN 'purchase' THEN '{"actions":[{"type":"rank","mid":"m1"}]}' ELSE CASE WHEN value > 60 THEN '{"actions":[]}' WHEN value > 30 THEN '{"actions":[{"type":"fly"}]}' WHEN value > 10 THEN '{"actions":[{"type":"dead","mid":"x","reason":"bored"}]}' ELSE '{"actions":[{"type":"open"}]}' END END AS payload FROM events)"""


def _payloads(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    v = F.col("value")
    payload = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"actions":[{"type":"open","mid":"m'), F.col("user_id").cast("string"), F.lit('"}]}')))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"actions":[{"type":"rank","mid":"m1","order":['), (i % 3).cast("string"), F.lit(","), (i % 2).cast("string"), F.lit("]}]}")))
        .when(F.col("event_type") == "purchase", F.lit('{"actions":[{"type":"rank","mid":"m1"}]}'))
        .otherwise(
            F.when(v > 60, F.lit('{"actions":[]}')).when(v > 30, F.lit('{"actions":[{"type":"fly"}]}')).when(v > 10, F.lit('{"actions":[{"type":"dead","mid":"x","reason":"bored"}]}')).otherwise(F.lit('{"actions":[{"type":"open"}]}'))
        )
    )
    return e.select("event_id", "event_type", "value", payload.alias("payload"))


@query(
    "action_json",
    sql(
        _PAYLOAD,
        "SELECT event_id, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN CASE WHEN event_id % 3 = event_id % 2 THEN 'repeated_candidate' END WHEN 'purchase' THEN 'rank_without_order' ELSE CASE WHEN value > 60 THEN 'empty' WHEN value > 30 THEN 'unknown_verb' WHEN value > 10 THEN 'unknown_reason' ELSE 'missing_molecule' END END AS rejected FROM pay",
    ),
)
def action_json(spark, sf):
    return _payloads(spark, sf).select("event_id", actions.reject_json(F.col("payload")).alias("rejected"))


@query(
    "props_json",
    "SELECT event_type, count(*) AS n, CAST(sum(CAST(props ->> 'k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type",
)
def props_json(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


_CMP = (
    STEPS,
    "g AS (SELECT route, arm, arg_min(reactant % 3, pos) AS verb, arg_min(product, pos) AS mid, list(rt ORDER BY pos) AS cands FROM steps GROUP BY route, arm)",
    "p AS (SELECT route, arg_max(reactant % 3, pos) AS verb, arg_max(product, pos) AS mid, list(rt ORDER BY p, pos) AS cands FROM steps WHERE p > 0.01 GROUP BY route)",
    """c AS (SELECT g.route, arm, p.route IS NOT NULL AS parsed, coalesce(p.verb = g.verb, false) AS verb_ok, coalesce(p.mid = g.mid, false) AS mid_ok, coalesce(p.cands[1] = g.cands[1], false) AS head_ok, coalesce(list_sort(p.cands) = list_sort(g.cands), false) AS set_ok,
 coalesce(p.cands = g.cands AND p.verb = g.verb AND p.mid = g.mid, false) AS exact FROM g LEFT JOIN p ON g.route = p.route)""",
)


def _compared(spark, sf):
    s = steps(spark, sf)

    def shaped(df, pick, order):
        a = F.array_sort(F.collect_list(F.struct(*order, F.col("rt"))))
        return df.groupBy("route").agg(F.first("arm").alias("arm"), pick(F.col("reactant") % 3, F.col("pos")).alias("verb"), pick(F.col("product"), F.col("pos")).alias("mid"), F.transform(a, lambda x: x["rt"]).alias("cands"))

    gold, predicted = shaped(s, F.min_by, ["pos"]), shaped(s.where("p > 0.01"), F.max_by, ["p", "pos"])
    return actions.compare(gold, predicted, "route").join(gold.select("route", "arm"), "route")


@query("action_compare", sql(*_CMP, "SELECT route, parsed, verb_ok, mid_ok, head_ok, set_ok, exact FROM c"))
def action_compare(spark, sf):
    return _compared(spark, sf).drop("arm")


_RATES = ["parsed", "verb_ok", "mid_ok", "head_ok", "set_ok", "exact"]


@query("action_rates", sql(*_CMP, "SELECT arm, count(*) AS n, " + ", ".join(f"round(count(*) FILTER ({f}) / CAST(count(*) AS DOUBLE), 4) AS {f}" for f in _RATES) + " FROM c GROUP BY arm"))
def action_rates(spark, sf):
    return actions.rates(_compared(spark, sf), _RATES, ["arm"])


@query(
    "clause_claims",
    r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([.;!?])\s+', '\1' || chr(1), 'g') AS t FROM documents),
u AS (SELECT doc_id, regexp_replace(t, '\bwhile\b|\bwhereas\b|,\s+but\b|:\s+|\s+[—–]\s+|\s+--\s+', chr(1), 'g') AS t FROM t),
v AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '\bbut\b(\s+c\d)', chr(1) || '\1', 'g'), chr(1))) AS c FROM u)
SELECT doc_id, count(*) FILTER (regexp_matches(c, '\S')) AS n_clauses, CAST(coalesce(sum(length(c)) FILTER (regexp_matches(c, '\S')), 0) AS BIGINT) AS clause_chars FROM v GROUP BY doc_id""",
)
def clause_claims(spark, sf):
    c = table(spark, sf, "documents").select("doc_id", claims.clauses(F.col("text")).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n_clauses"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("clause_chars"))


@query(
    "quoted_numbers",
    sql(
        STEPS,
        "facts AS (SELECT product, round(p, 4) AS v FROM steps)",
        "said AS (SELECT product, route, pos, round(p + CASE WHEN rt > 5 THEN 0.004 ELSE 0.0003 END, 4) AS v FROM steps)",
        "SELECT product, route, pos FROM said c WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.product = c.product AND abs(c.v - f.v) <= 0.0005)",
    ),
)
def quoted_numbers(spark, sf):
    """Quoted values that no menu value of the product supports within the tolerance."""
    s = steps(spark, sf)
    facts = s.select("product", F.round("p", 4).alias("v"))
    said = s.select("product", "route", "pos", F.round(F.col("p") + F.when(F.col("rt") > 5, 0.004).otherwise(0.0003), 4).alias("v"))
    return claims.unsupported(said, facts, "product", "v", 0.0005).select("product", "route", "pos")


@query(
    "sentence_counts",
    r"SELECT conv_id, turn, CAST(len(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\S'))) AS BIGINT) AS n_sentences FROM conversations",
)
def sentence_counts(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", claims.sentence_count(F.col("text")).alias("n_sentences"))


_TEMPLATE = "Route {route} of {target}: {n} steps, cost {cost}; again {route}."


@query(
    "template_round_trip",
    sql(STEPS, "r AS (SELECT route, min(target) AS target, count(*) AS n, CAST(CAST(round(sum(price)) AS BIGINT) AS VARCHAR) AS cost FROM steps GROUP BY route)", "SELECT CAST(route AS VARCHAR) AS route, CAST(target AS VARCHAR) AS target, CAST(n AS VARCHAR) AS n, cost FROM r"),
)
def template_round_trip(spark, sf):
    """Rows written through a template and read back from the text."""
    s = steps(spark, sf, at=True).withColumn("sum", running("price", "route"))
    r = s.groupBy("route").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("n"), F.round(F.max_by("sum", "at")).cast("long").alias("cost"))
    text = claims.fill(_TEMPLATE, {c: F.col(c) for c in ("route", "target", "n", "cost")})
    return r.select(claims.read_template(text, _TEMPLATE).alias("x")).select("x.route", "x.target", "x.n", "x.cost")


@query(
    "completion_kinds",
    r"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<think>' || coalesce(text, '') || '</think><act>open a</act>' WHEN turn % 3 = 1 THEN '<think>' || coalesce(text, '') ELSE coalesce(text, '') END AS t FROM conversations)
SELECT CASE WHEN contains(t, '<act>') THEN 'act' WHEN contains(t, '<think>') THEN 'cut' ELSE 'plain' END AS kind, count(*) AS n FROM c GROUP BY 1""",
)
def completion_kinds(spark, sf):
    text = F.coalesce("text", F.lit(""))
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>"), text, F.lit("</think><act>open a</act>"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("<think>"), text)).otherwise(text)
    return table(spark, sf, "conversations").select(claims.completion_parts(t)["kind"].alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "heading_number_text",
    sql(STEPS, "SELECT route, pos, CASE WHEN p = 0 THEN '.000' ELSE regexp_replace(printf('%.3f', p), '^0', '') END AS shown, 'rt' || rt AS rank FROM steps"),
)
def heading_number_text(spark, sf):
    """Signals of a menu line as text."""
    return steps(spark, sf).select("route", "pos", keys.short_number("p").alias("shown"), keys.recovered("rt", F.lit(True)).alias("rank"))


@query(
    "smiles_counts",
    """WITH n AS (SELECT p_partkey AS id, repeat('C', CAST(p_size % 7 + 1 AS INTEGER)) || '(=O)N' || repeat('c', CAST(p_size % 3 AS INTEGER)) || 'Cl' AS s, p_size % 7 + 1 + p_size % 3 AS carbons FROM part)
SELECT id, s AS structure, CAST(carbons + 3 AS BIGINT) AS heavy, CAST(carbons AS BIGINT) AS carbons, 1 AS chlorines FROM n""",
)
def smiles_counts(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat(F.repeat(F.lit("C"), (F.col("p_size") % 7 + 1).cast("int")), F.lit("(=O)N"), F.repeat(F.lit("c"), (F.col("p_size") % 3).cast("int")), F.lit("Cl"))
    s = p.select(F.col("p_partkey").alias("id"), text.alias("structure"))
    f = smiles.formula(F.col("structure"))
    return s.select("id", "structure", smiles.heavy_atoms(F.col("structure")).cast("long").alias("heavy"), F.element_at(f, "C").cast("long").alias("carbons"), F.element_at(f, "Cl").cast("int").alias("chlorines"))


@query(
    "distinct_steps_text",
    sql(STEPS, "d AS (SELECT target, product, reactant, min((route, pos)) AS first_seen FROM steps GROUP BY ALL)", "SELECT target, string_agg(product || '>>' || reactant, ' ' ORDER BY first_seen) AS steps, count(*) AS n FROM d GROUP BY target"),
)
def distinct_steps_text(spark, sf):
    """Distinct steps over all routes of a target in first-seen order."""
    d = steps(spark, sf).groupBy("target", "product", "reactant").agg(F.min(F.struct("route", "pos")).alias("seen"))
    text = F.concat(F.col("product").cast("string"), F.lit(">>"), F.col("reactant").cast("string"))
    g = d.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("seen", text.alias("t")))).alias("a"))
    return g.select("target", F.array_join(F.transform("a", lambda x: x["t"]), " ").alias("steps"), F.size("a").cast("long").alias("n"))


@query(
    "open_choice",
    sql(
        STEPS,
        "v AS (SELECT DISTINCT route, product % 5 AS m FROM steps), o AS (SELECT DISTINCT route, product % 5 AS m FROM steps WHERE p >= 0.05)",
        "SELECT route, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS left_open FROM (SELECT route, m FROM v EXCEPT SELECT route, m FROM o) GROUP BY route",
    ),
)
def open_choice(spark, sf):
    """What could be opened and was not."""
    m = F.col("product") % 5
    g = steps(spark, sf).groupBy("route").agg(F.collect_set(m).alias("v"), F.collect_set(F.when(F.col("p") >= 0.05, m)).alias("o"))
    rest = F.array_sort(F.array_except("v", "o"))
    return g.where(F.size(rest) > 0).select("route", F.array_join(F.transform(rest, lambda x: x.cast("string")), ",").alias("left_open"))


@query(
    "running_scope",
    sql(STEPS, "f AS (SELECT target, route, product, row_number() OVER (PARTITION BY target, product ORDER BY route, pos) = 1 AS fresh FROM steps)", "n AS (SELECT target, route, CAST(sum(CAST(fresh AS INT)) AS BIGINT) AS fresh FROM f GROUP BY target, route)", "SELECT target, route, CAST(sum(fresh) OVER (PARTITION BY target ORDER BY route) AS BIGINT) AS in_scope FROM n"),
)
def running_scope(spark, sf):
    """Distinct molecules of a route and all earlier ones of the target: first sightings, then a running sum."""
    w = Window.partitionBy("target", "product").orderBy("route", "pos")
    f = steps(spark, sf).withColumn("fresh", (F.row_number().over(w) == 1).cast("int"))
    n = f.groupBy("target", "route").agg(F.sum("fresh").alias("fresh"))
    return n.select("target", "route", F.sum("fresh").over(Window.partitionBy("target").orderBy("route")).alias("in_scope"))
