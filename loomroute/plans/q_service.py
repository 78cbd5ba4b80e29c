"""Service answers as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.operators import service

from . import q_consensus
from .roles import table


@query(
    "normalized_responses",
    """WITH l AS (SELECT DISTINCT l_orderkey AS key, l_returnflag AS backend, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_discount AS d FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY key, backend ORDER BY n, p, s, d) - 1 AS place FROM l WHERE key % 7 > 0)
SELECT key, backend, CAST(CASE WHEN key % 3 = 0 THEN n ELSE place END AS INT) AS rank, CASE WHEN key % 3 = 1 THEN 'a.m' || p ELSE 'm' || p END AS molecules, CASE WHEN key % 2 = 0 THEN d END AS score FROM o WHERE s % 5 > 0""",
)
def normalized_responses(spark, sf):
    """Three spellings of an answer as uniform candidates; errors and rows without molecules give nothing."""
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("backend"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_discount").alias("d")).distinct()
    name = F.concat(F.lit("m"), F.col("p").cast("string"))
    kind = F.col("key") % 3
    row = F.struct(
        F.when((kind == 0) & (F.col("s") % 5 > 0), F.array(name)).alias("molecules"), F.when((kind == 1) & (F.col("s") % 5 > 0), F.concat(F.lit("a."), name)).alias("smiles"), F.when((kind == 2) & (F.col("s") % 5 > 0), F.array(name)).alias("precursors"),
        F.when(F.col("key") % 4 == 0, F.col("d")).alias("score"), F.when(F.col("key") % 4 == 2, F.col("d")).alias("confidence"), F.when(kind == 0, F.col("n")).alias("rank"),
    )
    g = line.groupBy("key", "backend").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "p", "s", "d", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    body = F.to_json(F.struct(F.when(F.col("key") % 7 == 0, "down").alias("error"), F.when(kind == 0, F.col("rows")).alias("candidates"), F.when(kind == 1, F.col("rows")).alias("predictions"), F.when(kind == 2, F.col("rows")).alias("precursors")))
    found = service.normalized(g.select("key", "backend", body.alias("body")))
    return found.select("key", "backend", "rank", F.array_join("molecules", ".").alias("molecules"), "score")


@query(
    "single_step_service",
    f"""WITH {q_consensus.CANDIDATES}, {q_consensus.PLAIN}, {q_consensus.AGG.format(pin='NULL')}, ranked AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY score DESC, best_rank, key) AS place FROM agg)
SELECT product, key, place, score, CASE WHEN (product + key) % 3 = 0 THEN 1.0 WHEN (product + key) % 3 = 1 THEN 0.5 ELSE 0.0 END AS share FROM ranked WHERE place <= 3""",
)
def single_step_service(spark, sf):
    """One-step proposals with the share of their pieces that can be bought."""
    c = q_consensus.candidates(spark, sf)
    share = F.when((F.col("product") + F.col("key")) % 3 == 0, 1.0).when((F.col("product") + F.col("key")) % 3 == 1, 0.5)
    stock = c.select("product", "key").distinct().withColumn("share", share).where("share IS NOT NULL")
    return service.single_step(c, stock, "vote", 3).select("product", "key", "place", "score", "share")


@query("annotations", "SELECT 'k' || p_size AS key, arg_min('note ' || p_partkey, p_partkey) AS note FROM part WHERE p_partkey % 4 > 0 GROUP BY p_size")
def annotations(spark, sf):
    """Notes whose key stands under one of three names; the first of a key stays."""
    p = table(spark, sf, "part")
    key = F.concat(F.lit("k"), F.col("p_size").cast("string"))
    name = lambda i: F.when(F.col("p_partkey") % 4 == i, key)
    return service.annotations(p.select(name(1).alias("key"), name(2).alias("smiles"), name(3).alias("rxn_key"), F.concat(F.lit("note "), F.col("p_partkey").cast("string")).alias("note"), F.col("p_partkey").alias("line")))


@query("models_of_task", "SELECT s_name AS model FROM supplier WHERE s_acctbal > 0 AND s_nationkey % 3 <> 1")
def models_of_task(spark, sf):
    s = table(spark, sf, "supplier")
    tasks = F.when(F.col("s_nationkey") % 3 == 0, F.array(F.lit("retro"), F.lit("forward"))).when(F.col("s_nationkey") % 3 == 1, F.array(F.lit("forward"))).otherwise(F.array(F.lit("retro")))
    return service.enabled(s.select(F.col("s_name").alias("model"), (F.col("s_acctbal") > 0).alias("on"), tasks.alias("tasks")), "retro").select("model")


@query(
    "axis_orders",
    """SELECT l_orderkey AS route, l_linenumber AS n, round(-l_discount, 4) AS by_p, CASE WHEN l_linenumber < 5 THEN CAST(l_linenumber AS DOUBLE) ELSE 99.0 END AS by_rt, CASE WHEN l_suppkey % 4 > 0 THEN round(least(1.0, greatest(0.0, (ln(l_extendedprice + l_quantity) - 2.5) / 9)), 3) END AS by_cost FROM lineitem""",
)
def axis_orders(spark, sf):
    """Sort keys of the three axes, better first; a missing rank is worst, a price must be whole."""
    prices = F.array(F.log("l_extendedprice"), F.when(F.col("l_suppkey") % 4 > 0, F.log("l_quantity")))
    rt = service.axis_key("rt", F.when(F.col("l_linenumber") < 5, F.col("l_linenumber")), prices)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("n"), F.round(service.axis_key("p", F.col("l_discount"), prices), 4).alias("by_p"), F.when(rt > 99, 99.0).otherwise(rt).alias("by_rt"), service.axis_key("cost", F.lit(None), prices).alias("by_cost")
    )


_STEPS = """st AS (SELECT l_orderkey AS board, l_linenumber AS step, min(l_partkey) AS p FROM lineitem GROUP BY ALL)"""


def _board(spark, sf):
    st = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("board"), F.col("l_linenumber").alias("step")).agg(F.min("l_partkey").alias("p"))
    mid = F.concat(F.lit("m"), F.col("p").cast("string"))
    steps = st.where("step <= 3").select("board", "step", mid.alias("parent"), (F.col("p") % 5).alias("cand"), F.expr("CASE p % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'open' ELSE 'solved' END").alias("status"), (F.col("p") % 2).alias("n_closed"), F.lit(2).alias("n_pieces"))
    opened = st.where("step > 3").select("board", F.col("step").alias("place"), mid.alias("mid"), F.lit("r1").alias("under")).groupBy("board", "mid").agg(F.min("place").alias("place"), F.first("under").alias("under"))
    menus = opened.where("place % 2 = 0").select("board", "mid", F.explode(F.array(F.lit(0), F.lit(1))).alias("idx")).withColumn("line", F.concat(F.lit("<c"), F.col("idx").cast("string"), F.lit(" q.5>x</c"), F.col("idx").cast("string"), F.lit(">")))
    closed = st.where("step = 2").select("board", F.concat(F.lit("s"), (F.col("p") % 9).cast("string")).alias("mid"))
    budgets = st.select("board").distinct().select("board", (F.col("board") % 50).alias("left"), F.lit(50).alias("total"))
    return steps, opened, menus, closed, budgets


@query(
    "board_pages",
    f"""WITH {_STEPS}, led AS (SELECT board, string_agg('r' || step || '  m' || p || '·c' || p % 5 || '  ' || CASE p % 3 WHEN 0 THEN 'FAILED' WHEN 1 THEN p % 2 || ' of 2 closed' ELSE p % 2 || ' of 2 closed  solved' END || chr(10), '' ORDER BY step) AS t FROM st WHERE step <= 3 GROUP BY board),
o AS (SELECT board, p, min(step) AS place FROM st WHERE step > 3 GROUP BY ALL), op AS (SELECT board, count(*) AS n, string_agg('  m' || p || ' under r1' || chr(10) || CASE WHEN place % 2 = 0 THEN '    <c0 q.5>x</c0>' || chr(10) || '    <c1 q.5>x</c1>' || chr(10) ELSE '' END, '' ORDER BY place) AS t FROM o GROUP BY board),
cl AS (SELECT board, string_agg(DISTINCT 's' || p % 9, ' ' ORDER BY 's' || p % 9) AS t FROM st WHERE step = 2 GROUP BY board)
SELECT b.board, 'Budget: ' || b.board % 50 || ' of 50 left' || chr(10) || coalesce(led.t, '') || 'OPEN ' || coalesce(n, 0) || chr(10) || coalesce(op.t, '') || 'CLOSED ' || coalesce(cl.t, 'none') || chr(10) AS text
FROM (SELECT DISTINCT board FROM st) b LEFT JOIN led USING (board) LEFT JOIN op USING (board) LEFT JOIN cl USING (board)""",
)
def board_pages(spark, sf):
    """The whole board of a turn as text."""
    return service.board_page(*_board(spark, sf))


@query("board_page_round_trip", "SELECT DISTINCT l_orderkey AS board, true AS carries FROM lineitem")
def board_page_round_trip(spark, sf):
    """Whether the text still carries the open molecules."""
    parts = _board(spark, sf)
    return service.page_carries(service.board_page(*parts), parts[1])


@query(
    "chat_messages",
    """WITH t AS (SELECT conv_id AS episode, turn AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
m AS (SELECT episode, 1 + count(*) FILTER (i % 2 = 0) + count(*) AS n_messages, count(*) FILTER (k < n AND i % 3 > 0) AS n_calls, CAST(max(CASE WHEN k = n THEN i END) AS VARCHAR) AS answer FROM t GROUP BY episode)
SELECT episode, n_messages, n_calls, 'think ' || answer AS answer FROM m""",
)
def chat_messages(spark, sf):
    """Episodes as chat messages: boards, calls with their thinking, and the final answer."""
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").alias("i"))
    turns = t.select("episode", "i", F.when(F.col("i") % 2 == 0, "board").alias("board"), F.concat(F.lit("think "), F.col("i").cast("string")).alias("thinking"), F.when(F.col("i") % 3 > 0, "call").alias("call"))
    m = service.chat_messages(turns, "rules")
    calls = F.size(F.filter("messages", lambda x: x["call"].isNotNull()))
    return m.select("episode", F.size("messages").cast("long").alias("n_messages"), calls.cast("long").alias("n_calls"), F.element_at("messages", -1)["content"].alias("answer"))
