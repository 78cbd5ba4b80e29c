"""Draft rules on made-up drafts: an order is a turn, its text and facts are chosen by its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.functions.keys import dollars_string
from loomroute.operators import draft_rules as rules

from .roles import placed, running, table


def _case(column: str, options: list[str]) -> str:
    """SQL that picks one of the texts by a whole number; both engines read it."""
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(options[:-1])) + f" ELSE '{options[-1]}' END"


def _drafts(spark, sf, text: str):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("turn"), F.expr(text).alias("text"))


def _turns(text: str) -> str:
    return f"d AS (SELECT o_orderkey AS turn, {text} AS text FROM orders)"


ALIASES = {"suzuki": "suzuki", "amide coupling": "amid", "n-arylation": "buchwald", "grignard": "grignard"}
_NAMED = _case("o_orderkey % 5", ["We take c1, a Suzuki step.", "c0 is an amide coupling; c2 is a Grignard.", "The N-arylation of c3 holds.", "No name here, c1.", "A suzuki and an Amide coupling with c2"])
_FACTS = """SELECT l_orderkey AS turn, l_linenumber - 1 AS cand, CASE l_suppkey % 3 WHEN 0 THEN 'applies+makes' WHEN 1 THEN 'applies' END AS tier,
 CASE l_partkey % 4 WHEN 0 THEN 'Suzuki coupling' WHEN 1 THEN 'Amidation' WHEN 2 THEN 'Buchwald-Hartwig N-arylation' ELSE 'Other' END AS name FROM lineitem"""


@query(
    "draft_named",
    f"""WITH {_turns(_NAMED)}, f AS ({_FACTS}), alias AS (SELECT * FROM (VALUES ('suzuki', 'suzuki'), ('amide coupling', 'amid'), ('n-arylation', 'buchwald'), ('grignard', 'grignard')) AS v(word, key)),
want AS (SELECT turn, CAST(unnest(regexp_extract_all(text, '\\bc(\\d)\\b', 1)) AS INT) AS cand FROM d UNION SELECT turn, 1 FROM d),
j AS (SELECT f.turn, tier, lower(name) AS name FROM f JOIN want w ON w.turn = f.turn AND w.cand = f.cand WHERE tier IS NOT NULL),
said AS (SELECT d.turn, word, key FROM d, alias WHERE regexp_matches(lower(text), '\\b' || word || '\\b') AND d.turn IN (SELECT turn FROM j)),
h AS (SELECT s.turn, s.word, coalesce(bool_or(tier = 'applies+makes' AND (contains(name, key) OR contains(name, word))), false) AS earned, coalesce(bool_or(tier = 'applies' AND (contains(name, key) OR contains(name, word))), false) AS partly
  FROM said s JOIN j USING (turn) GROUP BY s.turn, s.word)
SELECT turn, CASE WHEN partly THEN 'named_applies_only' ELSE 'named_unearned' END AS code, word AS detail FROM h WHERE NOT earned""",
)
def draft_named(spark, sf):
    """Reaction names that no template earned on the candidates spoken of."""
    facts = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("turn"), (F.col("l_linenumber") - 1).alias("cand"), F.expr("CASE l_suppkey % 3 WHEN 0 THEN 'applies+makes' WHEN 1 THEN 'applies' END").alias("tier"),
        F.array(F.expr("CASE l_partkey % 4 WHEN 0 THEN 'Suzuki coupling' WHEN 1 THEN 'Amidation' WHEN 2 THEN 'Buchwald-Hartwig N-arylation' ELSE 'Other' END")).alias("names"),
    )
    d = _drafts(spark, sf, _NAMED)
    return rules.named(d, d.select("turn", F.lit(1).alias("cand")), facts, ALIASES)


CLASSES = {"cross-coupling": ["suzuki", "negishi"], "acylation": ["acylation", "amidation"], "reduction": ["reduction", "hydrogenation"], "oxidation": ["oxidation"]}
EXCLUSIVE = [("cross-coupling", "acylation"), ("reduction", "oxidation")]
_CONFLICT = _case("o_orderkey % 4", ["c0 is a Suzuki step. c1 is an acylation.", "This Suzuki amidation closes it; fine.", "A reduction, or an oxidation! And a Negishi acylation.", "nothing"])


@query(
    "draft_named_conflict",
    rf"""WITH {_turns(_CONFLICT)}, s AS (SELECT DISTINCT turn, lower(unnest(string_split(regexp_replace(text, '([.;!?])\s+', '\1' || chr(1), 'g'), chr(1)))) AS s FROM d),
m AS (SELECT turn, regexp_matches(s, '\b(suzuki|negishi)\b') AS a, regexp_matches(s, '\b(acylation|amidation)\b') AS b, regexp_matches(s, '\b(reduction|hydrogenation)\b') AS c, regexp_matches(s, '\boxidation\b') AS e FROM s)
SELECT DISTINCT turn, 'named_conflict' AS code, 'cross-coupling/acylation' AS detail FROM m WHERE a AND b UNION SELECT DISTINCT turn, 'named_conflict', 'reduction/oxidation' FROM m WHERE c AND e""",
)
def draft_named_conflict(spark, sf):
    return rules.named_conflict(_drafts(spark, sf, _CONFLICT), CLASSES, EXCLUSIVE)


RINGS = {"thiazole": "5:NS", "pyridine": "6:N", "furan": "5:O"}
GROUPS = {"lactone": "lactone", "anhydride": "anhydride"}
_WORDS = _case("o_orderkey % 4", ["The thiazoles and a furan.", "Pyridine, lactone; not benzothiazole.", "Two anhydrides here", "plain"])
_PRESENT = "SELECT l_orderkey AS turn, CASE l_partkey % 5 WHEN 0 THEN '5:NS' WHEN 1 THEN '6:N' WHEN 2 THEN 'lactone' WHEN 3 THEN '5:O' ELSE 'none' END AS signature FROM lineitem"


def _absent(words: dict[str, str], code: str) -> str:
    listed = ", ".join(f"('{w}', '{s}')" for w, s in words.items())
    return rf"""WITH {_turns(_WORDS)}, p AS ({_PRESENT}), v AS (SELECT * FROM (VALUES {listed}) AS v(word, sig))
SELECT d.turn, '{code}' AS code, word AS detail FROM d, v WHERE d.turn IN (SELECT turn FROM p) AND regexp_matches(lower(text), '\b' || word || 's?\b') AND NOT EXISTS (SELECT 1 FROM p WHERE p.turn = d.turn AND p.signature = v.sig)"""


def _present(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("turn"), F.expr("CASE l_partkey % 5 WHEN 0 THEN '5:NS' WHEN 1 THEN '6:N' WHEN 2 THEN 'lactone' WHEN 3 THEN '5:O' ELSE 'none' END").alias("signature"))


@query("draft_ring_identity", _absent(RINGS, "ring_identity"))
def draft_ring_identity(spark, sf):
    """Ring words without such a ring on the turn; ring signatures come from a table."""
    return rules.absent_words(_drafts(spark, sf, _WORDS), _present(spark, sf), RINGS, "ring_identity")


@query("draft_functional_group", _absent(GROUPS, "fg_identity"))
def draft_functional_group(spark, sf):
    return rules.absent_words(_drafts(spark, sf, _WORDS), _present(spark, sf), GROUPS, "fg_identity")


_BUY = _case("o_orderkey % 4", ["Both pieces are cheap and purchasable.", "a commercial piece", "So the AND closes on arrival.", "we go on"])


@query(
    "draft_purchasable",
    rf"""WITH {_turns(_BUY)}, t AS (SELECT l_orderkey AS turn, l_partkey AS mid, l_linenumber AS cand, [l_suppkey % 2 = 0, l_suppkey % 3 = 0] AS b FROM lineitem WHERE l_linenumber <= 2),
j AS (SELECT DISTINCT t.*, regexp_matches(text, '(?i)(both .*purchasable|closes on arrival)') AS strong, regexp_matches(text, '(?i)\b(purchasable|commercial)\b|closes on arrival') AS says FROM t JOIN d USING (turn))
SELECT turn, CASE WHEN NOT (b[1] OR b[2]) THEN 'purchasable/none' ELSE 'purchasable/some' END AS code, 'm' || mid || '·c' || cand AS detail FROM j WHERE says AND (NOT (b[1] OR b[2]) OR (strong AND NOT (b[1] AND b[2])))""",
)
def draft_purchasable(spark, sf):
    t = table(spark, sf, "lineitem").where("l_linenumber <= 2").select(
        F.col("l_orderkey").alias("turn"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("mid"), F.col("l_linenumber").alias("cand"), F.array(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey") % 3 == 0).alias("buyable")
    )
    return rules.purchasable(_drafts(spark, sf, _BUY), t.distinct())


_SHAPE = _case("o_orderkey % 5", ["It opens the ring, rings 2 <- 1.", "This keeps the ring intact.", "rings 3 <- 3 and the skeleton is kept; it changes the skeleton", "ring-forming step, rings 1 from 0", "quiet"])


@query(
    "draft_shape",
    rf"""WITH {_turns(_SHAPE)}, t AS (SELECT DISTINCT l_orderkey AS turn, l_partkey AS mid, l_linenumber AS cand, CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS kept, l_partkey % 4 AS rp, l_suppkey % 3 AS rr FROM lineitem WHERE l_linenumber = 1),
j AS (SELECT t.*, text, regexp_matches(text, 'opens the ring|changes the skeleton|ring-forming') AS br, regexp_matches(text, 'ring intact|skeleton is kept') AS ke, regexp_extract(text, 'rings (\d) (<-|from) (\d)', 1) AS a, regexp_extract(text, 'rings (\d) (<-|from) (\d)', 3) AS b FROM t JOIN d USING (turn) WHERE kept IS NOT NULL)
SELECT DISTINCT turn, 'shape/break' AS code, 'm' || mid || '·c' || cand AS detail FROM j WHERE kept AND br AND NOT ke UNION SELECT turn, 'shape/keep', 'm' || mid || '·c' || cand FROM j WHERE NOT kept AND ke AND NOT br
UNION SELECT turn, 'shape/rings', a || '<-' || b FROM j WHERE a <> '' AND (TRY_CAST(a AS INT) <> rp OR TRY_CAST(b AS INT) <> rr)""",
)
def draft_shape(spark, sf):
    t = table(spark, sf, "lineitem").where("l_linenumber = 1").select(
        F.col("l_orderkey").alias("turn"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("mid"), F.col("l_linenumber").alias("cand"), F.expr("CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END").alias("kept"),
        (F.col("l_partkey") % 4).alias("rings_product"), (F.col("l_suppkey") % 3).alias("rings_precursors"),
    )
    return rules.shape(_drafts(spark, sf, _SHAPE), t.distinct())


_COUNT = _case("o_orderkey % 4", ["A 7-atom fragment and a C3 unit.", "The 12 heavy-atom core, C2 building block", "no count", "a 9 atom thing; C1 source"])


@query(
    "draft_counts",
    rf"""WITH {_turns(_COUNT)}, s AS (SELECT DISTINCT l_orderkey AS turn, l_partkey % 13 AS heavy, l_suppkey % 4 AS carbons FROM lineitem),
a AS (SELECT turn, CAST(unnest(regexp_extract_all(text, '\b(\d{{1,3}})[- ](?:heavy[- ]|)atom\b', 1)) AS INT) AS n FROM d), c AS (SELECT turn, CAST(unnest(regexp_extract_all(text, '\bC(\d)\s+(?:unit|building block|fragment|source)\b', 1)) AS INT) AS n FROM d)
SELECT DISTINCT turn, 'count/atoms' AS code, CAST(n AS VARCHAR) AS detail FROM a WHERE turn IN (SELECT turn FROM s) AND NOT EXISTS (SELECT 1 FROM s WHERE s.turn = a.turn AND s.heavy = a.n)
UNION SELECT turn, 'count/carbons', CAST(n AS VARCHAR) FROM c WHERE turn IN (SELECT turn FROM s WHERE heavy <= 8) AND NOT EXISTS (SELECT 1 FROM s WHERE s.turn = c.turn AND heavy <= 8 AND s.carbons = c.n)""",
)
def draft_counts(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("turn"), (F.col("l_partkey") % 13).cast("int").alias("heavy"), (F.col("l_suppkey") % 4).cast("int").alias("carbons"))
    return rules.counts(_drafts(spark, sf, _COUNT), s)


_FLOOR = _case("o_orderkey % 4", ["So route A rests on .103 and route B on 0.05.", "The floor is 1.03, route C at .04", "route A, weakest at .06", "no route"])


@query(
    "draft_route_floor",
    rf"""WITH {_turns(_FLOOR)}, r AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS turn, chr(64 + l_linenumber) AS route, CASE WHEN l_linenumber < 4 THEN l_linenumber / 20.0 + (l_orderkey % 2) / 100.0 END AS w FROM lineitem),
q AS (SELECT turn, unnest(regexp_extract_all(text, '\broute ([A-Z])\b[^.;]{{0,60}}?(0?\.\d+|1\.0+)', 1)) AS route, unnest(regexp_extract_all(text, '\broute ([A-Z])\b[^.;]{{0,60}}?(0?\.\d+|1\.0+)', 2)) AS v FROM d)
SELECT DISTINCT q.turn, 'route_floor' AS code, q.route || ' ' || v AS detail FROM q JOIN r ON r.turn = q.turn AND r.route = q.route WHERE abs(CAST(v AS DOUBLE) - w) > 0.005
UNION SELECT turn, 'route_floor/over_one', '1.03' FROM d WHERE contains(text, 'floor is 1.03') AND turn IN (SELECT turn FROM r WHERE w IS NOT NULL)""",
)
def draft_route_floor(spark, sf):
    r = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("turn"), F.expr("char(64 + l_linenumber)").alias("route"), F.when(F.col("l_linenumber") < 4, F.col("l_linenumber") / 20.0 + (F.col("l_orderkey") % 2) / 100.0).alias("weakest")
    )
    return rules.route_floor(_drafts(spark, sf, _FLOOR), r.distinct())


_HAND = _case("o_orderkey % 5", ["I would run route B and it is also the cheapest; C is cheaper still.", "the cheapest here is route A. I would not claim B.", "route c is the cheapest, C is cheaper", "D is the one I would not claim", "done"])


@query(
    "draft_handover",
    f"""WITH {_turns(_HAND)}, r AS (SELECT DISTINCT l_orderkey AS turn, chr(64 + l_linenumber) AS route FROM lineitem), k AS (SELECT turn, turn % 5 AS k FROM d)
SELECT turn, 'handover/cheapest' AS code, 'B<C' AS detail FROM k WHERE k = 0 UNION ALL SELECT k.turn, 'handover/disowned', route FROM k JOIN r ON r.turn = k.turn WHERE (k = 1 AND route = 'B') OR (k = 3 AND route = 'D')""",
)
def draft_handover(spark, sf):
    """The figures of the five texts are worked out by hand in the SQL."""
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("turn"), F.expr("char(64 + l_linenumber)").alias("route"))
    return rules.handover(_drafts(spark, sf, _HAND), r)


_OPEN = _case("o_orderkey % 6", ["We go.\nopening together: m1 under r1, m2 under r2 | rival cuts, both now", "opening together: m1 under r9, m2 | pieces of the same step", "no clause at all", "opening together: m1, m2, zz9 | all three of them", "opening together: m1 under r1 | as the two wait", "Opening together: m2, m1 | different branches"])


@query(
    "draft_open_together",
    f"""WITH t AS (SELECT o_orderkey AS turn, o_orderkey % 6 AS k, CAST(o_custkey % 3 AS INT) AS n, CASE WHEN o_custkey % 2 = 0 THEN 'r1' ELSE 'r2' END AS u2 FROM orders),
v AS (SELECT turn, 'unearned' AS c, '' AS d FROM t WHERE n < 2 AND k <> 2
UNION ALL SELECT turn, 'missing', '' FROM t WHERE n = 2 AND k = 2
UNION ALL SELECT turn, 'incomplete', 'm2' FROM t WHERE n = 2 AND k = 4
UNION ALL SELECT turn, 'wrong', 'zz9' FROM t WHERE n = 2 AND k = 3
UNION ALL SELECT turn, 'count', 'three' FROM t WHERE n = 2 AND k = 3
UNION ALL SELECT turn, 'under', 'm1' FROM t WHERE n = 2 AND k = 1
UNION ALL SELECT turn, 'under', 'm2' FROM t WHERE n = 2 AND k = 0 AND u2 = 'r1'
UNION ALL SELECT turn, 'relation', 'one' FROM t WHERE n = 2 AND k = 1 AND u2 = 'r2'
UNION ALL SELECT turn, 'relation', 'different' FROM t WHERE n = 2 AND k IN (0, 5) AND u2 = 'r1')
SELECT turn, 'open_together/' || c AS code, d AS detail FROM v""",
)
def draft_open_together(spark, sf):
    """n molecules are opened, m1 under r1 and m2 under u2; the findings of the six texts are worked out by hand in the SQL."""
    o = table(spark, sf, "orders")
    mids = F.array(F.lit("m1"), F.lit("m2"))
    opened = o.select(F.col("o_orderkey").alias("turn"), F.explode(F.slice(mids, F.lit(1), (F.col("o_custkey") % 3).cast("int"))).alias("mid"))
    board = o.select(F.col("o_orderkey").alias("turn"), F.explode(mids).alias("mid"), "o_custkey")
    board = board.select("turn", "mid", F.when((F.col("mid") == "m1") | (F.col("o_custkey") % 2 == 0), "r1").otherwise("r2").alias("under"))
    return rules.open_together(_drafts(spark, sf, _OPEN), opened, board)


_NAMES = _case("o_orderkey % 4", ["The Suzuki branch opens.", "an amide coupling and a Grignard", "ids only", "n-arylation of r2"])


@query(
    "draft_open_named",
    f"""WITH {_turns(_NAMES)}, h AS (SELECT o_orderkey AS turn, CASE o_custkey % 4 WHEN 0 THEN 'we saw a suzuki' WHEN 1 THEN 'amidation, buchwald' WHEN 2 THEN 'the Grignard' ELSE '' END AS t FROM orders),
a AS (SELECT * FROM (VALUES ('suzuki', 'suzuki'), ('amide coupling', 'amid'), ('n-arylation', 'buchwald'), ('grignard', 'grignard')) AS v(word, key))
SELECT d.turn, 'open_named_uncited' AS code, word AS detail FROM d JOIN h USING (turn), a WHERE contains(lower(text), word) AND NOT contains(lower(t), word) AND NOT contains(lower(t), key)""",
)
def draft_open_named(spark, sf):
    history = table(spark, sf, "orders").select(F.col("o_orderkey").alias("turn"), F.expr("CASE o_custkey % 4 WHEN 0 THEN 'we saw a suzuki' WHEN 1 THEN 'amidation, buchwald' WHEN 2 THEN 'the Grignard' ELSE '' END").alias("text"))
    return rules.open_named(_drafts(spark, sf, _NAMES), history, ALIASES)


_END = "'Some words first. Then more of turn ' || o_orderkey || '. ' || " + _case("o_orderkey % 3", ["This closes the branch with pieces from stock; nothing remains open here.", "This closes the branch with pieces from stock! nothing remains closed here", "Something else entirely ends this turn."])


@query(
    "draft_stock_close",
    rf"""WITH t AS (SELECT o_custkey AS episode, o_orderkey AS turn, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS before, o_orderkey % 3 AS k FROM orders),
p AS (SELECT a.episode, a.turn, a.before, count(*) AS hits FROM t a JOIN t b ON a.episode = b.episode AND b.turn < a.turn AND (a.k = b.k OR (a.k < 2 AND b.k < 2)) GROUP BY a.episode, a.turn, a.before)
SELECT episode, turn, hits, before FROM p WHERE before >= 6 AND hits >= greatest(4, before // 2)""",
)
def draft_stock_close(spark, sf):
    """Formula endings. Of the three endings the first two share all of their long words but one in eleven."""
    t = table(spark, sf, "orders").select(F.col("o_custkey").alias("episode"), F.col("o_orderkey").alias("turn"), F.expr(_END).alias("text"))
    return rules.stock_close(t)


_PHRASE = _case("o_orderkey % 4", ["The furan ester.", "the  Furan ester", "a thiazole amide", "another furan"])


@query(
    "draft_target_phrases",
    """WITH p AS (SELECT o_custkey AS episode, o_orderkey AS turn, o_orderkey % 4 AS k, o_custkey % 2 AS has FROM orders),
f AS (SELECT *, CASE k WHEN 2 THEN 'a thiazole amide' WHEN 3 THEN 'another furan' ELSE 'the furan ester' END AS form, has = 1 AND k <> 2 AS ok, CASE WHEN k = 2 THEN 'thiazole' ELSE 'furan' END AS word FROM p),
a AS (SELECT f.*, (SELECT arg_min(g.form, g.turn) FROM f g WHERE g.episode = f.episode AND g.turn < f.turn AND g.ok) AS own FROM f)
SELECT episode, turn, 'target_identity' AS code, word AS detail FROM a WHERE own IS NULL AND NOT ok UNION ALL SELECT episode, turn, 'target_drift', own FROM a WHERE own IS NOT NULL AND form <> own""",
)
def draft_target_phrases(spark, sf):
    """The phrase for an episode's target: nothing that the target lacks, and the same once one was accepted."""
    o = table(spark, sf, "orders")
    phrases = o.select(F.col("o_custkey").alias("episode"), F.col("o_orderkey").alias("turn"), F.expr(_PHRASE).alias("phrase"))
    words = o.where("o_custkey % 2 = 1").select(F.col("o_custkey").alias("episode"), F.lit("furan").alias("word")).distinct()
    return rules.target_phrases(phrases, words, ["furan", "thiazole"])


_PIECE_WORDS = "p AS (SELECT DISTINCT l_orderkey AS turn, CASE l_partkey % 3 WHEN 0 THEN 'amide' WHEN 1 THEN 'furan' ELSE 'ester' END AS word FROM lineitem WHERE l_linenumber <= 3), t AS (SELECT o_orderkey AS turn, CASE o_custkey % 3 WHEN 0 THEN 'amide' WHEN 1 THEN 'furan' ELSE 'lactone' END AS word FROM orders)"


def _piece_words(spark, sf):
    p = table(spark, sf, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("turn"), F.expr("CASE l_partkey % 3 WHEN 0 THEN 'amide' WHEN 1 THEN 'furan' ELSE 'ester' END").alias("word"))
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("turn"), F.expr("CASE o_custkey % 3 WHEN 0 THEN 'amide' WHEN 1 THEN 'furan' ELSE 'lactone' END").alias("word"))
    return p, t


@query("delta_words", f"WITH {_PIECE_WORDS} SELECT p.turn, coalesce(string_agg(p.word, ',' ORDER BY p.word) FILTER (t.word IS NULL), '') AS only_here, coalesce(string_agg(p.word, ',' ORDER BY p.word) FILTER (t.word IS NOT NULL), '') AS both FROM p LEFT JOIN t ON t.turn = p.turn AND t.word = p.word GROUP BY p.turn")
def delta_words(spark, sf):
    """Groups of the pieces that the target lacks, and those that both have."""
    return rules.delta_words(*_piece_words(spark, sf)).select("turn", F.array_join("only", ",").alias("only_here"), F.array_join("both", ",").alias("both"))


@query("draft_delta", f"WITH {_PIECE_WORDS}, s AS (SELECT turn, unnest(['ester', 'lactone']) AS word FROM t WHERE turn IN (SELECT turn FROM p)) SELECT turn, 'delta_absent' AS code, word AS detail FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turn = s.turn AND p.word = s.word) AND NOT EXISTS (SELECT 1 FROM t WHERE t.turn = s.turn AND t.word = s.word)")
def draft_delta(spark, sf):
    p, t = _piece_words(spark, sf)
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("turn"), F.lit("not in the target: the esters, a lactone").alias("text"))
    return rules.delta_absent(d, p, t, ["amide", "furan", "ester", "lactone"])


_SHOWN = "CASE WHEN d >= 10000 THEN printf('$%.0fk', d / 1000) WHEN d >= 1000 THEN printf('$%.1fk', d / 1000) ELSE printf('$%.0f', d) END"


@query(
    "printed_prices",
    f"WITH p AS (SELECT l_orderkey AS turn, l_linenumber % 3 AS cand, CASE WHEN l_suppkey % 5 > 0 THEN floor(l_extendedprice) + 0.337 END AS d FROM lineitem), w AS (SELECT turn, cand, sum(d) AS d FROM p GROUP BY turn, cand HAVING count(d) = count(*)) SELECT DISTINCT turn, {_SHOWN} AS shown FROM (SELECT turn, d FROM p WHERE d IS NOT NULL UNION ALL SELECT turn, d FROM w)",
)
def printed_prices(spark, sf):
    """All price strings of a turn's screen."""
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("turn"), (F.col("l_linenumber") % 3).alias("cand"), F.when(F.col("l_suppkey") % 5 > 0, F.log(F.floor("l_extendedprice") + 0.337)).alias("ln_price"))
    return rules.printed_prices(p)


@query(
    "episode_turns",
    """WITH e AS (SELECT c_custkey AS episode, c_custkey % 2 AS k FROM customer)
SELECT episode, 1 AS turn, 'board one' AS env, 'open' AS call, CASE WHEN k = 1 THEN 'no such molecule' END AS reason FROM e UNION ALL SELECT episode, 2, 'board two', 'rank again', NULL FROM e""",
)
def episode_turns(spark, sf):
    """Messages become turns: refused calls and their replies stay in the turn, the last accepted call counts, a turn without one goes."""
    k = F.col("k") == 1

    def msg(role, content, recipient=None, supervised=None, when=None):
        m = F.struct(F.lit(role).alias("role"), F.lit(recipient).cast("string").alias("recipient"), F.lit(supervised).cast("boolean").alias("supervised"), F.lit(content).alias("content"))
        return m if when is None else F.when(when, m)

    rows = F.array_compact(F.array(
        msg("developer", "rules"), msg("user", "board one"), msg("assistant", "open zz", "tool", False, k), msg("tool", "no such molecule", None, None, k), msg("assistant", "open", "tool", True),
        msg("tool", "board two"), msg("assistant", "rank", "tool", True), msg("assistant", "rank again", "tool", True), msg("tool", "board three"), msg("assistant", "thinking"),
    ))
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("episode"), (F.col("c_custkey") % 2).alias("k"))
    return rules.episode_turns(e.select("episode", F.posexplode(rows).alias("i", "m")).select("episode", "i", "m.*")).select("episode", F.col("turn").cast("int").alias("turn"), "env", "call", "reason")


@query(
    "route_lines",
    """WITH s AS (SELECT l_orderkey AS route, l_linenumber AS n, l_discount AS p, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 5 + 1 END AS rt, l_extendedprice AS d FROM lineitem),
g AS (SELECT route, count(*) AS n, min(p) AS w, arg_min(n, (p, n)) AS at_, count(rt) AS back, max(rt) AS worst, sum(d) AS d FROM s GROUP BY route)
SELECT route, n || ' steps · weakest p' || regexp_replace(printf('%.3f', w), '^0', '') || ' at r' || at_ || ' · rt ' || back || '/' || n || ' back' || CASE WHEN back > 0 THEN ', worst ' || worst ELSE '' END || ' · ' || n || ' leaves · ' || """ + _SHOWN + """ AS line FROM g""",
)
def route_lines(spark, sf):
    """One line of figures for each route."""
    s = placed(table(spark, sf, "lineitem")).withColumn("rt", F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 5 + 1)).withColumn("sum", running("l_extendedprice", "l_orderkey"))
    g = s.groupBy(F.col("l_orderkey").alias("route")).agg(F.count(F.lit(1)).alias("n"), F.min("l_discount").alias("w"), F.min_by("l_linenumber", F.struct("l_discount", "l_linenumber")).alias("at"), F.count("rt").alias("back"), F.max("rt").alias("worst"), F.max_by("sum", "at").alias("cost"))
    c = F.col
    return g.select("route", rules.route_line(c("n"), c("w"), c("at"), c("back"), c("n"), c("worst"), c("n"), None, dollars_string("cost")).alias("line"))
