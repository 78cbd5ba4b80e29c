"""Corpus queries over documents, conversations, labels and the benchmark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomroute.catalog import query
from loomroute.operators import corpus

from .roles import STEPS, sql, steps, table


@query(
    "trajectory_turns",
    """WITH o AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, length(text) AS asked_chars, length(reply) AS reply_chars FROM o WHERE role = 'user' AND next_role = 'assistant'""",
)
def trajectory_turns(spark, sf):
    """User and assistant messages paired into turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    o = table(spark, sf, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("reply", F.lead("text").over(w))
    return o.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.length("text").cast("long").alias("asked_chars"), F.length("reply").cast("long").alias("reply_chars"))


@query(
    "trajectory_validate",
    """WITH c AS (SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n, count(*) FILTER (role = 'assistant') AS replies, count(*) FILTER (text IS NULL OR text = '') AS blank, arg_min(role, turn) AS opens, arg_max(role, turn) AS ends FROM conversations GROUP BY conv_id)
SELECT conv_id, concat_ws(',', CASE WHEN last_turn - first_turn + 1 <> n THEN 'format/gap' END, CASE WHEN opens = 'assistant' THEN 'format/opens_with_reply' END, CASE WHEN ends <> 'assistant' THEN 'action/no_last_reply' END, CASE WHEN replies = 0 THEN 'action/no_reply' END, CASE WHEN blank > 0 THEN 'format/blank' END) AS issues, n AS n_turns FROM c""",
)
def trajectory_validate(spark, sf):
    """Issue codes of each record, at most one of a kind."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.min("turn").alias("a"), F.max("turn").alias("z"), F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("role") == "assistant").alias("replies"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("blank"), F.min_by("role", "turn").alias("opens"), F.max_by("role", "turn").alias("ends")
    )
    rules = {
        "format/gap": F.col("z") - F.col("a") + 1 != F.col("n_turns"),
        "format/opens_with_reply": F.col("opens") == "assistant",
        "action/no_last_reply": F.col("ends") != "assistant",
        "action/no_reply": F.col("replies") == 0,
        "format/blank": F.col("blank") > 0,
    }
    return c.select("conv_id", F.array_join(corpus.issues(rules), ",").alias("issues"), "n_turns")


@query(
    "validation_summary",
    """WITH c AS (SELECT conv_id, arg_max(role, turn) AS ends, count(*) FILTER (role = 'assistant') AS replies FROM conversations GROUP BY conv_id)
SELECT count(*) AS records, count(*) FILTER (ends = 'assistant' AND replies > 0) AS clean, round(count(*) FILTER (ends = 'assistant' AND replies > 0) / CAST(greatest(count(*), 1) AS DOUBLE), 4) AS clean_share, CAST(sum(replies) AS BIGINT) AS replies FROM c""",
)
def validation_summary(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("ends"), F.count_if(F.col("role") == "assistant").alias("replies"))
    clean = F.count_if((F.col("ends") == "assistant") & (F.col("replies") > 0))
    return c.agg(F.count(F.lit(1)).alias("records"), clean.alias("clean"), F.round(clean / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("clean_share"), F.sum("replies").alias("replies"))


_ISSUES = """iss AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, concat_ws(',', CASE WHEN d.text IS NULL OR length(d.text) < 40 THEN 'short' END, CASE WHEN contains(d.text, ' | ') THEN 'table' END, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'toxic' END, CASE WHEN coalesce(l.quality, 1) = 0 THEN 'low' END) AS issues
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _issues(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    j = d.join(lab, "doc_id", "left")
    rules = {"short": F.col("text").isNull() | (F.length("text") < 40), "table": F.contains("text", F.lit(" | ")), "toxic": F.coalesce("toxic", F.lit(0)) == 1, "low": F.coalesce("quality", F.lit(1)) == 0}
    return j.select("doc_id", "source", "lang", "n_chars", corpus.issues(rules).alias("codes"))


@query("corpus_issues", sql(_ISSUES, "SELECT doc_id, issues FROM iss"))
def corpus_issues(spark, sf):
    return _issues(spark, sf).select("doc_id", F.array_join("codes", ",").alias("issues"))


@query(
    "corpus_reject_split",
    sql(
        _ISSUES,
        "ok AS (SELECT doc_id FROM iss WHERE NOT (list_has_any(string_split(issues, ','), ['short', 'toxic'])))",
        "h AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM ok)",
        "SELECT doc_id, CASE WHEN k <= greatest(1, CAST(floor(n * 0.05) AS BIGINT)) THEN 'valid' ELSE 'train' END AS part FROM h",
    ),
)
def corpus_reject_split(spark, sf):
    """Records with a blocking code go; the rest is split by record in hash order."""
    ok = _issues(spark, sf).where(~F.arrays_overlap("codes", F.array(F.lit("short"), F.lit("toxic")))).select("doc_id")
    return corpus.split_share(ok, "doc_id", 0.05).select("doc_id", "part")


@query(
    "split_by_target",
    "WITH u AS (SELECT source, row_number() OVER (ORDER BY md5('0:' || source), source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, d.source, CASE WHEN k <= greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN 'valid' ELSE 'train' END AS part FROM documents d JOIN u ON d.source = u.source",
)
def split_by_target(spark, sf):
    """All records of a unit land in the same part."""
    return corpus.split_share(table(spark, sf, "documents").select("doc_id", "source"), "source", 0.1).select("doc_id", "source", "part")


@query(
    "stratified_probe",
    sql(
        STEPS,
        "l AS (SELECT route, count(*) AS depth FROM steps GROUP BY route)",
        "SELECT depth, route, place FROM (SELECT depth, route, row_number() OVER (PARTITION BY depth ORDER BY md5('7:' || route), route) AS place FROM l) WHERE place <= 5",
    ),
)
def stratified_probe(spark, sf):
    """Five routes of each depth in seeded order: the sample is the feature."""
    depth = steps(spark, sf).groupBy("route").agg(F.count(F.lit(1)).alias("depth"))
    return corpus.stratified(depth, "depth", "route", 5, seed=7).select("depth", "route", "place")


#: Data-parallel ranks that read the corpus.
RANKS = 16


def _streams(spark, sf):
    return table(spark, sf, "documents").select(F.pmod("doc_id", F.lit(RANKS)).alias("stream"), "doc_id", "n_chars")


@query("pack_sequences")
def pack_sequences(spark, sf):
    """Documents of each rank packed in order; checked against a plain loop in the tests."""
    return corpus.pack(_streams(spark, sf), "stream", "doc_id", "n_chars", 16_384).select("stream", "doc_id", "pack", "offset")


@query("packing_stats")
def packing_stats(spark, sf):
    return corpus.packing_stats(corpus.pack(_streams(spark, sf), "stream", "doc_id", "n_chars", 16_384), "n_chars", 16_384)


_TOK = "tok AS (SELECT conv_id, turn, role, generate_subscripts(string_split(text, ' '), 1) AS i, unnest(string_split(text, ' ')) AS w FROM conversations WHERE text IS NOT NULL), t AS (SELECT conv_id, turn, role, length(w) / 10.0 AS nll, length(w) < 9 AS correct, w <> '' AS valid FROM tok)"


def _tokens(spark, sf):
    w = F.explode(F.split("text", " ", -1)).alias("w")
    t = table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "role", w)
    return t.select("conv_id", "turn", "role", (F.length("w") / 10.0).alias("nll"), (F.length("w") < 9).alias("correct"), (F.col("w") != "").alias("valid"))


@query("role_metrics", sql(_TOK, "SELECT role, count(*) AS tokens, round(avg(nll), 4) AS loss, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round(count(*) / CAST((SELECT count(*) FROM t WHERE valid) AS DOUBLE), 4) AS share FROM t WHERE valid GROUP BY role"))
def role_metrics(spark, sf):
    m = corpus.role_metrics(_tokens(spark, sf))
    return m.select("role", "tokens", *[F.round(c, 4).alias(c) for c in ("loss", "accuracy", "share")])


@query("span_exact_match", sql(_TOK, "s AS (SELECT conv_id, turn, role, bool_and(correct) AS exact FROM t WHERE valid GROUP BY ALL)", "SELECT role, count(*) AS spans, count(*) FILTER (exact) AS exact_spans, round(avg(CASE WHEN exact THEN 1.0 ELSE 0.0 END), 4) AS exact_match FROM s GROUP BY role"))
def span_exact_match(spark, sf):
    s = corpus.span_exact(_tokens(spark, sf), ["conv_id", "turn", "role"])
    return s.groupBy("role").agg(F.count(F.lit(1)).alias("spans"), F.sum("exact").cast("long").alias("exact_spans"), F.round(F.avg(F.col("exact").cast("double")), 4).alias("exact_match"))


_BAG = r"""words AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(coalesce(text, '')), '[^\s.,;:!?()"'']+')) AS word FROM conversations),
bags AS (SELECT conv_id, turn, word, count(*) AS n FROM words GROUP BY ALL), sizes AS (SELECT conv_id, turn, sum(n) AS size FROM bags GROUP BY ALL),
sh AS (SELECT a.conv_id, a.turn, b.turn AS earlier, sum(least(a.n, b.n)) AS m FROM bags a JOIN bags b ON a.conv_id = b.conv_id AND a.word = b.word AND b.turn < a.turn GROUP BY ALL),
best AS (SELECT conv_id, turn, max(m) AS m FROM sh GROUP BY ALL)"""


@query("repetition", sql(_BAG, "SELECT s.conv_id, s.turn, round(coalesce(m, 0) / CAST(size AS DOUBLE), 4) AS overlap, coalesce(m, 0) / CAST(size AS DOUBLE) >= 0.5 AS repeats FROM sizes s LEFT JOIN best b ON s.conv_id = b.conv_id AND s.turn = b.turn"))
def repetition(spark, sf):
    """Bag overlap of a turn with its most similar earlier turn."""
    r = corpus.repetition(table(spark, sf, "conversations"), "conv_id", "turn", "text", 0.5)
    return r.select("conv_id", "turn", F.round("overlap", 4).alias("overlap"), "repeats")


@query(
    "restates",
    sql(
        _BAG,
        "seen AS (SELECT a.conv_id, a.turn, sum(a.n) AS m FROM bags a WHERE EXISTS (SELECT 1 FROM bags b WHERE b.conv_id = a.conv_id AND b.word = a.word AND b.turn < a.turn) GROUP BY ALL)",
        "SELECT s.conv_id, s.turn, round(coalesce(m, 0) / CAST(size AS DOUBLE), 4) AS known, coalesce(m, 0) / CAST(size AS DOUBLE) >= 0.8 AS restates FROM sizes s LEFT JOIN seen b ON s.conv_id = b.conv_id AND s.turn = b.turn",
    ),
)
def restates(spark, sf):
    """Share of a turn's words that any earlier turn of the record has used."""
    bags = corpus.word_bags(table(spark, sf, "conversations"), ["conv_id", "turn"], "text")
    first = bags.groupBy("conv_id", "word").agg(F.min("turn").alias("first_turn"))
    j = bags.join(first, ["conv_id", "word"]).groupBy("conv_id", "turn").agg((F.sum(F.when(F.col("first_turn") < F.col("turn"), F.col("n")).otherwise(0)) / F.sum("n")).alias("known"))
    return j.select("conv_id", "turn", F.round("known", 4).alias("known"), (F.col("known") >= 0.8).alias("restates"))


@query(
    "leakage_exclusion",
    r"""WITH k AS (SELECT DISTINCT md5(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k FROM benchmark), p AS (SELECT doc_id, md5(regexp_replace(lower(unnest(string_split(coalesce(text, ''), chr(10)))), '\s+', ' ', 'g')) AS k FROM documents)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p JOIN k USING (k))""",
)
def leakage_exclusion(spark, sf):
    """Documents without a line that equals a benchmark item after normalisation."""
    norm = lambda c: F.md5(F.regexp_replace(F.lower(c), r"\s+", " "))
    keys_ = table(spark, sf, "benchmark").select(norm(F.col("text")).alias("k")).distinct()
    d = table(spark, sf, "documents")
    lines = d.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line")).select("doc_id", norm(F.col("line")).alias("k"))
    return d.select("doc_id").join(lines.join(keys_, "k", "left_semi").select("doc_id"), "doc_id", "left_anti")


@query(
    "special_token_leak",
    r"""SELECT 'documents' AS origin, count(*) AS n, count(*) FILTER (regexp_matches(text, '<\|[a-z_]+\|>|\[/?INST\]|</?s>')) AS leaks FROM documents UNION ALL SELECT 'pages', count(*), count(*) FILTER (regexp_matches(html, '<\|[a-z_]+\|>|\[/?INST\]|</?s>')) FROM pages UNION ALL SELECT 'conversations', count(*), count(*) FILTER (regexp_matches(text, '<\|[a-z_]+\|>|\[/?INST\]|</?s>')) FROM conversations""",
)
def special_token_leak(spark, sf):
    pattern = r"<\|[a-z_]+\|>|\[/?INST\]|</?s>"
    one = lambda name, c: table(spark, sf, name).agg(F.lit(name).alias("origin"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).rlike(pattern)).alias("leaks"))
    return one("documents", "text").unionByName(one("pages", "html")).unionByName(one("conversations", "text"))


@query(
    "length_quantiles",
    "WITH o AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, max(n) AS n, max(n_chars) FILTER (i = n // 2) AS p50, max(n_chars) FILTER (i = CAST(floor(n * 0.9) AS BIGINT)) AS p90, max(n_chars) FILTER (i = CAST(floor(n * 0.99) AS BIGINT)) AS p99, count(*) FILTER (n_chars > 16384) AS oversize FROM o GROUP BY lang",
)
def length_quantiles(spark, sf):
    """Quantiles by index rule, from counts of distinct lengths: no group is sorted whole."""
    n = table(spark, sf, "documents").groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("lang").orderBy("n_chars")
    c = n.withColumn("upto", F.sum("m").over(w)).withColumn("n", F.sum("m").over(Window.partitionBy("lang")))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("n_chars")))
    return c.groupBy("lang").agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.sum(F.when(F.col("n_chars") > 16384, F.col("m")).otherwise(0)).alias("oversize"))


@query(
    "episode_ledger",
    "SELECT conv_id, string_agg(turn || ' ' || role || ' ' || length(text), '; ' ORDER BY turn) AS ledger, CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT) AS supervised_chars FROM conversations GROUP BY conv_id",
)
def episode_ledger(spark, sf):
    """One line for each turn of an episode."""
    line = F.concat_ws(" ", F.col("turn").cast("string"), "role", F.length("text").cast("string"))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("a"), F.sum(F.when(F.col("role") == "assistant", F.length("text"))).alias("supervised_chars"))
    return g.select("conv_id", F.array_join(F.transform("a", lambda x: x["line"]), "; ").alias("ledger"), "supervised_chars")


@query(
    "message_spans",
    "SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_start, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS span_end FROM conversations",
)
def message_spans(spark, sf):
    """Spans of messages from growing prefixes."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    end = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(end - F.length("text"), F.lit(0)).alias("span_start"), end.alias("span_end"))
