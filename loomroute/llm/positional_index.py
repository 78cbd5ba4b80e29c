"""Benchmark decontamination with a distributed positional inverted index.

The index holds one posting (term, document, position) for every training token that some test item uses.
It is sharded by document: the task that reads a document writes all of its postings to one file, sorted by term,
so texts are never moved, a document's lists lie in one shard and a term's list in a shard is one run. Queries
are phrases: offset-adjusted lists (position minus the term's offset in the
phrase) are intersected from the rarest terms of the phrase; what is left is intersected with the lists of
the remaining terms, so a match is exact. ``proximity`` finds all terms of a query within a span.

Terms are identified by the 64-bit XXH64 of the word. No cap holds anywhere: every window, document and
occurrence counts. What is broadcast comes from the test items alone and is counted first; beyond the limit
the planner's shuffle join takes over.

Defined cases: null text has no words; items without words have no window and match nothing; an item of
fewer than ``width`` words is one window; rows that repeat a doc_id or item_id are separate documents, or
one item; an item with a null item_id counts for hits and is left out of item lists; empty tables give no
match; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomroute.plans.workspace import checked_broadcast, new_folder, save, scratch

from .text import padded_words

WIDTH = 10
#: Lists intersected in the shards before the exact step; a further list takes part only while it is short.
SEEDS = 4
#: A list is short if it has at most this many times the postings of the phrase's rarest list.
SEED_GROWTH = 30


@dataclass
class PositionalIndex:
    """postings: (row, term, pos), a row number's postings in one file. documents: (row, doc_id, n_words), one per document row."""

    postings: DataFrame
    documents: DataFrame


def query_terms(items: DataFrame) -> DataFrame:
    """Distinct term ids of the items."""
    word = F.explode(padded_words(F.col("text")))
    return items.select(word.alias("w")).where(F.col("w") != "").select(F.xxhash64("w").alias("term")).distinct()


def build(docs: DataFrame, terms: DataFrame) -> PositionalIndex:
    """Index ``docs`` (doc_id, text) for the words whose ids are in ``terms`` (column term).

    The empty word that ends each padded text is the end posting; its position gives the document's length. Rows are
    numbered in the job that writes the postings, so the numbers are the same at every read.
    """
    spark = docs.sparkSession
    ends = F.xxhash64(F.lit(""))
    wanted = save(terms.unionByName(spark.range(1).select(ends.alias("term"))), "terms")
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    words = rows.select("row", "doc_id", F.posexplode(padded_words(F.col("text"))).alias("pos", "w")).where((F.col("w") != "") | (F.col("pos") > 0))
    words = words.select("row", F.when(F.col("w") == "", F.col("doc_id")).alias("doc_id"), F.xxhash64("w").alias("term"), "pos")
    postings = words.join(checked_broadcast(wanted, wanted.count()), "term").withColumn("is_end", F.col("term") == ends)
    path = new_folder(spark, "postings")
    postings.select("row", "doc_id", "term", "pos", "is_end").sortWithinPartitions("is_end", "term").write.partitionBy("is_end").parquet(path)
    table = spark.read.schema(postings.select("row", "doc_id", "term", "pos", "is_end").schema).parquet(path)
    return PositionalIndex(
        postings=table.where(~F.col("is_end")).select("row", "term", "pos"),
        documents=save(table.where("is_end").select("row", "doc_id", (F.col("pos") - 1).cast("long").alias("n_words")), "documents"),
    )


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, wid, terms): each item's windows; equal windows share a wid."""
    padded = padded_words(F.col("text"))
    own = items.select("item_id", F.slice(padded, F.lit(2), F.size(padded) - 2).alias("words")).where(F.size("words") > 0)
    own = own.select("item_id", F.transform("words", lambda w: F.xxhash64(w)).alias("terms"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("terms") - width + 1, F.lit(1)))
    each = own.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("terms", i, width))).alias("terms"))
    return each.select("item_id", F.xxhash64("terms").alias("wid"), "terms").distinct()


def match_phrases(index: PositionalIndex, phrases: DataFrame) -> DataFrame:
    """(wid, row, start, length) of every occurrence of the distinct phrases (wid, terms)."""
    slots = save(phrases.select("wid", F.size("terms").alias("length"), F.posexplode("terms").alias("at", "term")), "slots")
    lists = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("postings"))
    by_rarity = Window.partitionBy("wid").orderBy("postings", "at")
    ranked = slots.join(lists, "term", "left").withColumn("k", F.row_number().over(by_rarity)).withColumn("least", F.min("postings").over(Window.partitionBy("wid")))
    whole = F.count("postings").over(Window.partitionBy("wid")) == F.col("length")  # a word that no document has ends the phrase
    ranked = ranked.withColumn("whole", whole).where("whole")
    seed = (F.col("k") == 1) | ((F.col("k") <= SEEDS) & (F.col("postings") <= SEED_GROWTH * F.col("least")))
    ranked = save(ranked.select("wid", "length", "at", "term", seed.alias("seed")), "ranked")
    seeds = ranked.where("seed").withColumn("seeds", F.count(F.lit(1)).over(Window.partitionBy("wid"))).select("wid", "length", "at", "term", "seeds")
    n_slots = ranked.count()
    # Lists of the rarest terms, shifted by their offsets, meet inside the shard; what is dealt out is counted there first.
    meet = index.postings.join(checked_broadcast(seeds, n_slots), "term").select("row", "wid", (F.col("pos") - F.col("at")).alias("start"), "length", "seeds")
    found = meet.groupBy("row", "wid", "start", "length", "seeds").agg(F.count(F.lit(1)).alias("n")).where("n = seeds")
    found = save(found.select("row", "wid", "start", "length", "seeds"), "candidates")
    # The remaining lists, of documents with a candidate only.
    rest = ranked.where("not seed").select("wid", "at", "term")
    needed = found.join(checked_broadcast(rest, n_slots), "wid").select("row", "wid", "start", "term", (F.col("start") + F.col("at")).alias("pos"))
    in_rows = found.select("row").distinct()
    held = index.postings.join(checked_broadcast(in_rows, found.count()), "row", "left_semi")
    also = needed.join(held, ["row", "term", "pos"]).groupBy("row", "wid", "start").agg(F.count(F.lit(1)).alias("also"))
    checked = found.where("seeds < length").join(also, ["row", "wid", "start"]).where("seeds + also = length")
    return found.where("seeds = length").select("wid", "row", "start", "length").unionByName(checked.select("wid", "row", "start", "length"))


def match_proximity(index: PositionalIndex, queries: DataFrame, span: int) -> DataFrame:
    """(qid, row, anchor): occurrences of a query's rarest term with every other term of it less than ``span`` words away.

    ``queries`` has (qid, terms); repeated terms of a query count once.
    """
    terms = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    lists = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("postings"))
    own = Window.partitionBy("qid")
    ranked = terms.join(lists, "term", "left").withColumn("k", F.row_number().over(own.orderBy(F.col("postings").asc_nulls_first(), "term"))).withColumn("n", F.count(F.lit(1)).over(own))
    ranked = save(ranked, "near_terms")
    n = ranked.count()
    anchors = index.postings.join(checked_broadcast(ranked.where("k = 1").select("qid", "term", "n"), n), "term").select("qid", "row", F.col("pos").alias("anchor"), "n")
    cell = F.floor(F.col("anchor") / span)
    asked = anchors.join(checked_broadcast(ranked.where("k > 1").select("qid", "term"), n), "qid").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    held = index.postings.withColumn("cell", F.floor(F.col("pos") / span))
    close = asked.join(held, ["row", "term", "cell"]).where(F.abs(F.col("pos") - F.col("anchor")) < span)
    full = close.groupBy("qid", "row", "anchor", "n").agg(F.count_distinct("term").alias("others")).where("others = n - 1").select("qid", "row", "anchor")
    return anchors.where("n = 1").select("qid", "row", "anchor").unionByName(full)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document row: doc_id, row, n_words, n_hit (words inside an occurrence), items (sorted as strings)."""
    with scratch(docs.sparkSession, keep=("windows", "hits", "documents")):
        found_windows = save(windows(items, width), "windows")
        index = build(docs, query_terms(items))
        hits = save(match_phrases(index, found_windows.select("wid", "terms").distinct()), "hits")
        n_windows = found_windows.count()
    # Union of the hit intervals: each start adds what lies beyond the furthest end so far.
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("row", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    spans = spans.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(before), F.col("start"))))
    covered = spans.groupBy("row").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).cast("long").alias("n_hit"))
    pairs = hits.select("row", "wid").distinct().join(checked_broadcast(found_windows.select("wid", "item_id"), n_windows), "wid")
    listed = pairs.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = index.documents.join(covered, "row", "left").join(listed, "row", "left")
    return out.select("doc_id", "row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
