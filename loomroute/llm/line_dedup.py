"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

A line's key is the line stripped of ASCII white space at both ends with A-Z lowered. Keys of at least
``min_chars`` code points in at least ``min_docs`` different documents lose every line except those of the
largest doc_id that holds the key. Other lines stay, joined by ``\\n``.

Defined cases: null or empty text is one empty line and stays null or empty text; a document is a row, and
rows that repeat a doc_id count as one document for the threshold; a null doc_id counts as one document that
sorts before all others; empty tables give empty results; columns beside doc_id and text pass through
unchanged whatever their names.

Plan: one scan explodes the lines with their positions and writes (document, position, key hash) of those that
are long enough. Documents per hash are counted in two steps, first per (hash, document), so a line found
everywhere is spread over all tasks and costs one partial sum per task. Lines of dropped keys give each document
the positions that it loses; the text is reassembled from the positions left, in time linear in its lines.
Texts stay where they are read while the documents that lose a line are few enough to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomroute.plans.workspace import checked_broadcast, free_name, save

from .text import ascii_lower

BLANK = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _document(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What a document is known by: its id and two hashes of its text. Rows equal in both have the same lines."""
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("ta"), F.xxhash64(F.lit("text"), text).alias("tb")]


def exploded_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, ta, tb, pos, a, b): each line of at least ``min_chars``, with two hashes of its key."""
    lines = docs.select(*_document(), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.withColumn("key", F.btrim("line", F.lit(BLANK))).where(F.char_length("key") >= min_chars).withColumn("key", ascii_lower(F.col("key")))
    return lines.select("doc_id", "ta", "tb", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("line"), "key").alias("b"))


def lost_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, ta, tb, lost): the positions of the lines that a document loses. Documents that lose nothing have no row."""
    lines = save(exploded_lines(docs, min_chars), "lines")
    holders = lines.groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one"))
    keys = holders.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    keys = save(keys.select("a", "b", "keeper"), "keys")
    lost = lines.join(checked_broadcast(keys, keys.count()), ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "ta", "tb").agg(F.collect_set("pos").alias("lost"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with ``text`` reassembled, plus ``_n_lines`` and ``_n_dropped`` (replaced if present)."""
    at, ta, tb, lost, kept = (free_name(docs, x) for x in ("_lost_id", "_lost_a", "_lost_b", "_lost", "_places"))
    found = save(lost_positions(docs, min_chars, min_docs), "lost").toDF(at, ta, tb, lost)
    entries = found.agg(F.coalesce(F.sum(F.size(lost) + 1), F.lit(0))).first()[0]
    found = checked_broadcast(found, entries)  # beyond the limit texts are shuffled by document
    same = [a.eqNullSafe(F.col(b)) for a, b in zip((docs["doc_id"], F.xxhash64(docs["text"]), F.xxhash64(F.lit("text"), docs["text"])), (at, ta, tb))]
    joined = docs.join(found, same, "left")
    lines = _lines(F.col("text"))
    joined = joined.withColumn("_n_lines", F.size(lines).cast("long"))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    joined = joined.withColumn(kept, F.when(F.col(lost).isNotNull(), places))
    joined = joined.withColumn("_n_dropped", F.when(F.col(kept).isNull(), F.lit(0).cast("long")).otherwise(F.col("_n_lines") - F.size(kept)))
    left = F.array_join(_at_places(lines, F.col(kept)), "\n")
    return joined.withColumn("text", F.when(F.col(kept).isNull(), F.col("text")).otherwise(left)).drop(at, ta, tb, lost, kept)


def _at_places(lines: Column, places: Column) -> Column:
    """The lines at the given places (from 0), in order; the array of lines is an argument, so it is made once a row."""
    both = F.array(F.struct(lines.alias("all"), places.alias("at")))
    return F.transform(both, lambda x: F.transform(x["at"], lambda i: F.get(x["all"], i)))[0]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
keys AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT d.doc_id, d.pos, d.line, (keys.k IS NOT NULL AND d.doc_id <> keys.keeper) AS lost
  FROM keyed d LEFT JOIN keys ON d.k = keys.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
