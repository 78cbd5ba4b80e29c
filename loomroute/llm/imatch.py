"""I-Match fingerprints with randomised lexicons.

Terms are lower-cased words. A term is kept if the share of distinct texts that hold it lies within the band
[``low``, ``high``], that is, if its inverse document frequency lies within [-ln high, -ln low]. Several random
subsets of this lexicon are drawn by hashing, of geometrically falling density, so that some subset leaves few
terms of a long document and some leaves many of a short one. For each subset a document's distinct kept terms
are sorted and hashed. The fingerprint lists the hashes, 16 hex digits each, subsets without a term as zeros.

The likeness of two fingerprints is the share of agreeing subsets among those in which either has a term, each
weighted alike; two fingerprints without any term are alike if equal.

The lexicon is bounded: the terms held by a share of ``low`` or more of the documents number at most the mean
count of distinct terms over ``low``, whatever the number of documents. It is counted before it is broadcast;
beyond the limit the planner's shuffle join takes over.

Neighbours: documents are cut into ranges of descending doc_id. Each range gets a copy of the first document of
the next one, so a document and its next meet in one task, and after the texts have been dealt out once no
further shuffle is needed: window, tokens, lexicon join and grouping all keep that partitioning.

Defined cases: null text counts as empty, and empty text has no terms; equal texts have equal fingerprints;
rows that repeat a doc_id are separate documents, in order of their text; a null doc_id comes last; the only
document is its own next one; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomroute.plans.workspace import checked_broadcast, save, shuffle_width

from .text import padded_words

LOW = 0.0005
HIGH = 0.2
#: Density of each subset as a power of two: four with a quarter of the lexicon, four with an eighth, and so on.
DENSITIES = tuple(bits for bits in range(2, 10) for _ in range(4))


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): documents that hold each term. Terms are 64-bit hashes of words."""
    word = F.explode(F.array_distinct(padded_words(F.col("text"))))
    words = docs.select(word.alias("w")).where(F.col("w") != "")
    return words.groupBy(F.xxhash64("w").alias("term")).agg(F.count(F.lit(1)).alias("n"))


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(text) once for each distinct text, and their number; only hashes are shuffled. Null counts as empty."""
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    keyed = keyed.withColumn("a", F.xxhash64("text")).withColumn("b", F.xxhash64(F.lit("text"), "text"))
    counts = keyed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    repeated = save(counts.where("n > 1"), "repeated")
    copies, n_repeated = repeated.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), F.count(F.lit(1))).first()
    firsts = checked_broadcast(repeated.select("a", "b", "first"), n_repeated)
    return keyed.join(firsts, ["a", "b"], "left").where("first is null or first = row").select("text"), docs.count() - copies


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, subsets): terms within the band, and the subsets they are in as bits. Copies of a text count once."""
    docs, total = distinct_texts(docs)
    band = term_counts(docs).where((F.col("n") >= low * total) & (F.col("n") <= max(high * total, 1)))
    bits = F.lit(0).cast("long")
    for i, density in enumerate(DENSITIES):
        inside = F.xxhash64(F.lit(i), "term").bitwiseAND(F.lit((1 << density) - 1)) == 0
        bits = bits + F.when(inside, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return band.select("term", bits.alias("subsets")).where("subsets <> 0")


def _with_hashes(df: DataFrame, sides: list[str]) -> DataFrame:
    """Each side's sorted (term, subsets) entries replaced by one hash per subset; zero where none of them is in it.

    Sparser subsets look at fewer terms: from each density on, only the entries of some sparser subset go on, in
    a projection of its own, so that no filter is evaluated twice.
    """
    keep = [c for c in df.columns if c not in sides]
    hashes: dict[str, list[str]] = {side: [] for side in sides}
    for density in sorted(set(DENSITIES)):
        own = [i for i, d in enumerate(DENSITIES) if d == density]
        rest = sum(1 << i for i, d in enumerate(DENSITIES) if d > density)
        columns = []
        for side in sides:
            for i in own:
                bit = F.lit(1 << i).cast("long")
                chosen = F.filter(side, lambda t: t["subsets"].bitwiseAND(bit) != 0)
                columns.append(F.xxhash64(F.transform(chosen, lambda t: t["term"])).alias(f"_{side}{i}"))
            bits = F.lit(rest).cast("long")
            columns.append(F.filter(side, lambda t: t["subsets"].bitwiseAND(bits) != 0).alias(side))
        df = df.select(*keep, *[h for side in sides for h in hashes[side]], *columns)
        for side in sides:
            hashes[side] += [f"_{side}{i}" for i in own]
    # The hash of no term at all is the seed.
    arrays = [F.transform(F.array(*hashes[side]), lambda h: F.when(h == F.xxhash64(F.array().cast("array<long>")), F.lit(0).cast("long")).otherwise(h)).alias(side) for side in sides]
    return df.select(*keep, *arrays)


def written(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(pairs, lambda p: (p["a"] != 0) | (p["b"] != 0)))
    same = F.size(F.filter(pairs, lambda p: (p["a"] != 0) & (p["a"] == p["b"])))
    return F.when(used > 0, same / used).when(a.isNotNull() & b.isNotNull(), F.lit(1.0))


def _part(doc_id: Column, cuts: list[int]) -> Column:
    """Number of cuts (descending) above doc_id, in two steps of about sqrt(n); null comes after all."""
    if not cuts:
        return F.lit(0)
    step = int(len(cuts) ** 0.5) + 1
    coarse = F.size(F.filter(F.lit(cuts[step - 1 :: step]), lambda c: c > doc_id)) * step
    fine = F.size(F.filter(F.slice(F.lit(cuts), coarse + 1, F.lit(step)), lambda c: c > doc_id))
    return F.when(doc_id.isNull(), F.lit(len(cuts))).otherwise(coarse + fine).cast("int")


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(part, place, is_copy, doc_id, text, next_text), dealt out by part; places follow descending doc_id.

    Only ``doc_id`` is read to find the ranges and their first documents, one row each.
    """
    spark = docs.sparkSession
    width = ranges or shuffle_width(spark)
    n = 4 * width  # several parts a task even out the hash
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", [i / n for i in range(1, n)], max(0.2 / n, 5e-6))}, reverse=True)
    placed = docs.withColumn("part", _part(F.col("doc_id"), cuts))
    heads = [tuple(r) for r in placed.groupBy("part").agg(F.max("doc_id")).orderBy("part").collect()]
    # A part's first document follows the part before it, and the first of all follows the last part.
    copies = [(doc_id, heads[i - 1][0]) for i, (_, doc_id) in enumerate(heads)]
    copied = spark.createDataFrame(copies, "head long, to int").groupBy("head").agg(F.collect_set("to").alias("to"))
    placed = placed.join(F.broadcast(copied), placed["doc_id"].eqNullSafe(copied["head"]), "left")  # one row a part
    at = F.concat(F.array(F.struct("part", F.lit(False).alias("is_copy"))), F.transform(F.coalesce("to", F.array().cast("array<int>")), lambda p: F.struct(p.alias("part"), F.lit(True).alias("is_copy"))))
    dealt = placed.select("doc_id", "text", F.explode(at).alias("at")).select("at.part", "at.is_copy", "doc_id", "text").repartition(width, "part")
    order = Window.partitionBy("part").orderBy("is_copy", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    return dealt.select("part", F.row_number().over(order).alias("place"), "is_copy", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, own, edited, next): hashes per subset of each text, its edited text and the next text."""
    words = lexicon(docs, low, high).unionByName(docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("term"), F.lit(0).cast("long").alias("subsets")))
    words = save(words, "lexicon")  # the empty word, in no subset, stands for every document
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs, ranges).withColumn("edited", F.when(~F.col("is_copy"), edited))
    rows = rows.withColumn("info", F.struct("is_copy", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))
    sides = rows.select("part", "place", "info", F.explode(sides).alias("s"))
    tokens = sides.select("part", "place", "info", "s.side", F.explode(padded_words(F.col("s.text"))).alias("w"))
    tokens = tokens.select("part", "place", "side", F.when((F.col("w") == "") & (F.col("side") == 0), F.col("info")).alias("info"), F.xxhash64("w").alias("term"))
    kept = tokens.join(checked_broadcast(words, words.count(), 1_000_000), "term")
    entry = F.struct("term", "subsets")
    gathered = kept.groupBy("part", "place").agg(
        F.max("info").alias("info"), F.array_sort(F.collect_set(F.when(F.col("side") == 0, entry))).alias("own"), F.array_sort(F.collect_set(F.when(F.col("side") == 1, entry))).alias("edited")
    )
    hashed = _with_hashes(gathered, ["own", "edited"])
    hashed = hashed.withColumn("next", F.lead("own").over(Window.partitionBy("part").orderBy("place")))
    return hashed.where(~F.col("info.is_copy")).select("info.doc_id", "info.n_chars", "info.edited_sha256", "own", "edited", "next")


def query(spark, sf_dir: str) -> DataFrame:
    found = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    own, edited, following = (F.col(c) for c in ("own", "edited", "next"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(own).alias("fingerprint"),
        written(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"),
        likeness(own, following).alias("near_next"),
    )
