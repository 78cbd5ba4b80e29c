"""Near-duplicate groups at a Jaccard similarity, found with BK-trees over SimHash fingerprints.

Two texts are alike if the sets of their ``words``-word shingles have a Jaccard similarity of ``similarity`` or
more; groups are what such links connect. Words and shingles are read as in ``simhash_bktree``; a shingle counts
once however often it repeats. A node is a distinct set; its fingerprint is a SimHash of the set, of 128 bits.

Shards: two sets that are alike share one of the first ``n - ceil(similarity n) + 1`` shingles of each, in any
order that holds for all sets (prefix filter). So every shingle of these prefixes is a shard, and sharding loses no
pair. Shingles that many documents of a bounded sample hold come last in the order: the sample decides how large
shards get, never the result. Shards of one node are left out before anything else is attached to a posting.

Trees: each shard has a BK-tree for each class of set sizes (ratio ``similarity`` between neighbouring classes,
since sizes further apart cannot be alike). Edges of the trees within the radius join first; members outside a
shard's largest part then query the trees of their own class and its neighbours and follow only the edges within
``radius``. A shard gives a spanning star for each part, a row a member at most, never its pairs. A shard above
``block`` members is cut into blocks as in ``simhash_bktree``.

Check: what these stars connect is a cluster. A cluster's whole sets meet in one task, or block by block if they are
many or long, and links are the pairs whose exact overlap gives the similarity. Again only spanning stars come out.

What can be missed: a pair whose fingerprints differ in more than ``radius`` bits. At a similarity of exactly
0.8 the differing bits have mean 19.4 and deviation 4.1 (angle of two sets, 128 bits), so 40 bits lie five
deviations away: less than one such pair in 100,000, by simulation over set sizes, but 2.5 in 10,000 for sets of four
and five shingles. Unrelated sets differ in 64 bits, with a deviation of 5.7. ``tests/llm`` compares the groups with
brute force.

Shingles and sets are identified by 64-bit hashes. Defined cases: null text has no words; texts without words
are alike; repeated rows stay rows of one node; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomroute.plans.workspace import checked_broadcast, free_name, save, scratch, shuffle_width

from .simhash_bktree import bk_forest, bk_query, components, join_labels, with_blocks
from .slices import release, sliced

WORDS = 5
SIMILARITY = Fraction(4, 5)
RADIUS = 40
#: Members of a shard that one task takes as tree or as queries.
BLOCK = 20_000
#: Documents of the sample that finds the frequent shingles, how many of them hold one, and the most that are kept.
SAMPLE, OFTEN, MOST = 20_000, 5, 100_000
#: Members a task.
TASK_MEMBERS = 300_000
#: Sets, and shingles of all sets, that a block of a cluster has at most; shingles that a task has.
CLUSTER_SETS, CLUSTER_TERMS, TASK_TERMS = 2_000, 2_000_000, 2_000_000
#: A shingle held by more sets than this is counted by a matrix product, others by their pairs.
DENSE_DF = 64


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(parts)
    n = max(len(parts) - words + 1, 1)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[len(parts) - n :] - 1).tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[s:e], 42) for s, e in zip(starts, stops)])
    return np.unique(np.frombuffer(raw, dtype=">u8").astype(np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A second hash made from the first (the finaliser of SplitMix64)."""
    z = h + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def set_fingerprint(own: np.ndarray) -> tuple[int, int]:
    """SimHash of a set in two words: a bit is set if it is set in more than half of the hashes."""
    if not len(own):
        return 0, 0
    counts = np.zeros(128, dtype=np.int64)
    for at in range(0, len(own), 1 << 14):
        part = own[at : at + (1 << 14)]
        raw = np.stack([part, _mixed(part)], axis=1).astype(">u8").view(np.uint8).reshape(len(part), 16)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int32)
    packed = np.packbits(counts * 2 > len(own)).tobytes()
    return int.from_bytes(packed[:8], "big"), int.from_bytes(packed[8:], "big")


def prefix(own: np.ndarray, frequent: np.ndarray, similarity: Fraction = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of which two sets that are alike share at least one: the rare ones, then the frequent ones."""
    n = len(own)
    size = n - -(-n * similarity.numerator // similarity.denominator) + 1
    if not len(frequent) or not n:
        return own[:size], own[:0]
    late = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
    rare = own[~late][:size]
    return rare, own[late][: size - len(rare)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def annotate(docs: DataFrame, names: dict[str, str], frequent: np.ndarray, words: int, similarity: Fraction) -> DataFrame:
    """The rows with their node, its size and fingerprint, and the two parts of its prefix (null if the task had the node before)."""
    columns = docs.columns
    added = [T.StructField(names["node"], T.LongType()), T.StructField(names["n"], T.IntegerType()), *(T.StructField(names[k], T.LongType()) for k in ("fp", "fq")), *(T.StructField(names[k], T.ArrayType(T.LongType())) for k in ("rare", "often"))]

    def run(batches):
        seen: set[int] = set()
        for part in sliced(batches):
            rows = []
            for text in part.column("text").to_pylist():
                own = shingles(text, words)
                node = xxhash.xxh64_intdigest(own.tobytes(), 42)
                rare, often = (None, None) if node in seen else (t.view(np.int64) for t in prefix(own, frequent, similarity))
                seen.add(node)
                rows.append((_signed(node), len(own), *map(_signed, set_fingerprint(own)), rare, often))
            node, n, fp, fq, rare, often = zip(*rows)
            found = [pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(fq, pa.int64()), pa.array(rare, pa.list_(pa.int64())), pa.array(often, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *found], names=[*columns, *(f.name for f in added)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def _whole_sets(texts: DataFrame, words: int) -> DataFrame:
    """The rows of (node, cluster, text) with the sorted shingles in place of the text."""

    def run(batches):
        for part in sliced(batches):
            whole = [shingles(t, words).view(np.int64) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("cluster"), pa.array(whole, pa.list_(pa.int64()))], names=["node", "cluster", "whole"])

    return texts.mapInArrow(run, "node long, cluster long, whole array<long>")


def frequent_shingles(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Sorted shingles that at least ``OFTEN`` documents of the sample hold, the most frequent ``MOST`` of them."""
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    sample = docs.select(F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("cluster"), "text").sample(share, seed=1)
    counts = _whole_sets(sample, words).select(F.explode("whole").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    held = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "term").limit(MOST).select("term").collect()
    return np.sort(np.array([r["term"] for r in held], dtype=np.int64).view(np.uint64))


def _live(batches):
    """(term, node) once, of terms that at least two nodes hold, from postings sorted by both."""
    waits, shared = np.empty((0, 2), dtype=np.int64), False  # the last pair, and whether its term is known to have two nodes
    for batch in batches:
        pairs = np.concatenate([waits, np.stack([batch.column(c).to_numpy() for c in ("term", "node")], axis=1)])
        if not len(pairs):
            continue
        pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])]
        same = pairs[1:, 0] == pairs[:-1, 0]
        many = np.concatenate([same, [False]]) | np.concatenate([[shared], same])
        waits, shared = pairs[-1:], bool(many[-1])
        out = pairs[:-1][many[:-1]]
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["term", "node"])
    if shared:
        yield pa.RecordBatch.from_arrays([pa.array(waits[:, 0]), pa.array(waits[:, 1])], names=["term", "node"])


def _size_class(n: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Sizes of two alike sets lie in the same class or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / -log(similarity) + 1e-9).astype(np.int64)


def _grouped(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """A number for each different row of the named columns."""
    return np.unique(np.stack([table.column(c).to_numpy().astype(np.int64) for c in names], axis=1), axis=0, return_inverse=True)[1].ravel()


def _star_rows(node: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(u, v) for each node that is not its part's center."""
    below = np.flatnonzero(node != node[label])
    if len(below):
        found = np.unique(np.stack([node[below], node[label[below]]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])


def _shard_stars(batches, radius: int, similarity: Fraction) -> Iterator[pa.RecordBatch]:
    """Stars of one task's shards: members within the radius and of like sizes are connected."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    shard = _grouped(table, ("term", "lo", "hi"))
    node, n, own, lo, hi = (table.column(c).to_numpy() for c in ("node", "n", "own", "lo", "hi"))
    fp = np.stack([table.column(c).to_numpy() for c in ("fp", "fq")], axis=1).view(np.uint64)
    n = n.astype(np.int64)
    size = _size_class(n, similarity) + 1
    place = shard * (int(size.max()) + 2) + size
    label = np.arange(len(node))

    def joined(a: np.ndarray, b: np.ndarray) -> None:
        like = (a != b) & (np.minimum(n[a], n[b]) * similarity.denominator >= np.maximum(n[a], n[b]) * similarity.numerator)
        join_labels(label, a[like], b[like])

    tree = np.flatnonzero(own == lo)
    if not len(tree):
        return
    root, key, inner = bk_forest(place[tree], fp[tree])
    near = key % 129 <= radius
    joined(tree[key[near] // 129], tree[inner[near]])
    # Equal fingerprints stand in one chain of the tree, at distance 0; the largest part of a shard need not ask.
    order = np.lexsort((label, shard))
    first = np.concatenate([[True], (np.diff(shard[order]) != 0) | (np.diff(label[order]) != 0)])
    part = np.cumsum(first) - 1
    count = np.bincount(part)
    of_part = shard[order][first]
    largest = np.zeros(len(count), dtype=bool)
    by_size = np.lexsort((-count, of_part))
    largest[by_size[np.concatenate([[True], np.diff(of_part[by_size]) != 0])]] = True
    settled = np.zeros(len(node), dtype=bool)
    settled[order] = largest[part]
    asking = np.flatnonzero((own == hi) & ~(settled & (lo == hi)))
    classes, at = np.unique(place[tree], return_index=True)
    for step in (0, 1, -1):
        where = place[asking] + step
        slot = np.minimum(np.searchsorted(classes, where), len(classes) - 1)
        ok = classes[slot] == where
        for q, hit in bk_query(fp[tree], root[at[slot[ok]]], key, inner, asking[ok], fp, radius):
            joined(q, tree[hit])
    yield from _star_rows(node, label)
    del table, held
    release()


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of every left set with every right set, counted without comparing the sets pair by pair."""
    sizes = [len(x) for x in (*left, *right)]
    _, term, df = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    heavy = np.flatnonzero(df > DENSE_DF)
    column = np.full(len(df), -1)
    column[heavy] = np.arange(len(heavy))
    for at in range(0, len(heavy), 1024):
        mine = (column[term] >= at) & (column[term] < at + 1024)
        x = np.zeros((len(sizes), min(1024, len(heavy) - at)), dtype=np.float32)
        x[owner[mine], column[term[mine]] - at] = 1.0
        out += x[: len(left)] @ x[len(left) :].T
    light = (df[term] <= DENSE_DF) & (df[term] > 1)
    order = np.argsort(term[light], kind="stable")
    t, o = term[light][order], owner[light][order]
    # Every posting with each posting of the same shingle: positions of the runs, in pieces of bounded size.
    start = np.searchsorted(t, t)
    many = np.searchsorted(t, t, side="right") - start
    many[o >= len(left)] = 0
    ends = np.cumsum(many)
    flat, at = out.ravel(), 0
    while at < len(t):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000)))
        m = many[at:upto]
        if m.sum():
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            a, b = np.repeat(o[at:upto], m), o[np.repeat(start[at:upto], m) + step] - len(left)
            np.add.at(flat, a[b >= 0] * len(right) + b[b >= 0], 1.0)
        at = upto
    return out


def _exact_stars(batches, similarity: Fraction) -> Iterator[pa.RecordBatch]:
    """Stars of one task's clusters: sets whose exact overlap gives the similarity are connected."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    group = _grouped(table, ("cluster", "lo", "hi"))
    node, own, lo, hi = (table.column(c).to_numpy() for c in ("node", "own", "lo", "hi"))
    column = table.column("whole").combine_chunks()
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0, [True]]))
    label = np.arange(len(node))
    p, q = similarity.numerator, similarity.denominator
    for a, b in zip(edges[:-1], edges[1:]):
        rows = order[a:b]
        left, right = rows[own[rows] == lo[rows]], rows[own[rows] == hi[rows]]
        if not len(left) or not len(right):
            continue
        sets = lambda rows: [flat[offsets[r] : offsets[r + 1]] for r in rows]
        n = np.diff(offsets)
        for at in range(0, len(left), 500):
            own_rows = left[at : at + 500]
            shared = _overlaps(sets(own_rows), sets(right))
            i, j = np.nonzero((p + q) * shared >= p * (n[own_rows][:, None] + n[right][None, :]))
            apart = own_rows[i] != right[j]
            join_labels(label, own_rows[i][apart], right[j][apart])
    yield from _star_rows(node, label)
    del table, held
    release()


def _exact_links(marked: DataFrame, nodes: DataFrame, clusters: DataFrame, names: dict[str, str], words: int, similarity: Fraction) -> DataFrame:
    """(u, v): links that connect the same nodes as all pairs of the similarity do; clusters: (node, cluster)."""
    own = save(nodes.join(clusters, "node").select("row", "node", "n", "cluster"), "clustered")
    n_own = own.count()
    sizes = own.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CLUSTER_SETS), F.ceil(F.sum("n") / CLUSTER_TERMS)).cast("int").alias("blocks"), F.sum("n").alias("terms"))
    large = save(sizes.where("blocks > 1").select("cluster", "blocks"), "large_clusters")
    n_terms = own.agg(F.sum("n")).first()[0] or 0
    texts = marked.select(F.col(names["row"]).alias("row"), "text").join(checked_broadcast(own, n_own), "row")
    whole = _whole_sets(texts.select("node", "cluster", "text"), words)
    whole = whole.join(checked_broadcast(large, large.count()), "cluster", "left").fillna(1, "blocks")
    whole = whole.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = whole.select("cluster", "node", "whole", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    width = max(shuffle_width(marked.sparkSession), n_terms // TASK_TERMS + 1)
    return dealt.repartition(width, "cluster", "lo", "hi").mapInArrow(lambda b: _exact_stars(b, similarity), "u long, v long")


def groups(docs: DataFrame, words: int = WORDS, similarity: Fraction = SIMILARITY, radius: int = RADIUS, block: int = BLOCK) -> tuple[DataFrame, str, str]:
    """The rows of ``docs`` (saved) with a row number and a group, and the names of these two columns.

    Rows of one group are alike, directly or through others. Numbers are written with the rows, so they stay the
    same whatever is read again later.
    """
    spark = docs.sparkSession
    names = {k: free_name(docs, f"_{k}") for k in ("row", "node", "n", "fp", "fq", "rare", "often", "group")}
    with scratch(spark, keep=("marked", "final_labels")):
        frequent = frequent_shingles(docs.select("text"), words)
        marked = annotate(docs.withColumn(names["row"], F.monotonically_increasing_id()), names, frequent, words, similarity)
        marked = save(marked, "marked")
        facts = marked.select(*(F.col(names[k]).alias(k) for k in ("row", "node", "n", "fp", "fq", "rare", "often"))).where("rare is not null")
        n_rare = facts.agg(F.sum(F.size("rare"))).first()[0] or 0
        rare = facts.select(F.explode("rare").alias("term"), "node").repartition(max(shuffle_width(spark), n_rare // TASK_MEMBERS + 1), "term")
        live = rare.sortWithinPartitions("term", "node").mapInArrow(_live, "term long, node long")
        live = save(live.unionByName(facts.select(F.explode("often").alias("term"), "node").distinct()), "live")
        used = live.select("node").distinct()
        used = save(facts.join(used, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("n", "fp", "fq"))), "nodes")
        members = with_blocks(live.join(used.drop("row"), "node"), ["term"], "node", block)
        width = max(shuffle_width(spark), live.count() // TASK_MEMBERS + 1)
        stars = members.select("term", "node", "n", "fp", "fq", "own", "lo", "hi").repartition(width, "term", "lo", "hi").mapInArrow(lambda b: _shard_stars(b, radius, similarity), "u long, v long")
        clusters = save(components(stars.distinct()), "clusters").toDF("node", "cluster")
        links = _exact_links(marked, used, clusters, names, words, similarity)
        labels = save(components(links), "final_labels").toDF("node", "label")
        labels = checked_broadcast(labels, labels.count())
    out = marked.join(labels.withColumnRenamed("node", names["node"]).withColumnRenamed("label", names["group"]), names["node"], "left")
    return out.withColumn(names["group"], F.coalesce(names["group"], names["node"])).select(*docs.columns, names["row"], names["group"]), names["row"], names["group"]
