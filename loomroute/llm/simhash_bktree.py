"""SimHash near-duplicate groups found with BK-trees.

Fingerprint: A-Z lowered, words are runs outside ASCII white space, shingles are ``words`` consecutive words
joined by one space (repeats count; a shorter text is one shingle), each hashed with XXH64 (seed 42). A bit is
set if it is set in more than half of the hashes. No words: fingerprint zero.

Links: two fingerprints with at most ``radius`` differing bits. Distinct fingerprints go to shards: the 64 bits
are cut into bands, and two fingerprints within the radius agree on enough whole bands to meet in at least one
shard, so sharding loses no link. Each shard is a BK-tree (children keyed by the integer Hamming distance to
their parent); its members query it, following only edges that differ from their own distance by at most the
radius. A shard tree is sent to the tasks that hold its queries rather than from the driver, since the driver
must not hold all fingerprints. A shard with more than ``block`` members is cut into blocks; every pair of
blocks is a task of its own, so no task holds more than two blocks of it and no pair goes missing.
A task returns a spanning star for each group it found, at most one row per member, never all pairs.

Defined cases: null text has no words; equal fingerprints are one node whatever their number; a row per input
row comes back; null doc_ids never become a component's id unless all of its documents have none; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomroute.plans.workspace import Rounds, checked_broadcast, save, scratch, shuffle_width

from .slices import release, sliced

WORDS = 4
RADIUS = 4
#: Members of a shard that one task takes as tree or as queries.
BLOCK = 20_000
#: Pairs of query and node looked at together.
FRONTIER = 250_000
#: Distinct fingerprints up to which each (bands, bands that must agree) is used; more bands make smaller shards.
SHARDINGS = ((2_000_000, 1), (500_000_000, 2), (None, 4))
_CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    parts = text.encode().lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(len(parts) - words + 1, 1)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[len(parts) - n :] - 1).tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        raw = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in sliced(batches):
            fps = np.fromiter((fingerprint(t, words) for t in batch.column("text").to_pylist()), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, fp long")


def _bands(radius: int, agree: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + agree bands: at most ``radius`` of them can differ."""
    n = radius + agree
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _shard_masks(radius: int, agree: int) -> list[int]:
    bands = _bands(radius, agree)
    masks = [sum(((1 << w) - 1) << s for s, w in chosen) for chosen in combinations(bands, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one word, or of several words a row."""
    bits = np.bitwise_count(a ^ b)
    return (bits if bits.ndim == 1 else bits.sum(axis=1)).astype(np.int64)


def _span(fp: np.ndarray) -> int:
    """Distances from 0 to the number of bits: an edge's key is its parent times this plus its distance."""
    return 64 * (1 if fp.ndim == 1 else fp.shape[1]) + 1


def bk_forest(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A BK-tree for each shard: root of each item, and (parent, distance) keys of the nodes in order with their items.

    All trees grow together, a level at a time: items that stand at the same node with the same distance to it
    go on below the first of them, which becomes the node's child on that edge.
    """
    n = len(fp)
    _, first, inverse = np.unique(shard, return_index=True, return_inverse=True)
    root = first[inverse]
    active = np.setdiff1d(np.arange(n), first, assume_unique=True)
    at = root[active]
    keys, nodes = [], []
    while len(active):
        step = at * _span(fp) + distance(fp[active], fp[at])
        edge, heads, group = np.unique(step, return_index=True, return_inverse=True)
        keys.append(edge)
        nodes.append(active[heads])
        rest = np.ones(len(active), dtype=bool)
        rest[heads] = False
        at = active[heads][group][rest]
        active = active[rest]
    if not keys:
        return root, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    key, node = np.concatenate(keys), np.concatenate(nodes)
    order = np.argsort(key, kind="stable")
    return root, key[order], node[order]


def bk_query(fp: np.ndarray, root: np.ndarray, key: np.ndarray, node: np.ndarray, asked: np.ndarray, asked_fp: np.ndarray, radius: int):
    """Yield (index into asked, item) within the radius, in pieces of bounded size. ``root`` is the root of each query.

    The stack holds pairs of query and node to look at, and pairs whose edges are still to be followed; a piece whose
    edges lead to more than ``FRONTIER`` pairs is halved before they are written out.
    """
    span = _span(fp)
    stack = [(asked[i : i + FRONTIER], root[i : i + FRONTIER], None) for i in range(0, len(asked), FRONTIER)]
    while stack:
        q, at, many = stack.pop()
        if many is None:
            far = distance(asked_fp[q], fp[at])
            near = far <= radius
            if near.any():
                yield q[near], at[near]
            lo = np.searchsorted(key, at * span + np.maximum(far - radius, 0))
            many = np.searchsorted(key, at * span + np.minimum(far + radius, span - 1), side="right") - lo
            some = many > 0
            q, at, many = q[some], lo[some], many[some]
        total = int(many.sum())
        if total > FRONTIER and len(q) > 1:
            half = len(q) // 2
            stack += [(q[:half], at[:half], many[:half]), (q[half:], at[half:], many[half:])]
        elif total:
            step = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
            stack.append((np.repeat(q, many), node[np.repeat(at, many) + step], None))


def join_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Give both ends of each link the same label; labels only fall."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _stars(batches, radius: int):
    """Links of one task's shards: (fp, center), one row for each member that is not its group's center."""
    held = list(batches)
    if not sum(b.num_rows for b in held):  # a task without shards
        return
    table = pa.Table.from_batches(held)
    group = np.unique(np.stack([table.column(c).to_numpy() for c in ("mask", "shard", "lo", "hi")], axis=1), axis=0, return_inverse=True)[1].ravel()
    fp = table.column("fp").to_numpy().view(np.uint64)
    lo, hi, own = (table.column(c).to_numpy() for c in ("lo", "hi", "own"))
    in_tree, asks = own == lo, own == hi
    tree = np.flatnonzero(in_tree)
    root, key, node = bk_forest(group[tree], fp[tree])
    root_of = np.full(int(group.max()) + 1, -1)
    root_of[group[tree]] = root
    asked = np.flatnonzero(asks)
    asked = asked[root_of[group[asked]] >= 0]
    label = np.arange(len(fp))
    for q, at in bk_query(fp[tree], root_of[group[asked]], key, node, asked, fp, radius):
        other = tree[at]
        apart = q != other
        join_labels(label, q[apart], other[apart])
    below = np.flatnonzero(label != np.arange(len(fp)))
    if len(below):
        yield pa.RecordBatch.from_arrays([pa.array(fp[below].view(np.int64)), pa.array(fp[label[below]].view(np.int64))], names=["u", "v"])
    del table, held
    release()


def with_blocks(members: DataFrame, shard: list[str], item: str, block: int) -> DataFrame:
    """Members with their block (own) and the pair of blocks (lo, hi) of each task that they belong to.

    A shard of at most ``block`` members is one block. A larger one is cut by a hash of ``item``, and each of its
    blocks meets each other in a task of its own.
    """
    hot = members.groupBy(*shard).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select(*shard, F.ceil(F.col("_n") / block).cast("int").alias("blocks"))
    hot = save(hot, "hot_shards")
    n_hot = hot.count()
    if n_hot:
        members = members.join(checked_broadcast(hot, n_hot), shard, "left").fillna(1, "blocks")
    else:
        members = members.withColumn("blocks", F.lit(1))
    members = members.withColumn("own", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return members.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("blocks", "other")


def links(distinct: DataFrame, n_distinct: int, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v): links that connect the same fingerprints as all pairs within the radius do."""
    agree = next(a for most, a in SHARDINGS if most is None or n_distinct <= most)
    masks = _shard_masks(radius, agree)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("shard")) for i, m in enumerate(masks)]))
    members = distinct.select("fp", each.alias("s")).select("s.mask", "s.shard", "fp")
    tasks = with_blocks(members, ["mask", "shard"], "fp", block)
    width = max(shuffle_width(distinct.sparkSession), n_distinct * len(masks) // 500_000 + 1)
    return tasks.repartition(width, "mask", "shard", "lo", "hi").mapInArrow(lambda b: _stars(b, radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the ends of all links (u, v); alternating large-star and small-star steps.

    The smallest neighbour comes from a partial aggregate, so a hub costs one partial row per task.
    """

    def low(df: DataFrame, both: bool) -> DataFrame:
        sides = df.union(df.select("v", "u")) if both else df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        near = sides.join(least, "u")
        if both:
            return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        kept = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return kept.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    state, rounds = None, Rounds("links")
    edges = rounds.save(edges.where("u <> v"))
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
        edges = rounds.save(low(low(edges, True), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest doc_id reachable over links."""
    with scratch(docs.sparkSession, keep=("fingerprints", "distinct", "labels")):
        own = save(fingerprints(docs, words), "fingerprints")
        distinct = save(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
        edges = links(distinct, distinct.count(), radius, block)
        labels = save(components(edges), "labels")
        n_linked = labels.count()
    linked = distinct.join(checked_broadcast(labels, n_linked), distinct["fp"] == labels["node"]).select("fp", "label", "first_id")
    least = linked.groupBy("label").agg(F.min("first_id").alias("component"))
    of = linked.join(least, "label").select("fp", "component")
    named = distinct.join(checked_broadcast(of, n_linked), "fp", "left").select("fp", F.coalesce("component", "first_id").alias("component_id"))
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
