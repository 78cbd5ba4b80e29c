"""Each stage on its own input against brute force."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomroute.llm import byte_bpe, simhash_similar
from loomroute.llm.simhash_bktree import distance
from loomroute.plans.workspace import save

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_dedup(rows):
    """rows of (doc_id, text) -> the texts after line dedup, written as plainly as possible."""
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(blank).translate(UPPER)
    holders = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    largest = {k: max(x for x in ids if x is not None) for k, ids in holders.items() if len(k) >= 40 and len(ids) >= 5}
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in largest or largest[key(x)] == d]
        out.append((d, text if len(left) == len(lines) else "\n".join(left)))
    return out


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def plain_windows(items):
    found = set()
    for text in items:
        w = plain_words(text)
        found |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    return found


def plain_hit(text, windows):
    w = plain_words(text)
    return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))


def as_rows(docs, *columns):
    return sorted((tuple(r) for r in docs.select(*columns).collect()), key=repr)


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    windows = plain_windows(r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ByteBPE.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks, special_tokens={})
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = save(stage(spark, before, small), name)
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        if name == "byte_bpe":
            sha = lambda b: hashlib.sha256(b).hexdigest()
            ids = {d: np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes() for d, t in rows}
            assert as_rows(docs, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(((d, len(ids[d]) // 4, sha(ids[d]), sha((t or "").encode())) for d, t in rows), key=repr)
            continue
        assert docs.columns == columns
        after = as_rows(docs, "doc_id", "text")
        if name == "language_id":
            assert after == as_rows(before.where(F.col("text").rlike(r"\p{L}")), "doc_id", "text")
        if name == "line_dedup":
            expected = plain_dedup(rows)
            assert after == sorted(expected, key=repr) and expected != rows
            assert as_rows(docs, "n_chars") == sorted(((len(t),) for _, t in expected), key=repr)
        if name == "near_dedup":
            assert [d for d, _ in after] == sorted(plain_kept(rows), key=repr) and len(after) < len(rows)
        if name == "decontaminate":
            assert after == sorted(((d, t) for d, t in rows if not plain_hit(t, windows)), key=repr) and len(after) < len(rows)
    assert as_rows(corpus_pipeline.run(spark, small), *docs.columns) == as_rows(docs, *docs.columns)


def test_stages_take_odd_rows(spark, small):
    long_line = "a line of text that is long enough to be looked at, and in five documents"
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (2, "the the the of and " * 3, "en", "s", 9, 1), (2, "the the the of and " * 3, "en", "s", 9, 1), (None, "in the and of it", "en", None, None, 1)]
    rows += [(i, f"{long_line}\nown words {i}", "en", "s", 1, 1) for i in range(10, 15)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row int"
    full = spark.createDataFrame(rows, schema)
    expected = {
        "language_id": [(2, rows[2][1]), (2, rows[2][1]), (None, rows[4][1])] + [(d, t) for d, t, *_ in rows[5:]],
        "line_dedup": [(2, rows[2][1]), (2, rows[2][1]), (None, rows[4][1])] + [(d, f"own words {d}") for d in range(10, 14)] + [(14, rows[9][1])],
        "near_dedup": [(2, rows[2][1]), (None, rows[4][1])] + [(d, f"own words {d}") for d in range(10, 14)] + [(14, rows[9][1])],
    }
    expected["decontaminate"] = expected["near_dedup"]
    docs, empty = save(full, "odd"), save(full.limit(0), "odd")
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = save(stage(spark, docs, small), name), save(stage(spark, empty, small), name)
        assert empty.count() == 0
        if name in expected:
            assert as_rows(docs, "doc_id", "text") == sorted(expected[name], key=repr), name
            assert docs.columns == full.columns
    assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 2, 10, 11, 12, 13, 14]


def plain_shingles(text):
    parts = (text or "").encode().lower().split()
    return frozenset(b" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))) if parts else frozenset()


def plain_kept(rows):
    """The smallest doc_id of each group linked by a Jaccard similarity of 0.8 or more."""
    sets = [plain_shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())


def test_near_dedup_is_exact_jaccard(spark, small):
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for k in range(60):  # near copies on both sides of the bound, chains among them
        words = (rng.choice(rows)[1] or "none").split() or ["none"]
        for _ in range(rng.randint(1, max(1, len(words) // 25))):
            words[rng.randrange(len(words))] = f"w{k}x{rng.random()}"
        rows.append((10_000 + k, " ".join(words)))
    rows += [(20_000, ""), (20_001, None), (20_002, "one two three four five six"), (20_003, "one two three four five")]
    rng.shuffle(rows)
    docs = save(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, small).collect())
    assert kept == plain_kept(rows)
    assert len(kept) < len(rows) - 20


def test_blocks_and_sizes_lose_no_pair(spark, monkeypatch):
    """Shards cut into blocks, frequent shingles and sets of other sizes give the same groups."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for k in range(160):
        words = list(common[: rng.randint(10, 60)])
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randrange(len(words)), f"x{rng.randrange(12)}")
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(simhash_similar, "SAMPLE", 80)
    docs = save(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    expected = plain_kept(rows)
    assert 1 < len(expected) < len(rows)
    for block, often, most in ((7, 5, 5), (20_000, 10**9, 2000)):
        monkeypatch.setattr(simhash_similar, "OFTEN", often)
        monkeypatch.setattr(simhash_similar, "CLUSTER_SETS", most)
        found, _, group = simhash_similar.groups(docs, radius=128, block=block)
        assert sorted(r["d"] for r in found.groupBy(group).agg(F.min("doc_id").alias("d")).collect()) == expected


@pytest.mark.parametrize("dense", [1, 3, 1000])
def test_overlaps_count_every_shared_shingle(monkeypatch, dense):
    monkeypatch.setattr(simhash_similar, "DENSE_DF", dense)
    rng = np.random.default_rng(dense)
    sets = [np.unique(rng.integers(-20, 60, rng.integers(0, 50))) for _ in range(40)]
    left, right = sets[:15], sets[5:]
    found = simhash_similar._overlaps(left, right)
    assert found.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert simhash_similar._overlaps(sets[:2], []).shape == (2, 0)


def test_wide_fingerprints_tell_sets_apart():
    """Sets of similarity 0.8 lie within the radius, unrelated ones far beyond it."""
    rng = np.random.default_rng(4)
    near, far = [], []
    for _ in range(400):
        n = int(rng.integers(20, 800))
        own = rng.integers(0, 1 << 63, 10 * n, dtype=np.uint64)
        k = 9 * n // 10 * 10 // 10
        a, b = own[:n], np.concatenate([own[:k], own[n : 2 * n - k]])  # 0.9 n shared of 1.1 n: similarity 0.818
        word = lambda x: np.array([simhash_similar.set_fingerprint(np.unique(x))], dtype=np.uint64)
        near.append(int(distance(word(a), word(b))[0]))
        far.append(int(distance(word(a), word(own[3 * n : 4 * n]))[0]))
    assert max(near) <= simhash_similar.RADIUS and 17 < np.mean(near) < 21 and min(far) > simhash_similar.RADIUS and 60 < np.mean(far) < 68
