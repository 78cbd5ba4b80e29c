"""Operators without SQL against brute force, round trips and held-out accuracy."""

import hashlib
import html
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers as tokenizers_of
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomroute.llm import byte_bpe, html_lstm, imatch, ppm_language, simhash_bktree, sstable

RANKS, WORDS = tokenizers_of.path("byte_bpe_50k.tiktoken"), tokenizers_of.path("word_bpe_49k.json")


def plain_fingerprint(text, words=4):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), 42) for i in range(max(1, len(parts) - words + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps):
    """doc list of (doc_id, fp) -> component id of each position."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(fps))]


def test_simhash_groups(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    expected = sorted((d, f"{fp:016x}", c) for (d, fp), c in zip(rows, plain_components(rows)))
    assert sorted(tuple(r) for r in simhash_bktree.query(spark, small).collect()) == expected


@pytest.mark.parametrize("sharding", [((None, 1),), ((None, 2),), ((None, 4),)])
def test_links_lose_no_group(spark, monkeypatch, sharding):
    rng = random.Random(3)
    fps = []
    for _ in range(40):
        center = rng.getrandbits(64)
        fps.append(center)
        for _ in range(6):
            center ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))
            fps.append(center)
    fps += [0, 0, (1 << 64) - 1]
    rows = list(enumerate(fps))
    monkeypatch.setattr(simhash_bktree, "SHARDINGS", sharding)
    signed = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in rows], "doc_id long, fp long")
    distinct = signed.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    for block in (4, 1000):  # hot shards cut into blocks, or not
        labels = {r["node"]: r["label"] for r in simhash_bktree.components(simhash_bktree.links(distinct, len(set(fps)), block=block)).collect()}
        groups = {}
        for d, f in signed.collect():
            groups.setdefault(labels.get(f, f), []).append(d)
        got = {d: min(g) for g in groups.values() for d in g}
        assert [got[d] for d, _ in rows] == plain_components(rows)


def test_bk_query_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    fp = np.unique((rng.integers(0, 4, 3000)[:, None] * 0 + rng.integers(0, 1 << 12, (3000, 1))).ravel().astype(np.uint64))
    shard = rng.integers(0, 3, len(fp))
    monkeypatch.setattr(simhash_bktree, "FRONTIER", 500)
    root, key, node = simhash_bktree.bk_forest(shard, fp)
    found = set()
    for q, at in simhash_bktree.bk_query(fp, root, key, node, np.arange(len(fp)), fp, 2):
        found |= set(zip(q.tolist(), at.tolist()))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    assert found == set(zip(*map(list, np.nonzero(near & (shard[:, None] == shard[None, :])))))


def test_simhash_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "one two", 1), (3, "one two", 1), (None, "ONE\ttwo", 1), (5, "x " * 200_000, 1), (6, "x " * 150_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = [tuple(r) for r in simhash_bktree.near_duplicates(docs).select("doc_id", "component_id").collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, 3), (5, 5), (6, 5)], key=repr)
    assert simhash_bktree.near_duplicates(docs.limit(0)).count() == 0


def test_imatch_against_loop(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in imatch.query(spark, small).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    assert len(got) == len(rows)
    by_text = {}
    for i, (doc_id, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[1][:half]
        r = got[doc_id]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        cut = lambda f: [f[k : k + 16] for k in range(0, len(f), 16)]
        for other, value in ((r["edited_fingerprint"], r["near_edited"]), (got[following[0]]["fingerprint"], r["near_next"])):
            pairs = [(a, b) for a, b in zip(cut(r["fingerprint"]), cut(other)) if a != "0" * 16 or b != "0" * 16]
            assert value == pytest.approx(sum(a == b for a, b in pairs) / len(pairs) if pairs else 1.0)
        if edited == t:
            assert r["near_edited"] == 1.0
    assert np.mean([r["near_edited"] for r in got.values()]) > 5 * np.mean([r["near_next"] for r in got.values()])


def test_imatch_hash_of_sorted_terms(spark, small):
    """A subset's hash is XXH64 over the sorted ids of the document's terms in it."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    lex = {r["term"]: r["subsets"] for r in imatch.lexicon(docs).collect()}
    one = docs.orderBy("doc_id").limit(1)
    words = one.select(F.explode(F.array_distinct(imatch.padded_words(F.col("text")))).alias("w")).select(F.xxhash64("w").alias("t")).collect()
    terms = sorted({r["t"] for r in words if r["t"] in lex})
    found = imatch.fingerprints(docs).where(F.col("doc_id") == one.first()["doc_id"]).first()["own"]
    for i, h in enumerate(found):
        chosen = [t for t in terms if lex[t] >> i & 1]
        seed = 42
        for t in chosen:
            seed = xxhash.xxh64_intdigest(t.to_bytes(8, "little", signed=True), seed)
        assert h == ((seed - (1 << 64) if seed >> 63 else seed) if chosen else 0)


def test_imatch_odd_rows(spark):
    rows = [(5, None, 1), (4, "alpha beta", 1), (4, "alpha beta", 1), (None, "gamma", 1), (9, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own int")
    got = imatch.fingerprints(docs, high=1.0, ranges=3).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 5), (4, 10), (4, 10), (5, 0), (9, 0)]
    assert all(r["own"] is not None and r["next"] is not None for r in got)
    alone = imatch.fingerprints(docs.where("doc_id = 9"), high=1.0).collect()
    assert len(alone) == 1 and alone[0]["next"] == alone[0]["own"]
    assert imatch.fingerprints(docs.limit(0)).count() == 0


def test_ppm_probabilities_sum_to_one():
    model = ppm_language.train({"a": [b"abracadabra", b"banana"], "b": [b"xyzzy xyzzy"]})
    p = np.exp2(-model.bits.reshape(-1, model.width, 2).astype(float))
    total = p[:, :-1].sum(1) + p[:, -1] * (256 - model.width + 1)
    assert np.allclose(total, 1, atol=1e-5)


def plain_code_length(samples, text, order):
    """PPM with escapes and exclusion, written as plainly as possible."""
    counts = {}
    for s in samples:
        for i in range(len(s)):
            for k in range(min(order, i) + 1):
                c = counts.setdefault(s[i - k : i], {})
                c[s[i]] = c.get(s[i], 0) + 1
    bits = 0.0
    for i, b in enumerate(text):
        out = set()
        for k in range(min(order, i), -1, -1):
            c = {x: n for x, n in counts.get(text[i - k : i], {}).items() if x not in out}
            if not c:
                continue
            total = sum(c.values()) + len(c)
            if b in c:
                bits -= np.log2(c[b] / total)
                break
            bits -= np.log2(len(c) / total)
            out |= set(c)
        else:
            bits += np.log2(256 - len(out))
    return bits


def test_ppm_code_lengths_against_plain_ppm(monkeypatch):
    samples = {"a": [b"the cat sat on the mat", b"that hat"], "b": [b"der hund und die katze", b"und so"]}
    texts = [b"the hat on the cat", b"und der", b"", b"zzz\xff\x00", b"t"]
    # The first bytes of a sample are known to the model with shorter contexts only, as in the plain version.
    model = ppm_language.train(samples, order=3)
    expected = [[plain_code_length(samples[lang], t, 3) for lang in ("a", "b")] for t in texts]
    assert np.allclose(ppm_language.code_lengths(model, texts), expected, rtol=1e-4)
    monkeypatch.setattr(ppm_language, "PIECE", 5)
    assert np.allclose(ppm_language.code_lengths(model, texts), expected, rtol=1e-4)


def test_language_accuracy_and_odd_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = ppm_language.query(spark, small).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    held = {r["doc_id"]: r["held_out"] for r in ppm_language.query(spark, small).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in held.items())
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34 !", "en"), (4, "the", None), (None, "the", "en"), (4, "the", None)], "doc_id long, text string, lang string")
    got = [tuple(r) for r in ppm_language.predict(odd, ppm_language.fit(docs)).collect()]
    assert [g[1] for g in got[:3]] == ["und"] * 3 and [g[2] for g in got[:3]] == [0.0] * 3 and len(got) == 6
    assert {r["lang_pred"] for r in ppm_language.predict(odd, ppm_language.fit(odd.where("lang IS NULL"))).collect()} == {"und"}


def test_sstable_round_trip_and_lookup():
    buffer = io.BytesIO()
    writer = sstable.Writer(buffer, 2)
    keys = [None, -(2**63), -7, -7, 0, 1, 255, 256, *range(10_000, 30_000, 3), 2**63 - 1]
    for i, k in enumerate(keys):
        writer.add(sstable.encode_key(k), np.full(i % 40, i % 60_000, dtype="<u2").tobytes())
    with pytest.raises(ValueError):
        writer.add(sstable.encode_key(5), b"")
    writer.close()
    reader = sstable.Reader(pa.BufferReader(buffer.getvalue()))
    assert [k for k, _ in reader] == keys and len(reader.blocks) > 3
    first = {}
    for i, k in enumerate(keys):
        first.setdefault(k, i)
    assert all(reader.get(k).tolist() == [i % 60_000] * (i % 40) for k, i in first.items())
    absent = range(10_001, 30_000, 3)
    assert all(reader.get(k) is None for k in absent)
    assert sum(reader.may_have(sstable.encode_key(k)) for k in absent) < 0.05 * len(absent)
    broken = bytearray(buffer.getvalue())
    broken[100] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Reader(pa.BufferReader(bytes(broken))))
    with pytest.raises(ValueError):
        sstable.Reader(pa.BufferReader(b"x" * 100))


def test_token_shards_against_the_library(spark, small):
    tokenizer = Tokenizer.from_file(WORDS)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    start, expected = 0, []
    for doc_id, t in sorted((r["doc_id"], r["text"] or "") for r in docs.collect()):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in sstable.query(spark, small).collect()) == expected


def test_token_shards_odd_rows(spark):
    from loomroute.plans.workspace import new_folder

    docs = spark.createDataFrame([(None, "a b", 1), (3, None, 1), (3, "x", 1), (1, "", 1), (2, "y " * 50_000, 1)], "doc_id long, text string, path int")
    manifest = sstable.write_shards(docs, new_folder(spark, "odd"), WORDS, 2)
    got = sorted(((r["doc_id"] or 0, r["start"], r["n_tokens"]) for r in sstable.read_shards(manifest).collect()), key=lambda r: r[1])
    assert got == [(0, 0, 3), (1, 3, 1), (2, 4, 50_001), (3, 50_005, 1), (3, 50_006, 2)]
    empty = sstable.write_shards(docs.limit(0), new_folder(spark, "empty"), WORDS, 2)
    assert sstable.read_shards(empty).count() == 0


ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "'s", "'", "!", "1", "23", "中", "😀", "\x1c", "\x85", "\xa0", chr(0x2003), "²", "ª", "Ω", "Σ", chr(0x301), "…", "'ll", "A", "İ", "<|endoftext|>", "×"]


def test_word_encoder_on_random_texts():
    tokenizer = Tokenizer.from_file(WORDS)
    encoder, rng = sstable.WordEncoder(WORDS), random.Random(5)
    texts = ["".join(rng.choices(ALPHABET[: 14 if i % 2 else None], k=rng.randint(0, 14))) for i in range(3000)]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, dtype="<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_byte_bpe_against_the_library(spark, small):
    bpe = byte_bpe.ByteBPE.load(RANKS, tokenizers_of.PATTERN)
    library = tiktoken.Encoding("own", pat_str=tokenizers_of.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(6)
    for _ in range(5000):
        t = "".join(rng.choices(ALPHABET, k=rng.randint(0, 14)))
        assert bpe.encode(t) == library.encode_ordinary(t), repr(t)
    for t in ("aab" * 30_000, " " * 50_000 + "x", "a" * 70_001, "=" * 9999):
        assert bpe.encode(t) == library.encode_ordinary(t) and bpe.decode(bpe.encode(t)) == t.encode()
    assert not any(bpe.leaves)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in byte_bpe.query(spark, small).collect():
        ids = np.array(library.encode_ordinary(docs[r["doc_id"]]), dtype="<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())


def test_byte_bpe_merge_that_ranks_lower():
    """A merge can create a pair of a better rank than others that wait: it goes first."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 400, b"abc": 300, b"cd": 350, b"abcd": 500}
    bpe = byte_bpe.ByteBPE(ranks, tokenizers_of.PATTERN)
    library = tiktoken.Encoding("own", pat_str=tokenizers_of.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    for _ in range(2000):
        t = "".join(rng.choices("abcd", k=rng.randint(1, 12)))
        assert bpe.encode(t) == library.encode_ordinary(t), t


def test_byte_bpe_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "a", 1)], "doc_id long, text string, ids int")
    got = byte_bpe.encode_documents(docs, RANKS, tokenizers_of.PATTERN).collect()
    assert [(r["doc_id"], bytes(r["decoded"])) for r in got] == [(None, b""), (1, b""), (1, b"a")]
    assert byte_bpe.encode_documents(docs.limit(0), RANKS, tokenizers_of.PATTERN).count() == 0


@pytest.fixture(scope="module")
def weights(spark, small):
    return html_lstm.fit_sample(html_lstm.sample(spark.read.parquet(f"{small}/pages.parquet"), 120))


def plain_article(page):
    """The article's text of the generator's pages, by patterns alone: headline and paragraphs."""
    body = re.search(r"<article>(.*)</article>", page or "", re.S)
    parts = re.split(r"</?(?:h1|p)>", body.group(1)) if body else []
    texts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in parts)
    return "\n\n".join(t for t in texts if t)


def test_html_text_against_plain_patterns(spark, small, weights):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    expected = {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in html_lstm.extract(pages, weights).collect()} == expected
    few = {r["page_id"]: plain_article(r["html"]) for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in html_lstm.query(spark, small).collect()} == {k: (t, len(t)) for k, t in few.items()}


ARTICLE = ["Storm hits the coast", "By Jane Doe", "Heavy rain fell on Monday, and roads were closed for hours.", "Officials said that repairs will take a week."]


@pytest.mark.parametrize(
    "around",
    [
        "<nav><a href=a>Home</a> <a href=b>News</a></nav>{}<footer>© 2020 The Site</footer>",
        "<div class=menu><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></div>{}<div class='disqus'><h3>2 comments</h3><div>bob</div><p>I was there, it was terrible.</p><div>ann</div><p>Stay safe everyone!</p></div>",
        "<div class='cookie notice'>We use cookies to make this site better.</div>{}<section id=comments><p>Thanks for writing this.</p><p>I do not agree at all.</p></section>",
        "<div class=advert><p>Buy shoes now, they are cheap!</p></div>{}<aside><h3>More</h3><ul><li><a href=x>Other story about the rain</a></ul></aside>",
        "<header><a href=/>The Site</a></header>{}<form><label>Your mail address</label><input><p>Get our news every day.</p></form>",
    ],
)
def test_html_kinds_of_blocks(weights, around):
    """Article headers and bylines stay; menus, adverts, notices, forms, sidebars and reader comments go."""
    head = f"<header><h1>{ARTICLE[0]}</h1><p class=byline>{ARTICLE[1]}</p></header>"
    body = "".join(f"<p>{t}</p>" for t in ARTICLE[2:])
    for box in ("<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>"):
        page = html_lstm.blocks("<body>" + around.format(box.format(head + body)))
        kept = [b[0] for b, s in zip(page, html_lstm.scores(weights, [html_lstm.features(page)])[0]) if s > 0.5]
        assert kept == ARTICLE, box


def test_html_teacher_reads_positions():
    """Without an article the deepest container of most prose is taught, whatever its name."""
    page = html_lstm.blocks("<body><div><a href=x>Menu</a></div><div class=zz><div class=q><h2>Head</h2><p>First sentence of the text is here.</p><p>And the second one goes on for long.</p><form><p>Give us your mail now.</p></form></div></div><p>Short end note here.</p>")
    assert [b[0] for b, y in zip(page, html_lstm.teach(page)) if y] == ["Head", "First sentence of the text is here.", "And the second one goes on for long."]
    assert html_lstm.teach([]) == []


def test_html_made_up_pages_are_learned(weights):
    maker = html_lstm._Layouts(np.random.default_rng(99), "the of and house river blue walk quick seven".split())
    pages = [maker.page() for _ in range(300)]
    found = html_lstm.scores(weights, [html_lstm.features(p) for p, _ in pages])
    assert np.mean(np.concatenate([(s > 0.5) == np.array(y) for s, (_, y) in zip(found, pages)])) > 0.97


def test_html_blocks():
    page = "<title>t</title><nav><a href=x>m</a></nav><main><h1>T &amp; U</h1><p>a&nbsp; b<br>c &lt;d <p>e<ul><li>one<li>two</ul><script>var p='<p>no</p>'</script></main><!-- c --><footer>&copy; f"
    assert [b[0] for b in html_lstm.blocks(page)] == ["m", "T & U", "a b c <d", "e", "one", "two", "© f"]
    assert html_lstm.blocks(None) == [] == html_lstm.blocks("")


def test_html_gradient():
    """Back-propagation agrees with finite differences."""
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in html_lstm.new_weights(rng).items()}
    x, mask = html_lstm._pad([rng.normal(size=(5, html_lstm.DIM)).astype(np.float32), rng.normal(size=(3, html_lstm.DIM)).astype(np.float32)])
    x = x.astype(np.float64)
    up = rng.normal(size=(5, 2, html_lstm.HIDDEN)) * mask
    for way in "fb":
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        _, trace = html_lstm._run(w, way, x, mask, True)
        html_lstm._back(w, way, x, mask, trace, up, grads)
        for name in (f"{way}x", f"{way}h", f"{way}c"):
            at = tuple(0 if i else -1 for i in range(w[name].ndim))
            kept, step, sums = w[name][at], 1e-2, []
            for s in (step, -step):
                w[name][at] = kept + s
                sums.append(float((html_lstm._run(w, way, x, mask, False)[0].astype(np.float64) * up).sum()))
            w[name][at] = kept
            assert grads[name][at] == pytest.approx((sums[0] - sums[1]) / (2 * step), rel=2e-2, abs=2e-3)


def test_html_odd_rows(spark, weights):
    pages = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 1), (2, "u", "<article><p>x</p></article>", 1), (None, "u", "<p" * 2000, 1)], "page_id long, url string, html string, text int")
    assert len(html_lstm.extract(pages, weights).collect()) == 4
    long_page = "<article>" + "<p>One sentence of this very long page.</p>" * 20_000 + "</article>"
    whole = html_lstm.extract(spark.createDataFrame([(1, "u", long_page)], "page_id long, url string, html string"), weights).first()["text"]
    assert whole.count("One sentence") > 19_900
    assert html_lstm.extract(pages.limit(0), weights).count() == 0
    made_up_only = html_lstm.fit_sample(html_lstm.sample(pages.limit(0)))
    assert html_lstm.extract(pages, made_up_only).count() == 4


def test_word_encoder_leaves_added_tokens_to_the_library():
    tokenizer = Tokenizer.from_file(WORDS)  # at its defaults
    texts = ["end of text <|endoftext|> next", "<|startoftext|>a b<|endoftext|>", "<|ENDOFTEXT|> x", "< |endoftext| >", "plain text", "é<|endoftext|>"]
    for t, ids in zip(texts, sstable.WordEncoder(WORDS).encode(texts)):
        assert np.frombuffer(ids, dtype="<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_html_unclosed_head_and_skipped_elements():
    def read(page):
        return [b[0] for b in html_lstm.blocks(page)]

    assert read("<html><head><title>t</title><script>s</script><body><article><p>a</article>") == ["a"]
    assert read("<html><head><meta charset=x><link href=y><style>s</style><article><p>a</article>") == ["a"]
    assert read("<html><head><title>t</title></head><body><p>a") == ["a"]
    for tag in ("button", "select", "svg", "noscript", "template", "object"):
        assert read(f"<body><div><{tag}>x<div>y</div>z</div><p>a") == ["a"], tag
        assert read(f"<body><div><{tag}><div>y</div></{tag}>b</div><p>a") == ["b", "a"], tag


def test_imatch_band_ignores_copies(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    hot = docs.orderBy("doc_id").limit(1)
    many = hot.select(F.explode(F.sequence(F.lit(1000), F.lit(1099))).alias("doc_id"), "text")  # a third of the rows
    more = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(many.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    alone, among = (sorted(tuple(r) for r in imatch.lexicon(d).collect()) for d in (docs, more))
    assert alone == among
    assert any(imatch.fingerprints(more).where("doc_id = 1000").first()["own"])


def test_language_ties_and_empty_tables(spark):
    same = {"b": [b"la la la", b"lo la"], "a": [b"la la la", b"lo la"]}
    model = ppm_language.train(same)
    docs = spark.createDataFrame([(1, "la lo", "x", 0.1), (2, "la " * 30_000, "x", 0.2)], "doc_id long, text string, lang_pred string, score double")
    got = ppm_language.predict(docs, model).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("a", 0.5), ("a", 0.5)]  # a tie goes to the language that sorts first
    assert ppm_language.predict(docs.limit(0), model).count() == 0
    named = ppm_language.annotate(docs, model, "guess", "how_sure")
    assert named.columns == [*docs.columns, "guess", "how_sure"] and {r["lang_pred"] for r in named.collect()} == {"x"}


def test_language_learned_from_long_texts_only(spark):
    rows = [(i, "der die das und " * 20, "de") for i in range(5)] + [(10 + i, "the of and to in " * 2000, "en") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = ppm_language.sample(docs, per_language=3, longest=500)
    assert {k: len(v) for k, v in found.items()} == {"de": 3, "en": 3} and all(len(t) == 500 for t in found["en"])
    assert set(ppm_language.sample(docs, most_languages=1)) == {"de"}  # as many rows each: the one that sorts first


def test_byte_bpe_digests_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "a", 1), (2, "na " * 100_000, 1)], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in byte_bpe.digests(docs, RANKS, tokenizers_of.PATTERN).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    library = tiktoken.Encoding("own", pat_str=tokenizers_of.PATTERN, mergeable_ranks=byte_bpe.loaded(RANKS, tokenizers_of.PATTERN).ranks, special_tokens={})
    expected = []
    for d, t in ((None, ""), (1, ""), (1, "a"), (2, "na " * 100_000)):
        ids = np.array(library.encode_ordinary(t), dtype="<u4").tobytes()
        expected.append((d, len(ids) // 4, sha(ids), sha(t.encode())))
    assert got == sorted(expected, key=repr)
    assert byte_bpe.digests(docs.limit(0), RANKS, tokenizers_of.PATTERN).count() == 0


def test_html_tie_is_no_content(spark):
    zero = {k: np.zeros_like(v) for k, v in html_lstm.new_weights(np.random.default_rng(0)).items()}
    pages = spark.createDataFrame([(1, "u", "<article><p>One sentence here.</p></article>")], "page_id long, url string, html string")
    assert html_lstm.extract(pages, zero).first()["text"] == ""  # every score is exactly one half
