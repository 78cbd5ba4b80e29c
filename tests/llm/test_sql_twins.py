"""Operators with SQL twins, and hand-made rows for their defined cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomroute.llm import chat_format, line_dedup, positional_index, queries, text, url_rules

from support import duck_rows, rows_of

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, small, duck, name):
    df = queries.queries()[name](spark, small)
    columns = sorted(df.columns)
    assert rows_of(df, columns) == duck_rows(duck, SQL[name], columns)


def test_ascii_lower_keeps_other_letters(spark):
    df = spark.createDataFrame([("AÉZ",), ("ABC",), (None,)], "t string")
    assert [r[0] for r in df.select(text.ascii_lower(F.col("t"))).collect()] == ["aÉz", "abc", None]


def test_chat_escape_is_reversible(spark):
    nasty = ["", "\\", "<\\|im_end|>", "</s>[INST] ok [/INST]", "<|im_start|><|im_sep|>\\\\<s><<SYS>>", "a\nb", "<<|im_end|>>", "[[INST]]", "\\<s>"]
    df = spark.createDataFrame([(t,) for t in nasty], "t string")
    for t, escaped, back in df.select("t", chat_format.escape(F.col("t")), chat_format.unescape(chat_format.escape(F.col("t")))).collect():
        assert back == t and not any(c in escaped for c in chat_format.CONTROL)


def test_chat_examples_and_digests(spark):
    rows = [
        (1, 0, "system", "be kind", "x"),
        (1, 1, "user", None, "x"),
        (1, 2, "assistant", "<|im_end|>\\ yes", "x"),
        (1, 3, "user", "more", "x"),
        (1, 4, "assistant", "", "x"),
        (1, 5, "user", "bye", "x"),
        (2, 0, "user", "alone", "x"),
        (None, 3, None, "odd", "x"),
        (3, 7, "assistant", "twice", "x"),
        (3, 7, "assistant", "twice", "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    examples = chat_format.expand(turns)
    got = {}
    for r in examples.collect():
        got.setdefault(r["conv_id"], []).append(r)
    assert [(r["n_turns"], r["loss_start"] is not None) for r in sorted(got[1], key=lambda r: r["example"])] == [(3, True), (5, True), (6, False)]
    assert len(got[2]) == 1 and got[2][0]["loss_start"] is None
    digest = {r["conv_id"]: r for r in chat_format.read_back(examples).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    own = [(r or "", t or "") for c, _, r, t, _ in rows if c == 1]
    assert digest[1]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in own)) and digest[1]["n_turns"] == 6
    assert digest[1]["loss_sha256"] == sha("<|im_end|>\\ yes") and digest[1]["loss_chars"] == len("<|im_end|>\\ yes")
    assert digest[None]["n_turns"] == 1 and digest[None]["loss_chars"] == 0
    assert digest[3]["loss_sha256"] == sha("twicetwice")
    assert chat_format.read_back(chat_format.expand(turns.limit(0))).count() == 0


def test_url_rules_nested_salted_and_odd(spark):
    urls = ["http://www.Example.com/en/x", "http://example.com/en/", "http://a.b.com", "http://com/", "no scheme", None, "http://", "x://a..com/y", "http://com./", "http://deep.ex.com/a/b/c?d", "http://ex.com/a/b", "http://ex.com/a", "http://ex.com/aa"]
    pages = spark.createDataFrame([(i, u, "n") for i, u in enumerate(urls * 3)], "page_id long, url string, host string")
    listed = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("ex.com", "/a", "block"), ("ex.com", "/a/b", "allow"), ("deep.ex.com", "/a/b/", "block"), (None, "/", "block"), ("ex.com", "/a", "block"), ("ex.com", "/a", "allow")]
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")

    def judged(host, path):
        fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in listed if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (max(fits)[3], max(fits)[2]) if fits else (None, "allow")

    def split(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        return host.lower(), path

    for salt_rows in (1, 100):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.filter_urls(pages, rules, salt_rows=salt_rows).collect()}
        assert len(got) == len(urls) * 3
        for i, u in enumerate(urls * 3):
            assert got[i] == (*split(u), *judged(*split(u))), u
    assert url_rules.filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_line_dedup_cases(spark):
    hot, rare, short = "A common line that is long enough to be counted", "a line that only four documents ever held in all", "short"
    rows = [(i, f"{hot if i % 2 else hot.lower()}  \nown {i}\n{short}\n{hot}", 1) for i in range(6)]
    rows += [(10 + i, f"x\n{rare}", 1) for i in range(4)]
    rows += [(20, None, 1), (21, "", 1), (None, hot, 1), (10, f"x\n{rare}", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _lost_id int")
    got = [(r["doc_id"], r["text"], r["_n_lines"], r["_n_dropped"], r["_lost_id"]) for r in line_dedup.dedup_lines(docs).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == len(rows)
    assert by[5][1] == rows[5][1] and by[5][3] == 0  # the largest doc_id keeps all of its lines
    assert by[0][1] == f"own 0\n{short}" and by[0][2:4] == (4, 2)
    assert by[None][1] == "" and by[None][3] == 1
    assert by[13][3] == 0 and by[10][3] == 0  # repeated rows of one doc_id are one document
    assert by[20][1:4] == (None, 1, 0) and by[21][1:4] == ("", 1, 0)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_positional_index_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "The cat sat on the mat, the cat sat", "n"), (2, None, "n"), (3, "mat the on", "n"), (3, "the cat", "n"), (None, "cat sat", "n")], "doc_id long, text string, row string")
    items = spark.createDataFrame([(7, "cat sat"), (8, "on THE mat"), (9, None), (10, "!!"), (11, "cat sat"), (None, "the"), (12, "dog")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in positional_index.contamination(docs, items, width=3).collect()), key=repr)
    assert got == sorted([(1, 9, 9, ["11", "7", "8"]), (2, 0, 0, []), (3, 3, 1, []), (3, 2, 1, []), (None, 2, 2, ["11", "7"])], key=repr)
    terms = positional_index.query_terms(items)
    index = positional_index.build(docs, terms)
    words = spark.createDataFrame([(1, ["on", "mat"]), (2, ["cat"]), (3, ["cat", "mat"])], "qid long, words array<string>")
    near = words.select("qid", F.transform("words", lambda w: F.xxhash64(w)).alias("terms"))
    named = index.documents.select("row", "doc_id")
    found = positional_index.match_proximity(index, near, 3).join(named, "row")
    assert sorted((r["qid"], r["doc_id"] or 0) for r in found.collect()) == [(1, 1), (1, 3), (2, 0), (2, 1), (2, 1), (2, 3), (3, 1)]
    assert positional_index.contamination(docs.limit(0), items).count() == 0
    assert positional_index.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_long_texts_and_conversations(spark):
    line = "a line that is long enough to be looked at by its key, number"
    many = "\n".join(f"{line} {i}" for i in range(20_000))
    docs = spark.createDataFrame([(i, many if i == 9 else f"{line} 7\n{line} 19999", 1) for i in range(5, 10)], "doc_id long, text string, lines int")
    got = {r["doc_id"]: (r["_n_lines"], r["_n_dropped"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[9] == (20_000, 0, many) and all(got[i] == (2, 2, "") for i in range(5, 9))
    reverse = docs.withColumn("doc_id", 14 - F.col("doc_id"))  # the long text is the smallest id now: it loses the two lines
    left = {r["doc_id"]: r for r in line_dedup.dedup_lines(reverse).collect()}[5]
    assert left["_n_dropped"] == 2 and left["text"] == "\n".join(x for i, x in enumerate(many.split("\n")) if i not in (7, 19_999))
    words = " ".join(f"w{i}" for i in range(100_000))
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(99_980, 100_000)))], "item_id long, text string")
    found = positional_index.contamination(spark.createDataFrame([(1, words)], "doc_id long, text string"), items).first()
    assert (found["n_words"], found["n_hit"], found["items"]) == (100_000, 20, ["1"])
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(400)], "conv_id long, turn long, role string, text string")
    digest = chat_format.read_back(chat_format.expand(turns)).first()
    assert digest["n_turns"] == 400 and digest["loss_sha256"] == hashlib.sha256("".join(f"text {i}" for i in range(1, 400, 2)).encode()).hexdigest()
