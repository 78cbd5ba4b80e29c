"""Rules that are easy to get wrong, on hand-made rows."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomroute import catalog
from loomroute.functions import fields, keys, smiles
from loomroute.operators import actions, and_or_board, board_text, caches, claims, consensus, corpus, draft_rules, graph, pareto, quantiles, routes
from loomroute.sources import readers, schemas, writers

from support import duck_rows, rows_of


def test_pareto_null_rules(spark):
    df = spark.createDataFrame([("t", 1, 1.0, 1.0), ("t", 2, 1.0, 1.0), ("t", 3, None, 5.0), ("t", 4, 0.5, 0.5)], "g string, id long, a double, b double")
    ids = lambda rule: sorted(r["id"] for r in pareto.front(df, ["g"], {"a": "max", "b": "max"}, rule).collect())
    assert ids("exclude") == [1, 2]  # equal vectors do not dominate each other
    assert ids("worst") == [1, 2, 3]
    assert ids("shared") == [3]  # on the shared axis b, row 3 beats all
    ranks = {r["id"]: r["front"] for r in pareto.ranks(df, ["g"], "id", {"a": "max", "b": "max"}).collect()}
    assert ranks == {1: 1, 2: 1, 3: None, 4: 2}


CANDIDATES = [
    # product, key, backend, rank
    ("p", "x", "A", 0), ("p", "y", "A", 1), ("p", "z", "A", 2),
    ("p", "y", "B", 0), ("p", "x", "B", 3), ("p", "x", "B", 1),  # the better of two ranks stays
    ("p", "w", "C", None),  # no rank counts as 0
    ("p", None, "C", 1),  # no key is left out
    ("q", "x", "B", 5),
]


def test_consensus_rules(spark):
    c = spark.createDataFrame(CANDIDATES, "product string, key string, backend string, rank int")

    def order(product="p", **how):
        return [r["key"] for r in consensus.rank(c, **how).where(F.col("product") == product).orderBy("place").collect()]

    by = {r["key"]: r for r in consensus.aggregate(c).where("product = 'p'").collect()}
    x = by["x"]
    assert (x["votes"], x["n_backends"], x["mrr"], x["best_rank"], x["rrf"], x["plurality"], x["agreement"], x["score"]) == (2.0, 2, 0.75, 0, round(1 / 60 + 1 / 61, 6), 1.0, 0.6667, 2.75)
    assert (by["w"]["votes"], by["w"]["best_rank"], by["z"]["mrr"]) == (1.0, 0, 0.3333)
    assert order(backbone="vote") == ["x", "y", "w", "z"]  # x and y tie on all figures; the key decides
    assert order(backbone="rrf") == order(backbone="union") == ["x", "y", "w", "z"]
    # w has a first place as x and y have, but less fused rank; z has none.
    assert order(backbone="plurality") == ["x", "y", "w", "z"]
    assert order(backbone="single", pinned="B") == ["y", "x"] and order("q", backbone="single", pinned="A") == []
    # Pinned rows keep the figures of all backends.
    assert consensus.rank(c, "single", pinned="B").where("product = 'p' AND key = 'x'").first()["votes"] == 2.0
    assert order(backbone="single", pinned="auto", priority=("C",)) == ["w"]
    assert order(backbone="single", weights={"B": 2.0}) == ["y", "x"]
    # A weight of 3 for C: w has 3 votes and a mean reciprocal rank of 1.
    assert order(backbone="vote", weights={"C": 3.0}) == ["w", "x", "y", "z"]
    # Half a first place for y; x has more fused rank than w.
    assert order(backbone="plurality", weights={"B": 0.5}) == ["x", "w", "y", "z"]
    assert order(backbone="vote", top_k=0) == ["x"]
    with pytest.raises(ValueError):
        consensus.rank(c, "best")
    ranked = consensus.rank(c, "vote", 5).withColumn("ok", F.lit(False))
    assert consensus.roundtrip_filter(ranked, "ok", "hard").count() == ranked.count()  # never empties a product


def test_agreement_gate(spark):
    c = spark.createDataFrame(CANDIDATES + [("p", "y", "D", 0)], "product string, key string, backend string, rank int")
    ok = spark.createDataFrame([("p", b) for b in "ABCDE"] + [("q", "B"), ("r", "A")], "product string, backend string")
    got = {r["product"]: tuple(r)[1:] for r in consensus.agreement_gate(c, 2, ok).collect()}
    assert got == {"p": (5, "y", 2, False), "q": (1, None, 0, True), "r": (1, None, 0, True)}
    assert not consensus.agreement_gate(c, 0, ok).where("abstained").count()


def test_price_and_sentence_figures(spark):
    prices = {0.005: "$0.01", 0.374: "$0.37", 1.0: "$1.0", 9.94: "$9.9", 12: "$12", 999: "$999", 1200: "$1.2k", 12_000: "$12k", 3_000_000: "$3.0M", 4_000_000: "$3.3M+"}
    df = spark.createDataFrame([(float(p),) for p in prices], "p double")
    assert [r[0] for r in df.select(keys.price_string(F.log("p"))).collect()] == list(prices.values())
    scale = spark.createDataFrame([(2.5,), (7.0,), (11.5,), (20.0,), (0.0,)], "v double")
    assert [r[0] for r in scale.select(keys.cost_string("v")).collect()] == ["$.000", "$.500", "$1.000", "$1.000", "$.000"]
    texts = {"p is 0.374.": 1, "One. Two! Three?": 3, "": 0, "  ": 0, "No mark": 1, "a.b.c": 1, "End.\nNext": 2}
    said = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in said.select(claims.sentence_count(F.col("t"))).collect()] == list(texts.values())
    cut = {
        "c7 reproduces nothing, while c5 clears the filter at 0.998": ["c7 reproduces nothing, ", " c5 clears the filter at 0.998"],
        "c2 is cheap but c3 is better": ["c2 is cheap ", " c3 is better"],
        "cheap but weak": ["cheap but weak"],
        "good, but weak": ["good", " weak"],
        "note: one -- two — three; four": ["note", "one", "two", "three;", "four"],
    }
    parts = spark.createDataFrame([(t,) for t in cut], "t string")
    assert [r[0] for r in parts.select(claims.clauses(F.col("t"))).collect()] == list(cut.values())


def test_quantiles_by_counts(spark):
    rows = [("a", v) for v in (5, 1, 9000, 9001, 4096, 4095, None, 5)] + [("b", -3)]
    df = spark.createDataFrame(rows, "g string, v long")
    at = {r["g"]: (r["low"], r["high"]) for r in quantiles.at_positions(df, ["g"], "v", {"low": lambda n: F.lit(0), "high": lambda n: n - 1}).collect()}
    assert at == {"a": (1, 9001), "b": (-3, -3)}
    assert {r["g"]: r["median"] for r in quantiles.medians(df, ["g"], "v").collect()} == {"a": 4095.0, "b": -3.0}
    even = spark.createDataFrame([(i,) for i in (1, 2, 10_000, 10_001)], "v long")
    assert quantiles.medians(even, [], "v").first()["median"] == 5001.0


def test_split_takes_the_smallest_hashes(spark):
    import hashlib

    units = [f"u{i}" for i in range(200)]
    df = spark.createDataFrame([(u, k) for u in units for k in range(2)], "u string, k int")
    got = {r["u"] for r in corpus.split_share(df, "u", 0.1, seed=3).where("part = 'valid'").collect()}
    assert got == set(sorted(units, key=lambda u: hashlib.md5(f"3:{u}".encode()).hexdigest())[:20])
    assert corpus.split_share(df.limit(0), "u", 0.1).count() == 0


def test_route_axes_null_policies(spark):
    s = spark.createDataFrame([(1, 1, 0.1, 1, 10.0), (1, 2, 0.01, None, None), (2, 1, 0.2, 6, 5.0)], "route long, pos long, p double, rt int, price double")
    a = {r["route"]: r for r in routes.axes(s, 0.05, 5).collect()}
    assert a[1]["p_share"] == 0.5 and a[1]["rt5"] is None and a[1]["rt5_miss"] == 0.5 and a[1]["cost"] is None and a[1]["cost_known"] == 10.0
    assert a[2]["rt5"] == 0.0 and a[2]["cost"] == 5.0


def test_keys(spark):
    df = spark.createDataFrame([("P", ["b", "a", "a"])], "p string, r array<string>")
    r = df.select(keys.step_key("p", "r"), keys.step_key("p", "r", distinct=False), keys.given_key("p", "r")).first()
    assert tuple(r) == ("P>>a.b", "P>>a.a.b", "P>>b.a.a")
    route = spark.sql("SELECT array(named_struct('product','T','reactants',array('b','a')), named_struct('product','a','reactants',array('c'))) AS s")
    assert tuple(route.select(keys.leaves("s"), keys.internal("s")).first()) == (["b", "c"], ["T", "a"])
    pair = spark.createDataFrame([([], [])], "a array<int>, b array<int>")
    assert pair.select(keys.jaccard_distance("a", "b")).first()[0] is None


def test_caches_keep_failures_apart(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "key string, value double")
    over = spark.createDataFrame([("a", None), ("d", 4.0)], "key string, value double")
    as_dict = lambda df: {r["key"]: r["value"] for r in df.collect()}
    assert as_dict(caches.overlay(base, over, "key", "value")) == {"a": None, "b": None, "c": 3.0, "d": 4.0}
    assert as_dict(caches.merge([base, over], "key")) == {"a": 1.0, "b": None, "c": 3.0, "d": 4.0}
    wanted = spark.createDataFrame([("a",), ("b",), ("e",)], "key string")
    assert [r["key"] for r in caches.need(wanted, base, "key").collect()] == ["e"]
    assert tuple(caches.coverage(wanted, base, "key", "value").first()) == (3, 2, 1, 3)


def test_maxmin_and_settle_with_a_cycle(spark):
    c = spark.createDataFrame([("T", 0, 0.9, ["a", "b"]), ("T", 1, 0.4, ["b"]), ("a", 0, 0.8, ["T"]), ("x", 0, None, ["b"])], "node string, candidate int, signal double, pieces array<string>")
    stock = spark.createDataFrame([("b",)], "node string")
    v = {r["node"]: r["value"] for r in graph.maxmin(c, stock, 5).collect()}
    assert v == {"T": 0.4, "a": 0.4, "b": graph.BEST, "x": graph.WORST}
    closed = {r["node"]: r["level"] for r in graph.settle(c.withColumnRenamed("candidate", "reaction"), stock).collect()}
    assert closed == {"b": 0, "T": 1, "x": 1, "a": 2}


def test_action_payloads(spark):
    cases = {
        '{"actions":[{"type":"rank","mid":"a","order":[1,0]}]}': None,
        '{"actions":[]}': "empty",
        "no json": "not_json",
        '{"actions":[{"type":"fly"}]}': "unknown_verb",
        '{"actions":[{"type":"rank","mid":"a"}]}': "rank_without_order",
        '{"actions":[{"type":"rank","mid":"a","order":[1,1]}]}': "repeated_candidate",
        '{"actions":[{"type":"open"}]}': "missing_molecule",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", actions.reject_json(F.col("p"))).collect()} == cases


def test_claims_and_templates(spark):
    df = spark.createDataFrame([("One two. Three but four;\nfive",), (None,)], "t string")
    assert [r[0] for r in df.select(claims.clauses(F.col("t"))).collect()] == [["One two.", "Three but four;", "five"], []]
    said = spark.createDataFrame([("k", 0.1004), ("k", 0.1006), ("z", 0.1)], "k string, v double")
    facts = spark.createDataFrame([("k", 0.1)], "k string, v double")
    assert sorted((r["k"], r["v"]) for r in claims.unsupported(said, facts, "k", "v", 5e-4).collect()) == [("k", 0.1006), ("z", 0.1)]
    t = spark.createDataFrame([("a=1.b=2;a=1",), ("a=1.b=2;a=3",)], "t string")
    assert [r[0] for r in t.select(claims.read_template(F.col("t"), "a={x}.b={y};a={x}")["x"]).collect()] == ["1", None]
    parts = spark.createDataFrame([("<think>t</think><act>open a</act>",), ("<think>t",), ("p",)], "t string")
    assert [r[0]["kind"] for r in parts.select(claims.completion_parts(F.col("t"))).collect()] == ["act", "cut", "plain"]


def test_smiles_reading(spark):
    df = spark.createDataFrame([("CC(=O)Nc1ccc(Cl)cc1", ["CC(=O)Cl", "Nc1ccc(Cl)cc1"]), ("CBr", ["C"]), ("", [])], "p string, r array<string>")
    got = df.select(smiles.heavy_atoms(F.col("p")), smiles.conserves(F.col("p"), F.col("r")), smiles.retro_mass_ok(F.col("p"), F.col("r"))).collect()
    assert [tuple(r) for r in got] == [(11, True, True), (2, False, True), (None, None, False)]
    one = spark.createDataFrame([("[CH3:1][OH:2].Cl",)], "s string")
    assert one.select(smiles.strip_maps(F.col("s")), smiles.major_component(F.col("s"))).first()[1] == "[CH3:1][OH:2]"
    assert one.select(smiles.formula(F.col("s"))).first()[0] == {"C": 1, "O": 1, "Cl": 1}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "run.jsonl").write_text(json.dumps({"target": "T", "routes": [[{"product": "T", "reactants": ["a"]}]] * 3, "found_at_calls": [1.0, None, 9.0]}) + "\n\n")
    run = readers.jsonl(spark, str(tmp_path / "run.jsonl"), schemas.RUN)
    assert run.count() == 1 and readers.run_routes(run, 5).count() == 1 and readers.run_routes(run).count() == 3
    with pytest.raises(ValueError):
        readers.require_targets(run, 2)
    (tmp_path / "menu.json").write_text(json.dumps({"T": [[["b", "a"], 0.5], [["c"], 0.1]]}))
    assert [(r["idx"], r["reactants"], r["q"]) for r in readers.menu(spark, str(tmp_path / "menu.json")).orderBy("idx").collect()] == [(0, ["a", "b"], 0.5), (1, ["c"], 0.1)]
    (tmp_path / "scores.json").write_text('{"a": 1.5, "b": null}')
    assert {r["key"]: (r["value"], r["present"]) for r in readers.score_cache(spark, str(tmp_path / "scores.json")).collect()} == {"a": (1.5, True), "b": (None, True)}
    for name, body in (("1.csv", "smi_can,price\nA,1.0\nB,error\n"), ("2.csv", "smi_can,price\nA,2.0\n")):
        (tmp_path / name).write_text(body)
    assert [tuple(r) for r in readers.prices(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")]).collect()] == [("A", 2.0)]
    (tmp_path / "stock.txt").write_text("A\n\nB\nA\n")
    assert readers.stock(spark, str(tmp_path / "stock.txt")).count() == 2
    (tmp_path / "spend.json").write_text('{"T": {"r1": 5.0}}')
    assert [tuple(r) for r in readers.spend(spark, str(tmp_path / "spend.json")).collect()] == [("T", "r1", 5.0)]
    base = spark.createDataFrame([("a", 1.0)], "key string, value double")
    more = spark.createDataFrame([("a", 2.0), ("b", None)], "key string, value double")
    assert writers.merged_cache(base, [more], "key", str(tmp_path / "cache")) == {"added": 1, "kept": 1}
    assert writers.jsonl(more, str(tmp_path / "out")) == 2
    writers.append_draws(more, base, "key", str(tmp_path / "draws"))
    assert spark.read.parquet(str(tmp_path / "draws")).count() == 1


def _chain(spark, n):
    return spark.createDataFrame([(i + 1, i) for i in range(n)], "child long, parent long")


def test_deep_chains_are_whole(spark):
    n = 80
    edges = _chain(spark, n)
    up = graph.ancestors(edges).collect()
    assert len(up) == n * (n + 1) // 2 and {(r["node"], r["ancestor"], r["distance"]) for r in up} == {(i, j, i - j) for i in range(n + 1) for j in range(i)}
    assert {r["node"]: r["depth"] for r in graph.longest_chain(edges).collect()} == {i: n - i for i in range(n + 1)}
    assert {(r["root"], r["leaf"]) for r in graph.leaf_walk(edges).collect()} == {(i, n) for i in range(n)}


def test_settle_and_dead_run_to_the_end(spark):
    n = 64
    rx = spark.createDataFrame([(i, 0, [i + 1]) for i in range(n)] + [(0, 1, [999])], "node long, reaction int, pieces array<long>")
    last = spark.createDataFrame([(n,), (n,)], "node long")
    assert {r["node"]: r["level"] for r in graph.settle(rx, last).collect()} == {n - i: i for i in range(n + 1)}
    # Node 0 has another reaction that still lives.
    assert sorted(r["node"] for r in graph.dead(rx, last).collect()) == list(range(1, n + 1))
    assert graph.settle(rx, last.limit(0)).count() == 0 and graph.dead(rx, last.limit(0)).count() == 0


def test_a_cycle_is_an_error(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 9)], "child long, parent long")
    with pytest.raises(ValueError, match="cycle"):
        graph.ancestors(edges)
    assert graph.ancestors(edges.where("child = parent")).count() == 0


def test_board_finds_alternatives_and_caps_routes():
    world = {"T": (False, [["A", "S1"]]), "A": (False, [["S1"], ["S2"], ["X"]]), "X": (False, []), "S1": (True, []), "S2": (True, [])}
    acts = [("open", {"mid": "T"}), ("rank", {"mid": "T", "order": [0]}), ("open", {"mid": "A"}), ("rank", {"mid": "A", "order": [0]}), ("rank", {"mid": "A", "order": [1]}), ("rank", {"mid": "A", "order": [1]}), ("rank", {"mid": "A", "order": [9]}), ("rank", {"mid": "A", "order": []}), ("open", {"mid": "S1"}), ("open", {"mid": "Z"})]
    for most, routes_ in ((0, 2), (1, 1)):
        b = and_or_board.AndOrBoard("T", world, 10, most)
        codes = [b.act(i, verb, args) for i, (verb, args) in enumerate(acts)]
        assert codes == [None] * 5 + ["already_tried", "unknown_candidate", "empty_order", "purchasable", "unknown_molecule"]
        assert len(b.routes) == routes_ and b.figures()[-1]
    # A shared piece is one node at its shallower depth; a claim may apply several steps at once.
    shared = {"T": (False, [["A", "B"]]), "A": (False, [["B"]]), "B": (False, [["S"]]), "S": (True, [])}
    b = and_or_board.AndOrBoard("T", shared, 2)
    assert [b.act(1, "open", {"mid": "T"}), b.act(2, "rank", {"mid": "T", "order": [0], "take": 3}), b.act(3, "open", {"mid": "A"}), b.act(4, "open", {"mid": "B"})] == [None, None, None, "budget"]
    assert b.act(5, "done", {"choices": {"T": 0, "A": 0, "B": 0}}) == "not_on_screen" and b.act(6, "rank", {"mid": "A", "order": [0]}) is None
    assert b.nodes["B"].depth == 1 and b.act(7, "dead", {"mid": "B", "reason": "tired"}) == "unknown_reason"
    assert b.act(8, "dead", {"mid": "B", "reason": "floor"}) is None and b.steps[0].status == "failed" and b.act(9, "rank", {"mid": "B"}) == "bad_arguments"


def test_work_tables_go_with_their_block(spark):
    from pathlib import Path

    from loomroute.plans import workspace

    at = lambda df: Path(df.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent
    one = spark.range(3)
    with workspace.scratch(spark, keep=("stays",)):
        gone, stays = workspace.save(one, "gone"), workspace.save(one, "stays")
        with workspace.scratch(spark):
            inner = at(workspace.save(one, "stays"))
        assert not inner.exists() and gone.count() == 3
        paths = at(gone), at(stays)
    assert not paths[0].exists() and stays.count() == 3
    rounds = workspace.Rounds("loop")
    first = at(rounds.save(one))
    second = rounds.save(spark.range(5))
    assert not first.exists() and second.count() == 5


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from loomroute.plans import workspace

    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)), master="local-cluster[3,2,1024]")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="checkpoint"):
        workspace.shared_dir(session)


def test_the_entry_point_survives_a_missing_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['loomroute.llm'] = None; import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 200 and 'op1_chat_format' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent), timeout=120)


def test_board_walks_wanted_routes():
    world = {"T": (False, [["A", "S"], ["S"]]), "A": (False, [["S"], ["T"], ["B"]]), "B": (False, [["S"]]), "S": (True, [])}
    b = and_or_board.AndOrBoard("T", world, 9)
    assert b.claim({"T": ["S", "A"], "A": ["S"]}) == (None, ["T"], False)  # nothing is on screen yet
    b.act(1, "open", {"mid": "T"})
    assert b.claim({"T": ["S"]}) == ({"T": 1}, [], False) and b.claim({"T": ["S"]}, window=1) == (None, [], True)
    assert b.claim({"T": ["S", "A"], "A": ["S"]}) == (None, [], True)  # A is not on the board, and cannot be bought
    b.act(2, "rank", {"mid": "T", "order": [0]})
    assert b.claim({"T": ["A", "S"], "A": ["S"]}) == (None, ["A"], False)
    b.act(3, "open", {"mid": "A"})
    assert b.claim({"T": ["A", "S"], "A": ["S"]}) == ({"T": 0, "A": 0}, [], False)
    assert b.claim({"T": ["A", "S"], "A": ["T"]})[2] and b.claim({"T": ["A", "S"]})[2] and b.claim({"T": ["B"]})[2] and b.claim({})[2]
    assert b.act(4, "rank", {"mid": "A", "order": [0]}) is None and len(b.routes) == 1
    assert b.swapped(b.routes[0], "A", 2) == {"T": 0, "A": 2} and b.swapped(b.routes[0], "T", 1) == {"T": 1}


def test_objectives_are_read():
    known = {"quality": [("p", "max"), ("cost", "min")]}
    assert fields.objectives("quality", known) == known["quality"] and fields.objectives("p:max, cost:min", known) == known["quality"]
    for bad in ("p", "p:best", ":max", ""):
        with pytest.raises(ValueError):
            fields.objectives(bad, known)


def test_stock_close_counts_equal_endings_once(spark):
    """A long episode of formula endings: what its joins give out grows with the turns, not with their pairs (F1)."""
    n = 600
    text = F.concat(F.lit("First words. More of turn "), F.col("id").cast("string"), F.lit(". "), F.when(F.col("id") % 3 < 2, "this branch closes with stock pieces; nothing remains open").otherwise("something else entirely ends this turn; really, other words"))
    turns = spark.range(0, n, 1, 2).select(F.lit("e").alias("episode"), F.col("id").alias("turn"), text.alias("text"))
    out = draft_rules.stock_close(turns.unionByName(turns.select(F.lit(None).cast("string").alias("episode"), "turn", "text")))
    kinds = [i % 3 < 2 for i in range(n)]
    expected = [("e", i, h, i) for i in range(6, n) if (h := kinds[:i].count(kinds[i])) >= max(4, i // 2)]
    assert sorted(map(tuple, out.collect())) == expected
    made, seen = 0, [out._jdf.queryExecution().executedPlan()]
    while seen:
        node = seen.pop()
        kind = node.nodeName()
        seen += [node.executedPlan()] if kind == "AdaptiveSparkPlan" else [node.plan()] if kind.endswith("QueryStage") else []
        seen += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in kind or kind == "Generate":
            made = max(made, node.metrics().get("numOutputRows").get().value())
    assert 0 < made <= 20 * n


def test_rounding_of_printed_numbers(spark):
    """As C prints them: ties of the exact value to even, and no detour over the logarithm (F2)."""
    values = [30500.0, 43500.0, 104500.0, 1250.0, 1450.0, 1350.0, 10000.0, 9950.0, 999.5, 2.5, 1102000.0, 4_000_000.0]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    shown = [f"${d / 1000:.0f}k" if d >= 10_000 else f"${d / 1000:.1f}k" if d >= 1000 else f"${d:.0f}" for d in values]
    assert [r[0] for r in df.select(keys.dollars_string("d")).collect()] == shown
    line = board_text.candidate_line(F.lit(1), F.lit(0.0625), F.lit(2), F.lit(True), F.array("d"), keys.dollars_string)
    assert [r[0] for r in df.select(line).collect()] == [f"c1 q.062 rt2 {x}" for x in shown]


def test_candidate_lines_equal_sql_at_ties(spark, duck, tmp_path):
    """Prices at ties and thresholds give the SQL's lines (F2)."""
    prices = [20000.0, 30500.0, 31500.0, 43500.0, 44500.0, 99500.0, 104500.0, 1102000.0] + [1000.0 * i + 500 for i in range(20, 105)]
    _lines(duck, tmp_path, [(i // 7, i % 7 + 1, p) for i, p in enumerate(prices)])
    _equal_sql(spark, tmp_path, "candidate_lines")


def test_route_lines_equal_sql_at_ties(spark, duck, tmp_path):
    """Small and large sums, ties and thresholds give the SQL's lines (F3)."""
    sums = [0.4, 2.5, 9.99, 999.5, 1000.0, 1250.0, 9999.99, 10000.0, 88500.0, 89500.0, 1102000.0, 4_000_000.0]
    _lines(duck, tmp_path, [(i, n, s / 2) for i, s in enumerate(sums) for n in (1, 2)])
    _equal_sql(spark, tmp_path, "route_lines")


def test_sums_follow_the_files_order(spark, duck, tmp_path):
    """Sums near a rounding tie are those of the lines in the files' order, however the tasks cut the files (F4)."""
    r = random.Random(3)
    rows = []
    for i in range(2000):
        cents = [r.randrange(100_000, 10_000_000) for _ in range(6)]
        rows += [(i, n + 1, c / 100) for n, c in enumerate([*cents, 20_000_050 - sum(cents) % 100])]
    r.shuffle(rows)
    _lines(duck, tmp_path, rows)
    for conf, value in (kept := {"spark.sql.files.maxPartitionBytes": "32k", "spark.sql.files.openCostInBytes": "1k"}).items():
        kept[conf] = spark.conf.get(conf)
        spark.conf.set(conf, value)
    try:
        _equal_sql(spark, tmp_path, "template_round_trip")
    finally:
        for conf, value in kept.items():
            spark.conf.set(conf, value)


def _lines(duck, tmp_path, rows):
    """lineitem of rows (order, line, price), in this order, and its orders."""
    columns = "SELECT l_orderkey, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, l_linenumber, 1.0::DOUBLE AS l_quantity, l_extendedprice, 0.05::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, 'A' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '2000-01-01' AS l_shipdate"
    values = ", ".join(f"({o}::BIGINT, {n}::INTEGER, {p!r}::DOUBLE)" for o, n, p in rows)
    duck.execute(f"COPY ({columns} FROM (VALUES {values}) AS v(l_orderkey, l_linenumber, l_extendedprice)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    duck.execute(f"COPY (SELECT DISTINCT l_orderkey AS o_orderkey, 1::BIGINT AS o_custkey, 'F' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, TIMESTAMP '2000-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM '{tmp_path}/lineitem.parquet') TO '{tmp_path}/orders.parquet'")


def _equal_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql("SET threads=1")
    for t in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    assert rows_of(df, columns) == duck_rows(con, catalog.oracle_sql()[name], columns)
