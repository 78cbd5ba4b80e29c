"""Order-dependent operators against plain loops."""

import time

import pandas as pd
from pyspark.sql import functions as F

from loomroute import catalog
from loomroute.operators import board, corpus, diversity
from loomroute.plans import q_state
from loomroute.streaming import microbatch
from loomroute.streaming.board_stream import replay_stream

Q = catalog.queries()


def test_pack_sequences(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "n_chars").orderBy("doc_id").collect()
    expected, state = {}, {}
    for doc_id, n in docs:
        source = doc_id % 16
        pack, used = state.get(source, (0, 0))
        if n > 16_384:
            expected[source, doc_id] = (-1, 0)
            continue
        if used + n > 16_384:
            pack, used = pack + 1, 0
        expected[source, doc_id] = (pack, used)
        state[source] = (pack, used + n)
    assert {(r["stream"], r["doc_id"]): (r["pack"], r["offset"]) for r in Q["pack_sequences"](spark, small).collect()} == expected
    stats = Q["packing_stats"](spark, small).first()
    assert stats["samples"] == len(expected) and stats["packs"] == sum(p + 1 for p, _ in state.values())


def test_oversize_sample_is_dropped_whole(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 99), ("a", 3, 5), ("a", 4, 1)], "stream string, i long, n long")
    got = {r["i"]: (r["pack"], r["offset"]) for r in corpus.pack(df, "stream", "i", "n", 10).collect()}
    assert got == {1: (0, 0), 2: (-1, 0), 3: (0, 5), 4: (1, 0)}


def test_clusters_follow_growing_unions(spark):
    sets = spark.createDataFrame([("t", 1, [1, 2]), ("t", 2, [2, 3]), ("t", 3, [1, 2, 3, 4]), ("t", 4, [9]), ("u", 1, [])], "t string, r long, items array<int>")
    got = {(r["t"], r["r"]): r["cluster"] for r in diversity.cluster(sets, "t", "r", "items", 0.5).collect()}
    # {2,3} shares 1 of 3 with {1,2}; {1,2,3,4} shares 2 of 4 with the first cluster.
    assert got == {("t", 1): 0, ("t", 2): 1, ("t", 3): 0, ("t", 4): 2, ("u", 1): 0}


def test_microbatch(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet").toPandas().sort_values(["event_type", "ts", "event_id"])
    expected = {}
    for kind, pool in e.groupby("event_type"):
        number, used, first = -1, 0, None
        for t, i in zip(pool.ts, pool.event_id):
            if number < 0 or used == 16 or (t - first).total_seconds() > 1.0:
                number, used, first = number + 1, 0, t
            used += 1
            expected[kind, i] = number
    assert {(r["event_type"], r["event_id"]): r["batch"] for r in Q["microbatch_16_or_1s"](spark, small).collect()} == expected
    assert microbatch.assign([0.0] * 33, 16, 1.0)[0] == [0] * 16 + [1] * 16 + [2]


def test_board_rules():
    b = board.Board(2)
    assert b.apply(1, "rank", "a", 0) == "not_expanded"
    assert b.apply(1, "open", "a", 0) is None
    assert b.apply(1, "rank", "a", 0) == "twice_in_turn"
    assert b.apply(2, "rank", "a", 0) is None
    assert b.apply(3, "rank", "a", 0) == "repeated_candidate"
    assert b.apply(4, "open", "a.0", 0) is None
    assert b.apply(5, "open", "b", 0) == "budget"
    assert b.apply(6, "dead", "a.0", 0) is None
    assert b.status == {"a": "dead", "a.0": "dead"} and b.counts() == (0, 2)  # the parent has no candidate and no budget left
    assert b.apply(7, "fly", "a", 0) == "unknown_verb"
    assert b.apply(8, "terminate", "", 0) is None and b.apply(9, "open", "c", 0) == "after_end"
    assert board.Board.load(b.dump()).dump() == b.dump()


def test_board_replay_batch_equals_loop_and_stream(spark, small, tmp_path):
    log = q_state.action_log(spark, small)
    rows = log.orderBy("episode", "seq").collect()
    expected = {}
    for episode in {r["episode"] for r in rows}:
        own = [(r["episode"], r["seq"], r["turn"], r["verb"], r["mid"], r["cand"]) for r in rows if r["episode"] == episode]
        for x in board.replay_rows(board.Board(10), own):
            expected[x[0], x[1]] = x[2:]
    got = {(r["episode"], r["seq"]): tuple(r)[2:] for r in Q["board_replay"](spark, small).collect()}
    assert got == expected
    half = log.agg(F.max("seq")).first()[0] // 2
    for i, part in enumerate((log.where(F.col("seq") <= half), log.where(F.col("seq") > half))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = replay_stream(stream, 10).writeStream.format("memory").queryName("boards").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["episode"], r["seq"]): tuple(r)[2:] for r in spark.table("boards").collect()} == expected


def test_stream_batches_keep_the_open_batch(spark, tmp_path):
    rows = [("q", i, i * 0.3) for i in range(20)]
    expected = microbatch.assign([t for _, _, t in rows], 4, 1.0)[0]
    for part in (rows[:9], rows[9:]):
        spark.createDataFrame(part, "q string, i long, _t double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema("q string, i long, _t double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = microbatch.stream_batches(stream, "q", "i", 4, 1.0).writeStream.format("memory").queryName("stream_batches").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = pd.DataFrame(spark.table("stream_batches").collect(), columns=["q", "i", "batch"]).sort_values("i")
    assert got.batch.tolist() == expected
