"""op3_near_dedup: what meets in the joins of pairs."""

import random

from lexatlas.llm import setsketch


def test_only_nodes_of_pairs_meet_their_sets(spark, monkeypatch):
    side = spark.createDataFrame([(bytes([i // 256, i % 256]), i) for i in range(2000)], "node binary, n int")
    pairs = spark.createDataFrame([(bytes([0, 1]), bytes([0, 2])), (bytes([0, 3]), bytes([0, 2]))], "node binary, pivot binary")
    seen = []
    plain = setsketch.spread_join
    monkeypatch.setattr(setsketch, "spread_join", lambda left, right, *more: seen.append(right) or plain(left, right, *more))
    rows = sorted(tuple(r) for r in setsketch._with_ends(pairs, side).select("n", "p_n").collect())
    assert rows == [(1, 2), (3, 2)]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "_lx_b" in plan  # the membership filter stands before the join


def test_near_copies_of_many_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t + " more") for i, t in enumerate(texts[:40])]
    found = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    root = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert root == {i: i % 1000 for i, _ in rows}


def test_both_filters_of_the_ends_are_written_at_once(spark, monkeypatch):
    from lexatlas.llm import common

    written, plain = [], common.cut
    for module in (common, setsketch):
        monkeypatch.setattr(module, "cut", lambda df: written.append(df.columns) or plain(df))
    side = spark.createDataFrame([(bytes([i // 256, i % 256]), i) for i in range(600)], "node binary, n int")
    pairs = spark.createDataFrame([(bytes([0, i]), bytes([0, i % 3])) for i in range(3, 40)], "node binary, pivot binary")
    rows = sorted(tuple(r) for r in setsketch._with_ends(pairs, side).select("n", "p_n").collect())
    assert rows == [(i, i % 3) for i in range(3, 40)]
    assert len(written) == 2  # the weights of the pivots and one table with both filters


def test_filters_of_two_sides_stay_apart(spark):
    from lexatlas.llm.common import may_contain, memberships

    a, b = (spark.createDataFrame([(i,) for i in ids] * 2, "k long") for ids in (range(0, 50), range(100, 130)))
    keys = spark.range(200).select("id")
    held = [{r["id"] for r in may_contain(keys, ["id"], f, "_m").filter("_m").collect()} for f in memberships([a, b])]
    assert set(range(0, 50)) <= held[0] and set(range(100, 130)) <= held[1]
    assert len(held[0]) < 60 and len(held[1]) < 40
