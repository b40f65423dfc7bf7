"""Findings of the third round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lexatlas.functions.tails import _near_normal, two_sided_p
from lexatlas.operators import effects, neighbours, ranking
from lexatlas.plans import frames, map_queries


def test_t_tail_of_many_rows_settles():
    """F8: rows with thousands of degrees of freedom settle one by one; a row's value does not depend on those beside it."""
    r = np.random.default_rng(0)
    df, t = 10 ** r.uniform(0, 5, 640), r.normal(size=640) * 3
    together = two_sided_p(t, df)
    alone = np.array([two_sided_p(a, b)[0] for a, b in zip(t, df)])
    assert np.array_equal(together, alone)
    # The series for large df is exact to 1e-9 from some thousands on.
    large = df > 2e4
    assert np.allclose(together[large], _near_normal(t[large], df[large]), atol=1e-9, rtol=0)


def test_queries_are_sent_once_to_a_group_of_cells(spark):
    """A query is one row however many cells it visits; where nothing can be ruled out the lots and blocks stay bounded."""
    r = np.random.default_rng(1)
    v = r.normal(size=(700, 24))
    v[600:] = v[:100]  # copies
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    index = neighbours.build_index(df, "id", "v", 5, False, 10)
    assert len(index.pivots) == 60
    visiting = neighbours.visits(index, index.points, None, 5, [])
    assert visiting.count() == 600
    found = neighbours.nearest_neighbours(df, 5, "id", "v", "euclidean", 10).collect()
    d = neighbours.distances(v, v, exact=True)
    np.fill_diagonal(d, np.inf)
    for e in found:
        order = np.argsort(d[e["src"]], kind="stable")
        assert (e["dst"], e["dist"]) == (order[e["rank"] - 1], d[e["src"], order[e["rank"] - 1]])
    assert len(found) == 3500


def test_several_groups_lots_and_blocks_meet(spark, monkeypatch):
    """The pairs that lots of queries and blocks of groups are dealt over are all pairs."""
    monkeypatch.setattr(neighbours, "MEET", 30)
    r = np.random.default_rng(2)
    v = np.concatenate([r.normal(size=(150, 3)), r.normal(size=(150, 3)) * 0.01 + 1e3])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    index = neighbours.build_index(df, "id", "v", 4, False, 40)
    assert index.groups.max() > 0
    d = neighbours.distances(v, v, exact=True)
    np.fill_diagonal(d, np.inf)
    for e in neighbours.nearest_neighbours(df, 4, "id", "v", "euclidean", 40).collect():
        order = np.argsort(d[e["src"]], kind="stable")
        assert (e["dst"], e["dist"]) == (order[e["rank"] - 1], d[e["src"], order[e["rank"] - 1]])


def test_ranks_are_not_broadcast(spark):
    """exploded values and their ranks, which are as many, meet by sorting, not by sending one side to every task."""
    wide = spark.range(500).select("id", (F.col("id") % 2).cast("int").alias("cluster_id"), F.array(*[(F.col("id") * j % 7).cast("double") for j in range(4)]).alias("features"))
    made = ranking.percentile_ranks(ranking.long_view(wide, "id", "features"))
    associated = effects.topic_associations(wide)
    for df, least in ((made, 1), (associated, 1)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= least
    assert made.count() == 2000 and associated.count() == 8


def test_points_are_dealt_by_documents(spark, tmp_path, monkeypatch):
    """A task has a bounded number of documents, however few row groups the table has."""
    monkeypatch.setattr(frames, "PER_TASK", 10)
    n = 10 * (spark.sparkContext.defaultParallelism + 5)
    spark.createDataFrame([(i, f"Word {i}.", "en", "web", 7) for i in range(n)], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [0.0, 1.0, float(i)], 0) for i in range(n)], "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    made = frames.points(spark, str(tmp_path))
    assert made.count() == n and made.rdd.getNumPartitions() == n // 10


def test_stream_files_follow_the_documents():
    """no file of the stream holds more than 10,000 documents."""
    assert [map_queries._files(n) for n in (0, 500, 40_000, 40_001, 600_000)] == [4, 4, 4, 5, 60]


def test_copies_just_below_the_limit_do_not_meet_their_whole_group(spark, monkeypatch):
    """op3_near_dedup, pipeline: pairs grow with the copies, not their square, and every link of the full sets is found."""
    import random

    from lexatlas.llm import setsketch

    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]

    def edited(places, mark):
        return [w if i not in places else f"{mark}{w}" for i, w in enumerate(base)]

    texts = [edited(rng.sample(range(1, 119), rng.randint(1, 3)), f"c{k}") for k in range(250)]
    for k in range(80):  # at most 0.79 similar to the base, some of them linked by a copy that has half of their edits
        places = rng.sample(range(2, 118, 3), rng.randint(7, 9))
        texts.append(edited(places, f"o{k}"))
        if k % 8 == 0:
            texts.append(edited(places[:4], f"o{k}"))
    rng.shuffle(texts)
    sets = [{*zip(t, t[1:])} for t in texts]
    root = [*range(len(texts))]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    met, compare = [], setsketch._linked

    def counted(pairs, *others):
        met.append(pairs.count())
        return compare(pairs, *others)

    monkeypatch.setattr(setsketch, "_linked", counted)
    got = setsketch.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), width=2)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: find(i) for i in range(len(texts))}
    assert 10 < len({find(i) for i in range(len(texts))}) < 80
    assert sum(met) < 30 * len(texts)
