"""Findings of round 4: what is shuffled and written grows with the rows, and goes when it has been used."""

import os

import numpy as np
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexatlas.operators import approximate, density, layout, neighbours
from lexatlas.session import TIDY, cut, release, shared_dir


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {n for i in range(blocks.size()) if (n := blocks.apply(i).name()).startswith("shuffle_")}


def folders(spark):
    at = shared_dir(spark).removeprefix("file:")
    return {f"{at}/{n}" for n in os.listdir(at)} if os.path.isdir(at) else set()


def parts(folder):
    return [os.path.join(top, f) for top, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id bigint, v array<double>")


def test_written_tables_leave_no_shuffle_files_and_can_go(spark):
    """A table that has been written keeps nothing of its shuffles; a released one is deleted, other frames are left alone."""
    before, setting, there = shuffle_files(spark), spark.conf.get(TIDY, None), folders(spark)
    made = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3))
    assert not shuffle_files(spark) - before and spark.conf.get(TIDY, None) == setting
    assert made.count() == 7 and len(folders(spark) - there) == 1
    release(made.select("k"), None)
    assert made.count() == 7
    release(made)
    assert folders(spark) == there


def test_functions_that_write_travel():
    """A function that knows cut can be sent to tasks."""
    assert callable(cloudpickle.loads(cloudpickle.dumps(cut)))


def test_a_search_sends_every_query_once(spark, monkeypatch):
    """Points are written once, by block, and are not sent to the lots of queries; a second search reads the same files."""
    monkeypatch.setattr(neighbours, "MEET", 40)
    x = np.random.default_rng(1).normal(size=(400, 12))
    index = neighbours.build_index(frame(spark, x), "id", "v", 3, False, 20)
    visiting = neighbours.visits(index, index.points, None, 3, [])
    assert index.groups.max() > 5 and visiting.select(F.max(F.size("groups"))).first()[0] <= index.groups.max() + 2
    found = neighbours.point_neighbours(index, 3)
    folder = index.folder.removeprefix("file:")
    rows = [r for f in parts(folder) for r in pq.ParquetFile(f).read()["rid"].to_pylist()]
    assert sorted(rows) == list(range(400)) and len(parts(folder)) > 5
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "FlatMapCoGroups" not in plan  # the search has been written
    first = {(r["rid"], r["nid"]): r["dist"] for r in found.collect()}
    again = {(r["rid"], r["nid"]): r["dist"] for r in neighbours.point_neighbours(index, 3, index.points.select("rid", "v")).where("dist > 0").collect()}
    d = neighbours.distances(x, x, exact=True)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert first == {(i, j): d[i, j] for i in range(400) for j in near[i]}
    assert again.items() <= first.items() and index.folder.removeprefix("file:") == folder


def test_lots_hold_all_queries():
    """A group with many queries is parted, groups with few share a lot."""
    index = neighbours.Index(None, None, None, np.arange(5.0)[:, None], [], np.zeros(5), np.zeros(5), np.array([9000, 9000, 9000, 9000, 9000]), False)
    first, several, n = neighbours.lots_of(index, {0: 20_000, 1: 10, 2: 20, 4: 8000}, 1)
    assert n == 5 and several[index.groups[0]] == 3 and first[index.groups[1]] == first[index.groups[2]] != first[index.groups[4]]
    assert len({first[index.groups[c]] for c in (0, 1, 4)}) == 3


def test_text_ids_and_ties(spark):
    """Equally near points come in order of their ids, also when these are texts."""
    df = spark.createDataFrame([(n, [float(a), 0.0]) for n, a in (("b", 1), ("a", -1), ("c", 0), ("é", 3), ("z", -3))], "id string, v array<double>")
    got = {(r["src"], r["rank"]): (r["dst"], r["dist"]) for r in neighbours.nearest_neighbours(df, 3, "id", "v", "euclidean", 1).collect()}
    assert [got["c", i] for i in (1, 2, 3)] == [("a", 1.0), ("b", 1.0), ("z", 3.0)] and len(got) == 15


def test_a_spanning_tree_does_not_write_vectors_in_rounds(spark):
    """vectors are written with the index and its blocks only, and tables of a round go with it."""
    x = np.random.default_rng(2).normal(size=(200, 4)) + 6 * np.arange(4)[:, None].repeat(50, 0)
    index = neighbours.build_index(frame(spark, x), "id", "v", 4, False, 16)
    near = cut(neighbours.point_neighbours(index, 4))
    core = cut(density.core_distances(index, near, 4, 3))
    before = folders(spark)
    tree = density.spanning_tree(index, near, core)
    left = folders(spark) - before
    assert tree.count() == 199
    assert not [f for f in left if parts(f) and "list" in str(pq.ParquetFile(parts(f)[0]).schema_arrow)]


def test_products_are_written_and_go(spark, monkeypatch):
    """with a small bound every product is written, the axes stay the same, and only the last tables are left."""
    x = np.random.default_rng(3).normal(size=(60, 3))
    graph = cut(layout.fuzzy_union(layout.local_scaling(neighbours.nearest_neighbours(frame(spark, x), 5, "id", "v"), 5)))
    before = folders(spark)
    wide = layout.spectral_coordinates(graph, 2, degree=4)
    assert len(folders(spark) - before) == 1
    monkeypatch.setattr(layout, "SHUFFLED", 1)
    narrow = layout.spectral_coordinates(graph, 2, degree=4)
    assert len(folders(spark) - before) == 2 and narrow.products == wide.products
    a, b = ({r["id"]: (r["c0"], r["c1"]) for r in s.axes.collect()} for s in (wide, narrow))
    assert a.keys() == b.keys() and np.allclose([a[i] for i in a], [b[i] for i in a], atol=1e-6)


def test_rounds_in_parts_give_the_same_lists(spark):
    """a round whose vectors do not fit is done in parts, with the lists that it would have had; its tables go."""
    x = np.random.default_rng(4).normal(size=(300, 10))
    df, k = frame(spark, x), 3
    whole = approximate.approximate_neighbours(df, k, "id", "v", "euclidean", tables=2, bucket=20, largest=40)
    before = folders(spark)
    size = 300 * (2 * approximate.BREADTH * k + 1) * (80 + 12 * approximate.BREADTH * k)
    parted = approximate.approximate_neighbours(df, k, "id", "v", "euclidean", tables=2, bucket=20, largest=40, sent=size // 3)
    assert len(folders(spark) - before) == 3  # rows, points and the last lists
    pick = lambda a: {(r["src"], r["rank"]): (r["dst"], r["dist"]) for r in a.neighbours.collect()}
    assert pick(whole) == pick(parted) and whole.rounds == parted.rounds
