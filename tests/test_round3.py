"""Cluster trees, approximate neighbours and places of new documents against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas.operators import approximate, cluster_tree, encode, gram, neighbours, placement, ranking, reduce
from lexatlas.plans.stages import Stages

EPS = 1e-10


def frame(spark, x, ids=None):
    rows = [(int(i) if ids is None else ids[i], [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def labels_by_hand(members, formed, links):
    """Merge the seeds link by link, add up the excess of mass over the nodes, choose from the leaves up."""
    seeds = sorted(formed)
    n = len(seeds)
    low = [formed[s] for s in seeds] + [None] * len(links)
    parent, high, kids = [None] * (n + len(links)), [np.inf] * (n + len(links)), [()] * (n + len(links))
    group = {s: i for i, s in enumerate(seeds)}
    top = {i: [i] for i in range(n)}
    for e, (a, b, w) in enumerate(sorted(links, key=lambda r: r[2])):
        x, y, new = group[a], group[b], n + e
        for v in (x, y):
            parent[v], high[v] = new, w
        low[new], kids[new] = w, (x, y)
        top[new] = top.pop(x) + top.pop(y)
        for leaf in top[new]:
            group[seeds[leaf]] = new
    at, mass, rows = {}, np.zeros(len(low)), np.zeros(len(low))
    for rid, m, seed, w in members:
        v = seeds.index(seed)
        while parent[v] is not None and w >= high[v]:
            v = parent[v]
        at[rid] = v
        mass[v] += m / max(w, EPS)
        rows[v] += m
    size, best, chosen = rows.copy(), np.zeros(len(low)), [False] * len(low)
    for v in range(len(low)):
        born = 0.0 if np.isinf(high[v]) else 1 / max(high[v], EPS)
        s, below = mass[v] - rows[v] * born, sum(best[c] for c in kids[v])
        inner = sum(size[c] for c in kids[v])
        size[v] += inner
        s += inner * (1 / max(low[v], EPS) - born) if kids[v] else 0.0
        chosen[v] = parent[v] is not None and not below > s
        best[v] = max(below, s)
    out = {}
    for v in reversed(range(len(low))):
        up = out.get(parent[v])
        out[v] = up if up is not None else v if chosen[v] else None
    picked = sorted({v for v in out.values() if v is not None}, key=lambda v: (-size[v], v))
    number = {v: i for i, v in enumerate(picked)}
    return {rid: number.get(out[v], -1) for rid, v in at.items()}


def case(rng, shape, n):
    formed = {int(s): float(rng.uniform(0.01, 0.1)) for s in rng.permutation(1000)[:n]}
    seeds = list(formed)
    if shape == "chain":  # every link joins one more seed to all before: as deep as there are seeds
        pairs = [(seeds[i], seeds[i + 1]) for i in range(n - 1)]
        w = np.sort(rng.uniform(0.2, 1, n - 1))
    else:
        pairs = [(seeds[rng.integers(0, i)], seeds[i]) for i in range(1, n)]
        w = rng.uniform(0.2, 1, n - 1)
    links = [(a, b, float(x)) for (a, b), x in zip(pairs, w)]
    members, rid = [], 0
    for s in seeds:
        for _ in range(rng.integers(3, 9)):
            members.append((rid, int(rng.integers(1, 4)), s, float(rng.uniform(0.05, 0.25) if rng.random() < 0.8 else rng.uniform(0.3, 1.1))))
            rid += 1
    return members, formed, links


@pytest.mark.parametrize("shape,n,in_task", [("tree", 14, 1), ("chain", 10, 2), ("tree", 30, 1000), ("tree", 2, 1)])
def test_cluster_tree(spark, shape, n, in_task):
    members, formed, links = case(np.random.default_rng(n), shape, n)
    made = cluster_tree.cluster_labels(
        spark.createDataFrame(members, "rid long, m long, seed long, w double"),
        spark.createDataFrame(list(formed.items()), "seed long, w double"),
        spark.createDataFrame([(a, b, w, min(a, b), max(a, b)) for a, b, w in links], "a long, b long, w double, lo long, hi long"),
        in_task,
    )
    got, want = {r["rid"]: r["cluster_id"] for r in made.collect()}, labels_by_hand(members, formed, links)
    assert got == want and (n == 2 or len(set(want.values())) > 2)


def test_forest_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, int(rng.integers(0, i)), i) for i in range(1, 60) if i % 9] + [(100 + i, 1000 + i, 1001 + i) for i in range(12)]
    head = {}

    def find(v):
        while head.setdefault(v, v) != v:
            v = head[v]
        return v

    for _, x, y in edges:
        head[find(x)] = find(y)
    got = {r["node"]: r["root"] for r in cluster_tree.forest_components(spark.createDataFrame(edges, "e long, x long, y long")).collect()}
    assert set(got) == {v for _, x, y in edges for v in (x, y)}
    assert {frozenset(a for a in got if got[a] == r) for r in set(got.values())} == {frozenset(a for a in got if find(a) == r) for r in {find(v) for v in got}}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_approximate_neighbours(spark, metric):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 24)) + 4 * rng.normal(size=(10, 24))[rng.integers(0, 10, 400)]
    x[100:240] = x[3]  # more than a third are copies of one row
    x[300:303] = 0.0
    df = frame(spark, x)
    made = approximate.approximate_neighbours(df, 5, "id", "v", metric, tables=4, bucket=20, largest=40)
    exact = neighbours.nearest_neighbours(df, 5, "id", "v", metric, 64)
    assert approximate.recall(made.neighbours, exact).first()["recall"] >= 0.95
    got = made.neighbours.collect()
    assert len(got) == 400 * 5 and all(r["src"] != r["dst"] for r in got) and len({(r["src"], r["dst"]) for r in got}) == 2000
    unit = np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), 0)
    for r in got:
        a, b = r["src"], r["dst"]
        both_zero = not unit[a].any() and not unit[b].any()
        true = (0.0 if both_zero else 1 - unit[a] @ unit[b]) if metric == "cosine" else np.linalg.norm(x[a] - x[b])
        assert r["dist"] == pytest.approx(true, abs=1e-7)
    assert made.rounds_table().count() == len(made.rounds)
    with pytest.raises(ValueError):
        approximate.approximate_neighbours(df.limit(0), 5, "id", "v")


def test_new_coordinates(spark, tmp_path):
    rng = np.random.default_rng(10)
    x, places = rng.normal(size=(120, 6)), rng.uniform(-1, 1, (120, 2))
    known = spark.createDataFrame([(i, [float(v) for v in x[i]], float(places[i, 0]), float(places[i, 1])) for i in range(90)], "id long, pc array<double>, x double, y double")
    new = frame(spark, x).withColumnRenamed("v", "pc")
    repeated = new.unionByName(new.where("id = 95")).unionByName(spark.createDataFrame([(500, None)], "id long, pc array<double>"))
    got = placement.new_coordinates(known, repeated, "pc", ("x", "y"), 4, block=20).collect()
    assert len(got) == 121
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in got:
        d = 1 - unit[:90] @ unit[r["id"]]
        near = np.argsort(d, kind="stable")[:4]
        w = np.exp(-(d[near] - d[near].min()) / (d[near].mean() - d[near].min())) if r["id"] >= 90 else (near == r["id"]).astype(float)
        assert [r["x"], r["y"]] == pytest.approx(list(w @ places[near] / w.sum()), abs=1e-9)
    fitted = reduce.fit_reduction(new, "pc")
    scored = fitted.transform(known.select("id", F.col("pc").alias("embedding")), "embedding").select("id", "pc").join(known.select("id", "x", "y"), "id")
    drawn = placement.DocumentMap(fitted, scored, ("x", "y"), 4)
    drawn.save(spark, str(tmp_path / "map"))
    again = placement.DocumentMap.load(spark, str(tmp_path / "map"))
    rows = new.withColumnRenamed("pc", "embedding").where("id % 10 = 0")
    first = sorted(map(tuple, drawn.place(rows).collect()))
    second = sorted(map(tuple, again.place(rows).collect()))
    assert len(first) == 12 and all(a == pytest.approx(b) for a, b in zip(first, second))
    assert all([a, b] == pytest.approx(list(places[i])) for i, a, b in first if i < 90)


def test_bracketed_quantiles(spark, monkeypatch):
    """Positions are exact in large and small groups, with ties, a value of a third of the rows, and infinite and equal values."""
    rng = np.random.default_rng(11)
    g = np.concatenate([np.zeros(20000), np.ones(7000), np.full(40, 2), np.full(1, 3), np.full(5000, 4)]).astype(int)
    v = np.concatenate([np.where(rng.random(20000) < 0.34, 1.5, rng.normal(size=20000)), rng.integers(0, 50, 7000), rng.normal(size=40), [7.0], np.full(5000, 2.0)]).astype(float)
    v[20000] = np.inf
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)] + [(0, None), (9, None)], "g long, v double").repartition(7)
    probs = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.9, "f": 1.0, "h": 0.1001}
    ranks, brackets = ranking.bracketed_ranks(df, ["g"], "v", list(probs.values()))
    assert ranks.where("g = 0").count() < 2000 and brackets.count() == 5
    with np.errstate(invalid="ignore"):
        for r in ranking.quantiles(df, ["g"], "v", probs).collect():
            x = v[g == r["g"]]
            assert [r[k] for k in probs if k != "f" or r["g"] != 1] == pytest.approx([np.quantile(x, p) for k, p in probs.items() if k != "f" or r["g"] != 1])
    one = ranking.quantiles(df.where("g = 0"), [], "v", probs).first()
    assert [one[k] for k in probs] == pytest.approx([np.quantile(v[g == 0], p) for p in probs.values()])
    # Where the rows inside the brackets would not fit a task, they are ranked in ranges.
    monkeypatch.setattr(ranking, "HOT_GROUP", 1)
    assert ranking.quantiles(df.where("g = 0"), [], "v", probs).first() == one
    monkeypatch.undo()
    for r in ranking.floor_percentile(df, ["g"], "v", {"x": 10, "y": 50, "z": 100}).collect():
        x = np.sort(v[g == r["g"]])
        assert (r["x"], r["y"], r["z"]) == (x[int(len(x) * 10 / 100)], x[int(len(x) * 50 / 100)], None)
    assert ranking.quantiles(df.where("g = 77"), [], "v", probs).first()["a"] is None and ranking.quantiles(df.where("g = 77"), ["g"], "v", probs).count() == 0


def test_stages(spark, tmp_path):
    """A stage that broke off is made again; a changed input or option changes what follows, and nothing else."""
    df = spark.range(20).withColumn("v", F.col("id") * 2)

    def run(data, option=1, fail=False):
        held = Stages(spark, str(tmp_path / "s"))
        a, ka = held.table("a", [held.name_input(data)], {}, lambda: data.where("id > 3"))
        b, _ = held.table("b", [ka], {"o": option}, lambda: a.withColumn("w", F.raise_error(F.lit("broken")) if fail else F.col("v") + option))
        return held, b

    with pytest.raises(Exception):
        run(df, fail=True)[1].collect()
    held, b = run(df)
    assert (held.made, held.taken) == (["b"], ["a"]) and b.agg(F.sum("w")).first()[0] == sum(2 * i + 1 for i in range(4, 20))
    assert run(df.repartition(3))[0].made == [] and run(df, option=2)[0].made == ["b"] and run(df.where("id <> 7"))[0].made == ["a", "b"]
    plain = Stages(spark)
    assert plain.name_input(df) == "" and plain.table("a", [""], {}, lambda: df)[0].count() == 20 and plain.made == ["a"]


def test_lasso_is_proven(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(200, 9))
    x[:, 8] = x[:, 0]  # two equal columns and one constant
    x[:, 7] = 0.0
    y = x[:, 0] * 2 - x[:, 3] + rng.normal(size=200)
    xx, xy, yy = x.T @ x, x.T @ y, y @ y
    for alpha in (0.01, 0.3, 10.0):
        b, gap = gram.lasso_fit(xx, xy, 200, alpha, yy)
        grad = (xy - xx @ b) / 200
        assert 0 <= gap <= 1e-10 * yy / 400 and np.abs(grad).max() <= alpha + 1e-4
        assert grad[b != 0] == pytest.approx(alpha * np.sign(b[b != 0]), abs=1e-4)
        value = lambda v: ((y - x @ v) ** 2).sum() / 400 + alpha * np.abs(v).sum()
        assert all(value(b) <= value(b + rng.normal(size=9) * 10.0**-k) + gap for k in range(1, 6))
    with pytest.raises(gram.NotSettled):
        gram.lasso_fit(xx, xy, 200, 0.01, yy, max_sweeps=1)


def test_equal_texts_are_encoded_once(spark):
    texts = ["a b", "a b", None, "", "", "c " * 500, "a b"] + [f"w{i} x" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "a b"), (0, "again")], "id long, text string")
    seen = spark.sparkContext.accumulator(0)

    def load():
        inner = encode.hashing_encoder(8)()

        def run(batch):
            seen.add(len(batch))
            return inner(batch)

        return run

    got = encode.embed_distinct(df, 8, load, prefix="p: ").collect()
    assert seen.value == len({t for t in texts if t is not None} | {"again"})
    key = lambda rows: sorted((str(r["id"]), tuple(r["embedding"]), r["embed_ok"]) for r in rows)
    assert key(got) == key(encode.embed(df, 8, prefix="p: ").collect()) and len(got) == len(texts) - 1 + 2
    assert encode.embed_distinct(df.limit(0), 8).count() == 0
