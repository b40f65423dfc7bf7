"""Results that must hold whatever the data: brute force, simulated truth, partitioning, skew."""

from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas.functions.scalars import id_hash
from lexatlas.operators import causal, cluster_tree, clusters, contributions as con, density, gram, importance as imp, layout, neighbours, ranking, reduce, sampling, vectors
from lexatlas.session import cut


def frame(spark, x, **cols):
    rows = [(i, [float(v) for v in r], *[float(c[i]) for c in cols.values()]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>" + "".join(f", {c} double" for c in cols))


# -- ranks and skew ---------------------------------------------------------------------------------


def heavy(spark, n=3000):
    """One value holds a third of the rows, one group two thirds."""
    i = F.col("id")
    v = F.when(i % 3 == 0, 0.0).otherwise((id_hash("id") % 997) / 7.0 - 50)
    return spark.range(n).select("id", F.when(i % 3 < 2, "a").otherwise(F.concat(F.lit("g"), (i % 7).cast("string"))).alias("g"), v.alias("value"))


def test_value_ranks_in_ranges(spark):
    df = heavy(spark)
    plain = sorted(map(tuple, ranking.value_ranks(df, ["g"], "value").collect()))
    for hot in (1, 50):
        assert sorted(map(tuple, ranking.value_ranks(df, ["g"], "value", hot=hot).collect())) == plain
    want = {}
    for g, v in [(r["g"], r["value"]) for r in df.collect()]:
        want.setdefault(g, []).append(v)
    for g, v, cnt, below, total in plain:
        a = np.array(want[g])
        assert (cnt, below, total) == ((a == v).sum(), (a < v).sum(), len(a))


def test_attach_spreads_hot_keys(spark):
    df = heavy(spark)
    ranks = ranking.value_ranks(df, [], "value")
    plain = {r["id"]: r["below"] for r in ranking.attach(df, ranks, ["value"], "id").collect()}
    salted = ranking.attach(df, ranks, ["value"], "id", per_task=10)
    assert {r["id"]: r["below"] for r in salted.collect()} == plain and len(plain) == 3000


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partitioning_does_not_matter(spark, parts):
    df = heavy(spark, 600).orderBy(F.rand(parts)).repartition(parts)
    q = ranking.quantiles(df, ["g"], "value", {"m": 0.5, "p": 0.9}).orderBy("g").collect()
    base = ranking.quantiles(heavy(spark, 600), ["g"], "value", {"m": 0.5, "p": 0.9}).orderBy("g").collect()
    assert q == base
    s = {r["id"] for r in sampling.stratified_sample(df, 77, "g").collect()}
    assert s == {r["id"] for r in sampling.stratified_sample(heavy(spark, 600), 77, "g").collect()} and len(s) == 77


def test_quantiles_match_numpy(spark):
    df = heavy(spark)
    x = np.array([r[0] for r in df.select("value").collect()])
    r = ranking.quantiles(df, [], "value", {"a": 0.1, "b": 0.37, "c": 0.9}).first()
    assert [r["a"], r["b"], r["c"]] == pytest.approx(list(np.quantile(x, [0.1, 0.37, 0.9])))


def test_samples_are_exact(spark):
    df = heavy(spark)
    assert sampling.uniform_sample(df, 500).count() == 500
    top = {r["id"] for r in sampling.uniform_sample(df, 500).collect()}
    ranked = {r["id"] for r in sampling.hash_positions(df, [], "id", 42).where("position <= 500").collect()}
    assert top == ranked
    assert sampling.stratified_sample(df, 10_000, "g").count() == 3000
    with_null = df.withColumn("g", F.when(F.col("g") != "a", F.col("g")))
    assert sampling.stratified_sample(with_null, 100, "g").where("g is null").count() == pytest.approx(67, abs=1)
    assert sampling.remainder(df, sampling.uniform_sample(df, 500)).count() == 2500


# -- vectors -------------------------------------------------------------------------------------------


def test_reduction(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 8)) + rng.normal(scale=1e-3, size=(200, 8))
    df = frame(spark, x)
    full = reduce.fit_reduction(df, "v", 200)
    assert full.k == 8 and full.variance.sum() == pytest.approx(1.0) and full.variance[:3].sum() > 0.9999
    assert full.loadings.T @ full.loadings == pytest.approx(np.eye(8), abs=1e-8)
    z = (x - x.mean(0)) / x.std(0)
    s = np.linalg.svd(z, compute_uv=False) ** 2
    assert full.variance == pytest.approx(s / s.sum(), abs=1e-8)
    got = np.array([r["pc"] for r in full.transform(df, "v").orderBy("id").collect()])
    assert got @ full.loadings.T == pytest.approx(z, abs=1e-6)


def test_scaling_is_invariant(spark):
    x = np.random.default_rng(2).normal(size=(50, 4))
    a = vectors.standardised(frame(spark, x), "v").orderBy("id").collect()
    b = vectors.standardised(frame(spark, x * 7 + 3), "v").orderBy("id").collect()
    assert np.array([r["scaled"] for r in a]) == pytest.approx(np.array([r["scaled"] for r in b]))
    flat = vectors.standardised(frame(spark, np.ones((5, 2))), "v").first()
    assert flat["scaled"] == [0.0, 0.0]


def brute(x, k, cosine):
    if cosine:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        u = x / np.where(n > 0, n, 1)
        d = 1 - u @ u.T
        zero = n[:, 0] == 0
        d[np.ix_(zero, zero)] = 0
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, 1)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("block", [2048, 24])
def test_neighbours_with_copies(spark, metric, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 5))
    x[40:100] = x[7]  # more than a third are copies of one row
    x[150:153] = 0.0
    got = neighbours.nearest_neighbours(frame(spark, x), 6, "id", "v", metric, block).collect()
    order, dist = brute(x, 6, metric == "cosine")
    assert len(got) == 160 * 6
    for r in got:
        assert r["dist"] == pytest.approx(dist[r["src"], r["rank"] - 1], abs=1e-8)
    same = sum(order[r["src"], r["rank"] - 1] == r["dst"] for r in got)
    assert same > 0.97 * len(got)  # ties at rounding distance may swap


def test_layout(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.1, size=(30, 6)) for c in np.eye(6)[:3] * 3])
    made = layout.layout(frame(spark, x), "v", "id", 2, 8)
    settled = made.convergence.collect()
    assert len(settled) == 2 and all(r["residual"] <= 1e-3 and r["eigenvalue"] > 0.99 for r in settled)  # three groups apart
    rows = made.points.orderBy("id").collect()
    c = np.array([[r["x"], r["y"]] for r in rows])
    assert len(c) == 90 and np.abs(c).max() == pytest.approx(1.0) and c.mean(0) == pytest.approx([0, 0], abs=1e-9)
    centres = np.array([c[i * 30 : i * 30 + 30].mean(0) for i in range(3)])
    inside = max(np.linalg.norm(c[i * 30 : i * 30 + 30] - centres[i], axis=1).mean() for i in range(3))
    between = min(np.linalg.norm(centres[i] - centres[j]) for i in range(3) for j in range(i))
    assert between > 3 * inside


def blobs():
    rng = np.random.default_rng(5)
    x = np.vstack([np.array(c) + rng.normal(0, 0.05, (30, 3)) for c in ([0, 0, 0], [1, 0, 0], [0, 1, 0])] + [rng.uniform(-0.5, 1.5, (6, 3))])
    return np.vstack([x, np.repeat(x[:1], 12, axis=0)]), np.r_[np.repeat([0, 1, 2], 30), -np.ones(6), np.zeros(12)]


def test_spanning_tree_and_clusters(spark):
    x, truth = blobs()
    df = frame(spark, x)
    index = neighbours.build_index(df, "id", "v", 6, False, 16)
    near = cut(neighbours.point_neighbours(index, 6))
    core = cut(density.core_distances(index, near, 6, 4))
    tree = density.spanning_tree(index, near, core)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    c = np.sort(d, 1)[:, 4]
    m = np.maximum(np.maximum(c[:, None], c[None]), d)
    inside, best, total = np.zeros(len(x), bool), m[0].copy(), 0.0
    inside[0] = True
    for _ in range(len(x) - 1):
        j = np.where(inside, np.inf, best).argmin()
        total += best[j]
        inside[j] = True
        best = np.minimum(best, m[j])
    assert tree.agg(F.sum("w")).first()[0] == pytest.approx(total)
    assert tree.count() == len(x) - 12 - 1
    sizes = index.copies.select("rid", "m").join(core.select("rid", "core"), "rid")
    found = {}
    for in_task in (1, 1000):
        out = cluster_tree.cluster_labels(*density.seeds(tree, sizes, 8), in_task)
        found[in_task] = {r["rid"]: r["cluster_id"] for r in index.rows.join(out, "rid").select(F.col("id").alias("rid"), "cluster_id").collect()}
    assert found[1] == found[1000]
    labels = found[1]
    for b in range(3):
        own = {labels.get(i, -1) for i in range(len(x)) if truth[i] == b}
        assert len(own - {-1}) == 1


def test_small_table_is_noise(spark):
    x, _ = blobs()
    got = density.density_clusters(frame(spark, x[:10]), "id", "v", 20, 3).collect()
    assert len(got) == 10 and {r["cluster_id"] for r in got} == {-1}


# -- estimation --------------------------------------------------------------------------------------------


def simulated(spark, n=2000, p=6):
    rng = np.random.default_rng(6)
    x, a, b = rng.normal(size=(n, p)), rng.normal(size=p), rng.normal(size=p)
    t = x @ a + rng.normal(size=n)
    y = 0.7 * t + x @ b + rng.normal(size=n)
    return frame(spark, x, t=t, y=y), x, t, y


def test_theta_is_recovered(spark):
    df, *_ = simulated(spark)
    fit = causal.double_ml(df, ["t", "y"], "v", n_features=6)
    r = fit["estimates"].first()
    assert abs(r["theta"] - 0.7) < 4 * r["se"] and r["p_value"] < 1e-6
    naive = causal.naive_ols(df, [("t", "y")]).first()
    assert abs(naive["theta"] - 0.7) > 4 * naive["se"]
    again = causal.estimate(fit["rows"].where("cv"))
    assert again.first()["theta"] == pytest.approx(r["theta"])
    assert causal.double_ml(df, ["t", "y"], "v", cross_fit=False, n_features=6)["estimates"].first()["cv"] is False
    r2 = {x["target"]: x for x in fit["r2"].collect()}
    assert len(r2["t"]["r2_folds"]) == 5 and r2["t"]["r2_full"] > r2["t"]["r2_cv"] - 1e-3


def test_gram_matches_numpy(spark):
    df, x, t, y = simulated(spark, 500)
    g = gram.gram(gram.with_model_columns(df, "id", "v", ["t", "y"], 4), ["t", "y"])
    z = np.column_stack([x, t, y])
    z = np.column_stack([np.ones(len(z)), z - z.mean(0)])
    assert g.total == pytest.approx(z.T @ z, abs=1e-6) and len(g.folds) == 4
    coef, inter = gram.ridge_fit(g.total, 6, g.target("y"), 0.0)
    assert coef == pytest.approx(np.linalg.lstsq(np.column_stack([np.ones(500), x]), y, rcond=None)[0][1:])
    assert inter == pytest.approx(0.0, abs=1e-9)


def test_lasso_conditions(spark):
    df, *_ = simulated(spark, 500)
    g = gram.gram(gram.with_model_columns(df, "id", "v", ["t", "y"], 4), ["t", "y"])
    b, alpha, gap = imp.lasso_path(g, "y", [0.5])
    assert 0 <= gap < 1e-9
    sd = gram.deviations(g.total, 6)
    n, _, _, sxx, sxy, _ = gram.centred(imp._scaled(g.total, 6, sd), 6, g.target("y"))
    grad = (sxy - sxx @ b) / n
    assert alpha == 0.5 and np.abs(grad).max() <= 0.5 + 1e-6
    on = np.abs(b) > 1e-9
    assert grad[on] == pytest.approx(0.5 * np.sign(b[on]), abs=1e-6) and 0 < on.sum() <= 6


def test_selection_finds_the_signal(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 6))
    df = frame(spark, x, t=2 * x[:, 1] + 0.1 * rng.normal(size=400), y=x[:, 1] - 3 * x[:, 4] + 0.1 * rng.normal(size=400))
    model = gram.with_model_columns(df, "id", "v", ["t", "y"], 4)
    parts = [imp.boosted(model, ["t", "y"], 3, 3), imp.binned_mi(model, ["t", "y"])]
    parts += [imp.regularised(model, ["t", "y"], m)[0] for m in ("lasso", "ridge")]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    top = imp.top_components(table, 2)
    for method in ("gbt", "mi", "lasso", "ridge"):
        assert set(imp.primary_components(top, method, ())[1]) == {1, 4}, method
    assert imp.primary_components(top, "absent", ("ridge", "mi"))[0] == "ridge"


def test_contributions_add_up(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    df, x, t, y = simulated(spark, 300)
    model = GBTRegressor(featuresCol="f", labelCol="y", maxIter=4, maxDepth=8, stepSize=0.3, seed=1).fit(df.select(array_to_vector("v").alias("f"), "y"))
    out, base = con.gbt_contributions(df, "y", model, "v")
    rows = model.transform(out.withColumn("f", array_to_vector("v"))).collect()
    for r in rows:
        assert sum(r["contrib_y"]) + base == pytest.approx(r["prediction"])
    lin = con.linear_contributions(df, ["y"], "v", alpha=0.0).orderBy("id").collect()
    b = np.linalg.lstsq(np.column_stack([np.ones(300), x]), y, rcond=None)[0]
    for i, r in enumerate(lin):
        assert sum(r["contrib_y"]) + y.mean() == pytest.approx(b[0] + x[i] @ b[1:])


def test_shapley_matches_definition():
    """One leaf of up to eight features: the average over all orders in which features become known."""
    rng = np.random.default_rng(14)
    for d in (1, 2, 3, 8):
        z, value = rng.uniform(0.1, 0.9, d), 8.0
        x = np.array([rng.integers(0, 2, d), np.ones(d), np.zeros(d)], dtype=float)
        got = con.shapley_of_rows(x, [(value, np.arange(d), np.full(d, 0.5), np.full(d, np.inf), z)])
        for row, g in zip(x, got):
            game = lambda known: value * np.prod([row[j] if known >> j & 1 else z[j] for j in range(d)])
            for i in range(d):
                gains = [(game(s | 1 << i) - game(s)) / (d * comb(d - 1, bin(s).count("1"))) for s in range(1 << d) if not s >> i & 1]
                assert g[i] == pytest.approx(sum(gains))


def test_mi_of_independent_and_equal(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1000, 2))
    r = {q["pc"]: q["importance"] for q in imp.binned_mi(frame(spark, x, y=x[:, 0]), ["y"], "v").collect()}
    assert r[0] == pytest.approx(np.log(10), abs=1e-6) and r[1] < 0.1


def test_extreme_group_scopes(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(100)], "id long, cluster_id int, y double")
    own = clusters.topic_extremes(df, ["y"]).collect()
    assert all(r["prob_high"] == pytest.approx(0.1, abs=0.02) for r in own)
    assert {round(r["prob_high"], 2) for r in clusters.topic_extremes(df, ["y"], scope="global").collect()} == {0.1}
