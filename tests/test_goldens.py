"""Hand-worked results on the micro-table."""

import math

import pytest
from pyspark.sql import functions as F

from lexatlas.functions.scalars import id_hash
from lexatlas.functions.tails import t_quantile, two_sided_p
from lexatlas.operators import categories as cat, causal, clusters, effects, outcomes as out, ranking
from lexatlas.spec import Outcome

Y, X = Outcome("y"), Outcome("x")


def column(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_outcome_stats(micro):
    r = out.numeric_stats(micro, ["y"]).first()
    assert r["median"] == 4.5 and r["std"] == pytest.approx(2.449490, abs=1e-6)
    assert [r[p] for p in ("p10", "p25", "p50", "p75", "p90")] == pytest.approx([1.7, 2.75, 4.5, 6.25, 7.3])


def test_mode(micro):
    modes = column(out.outcome_modes(micro, (Y, X)), "outcome", "mode")
    assert modes == {"y": "continuous", "x": "zero_presence"}
    given = out.outcome_modes(micro, (Outcome("x", mode="continuous"),)).first()
    assert given["mode"] == "continuous" and given["many_zeros"] and not given["detected"]


def test_thresholds(micro):
    t = {r["outcome"]: r for r in out.thresholds(micro, (Y, X)).collect()}
    assert (t["y"]["low"], t["y"]["high"]) == (2.75, 6.25) and (t["x"]["low"], t["x"]["high"]) == (0.0, 2.25)
    p = out.thresholds(micro, (X.with_mode("zero_presence"),)).first()
    assert (p["low"], p["high"], p["zero_count"], p["non_zero_count"]) == (0.0, 1.0, 4, 4)
    zeros = out.thresholds(micro.withColumn("x", F.lit(0.0)), (X.with_mode("zero_presence"),)).first()
    assert zeros["high"] == 1.0


def test_categories(micro):
    c = column(cat.with_category(micro, (Y, X), out.thresholds(micro, (Y, X))), "id", "category")
    assert c[8] == "both_high" and set(c[i] for i in range(1, 8)) == {"middle"}
    pair = (Y.with_mode("zero_presence"), X.with_mode("zero_presence"))
    rows = cat.with_category(micro, pair, out.thresholds(micro, pair))
    assert {i for i, v in column(rows, "id", "category").items() if v == "both_present"} == {3, 5, 6, 8}
    assert {i for i, v in column(rows, "id", "agreement").items() if v} == {3, 5, 6, 8}
    assert column(cat.category_counts(rows), "category", "n") == {"first_present": 4, "both_present": 4, "agreement": 4, "disagreement": 4}


def test_topics(micro):
    s = {r["cluster_id"]: r for r in clusters.outcome_stats(micro, ["y"]).collect()}
    assert set(s) == {0, 1} and s[0]["n"] == 4 and s[0]["std"] == pytest.approx(1.290994, abs=1e-6) and s[1]["median"] == 6
    e = {r["cluster_id"]: r for r in clusters.topic_extremes(micro, ["y"]).collect()}
    assert (e[0]["p10"], e[0]["p90"]) == pytest.approx((1.3, 3.7)) and e[0]["prob_high"] == 0.25
    assert e[1]["prob_low"] == pytest.approx(1 / 3)
    p = {r["cluster_id"]: r for r in clusters.topic_presence(micro, ["x"]).collect()}
    assert (p[0]["presence_rate"], p[0]["outside_rate"]) == (0.25, 0.75) and p[0]["relative_risk"] == pytest.approx(1 / 3)
    assert p[1]["relative_risk"] == pytest.approx(5 / 3) and p[1]["magnitude"] == 2.5


def test_welch(micro):
    a = effects.topic_associations(micro.withColumn("f", F.array("y")), "f")
    t = column(a, "topic_id", "t_statistic")
    assert t[0] == pytest.approx(-4.381780, abs=1e-6) and t[1] == pytest.approx(1.792176, abs=1e-6)
    assert column(a, "topic_id", "rank") == {1: 1, 0: 2}


def test_percentiles(micro):
    long = micro.select("id", F.lit(0).alias("pc"), F.col("x").alias("value"))
    left = column(ranking.percentile_ranks(long), "id", "pct")
    assert [left[i] for i in range(1, 9)] == [0, 0, 50, 0, 62.5, 75, 0, 87.5]
    avg = column(ranking.percentile_ranks(long, method="average"), "id", "pct")
    assert [avg[i] for i in range(1, 9)] == [31.25, 31.25, 62.5, 31.25, 75, 87.5, 31.25, 100]


def test_lookups(micro):
    r = ranking.floor_percentile(micro, [], "y", {"a": 25, "b": 75, "c": 100}).first()
    assert (r["a"], r["b"], r["c"]) == (3.0, 7.0, None)
    assert ranking.value_percentile(micro, "y", {"v": 3}).first()["v"] == 25
    assert ranking.value_percentile(micro, "y", {"v": 0}).first()["v"] == 0


def test_deciles(micro):
    assert ranking.decile_edges(micro, "x").first()[0] == pytest.approx([0, 0.5, 1.2, 1.9, 2.6, 3.3, 4])
    bins = column(ranking.decile_bins(micro, "x"), "id", "bin")
    assert [bins[i] for i in range(1, 9)] == [0, 0, 1, 0, 3, 4, 0, 5]


def test_naive(micro):
    r = causal.naive_ols(micro, [("x", "y")]).first()
    assert r["theta"] == pytest.approx(1.028571, abs=1e-6) and r["se"] == pytest.approx(0.472941, abs=1e-6)
    assert r["correlation"] == pytest.approx(0.663940, abs=1e-6) and r["r2"] == pytest.approx(0.440816, abs=1e-6)
    assert r["ci_upper"] - r["theta"] == pytest.approx(t_quantile(6) * r["se"])


def test_theta(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (-1.0, -1.0), (2.0, 3.0), (-2.0, -5.0)], "resid_treatment double, resid_outcome double")
    rows = rows.withColumns({"pred_treatment": F.col("resid_treatment"), "pred_outcome": F.lit(1.0)})
    r = causal.estimate(rows, keys=()).first()
    assert r["theta"] == pytest.approx(1.9) and r["se"] == pytest.approx(0.269258, abs=1e-6)


def test_hash(spark):
    h = [r[0] for r in spark.range(3).select(id_hash("id", 42)).collect()]
    assert h == [399303206524389173, 801197843346488537, 993560441192973433]


@pytest.mark.parametrize(
    "t, df, p",  # tabulated two-sided points
    [(12.706205, 1, 0.05), (2.776445, 4, 0.05), (2.228139, 10, 0.05), (2.042272, 30, 0.05), (2.763769, 10, 0.02), (0.0, 7, 1.0), (1.0, 1, 0.5)],
)
def test_tails(t, df, p):
    assert two_sided_p(t, df)[0] == pytest.approx(p, abs=1e-6)


def test_tail_edges():
    assert math.isnan(two_sided_p(1.0, 0)[0]) and two_sided_p(float("inf"), 5)[0] == 0.0
    assert two_sided_p(1.959964, 1e7)[0] == pytest.approx(0.05, abs=1e-5)
