"""Empty, constant, missing and odd input; sources, sinks, streams, encoder."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lexatlas.operators import categories as cat, causal, cleaning, clusters, effects, encode, outcomes as out, points as pts, profiling, ranking, reduce, topics, vectors
from lexatlas.plans.frames import docs
from lexatlas.sources import readers, sinks
from lexatlas.spec import AnalysisSpec, Control, Outcome
from lexatlas.streaming import scoring


def test_spec_is_checked():
    with pytest.raises(ValueError):
        Outcome("a", type="odd")
    with pytest.raises(ValueError):
        Outcome("a", type="categorical")
    with pytest.raises(ValueError):
        Outcome("a", mode="odd")
    with pytest.raises(ValueError):
        AnalysisSpec(dimensions=4)
    assert Outcome("human_sum_score").display == "Human Sum Score" and Control("num_raters").display == "Num Raters"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id long, text string, y double, x double, cluster_id int")
    assert out.numeric_stats(empty, ["y"]).count() == 0
    assert ranking.quantiles(empty, ["cluster_id"], "y", {"m": 0.5}).count() == 0
    assert topics.extract_topics(empty).count() == 0
    assert clusters.topic_presence(empty, ["y"]).count() == 0
    assert causal.naive_ols(empty, [("x", "y")]).first()["theta"] is None
    with pytest.raises(ValueError):
        reduce.fit_reduction(empty.withColumn("v", F.array("y")), "v")


def test_imputation(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, None, "a"), (3, 4.0, None), (4, float("nan"), None)], "id long, y double, c string")
    r = {x["id"]: x for x in cleaning.impute_mode(cleaning.impute_median(df, ["y"]), ["c"]).collect()}
    assert r[2]["y"] == 2.5 and r[4]["y"] == 2.5 and r[3]["c"] == "a"  # the smaller of two equally frequent
    nothing = spark.createDataFrame([(1, None, None)], "id long, y double, c string")
    r = cleaning.impute_mode(cleaning.impute_median(nothing, ["y"]), ["c"]).first()
    assert r["y"] is None and r["c"] == "Unknown"
    with pytest.raises(ValueError):
        out.assert_complete(nothing, ["y"])


def test_constant_columns(spark):
    df = spark.range(20).select("id", F.lit(3.0).alias("y"), F.lit(0.0).alias("x"), F.lit(0).alias("cluster_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    assert ranking.decile_edges(df, "y").first()[0] == [3.0]
    assert {r["bin"] for r in ranking.decile_bins(df, "y").collect()} == {0}
    assert causal.naive_ols(df, [("x", "y")]).first()["theta"] is None
    assert {r["corr"] for r in effects.pc_correlations(df, ["y"], "v").collect()} <= {None}
    a = effects.topic_associations(df, "v").collect()
    assert all(r["t_statistic"] is None and r["p_value"] is None and r["non_topic_mean"] is None for r in a)
    p = clusters.topic_presence(df, ["y"]).first()
    assert p["outside_rate"] == 0.0 and p["relative_risk"] is None


def test_one_member_topic(micro):
    one = micro.withColumn("cluster_id", F.when(F.col("id") == 1, 5).otherwise(0)).withColumn("v", F.array("y"))
    r = {x["topic_id"]: x for x in effects.topic_associations(one, "v").collect()}
    assert r[5]["size"] == 1 and r[5]["t_statistic"] is None


def test_duplicate_ids_are_rejected(spark):
    with pytest.raises(ValueError):
        cleaning.assert_unique_ids(spark.createDataFrame([(1,), (1,)], "id long"), "id")
    with pytest.raises(ValueError):
        cleaning.assert_unique_ids(spark.createDataFrame([(None,), (1,)], "id long"), "id")
    cleaning.assert_unique_ids(spark.createDataFrame([("a",), ("b",)], "id string"), "id")


def test_required_columns(micro):
    with pytest.raises(ValueError, match="text"):
        cleaning.require_columns(micro, "text", (Outcome("y"),))
    cleaning.require_columns(micro.withColumn("text", F.lit("")), "text", (Outcome("y"), Outcome("text_length")), "id")


def test_vector_checks(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None), (9, [3.0, 4.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    r = vectors.vector_check(v).first()
    assert (r["n_vectors"], r["n_broken"], r["n_zero"], r["n_nonzero"], r["valid"]) == (5, 2, 1, 2, False)
    assert r["mean_norm"] == pytest.approx(2.0)
    c = vectors.id_coverage(spark.createDataFrame([(1,), (5,)], "id long"), v).first()
    assert (c["n_matched"], c["n_missing_vectors"], c["n_orphan_vectors"]) == (1, 1, 4)
    n = {x["id"]: x["n"] for x in v.where("id in (2, 9)").select("id", vectors.l2_normalised("embedding").alias("n")).collect()}
    assert n[2] is None and n[9] == [0.6, 0.8]


def test_topic_words(spark):
    rows = [(0, "Visit http://a.b/c now! Solar power, solar panels."), (0, "solar power"), (1, "Wind power and wind turbines at www.x.y"), (-1, "noise solar noise"), (2, "http://only.url"), (1, None)]
    df = spark.createDataFrame(rows, "cluster_id int, text string")
    counts = {(r["cluster_id"], r["term"]): r["tf"] for r in topics.term_counts(df).collect()}
    assert counts[0, "solar"] == 3 and counts[0, "solar power"] == 2 and (1, "and") not in counts
    assert counts[1, "power wind"] == 1  # neighbours once stop words are gone
    assert not any(k[0] == 2 for k in counts)
    kw = {r["cluster_id"]: r["keywords"] for r in topics.extract_topics(df).collect()}
    assert set(kw) == {0, 1} and kw[1].startswith("Wind") and len(kw[0].split(" - ")) <= 5
    one = topics.extract_topics(df.where("cluster_id = 0")).first()
    assert one["keywords"].startswith("Solar")  # a single class keeps its terms
    wide = topics.term_counts(spark.createDataFrame([(0, "für über")], "cluster_id int, text string"), keep="a-zà-ÿ").collect()
    assert {r["term"] for r in wide} == {"für", "über", "für über"}


def test_roles(spark):
    rows = [(f"k{i}", i, f"some longer text {i} " * 3, i * 0.5, i % 3, 2000 + i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, row_id long, body string, score double, level int, year int")
    roles = profiling.detect_roles(profiling.column_profile(df))
    found = {r["role"]: r["column"] for r in roles.collect() if r["role"]}
    assert found == {"text": "body", "id": "row_id"}
    picked = {r["column"]: r["role"] for r in profiling.detect_outcomes(roles).collect()}
    assert picked == {"score": "outcome", "level": "control", "year": "control"}
    sketch = profiling.detect_roles(profiling.column_profile(df, exact=False)).collect()
    assert {r["column"] for r in sketch if r["role"] == "text"} == {"body"}
    only = profiling.detect_outcomes(profiling.detect_roles(profiling.column_profile(df.select("body", "level", "year"))))
    assert {r["column"]: r["role"] for r in only.collect()} == {"level": "outcome", "year": "outcome"}


def test_suggestions(spark):
    p = spark.createDataFrame([(100, 64), (5000, 768), (200000, 64)], "n_samples long, n_features int")
    r = {x["n_samples"]: x for x in profiling.suggest_parameters(p, "few").collect()}
    assert [r[n]["min_cluster_size"] for n in (100, 5000, 200000)] == [50, 50, 200]
    assert [r[n]["min_samples"] for n in (100, 5000, 200000)] == [7, 7, 30]
    assert r[100]["tree_depth"] == 3 and r[200000]["dml_folds"] == 10 and r[5000]["batch_size"] == 32
    d = profiling.suggest_parameters(p, "descriptions").first()
    assert (d["min_cluster_size"], d["min_samples"], d["n_neighbors"]) == (10, 2, 5)
    with pytest.raises(ValueError):
        profiling.suggest_parameters(p, "odd")


def test_csv(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('id,text,y\n1,"two\nlines, ""quoted""",3\n2,plain,4\n')
    df = readers.read_documents(spark, str(f))
    assert readers.row_count(df) == 2 and readers.preview(df, 1).count() == 1
    assert df.where("id = 1").first()["text"] == 'two\nlines, "quoted"'
    typed = readers.read_documents(spark, str(f), "id string, text string, y double")
    assert typed.dtypes[2] == ("y", "double")


def test_wide_vectors(spark, tmp_path):
    f = tmp_path / "v.csv"
    f.write_text("id,emb_0,emb_1,emb_10\n1,0.5,1.5,2.5\n")
    with pytest.raises(Exception):
        readers.read_vectors(spark, str(f)).collect()  # a gap in the columns
    f.write_text("id,emb_0,emb_1\n1,0.5,1.5\n")
    assert readers.read_vectors(spark, str(f)).first()["embedding"] == [0.5, 1.5]


def test_encoder_failures(spark):
    def load():
        def fails_on_bad(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("out of memory")
            return np.ones((len(texts), 4))

        return fails_on_bad

    df = spark.range(50).select("id", F.when(F.col("id") == 17, "bad").otherwise("fine").alias("text"))
    got = encode.embed(df, 4, load, batch=16)
    r = encode.failure_summary(got).first()
    assert (r["n"], r["n_failed"]) == (50, 1)
    bad = got.where("not embed_ok").first()
    assert bad["id"] == 17 and bad["embedding"] == [0.0] * 4
    a = encode.embed(df, 16).collect()
    assert a == encode.embed(df.repartition(3), 16).orderBy("id").collect()


def test_browse_order_is_local(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "c", *map(float, rng.uniform(-1, 1, 3))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, category string, x double, y double, z double")
    order = cat.browse_order(df)
    at = {r["id"]: r["browse_rank"] for r in order.collect()}
    assert sorted(at.values()) == list(range(1, 501))
    xyz = np.array([r[2:] for r in rows])
    seq = xyz[[i for i, _ in sorted(at.items(), key=lambda t: t[1])]]
    assert np.linalg.norm(np.diff(seq, axis=0), axis=1).mean() < 0.5 * np.linalg.norm(np.diff(xyz, axis=0), axis=1).mean()
    n = {r["id"]: r for r in cat.browse_neighbours(order).collect()}
    first = next(i for i, r in at.items() if r == 1)
    assert at[n[first]["previous_id"]] == 500 and at[n[first]["next_id"]] == 2


def test_state(spark, tmp_path):
    df = docs(spark, SMALL).select("id", "lang", "text_length")
    path = str(tmp_path / "state")
    sinks.save_state({"documents": df}, path, AnalysisSpec())
    tables, warnings = sinks.load_state(spark, path)
    assert tables["documents"].count() == 200 and warnings == []
    a = sinks.checksum(df).first()["checksum"]
    assert a == sinks.checksum(df.repartition(7).select("text_length", "id", "lang")).first()["checksum"]
    df.withColumn("text_length", F.col("text_length") + 1).write.mode("overwrite").parquet(f"{path}/tables/documents")
    with pytest.raises(ValueError):
        sinks.load_state(spark, path)
    assert sinks.load_state(spark, path, skip_validation=True)[0]["documents"].count() == 200


def test_export(spark, tmp_path):
    d = docs(spark, SMALL).select("id", "text", "lang").withColumn("s", F.struct(F.lit(1).alias("a"), F.array(F.lit(2)).alias("b")))
    broken = d.select(F.raise_error(F.lit("x")).cast("string").alias("x"))
    spec = AnalysisSpec(exclude_text=True, anonymize_ids=True)
    status = {r["table"]: r for r in sinks.export_tables({"points": d, "other": broken}, str(tmp_path / "e"), spec, "csv").collect()}
    assert status["points"]["ok"] and not status["other"]["ok"] and status["other"]["folder"] == "08_other"
    back = spark.read.option("header", True).csv(str(tmp_path / "e" / "07_points" / "points"))
    assert set(back.columns) == {"id", "lang", "s_a", "s_b"} and back.count() == 200
    assert len(back.first()["id"]) == 16


def test_flat_and_chosen(spark):
    df = spark.createDataFrame([(1, ((2, 3.0), 4))], "id int, r struct<a: struct<x: int, y: double>, b: int>")
    assert pts.flat(df).columns == ["id", "r_a_x", "r_a_y", "r_b"]
    assert pts.chosen_columns(pts.flat(df), ("r_a",), ("id",)).columns == ["id", "r_a_x", "r_a_y"]


def test_stream_scores_like_batch(spark, tmp_path):
    d = docs(spark, SMALL).select("id", "text", "sentence_count", "text_length")
    vec = encode.embed(d, 16)
    fitted = reduce.fit_reduction(vec, "embedding", 4)
    pair = (Outcome("sentence_count"), Outcome("text_length"))
    scored = fitted.transform(vec).withColumn("cluster_id", (F.col("id") % 3).cast("int"))
    scorer = scoring.fit_scorer(fitted, scored, out.thresholds(d, pair), pair, 16)
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = scoring.stream_documents(spark, str(tmp_path / "in"), d.schema)
    q = scoring.start(scorer, stream, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    cols = ["id", "topic_id", "category"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()))
    assert got == sorted(map(tuple, scorer.score(d).select(*cols).collect())) and len(got) == 200
    fitted.save(spark, str(tmp_path / "model"))
    again = reduce.Reduction.load(spark, str(tmp_path / "model"))
    assert np.array_equal(again.loadings, fitted.loadings) and np.array_equal(again.variance, fitted.variance)
