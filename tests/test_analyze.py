"""The whole analysis on a small table."""

from conftest import SMALL
from pyspark.sql import functions as F

from lexatlas import AnalysisSpec, Control, Outcome
from lexatlas.plans.analyze import analyze
from lexatlas.plans.frames import docs
from lexatlas.plans.stages import Stages


def test_analyze(spark, tmp_path):
    d = docs(spark, SMALL).withColumnRenamed("id", "essay")
    spec = AnalysisSpec(
        id="essay", outcomes=(Outcome("sentence_count"), Outcome("text_length")), controls=(Control("n_words"),), n_components=4, dimensions=2,
        sample_size=90, min_cluster_size=5, min_samples=2, selection_methods=("ridge",), primary_method="gbt", n_top=2,
    )
    held = Stages(spark, str(tmp_path / "stages"))
    a = analyze(d, spec, dim=16, stages=held)
    assert len(held.made) == 8 and held.taken == []
    t = a.tables
    assert a.notes == [] and a.chosen["primary_method"] == "ridge" and len(a.chosen["primary_components"]) == 2
    assert t["assignments"].count() == 90 and t["points"].count() == 90
    p = t["points"].first()
    assert p["z"] == 0.0 and len(p["all_pc_values"]) == 4 and 1 <= len(p["pc_info"]) <= 2 and p["category"]
    assert {r["variant"] for r in t["dml_summary"].select("variant").distinct().collect()} == {"naive", "vectors", "components", "top_ridge"}
    assert t["dml_rows"].count() == 90 * 3 * 2
    assert t["id_mapping"].where("in_sample").count() == 90 and t["id_mapping"].count() == 200
    assert t["category_counts"].agg(F.sum("n")).first()[0] == 90
    assert a.scorer.score(d.withColumnRenamed("essay", "id").select("id", "text", "sentence_count", "text_length")).count() == 200
    again = Stages(spark, held.path)
    b = analyze(d, spec, dim=16, stages=again)
    assert again.made == [] and again.taken == held.made
    assert sorted(map(tuple, b.tables["assignments"].collect())) == sorted(map(tuple, t["assignments"].collect()))
    new = d.withColumnRenamed("essay", "id").select("id", "text", "sentence_count", "text_length")
    scores = [{r["id"]: (r["topic_id"], r["category"]) for r in x.scorer.score(new).collect()} for x in (a, b)]
    assert scores[0] == scores[1] and len(scores[0]) == 200
    assert a.map.place(t["embeddings"].limit(5)).count() == 5
