"""Queries over estimation: sums, naive and adjusted effects, importance, contributions."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from lexatlas.functions.scalars import fold_of
from lexatlas.operators import causal, contributions as con, gram, importance as imp, points as pts, ranking, trees
from lexatlas.operators.vectors import with_controls
from lexatlas.plans.catalog import query
from lexatlas.plans.frames import DOCS_SQL, LONG_SQL, POINTS_SQL, docs, final, hash_sql, measured, measured_points, points, rounded_sql, t_critical_sql, t_tail_sql
from lexatlas.session import shared_dir
from lexatlas.sources import sinks
from lexatlas.spec import AnalysisSpec

W = "WITH "
TWO = ["sentence_count", "text_length"]
PAIRS = [("sentence_count", "text_length")]
THREE = ["sentence_count", "text_length", "digit_count"]

_FOLDED = DOCS_SQL + f", f AS (SELECT *, ({hash_sql('id')} % 5)::INTEGER AS fold FROM docs)"


def _folded(spark, sf):
    return measured(spark, sf).withColumn("fold", fold_of("id", 5))


@query(
    "g0_fold_sums",
    W + _FOLDED + """ SELECT fold, count(*) AS n, sum(n_words) AS sum_n_words, sum(n_words * n_words) AS sum_n_words_n_words,
      sum(n_words * digit_count) AS sum_n_words_digit_count, sum(digit_count) AS sum_digit_count,
      sum(digit_count * digit_count) AS sum_digit_count_digit_count FROM f GROUP BY fold""",
)
def g0(spark, sf):
    return gram.gram_entries(_folded(spark, sf), ["n_words", "digit_count"])


@query(
    "g0_fold_gram",
    rounded_sql(
        "value",
        W + _FOLDED + """, v AS (SELECT fold, [n_words, digit_count, sentence_count, text_length] AS z FROM f),
          e AS (SELECT fold, i, j, z[i] AS a, z[j] AS b FROM v, range(1, 5) r1(i), range(1, 5) r2(j))
          SELECT fold, (i - 1)::INTEGER AS i, (j - 1)::INTEGER AS j, corr(a, b) AS value FROM e GROUP BY fold, i, j""",
    ),
)
def g0b(spark, sf):
    d = _folded(spark, sf).withColumn("features", F.array("n_words", "digit_count"))
    g = gram.gram(d, TWO)
    rows = []
    for fold, m in g.folds.items():
        cov = m[1:, 1:] / m[0, 0] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0] ** 2
        sd = np.sqrt(np.diag(cov))
        rows += [(int(fold), i, j, float(cov[i, j] / sd[i] / sd[j])) for i in range(4) for j in range(4)]
    return final(spark.createDataFrame(rows, "fold int, i int, j int, value double"))


@query(
    "d1_naive_ols",
    rounded_sql(
        "theta se correlation r2",
        W + DOCS_SQL + """, s AS (SELECT 'sentence_count' AS treatment, 'text_length' AS outcome, count(*) AS n, regr_slope(text_length, sentence_count) AS theta,
          regr_sxx(text_length, sentence_count) AS sxx, regr_syy(text_length, sentence_count) AS syy, corr(text_length, sentence_count) AS correlation FROM docs)
        SELECT treatment, outcome, n, theta, sqrt((syy - theta * theta * sxx) / (n - 2) / sxx) AS se, correlation, correlation ** 2 AS r2 FROM s""",
    ),
)
def d1(spark, sf):
    return final(causal.naive_ols(docs(spark, sf), PAIRS, inference=False))


def _naive(t: str, y: str) -> str:
    return f"""SELECT '{t}' AS treatment, '{y}' AS outcome, count(*) AS n, regr_slope({y}, {t}) AS theta, regr_sxx({y}, {t}) AS sxx,
      regr_syy({y}, {t}) AS syy, corr({y}, {t}) AS correlation FROM docs"""


@query(
    "d1_naive_inference",
    rounded_sql(
        "theta se correlation r2 t_stat p_value ci_lower ci_upper",
        W + DOCS_SQL + ", s AS (" + " UNION ALL ".join(_naive(t, y) for t, y in causal.ordered_pairs(THREE)) + f"""),
        e AS (SELECT *, sqrt((syy - theta * theta * sxx) / (n - 2) / sxx) AS se FROM s)
        SELECT treatment, outcome, n, theta, se, correlation, correlation ** 2 AS r2, theta / se AS t_stat,
          {t_tail_sql("(theta / se)", "(n - 2.0)")} AS p_value,
          theta - {t_critical_sql("(n - 2.0)")} * se AS ci_lower, theta + {t_critical_sql("(n - 2.0)")} * se AS ci_upper FROM e""",
    ),
)
def d1b(spark, sf):
    return final(causal.naive_ols(docs(spark, sf), causal.ordered_pairs(THREE)))


# One-feature least squares: the same estimator as the general one, in closed form.
_PRED = _FOLDED + """, tr AS (SELECT h.fold, regr_slope(f.sentence_count, f.n_words) AS bs, regr_intercept(f.sentence_count, f.n_words) AS as_,
    regr_slope(f.text_length, f.n_words) AS bt, regr_intercept(f.text_length, f.n_words) AS at_
    FROM range(0, 5) h(fold) JOIN f ON f.fold <> h.fold GROUP BY h.fold),
  fu AS (SELECT regr_slope(sentence_count, n_words) AS bs, regr_intercept(sentence_count, n_words) AS as_,
    regr_slope(text_length, n_words) AS bt, regr_intercept(text_length, n_words) AS at_ FROM f),
  pr AS (SELECT f.id, f.fold, f.sentence_count, f.text_length, tr.as_ + tr.bs * n_words AS pred_sentence_count, tr.at_ + tr.bt * n_words AS pred_text_length,
    fu.as_ + fu.bs * n_words AS full_sentence_count, fu.at_ + fu.bt * n_words AS full_text_length FROM f JOIN tr USING (fold), fu)"""


def _pred(spark, sf):
    return causal.one_feature_predictions(_folded(spark, sf), "n_words", TWO, "id")


@query("d3_crossfit_predictions", rounded_sql("pred_sentence_count pred_text_length", W + _PRED + " SELECT id, fold, pred_sentence_count, pred_text_length FROM pr", 4))
def d3(spark, sf):
    return final(_pred(spark, sf).select("id", "fold", "pred_sentence_count", "pred_text_length"), 4)


@query("d4_full_fit", rounded_sql("full_sentence_count full_text_length", W + _PRED + " SELECT id, full_sentence_count, full_text_length FROM pr", 4))
def d4(spark, sf):
    return final(_pred(spark, sf).select("id", "full_sentence_count", "full_text_length"), 4)


_R2 = _PRED + """, l AS (SELECT fold, 'sentence_count' AS target, sentence_count AS y, pred_sentence_count AS p, full_sentence_count AS q FROM pr
    UNION ALL SELECT fold, 'text_length', text_length, pred_text_length, full_text_length FROM pr),
  r AS (SELECT target, fold, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2 FROM l GROUP BY 1, 2),
  c AS (SELECT target, avg(r2) AS r2_cv, stddev_pop(r2) AS r2_cv_std FROM r GROUP BY 1),
  u AS (SELECT target, 1 - sum((y - q) ** 2) / (var_pop(y) * count(*)) AS r2_full FROM l GROUP BY 1)"""


@query("d5_fold_r2", rounded_sql("r2", W + _R2 + " SELECT target, fold, r2 FROM r"))
def d5(spark, sf):
    return final(causal.fold_r2(_pred(spark, sf), TWO))


@query("d5_r2_summary", rounded_sql("r2_cv r2_cv_std r2_full", W + _R2 + " SELECT target, r2_cv, r2_cv_std, r2_full FROM c JOIN u USING (target)"))
def d5b(spark, sf):
    return final(causal.r2_summary(_pred(spark, sf), TWO).drop("r2_folds"))


@query("a24_r2_comparison", rounded_sql("r2_cv r2_full r2_diff", W + _R2 + " SELECT target, r2_cv, r2_full, CASE WHEN r2_cv <> 0 THEN r2_full - r2_cv END AS r2_diff FROM c JOIN u USING (target)"))
def a24(spark, sf):
    return final(causal.r2_comparison(causal.r2_summary(_pred(spark, sf), TWO)))


_ROWS = _PRED + """, rr AS (SELECT id, fold, 'n_words' AS variant, 'sentence_count' AS treatment, 'text_length' AS outcome, true AS cv,
    pred_sentence_count AS pred_treatment, pred_text_length AS pred_outcome, sentence_count - pred_sentence_count AS resid_treatment,
    text_length - pred_text_length AS resid_outcome FROM pr
  UNION ALL SELECT id, fold, 'n_words', 'sentence_count', 'text_length', false, full_sentence_count, full_text_length,
    sentence_count - full_sentence_count, text_length - full_text_length FROM pr)"""
_EST = _ROWS + """, es AS (SELECT variant, treatment, outcome, cv, count(*) AS n, sum(resid_treatment * resid_outcome) / sum(resid_treatment ** 2) AS theta,
    sum(resid_treatment ** 2) AS tt, corr(resid_outcome, resid_treatment) AS corr_resid, corr(pred_outcome, pred_treatment) AS corr_pred FROM rr GROUP BY 1, 2, 3, 4),
  se AS (SELECT es.cv, sqrt(sum((resid_outcome - theta * resid_treatment) ** 2) / (any_value(n) * any_value(tt))) AS se FROM es JOIN rr ON es.cv = rr.cv GROUP BY es.cv),
  est AS (SELECT variant, treatment, outcome, cv, n, theta, se, corr_resid, corr_pred, theta - 1.96 * se AS ci_lower, theta + 1.96 * se AS ci_upper, theta / se AS t_stat FROM es JOIN se USING (cv))"""


def _rows(spark, sf):
    return causal.residual_rows(_pred(spark, sf), PAIRS, "n_words", "id")


@query("d13_residual_rows", rounded_sql("pred_treatment pred_outcome resid_treatment resid_outcome", W + _ROWS + " SELECT * FROM rr", 4))
def d13(spark, sf):
    return final(_rows(spark, sf), 4)


@query("d6_dml_theta", rounded_sql("theta se ci_lower ci_upper t_stat", W + _EST + " SELECT variant, treatment, outcome, n, theta, se, ci_lower, ci_upper, t_stat FROM est WHERE cv"))
def d6(spark, sf):
    return final(causal.estimate(_rows(spark, sf)).where("cv").drop("cv", "corr_resid", "corr_pred"))


@query("d2_single_fit_theta", rounded_sql("theta se", W + _EST + " SELECT variant, treatment, outcome, theta, se FROM est WHERE NOT cv"))
def d2(spark, sf):
    return final(causal.estimate(_rows(spark, sf)).where("not cv").select("variant", "treatment", "outcome", "theta", "se"))


@query(
    "d7_dml_p_value",
    rounded_sql("theta se corr_resid corr_pred ci_lower ci_upper t_stat p_value", W + _EST + f" SELECT *, {t_tail_sql('t_stat', '(n - 2.0)')} AS p_value FROM est"),
)
def d7(spark, sf):
    return final(causal.estimate(_rows(spark, sf), n_features=1))


@query("d8_residual_corr", rounded_sql("corr_resid corr_pred", W + _EST + " SELECT cv, corr_resid, corr_pred FROM est"))
def d8(spark, sf):
    return final(causal.estimate(_rows(spark, sf)).select("cv", "corr_resid", "corr_pred"))


@query(
    "d9_reduction",
    rounded_sql(
        "naive_theta theta reduction_signed reduction_abs",
        W + _EST + """, nv AS (SELECT regr_slope(text_length, sentence_count) AS naive_theta FROM docs)
          SELECT cv, naive_theta, theta, (1 - theta / naive_theta) * 100 AS reduction_signed, (1 - abs(theta) / abs(naive_theta)) * 100 AS reduction_abs FROM est, nv""",
    ),
)
def d9(spark, sf):
    naive = causal.naive_ols(docs(spark, sf), PAIRS, inference=False)
    r = causal.reduction(causal.estimate(_rows(spark, sf)), naive)
    return final(r.select("cv", "naive_theta", "theta", "reduction_signed", "reduction_abs"))


@query(
    "d10_all_pairs",
    rounded_sql("theta r2", W + DOCS_SQL + ", " + ", ".join(
        f"p{i} AS (SELECT '{t}' AS treatment, '{y}' AS outcome, regr_slope({y}, {t}) AS theta, regr_r2({y}, {t}) AS r2 FROM docs)"
        for i, (t, y) in enumerate([("sentence_count", "text_length"), ("sentence_count", "digit_count"), ("text_length", "digit_count")])
    ) + " SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2"),
)
def d10(spark, sf):
    return final(causal.naive_ols(docs(spark, sf), causal.ordered_pairs(THREE), inference=False).select("treatment", "outcome", "theta", "r2"))


@query("d14_from_saved_rows", rounded_sql("theta se", W + _EST + " SELECT variant, treatment, outcome, cv, n, theta, se FROM est"))
def d14(spark, sf):
    """The residual rows are exported, read back without anything else, and give the estimates again."""
    path = f"{shared_dir(spark)}/lexatlas-query-{uuid.uuid4().hex}"
    sinks.export_tables({"dml_rows": _rows(spark, sf)}, path, AnalysisSpec(), counts=False)
    saved = spark.read.parquet(f"{path}/{sinks.folder_of('dml_rows')}/dml_rows").withColumn("cv", F.col("cv").cast("boolean"))
    return final(causal.estimate(saved).select("variant", "treatment", "outcome", "cv", "n", "theta", "se"))


@query("u1_summary_union", rounded_sql("theta se", W + _EST + """, nv AS (SELECT regr_slope(text_length, sentence_count) AS theta, regr_sxx(text_length, sentence_count) AS sxx,
      regr_syy(text_length, sentence_count) AS syy, count(*) AS n FROM docs)
    SELECT variant, cv, theta, se FROM est UNION ALL SELECT 'naive', NULL, theta, sqrt((syy - theta * theta * sxx) / (n - 2) / sxx) FROM nv"""))
def u1(spark, sf):
    naive = causal.naive_ols(docs(spark, sf), PAIRS, inference=False)
    return final(causal.summary_table(naive, causal.estimate(_rows(spark, sf))).select("variant", "cv", "theta", "se"))


@query("d3_ridge_many_features")
def d3_ridge(spark, sf):
    """Cross-fitted estimate with all vector positions and a control."""
    p = with_controls(measured_points(spark, sf), "embedding", ["n_words"])
    return final(causal.double_ml(p, TWO, "features", variant="vectors", n_features=65)["estimates"])


@query("d3_boosted_trees")
def d3_gbt(spark, sf):
    return final(causal.double_ml(points(spark, sf), TWO, "embedding", learner="gbt", variant="trees", n_features=64)["estimates"])


# -- contributions -----------------------------------------------------------------------------------


@query(
    "d15_linear_contribution",
    rounded_sql("contribution", W + DOCS_SQL + ", s AS (SELECT regr_slope(text_length, n_words) AS b, avg(n_words) AS m FROM docs) SELECT id, b * (n_words - m) AS contribution FROM docs, s", 4),
)
def d15(spark, sf):
    return final(con.one_feature_contribution(docs(spark, sf), "n_words", "text_length").select("id", "contribution"), 4)


@query("d15_vector_contributions")
def d15b(spark, sf):
    c = con.linear_contributions(measured_points(spark, sf), TWO, "embedding")
    return final(con.contribution_stats(c, TWO))


def _tree_contributions(spark, sf):
    """Documents with what each position adds to the prediction of 100 trees, that prediction, and the base value."""
    from pyspark.ml.functions import array_to_vector

    p = measured_points(spark, sf).withColumn("features", F.col("embedding").cast("array<double>"))
    model = trees.fit_side_by_side(trees.training_frame(p, "features", ["text_length"]), {0: (trees.learner("text_length", 100, 5), None)})[0]
    rows, base = con.gbt_contributions(p, "text_length", model)
    return model.transform(rows.withColumn("_x", array_to_vector("features"))), base


@query("d15_tree_contributions")
def d15c(spark, sf):
    return final(_tree_contributions(spark, sf)[0].select("id", F.posexplode("contrib_text_length").alias("pc", "contribution")))


@query("d15_tree_additivity", W + POINTS_SQL + " SELECT id, true AS additive FROM points")
def d15d(spark, sf):
    """Base value and contributions of a document add up to what the trees predict for it."""
    rows, base = _tree_contributions(spark, sf)
    total = F.lit(float(base)) + F.aggregate("contrib_text_length", F.lit(0.0), lambda s, c: s + c)
    return rows.select("id", (F.abs(total - F.col("_y")) < 1e-6 * (1 + F.abs("_y"))).alias("additive"))


_CONTRIB = POINTS_SQL + """, k AS (SELECT id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pc, unnest(embedding)::DOUBLE AS a,
    unnest(list_reverse(embedding))::DOUBLE AS b FROM points)"""


def _contrib(spark, sf):
    """Two arrays per document that play the part of contributions."""
    e = F.col("embedding").cast("array<double>")
    return measured_points(spark, sf).withColumn("contrib_sentence_count", e).withColumn("contrib_text_length", F.reverse(e))


@query(
    "a21_contribution_stats",
    rounded_sql("min max range std", W + _CONTRIB + """ SELECT pc, 'sentence_count' AS outcome, min(a) AS min, max(a) AS max, max(a) - min(a) AS range, stddev_pop(a) AS std FROM k GROUP BY pc
      UNION ALL SELECT pc, 'text_length', min(b), max(b), max(b) - min(b), stddev_pop(b) FROM k GROUP BY pc"""),
)
def a21(spark, sf):
    return final(con.contribution_stats(_contrib(spark, sf), TWO))


@query("a27_top_by_contribution", rounded_sql("importance", W + _CONTRIB + " SELECT pc, (avg(abs(a)) + avg(abs(b))) / 2 AS importance FROM k GROUP BY pc ORDER BY round(importance, 9) DESC, pc LIMIT 5"))
def a27(spark, sf):
    top = con.top_by_contribution(_contrib(spark, sf), TWO, 64)
    return final(top.orderBy(F.round("importance", 9).desc(), "pc").limit(5))


@query(
    "k5_top_components_per_document",
    rounded_sql(
        "percentile contribution_sentence_count variance_text_length",
        W + _CONTRIB + """, r AS (SELECT id, pc, a, b, (rank() OVER (PARTITION BY pc ORDER BY a) - 1) * 100.0 / count(*) OVER (PARTITION BY pc) AS percentile,
            row_number() OVER (PARTITION BY id ORDER BY abs(a) + abs(b) DESC, pc DESC) AS i FROM k)
          SELECT id, 'PC' || pc AS pc, percentile, a AS contribution_sentence_count, abs(b) * (1.0 / (pc + 1)) * 100 AS variance_text_length FROM r WHERE i <= 6""",
    ),
)
def k5(spark, sf):
    c = _contrib(spark, sf)
    pct = ranking.percentile_arrays(ranking.long_view(c, "id", "embedding"))
    variance = F.transform("embedding", lambda v, i: 1.0 / (i + 1))
    info = con.top_components_per_row(TWO, variance, F.col("percentiles"), 64)
    rows = c.join(pct, "id").select("id", F.inline(info))
    return final(rows.select("id", "pc", "percentile", "contribution_sentence_count", "variance_text_length"))


@query("p16_clipped_selection", W + _CONTRIB + """, r AS (SELECT id, pc, row_number() OVER (PARTITION BY id ORDER BY abs(a) + abs(b) DESC, pc DESC) AS i FROM k)
  SELECT id, count(*) FILTER (pc < 32)::INTEGER AS n_kept FROM r WHERE i <= 6 GROUP BY id""")
def p16(spark, sf):
    e = F.col("embedding")
    info = con.top_components_per_row(TWO, F.transform(e, lambda v: F.lit(0.0)), F.transform(e, lambda v: F.lit(0.0)), 32)
    return _contrib(spark, sf).select("id", F.size(info).alias("n_kept"))


@query("p15_point_table", rounded_sql("x y z", W + POINTS_SQL + " SELECT x * 100 AS x, y * 100 AS y, z * 100 AS z, id::VARCHAR AS id, text, cluster_id, sentence_count, text_length FROM points"))
def p15(spark, sf):
    return final(pts.point_table(points(spark, sf), TWO))


@query("p15_point_table_2d", rounded_sql("x y z", W + POINTS_SQL + " SELECT x * 100 AS x, y * 100 AS y, 0.0 AS z, id::VARCHAR AS id, text, cluster_id, sentence_count FROM points"))
def p15b(spark, sf):
    return final(pts.point_table(points(spark, sf), ["sentence_count"], coords=("x", "y")))


@query(
    "p20_flat_records",
    rounded_sql("prob_high prob_low", W + POINTS_SQL + """, q AS (SELECT cluster_id, avg((digit_count <> 0)::INT) AS prob_high, count(*) AS size FROM points GROUP BY 1)
      SELECT cluster_id AS topic_id, prob_high, 1 - prob_high AS prob_low FROM q"""),
)
def p20(spark, sf):
    rate = F.avg((F.col("digit_count") != 0).cast("int"))
    nested = points(spark, sf).groupBy(F.col("cluster_id").alias("topic_id")).agg(
        F.count(F.lit(1)).alias("size"), F.struct(rate.alias("high"), (1 - rate).alias("low")).alias("prob")
    )
    return final(pts.chosen_columns(pts.flat(nested), ("prob_",), ("topic_id",)))


# -- importance ----------------------------------------------------------------------------------------

_IMP = LONG_SQL + f""", fi AS (SELECT ({hash_sql('id')} % 5)::INTEGER AS fold, pc, abs(avg(value)) AS importance FROM long GROUP BY 1, 2),
  fr AS (SELECT fold, pc, row_number() OVER (PARTITION BY fold ORDER BY importance DESC, pc) AS rank FROM fi)"""


def _fold_importance(spark, sf):
    long = ranking.long_view(points(spark, sf), "id", "embedding").withColumn("fold", fold_of("id", 5))
    return long.groupBy("fold", "pc").agg(F.abs(F.avg("value")).alias("importance"))


@query("w3_fold_ranks", W + _IMP + " SELECT * FROM fr")
def w3(spark, sf):
    return ranking.importance_ranks(_fold_importance(spark, sf), ["fold"]).select("fold", "pc", "rank")


@query("a22_rank_summary", W + _IMP + " SELECT pc, round_even(avg(rank), 0)::BIGINT AS avg_rank, floor(median(rank))::BIGINT AS median_rank FROM fr GROUP BY pc")
def a22(spark, sf):
    return ranking.rank_summary(ranking.importance_ranks(_fold_importance(spark, sf), ["fold"]), ["pc"])


@query("w4_list_rank", W + LONG_SQL + """, i AS (SELECT pc, abs(avg(value)) AS importance FROM long GROUP BY pc),
  r AS (SELECT pc, row_number() OVER (ORDER BY importance DESC, pc) AS rank, count(*) OVER () AS n FROM i)
  SELECT pc, rank, CASE WHEN rank <= 6 THEN rank ELSE n + 1 END AS list_rank FROM r""")
def w4(spark, sf):
    long = ranking.long_view(points(spark, sf), "id", "embedding")
    return ranking.list_ranks(long.groupBy("pc").agg(F.abs(F.avg("value")).alias("importance")), 6, []).drop("importance")


_EDGES = "[" + ", ".join(f"quantile_cont({{v}}, {i / 10})" for i in range(1, 10)) + "]"
_MI = LONG_SQL + f""", xe AS (SELECT pc, list_distinct({_EDGES.format(v='value')}) AS e FROM long GROUP BY pc),
  ye AS (SELECT list_distinct({_EDGES.format(v='text_length')}) AS et, list_distinct({_EDGES.format(v='sentence_count')}) AS es FROM points),
  bb AS (SELECT pc, len(list_filter(e, lambda q: q < value)) AS bx, len(list_filter(et, lambda q: q < text_length)) AS bt,
    len(list_filter(es, lambda q: q < sentence_count)) AS bs FROM long JOIN xe USING (pc), ye),
  cc AS (SELECT pc, 'text_length' AS outcome, bx, bt AS y, count(*) AS c FROM bb GROUP BY 1, 2, 3, 4
    UNION ALL SELECT pc, 'sentence_count', bx, bs, count(*) FROM bb GROUP BY 1, 2, 3, 4),
  ct AS (SELECT *, sum(c) OVER (PARTITION BY pc, outcome) AS n, sum(c) OVER (PARTITION BY pc, outcome, bx) AS cx, sum(c) OVER (PARTITION BY pc, outcome, y) AS cy FROM cc),
  mi AS (SELECT 'mi' AS method, outcome, pc, greatest(sum(c / n * ln(c * n / (cx * cy))), 0) AS importance FROM ct GROUP BY outcome, pc),
  cr AS (SELECT 'corr' AS method, 'text_length' AS outcome, pc, abs(corr(value, text_length)) AS importance FROM long GROUP BY pc
    UNION ALL SELECT 'corr', 'sentence_count', pc, abs(corr(value, sentence_count)) FROM long GROUP BY pc),
  av AS (SELECT method, pc, avg(importance) AS importance FROM (SELECT * FROM mi UNION ALL SELECT * FROM cr) GROUP BY 1, 2),
  rk AS (SELECT method, pc, importance, row_number() OVER (PARTITION BY method ORDER BY importance DESC, pc) AS rank, count(*) OVER (PARTITION BY method) AS n FROM av)"""


def _two_methods(spark, sf):
    from lexatlas.operators.effects import pc_correlations

    p = measured_points(spark, sf)
    c = pc_correlations(p, TWO, "embedding").select(F.lit("corr").alias("method"), "outcome", "pc", F.abs("corr").alias("importance"))
    return imp.binned_mi(p, TWO, "embedding").unionByName(c)


@query("f4_binned_mi", rounded_sql("importance", W + _MI + " SELECT * FROM mi"))
def f4(spark, sf):
    return final(imp.binned_mi(measured_points(spark, sf), TWO, "embedding"))


@query("k4_top_components", rounded_sql("importance", W + _MI + " SELECT method, pc, importance, rank FROM rk WHERE rank <= 6"))
def k4(spark, sf):
    return final(imp.top_components(_two_methods(spark, sf)))


@query("f5_selection_summary", W + _MI + " SELECT method, string_agg('PC' || pc, ', ' ORDER BY rank) AS components FROM rk WHERE rank <= 6 GROUP BY method")
def f5(spark, sf):
    return imp.selection_summary(imp.top_components(_two_methods(spark, sf)))


@query(
    "f7_importance_summary",
    rounded_sql(
        "mi_importance corr_importance",
        W + _MI + """ SELECT pc, max(importance) FILTER (method = 'mi') AS mi_importance, max(CASE WHEN rank <= 6 THEN rank ELSE n + 1 END) FILTER (method = 'mi') AS mi_rank,
          max(importance) FILTER (method = 'corr') AS corr_importance, max(CASE WHEN rank <= 6 THEN rank ELSE n + 1 END) FILTER (method = 'corr') AS corr_rank FROM rk GROUP BY pc""",
    ),
)
def f7(spark, sf):
    return final(imp.importance_summary(_two_methods(spark, sf), methods=("mi", "corr")))


@query(
    "f3_ridge_two_features",
    rounded_sql(
        "importance",
        W + DOCS_SQL + ", o AS (" + " UNION ALL ".join(
            f"""SELECT '{t}' AS outcome, count(*)::DOUBLE AS n, corr(n_words, digit_count) AS r, covar_pop(n_words, {t}) / stddev_pop(n_words) * count(*) AS c1,
            covar_pop(digit_count, {t}) / stddev_pop(digit_count) * count(*) AS c2 FROM docs""" for t in TWO
        ) + """), s AS (SELECT outcome, ((n + 10) * c1 - n * r * c2) / ((n + 10) ** 2 - (n * r) ** 2) AS b0, ((n + 10) * c2 - n * r * c1) / ((n + 10) ** 2 - (n * r) ** 2) AS b1 FROM o)
          SELECT 'ridge' AS method, outcome, 0 AS pc, abs(b0) AS importance FROM s UNION ALL SELECT 'ridge', outcome, 1, abs(b1) FROM s""",
    ),
)
def f3(spark, sf):
    d = _folded(spark, sf).withColumn("features", F.array("n_words", "digit_count"))
    return final(imp.regularised(d, TWO, "ridge", [10.0])[0])


@query("f3_ridge_components")
def f3b(spark, sf):
    m = gram.with_model_columns(measured_points(spark, sf), "id", "embedding", TWO, 5)
    return final(imp.regularised(m, TWO, "ridge")[0])


@query("f2_lasso_components")
def f2(spark, sf):
    m = gram.with_model_columns(measured_points(spark, sf), "id", "embedding", TWO, 5)
    return final(imp.regularised(m, TWO, "lasso")[0])


def _optimality(spark, sf, method: str):
    """Per outcome, on the rows themselves: how many components there are and for how many the gradient is what the penalty asks for."""
    p = measured_points(spark, sf)
    g = gram.gram(gram.with_model_columns(p, "id", "embedding", TWO, 5), TWO)
    mean = g.total[0, 1 : g.p + 1] / g.total[0, 0] + g.shift[: g.p]
    sd = gram.deviations(g.total, g.p)
    fits = {t: (imp.lasso_path(g, t)[:2] if method == "lasso" else imp.ridge_choice(g, t)) for t in TWO}
    centre = {t: p.agg(F.avg(t)).first()[0] for t in TWO}
    z = F.zip_with(F.zip_with("embedding", F.lit([float(m) for m in mean]), lambda x, m: x - m), F.lit([float(s) for s in sd]), lambda x, s: x / s)
    scaled = p.select("id", *TWO, z.alias("z"))
    dot = lambda coef: F.aggregate(F.zip_with("z", F.lit([float(b) for b in coef]), lambda x, b: x * b), F.lit(0.0), lambda s, x: s + x)
    left = scaled.select("z", *[(F.col(t) - F.lit(centre[t]) - dot(fits[t][0])).alias(t) for t in TWO])
    long = left.select(*TWO, F.posexplode("z").alias("pc", "z")).groupBy("pc").agg(F.count("*").alias("n"), *[F.sum(F.col(t) * F.col("z")).alias(t) for t in TWO])
    parts = None
    for t in TWO:
        coef, alpha = fits[t]
        b = F.get(F.lit([float(v) for v in coef]), F.col("pc"))
        grad = F.col(t) / F.col("n") if method == "lasso" else F.col(t)
        scale = float(np.sqrt(g.total[g.target(t), g.target(t)] / g.total[0, 0]))  # gradients are in units of the outcome
        if method == "lasso":
            ok = F.when(b != 0, F.abs(grad - F.lit(alpha) * F.signum(b)) < 1e-4 * scale).otherwise(F.abs(grad) < alpha + 1e-4 * scale)
        else:
            ok = F.abs(grad - F.lit(alpha) * b) < 1e-6 * scale * F.col("n")
        part = long.agg(F.lit(t).alias("outcome"), F.count("*").alias("n_components"), F.count_if(ok).alias("n_optimal"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


_EVERY = """SELECT unnest(['sentence_count', 'text_length']) AS outcome, (SELECT max(len(embedding)) FROM embeddings)::BIGINT AS n_components,
  (SELECT max(len(embedding)) FROM embeddings)::BIGINT AS n_optimal"""


@query("f2_lasso_optimality", _EVERY)
def f2b(spark, sf):
    """Components in use have a gradient of the size of the penalty and the sign of their coefficient, the others a smaller one."""
    return _optimality(spark, sf, "lasso")


@query("f3_ridge_optimality", _EVERY)
def f3c(spark, sf):
    """The gradient is the penalty times the coefficient."""
    return _optimality(spark, sf, "ridge")


@query("f2_duality_gap", "SELECT unnest(['sentence_count', 'text_length']) AS outcome, 'lasso' AS method, true AS proven")
def f2c(spark, sf):
    """The final fits are proven to be within 1e-12 of the least value, in units of half the variance of the outcome."""
    p = measured_points(spark, sf)
    m = gram.with_model_columns(p, "id", "embedding", TWO, 5)
    half = F.create_map(*[x for t in TWO for x in (F.lit(t), F.lit(p.agg(F.var_pop(t) / 2).first()[0]))])
    return imp.regularised(m, TWO, "lasso")[1].select("outcome", "method", (F.col("gap") <= 1.001e-12 * half[F.col("outcome")]).alias("proven"))


@query("f1_boosted_importance")
def f1(spark, sf):
    m = gram.with_model_columns(measured_points(spark, sf), "id", "embedding", TWO, 5)
    return final(imp.boosted(m, TWO))


@query("f6_fold_importance_ranks")
def f6(spark, sf):
    m = gram.with_model_columns(points(spark, sf), "id", "embedding", TWO, 5)
    return final(imp.fold_ranks(m, TWO))


@query("p16_clip_to_components", W + LONG_SQL + " SELECT id, count(*) AS n FROM long WHERE pc < 10 GROUP BY id")
def p16b(spark, sf):
    return ranking.long_view(points(spark, sf), "id", "embedding").where("pc < 10").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("d11_feature_sets")
def d11(spark, sf):
    """The estimate for all vector positions and for the six most correlated ones."""
    p = measured_points(spark, sf)
    from lexatlas.functions.scalars import gather
    from lexatlas.operators.effects import pc_correlations

    c = pc_correlations(p, TWO, "embedding").select(F.lit("corr").alias("method"), "outcome", "pc", F.abs("corr").alias("importance"))
    _, best = imp.primary_components(imp.top_components(c), "corr", ())
    top = p.withColumn("top", gather("embedding", best))
    parts = [
        causal.double_ml(with_controls(top, f, ["n_words"]), TWO, "features", variant=name, n_features=n)["estimates"]
        for name, f, n in (("vectors", "embedding", 65), ("top", "top", 7))
    ]
    return final(parts[0].unionByName(parts[1]))


@query(
    "d12_controls",
    rounded_sql("mean", W + POINTS_SQL + " SELECT 'Control_' || c AS name, avg(v) AS mean FROM (SELECT 'digit_count' AS c, digit_count AS v FROM points UNION ALL SELECT 'n_words', n_words FROM points) GROUP BY c"),
)
def d12(spark, sf):
    from lexatlas.operators.vectors import feature_names

    f = with_controls(measured_points(spark, sf), "embedding", ["n_words", "digit_count"])
    names = F.lit(feature_names(64, ["n_words", "digit_count"]))
    rows = f.select(F.inline(F.arrays_zip(names.alias("name"), F.col("features").alias("v")))).where(F.col("name").startswith("Control_"))
    return final(rows.groupBy("name").agg(F.avg("v").alias("mean")))
