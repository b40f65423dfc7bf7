"""Queries over documents and labels: scans, cleaning, statistics, sampling, categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexatlas.functions.scalars import p_value_text, title
from lexatlas.functions.text import prefixed
from lexatlas.operators import categories as cat, cleaning, outcomes as out, profiling, ranking, sampling
from lexatlas.plans.catalog import query
from lexatlas.plans.frames import (
    DIGITS, DOCS_SQL, LABELLED_SQL, LENGTH, POINTS_SQL, QUALITY, SENTENCES, TOXIC,
    docs, final, hash_sql, labelled, measured, measured_points, points, rounded_sql, table,
)
from lexatlas.session import cut
from lexatlas.spec import AnalysisSpec, Outcome

PAIR = (SENTENCES, LENGTH)
PRESENCE = (DIGITS, LENGTH)
W = "WITH "


@query("s1_table_scan", "SELECT doc_id AS id, text, lang, source FROM documents")
def s1(spark, sf):
    return docs(spark, sf).select("id", "text", "lang", "source")


@query("s3_row_count", "SELECT count(*) AS n FROM documents")
def s3(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))


@query("p1_dense_ids", "SELECT count(*) AS n, 0::BIGINT AS lowest, count(*) - 1 AS highest, count(*) AS distinct_ids FROM documents")
def p1(spark, sf):
    ids = cleaning.dense_ids(table(spark, sf, "documents").select("doc_id"))
    g = F.col("generated_id")
    return ids.agg(
        F.count(g).alias("n"), F.min(g).cast("bigint").alias("lowest"), F.max(g).cast("bigint").alias("highest"),
        F.count_distinct(g).alias("distinct_ids"),
    )


@query("p2_synthetic_outcomes", W + DOCS_SQL + " SELECT id, text_length, sentence_count FROM docs")
def p2(spark, sf):
    return cleaning.synthetic_outcomes(docs(spark, sf).select("id", "text")).select("id", "text_length", "sentence_count")


@query("p3_drop_missing_text", "SELECT doc_id AS id FROM documents WHERE text IS NOT NULL")
def p3(spark, sf):
    return cleaning.drop_missing_text(docs(spark, sf)).select("id")


@query(
    "p4_impute_median",
    W + LABELLED_SQL + """ SELECT id,
      coalesce(quality::DOUBLE, (SELECT quantile_cont(quality::DOUBLE, 0.5) FROM labelled)) AS quality,
      coalesce(toxic::DOUBLE, (SELECT quantile_cont(toxic::DOUBLE, 0.5) FROM labelled)) AS toxic FROM labelled""",
)
def p4(spark, sf):
    return cleaning.impute_median(labelled(spark, sf).select("id", "quality", "toxic"), ["quality", "toxic"])


@query(
    "p5_impute_mode",
    """WITH gaps AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang FROM documents)
    SELECT id, coalesce(lang, (SELECT lang FROM gaps WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1),
      'Unknown') AS lang FROM gaps""",
)
def p5(spark, sf):
    gaps = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"))
    return cleaning.impute_mode(gaps, ["lang"])


@query("p6_drop_text", "SELECT doc_id AS id, lang, source FROM documents")
def p6(spark, sf):
    return docs(spark, sf).select("id", "text", "lang", "source").drop("text")


@query(
    "p7_anonymise",
    f"""WITH s AS (SELECT doc_id FROM documents ORDER BY {hash_sql('doc_id')}, doc_id LIMIT 150)
    SELECT doc_id AS id, substr(sha256(doc_id::VARCHAR), 1, 16) AS anonymous_id,
      doc_id IN (SELECT doc_id FROM s) AS in_sample FROM documents""",
)
def p7(spark, sf):
    d = docs(spark, sf).select("id")
    return cleaning.anonymise(d, "id", sampling.uniform_sample(d, 150))


@query("p8_prefix", "SELECT doc_id AS id, 'passage: ' || text AS prompt FROM documents")
def p8(spark, sf):
    return docs(spark, sf).select("id", prefixed("text", "passage: ").alias("prompt"))


_T = """, t AS (SELECT quantile_cont(sentence_count, 0.25) AS l1, quantile_cont(sentence_count, 0.75) AS h1,
  quantile_cont(text_length, 0.25) AS l2, quantile_cont(text_length, 0.75) AS h2 FROM docs)"""
_CONT = DOCS_SQL + _T + """, cats AS (SELECT id, CASE
  WHEN sentence_count > h1 AND text_length > h2 THEN 'both_high' WHEN sentence_count > h1 AND text_length < l2 THEN 'first_high'
  WHEN sentence_count < l1 AND text_length > h2 THEN 'second_high' WHEN sentence_count < l1 AND text_length < l2 THEN 'both_low'
  ELSE 'middle' END AS category FROM docs, t)"""


@query("p9_category_continuous", W + _CONT + " SELECT id, category FROM cats")
def p9(spark, sf):
    d = measured(spark, sf)
    return cat.with_category(d, PAIR, out.thresholds(d, PAIR)).select("id", "category")


def _presence(cond2: str) -> str:
    return DOCS_SQL + _T + f""", flags AS (SELECT *, digit_count <> 0 AS p1, {cond2} AS p2 FROM docs, t),
    cats AS (SELECT id, digit_count, text_length, CASE WHEN NOT p1 AND NOT p2 THEN 'both_absent' WHEN p1 AND NOT p2 THEN 'first_present'
      WHEN NOT p1 AND p2 THEN 'second_present' ELSE 'both_present' END AS category, p1 = p2 AS agreement FROM flags)"""


@query("p10_category_presence", W + _presence("text_length > h2") + " SELECT id, category, agreement FROM cats")
def p10(spark, sf):
    d = measured(spark, sf)
    return cat.with_category(d, PRESENCE, out.thresholds(d, PRESENCE)).select("id", "category", "agreement")


@query("p10_category_presence_nonzero", W + _presence("text_length <> 0") + " SELECT id, category, agreement FROM cats")
def p10b(spark, sf):
    d = measured(spark, sf)
    return cat.with_category(d, PRESENCE, out.thresholds(d, PRESENCE), "nonzero").select("id", "category", "agreement")


_LABEL_CATS = LABELLED_SQL + """, cats AS (SELECT id, CASE WHEN quality = 0 AND toxic = 0 THEN 'both_absent'
  WHEN quality <> 0 AND toxic = 0 THEN 'first_present' WHEN quality = 0 AND toxic <> 0 THEN 'second_present' ELSE 'both_present' END AS category,
  (quality <> 0) = (toxic <> 0) AS agreement FROM labelled WHERE quality IS NOT NULL)"""
_MARKS = (Outcome("quality", mode="zero_presence"), Outcome("toxic", mode="zero_presence"))


def _label_categories(spark, sf):
    d = labelled(spark, sf).where("quality is not null").select("id", "quality", "toxic")
    return cat.with_category(d, _MARKS, out.thresholds(d, _MARKS))


@query("p11_agreement", W + _LABEL_CATS + " SELECT id, agreement FROM cats")
def p11(spark, sf):
    return _label_categories(spark, sf).select("id", "agreement")


@query("p12_single_outcome_category", "SELECT doc_id AS id, 'middle' AS category FROM documents")
def p12(spark, sf):
    d = docs(spark, sf)
    return cat.with_category(d, (LENGTH,), out.thresholds(d, (LENGTH,))).select("id", "category")


@query(
    "p13_display_class",
    W + _LABEL_CATS + """ SELECT id, CASE WHEN NOT agreement THEN 'disagreement'
      WHEN category IN ('both_present', 'both_absent') THEN category ELSE 'hidden' END AS display_class FROM cats""",
)
def p13(spark, sf):
    c = cat.display_class(_label_categories(spark, sf), ("both_present", "both_absent"), show_disagreement=True)
    return c.select("id", "display_class")


@query(
    "p14_point_colours",
    rounded_sql(
        "hue r g b",
        W + POINTS_SQL + """, p AS (SELECT id, cluster_id, 100.0 * (rank() OVER (ORDER BY x) - 1) / count(*) OVER () AS pct FROM points),
        q AS (SELECT *, pct / 100.0 AS s, CASE WHEN pct < 50 THEN pct / 50.0 ELSE pct / 50.0 - 1 END AS t FROM p)
        SELECT id, fmod(cluster_id * 137.5::DOUBLE, 360.0::DOUBLE) AS hue, CASE WHEN s < 0.5 THEN 0.58 * (1 - t) ELSE t END AS r,
          CASE WHEN s < 0.5 THEN t ELSE 1.0 END AS g, CASE WHEN s < 0.5 THEN 0.83 ELSE 0.83 * (1 - t) END AS b FROM q""",
    ),
)
def p14(spark, sf):
    p = measured_points(spark, sf).select("id", "cluster_id", F.col("x").alias("value"), F.lit(0).alias("pc"))
    pct = ranking.percentile_ranks(p)
    joined = p.select("id", "cluster_id").join(pct, "id")
    return final(joined.select("id", cat.topic_hue(F.col("cluster_id").cast("double")).alias("hue"), *cat.gradient(F.col("pct"))))


@query(
    "p17_rounded_statistics",
    W + DOCS_SQL + """ SELECT lang, round(corr(text_length, n_words), 3) AS corr, printf('%.5f', count(*) / 100000.0) AS share_text
      FROM docs GROUP BY lang""",
)
def p17(spark, sf):
    d = docs(spark, sf).groupBy("lang").agg(F.corr("text_length", "n_words").alias("c"), F.count(F.lit(1)).alias("n"))
    return d.select("lang", F.round("c", 3).alias("corr"), p_value_text(F.col("n") / 100000.0).alias("share_text"))


# -- statistics -----------------------------------------------------------------------------------

_STACK = """, long AS (SELECT 'sentence_count' AS outcome, sentence_count AS value FROM docs
  UNION ALL SELECT 'text_length', text_length FROM docs UNION ALL SELECT 'digit_count', digit_count FROM docs)"""
_THREE = ["sentence_count", "text_length", "digit_count"]


@query(
    "a1_outcome_stats",
    rounded_sql(
        "min max mean std median p10 p25 p50 p75 p90",
        W + DOCS_SQL + _STACK + """ SELECT outcome, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std,
          quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25,
          quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90
          FROM long GROUP BY outcome""",
    ),
)
def a1(spark, sf):
    return final(out.numeric_stats(measured(spark, sf), _THREE))


@query(
    "a2_value_counts",
    rounded_sql("share", "SELECT lang AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY lang"),
)
def a2(spark, sf):
    return final(out.category_shares(docs(spark, sf), "lang"))


@query(
    "a3_outcome_mode",
    rounded_sql(
        "zero_fraction",
        W + LABELLED_SQL + """, long AS (SELECT 'sentence_count' AS outcome, sentence_count AS value FROM labelled
          UNION ALL SELECT 'text_length', text_length FROM labelled UNION ALL SELECT 'digit_count', digit_count FROM labelled
          UNION ALL SELECT 'quality', quality::DOUBLE FROM labelled WHERE quality IS NOT NULL
          UNION ALL SELECT 'toxic', toxic::DOUBLE FROM labelled WHERE toxic IS NOT NULL),
        f AS (SELECT outcome, avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) AS zf, count(DISTINCT value) AS u, bool_or(value = 0) AS z
          FROM long GROUP BY outcome),
        m AS (SELECT outcome, zf AS zero_fraction, u AS n_unique, CASE WHEN zf > 0.5 OR (u = 2 AND z) OR (u <= 10 AND z AND zf > 0.2)
          THEN 'zero_presence' ELSE 'continuous' END AS mode, true AS detected FROM f)
        SELECT *, mode = 'continuous' AND zero_fraction > 0.3 AS many_zeros FROM m""",
    ),
)
def a3(spark, sf):
    names = ("sentence_count", "text_length", "digit_count", "quality", "toxic")
    return final(out.outcome_modes(labelled(spark, sf), tuple(Outcome(n) for n in names)))


_PROFILE_SQL = """profile AS (
  SELECT 0 AS position, 'doc_id' AS "column", 'integer' AS kind, count(*) AS rows, count(doc_id) AS present, count(DISTINCT doc_id) AS n_unique,
    NULL::DOUBLE AS mean_length, avg((doc_id = 0)::INT) AS zero_share, min(doc_id)::DOUBLE AS min, max(doc_id)::DOUBLE AS max FROM documents
  UNION ALL SELECT 1, 'text', 'text', count(*), count(text), count(DISTINCT text), avg(length(text)), NULL, NULL, NULL FROM documents
  UNION ALL SELECT 2, 'lang', 'text', count(*), count(lang), count(DISTINCT lang), avg(length(lang)), NULL, NULL, NULL FROM documents
  UNION ALL SELECT 3, 'source', 'text', count(*), count(source), count(DISTINCT source), avg(length(source)), NULL, NULL, NULL FROM documents
  UNION ALL SELECT 4, 'n_chars', 'integer', count(*), count(n_chars), count(DISTINCT n_chars), NULL, avg((n_chars = 0)::INT), min(n_chars), max(n_chars) FROM documents)"""


@query(
    "a4_column_profile",
    rounded_sql(
        "mean_length zero_share min max",
        W + _PROFILE_SQL + """ SELECT *, CASE "column" WHEN 'text' THEN 'text' WHEN 'doc_id' THEN 'id' END AS role FROM profile""",
    ),
)
def a4(spark, sf):
    return final(profiling.detect_roles(profiling.column_profile(table(spark, sf, "documents"))))


@query(
    "a5_detected_outcomes",
    rounded_sql(
        "min max",
        """WITH c AS (
          SELECT 2 AS position, 'l_suppkey' AS "column", count(DISTINCT l_suppkey) AS u, avg((l_suppkey = 0)::INT) AS zs, min(l_suppkey)::DOUBLE AS min, max(l_suppkey)::DOUBLE AS max, true AS int64, count(*) AS n FROM lineitem
          UNION ALL SELECT 3, 'l_quantity', count(DISTINCT l_quantity), avg((l_quantity = 0)::INT), min(l_quantity), max(l_quantity), false, count(*) FROM lineitem
          UNION ALL SELECT 4, 'l_extendedprice', count(DISTINCT l_extendedprice), avg((l_extendedprice = 0)::INT), min(l_extendedprice), max(l_extendedprice), false, count(*) FROM lineitem
          UNION ALL SELECT 5, 'l_discount', count(DISTINCT l_discount), avg((l_discount = 0)::INT), min(l_discount), max(l_discount), false, count(*) FROM lineitem
          UNION ALL SELECT 6, 'l_tax', count(DISTINCT l_tax), avg((l_tax = 0)::INT), min(l_tax), max(l_tax), false, count(*) FROM lineitem),
        r AS (SELECT *, u <= 20 OR (int64 AND u < n * 0.1) OR regexp_matches("column", 'age|gender|sex|group|condition|batch|rater|year|month|day|time|count|num_') AS ctl FROM c),
        k AS (SELECT *, row_number() OVER (PARTITION BY ctl ORDER BY position) AS i FROM r)
        SELECT (position - 2)::INTEGER AS position, "column", CASE "column" WHEN 'l_suppkey' THEN 'L Suppkey' WHEN 'l_quantity' THEN 'L Quantity'
          WHEN 'l_extendedprice' THEN 'L Extendedprice' WHEN 'l_discount' THEN 'L Discount' ELSE 'L Tax' END AS display,
          CASE WHEN ctl THEN 'control' ELSE 'outcome' END AS role, CASE WHEN zs > 0.3 THEN 'zero_presence' ELSE 'continuous' END AS mode, min, max
        FROM k WHERE (ctl AND i <= 5) OR (NOT ctl AND i <= 2)""",
    ),
)
def a5(spark, sf):
    cols = ["l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    profile = profiling.column_profile(table(spark, sf, "lineitem").select(*cols))
    return final(profiling.detect_outcomes(profile.withColumn("role", F.lit(None).cast("string"))))


@query(
    "a6_thresholds",
    rounded_sql(
        "low high",
        W + LABELLED_SQL + """ SELECT 'sentence_count' AS outcome, quantile_cont(sentence_count, 0.25) AS low, quantile_cont(sentence_count, 0.75) AS high, 'continuous' AS mode FROM labelled
          UNION ALL SELECT 'text_length', 500.0, max(text_length), 'continuous' FROM labelled
          UNION ALL SELECT 'n_words', quantile_cont(n_words, 0.1), quantile_cont(n_words, 0.9), 'continuous' FROM labelled""",
    ),
)
def a6(spark, sf):
    spec = (SENTENCES, Outcome("text_length", low_value=500.0), Outcome("n_words", low_percentile=10.0, high_percentile=90.0))
    return final(out.thresholds(measured(spark, sf), spec).select("outcome", "low", "high", "mode"))


@query(
    "a7_presence_thresholds",
    rounded_sql(
        "low high zero_fraction",
        W + DOCS_SQL + """ SELECT 'digit_count' AS outcome, 0.0 AS low, coalesce(min(digit_count) FILTER (digit_count <> 0), 1.0) AS high,
          count(*) FILTER (digit_count = 0) AS zero_count, count(*) FILTER (digit_count <> 0) AS non_zero_count,
          avg((digit_count = 0)::INT) AS zero_fraction FROM docs""",
    ),
)
def a7(spark, sf):
    t = out.thresholds(docs(spark, sf), (DIGITS,))
    return final(t.select("outcome", "low", "high", "zero_count", "non_zero_count", "zero_fraction"))


@query(
    "a8_control_summary",
    rounded_sql("min max mean std", W + DOCS_SQL + " SELECT 'n_words' AS control, min(n_words) AS min, max(n_words) AS max, avg(n_words) AS mean, stddev_pop(n_words) AS std FROM docs"),
)
def a8(spark, sf):
    return final(out.control_summary(docs(spark, sf), ["n_words"]))


@query("a20_category_counts", W + _CONT + " SELECT category, count(*) AS n FROM cats GROUP BY category")
def a20(spark, sf):
    d = measured(spark, sf)
    return cat.category_counts(cat.with_category(d, PAIR, out.thresholds(d, PAIR)))


@query(
    "a20_presence_counts",
    W + _LABEL_CATS + """ SELECT category, count(*) AS n FROM cats GROUP BY category
      UNION ALL SELECT CASE WHEN agreement THEN 'agreement' ELSE 'disagreement' END, count(*) FROM cats GROUP BY 1""",
)
def a20b(spark, sf):
    return cat.category_counts(_label_categories(spark, sf))


@query(
    "a25_sampling_info",
    rounded_sql("sample_ratio", "SELECT 'stratified' AS method, count(*) AS original_size, 120::BIGINT AS sample_size, 42::BIGINT AS sample_seed, 120.0 / count(*) AS sample_ratio, 'lang' AS stratify_column FROM documents"),
)
def a25(spark, sf):
    d = docs(spark, sf).select("id", "lang")
    return final(sampling.sampling_info(d, sampling.stratified_sample(d, 120, "lang"), "stratified", 42, "lang"))


def _suggest(mode: str) -> str:
    size = "20" if mode == "many" else "greatest(30, least(floor(n * 0.005), 100))"
    samples = "3" if mode == "many" else f"greatest(5, floor({size} * 0.15))"
    neighbors = "10" if mode == "many" else "CASE WHEN n < 1000 THEN 15 WHEN n < 5000 THEN 30 WHEN n < 20000 THEN 50 ELSE 100 END"
    return f"""WITH p AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT max(len(embedding)) FROM embeddings) AS d)
      SELECT CASE WHEN n < 500 THEN 'tiny' WHEN n < 2000 THEN 'small' WHEN n < 10000 THEN 'medium' WHEN n < 50000 THEN 'large' ELSE 'xlarge' END AS size_class,
        ({size})::BIGINT AS min_cluster_size, ({samples})::BIGINT AS min_samples, ({neighbors})::BIGINT AS n_neighbors,
        (CASE WHEN n < 500 THEN 3 WHEN n < 10000 THEN 5 ELSE 10 END)::BIGINT AS dml_folds,
        (CASE WHEN n < 1000 THEN 50 WHEN n < 10000 THEN 100 ELSE 200 END)::BIGINT AS n_trees,
        (CASE WHEN n < 1000 OR d / n > 0.5 THEN 3 WHEN n < 5000 THEN 5 WHEN n < 20000 THEN 6 ELSE 8 END)::BIGINT AS tree_depth,
        (CASE WHEN d > 1000 THEN 16 WHEN d > 500 THEN 32 ELSE 64 END)::BIGINT AS batch_size FROM p"""


def _profile_row(spark, sf):
    d = table(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).scalar()
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n_samples")).withColumn("n_features", d)


_SUGGESTED = ["size_class", "min_cluster_size", "min_samples", "n_neighbors", "dml_folds", "n_trees", "tree_depth", "batch_size"]


@query("a26_suggested_parameters", _suggest("many"))
def a26(spark, sf):
    return profiling.suggest_parameters(_profile_row(spark, sf)).select(*_SUGGESTED)


@query("a26_suggested_medium", _suggest("medium"))
def a26b(spark, sf):
    return profiling.suggest_parameters(_profile_row(spark, sf), "medium").select(*_SUGGESTED)


# -- ranks, quantile lookups, samples -----------------------------------------------------------------


@query(
    "w0_value_ranks",
    W + DOCS_SQL + """ SELECT lang, text_length, count(*) AS cnt,
      (sum(count(*)) OVER (PARTITION BY lang ORDER BY text_length) - count(*))::BIGINT AS below,
      (sum(count(*)) OVER (PARTITION BY lang))::BIGINT AS total FROM docs GROUP BY lang, text_length""",
)
def w0(spark, sf):
    return ranking.value_ranks(measured(spark, sf), ["lang"], "text_length")


@query(
    "w5_floor_percentile",
    W + DOCS_SQL + """, s AS (SELECT text_length, row_number() OVER (ORDER BY text_length) - 1 AS i, count(*) OVER () AS n FROM docs)
      SELECT max(text_length) FILTER (i = floor(n * 0.10)) AS extremes_low, max(text_length) FILTER (i = floor(n * 0.90)) AS extremes_high,
        max(text_length) FILTER (i = floor(n * 0.25)) AS quartiles_low, max(text_length) FILTER (i = floor(n * 0.75)) AS quartiles_high,
        max(text_length) FILTER (i = floor(n * 0.50)) AS median, max(text_length) FILTER (i = n) AS top FROM s""",
)
def w5(spark, sf):
    p = ranking.PRESETS
    at = {f"{k}_{s}": p[k][i] for k in ("extremes", "quartiles") for i, s in enumerate(("low", "high"))}
    return ranking.floor_percentile(measured(spark, sf), [], "text_length", {**at, "median": p["median"][0], "top": 100})


@query(
    "w5b_value_percentile",
    rounded_sql(
        "a b",
        W + DOCS_SQL + """, s AS (SELECT count(*) AS n, count(*) FILTER (text_length <= 800) AS ca, count(*) FILTER (text_length <= 3000) AS cb FROM docs)
          SELECT greatest(ca - 1, 0) * 100.0 / n AS a, floor(greatest(ca - 1, 0) * 100.0 / n + 0.5)::BIGINT AS a_rounded,
            greatest(cb - 1, 0) * 100.0 / n AS b, floor(greatest(cb - 1, 0) * 100.0 / n + 0.5)::BIGINT AS b_rounded FROM s""",
    ),
)
def w5b(spark, sf):
    return final(ranking.value_percentile(docs(spark, sf), "text_length", {"a": 800, "b": 3000}))


_EDGES = ", e AS (SELECT list_distinct([" + ", ".join(f"quantile_cont(text_length, {i / 10})" for i in range(11)) + "]) AS edges FROM docs)"
_BINS = DOCS_SQL + _EDGES + """, b AS (SELECT docs.id, docs.lang,
  len(list_filter(list_sort(edges)[2:len(edges) - 1], lambda v: v < docs.text_length))::INTEGER AS bin FROM docs, e)"""


@query("w7_decile_bins", W + _BINS + " SELECT id, bin FROM b")
def w7(spark, sf):
    return ranking.decile_bins(measured(spark, sf), "text_length").select("id", "bin")


def _stratified(source: str, stratum: str, n: int) -> str:
    return f"""{source}, g AS (SELECT {stratum} AS s, count(*) AS size FROM b GROUP BY 1),
      x AS (SELECT s, size, size * {n}::DOUBLE / sum(size) OVER () AS exact FROM g),
      y AS (SELECT s, size, floor(exact) AS whole, round(exact - floor(exact), 9) AS rest FROM x),
      z AS (SELECT s, size, whole, row_number() OVER (ORDER BY rest DESC, s) AS turn, {n} - sum(whole) OVER () AS spare FROM y),
      alloc AS (SELECT s, size, (whole + CASE WHEN turn <= spare THEN 1 ELSE 0 END)::BIGINT AS allocated FROM z),
      r AS (SELECT id, {stratum} AS s, row_number() OVER (PARTITION BY {stratum} ORDER BY {hash_sql('id')}, id) AS pos FROM b)"""


@query("w8_stratified_sample", W + _stratified(_BINS, "bin", 130) + " SELECT r.id, r.s AS bin FROM r JOIN alloc USING (s) WHERE pos <= allocated")
def w8(spark, sf):
    binned = ranking.decile_bins(measured(spark, sf), "text_length").select("id", "bin")
    return sampling.stratified_sample(binned, 130, "bin")


@query("w8_allocation", W + _stratified(DOCS_SQL + ", b AS (SELECT id, lang FROM docs)", "lang", 137) + " SELECT s AS lang, size, allocated FROM alloc")
def w8b(spark, sf):
    return sampling.allocation(docs(spark, sf).select("id", "lang"), "lang", 137)


@query("w9_uniform_sample", f"SELECT doc_id AS id FROM documents ORDER BY {hash_sql('doc_id')}, doc_id LIMIT 100")
def w9(spark, sf):
    return sampling.uniform_sample(docs(spark, sf).select("id"), 100)


@query("w9_hash_positions", f"SELECT doc_id AS id, row_number() OVER (ORDER BY {hash_sql('doc_id')}, doc_id) AS position FROM documents")
def w9b(spark, sf):
    return sampling.hash_positions(docs(spark, sf).select("id"), [], "id", 42)


@query("w10_auto_stratified_sample", W + _stratified(_BINS, "bin", 90) + " SELECT r.id FROM r JOIN alloc USING (s) WHERE pos <= allocated")
def w10(spark, sf):
    return sampling.sample(measured(spark, sf), AnalysisSpec(outcomes=PAIR, sample_size=90)).select("id")


@query("w11_folds", f"SELECT doc_id AS id, ({hash_sql('doc_id')} % 5)::INTEGER AS fold FROM documents")
def w11(spark, sf):
    return sampling.with_folds(docs(spark, sf).select("id"), 5)


@query(
    "u3_remainder",
    f"WITH s AS (SELECT doc_id FROM documents ORDER BY {hash_sql('doc_id')}, doc_id LIMIT 100) SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)",
)
def u3(spark, sf):
    d = docs(spark, sf).select("id")
    return sampling.remainder(d, sampling.uniform_sample(d, 100))


_AXES = [f"least(greatest(floor(({c} + 1.0) / 2.0 * 1024), 0), 1023)::BIGINT AS g{c}" for c in "xyz"]
_CODE = " | ".join(f"(((g{c} >> {b}) & 1) << {3 * b + i})" for b in range(10) for i, c in enumerate("xyz"))
_ORDER = POINTS_SQL + f""", t AS (SELECT quantile_cont(text_length, 0.5) AS m FROM points),
  g AS (SELECT id, CASE WHEN text_length > m THEN 'high' ELSE 'low' END AS category, {', '.join(_AXES)} FROM points, t),
  k AS (SELECT id, category, (({_CODE}) << 33) | ({hash_sql('id')} >> 27) AS v FROM g),
  o AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY v, id) AS browse_rank FROM k)"""


def _browse(spark, sf):
    p = measured_points(spark, sf)
    m = ranking.quantiles(p, [], "text_length", {"m": 0.5}).scalar()
    return cat.browse_order(p.withColumn("category", F.when(F.col("text_length") > m, "high").otherwise("low")))


@query("k8_browse_order", W + _ORDER + " SELECT * FROM o")
def k8(spark, sf):
    return _browse(spark, sf)


@query(
    "w12_browse_neighbours",
    W + _ORDER + """ SELECT id, category, browse_rank,
      coalesce(lag(id) OVER w, last_value(id) OVER f) AS previous_id, coalesce(lead(id) OVER w, first_value(id) OVER f) AS next_id
      FROM o WINDOW w AS (PARTITION BY category ORDER BY browse_rank),
      f AS (PARTITION BY category ORDER BY browse_rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def w12(spark, sf):
    return cat.browse_neighbours(cut(_browse(spark, sf)))


@query("j6_sample_flag", f"""WITH s AS (SELECT doc_id FROM documents ORDER BY {hash_sql('doc_id')}, doc_id LIMIT 100)
  SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM s) GROUP BY lang""")
def j6(spark, sf):
    d = docs(spark, sf).select("id", "lang")
    return d.join(sampling.uniform_sample(d.select("id"), 100), "id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s2_preview_profile",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(DISTINCT {c}) AS n_unique FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")),
)
def s2(spark, sf):
    """Detection over the whole table, all columns, instead of a preview."""
    return profiling.column_profile(table(spark, sf, "documents")).select("column", "rows", "n_unique")


@query(
    "s6_required_columns",
    """SELECT count(*) AS n, 'missing columns: absent' AS refused FROM documents""",
)
def s6(spark, sf):
    """Passes with the columns that are there and names the one that is not."""
    d = table(spark, sf, "documents")
    cleaning.require_columns(d, "text", (LENGTH, Outcome("n_chars")), "doc_id")
    try:
        cleaning.require_columns(d, "text", (Outcome("absent"), Outcome("n_chars")), "doc_id")
        refused = None
    except ValueError as e:
        refused = str(e)
    return d.agg(F.count(F.lit(1)).alias("n"), F.lit(refused).cast("string").alias("refused"))


@query("p18_display_names", "SELECT source, upper(source[1]) || source[2:] AS display, count(*) AS n FROM documents GROUP BY source")
def p18(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("display", title("source"))


@query("k9_value_counts_ranked", "SELECT source AS value, count(*) AS n FROM documents GROUP BY source")
def k9(spark, sf):
    return out.category_shares(docs(spark, sf), "source").select("value", "n").orderBy(F.col("n").desc(), "value")


@query("u2_numeric_columns", "SELECT 'n_chars' AS \"column\", count(n_chars) AS present FROM documents UNION ALL SELECT 'doc_id', count(doc_id) FROM documents")
def u2(spark, sf):
    p = profiling.column_profile(table(spark, sf, "documents"))
    return p.where(F.col("kind").isin("integer", "number")).select("column", "present")
