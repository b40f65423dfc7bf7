"""Queries over topics and components: sizes, statistics, keywords, effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexatlas.functions.scalars import gather, narrow, wide
from lexatlas.functions.text import STOP_WORDS, URL_PATTERN, clean_text
from lexatlas.operators import clusters, effects, ranking, topics, vectors
from lexatlas.plans.catalog import query
from lexatlas.plans.frames import (
    DIGITS, DOCS_SQL, LENGTH, LONG_SQL, POINTS_SQL, SENTENCES, docs, final, measured_points, points, rounded_sql, t_tail_sql, table,
)
from lexatlas.spec import Outcome

W = "WITH "
TWO = ["sentence_count", "text_length"]
_MEMBERS = POINTS_SQL + """, m AS (SELECT cluster_id, 'sentence_count' AS outcome, sentence_count AS value FROM points
  UNION ALL SELECT cluster_id, 'text_length', text_length FROM points)"""


@query("a9_cluster_sizes", rounded_sql("share", "SELECT label AS cluster_id, count(*) AS size, count(*) / sum(count(*)) OVER () AS share FROM embeddings GROUP BY label"))
def a9(spark, sf):
    return final(clusters.cluster_sizes(table(spark, sf, "embeddings").select(F.col("label").alias("cluster_id"))))


@query(
    "a10_cluster_stats",
    rounded_sql(
        "mean std median",
        W + _MEMBERS + " SELECT cluster_id, outcome, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, median(value) AS median FROM m GROUP BY 1, 2",
    ),
)
def a10(spark, sf):
    return final(clusters.outcome_stats(measured_points(spark, sf), TWO))


_CENTRES = POINTS_SQL + ", c AS (SELECT cluster_id, count(*) AS size, avg(x) AS centroid_x, avg(y) AS centroid_y, avg(z) AS centroid_z FROM points GROUP BY 1)"


@query("a10_centroids", rounded_sql("centroid_x centroid_y centroid_z", W + _CENTRES + " SELECT * FROM c"))
def a10b(spark, sf):
    return final(clusters.centroids(points(spark, sf)))


@query(
    "a10_category_stats",
    W + POINTS_SQL + """, k AS (SELECT cluster_id, lang, count(*) AS n FROM points GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, lang) AS i, count(*) OVER (PARTITION BY cluster_id) AS diversity FROM k)
      SELECT cluster_id, 'lang' AS outcome, lang AS mode, diversity FROM r WHERE i = 1""",
)
def a10c(spark, sf):
    return clusters.category_stats(points(spark, sf), ["lang"])


_EXTREMES = """, q AS (SELECT {key}, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM m GROUP BY {key})
  SELECT cluster_id, outcome, any_value(p10) AS p10, any_value(p90) AS p90, avg((value >= p90)::INT) AS prob_high, avg((value <= p10)::INT) AS prob_low
  FROM m JOIN q USING ({key}) GROUP BY cluster_id, outcome"""


@query("a11_topic_extremes", rounded_sql("p10 p90 prob_high prob_low", W + _MEMBERS + _EXTREMES.format(key="cluster_id, outcome")))
def a11(spark, sf):
    return final(clusters.topic_extremes(measured_points(spark, sf), TWO))


@query("a11_topic_extremes_global", rounded_sql("p10 p90 prob_high prob_low", W + _MEMBERS + _EXTREMES.format(key="outcome")))
def a11b(spark, sf):
    return final(clusters.topic_extremes(measured_points(spark, sf), TWO, scope="global"))


_PRESENCE = POINTS_SQL + """, s AS (SELECT cluster_id, count(*) AS n, count(*) FILTER (digit_count <> 0) AS k,
    sum(digit_count) FILTER (digit_count <> 0) AS total FROM points GROUP BY 1),
  t AS (SELECT sum(n) AS n_all, sum(k) AS k_all FROM s),
  p AS (SELECT cluster_id, 'digit_count' AS outcome, k / n AS presence_rate, (k_all - k) / (n_all - n) AS outside_rate,
    (k / n) / nullif((k_all - k) / (n_all - n), 0) AS relative_risk, coalesce(total / nullif(k, 0), 0) AS magnitude FROM s, t)"""


@query("a12_topic_presence", rounded_sql("presence_rate outside_rate relative_risk magnitude", W + _PRESENCE + " SELECT * FROM p"))
def a12(spark, sf):
    return final(clusters.topic_presence(points(spark, sf), ["digit_count"]))


_IMPACT = _PRESENCE + """, q AS (SELECT cluster_id, quantile_cont(text_length, 0.1) AS p10, quantile_cont(text_length, 0.9) AS p90 FROM points GROUP BY 1),
  e AS (SELECT cluster_id, avg((text_length >= p90)::INT) AS hi, avg((text_length <= p10)::INT) AS lo FROM points JOIN q USING (cluster_id) GROUP BY 1),
  i AS (SELECT cluster_id, greatest(hi, lo, presence_rate) AS max_impact_prob, greatest(hi, lo, presence_rate, 1 - presence_rate) * 100 AS max_pct
    FROM e JOIN p USING (cluster_id))"""


@query(
    "a13_max_impact",
    rounded_sql("max_impact_prob max_pct impact", W + _IMPACT + " SELECT *, CASE WHEN max_impact_prob > 0 THEN max_impact_prob * 100 ELSE max_pct END AS impact FROM i"),
)
def a13(spark, sf):
    return final(clusters.ranked_by_impact(clusters.topic_impact(measured_points(spark, sf), (DIGITS, LENGTH))))


@query(
    "k1_largest_topics",
    "SELECT label AS cluster_id, count(*) AS size FROM embeddings GROUP BY label",
)
def k1(spark, sf):
    sizes = clusters.cluster_sizes(table(spark, sf, "embeddings").select(F.col("label").alias("cluster_id")))
    return sizes.select("cluster_id", "size").orderBy(F.col("size").desc(), "cluster_id")


@query(
    "k7_nearest_topics",
    rounded_sql(
        "x y z distance",
        W + _CENTRES + """, t AS (SELECT cluster_id AS topic_id, 'Topic ' || cluster_id AS label, centroid_x * 100 AS x, centroid_y * 100 AS y, centroid_z * 100 AS z, size FROM c)
        SELECT *, sqrt((x - 5) ** 2 + (y - 1) ** 2 + (z + 2) ** 2) AS distance FROM t ORDER BY distance, topic_id LIMIT 4""",
    ),
)
def k7(spark, sf):
    centres = clusters.centroids(points(spark, sf))
    labels = centres.select("cluster_id", F.concat(F.lit("Topic "), F.col("cluster_id").cast("string")).alias("keywords"))
    placed = clusters.topic_placement(labels, centres)
    return final(clusters.nearest_topics(placed, {"x": 5, "y": 1, "z": -2}, 4))


# -- text -------------------------------------------------------------------------------------------

_CLEAN = f"""trim(regexp_replace(regexp_replace(lower(text), '{URL_PATTERN}', '', 'g'), '[^a-z]+', ' ', 'g'))"""
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_TERMS = POINTS_SQL + f""", toks AS (SELECT cluster_id, list_filter(string_split({_CLEAN}, ' '), lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w)) AS w FROM points),
  terms AS (SELECT cluster_id, unnest(w) AS term FROM toks
    UNION ALL SELECT cluster_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM toks WHERE len(w) >= 2),
  tc AS (SELECT cluster_id, term, count(*) AS tf FROM terms GROUP BY 1, 2)"""
_TFIDF = _TERMS + """, nc AS (SELECT count(DISTINCT cluster_id) AS n FROM tc),
  v AS (SELECT term, count(*) AS df FROM tc, nc GROUP BY term, n HAVING count(*) >= CASE WHEN n < 10 THEN 1 ELSE 2 END AND count(*) <= 0.95 * n
    ORDER BY sum(tf) DESC, term LIMIT 1000),
  raw AS (SELECT cluster_id, term, tf, df, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tc JOIN v USING (term), nc),
  scored AS (SELECT cluster_id, term, tf, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY cluster_id)) AS score FROM raw)"""
_KEYWORDS = _TFIDF + """, best AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term) AS i FROM scored),
  kept AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY i) AS j FROM best WHERE i <= 10 AND score > 0 AND length(term) > 1),
  kw AS (SELECT cluster_id, string_agg(list_aggregate(list_transform(string_split(term, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' '), ' - ' ORDER BY i) AS keywords
    FROM kept WHERE j <= 5 GROUP BY 1)"""


@query("x1_clean_text", f"SELECT doc_id AS id, {_CLEAN} AS clean FROM documents")
def x1(spark, sf):
    return docs(spark, sf).select("id", clean_text("text").alias("clean"))


@query("x3_term_counts", W + _TERMS + " SELECT * FROM tc")
def x3(spark, sf):
    return topics.term_counts(points(spark, sf))


@query("x4_vocabulary", W + _TFIDF + " SELECT term, df FROM v")
def x4(spark, sf):
    counts = topics.term_counts(points(spark, sf))
    return topics.vocabulary(counts, counts.agg(F.count_distinct("cluster_id")).scalar())


@query("x5_ctfidf", rounded_sql("score", W + _TFIDF + " SELECT * FROM scored"))
def x5(spark, sf):
    return final(topics.class_tfidf(topics.term_counts(points(spark, sf))))


@query("x6_topic_keywords", W + _KEYWORDS + " SELECT * FROM kw")
def x6(spark, sf):
    return topics.extract_topics(points(spark, sf))


def topic_profile(spark, sf):
    """Topics with keywords, size and outcome statistics."""
    p = points(spark, sf)
    sizes = clusters.cluster_sizes(p)
    stats = clusters.outcome_stats(p, TWO)
    labelled = clusters.topic_labels(sizes.select("cluster_id", "size"), topics.extract_topics(p))
    return final(labelled.join(stats.drop("n"), "cluster_id"))


@query(
    "topic_profile",
    rounded_sql(
        "mean std median",
        W + _KEYWORDS + """, m AS (SELECT cluster_id, 'sentence_count' AS outcome, sentence_count AS value FROM points
            UNION ALL SELECT cluster_id, 'text_length', text_length FROM points),
          s AS (SELECT cluster_id, outcome, count(*) AS size, avg(value) AS mean, stddev_samp(value) AS std, median(value) AS median FROM m GROUP BY 1, 2)
          SELECT cluster_id, size, coalesce(keywords, 'Topic ' || cluster_id) AS keywords, outcome, mean, std, median FROM s LEFT JOIN kw USING (cluster_id)""",
    ),
)
def profile(spark, sf):
    return topic_profile(spark, sf)


@query(
    "x7_topic_placement",
    rounded_sql("x y z", W + _KEYWORDS + """, c AS (SELECT cluster_id, count(*) AS size, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points GROUP BY 1)
      SELECT cluster_id AS topic_id, keywords AS label, cx * 100 AS x, cy * 100 AS y, cz * 100 AS z, size FROM c JOIN kw USING (cluster_id)"""),
)
def x7(spark, sf):
    p = points(spark, sf)
    return final(clusters.topic_placement(topics.extract_topics(p), clusters.centroids(p)))


@query(
    "j4_topic_labels",
    """SELECT label AS cluster_id, count(*) AS size, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'Topic ' || label END AS keywords FROM embeddings GROUP BY label""",
)
def j4(spark, sf):
    sizes = clusters.cluster_sizes(table(spark, sf, "embeddings").select(F.col("label").alias("cluster_id"))).select("cluster_id", "size")
    named = sizes.where("cluster_id % 2 = 0").select("cluster_id", F.lit("even").alias("keywords"))
    return clusters.topic_labels(sizes, named)


# -- components -----------------------------------------------------------------------------------------


@query("w1_pc_percentile", rounded_sql("pct", W + LONG_SQL + " SELECT id, pc, value, (rank() OVER (PARTITION BY pc ORDER BY value) - 1) * 100.0 / count(*) OVER (PARTITION BY pc) AS pct FROM long").replace("* REPLACE (", "* REPLACE ((round(value, 6) + 0.0)::DOUBLE AS value, "))
def w1(spark, sf):
    return final(ranking.percentile_ranks(ranking.long_view(measured_points(spark, sf), "id", "embedding")))


@query(
    "w2_avg_rank_percentile",
    rounded_sql(
        "value pct",
        W + DOCS_SQL + """ SELECT id, 0 AS pc, digit_count AS value, (rank() OVER (ORDER BY digit_count) + (count(*) OVER (PARTITION BY digit_count) - 1) / 2.0)
          * 100.0 / count(*) OVER () AS pct FROM docs""",
    ),
)
def w2(spark, sf):
    d = docs(spark, sf).select("id", F.lit(0).alias("pc"), F.col("digit_count").alias("value"))
    return final(ranking.percentile_ranks(d, method="average"))


_TAIL = LONG_SQL + """, q AS (SELECT pc, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM long GROUP BY pc),
  o AS (SELECT quantile_cont(text_length, 0.1) AS t10, quantile_cont(text_length, 0.9) AS t90, quantile_cont(sentence_count, 0.1) AS s10,
    quantile_cont(sentence_count, 0.9) AS s90 FROM points),
  j AS (SELECT l.*, value >= p90 AS hi, value <= p10 AS lo, t10, t90, s10, s90 FROM long l JOIN q USING (pc), o)"""


def _effect(name: str, high: str, low: str, source: str = "j") -> str:
    return f"""SELECT pc, '{name}' AS outcome, 100.0 * avg(({high})::INT) FILTER (hi) AS high_if_high, 100.0 * avg(({high})::INT) FILTER (lo) AS high_if_low,
      100.0 * avg(({low})::INT) FILTER (hi) AS low_if_high, 100.0 * avg(({low})::INT) FILTER (lo) AS low_if_low FROM {source} GROUP BY pc"""


_E_S = _effect("sentence_count", "sentence_count >= s90", "sentence_count <= s10")
_E_T = _effect("text_length", "text_length >= t90", "text_length <= t10")
_DIFFS = "high_if_high - high_if_low AS high_diff, low_if_high - low_if_low AS low_diff"


@query(
    "a14_pc_effects",
    rounded_sql(
        "high_if_high high_if_low high_diff low_if_high low_if_low low_diff",
        W + _TAIL + f", e AS ({_E_S} UNION ALL {_E_T}) SELECT pc, outcome, high_if_high, high_if_low, {_DIFFS}, low_if_high, low_if_low FROM e",
    ),
)
def a14(spark, sf):
    e = effects.pc_effects(measured_points(spark, sf), (SENTENCES, LENGTH), "embedding")
    return final(e.drop("mode", "magnitude_high", "magnitude_low"))


@query(
    "a15_pc_presence_effects",
    rounded_sql(
        "high_if_high high_if_low high_diff low_if_high low_if_low low_diff magnitude_high magnitude_low",
        W + _TAIL + f""", e AS ({_effect('digit_count', 'digit_count <> 0', 'digit_count = 0')}),
          g AS (SELECT pc, coalesce(avg(digit_count) FILTER (hi AND digit_count <> 0), 0) AS magnitude_high,
            coalesce(avg(digit_count) FILTER (lo AND digit_count <> 0), 0) AS magnitude_low FROM j GROUP BY pc)
          SELECT pc, outcome, high_if_high, high_if_low, {_DIFFS}, low_if_high, low_if_low, magnitude_high, magnitude_low FROM e JOIN g USING (pc)""",
    ),
)
def a15(spark, sf):
    return final(effects.pc_effects(measured_points(spark, sf), (DIGITS,), "embedding").drop("mode"))


@query(
    "f8_extreme_table",
    rounded_sql(
        " ".join(f"{t}_{c}" for t in "yx" for c in ("high_if_high", "high_if_low", "high_diff", "low_if_high", "low_if_low", "low_diff", "gap_if_high", "gap_if_low")),
        W + _TAIL + f", a AS ({_E_S}), b AS ({_E_T}) SELECT pc, "
        + ", ".join(
            f"{s}.high_if_high AS {t}_high_if_high, {s}.high_if_low AS {t}_high_if_low, {s}.high_if_high - {s}.high_if_low AS {t}_high_diff, "
            f"{s}.low_if_high AS {t}_low_if_high, {s}.low_if_low AS {t}_low_if_low, {s}.low_if_high - {s}.low_if_low AS {t}_low_diff, "
            f"{s}.high_if_high - {s}.low_if_high AS {t}_gap_if_high, {s}.high_if_low - {s}.low_if_low AS {t}_gap_if_low"
            for t, s in (("y", "a"), ("x", "b"))
        )
        + " FROM a JOIN b USING (pc)",
    ),
)
def f8(spark, sf):
    e = effects.pc_effects(measured_points(spark, sf), (SENTENCES, LENGTH), "embedding")
    return final(effects.extreme_table(e, "sentence_count", "text_length"))


@query(
    "a16_pc_correlation",
    rounded_sql("corr", W + LONG_SQL + """ SELECT pc, 'sentence_count' AS outcome, corr(value, sentence_count) AS corr FROM long GROUP BY pc
      UNION ALL SELECT pc, 'text_length', corr(value, text_length) FROM long GROUP BY pc"""),
)
def a16(spark, sf):
    return final(effects.pc_correlations(points(spark, sf), TWO, "embedding"))


_ASSOC = LONG_SQL + """, r AS (SELECT pc, cluster_id, value, (rank() OVER (PARTITION BY pc ORDER BY value)
    + (count(*) OVER (PARTITION BY pc, value) - 1) / 2.0) * 100.0 / count(*) OVER (PARTITION BY pc) AS pct FROM long),
  g AS (SELECT pc, cluster_id AS topic_id, count(*) AS n, avg(pct) AS ap, stddev_pop(pct) AS sp, avg(value) AS m, var_samp(value) AS v FROM r GROUP BY 1, 2),
  o AS (SELECT g.pc, topic_id, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM g JOIN r ON g.pc = r.pc AND g.topic_id <> r.cluster_id GROUP BY 1, 2),
  a AS (SELECT g.pc, g.topic_id, g.n AS size, ap AS avg_percentile, sp AS std_percentile, g.m AS topic_mean, o.m AS non_topic_mean,
    (g.m - o.m) / sqrt(g.v / g.n + o.v / o.n) AS t_statistic,
    (g.v / g.n + o.v / o.n) ** 2 / ((g.v / g.n) ** 2 / (g.n - 1) + (o.v / o.n) ** 2 / (o.n - 1)) AS welch_df
    FROM g JOIN o ON g.pc = o.pc AND g.topic_id = o.topic_id)"""


@query(
    "a23_topic_pc_association",
    rounded_sql("avg_percentile std_percentile topic_mean non_topic_mean t_statistic welch_df", W + _ASSOC + " SELECT * FROM a"),
)
def a23(spark, sf):
    return final(effects.topic_associations(measured_points(spark, sf), "embedding").drop("p_value", "rank"))


@query("k3_ranked_associations", W + _ASSOC + " SELECT pc, topic_id, row_number() OVER (PARTITION BY pc ORDER BY round(avg_percentile, 9) DESC, topic_id) AS rank FROM a")
def k3(spark, sf):
    return effects.topic_associations(measured_points(spark, sf), "embedding").select("pc", "topic_id", "rank")


@query(
    "t1_association_p_values",
    rounded_sql("t_statistic p_value", W + _ASSOC + f" SELECT pc, topic_id, t_statistic, {t_tail_sql('t_statistic', 'welch_df')} AS p_value FROM a"),
)
def t1(spark, sf):
    return final(effects.topic_associations(measured_points(spark, sf), "embedding").select("pc", "topic_id", "t_statistic", "p_value"))


_GROUPS = LONG_SQL + ", t AS (SELECT pc, sum(value) AS total, count(*) AS n FROM long GROUP BY pc)"


@query(
    "j8_complement_means",
    rounded_sql("inside outside", W + _GROUPS + """ SELECT long.pc, cluster_id, avg(value) AS inside, (any_value(total) - sum(value)) / (any_value(n) - count(*)) AS outside
      FROM long JOIN t USING (pc) GROUP BY long.pc, cluster_id"""),
)
def j8(spark, sf):
    a = effects.topic_associations(measured_points(spark, sf), "embedding")
    return final(a.select("pc", F.col("topic_id").alias("cluster_id"), F.col("topic_mean").alias("inside"), F.col("non_topic_mean").alias("outside")))


@query("j9_selected_components", rounded_sql("value", W + LONG_SQL + " SELECT id, pc, value FROM long WHERE pc IN (1, 5, 8, 13)"))
def j9(spark, sf):
    picked = points(spark, sf).select("id", gather("embedding", [1, 5, 8, 13]).alias("v"))
    pcs = F.array(*[F.lit(i) for i in (1, 5, 8, 13)])
    return final(picked.select("id", F.inline(F.arrays_zip(pcs.alias("pc"), F.col("v").alias("value")))).select("id", "pc", F.col("value").cast("double").alias("value")))


@query(
    "j10_component_tails",
    W + _TAIL + " SELECT pc, count(*) FILTER (hi) AS n_high, count(*) FILTER (lo) AS n_low FROM j GROUP BY pc",
)
def j10(spark, sf):
    long = ranking.long_view(measured_points(spark, sf), "id", "embedding")
    tails = ranking.quantiles(long, ["pc"], "value", {"p10": 0.1, "p90": 0.9})
    return long.join(F.broadcast(tails), "pc").groupBy("pc").agg(  # one row per component
        F.count_if(F.col("value") >= F.col("p90")).alias("n_high"), F.count_if(F.col("value") <= F.col("p10")).alias("n_low")
    )


_DIM = 64  # of the vectors in the table


@query(
    "p19_wide_columns",
    rounded_sql(" ".join(f"emb_{i}" for i in range(_DIM)), "SELECT vec_id AS id, " + ", ".join(f"embedding[{i + 1}] AS emb_{i}" for i in range(_DIM)) + " FROM embeddings"),
)
def p19(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *wide("embedding", _DIM, "emb_"))
    back = e.select("id", narrow("emb_", _DIM).alias("v"))
    return final(back.select("id", *wide("v", _DIM, "emb_")))


@query(
    "w6_cumulative_variance",
    rounded_sql("variance cumulative", W + LONG_SQL + ", v AS (SELECT pc, var_pop(value) AS variance FROM long GROUP BY pc) SELECT pc, variance, sum(variance) OVER (ORDER BY pc) AS cumulative FROM v"),
)
def w6(spark, sf):
    long = ranking.long_view(measured_points(spark, sf), "id", "embedding")
    return final(ranking.running_share(long.groupBy("pc").agg(F.var_pop("value").alias("variance"))))


@query("k2_ranked_topics", W + _IMPACT + " SELECT cluster_id, row_number() OVER (ORDER BY max_impact_prob * 100 DESC, cluster_id) AS place FROM i")
def k2(spark, sf):
    ranked = clusters.ranked_by_impact(clusters.topic_impact(measured_points(spark, sf), (DIGITS, LENGTH)))
    return ranking.importance_ranks(ranked, [], "cluster_id", "impact").select("cluster_id", F.col("rank").alias("place"))


@query("k6_top_terms", W + _TFIDF + """, b AS (SELECT cluster_id, term, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term) AS place FROM scored)
  SELECT * FROM b WHERE place <= 10""")
def k6(spark, sf):
    scores = topics.class_tfidf(topics.term_counts(points(spark, sf)))
    return topics.top_terms(scores, 10)


@query("x2_class_sizes", W + _TERMS + " SELECT cluster_id, sum(tf)::BIGINT AS n_terms FROM tc GROUP BY cluster_id")
def x2(spark, sf):
    return topics.term_counts(points(spark, sf)).groupBy("cluster_id").agg(F.sum("tf").alias("n_terms"))


@query("j3_keywords_with_stats", W + _KEYWORDS + ", c AS (SELECT cluster_id, count(*) AS size FROM points GROUP BY 1) SELECT cluster_id, keywords, size FROM kw JOIN c USING (cluster_id)")
def j3(spark, sf):
    p = points(spark, sf)
    return topics.extract_topics(p).join(clusters.cluster_sizes(p).select("cluster_id", "size"), "cluster_id")


@query("w13_global_rank", W + LONG_SQL + """, v AS (SELECT pc, var_pop(value) AS s FROM long GROUP BY pc)
  SELECT pc, row_number() OVER (ORDER BY s DESC, pc) AS rank FROM v""")
def w13(spark, sf):
    long = ranking.long_view(measured_points(spark, sf), "id", "embedding")
    return ranking.importance_ranks(long.groupBy("pc").agg(F.var_pop("value").alias("s")), [], "pc", "s").select("pc", "rank")
