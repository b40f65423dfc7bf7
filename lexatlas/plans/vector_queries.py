"""Queries over vectors: checks, scaling, joins, nearest neighbours, reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexatlas.functions.scalars import l2_normalised
from lexatlas.operators import clusters, ranking, vectors
from lexatlas.plans.catalog import query
from lexatlas.plans.frames import DOCS_SQL, LONG_SQL, POINTS_SQL, docs, final, points, rounded_sql, table

W = "WITH "


@query(
    "s4_vector_scan",
    rounded_sql("norm", "SELECT vec_id AS id, len(embedding)::INTEGER AS dim, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS norm FROM embeddings"),
)
def s4(spark, sf):
    e = table(spark, sf, "embeddings")
    return final(e.select(F.col("vec_id").alias("id"), F.size("embedding").alias("dim"), vectors.l2_norm("embedding").alias("norm")))


@query(
    "a18_vector_validation",
    rounded_sql(
        "mean_norm std_norm",
        """WITH n AS (SELECT len(embedding) AS d, list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) AS ss FROM embeddings)
        SELECT count(*) AS n_vectors, min(d) AS min_dim, max(d) AS max_dim, 0::BIGINT AS n_broken, count(*) FILTER (ss = 0) AS n_zero,
          count(*) FILTER (ss > 0) AS n_nonzero, avg(sqrt(ss)) AS mean_norm, stddev_pop(sqrt(ss)) AS std_norm, min(d) = max(d) AS valid FROM n""",
    ),
)
def a18(spark, sf):
    return final(vectors.vector_check(table(spark, sf, "embeddings")))


@query(
    "j7_vector_check",
    """SELECT (SELECT count(*) FROM documents JOIN embeddings ON doc_id = vec_id) AS n_matched,
      (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS n_missing_vectors,
      (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS n_orphan_vectors""",
)
def j7(spark, sf):
    return vectors.id_coverage(table(spark, sf, "documents"), table(spark, sf, "embeddings"), "doc_id", "vec_id")


@query("j1_join_vectors", rounded_sql("first", W + POINTS_SQL + " SELECT id, cluster_id, x AS first FROM points"))
def j1(spark, sf):
    d = docs(spark, sf).select("id")
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster_id"), "embedding")
    j = vectors.join_vectors(d, e, "id", "vec_id")
    return final(j.select("id", "cluster_id", F.col("embedding")[0].cast("double").alias("first")))


@query("j2_features_with_controls", rounded_sql("second last", W + POINTS_SQL + " SELECT id, 66 AS n_features, digit_count AS second, n_words AS last FROM points"))
def j2(spark, sf):
    f = vectors.with_controls(points(spark, sf), "embedding", ["n_words", "digit_count"])
    return final(f.select("id", F.size("features").alias("n_features"), F.col("features")[64].alias("second"), F.col("features")[65].alias("last")))


@query(
    "j5_merge_tables",
    rounded_sql("norm", "SELECT e.vec_id AS id, l.quality, sqrt(list_sum(list_transform(e.embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS norm FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id"),
)
def j5(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), vectors.l2_norm("embedding").alias("norm"))
    return final(e.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality"), "id"))


@query(
    "e3_l2_normalise",
    rounded_sql("value", """WITH n AS (SELECT vec_id AS id, embedding, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS norm FROM embeddings)
      SELECT id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pc, unnest(embedding)::DOUBLE / norm AS value FROM n"""),
)
def e3(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), l2_normalised("embedding").alias("v"))
    return final(ranking.long_view(e, "id", "v"))


@query(
    "r1_standardise",
    rounded_sql("value", W + LONG_SQL + """, s AS (SELECT pc, avg(value) AS m, stddev_pop(value) AS sd FROM long GROUP BY pc)
      SELECT id, pc, (value - m) / sd AS value FROM long JOIN s USING (pc)"""),
)
def r1(spark, sf):
    return final(ranking.long_view(vectors.standardised(points(spark, sf), "embedding"), "id", "scaled"))


_CUBE = POINTS_SQL + """, c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points),
  s AS (SELECT max(greatest(abs(x - cx), abs(y - cy), abs(z - cz))) AS scale FROM points, c)"""


@query("r6_unit_cube", rounded_sql("x y z", W + _CUBE + " SELECT id, (x - cx) / scale AS x, (y - cy) / scale AS y, (z - cz) / scale AS z FROM points, c, s"))
def r6(spark, sf):
    return final(vectors.unit_cube(points(spark, sf).select("id", "x", "y", "z")))


@query("a19_cloud_centre", rounded_sql("x y z", W + POINTS_SQL + " SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points"))
def a19(spark, sf):
    return final(vectors.cloud_centre(points(spark, sf)))


@query("a28_coordinate_range", rounded_sql("min max", W + POINTS_SQL + " SELECT min(least(x, y, z)) AS min, max(greatest(x, y, z)) AS max FROM points"))
def a28(spark, sf):
    return final(vectors.coordinate_range(points(spark, sf)))


@query(
    "a10_array_centroids",
    rounded_sql("value", W + LONG_SQL + " SELECT cluster_id, pc, avg(value) AS value FROM long GROUP BY cluster_id, pc"),
)
def a10(spark, sf):
    c = clusters.array_centroids(points(spark, sf), "embedding")
    return final(ranking.long_view(c, "cluster_id", "centroid"))
