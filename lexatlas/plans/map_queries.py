"""Queries over neighbours, the map, clusters, embedding, sinks, state and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from lexatlas.functions.scalars import doubles
from lexatlas.operators import approximate, categories, clusters, density, encode, layout, neighbours, placement, points as pts, ranking, reduce
from lexatlas.operators.outcomes import thresholds
from lexatlas.plans.catalog import query
from lexatlas.plans.frames import LENGTH, POINTS_SQL, SENTENCES, docs, final, points, rounded_sql, table
from lexatlas.plans.stages import Stages
from lexatlas.session import cut, shared_dir
from lexatlas.sources import readers, sinks
from lexatlas.spec import AnalysisSpec
from lexatlas.streaming import scoring

W = "WITH "
#: Points of a block in the queries: the test tables then have eight cells and more.
CELL = 62


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _fresh(spark) -> str:
    return f"{shared_dir(spark)}/lexatlas-query-{uuid.uuid4().hex}"


_V = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda a: a::DOUBLE) AS e FROM embeddings)"""


def _knn(distance: str) -> str:
    return W + _V + f""", d AS (SELECT a.id AS src, b.id AS dst, {distance} AS dist FROM v a JOIN v b ON a.id <> b.id),
      r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM d) SELECT * FROM r WHERE rank <= 10"""


@query("j11_knn_cosine", rounded_sql("dist", _knn("1 - list_cosine_similarity(a.e, b.e)")))
def j11(spark, sf):
    return final(neighbours.nearest_neighbours(_vectors(spark, sf), 10, "id", "embedding", "cosine", CELL))


@query("j11_knn_euclidean", rounded_sql("dist", _knn("list_distance(a.e, b.e)")))
def j11b(spark, sf):
    return final(neighbours.nearest_neighbours(_vectors(spark, sf), 10, "id", "embedding", "euclidean", CELL))


_RHO = _knn("1 - list_cosine_similarity(a.e, b.e)")


@query(
    "r5_directed_weights",
    rounded_sql("nearest", f"SELECT src, min(dist) AS nearest, 1::BIGINT AS n_full FROM ({_RHO}) GROUP BY src"),
)
def r5a(spark, sf):
    """Local scaling: the weight of the nearest neighbour is 1 and the weights add up to log2(k)."""
    edges = cut(neighbours.nearest_neighbours(_vectors(spark, sf), 10, "id", "embedding", "cosine", CELL))
    w = layout.local_scaling(edges, 10)
    full = w.groupBy("src").agg(F.count_if(F.col("w") > 1 - 1e-12).alias("n_full"), F.sum("w").alias("_s"))
    full = full.where(F.abs(F.col("_s") - F.log2(F.lit(10.0))) < 1e-3)
    return final(edges.groupBy("src").agg(F.min("dist").alias("nearest")).join(full.select("src", "n_full"), "src"))


@query(
    "j11_approximate_recall",
    "SELECT 10 * count(*)::BIGINT AS n, true AS recalled, true AS ends FROM embeddings",
)
def j11c(spark, sf):
    """At least 0.95 of the exact neighbours are found, and the rounds end because hardly anything changes."""
    found = approximate.approximate_neighbours(_vectors(spark, sf), 10, "id", "embedding", "cosine", bucket=CELL, largest=4 * CELL)
    exact = neighbours.nearest_neighbours(_vectors(spark, sf), 10, "id", "embedding", "cosine", CELL)
    last = F.lit(found.rounds[-1][1] < approximate.ENOUGH)
    return approximate.recall(found.neighbours, exact).select("n", (F.col("recall") >= 0.95).alias("recalled"), last.alias("ends"))


@query(
    "j11_approximate_lists",
    rounded_sql("dist", W + _V + """, d AS (SELECT a.id AS src, min(1 - list_cosine_similarity(a.e, b.e)) AS dist FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id)
      SELECT src, dist, 10::BIGINT AS n, 10::BIGINT AS n_different, true AS in_order, true AS exact FROM d"""),
)
def j11d(spark, sf):
    """Every row has ten different others, in order, with their true distances; the nearest of all is among them."""
    v = _vectors(spark, sf)
    found = approximate.approximate_neighbours(v, 10, "id", "embedding", "cosine", tables=8, bucket=CELL, largest=4 * CELL).neighbours
    one = lambda side: v.select(F.col("id").alias(side), F.transform("embedding", lambda x: x.cast("double")).alias(f"_{side}"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    true = 1 - dot("_src", "_dst") / F.sqrt(dot("_src", "_src") * dot("_dst", "_dst"))
    checked = found.join(one("src"), "src").join(one("dst"), "dst").withColumn("ok", F.abs(true - F.col("dist")) < 1e-9)
    lists = checked.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dist", "dst"))).alias("l"), F.bool_and("ok").alias("exact"))
    size = lambda c: F.size(c).cast("bigint")
    return final(lists.select(
        "src", F.col("l")[0]["dist"].alias("dist"), size("l").alias("n"), size(F.array_distinct("l.dst")).alias("n_different"),
        (F.array_sort("l.dist") == F.col("l.dist")).alias("in_order"), "exact",
    ))


_SIGMA = """, g AS (SELECT src, list(dst ORDER BY rank) AS dsts, list(dist ORDER BY rank) AS ds FROM n GROUP BY src),
  h AS (SELECT src, dsts, ds, list_transform(ds, lambda d: greatest(d - coalesce(list_min(list_filter(ds, lambda x: x > 0)), 0), 0)) AS gap FROM g),
  b AS (SELECT src, dsts, ds, gap, list_reduce(list_prepend({'lo': 0.0::DOUBLE, 'hi': 'inf'::DOUBLE, 's': 1.0::DOUBLE}, list_transform(range(64), lambda i: {'lo': i::DOUBLE, 'hi': 0.0::DOUBLE, 's': 0.0::DOUBLE})),
    lambda a, x: CASE WHEN abs(list_sum(list_transform(gap, lambda q: exp(-q / a.s))) - log2(10)) < 1e-5 THEN a
      WHEN list_sum(list_transform(gap, lambda q: exp(-q / a.s))) > log2(10) THEN {'lo': a.lo, 'hi': a.s, 's': (a.lo + a.s) / 2}
      ELSE {'lo': a.s, 'hi': a.hi, 's': CASE WHEN isinf(a.hi) THEN a.s * 2 ELSE (a.s + a.hi) / 2 END} END).s AS sigma FROM h),
  w AS (SELECT src, unnest(dsts) AS dst, unnest(list_transform(gap, lambda q: exp(-q / greatest(sigma, 1e-3 * list_avg(ds))))) AS w FROM b)"""


@query(
    "r5_fuzzy_union",
    rounded_sql("w", f"WITH n AS ({_RHO})" + _SIGMA + """, u AS (SELECT src, dst, w FROM w UNION ALL SELECT dst, src, w FROM w)
      SELECT src, dst, sum(w) - CASE WHEN count(*) > 1 THEN min(w) * max(w) ELSE 0 END AS w FROM u GROUP BY src, dst"""),
)
def r5b(spark, sf):
    edges = neighbours.nearest_neighbours(_vectors(spark, sf), 10, "id", "embedding", "cosine", CELL)
    return final(layout.fuzzy_union(layout.local_scaling(edges, 10)))


@query(
    "r5_eigen_equation",
    "SELECT unnest(range(0, 3))::INTEGER AS axis, (SELECT count(*) FROM embeddings)::BIGINT AS n, true AS holds, true AS unit, true AS reported",
)
def r5c(spark, sf):
    """The graph times an axis is its eigenvalue times the axis, up to the tolerance, and the residual is the one that is reported."""
    edges = neighbours.nearest_neighbours(_vectors(spark, sf), 10, "id", "embedding", "cosine", CELL)
    graph = cut(layout.fuzzy_union(layout.local_scaling(edges, 10)))
    made = layout.spectral_coordinates(graph, 3)
    axes = made.axes.select("id", F.posexplode(F.array("c0", "c1", "c2")).alias("axis", "x"))
    degree = graph.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg"))
    scaled = graph.join(degree.withColumnRenamed("id", "src"), "src").join(degree.select(F.col("id").alias("dst"), F.col("deg").alias("_d")), "dst")
    moved = scaled.join(axes.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "axis").agg(F.sum(F.col("w") / F.sqrt(F.col("deg") * F.col("_d")) * F.col("x")).alias("ax"))
    both = moved.join(axes, ["id", "axis"]).join(F.broadcast(made.convergence_table()), "axis")
    sums = both.groupBy("axis").agg(
        F.count("*").alias("n"), F.sqrt(F.sum((F.col("ax") - F.col("eigenvalue") * F.col("x")) ** 2)).alias("r"), F.sum(F.col("x") ** 2).alias("s"), F.first("residual").alias("residual")
    )
    return sums.select("axis", "n", (F.col("r") <= layout.TOLERANCE * 1.001).alias("holds"), (F.abs(F.col("s") - 1) < 1e-9).alias("unit"), (F.abs(F.col("r") - F.col("residual")) < 1e-6).alias("reported"))


@query("r5_layout", "SELECT count(*)::BIGINT AS n, true AS centred, 1.0::DOUBLE AS largest FROM embeddings")
def r5(spark, sf):
    """The map is centred and its largest coordinate is 1."""
    points = layout.layout(_vectors(spark, sf), "embedding", "id", 3, 10).points
    mean = F.greatest(*[F.abs(F.avg(a)) for a in "xyz"])
    return final(points.agg(F.count("*").alias("n"), (mean < 1e-9).alias("centred"), F.greatest(*[F.max(F.abs(a)) for a in "xyz"]).alias("largest")))


@query(
    "r4_new_coordinates",
    rounded_sql("x y z", W + _V + """, o AS (SELECT * FROM v WHERE id % 4 <> 0),
      d AS (SELECT a.id, b.id AS nid, b.e[1] AS x, b.e[2] AS y, b.e[3] AS z, 1 - list_cosine_similarity(a.e, b.e) AS dist FROM v a JOIN o b ON true),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS k FROM d QUALIFY k <= 10),
      m AS (SELECT *, min(dist) OVER (PARTITION BY id) AS least, avg(dist) OVER (PARTITION BY id) - min(dist) OVER (PARTITION BY id) AS gap FROM r),
      w AS (SELECT *, CASE WHEN least <= 1e-9 THEN (dist <= 1e-9)::INTEGER::DOUBLE WHEN gap > 0 THEN exp(-(dist - least) / gap) ELSE 1.0 END AS w FROM m)
      SELECT id, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y, sum(w * z) / sum(w) AS z FROM w GROUP BY id"""),
)
def r4c(spark, sf):
    """Three quarters of the documents are on the map, by their first three positions; all are placed, those on it where they are."""
    v = _vectors(spark, sf)
    known = v.where("id % 4 <> 0").select("id", "embedding", *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])
    return final(placement.new_coordinates(known, v, "embedding", block=CELL))


@query(
    "c1_spanning_tree",
    rounded_sql("weight", W[:-1] + " RECURSIVE " + _V + """, p AS (SELECT min(id) AS id, count(*) AS m, e FROM v GROUP BY e),
      c AS (SELECT a.id, (SELECT list_sort(list(list_distance(a.e, b.e)))[3] FROM v b WHERE b.id <> a.id) AS core FROM p a),
      w AS (SELECT a.id AS a, b.id AS b, greatest(list_distance(a.e, b.e), ca.core, cb.core) AS w FROM p a JOIN p b ON a.id <> b.id JOIN c ca ON ca.id = a.id JOIN c cb ON cb.id = b.id),
      t AS (
        SELECT 0 AS step, b AS id, w AS best, NULL::DOUBLE AS taken FROM w WHERE a = (SELECT min(id) FROM p)
        UNION ALL
        SELECT step + 1, q.id, least(q.best, w.w), q.first FROM (
          SELECT *, min(best) OVER () AS first, arg_min(id, best) OVER () AS next FROM t) AS q JOIN w ON w.a = q.next AND w.b = q.id),
      s AS (SELECT step, min(best) AS best FROM t GROUP BY step)
      SELECT count(*)::BIGINT AS edges, sum(best) AS weight FROM s"""),
)
def c1b(spark, sf):
    """The spanning tree of the mutual reachability: its number of edges and total length are those of the complete graph's."""
    index = neighbours.build_index(_vectors(spark, sf), "id", "embedding", 8, False, CELL)
    near = cut(neighbours.point_neighbours(index, 8))
    tree = density.spanning_tree(index, near, cut(density.core_distances(index, near, 8, 3)))
    return final(tree.agg(F.count("*").alias("edges"), F.sum("w").alias("weight")))


@query("c1_density_clusters", "SELECT count(*)::BIGINT AS n, true AS large_enough, true AS in_order, true AS dense, true AS complete FROM embeddings")
def c1(spark, sf):
    """Every row has one label; clusters have ten rows at least and are numbered from 0 by size; the parts of the tree are finished by several tasks."""
    labels = cut(density.density_clusters(_vectors(spark, sf), "id", "embedding", 10, 3, CELL, in_task=4))
    sizes = labels.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy(F.lit(0)).orderBy("cluster_id"))
    facts = sizes.withColumn("_before", before).agg(
        F.coalesce(F.bool_and(F.col("n") >= 10), F.lit(True)).alias("large_enough"), F.coalesce(F.bool_and(F.coalesce(F.col("n") <= F.col("_before"), F.lit(True))), F.lit(True)).alias("in_order"),
        (F.count("*") == F.coalesce(F.max("cluster_id") + 1, F.lit(0))).alias("dense"),
    )
    rows = labels.agg(F.count("*").alias("n"), (F.countDistinct("id") == F.count("*")).alias("complete"))
    return rows.join(facts).select("n", "large_enough", "in_order", "dense", "complete")


@query("r2_component_scores")
def r2(spark, sf):
    v = _vectors(spark, sf)
    fitted = reduce.fit_reduction(v, "embedding")
    return final(ranking.long_view(fitted.transform(v, "embedding"), "id", "pc"))


_Z = """l AS (SELECT vec_id AS id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
  s AS (SELECT d, avg(x) AS m, stddev_pop(x) AS sd FROM l GROUP BY d),
  z AS (SELECT id, d, CASE WHEN sd > 0 THEN (x - m) / sd ELSE 0 END AS z FROM l JOIN s USING (d))"""


@query("r2_score_norms", rounded_sql("norm", W + _Z + " SELECT id, sum(z * z) AS norm FROM z GROUP BY id"))
def r2c(spark, sf):
    """All components are a rotation of the standardised vector: the squared length of every row stays."""
    v = _vectors(spark, sf)
    scores = reduce.fit_reduction(v, "embedding").transform(v, "embedding")
    return final(scores.select("id", F.aggregate("pc", F.lit(0.0), lambda s, x: s + x * x).alias("norm")))


@query(
    "a17_variance_moments",
    rounded_sql("total squares cubes", W + _Z + """, c AS (SELECT a.d AS i, b.d AS j, sum(a.z * b.z) AS v FROM z a JOIN z b USING (id) GROUP BY 1, 2),
      t AS (SELECT sum(v) AS total FROM c WHERE i = j)
      SELECT 1.0::DOUBLE AS total, (SELECT sum(v * v) FROM c) / total ** 2 AS squares,
        (SELECT sum(a.v * b.v * e.v) FROM c a JOIN c b ON a.j = b.i JOIN c e ON b.j = e.i AND e.j = a.i) / total ** 3 AS cubes FROM t"""),
)
def a17b(spark, sf):
    """Sums of powers of the variance ratios are traces of powers of the covariance."""
    v = F.col("variance")
    var = reduce.fit_reduction(_vectors(spark, sf), "embedding").variance_table(spark)
    return final(var.agg(F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.sum(v * v * v).alias("cubes")))


@query("r3_orthonormal", "SELECT a.i::INTEGER AS a, b.i::INTEGER AS b, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END::DOUBLE AS dot FROM (SELECT unnest(range(0, (SELECT max(len(embedding)) FROM embeddings))) AS i) a, (SELECT unnest(range(0, (SELECT max(len(embedding)) FROM embeddings))) AS i) b")
def r3b(spark, sf):
    """Products of the loadings of every two components."""
    rows = reduce.fit_reduction(_vectors(spark, sf), "embedding").loadings_table(spark)
    other = rows.select("dim", F.col("pc").alias("b"), F.col("loading").alias("_other"))
    return final(rows.join(other, "dim").groupBy(F.col("pc").alias("a"), "b").agg(F.sum(F.col("loading") * F.col("_other")).alias("dot")))


@query("r4_saved_equals_fitted", "SELECT vec_id AS id, len(embedding)::BIGINT AS equal FROM embeddings")
def r4b(spark, sf):
    """Components of every row that the saved and reloaded model scores as the fitted one does."""
    v = _vectors(spark, sf)
    path = _fresh(spark)
    fitted = reduce.fit_reduction(v, "embedding")
    fitted.save(spark, path)
    scored = reduce.Reduction.load(spark, path).transform(fitted.transform(v, "embedding", "first"), "embedding", "second")
    same = F.filter(F.zip_with("first", "second", lambda x, y: F.abs(x - y) < 1e-9), lambda b: b)
    return scored.select("id", F.size(same).cast("bigint").alias("equal"))


@query("a17_explained_variance")
def a17(spark, sf):
    return final(reduce.fit_reduction(_vectors(spark, sf), "embedding", 200).variance_table(spark))


@query("r2_total_variance", "SELECT least(max(len(embedding)), count(*) - 1)::BIGINT AS k, 1.0::DOUBLE AS total FROM embeddings")
def r2b(spark, sf):
    """With all components the variance ratios add up to 1."""
    var = reduce.fit_reduction(_vectors(spark, sf), "embedding", 200).variance_table(spark)
    return final(var.agg(F.count(F.lit(1)).alias("k"), F.sum("variance").alias("total")))


@query("r3_loadings")
def r3(spark, sf):
    return final(reduce.fit_reduction(_vectors(spark, sf), "embedding").loadings_table(spark))


@query("r4_transform_saved_model")
def r4(spark, sf):
    v = _vectors(spark, sf)
    path = _fresh(spark)
    reduce.fit_reduction(v, "embedding").save(spark, path)
    return final(ranking.long_view(reduce.Reduction.load(spark, path).transform(v, "embedding"), "id", "pc"))


@query("e1_embed_documents", "SELECT doc_id AS id, true AS embed_ok, 64::INTEGER AS dim FROM documents")
def e1(spark, sf):
    e = encode.embed(docs(spark, sf).select("id", "text"), 64, prefix=encode.PREFIXES["passage"])
    return final(e.select("id", "embed_ok", F.size("embedding").alias("dim")))


@query("e1_encode_once", "SELECT count(*)::BIGINT AS n, count(DISTINCT text)::BIGINT AS encoded, count(*)::BIGINT AS equal FROM documents WHERE text IS NOT NULL")
def e1b(spark, sf):
    """Equal texts reach the encoder once; every row gets the vector that it would have got alone."""
    seen = spark.sparkContext.accumulator(0)

    def counting():
        inner = encode.hashing_encoder(64)()

        def count(texts):
            seen.add(len(texts))
            return inner(texts)

        return count

    d = docs(spark, sf).select("id", "text")
    once = cut(encode.embed_distinct(d, 64, counting, prefix=encode.PREFIXES["passage"]))
    encoded = seen.value
    each = encode.embed(d, 64, prefix=encode.PREFIXES["passage"]).select("id", F.col("embedding").alias("_e"))
    same = once.join(each, "id").where(F.col("embedding") == F.col("_e"))
    return once.agg(F.count("*").alias("n"), F.lit(encoded).cast("bigint").alias("encoded")).join(same.agg(F.count("*").alias("equal")))


def _no_digits():
    """An encoder that refuses every batch with a digit in it."""
    inner = encode.hashing_encoder(64)()

    def refuse(texts):
        if any(c in t for t in texts for c in "0123456789"):
            raise ValueError("digit")
        return inner(texts)

    return refuse


@query(
    "e2_embed_failures",
    rounded_sql("failed_share", """SELECT count(*) AS n, count(*) FILTER (regexp_matches(text, '[0-9]')) AS n_failed,
      count(*) FILTER (regexp_matches(text, '[0-9]')) / count(*)::DOUBLE AS failed_share FROM documents"""),
)
def e2(spark, sf):
    return final(encode.failure_summary(encode.embed(docs(spark, sf).select("id", "text"), 64, _no_digits)))


@query("s5_vector_roundtrip", rounded_sql("total", "SELECT vec_id AS id, list_sum(list_transform(embedding, lambda a: a::DOUBLE)) AS total FROM embeddings"))
def s5(spark, sf):
    path = _fresh(spark)
    readers.write_vectors(_vectors(spark, sf), path)
    back = readers.read_vectors(spark, path)
    return final(back.select("id", F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x).alias("total")))


@query("s7_export_tables", "SELECT 'category_counts' AS \"table\", '07_points' AS folder, true AS ok, count(DISTINCT lang) AS rows FROM documents "
       "UNION ALL SELECT 'id_mapping', '01_raw', true, count(*) FROM documents")
def s7(spark, sf):
    d = docs(spark, sf)
    tables = {
        "category_counts": d.groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("n")),
        "id_mapping": d.select("id", "text"),
    }
    status = sinks.export_tables(tables, _fresh(spark), AnalysisSpec(exclude_text=True, anonymize_ids=True))
    return status.select("table", "folder", "ok", "rows")


@query("s8_failed_export", "SELECT 'broken' AS \"table\", false AS ok UNION ALL SELECT 'id_mapping', true")
def s8(spark, sf):
    d = docs(spark, sf).select("id")
    broken = d.select(F.raise_error(F.lit("broken on purpose")).cast("string").alias("x"))
    status = sinks.export_tables({"broken": broken, "id_mapping": d}, _fresh(spark), AnalysisSpec())
    return status.select("table", "ok")


@query("s9_manifest", "SELECT count(*) AS rows, 'review_id' AS id, 'true' AS exclude_text, '7' AS n_clusters, true AS dated FROM documents")
def s9(spark, sf):
    path = _fresh(spark)
    spec = AnalysisSpec(id="review_id", exclude_text=True)
    sinks.write_manifest(spark, path, spec, readers.row_count(table(spark, sf, "documents")), {"n_clusters": 7})
    held = lambda column, key: F.get_json_object(column, f"$.{key}").alias(key)
    row = spark.read.json(f"{path}/manifest")
    return row.select("rows", held("spec", "id"), held("spec", "exclude_text"), held("chosen", "n_clusters"), F.col("created").rlike(r"^\d{4}-\d\d-\d\dT").alias("dated"))


@query("p7_export_has_no_raw_ids", "SELECT doc_id AS id, 0::BIGINT AS n FROM documents WHERE false")
def p7_export(spark, sf):
    """Ids of documents found in any column of an anonymised export: none."""
    d = points(spark, sf).withColumn("category", F.col("lang"))
    order = cut(categories.browse_order(d.select("id", "category", "x", "y", "z")))
    tables = {"points": pts.flat(d.select("id", "category", "x", "y")), "browse_order": categories.browse_neighbours(order), "documents": table(spark, sf, "documents")}
    path = _fresh(spark)
    sinks.export_tables(tables, path, AnalysisSpec(id="doc_id", exclude_text=True, anonymize_ids=True), counts=False)
    found = None
    for name in tables:
        df = spark.read.parquet(f"{path}/{sinks.folder_of(name)}/{name}")
        cells = F.array(*[F.col(c).cast("string") for c, t in df.dtypes if c.endswith("id") and c != "cluster_id"])
        part = df.select(F.explode(cells).alias("id"))
        found = part if found is None else found.unionByName(part)
    ids = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return found.join(ids, "id").groupBy(F.col("id").cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("s11_state_roundtrip", "SELECT count(*) AS n, sum(quality)::BIGINT AS quality FROM labels")
def s11(spark, sf):
    path = _fresh(spark)
    sinks.save_state({"labels": table(spark, sf, "labels")}, path, AnalysisSpec())
    tables, _ = sinks.load_state(spark, path)
    return tables["labels"].agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("quality"))


@query(
    "s12_checksum",
    """SELECT count(*) AS n, sum(('0x' || substr(md5(doc_id || '|' || lang || '|' || source || '|' || n_chars), 1, 15))::HUGEINT)::VARCHAR AS checksum FROM documents""",
)
def s12(spark, sf):
    return sinks.text_checksum(table(spark, sf, "documents"), ["doc_id", "lang", "source", "n_chars"])


@query(
    "s12_row_checksum",
    """SELECT count(*) AS n, sum(('0x' || substr(md5(json_object('doc_id', doc_id, 'lang', lang, 'n_chars', n_chars, 'source', source, 'text', text)::VARCHAR), 1, 15))::HUGEINT)::VARCHAR AS checksum
      FROM documents""",
)
def s12b(spark, sf):
    return sinks.checksum(table(spark, sf, "documents"))


def _scorer(spark, sf):
    d = docs(spark, sf)
    vec = cut(encode.embed(d.select("id", "text"), 64))
    fitted = reduce.fit_reduction(vec, "embedding")
    scored = fitted.transform(vec).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id")), "id")
    pair = (SENTENCES, LENGTH)
    return scoring.fit_scorer(fitted, scored, thresholds(d, pair), pair, 64)


def _nearest(scored, centres):
    """(id, category, embed_ok, nearest): whether no centre is nearer than that of topic_id."""
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    every = F.broadcast(centres.agg(F.collect_list(F.struct("topic_id", "centre")).alias("_all")))  # a handful of topics in the test tables
    met = scored.join(every).withColumn("_d", F.transform("_all", lambda c: F.struct(far(F.col("pc"), c["centre"]).alias("d"), c["topic_id"].alias("t"))))
    own = F.element_at(F.filter("_d", lambda e: e["t"] == F.col("topic_id")), 1)["d"]
    return met.select("id", "category", "embed_ok", F.coalesce(own <= F.array_min(F.col("_d.d")) + 1e-9, F.lit(False)).alias("nearest"))


_SCORED = W + """docs AS (SELECT doc_id AS id, length(text)::DOUBLE AS text_length, len(regexp_extract_all(text, '[.!?]+'))::DOUBLE AS sentence_count FROM documents),
      t AS (SELECT quantile_cont(sentence_count, 0.25) AS l1, quantile_cont(sentence_count, 0.75) AS h1, quantile_cont(text_length, 0.25) AS l2, quantile_cont(text_length, 0.75) AS h2 FROM docs)
      SELECT id, CASE WHEN sentence_count > h1 AND text_length > h2 THEN 'both_high' WHEN sentence_count > h1 AND text_length < l2 THEN 'first_high'
        WHEN sentence_count < l1 AND text_length > h2 THEN 'second_high' WHEN sentence_count < l1 AND text_length < l2 THEN 'both_low' ELSE 'middle' END AS category,
        true AS embed_ok, true AS nearest FROM docs, t"""


@query("st1_score_batch", _SCORED)
def st1(spark, sf):
    scorer = _scorer(spark, sf)
    return _nearest(scorer.score(docs(spark, sf).select("id", "text", "sentence_count", "text_length")), scorer.centres.read(spark))


def _files(n: int) -> int:
    """Files of a stream of ``n`` documents: four, and more where these would hold over 10,000 each."""
    return max(4, ranking.tasks_for(n, 10_000))


@query("st1_score_stream", _SCORED)
def st1b(spark, sf):
    """The documents as a stream of files, scored batch by batch into a table."""
    folder = _fresh(spark)
    d = docs(spark, sf).select("id", "text", "sentence_count", "text_length")
    d.repartition(_files(d.count())).write.parquet(f"{folder}/in")
    stream = scoring.stream_documents(spark, f"{folder}/in", d.schema)
    scorer = _scorer(spark, sf)
    scoring.start(scorer, stream, f"{folder}/out", f"{folder}/checkpoint", available_now=True, columns=["id", "category", "embed_ok", "pc", "topic_id"]).awaitTermination()
    return _nearest(spark.read.parquet(f"{folder}/out"), scorer.centres.read(spark))


@query(
    "st1_nearest_topic",
    W + _V + """, l AS (SELECT vec_id AS id, label, (generate_subscripts(embedding, 1))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
      c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM l GROUP BY label, i) GROUP BY label)
      SELECT v.id, arg_min(c.label, list_distance(v.e, c.c))::INTEGER AS topic_id, 2::INTEGER AS version FROM v, c GROUP BY v.id""",
)
def st1c(spark, sf):
    """Every vector and the nearest mean of a label, of the second version that was published."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), doubles("embedding").alias("pc"), F.col("label").alias("cluster_id"))
    centres = cut(clusters.array_centroids(v, "pc", "cluster_id").select(F.col("cluster_id").alias("topic_id"), F.col("centroid").alias("centre")))
    store = scoring.TopicCentres(_fresh(spark))
    store.publish(centres.withColumn("centre", F.transform("centre", lambda x: -x)))
    version = store.publish(centres)
    return scoring.nearest_topic(v, store.read(spark), block=2).select("id", "topic_id", F.lit(version).alias("version"))


@query(
    "s10_stage_store",
    rounded_sql("mean", W + """docs AS (SELECT lang, length(text)::DOUBLE AS n FROM documents WHERE lang IS NOT NULL), t AS (SELECT lang, count(*) AS n, avg(n) AS mean FROM docs GROUP BY lang)
      SELECT lang, n, mean, rank() OVER (ORDER BY n DESC, lang) AS place, 3::INTEGER AS made, 0::INTEGER AS made_again, 1::INTEGER AS made_for_new_option FROM t"""),
)
def s10(spark, sf):
    """Three stages over the documents: a second run makes none of them, a changed option of the last one only that."""
    path, made = _fresh(spark), []
    for option in ("n", "n", "mean"):
        held = Stages(spark, path)
        d = docs(spark, sf).where("lang is not null").select("id", "lang", "text_length")
        a, ka = held.table("lengths", [held.name_input(d)], {}, lambda d=d: d)
        b, kb = held.table("languages", [ka], {}, lambda a=a: a.groupBy("lang").agg(F.count("*").alias("n"), F.avg("text_length").alias("mean")))
        order = Window.partitionBy(F.lit(0)).orderBy(F.col(option).desc(), "lang")  # one row per language
        c, _ = held.table("places", [kb], {"by": option}, lambda b=b, order=order: b.withColumn("place", F.rank().over(order).cast("bigint")))
        made.append((c, len(held.made)))
    first = made[0][0].select("lang", "n", "mean", "place")
    return final(first.withColumns({k: F.lit(n) for k, (_, n) in zip(("made", "made_again", "made_for_new_option"), made)}))
