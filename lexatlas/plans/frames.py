"""The test tables bound to the roles of an analysis, and the same binding in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexatlas.functions.scalars import rounded
from lexatlas.functions.text import sentence_count, text_length
from lexatlas.operators.ranking import tasks_for
from lexatlas.session import cut
from lexatlas.sources.readers import spread
from lexatlas.spec import Outcome

SENTENCES = Outcome("sentence_count")
LENGTH = Outcome("text_length")
DIGITS = Outcome("digit_count", mode="zero_presence")
QUALITY = Outcome("quality", type="ordinal")
TOXIC = Outcome("toxic", type="ordinal")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents of one task in which their texts meet the vectors; small enough for the different terms of its texts.
PER_TASK = 8192


def docs(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """documents with outcomes and a control, dealt over ``tasks`` by id if given. Unused columns, and the text, are pruned by Catalyst."""
    read = table(spark, sf_dir, "documents")
    return (read.repartition(tasks, "doc_id") if tasks else spread(read, "doc_id")).select(
        F.col("doc_id").alias("id"),
        "text", "lang", "source",
        text_length("text").alias("text_length"),
        sentence_count("text").alias("sentence_count"),
        F.regexp_count("text", F.lit("[0-9]")).cast("double").alias("digit_count"),
        F.size(F.split(F.trim("text"), r"\s+")).cast("double").alias("n_words"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs with vectors, a cluster id and three coordinates."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster_id")
    )
    v = F.col("embedding")
    # A few large row groups, and texts sorted in one partition per core, would let a task grow with the table.
    tasks = tasks_for(table(spark, sf_dir, "documents").count(), PER_TASK)  # from the file footers
    dealt = docs(spark, sf_dir, tasks if tasks > spark.sparkContext.defaultParallelism else None)
    return dealt.join(e, "id").withColumns(
        {"x": v[0].cast("double"), "y": v[1].cast("double"), "z": v[2].cast("double")}
    )


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs without the text, written once: for operators that read the numbers several times."""
    return cut(docs(spark, sf_dir).drop("text"))


def measured_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points without the text, written once."""
    return cut(points(spark, sf_dir).drop("text"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs with the partly missing labels."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return docs(spark, sf_dir).join(marks, "id", "left")


def final(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with another engine."""
    return df.select(*[rounded(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


DOCS_SQL = r"""docs AS (
  SELECT doc_id AS id, text, lang, source,
    length(text)::DOUBLE AS text_length,
    len(regexp_extract_all(text, '[.!?]+'))::DOUBLE AS sentence_count,
    len(regexp_extract_all(text, '[0-9]'))::DOUBLE AS digit_count,
    len(regexp_split_to_array(trim(text), '\s+'))::DOUBLE AS n_words
  FROM documents)"""

POINTS_SQL = (
    DOCS_SQL
    + """, points AS (
  SELECT d.*, e.embedding, e.label AS cluster_id, e.embedding[1]::DOUBLE AS x, e.embedding[2]::DOUBLE AS y,
    e.embedding[3]::DOUBLE AS z
  FROM docs d JOIN embeddings e ON d.id = e.vec_id)"""
)

LONG_SQL = (
    POINTS_SQL
    + """, long AS (
  SELECT id, cluster_id, text_length, sentence_count, digit_count,
    (generate_subscripts(embedding, 1) - 1)::INTEGER AS pc, unnest(embedding)::DOUBLE AS value
  FROM points)"""
)

LABELLED_SQL = (
    DOCS_SQL
    + """, labelled AS (
  SELECT d.*, l.quality, l.toxic FROM docs d LEFT JOIN labels l ON d.id = l.doc_id)"""
)


def hash_sql(expr: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5({expr}::VARCHAR || '#{seed}'), 1, 15))::BIGINT"


def rounded_sql(columns: str, inner: str, digits: int = 6) -> str:
    """``inner`` with the named double columns rounded as :func:`final` does."""
    if not columns.strip():
        return inner
    parts = ", ".join(f"(round({c}::DOUBLE, {digits}) + 0.0)::DOUBLE AS {c}" for c in columns.split())
    return f"SELECT * REPLACE ({parts}) FROM ({inner}) AS _t"


def t_tail_sql(t: str, df: str) -> str:
    """P(|T| >= |t|): the density with t = sqrt(df) tan(angle), integrated over the angle by Simpson's rule."""
    low = f"atan(abs({t}) / sqrt({df}))"
    step = f"((least(pi() / 2, {low} + 60 / sqrt({df})) - {low}) / 4000)"
    height = f"cos(least(pi() / 2, {low} + k * {step})) ** ({df} - 1)"
    weight = "CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(0, 4001), lambda k: ({weight}) * {height})) * {step} / 3"
    return f"(2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * {area})"


def t_critical_sql(df: str) -> str:
    """97.5 % point of Student's t by the Cornish-Fisher series, for df in the hundreds and more."""
    z = "1.959963984540054"
    return f"""({z} + ({z} ** 3 + {z}) / (4 * {df}) + (5 * {z} ** 5 + 16 * {z} ** 3 + 3 * {z}) / (96 * {df} ** 2)
      + (3 * {z} ** 7 + 19 * {z} ** 5 + 17 * {z} ** 3 - 15 * {z}) / (384 * {df} ** 3))"""
