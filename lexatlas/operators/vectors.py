"""Checks and scaling of vector columns, all on the JVM side."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from lexatlas.functions.scalars import doubles, l2_norm, l2_normalised, ratio
from lexatlas.operators.cleaning import scalars


def broken(v: str) -> Column:
    """True when a vector is missing or has a null, NaN or infinite entry."""
    bad = F.exists(doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(v).isNull() | F.coalesce(bad, F.lit(True))


def all_zero(v: str) -> Column:
    return F.forall(doubles(v), lambda x: x == 0)


def vector_check(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row about the vectors themselves."""
    ok = ~broken(vector)
    norm = F.when(ok, l2_norm(vector))
    zero = ok & all_zero(vector)
    return vectors.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.min(F.size(vector)).cast("bigint").alias("min_dim"),
        F.max(F.size(vector)).cast("bigint").alias("max_dim"),
        F.count_if(~ok).alias("n_broken"),
        F.count_if(zero).alias("n_zero"),
        F.count_if(ok & ~zero).alias("n_nonzero"),
        F.avg(norm).alias("mean_norm"),
        F.stddev_pop(norm).alias("std_norm"),
    ).withColumn("valid", (F.col("n_broken") == 0) & (F.col("min_dim") == F.col("max_dim")))


def id_coverage(docs: DataFrame, vectors: DataFrame, doc_id: str = "id", vec_id: str = "id") -> DataFrame:
    """Rows with both, documents without vector, vectors without document."""
    a = docs.select(F.col(doc_id).alias("_id"), F.lit(1).alias("_d"))
    b = vectors.select(F.col(vec_id).alias("_id"), F.lit(1).alias("_v"))
    return a.join(b, "_id", "full").agg(
        F.count_if(F.col("_d").isNotNull() & F.col("_v").isNotNull()).alias("n_matched"),
        F.count_if(F.col("_v").isNull()).alias("n_missing_vectors"),
        F.count_if(F.col("_d").isNull()).alias("n_orphan_vectors"),
    )


def join_vectors(docs: DataFrame, vectors: DataFrame, doc_id: str = "id", vec_id: str = "id") -> DataFrame:
    """Documents with their vectors, by id."""
    return docs.join(vectors.withColumnRenamed(vec_id, doc_id), doc_id)


def with_controls(df: DataFrame, features: str, controls: list[str], out: str = "features") -> DataFrame:
    """The controls, in name order, behind the features of the same row."""
    tail = F.array(*[F.col(c).cast("double") for c in sorted(controls)]) if controls else F.array().cast("array<double>")
    return df.withColumn(out, F.concat(doubles(features), tail))


def feature_names(n_features: int, controls: list[str], prefix: str = "PC") -> list[str]:
    return [f"{prefix}{i}" for i in range(n_features)] + [f"Control_{c}" for c in sorted(controls)]


def moments(df: DataFrame, vector: str) -> DataFrame:
    """One row: ``n`` and the arrays ``mean`` and ``std`` (population)."""
    s = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(doubles(vector)))
    full = df.where(F.col(vector).isNotNull())
    if full.isEmpty():
        raise ValueError("no vectors to summarise")
    row = full.agg(s.alias("_s"))
    n = F.col("_s.count")
    shrink = ratio(n - 1, n)
    return row.select(
        n.alias("n"),
        vector_to_array(F.col("_s.mean")).alias("mean"),
        F.transform(vector_to_array(F.col("_s.variance")), lambda v: F.sqrt(v * shrink)).alias("std"),
    )


def standardised(df: DataFrame, vector: str, out: str = "scaled") -> DataFrame:
    """Zero mean and unit population deviation per position; a constant position becomes 0."""
    m = scalars(moments(df, vector))
    scaled = F.zip_with(
        F.zip_with(doubles(vector), F.col("_mean"), lambda x, c: x - c),
        F.col("_std"),
        lambda x, s: x / F.when(s > 0, s).otherwise(F.lit(1.0)),
    )
    return df.withColumns({"_mean": m["mean"], "_std": m["std"]}).withColumn(out, scaled).drop("_mean", "_std")


def unit_cube(df: DataFrame, coords=("x", "y", "z")) -> DataFrame:
    """Centred coordinates divided by the largest absolute one."""
    fit = scalars(cube_fit(df, coords))
    scale = F.when(fit["scale"] > 0, fit["scale"]).otherwise(F.lit(1.0))
    return df.withColumns({c: (F.col(c) - fit[f"centre_{c}"]) / scale for c in coords})


def cube_fit(df: DataFrame, coords=("x", "y", "z")) -> DataFrame:
    """The centre and scale of R6 as one row, to be reused on new data. One pass: the largest
    deviation from the mean is at the minimum or the maximum."""
    aggs = []
    for c in coords:
        aggs += [F.avg(c).alias(f"centre_{c}"), F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
    row = df.agg(*aggs)
    sides = [s for c in coords for s in (F.col(f"_hi_{c}") - F.col(f"centre_{c}"), F.col(f"centre_{c}") - F.col(f"_lo_{c}"))]
    return row.select(*[f"centre_{c}" for c in coords], F.greatest(*sides).alias("scale"))


def coordinate_range(df: DataFrame, coords=("x", "y", "z")) -> DataFrame:
    """Smallest and largest coordinate over all axes."""
    return df.agg(F.min(F.least(*coords)).alias("min"), F.max(F.greatest(*coords)).alias("max"))


def cloud_centre(df: DataFrame, coords=("x", "y", "z")) -> DataFrame:
    """A19."""
    return df.agg(*[F.avg(c).alias(c) for c in coords])


__all__ = [n for n in dir() if not n.startswith("_")] + ["l2_normalised"]
