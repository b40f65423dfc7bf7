"""Standardise, principal components, loadings, scoring of new rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexatlas.functions.scalars import doubles
from lexatlas.operators.vectors import moments


@dataclass
class Reduction:
    """A fitted reduction: d means and deviations, d x k loadings, k variance ratios."""

    mean: np.ndarray
    std: np.ndarray
    loadings: np.ndarray
    variance: np.ndarray

    @property
    def k(self) -> int:
        return self.loadings.shape[1]

    def transform(self, df: DataFrame, vector: str = "embedding", out: str = "pc") -> DataFrame:
        """Adds the component scores; works on batches and on streams."""
        scale = np.where(self.std > 0, self.std, 1.0)
        rotate = self.loadings / scale[:, None]
        shift = self.mean @ rotate
        shared = df.sparkSession.sparkContext.broadcast((rotate, shift))

        @F.pandas_udf("array<double>")
        def score(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            rotate, shift = shared.value
            return pd.Series(list(np.stack(v.to_numpy()).astype(float) @ rotate - shift))

        return df.where(F.col(vector).isNotNull()).withColumn(out, score(doubles(vector)))

    def loadings_table(self, spark: SparkSession) -> DataFrame:
        """(dim, pc, loading)."""
        rows = [(i, j, float(v)) for i, row in enumerate(self.loadings) for j, v in enumerate(row)]
        return spark.createDataFrame(rows, "dim int, pc int, loading double")

    def variance_table(self, spark: SparkSession) -> DataFrame:
        """(pc, variance, cumulative)."""
        c = np.cumsum(self.variance)
        return spark.createDataFrame(
            [(i, float(v), float(c[i])) for i, v in enumerate(self.variance)], "pc int, variance double, cumulative double"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """As Parquet, one row per vector position plus one row per component."""
        dims = [(i, float(m), float(s), [float(v) for v in row]) for i, (m, s, row) in enumerate(zip(self.mean, self.std, self.loadings))]
        spark.createDataFrame(dims, "dim int, mean double, std double, loadings array<double>").write.mode("overwrite").parquet(f"{path}/dims")
        self.variance_table(spark).write.mode("overwrite").parquet(f"{path}/variance")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Reduction":
        dims = spark.read.parquet(f"{path}/dims").orderBy("dim").collect()  # one row per vector position
        var = spark.read.parquet(f"{path}/variance").orderBy("pc").collect()
        return Reduction(
            np.array([r["mean"] for r in dims]), np.array([r["std"] for r in dims]),
            np.array([r["loadings"] for r in dims]), np.array([r["variance"] for r in var]),
        )


def fit_reduction(df: DataFrame, vector: str = "embedding", k: int = 200) -> Reduction:
    """k = min(k, rows - 1, dimensions) components of the standardised vectors.

    Two passes: moments, then Spark ML's covariance. The sign of a component makes its largest
    loading positive.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    clean = df.where(F.col(vector).isNotNull()).select(doubles(vector).alias("v"))
    row = moments(clean, "v").first()
    n, mean, std = row["n"], np.array(row["mean"]), np.array(row["std"])
    k = int(min(k, n - 1, len(mean)))
    if k < 1:
        raise ValueError("at least two rows are needed for a reduction")
    scale = np.where(std > 0, std, 1.0)
    rule = F.arrays_zip(F.lit([float(x) for x in mean]).alias("m"), F.lit([float(x) for x in scale]).alias("s"))
    scaled = clean.select(array_to_vector(F.zip_with("v", rule, lambda x, r: (x - r["m"]) / r["s"])).alias("v"))
    fitted = PCA(k=k, inputCol="v", outputCol="p").fit(scaled)
    loadings = fitted.pc.toArray()
    peak = loadings[np.abs(loadings).argmax(axis=0), np.arange(k)]
    return Reduction(mean, std, loadings * np.where(peak < 0, -1.0, 1.0), fitted.explainedVariance.toArray())
