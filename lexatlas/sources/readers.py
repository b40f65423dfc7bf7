"""Tables of documents and vectors."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lexatlas.functions.scalars import narrow


def read_documents(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV (quoted newlines allowed) or Parquet, by the ending of the path.

    Give a schema for CSV at scale: without one the files are read once more to infer it.
    """
    if re.search(r"\.csv(\.\w+)?$", path):
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a scan with fewer partitions than cores, spread by ``key``.

    A small or unsplittable file would leave most cores idle during the work on its texts. A large
    table has more partitions than cores and is returned as it is: its texts are never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def preview(df: DataFrame, n: int = 1000) -> DataFrame:
    """A bounded number of rows for a look at the columns; the full profile (A4) is preferred."""
    return df.limit(n)


def row_count(df: DataFrame) -> int:
    """S3: rows, not physical lines."""
    return df.count()


def read_vectors(spark: SparkSession, path: str, id_col: str = "id", prefix: str = "emb_") -> DataFrame:
    """(id, embedding) from Parquet with an array column, or from wide columns ``emb_0..``."""
    df = read_documents(spark, path)
    if "embedding" in df.columns:
        return df.select(id_col, F.col("embedding").cast("array<float>").alias("embedding"))
    width = [c for c in df.columns if re.fullmatch(rf"{re.escape(prefix)}\d+", c)]
    if not width:
        raise ValueError(f"no 'embedding' column and no '{prefix}<n>' columns in {path}")
    return df.select(id_col, narrow(prefix, len(width)).cast("array<float>").alias("embedding"))


def write_vectors(df: DataFrame, path: str) -> None:
    """S5."""
    df.write.mode("overwrite").parquet(path)
