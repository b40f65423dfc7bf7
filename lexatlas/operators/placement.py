"""Places of new documents on a map that has been made, from their nearest documents on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexatlas.operators.neighbours import BLOCK, build_index, point_neighbours, search_vectors
from lexatlas.operators.reduce import Reduction

SAME = 1e-9  # cosine distance up to which a new document is one of the map


def new_coordinates(
    reference: DataFrame, new: DataFrame, features: str = "pc", axes: tuple[str, ...] = ("x", "y", "z"), k: int = 10, id_col: str = "id", block: int = BLOCK
) -> DataFrame:
    """(id, axes..) of the rows of ``new``: weighted means over the ``k`` nearest documents (id, features, axes..) of ``reference``.

    With distances d the weight is exp(-(d - least) / mean of (d - least)), equal weights if all are as near.
    A document that is on the map (cosine distance 0) gets the place it has there. As the weights add up to
    1, the places are in the map's own units, whatever its centre and scale. Copies on the map count as one
    document, the one with the smallest id. Rows of ``new`` without a vector are left out; ids that repeat
    give one row each.
    """
    index = build_index(reference, id_col, features, k, cosine=True, block=block)
    numbered = new.select(id_col, features).where(F.col(features).isNotNull()).withColumn("_q", F.sha2(F.concat_ws("#", F.col(id_col).cast("string"), F.to_json(features)), 256))
    queries = search_vectors(numbered.select("_q", features).dropDuplicates(["_q"]), "_q", features, True).withColumnRenamed("id", "rid")
    near = point_neighbours(index, k, queries)
    places = reference.select(F.col(id_col).alias("nid"), *axes)
    lists = near.join(places, "nid").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("dist", *axes))).alias("n"))  # k entries
    least = F.array_min(F.col("n.dist"))
    gap = F.aggregate("n", F.lit(0.0), lambda s, e: s + e["dist"]) / F.size("n") - least
    weighted = lists.withColumns({"_least": least, "_gap": gap}).withColumn(
        "n",
        F.transform("n", lambda e: F.struct(
            F.when(F.col("_least") <= SAME, (e["dist"] <= SAME).cast("double")).when(F.col("_gap") > 0, F.exp(-(e["dist"] - F.col("_least")) / F.col("_gap"))).otherwise(1.0).alias("w"),
            *[e[a].alias(a) for a in axes],
        )),
    )
    total = F.aggregate("n", F.lit(0.0), lambda s, e: s + e["w"])
    along = [F.aggregate(F.transform("n", _weighted(a)), F.lit(0.0), lambda s, x: s + x) for a in axes]
    placed = weighted.select("rid", *[(x / total).alias(a) for x, a in zip(along, axes)])
    return numbered.select(id_col, F.col("_q").alias("rid")).join(placed, "rid").drop("rid")


def _weighted(axis: str) -> Callable[[Column], Column]:
    return lambda e: e["w"] * e[axis]


@dataclass
class DocumentMap:
    """A fitted reduction and the documents it has placed: (id, pc, axes..)."""

    reduction: Reduction
    documents: DataFrame
    axes: tuple[str, ...]
    k: int = 10

    def place(self, vectors: DataFrame, vector: str = "embedding", id_col: str = "id") -> DataFrame:
        """(id, axes..) of new vectors, by their components."""
        scored = self.reduction.transform(vectors.select(F.col(id_col).alias("id"), vector), vector, "pc")
        return new_coordinates(self.documents, scored.select("id", "pc"), "pc", self.axes, self.k).withColumnRenamed("id", id_col)

    def save(self, spark: SparkSession, path: str) -> None:
        self.reduction.save(spark, f"{path}/reduction")
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        spark.createDataFrame([(i, a, self.k) for i, a in enumerate(self.axes)], "at int, axis string, k int").write.mode("overwrite").parquet(f"{path}/axes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "DocumentMap":
        axes = spark.read.parquet(f"{path}/axes").orderBy("at").collect()  # two or three rows
        return DocumentMap(Reduction.load(spark, f"{path}/reduction"), spark.read.parquet(f"{path}/documents"), tuple(r["axis"] for r in axes), axes[0]["k"])
