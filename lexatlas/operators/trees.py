"""Boosted trees: many independent fits side by side over one shared frame, and fitted trees as tables."""

from __future__ import annotations

import uuid
from collections.abc import Hashable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F

from lexatlas.session import cut, parallelism, shared_dir

SIDE_BY_SIDE = 8  # fits at a time: each has short jobs, which leave most of a cluster idle between them
ROWS_OF_TASK = 20_000  # rows of the training frame for one task
SEED, STEP = 42, 0.3


def training_frame(df: DataFrame, features: str = "features", keep: list[str] | None = None) -> DataFrame:
    """(_x, keep..) written, in as many partitions as the rows are worth: every tree level is a job over all of them."""
    from pyspark.ml.functions import array_to_vector

    held = cut(df.select(array_to_vector(features).alias("_x"), *(keep or [])))
    parts = max(1, min(held.count() // ROWS_OF_TASK, 4 * parallelism(df.sparkSession)))
    return held.repartition(parts) if parts > held.rdd.getNumPartitions() else held.coalesce(parts)


def learner(target: str, n_trees: int, depth: int, seed: int = SEED):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(
        featuresCol="_x", labelCol=target, predictionCol="_y", maxIter=n_trees, maxDepth=depth, stepSize=STEP, seed=seed, checkpointInterval=10
    )


def fit_side_by_side(frame: DataFrame, fits: dict[Hashable, tuple[object, Column | None]], at_once: int = SIDE_BY_SIDE) -> dict[Hashable, object]:
    """The fitted models of ``fits``: name -> (learner, condition on the rows or None).

    The frame is kept in memory while the fits run as concurrent jobs, and released at the end, also when
    one fails; its error is raised when the fits that had begun are over.
    """
    shared = frame.persist()
    try:
        shared.count()  # filled once, not by several fits at the same time

        def run(name: Hashable) -> object:
            estimator, rows = fits[name]
            return estimator.fit(shared if rows is None else shared.where(rows))

        with ThreadPoolExecutor(max(1, min(at_once, len(fits)))) as pool:
            started = {name: pool.submit(inheritable_thread_target(frame.sparkSession)(run), name) for name in fits}
            return {name: f.result() for name, f in started.items()}
    finally:
        shared.unpersist()


def tree_nodes(model) -> DataFrame:
    """(tree, weight, node, rows, prediction, left, right, feature, threshold) of a fitted model, read from its saved form.

    ``rows`` are the training rows at the node; left, right and feature are -1 at leaves.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = f"{shared_dir(spark)}/lexatlas-trees-{uuid.uuid4().hex}"
    model.write().save(path)
    weights = F.lit([float(w) for w in model.treeWeights])
    data = spark.read.parquet(f"{path}/data")
    n = F.col("nodeData")
    return data.select(
        F.col("treeID").alias("tree"), F.get(weights, F.col("treeID")).alias("weight"), n["id"].alias("node"), n["impurityStats"][0].alias("rows"), n["prediction"].alias("prediction"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
    )
