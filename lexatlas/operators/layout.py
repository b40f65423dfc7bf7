"""A 2-D or 3-D map of the documents from their neighbour graph, as DataFrame steps.

(a) cosine neighbours, (b) local scaling by nearest distance and a per-row bandwidth, (c) fuzzy
union of the directed weights, (d) spectral coordinates of the normalised graph by filtered subspace
iteration, until the residual of every axis is small. Steps a to c are those of UMAP; (d) is a spectral
layout, not stochastic gradient descent.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexatlas.functions.scalars import id_hash
from lexatlas.operators.approximate import approximate_neighbours
from lexatlas.operators.neighbours import nearest_neighbours
from lexatlas.operators.ranking import HOT_GROUP
from lexatlas.operators.vectors import unit_cube
from lexatlas.session import cut, release

BISECTIONS = 64


def local_scaling(edges: DataFrame, k: int) -> DataFrame:
    """Directed weights exp(-(dist - rho) / sigma) with sum_j = log2(k) per source.

    rho is the smallest positive distance, sigma is found by bisection on the k distances of the row.
    """
    lists = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "dist"))).alias("_e"))  # k entries
    target = math.log2(max(k, 2))

    @F.pandas_udf("array<double>")
    def weights(dist: pd.Series) -> pd.Series:
        if not len(dist):
            return pd.Series([], dtype=object)
        size = dist.map(len).to_numpy()
        real = np.arange(size.max()) < size[:, None]
        d = np.zeros(real.shape)
        d[real] = np.concatenate(dist.to_numpy())
        rho = np.where(real & (d > 0), d, np.inf).min(axis=1)
        gap = np.where(real, np.maximum(d - np.where(np.isfinite(rho), rho, 0.0)[:, None], 0.0), np.inf)
        low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
        for _ in range(BISECTIONS):  # all rows at once; a row that is exact enough stays
            total = np.exp(-gap / sigma[:, None]).sum(axis=1)
            open_ = np.abs(total - target) >= 1e-5
            if not open_.any():
                break
            above = open_ & (total > target)
            below = open_ & ~above
            high = np.where(above, sigma, high)
            low = np.where(below, sigma, low)
            middle = np.where(np.isinf(high), sigma * 2, (low + np.where(np.isinf(high), 0.0, high)) / 2)
            sigma = np.where(open_, middle, sigma)
        mean = np.where(real, d, 0.0).sum(axis=1) / size
        sigma = np.maximum(sigma, np.where(mean > 0, 1e-3 * mean, 1e-3))
        w = np.exp(-gap / sigma[:, None])
        return pd.Series([row[:n] for row, n in zip(w, size)])

    weighted = lists.withColumn("_w", weights(F.transform("_e", lambda e: e["dist"])))
    pairs = weighted.select("src", F.inline(F.arrays_zip(F.col("_e").alias("e"), F.col("_w").alias("w"))))
    return pairs.select("src", F.col("e.dst").alias("dst"), "w")


def fuzzy_union(directed: DataFrame) -> DataFrame:
    """Symmetric weights a + b - ab, both directions kept."""
    reverse = directed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("w"))
    both = directed.unionByName(reverse).groupBy("src", "dst").agg(F.sum("w").alias("_s"), F.count(F.lit(1)).alias("_n"), F.product("w").alias("_p"))
    return both.select("src", "dst", (F.col("_s") - F.when(F.col("_n") > 1, F.col("_p")).otherwise(0.0)).alias("w"))


EXTRA = 3  # columns beyond the wanted ones, which speed up the convergence
DEGREE = 8  # products with the graph between two checks
ITERATIONS = 400  # products in all, beyond which the layout fails
TOLERANCE = 1e-3  # of |A x - value x| for every axis x of length 1
SHUFFLED = 1 << 30  # bytes that products may shuffle before the vectors are written; a product alone may need more
EDGE_BYTES = 160  # shuffled by a product for each edge: the edge, and a part of the sums


@dataclass(frozen=True)
class Spectral:
    """Axes (id, c0 .. c<dims-1>) of length 1, the eigenvalue and residual of each, and the products with the graph that were made."""

    axes: DataFrame
    values: tuple[float, ...]
    residuals: tuple[float, ...]
    products: int

    def convergence_table(self) -> DataFrame:
        rows = [(i, v, r, self.products) for i, (v, r) in enumerate(zip(self.values, self.residuals))]
        return self.axes.sparkSession.createDataFrame(rows, "axis int, eigenvalue double, residual double, products int")


def normalised(graph: DataFrame, per_task: int = HOT_GROUP) -> tuple[DataFrame, DataFrame]:
    """The edges (src, dst, salt, w, me) of D^-1/2 W D^-1/2, with a loop of weight 0 and me = 1 for every node, and (id, deg, copies); both written.

    Nodes with more than ``per_task`` edges are met in several copies, over which ``salt`` deals their edges.
    """
    nodes = cut(graph.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg"), F.ceil(F.count("*") / F.lit(per_task)).cast("int").alias("copies")))
    ends = nodes.select(F.col("id").alias("dst"), F.col("deg").alias("deg2"), "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    hot = F.broadcast(nodes.where("copies > 1").select(F.col("id").alias("dst"), F.col("copies").alias("_c")))  # at most edges / per_task rows
    salted = graph.join(hot, "dst", "left").withColumn("salt", F.when(F.col("_c").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("src"), F.col("_c")).cast("int")))
    both = salted.join(ends, ["dst", "salt"]).join(nodes.select(F.col("id").alias("src"), "deg"), "src")
    edges = both.select("src", "dst", "salt", (F.col("w") / F.sqrt(F.col("deg") * F.col("deg2"))).alias("w"), F.lit(0.0).alias("me"))
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("salt"), F.lit(0.0).alias("w"), F.lit(1.0).alias("me"))
    return cut(edges.unionByName(loops)), nodes


def _product(edges: DataFrame, vectors: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """(id, copies, keep.., _names..): the columns ``keep`` and the products of ``names`` with the graph, in one join and one sum."""
    met = vectors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumnRenamed("id", "dst")
    sums = [F.sum(F.col("w") * F.col(c)).alias(f"_{c}") for c in names] + [F.sum(F.col("me") * F.col(c)).alias(c) for c in keep]
    return edges.join(met, ["dst", "salt"]).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("me") * F.col("copies")).cast("int").alias("copies"), *sums)


def _filtered(edges: DataFrame, vectors: DataFrame, names: list[str], bound: float, degree: int, at_once: int) -> DataFrame:
    """Chebyshev filter: directions with eigenvalues in [-1, bound] shrink against those above, by a polynomial of the degree.

    After ``at_once`` products the vectors are written, so no more is shuffled at a time. The result is written.
    """
    half, centre = (bound + 1) / 2, (bound - 1) / 2
    first = scale = half / (1 - centre)
    before = [f"o_{c}" for c in names]
    now, written = vectors.select("id", "copies", *names, *[F.lit(0.0).alias(b) for b in before]), None
    for step in range(degree):
        after = scale if step == 0 else 1 / (2 / first - scale)
        factor = (scale if step == 0 else 2 * after) / half
        back = 0.0 if step == 0 else scale * after
        made = _product(edges, now, names, [*names, *before])
        now = made.select(
            "id", "copies",
            *[((F.col(f"_{c}") - F.lit(centre) * F.col(c)) * F.lit(factor) - F.lit(back) * F.col(b)).alias(c) for c, b in zip(names, before)],
            *[F.col(c).alias(b) for c, b in zip(names, before)],
        )
        scale = after
        if step + 1 < degree and (step + 1) % at_once == 0:
            now = cut(now)
            release(written)
            written = now
    made = cut(now.select("id", "copies", *names))
    release(written)
    return made


def spectral_coordinates(graph: DataFrame, dims: int = 3, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, degree: int = DEGREE) -> Spectral:
    """The leading eigenvectors of D^-1/2 W D^-1/2 after the trivial one.

    Filtered subspace iteration: a product is one equi-join of the edges with the vectors and one sum per
    node. After every ``degree`` products the block is written, made orthonormal with a matrix as wide as
    the block and rotated to the approximate eigenvectors it contains; it ends when A x - value x is no
    longer than ``tolerance`` for every axis. More than ``iterations`` products raise an error. Of the tables
    that are written on the way only the last are kept.
    """
    q = dims + 1 + EXTRA
    edges, nodes = normalised(graph)
    at_once = max(1, SHUFFLED // (EDGE_BYTES * max(1, edges.count())))  # from the file footers
    # Deterministic start: the trivial direction, which stays as it is, then hashed numbers in [-1, 1].
    start = [F.sqrt("deg").alias("c0")] + [(id_hash("id", j) / F.lit(float(1 << 59)) - 1.0).alias(f"c{j}") for j in range(1, q)]
    names, bound, made = [f"c{j}" for j in range(q)], 0.0, 0
    free = names[1:]
    written = vectors = cut(nodes.select("id", "copies", *start))
    while True:
        filtered = _filtered(edges, vectors, names, bound, degree, at_once)
        release(written)
        written = vectors = cut(orthonormal(filtered, names, ["copies"]))
        release(filtered)
        made += degree + 1
        both = cut(_product(edges, vectors, free, free))
        pairs = [(i, j) for i in range(len(free)) for j in range(i, len(free))]
        products = [F.sum(F.col(free[i]) * F.col(f"_{free[j]}")).alias(f"h{i}_{j}") for i in range(len(free)) for j in range(len(free))]
        products += [F.sum(F.col(f"_{free[i]}") * F.col(f"_{free[j]}")).alias(f"g{i}_{j}") for i, j in pairs]
        sums = both.agg(*products).first()
        release(both)
        h = np.array([[sums[f"h{i}_{j}"] for j in range(len(free))] for i in range(len(free))])
        g = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(len(free))] for i in range(len(free))])
        value, rotate = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-value, kind="stable")
        value, rotate = value[order], rotate[:, order]
        rotate = rotate * np.where(rotate[np.abs(rotate).argmax(axis=0), np.arange(len(free))] < 0, -1.0, 1.0)
        residual = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", rotate, g, rotate) - value**2, 0.0))
        turned = [sum((F.col(c) * F.lit(float(rotate[i, j])) for i, c in enumerate(free)), F.lit(0.0)) for j in range(len(free))]
        if residual[:dims].max() <= tolerance:
            axes = vectors.select("id", *[turned[j].alias(f"c{j}") for j in range(dims)])
            release(edges, nodes)
            return Spectral(axes, tuple(map(float, value[:dims])), tuple(map(float, residual[:dims])), made)
        if made + degree + 1 > iterations:
            raise RuntimeError(f"the layout has not settled after {made} products: residuals {residual[:dims].tolist()}, tolerance {tolerance}")
        vectors = vectors.select("id", "copies", "c0", *[t.alias(c) for t, c in zip(turned, free)])
        bound = float(np.clip(value[-1], -0.5, 0.98))


def orthonormal(vectors: DataFrame, names: list[str], others: list[str] | None = None) -> DataFrame:
    """Columns made orthonormal in order (Gram-Schmidt through the Cholesky factor)."""
    q = len(names)
    sums = vectors.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i in range(q) for j in range(i, q)]).first()
    g = np.zeros((q, q))
    for i in range(q):
        for j in range(i, q):
            g[i, j] = g[j, i] = sums[f"s{i}_{j}"]
    # Columns of length 1 first: after a filter their lengths differ by orders of magnitude.
    scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    r = scale[:, None] * np.linalg.inv(np.linalg.cholesky(g * scale * scale[:, None] + np.eye(q) * 1e-14).T)
    cols = []
    for j in range(q):
        c = F.lit(0.0)
        for i in range(j + 1):
            c = c + F.col(names[i]) * F.lit(float(r[i, j]))
        cols.append(c.alias(names[j]))
    return vectors.select("id", *(others or []), *cols)


@dataclass(frozen=True)
class Layout:
    """The map (id, x, y[, z]) and how well each axis has settled (axis, eigenvalue, residual, products)."""

    points: DataFrame
    convergence: DataFrame


def layout(
    df: DataFrame, features: str = "pc", id_col: str = "id", dims: int = 3, k: int = 10, iterations: int = ITERATIONS, tolerance: float = TOLERANCE,
    approximate: bool = False,
) -> Layout:
    """Coordinates centred, largest absolute coordinate 1. ``approximate`` takes approximate neighbours, for many dimensions."""
    found = approximate_neighbours(df, k, id_col, features, "cosine").neighbours if approximate else nearest_neighbours(df, k, id_col, features, "cosine")
    made = spectral_coordinates(fuzzy_union(local_scaling(cut(found), k)), dims, iterations, tolerance)
    axes = ["x", "y", "z"][:dims]
    named = cut(made.axes.select("id", *[F.col(f"c{i}").alias(a) for i, a in enumerate(axes)]))
    return Layout(unit_cube(named, tuple(axes)), made.convergence_table())
