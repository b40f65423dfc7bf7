"""What each feature adds to the prediction of a document."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lexatlas.functions.scalars import doubles, ratio
from lexatlas.operators.cleaning import scalars
from lexatlas.operators.gram import Gram, gram, ridge_fit
from lexatlas.operators.trees import tree_nodes


def linear_contributions(df: DataFrame, targets: list[str], features: str = "features", g: Gram | None = None, alpha: float = 1.0) -> DataFrame:
    """D15, linear: coefficient times distance from the mean, which is the exact Shapley value of a
    linear rule. Adds ``contrib_<target>`` arrays; their sum plus the mean prediction is the prediction.
    """
    g = g or gram(df.withColumn("fold", F.lit(0)), targets, features)
    out = df
    centre = g.total[0, 1 : g.p + 1] / g.total[0, 0] + g.shift[: g.p]
    for t in targets:
        coef, _ = ridge_fit(g.total, g.p, g.target(t), alpha)
        rule = F.arrays_zip(F.lit([float(c) for c in coef]).alias("b"), F.lit([float(c) for c in centre]).alias("m"))
        out = out.withColumn(f"contrib_{t}", F.zip_with(doubles(features), rule, lambda x, r: r["b"] * (x - r["m"])))
    return out


def one_feature_contribution(df: DataFrame, feature: str, target: str) -> DataFrame:
    """D15 for a single column by plain aggregates: adds ``contribution``."""
    x, y = F.col(feature), F.col(target)
    fit = scalars(df.agg(ratio(F.regr_sxy(y, x), F.regr_sxx(y, x)).alias("slope"), F.avg(x).alias("centre")))
    return df.withColumn("contribution", fit["slope"] * (x - fit["centre"]))


# -- boosted trees ----------------------------------------------------------------------------------


LEAF = "value double, share double, features array<int>, lows array<double>, highs array<double>, shares array<double>"


def _leaves_of(tree: pd.DataFrame) -> pd.DataFrame:
    """The leaves of one tree: weighted value, share of the training rows, and for each feature of the path its bounds and
    the share of rows that follow it where the feature is unknown."""
    at = {r.node: r for r in tree.itertuples(index=False)}
    total, made = at[0].rows, []
    held = [(0, {})]
    while held:
        node, path = held.pop()
        r = at[node]
        if r.left < 0:
            names = sorted(path)
            low, high, share = ([path[f][k] for f in names] for k in range(3))
            made.append((r.weight * r.prediction, r.rows / total, names, low, high, share))
            continue
        for child, low, high in ((r.left, -np.inf, r.threshold), (r.right, r.threshold, np.inf)):
            a, b, s = path.get(r.feature, (-np.inf, np.inf, 1.0))
            held.append((child, {**path, r.feature: (max(a, low), min(b, high), s * at[child].rows / r.rows)}))
    return pd.DataFrame(made, columns=["value", "share", "features", "lows", "highs", "shares"])


def leaves_table(model) -> DataFrame:
    """One row for each leaf of a boosted model; the trees are read by as many tasks."""
    return tree_nodes(model).groupBy("tree").applyInPandas(_leaves_of, LEAF)


def shapley_of_rows(x: np.ndarray, leaves: list[tuple]) -> np.ndarray:
    """Exact path-dependent tree Shapley values for a batch of rows; ``leaves`` are (value, features, lows, highs, shares).

    With m_j = 1 where the row meets the conditions on feature j and z_j the share of rows that do, feature i
    adds value (m_i - z_i) times the integral over t from 0 to 1 of the product of z_j (1 - t) + m_j t over the
    other features. That is a polynomial in t, so a few nodes of Gauss and Legendre give the integral exactly:
    the work is in proportion to the leaves and the length of their paths.
    """
    out = np.zeros_like(x, dtype=float)
    for value, features, low, high, share in leaves:
        d = len(features)
        if not d:
            continue
        nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
        t, w = (nodes + 1) / 2, weights / 2
        met = ((x[:, features] > low) & (x[:, features] <= high)).astype(float)
        factor = share[:, None] * (1 - t) + met[:, :, None] * t  # rows x features x nodes; positive, as every path has rows
        product = factor.prod(axis=1)
        out[:, features] += value * (met - share) * ((product[:, None, :] / factor) @ w)
    return out


def gbt_contributions(df: DataFrame, target: str, model, features: str = "features") -> tuple[DataFrame, float]:
    """D15, trees: adds ``contrib_<target>`` from a fitted ``GBTRegressionModel``; also the base value.

    The leaves are broadcast (their number depends on depth and number of trees, not on the rows) and applied
    to Arrow batches.
    """
    rows = leaves_table(model).collect()  # trees x 2^depth at most
    leaves = [(r["value"], np.array(r["features"], dtype=int), *(np.array(r[c]) for c in ("lows", "highs", "shares"))) for r in rows]
    shared = df.sparkSession.sparkContext.broadcast(leaves)

    @F.pandas_udf("array<double>")
    def contributions(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(shapley_of_rows(np.stack(x.to_numpy()).astype(float), shared.value)))

    return df.withColumn(f"contrib_{target}", contributions(doubles(features))), sum(r["value"] * r["share"] for r in rows)


# -- summaries ----------------------------------------------------------------------------------------


def _long(df: DataFrame, targets: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(t).alias("outcome"), F.col(f"contrib_{t}").alias("_c")) for t in targets])
    return df.select(F.inline(rows)).select("outcome", F.posexplode("_c").alias("pc", "value"))


def contribution_stats(df: DataFrame, targets: list[str]) -> DataFrame:
    """(pc, outcome, min, max, range, std)."""
    v = F.col("value")
    return _long(df, targets).groupBy("pc", "outcome").agg(
        F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"), F.stddev_pop(v).alias("std")
    )


def top_by_contribution(df: DataFrame, targets: list[str], n: int = 5) -> DataFrame:
    """Components by mean absolute contribution over documents and outcomes."""
    return (
        _long(df, targets)
        .groupBy("pc")
        .agg(F.avg(F.abs("value")).alias("importance"))
        .orderBy(F.col("importance").desc(), "pc")
        .limit(n)
    )


def top_components_per_row(
    targets: list[str], variance: Column, percentiles: Column, n_pcs: int | Column, n: int = 6
) -> Column:
    """The ``n`` components with the largest summed absolute contribution of the document, as
    an array of structs. Array functions only: nothing is shuffled.

    Components at or beyond ``n_pcs`` (such as controls) are taken out after the choice.
    """
    total = F.transform(F.col(f"contrib_{targets[0]}"), lambda c: F.abs(c))
    for t in targets[1:]:
        total = F.zip_with(total, F.col(f"contrib_{t}"), lambda s, c: s + F.abs(c))
    # Largest first, ties by the higher index.
    order = F.reverse(F.array_sort(F.transform(total, lambda s, i: F.struct(s.alias("s"), i.alias("i")))))
    limit = F.lit(n_pcs) if isinstance(n_pcs, int) else n_pcs
    chosen = F.filter(F.transform(F.slice(order, 1, n), lambda e: e["i"]), lambda i: i < limit)

    def info(i):
        parts = [
            F.concat(F.lit("PC"), i.cast("string")).alias("pc"),
            F.get(percentiles, i).alias("percentile"),
            (F.get(variance, i) * 100).alias("variance_total"),
        ]
        for t in targets:
            c = F.get(F.col(f"contrib_{t}"), i)
            parts += [c.alias(f"contribution_{t}"), (F.abs(c) * F.get(variance, i) * 100).alias(f"variance_{t}")]
        return F.struct(*parts)

    return F.transform(chosen, info)
