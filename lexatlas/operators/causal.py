"""Naive and double machine learning estimates of one outcome's effect on another.

Every outcome is predicted once per learner and feature set; all ordered pairs share the residuals.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lexatlas.functions.scalars import correlation, ratio
from lexatlas.functions.tails import t_critical, t_tail
from lexatlas.operators.cleaning import scalars
from lexatlas.operators.gram import Gram, gram, ridge_fit, with_model_columns
from lexatlas.operators.trees import fit_side_by_side, learner, training_frame
from lexatlas.session import cut


def ordered_pairs(names: list[str]) -> list[tuple[str, str]]:
    """The earlier outcome is the treatment."""
    return list(combinations(names, 2))


def naive_ols(df: DataFrame, pairs: list[tuple[str, str]], inference: bool = True) -> DataFrame:
    """Slope of outcome on treatment, one row per pair, one aggregation for all pairs."""
    aggs = []
    for i, (t, y) in enumerate(pairs):
        x, o = F.col(t).cast("double"), F.col(y).cast("double")
        aggs += [
            F.regr_count(o, x).alias(f"n{i}"), F.regr_sxx(o, x).alias(f"xx{i}"),
            F.regr_sxy(o, x).alias(f"xy{i}"), F.regr_syy(o, x).alias(f"yy{i}"),
        ]
    rows = [
        F.struct(
            F.lit(t).alias("treatment"), F.lit(y).alias("outcome"), F.col(f"n{i}").alias("n"),
            F.col(f"xx{i}").alias("xx"), F.col(f"xy{i}").alias("xy"), F.col(f"yy{i}").alias("yy"),
        )
        for i, (t, y) in enumerate(pairs)
    ]
    long = df.agg(*aggs).select(F.inline(F.array(*rows)))
    xx, xy, yy, n = (F.col(c) for c in ("xx", "xy", "yy", "n"))
    theta = ratio(xy, xx)
    sse = F.greatest(yy - theta * xy, F.lit(0.0))
    out = long.select(
        "treatment", "outcome", "n",
        theta.alias("theta"),
        F.sqrt(ratio(ratio(sse, n - 2), xx)).alias("se"),
        ratio(xy, F.sqrt(xx) * F.sqrt(yy)).alias("correlation"),
        ratio(xy * xy, xx * yy).alias("r2"),
    )
    if not inference:
        return out
    t, df2 = ratio(F.col("theta"), F.col("se")), F.col("n") - 2
    return (
        out.withColumn("t_stat", t)
        .withColumn("p_value", t_tail(F.col("t_stat"), df2))
        .withColumn("_half", t_critical(df2) * F.col("se"))
        .withColumn("ci_lower", F.col("theta") - F.col("_half"))
        .withColumn("ci_upper", F.col("theta") + F.col("_half"))
        .drop("_half")
    )


# -- nuisance predictions -----------------------------------------------------------------------


def linear_rules(g: Gram, k: int, alpha: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(coefficients p x q, intercepts q) for each held-out fold and -1 for the fit on all rows."""
    rules = {}
    for fold in [-1, *range(k)]:
        m = g.train(None if fold == -1 else fold)
        fits = [ridge_fit(m, g.p, g.target(t), alpha) for t in g.targets]
        coef = np.column_stack([c for c, _ in fits])
        inter = np.array([b for _, b in fits])
        # From shifted to raw coordinates.
        rules[fold] = (coef, inter - g.shift[: g.p] @ coef + g.shift[g.p :])
    return rules


def ridge_predictions(model: DataFrame, targets: list[str], k: int, id_col: str, alpha: float = 1.0, g: Gram | None = None) -> DataFrame:
    """D3/D4 with the linear learner: held-out and full-fit predictions of every target.

    One pass for the sums and one to predict; the K + 1 coefficient vectors are broadcast.
    Output: id, fold, targets.., pred_<t> (held out), full_<t>.
    """
    g = g or gram(model, targets)
    rules = model.sparkSession.sparkContext.broadcast(linear_rules(g, k, alpha))
    q = len(targets)

    @F.pandas_udf("array<double>")
    def predict(features: pd.Series, fold: pd.Series) -> pd.Series:
        out = np.empty((len(features), 2 * q))
        if len(features):
            x, f = np.stack(features.to_numpy()), fold.to_numpy()
            coef, inter = rules.value[-1]
            out[:, q:] = x @ coef + inter
            for v in np.unique(f):
                coef, inter = rules.value[int(v)]
                out[f == v, :q] = x[f == v] @ coef + inter
        return pd.Series(list(out))

    predicted = model.withColumn("_p", predict("features", "fold"))
    return predicted.select(
        id_col, "fold", *targets,
        *[F.col("_p")[i].alias(f"pred_{t}") for i, t in enumerate(targets)],
        *[F.col("_p")[q + i].alias(f"full_{t}") for i, t in enumerate(targets)],
    )


def gbt_predictions(
    model: DataFrame, targets: list[str], k: int, id_col: str, n_trees: int = 100, depth: int = 5, seed: int = 42
) -> DataFrame:
    """D3/D4 with boosted trees: K + 1 fits per target, side by side over one frame, each a distributed training."""
    from pyspark.ml.functions import array_to_vector

    frame = training_frame(model, "features", ["fold", *targets])
    asked = {(t, fold): (learner(t, n_trees, depth, seed), None if fold == -1 else F.col("fold") != fold) for t in targets for fold in [-1, *range(k)]}
    fits = fit_side_by_side(frame, asked)
    data = model.withColumn("_x", array_to_vector("features"))
    parts = []
    for fold in range(k):
        part = data.where(F.col("fold") == fold)
        for t in targets:
            part = fits[t, fold].transform(part).withColumnRenamed("_y", f"pred_{t}")
            part = fits[t, -1].transform(part).withColumnRenamed("_y", f"full_{t}")
        parts.append(part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(id_col, "fold", *targets, *[f"pred_{t}" for t in targets], *[f"full_{t}" for t in targets])


def one_feature_predictions(model: DataFrame, feature: str, targets: list[str], id_col: str) -> DataFrame:
    """D3/D4 with ordinary least squares on a single column, as plain aggregates.

    The sums of the other folds are the totals minus the fold's own; the K rows are broadcast.
    """
    x = F.col(feature)
    aggs = [F.count(x).alias("n"), F.sum(x).alias("x"), F.sum(x * x).alias("xx")]
    for t in targets:
        aggs += [F.sum(t).alias(f"y_{t}"), F.sum(x * F.col(t)).alias(f"xy_{t}")]
    per_fold = model.groupBy("fold").agg(*aggs)
    names = [c for c in per_fold.columns if c != "fold"]
    per_fold = cut(per_fold)  # K rows
    totals = scalars(per_fold.agg(*[F.sum(c).alias(c) for c in names]))
    rules = [F.col("fold").alias("_fold")]
    for tag in ("pred", "full"):
        def s(c, tag=tag):
            return totals[c] - F.col(c) if tag == "pred" else totals[c]

        for t in targets:
            slope = ratio(s(f"xy_{t}") - s("x") * s(f"y_{t}") / s("n"), s("xx") - s("x") * s("x") / s("n"))
            slope = F.coalesce(slope, F.lit(0.0))
            rules += [slope.alias(f"b_{tag}_{t}"), ((s(f"y_{t}") - slope * s("x")) / s("n")).alias(f"a_{tag}_{t}")]
    table = per_fold.select(*rules)
    joined = model.join(F.broadcast(table), F.col("fold") == F.col("_fold"))  # K rows
    return joined.select(
        id_col, "fold", *targets,
        *[
            (F.col(f"a_{tag}_{t}") + F.col(f"b_{tag}_{t}") * x).alias(f"{tag}_{t}")
            for tag in ("pred", "full") for t in targets
        ],
    )


# -- estimates from predictions -------------------------------------------------------------------


def residual_rows(pred: DataFrame, pairs: list[tuple[str, str]], variant: str, id_col: str) -> DataFrame:
    """One row per document, pair and kind (``cv`` true for held-out predictions)."""
    rows = []
    for t, y in pairs:
        for cv, tag in ((True, "pred"), (False, "full")):
            rows.append(
                F.struct(
                    F.lit(variant).alias("variant"), F.lit(t).alias("treatment"), F.lit(y).alias("outcome"), F.lit(cv).alias("cv"),
                    F.col(f"{tag}_{t}").alias("pred_treatment"), F.col(f"{tag}_{y}").alias("pred_outcome"),
                    (F.col(t) - F.col(f"{tag}_{t}")).alias("resid_treatment"),
                    (F.col(y) - F.col(f"{tag}_{y}")).alias("resid_outcome"),
                )
            )
    return pred.select(id_col, "fold", F.inline(F.array(*rows)))


def estimate(rows: DataFrame, n_features: int | None = None, keys=("variant", "treatment", "outcome", "cv")) -> DataFrame:
    """Theta, se, interval, p, residual and prediction correlation per group.

    One aggregation: the residual sum of squares follows from the three cross sums.
    """
    rt, ry = F.col("resid_treatment"), F.col("resid_outcome")
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(rt * rt).alias("_tt"), F.sum(rt * ry).alias("_ty"), F.sum(ry * ry).alias("_yy"),
        correlation(ry, rt).alias("corr_resid"),
        correlation("pred_outcome", "pred_treatment").alias("corr_pred"),
    )
    tt, ty, yy = F.col("_tt"), F.col("_ty"), F.col("_yy")
    theta = ratio(ty, tt)
    se = F.sqrt(ratio(F.greatest(yy - 2 * theta * ty + theta * theta * tt, F.lit(0.0)), F.col("n") * tt))
    out = sums.select(*keys, "n", theta.alias("theta"), se.alias("se"), "corr_resid", "corr_pred")
    out = (
        out.withColumn("ci_lower", F.col("theta") - 1.96 * F.col("se"))
        .withColumn("ci_upper", F.col("theta") + 1.96 * F.col("se"))
        .withColumn("t_stat", ratio(F.col("theta"), F.col("se")))
    )
    if n_features is None:
        return out
    return out.withColumn("p_value", t_tail(F.col("t_stat"), F.col("n") - n_features - 1))


def fold_r2(pred: DataFrame, targets: list[str], tag: str = "pred") -> DataFrame:
    """(target, fold, r2) about the fold's own mean."""
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y"), F.col(f"{tag}_{t}").alias("p")) for t in targets])
    long = pred.select("fold", F.inline(pairs))
    e = F.col("y") - F.col("p")
    return long.groupBy("target", "fold").agg(
        (1 - ratio(F.sum(e * e), F.var_pop("y") * F.count("y"))).alias("r2")
    )


def r2_summary(pred: DataFrame, targets: list[str]) -> DataFrame:
    """(target, mean, std over folds, all folds, r2 of the full fit)."""
    cv = fold_r2(pred, targets).groupBy("target").agg(
        F.avg("r2").alias("r2_cv"),
        F.stddev_pop("r2").alias("r2_cv_std"),
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "r2"))), lambda s: s["r2"]).alias("r2_folds"),
    )
    full = fold_r2(pred.withColumn("fold", F.lit(0)), targets, "full").select("target", F.col("r2").alias("r2_full"))
    return cv.join(full, "target")


def r2_comparison(summary: DataFrame) -> DataFrame:
    """Full minus cross-validated; null when the latter is missing or 0."""
    diff = F.when(F.col("r2_cv") != 0, F.col("r2_full") - F.col("r2_cv"))
    return summary.select("target", "r2_cv", "r2_full", diff.alias("r2_diff"))


def r2_comparison_by_variant(summary: DataFrame) -> DataFrame:
    """A24 with the feature set kept."""
    diff = F.when(F.col("r2_cv") != 0, F.col("r2_full") - F.col("r2_cv"))
    return summary.withColumn("r2_diff", diff)


def reduction(estimates: DataFrame, naive: DataFrame) -> DataFrame:
    """How much smaller the adjusted effect is, in percent, signed and by size."""
    base = naive.select("treatment", "outcome", F.col("theta").alias("naive_theta"))
    share = ratio(F.col("theta"), F.col("naive_theta"))
    size = ratio(F.abs("theta"), F.abs("naive_theta"))
    return (
        estimates.join(F.broadcast(base), ["treatment", "outcome"])  # one row per pair of outcomes
        .withColumn("reduction_signed", (1 - share) * 100)
        .withColumn("reduction_abs", (1 - size) * 100)
    )


def summary_table(naive: DataFrame, estimates: DataFrame) -> DataFrame:
    """Naive and adjusted estimates in one table, columns of only one of them null."""
    head = naive.withColumn("variant", F.lit("naive"))
    return head.unionByName(estimates, allowMissingColumns=True)


def display_rounding(summary: DataFrame, columns=("theta", "se", "ci_lower", "ci_upper", "r2", "correlation", "corr_resid", "corr_pred")) -> DataFrame:
    """Three decimals, one for the reductions, p untouched."""
    out = summary
    for c in columns:
        if c in out.columns:
            out = out.withColumn(c, F.round(c, 3))
    for c in ("reduction_signed", "reduction_abs"):
        if c in out.columns:
            out = out.withColumn(c, F.round(c, 1))
    return out


def double_ml(
    df: DataFrame,
    outcomes: list[str],
    features: str = "features",
    id_col: str = "id",
    k: int = 5,
    learner: str = "ridge",
    variant: str = "all",
    alpha: float = 1.0,
    n_trees: int = 100,
    depth: int = 5,
    cross_fit: bool = True,
    n_features: int | None = None,
) -> dict[str, DataFrame]:
    """D2-D13 for one feature set: ``rows``, ``estimates`` and ``r2``."""
    model = with_model_columns(df, id_col, features, outcomes, k)
    if n_features is None:
        n_features = model.agg(F.max(F.size("features"))).first()[0] or 0
    if learner == "ridge":
        pred = ridge_predictions(model, outcomes, k, id_col, alpha)
    elif learner == "gbt":
        pred = gbt_predictions(model, outcomes, k, id_col, n_trees, depth)
    else:
        raise ValueError(f"unknown learner '{learner}'")
    rows = residual_rows(pred, ordered_pairs(outcomes), variant, id_col)
    wanted = rows.where(F.col("cv") == F.lit(cross_fit))
    return {"rows": rows, "estimates": estimate(wanted, n_features), "r2": r2_summary(pred, outcomes).withColumn("variant", F.lit(variant))}
