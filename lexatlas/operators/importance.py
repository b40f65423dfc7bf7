"""Which components predict the outcomes. All methods give (method, outcome, pc, importance)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from lexatlas.functions.scalars import ratio
from lexatlas.operators.cleaning import scalars
from lexatlas.operators.gram import Gram, centred, deviations, gram, lasso_fit, ridge_fit, squared_error
from lexatlas.operators.ranking import importance_ranks, quantiles
from lexatlas.operators.trees import SEED, fit_side_by_side, learner, training_frame

SCHEMA = "method string, outcome string, pc int, importance double"
ALPHA_SCHEMA = "method string, outcome string, alpha double, gap double"
RIDGE_ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)


def _table(spark, method: str, outcome: str, values) -> DataFrame:
    """One row per component: no larger than a feature vector."""
    return spark.createDataFrame([(method, outcome, i, float(v)) for i, v in enumerate(values)], SCHEMA)


def boosted(model: DataFrame, targets: list[str], n_trees: int = 100, depth: int = 6, seed: int = SEED, method: str = "gbt") -> DataFrame:
    """importance of boosted trees, one distributed training per outcome, side by side."""
    frame = training_frame(model, "features", targets)
    fits = fit_side_by_side(frame, {t: (learner(t, n_trees, depth, seed), None) for t in targets})
    out = None
    for t in targets:
        part = _table(model.sparkSession, method, t, fits[t].featureImportances.toArray())
        out = part if out is None else out.unionByName(part)
    return out


def fold_ranks(model: DataFrame, targets: list[str], k: int = 5, n_trees: int = 50, depth: int = 4) -> DataFrame:
    """(outcome, fold, pc, importance, rank) of trees trained without one fold at a time, all of them side by side."""
    frame = training_frame(model, "features", ["fold", *targets])
    fits = fit_side_by_side(frame, {(t, fold): (learner(t, n_trees, depth), F.col("fold") != fold) for t in targets for fold in range(k)})
    out = None
    for (t, fold), fitted in fits.items():
        part = _table(model.sparkSession, "gbt", t, fitted.featureImportances.toArray()).withColumn("fold", F.lit(fold))
        out = part if out is None else out.unionByName(part)
    return importance_ranks(out, ["outcome", "fold"])


def _scaled(m: np.ndarray, p: int, sd: np.ndarray) -> np.ndarray:
    s = np.ones(m.shape[0])
    s[1 : p + 1] = 1.0 / sd
    return m * np.outer(s, s)


def lasso_path(g: Gram, target: str, alphas=None, n_alphas: int = 100) -> tuple[np.ndarray, float, float]:
    """(coefficients for standardised features, alpha with the least held-out error, duality gap of the final fit).

    Every fold is fitted from the training sums alone; no further pass over the rows.
    """
    p, at = g.p, g.target(target)
    sd = deviations(g.total, p)
    full = _scaled(g.total, p, sd)
    n, _, _, sxx, sxy, syy = centred(full, p, at)
    if alphas is None:
        top = float(np.max(np.abs(sxy)) / n) or 1.0
        alphas = np.geomspace(top, top * 1e-3, n_alphas)
    alphas = sorted((float(a) for a in alphas), reverse=True)
    error = np.zeros(len(alphas))
    for fold in g.folds:
        train, test = _scaled(g.train(fold), p, sd), _scaled(g.folds[fold], p, sd)
        fn, mx, my, fxx, fxy, fyy = centred(train, p, at)
        if fn < 2:
            continue
        b = None
        for i, a in enumerate(alphas):
            b, _ = lasso_fit(fxx, fxy, fn, a, fyy, b, tol=1e-6)
            error[i] += squared_error(test, p, at, b, my - mx @ b) / test[0, 0]
    best = alphas[int(np.argmin(error))]
    coef, gap = lasso_fit(sxx, sxy, n, best, syy, tol=1e-12)
    return coef, best, gap


def ridge_choice(g: Gram, target: str, alphas=RIDGE_ALPHAS) -> tuple[np.ndarray, float]:
    """(coefficients for standardised features, alpha with the best mean held-out R2)."""
    p, at = g.p, g.target(target)
    sd = deviations(g.total, p)
    score = np.zeros(len(alphas))
    for fold in g.folds:
        train, test = _scaled(g.train(fold), p, sd), _scaled(g.folds[fold], p, sd)
        if train[0, 0] < 2:
            continue
        syy = centred(test, p, at)[5]
        for i, a in enumerate(alphas):
            coef, inter = ridge_fit(train, p, at, a)
            score[i] += 1.0 - squared_error(test, p, at, coef, inter) / syy if syy > 0 else 0.0
    best = float(alphas[int(np.argmax(score))])
    return ridge_fit(_scaled(g.total, p, sd), p, at, best)[0], best


def regularised(model: DataFrame, targets: list[str], method: str, alphas=None, g: Gram | None = None) -> tuple[DataFrame, DataFrame]:
    """importance |coefficient|, and the chosen alphas with the duality gap of the lasso."""
    g = g or gram(model, targets)
    out, chosen = None, []
    for t in targets:
        coef, alpha, gap = lasso_path(g, t, alphas) if method == "lasso" else (*ridge_choice(g, t, alphas or RIDGE_ALPHAS), None)
        part = _table(model.sparkSession, method, t, np.abs(coef))
        out = part if out is None else out.unionByName(part)
        chosen.append((method, t, alpha, gap))
    return out, model.sparkSession.createDataFrame(chosen, ALPHA_SCHEMA)


def binned_mi(df: DataFrame, targets: list[str], features: str = "features", bins: int = 10) -> DataFrame:
    """mutual information of each component and outcome over equal-frequency bins.

    Edges are exact quantiles with equal ones merged; a value on an edge belongs to the lower bin.
    """
    names = [f"q{i}" for i in range(1, bins)]
    probs = {f"q{i}": i / bins for i in range(1, bins)}

    def place(value, edges):
        return F.size(F.filter(F.array_distinct(edges), lambda e: e < value))

    long_y = df.select(F.inline(F.array(*[F.struct(F.lit(t).alias("outcome"), F.col(t).cast("double").alias("value")) for t in targets])))
    y_edges = quantiles(long_y, ["outcome"], "value", probs)
    y_row = scalars(
        y_edges.agg(*[F.max(F.when(F.col("outcome") == t, F.array(*names))).alias(f"e{i}") for i, t in enumerate(targets)])
    )
    edged = df.withColumns({f"_e{i}": y_row[f"e{i}"] for i in range(len(targets))})
    y_bins = [place(F.col(t).cast("double"), F.col(f"_e{i}")).alias(f"b{i}") for i, t in enumerate(targets)]
    long = edged.select(F.posexplode(features).alias("pc", "value"), *y_bins).withColumn("value", F.col("value").cast("double"))
    x_edges = quantiles(long.select("pc", "value"), ["pc"], "value", probs).select("pc", F.array(*names).alias("_e"))
    binned = long.join(F.broadcast(x_edges), "pc").withColumn("bx", place(F.col("value"), F.col("_e")))  # one row per component
    pairs = F.array(*[F.struct(F.lit(t).alias("outcome"), F.col(f"b{i}").alias("by")) for i, t in enumerate(targets)])
    # bins x bins x components x outcomes rows from here on
    cells = (
        binned.groupBy("pc", "bx", *[f"b{i}" for i in range(len(targets))])
        .agg(F.count(F.lit(1)).alias("c"))
        .select("pc", "bx", "c", F.inline(pairs))
        .groupBy("pc", "outcome", "bx", "by")
        .agg(F.sum("c").alias("c"))
    )
    key = ["pc", "outcome"]
    n = F.sum("c").over(Window.partitionBy(*key))
    cx = F.sum("c").over(Window.partitionBy(*key, "bx"))
    cy = F.sum("c").over(Window.partitionBy(*key, "by"))
    term = F.col("c") / n * F.log(F.col("c") * n / (cx * cy).cast("double"))
    return (
        cells.select(*key, term.alias("_t"))
        .groupBy(*key)
        .agg(F.greatest(F.sum("_t"), F.lit(0.0)).alias("importance"))
        .select(F.lit("mi").alias("method"), "outcome", "pc", "importance")
    )


def average_importance(imp: DataFrame) -> DataFrame:
    """(method, pc, importance) averaged over the outcomes."""
    return imp.groupBy("method", "pc").agg(F.avg("importance").alias("importance"))


def top_components(imp: DataFrame, n_top: int = 6) -> DataFrame:
    """(method, rank, pc, importance) of the best ``n_top`` per method."""
    ranked = importance_ranks(average_importance(imp), ["method"])
    return ranked.where(F.col("rank") <= n_top)


def primary_components(top: DataFrame, primary: str, order: tuple[str, ...]) -> tuple[str, list[int]]:
    """the chosen method (the first available one when ``primary`` is missing) and its components."""
    rows = top.orderBy("method", "rank").collect()  # a few rows per method
    have = {r["method"] for r in rows}
    if not have:
        raise ValueError("no selection method has been run")
    chosen = primary if primary in have else next(m for m in order if m in have)
    return chosen, [r["pc"] for r in rows if r["method"] == chosen]


def importance_summary(imp: DataFrame, n_top: int = 6, methods=("gbt", "lasso", "ridge", "mi")) -> DataFrame:
    """One row per component: average importance and list rank for each method."""
    avg = average_importance(imp)
    ranked = importance_ranks(avg, ["method"])
    n = F.count(F.lit(1)).over(Window.partitionBy("method"))
    ranked = ranked.withColumn("list_rank", F.when(F.col("rank") <= n_top, F.col("rank")).otherwise(n + 1))
    aggs = []
    for m in methods:
        mine = F.col("method") == m
        aggs += [
            F.max(F.when(mine, F.col("importance"))).alias(f"{m}_importance"),
            F.max(F.when(mine, F.col("list_rank"))).alias(f"{m}_rank"),
        ]
    return ranked.groupBy("pc").agg(*aggs)


def selection_summary(top: DataFrame) -> DataFrame:
    """(method, components) with the chosen ones as text, best first."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "pc"))), lambda s: F.concat(F.lit("PC"), s["pc"].cast("string")))
    return top.groupBy("method").agg(F.array_join(words, ", ").alias("components"))
