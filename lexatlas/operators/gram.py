"""Per-fold sufficient statistics of a least-squares problem, in one pass over the rows.

Each task keeps one small matrix per fold. Tasks send the matrices as blocks of rows, which are
added up in two levels, so that no task receives more than about the square root of the number
of partitions. The result, (1 + features + targets) squared per fold, is what the driver sees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexatlas.functions.scalars import doubles, fold_of
from lexatlas.session import parallelism

BLOCK_ROWS = 256
_SCHEMA = "fold int, block int, shard int, sums array<double>"


@dataclass
class Gram:
    """Sums over rows of z z' per fold, z = (1, x - shift, y - shift)."""

    folds: dict[int, np.ndarray]
    shift: np.ndarray  # p + q values subtracted before summing
    p: int
    targets: list[str]

    @property
    def total(self) -> np.ndarray:
        return sum(self.folds.values())

    def target(self, name: str) -> int:
        return 1 + self.p + self.targets.index(name)

    def train(self, fold: int | None) -> np.ndarray:
        """All rows but those of ``fold``: by subtraction."""
        return self.total if fold is None else self.total - self.folds.get(fold, 0.0)


def with_model_columns(df: DataFrame, id_col: str, features: str, targets: list[str], k: int, seed: int = 42) -> DataFrame:
    """(id, fold, features, targets..): the only columns the estimators read."""
    return df.select(
        id_col,
        fold_of(id_col, k, seed).alias("fold"),
        doubles(features).alias("features"),
        *[F.col(t).cast("double").alias(t) for t in targets],
    )


def gram(df: DataFrame, targets: list[str], features: str = "features", fold: str = "fold") -> Gram:
    """Sums for every fold and target at once. ``df`` needs ``fold``, ``features`` and the targets."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    z = F.concat(F.col(features), F.array(*[F.col(t) for t in targets]))
    data = df.select(F.col(fold).alias("fold"), z.alias("z"))
    if data.isEmpty():
        raise ValueError("no rows to fit")
    means = data.agg(vector_to_array(Summarizer.mean(array_to_vector("z"))).alias("m")).first()["m"]
    shift = np.asarray(means, dtype=float)
    if np.isnan(shift).any():
        raise ValueError("features and targets must be complete")
    width = len(shift) + 1
    spread = max(1, int(parallelism(df.sparkSession) ** 0.5))
    centre = df.sparkSession.sparkContext.broadcast(shift)

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            rows = np.stack(pdf["z"].to_numpy()) - centre.value
            rows = np.hstack([np.ones((len(rows), 1)), rows])
            fold_of_row = pdf["fold"].to_numpy()
            for f in np.unique(fold_of_row):
                part = rows[fold_of_row == f]
                sums[f] = sums.get(f, 0.0) + part.T @ part
        if sums:
            from pyspark import TaskContext

            shard = TaskContext.get().partitionId() % spread
            for f, m in sums.items():
                for b in range(0, width, BLOCK_ROWS):
                    yield pd.DataFrame(
                        {"fold": [int(f)], "block": [b // BLOCK_ROWS], "shard": [shard], "sums": [m[b : b + BLOCK_ROWS].ravel()]}
                    )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        total = np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)
        return pd.DataFrame({"fold": [head["fold"]], "block": [head["block"]], "shard": [head["shard"]], "sums": [total]})

    level1 = data.mapInPandas(partial, _SCHEMA).groupBy("fold", "block", "shard").applyInPandas(add, _SCHEMA)
    level2 = level1.groupBy("fold", "block").applyInPandas(add, _SCHEMA)
    folds: dict[int, list] = {}
    for r in level2.collect():  # (1 + p + q)^2 numbers per fold
        folds.setdefault(r["fold"], []).append((r["block"], np.asarray(r["sums"]).reshape(-1, width)))
    merged = {f: np.vstack([m for _, m in sorted(parts, key=lambda t: t[0])]) for f, parts in folds.items()}
    return Gram(merged, shift, width - 1 - len(targets), list(targets))


def gram_entries(df: DataFrame, columns: list[str], fold: str = "fold") -> DataFrame:
    """The same sums for a few scalar columns, as plain aggregates: (fold, n, sum_<a>, sum_<a>_<b>)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(columns):
        aggs.append(F.sum(a).alias(f"sum_{a}"))
        aggs += [F.sum(F.col(a) * F.col(b)).alias(f"sum_{a}_{b}") for b in columns[i:]]
    return df.groupBy(fold).agg(*aggs)


# -- solvers on the small matrices ------------------------------------------------------------


def centred(m: np.ndarray, p: int, target: int):
    """(n, mean x, mean y, Sxx, Sxy, Syy) from a sum matrix; means relative to the shift."""
    n = m[0, 0]
    mx, my = m[0, 1 : p + 1] / n, m[0, target] / n
    sxx = m[1 : p + 1, 1 : p + 1] - n * np.outer(mx, mx)
    sxy = m[1 : p + 1, target] - n * mx * my
    return n, mx, my, sxx, sxy, max(m[target, target] - n * my * my, 0.0)


def ridge_fit(m: np.ndarray, p: int, target: int, alpha: float, scale: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Coefficients and intercept (both relative to the shift) of ridge with an unpenalised
    intercept. ``scale`` standardises the features; the coefficients are then for scaled features."""
    n, mx, my, sxx, sxy, _ = centred(m, p, target)
    s = np.ones(p) if scale is None else scale
    a = sxx / np.outer(s, s) + alpha * np.eye(p)
    coef = np.linalg.lstsq(a, sxy / s, rcond=None)[0] if alpha == 0 else np.linalg.solve(a, sxy / s)
    return coef, float(my - (mx / s) @ coef)


def deviations(m: np.ndarray, p: int) -> np.ndarray:
    """Population deviation per feature, 1 for a constant one."""
    n = m[0, 0]
    var = np.diag(m)[1 : p + 1] / n - (m[0, 1 : p + 1] / n) ** 2
    sd = np.sqrt(np.maximum(var, 0.0))
    return np.where(sd > 1e-12, sd, 1.0)


def squared_error(m: np.ndarray, p: int, target: int, coef: np.ndarray, intercept: float) -> float:
    """Sum of squared residuals of a linear rule on the rows behind ``m``."""
    w = np.zeros(m.shape[0])
    w[0], w[1 : p + 1], w[target] = -intercept, -coef, 1.0
    return float(max(w @ m @ w, 0.0))


class NotSettled(RuntimeError):
    """A fit that has not reached its tolerance within its sweeps."""


def duality_gap(q: np.ndarray, c: np.ndarray, yy: float, alpha: float, b: np.ndarray) -> tuple[float, float]:
    """(gap, scale) of 1/(2n) |y - Xb|^2 + alpha |b|_1 on q = X'X / n, c = X'y / n and yy = y'y / n.

    The residual times ``scale`` is a feasible point of the dual problem, so the least value is at most ``gap`` below that of b.
    """
    grad = c - q @ b
    rr = max(yy - 2 * b @ c + b @ q @ b, 0.0)
    peak = float(np.abs(grad).max(initial=0.0))
    scale = min(1.0, alpha / peak) if peak > 0 else 1.0
    primal = rr / 2 + alpha * float(np.abs(b).sum())
    return max(primal - (scale * (yy - b @ c) - scale * scale * rr / 2), 0.0), scale


def lasso_fit(
    gram_xx: np.ndarray, xy: np.ndarray, n: float, alpha: float, yy: float, start=None, max_sweeps: int = 100_000, tol: float = 1e-10
) -> tuple[np.ndarray, float]:
    """(b, gap): coordinate descent for 1/(2n) |y - Xb|^2 + alpha |b|_1 on the covariances, until the duality gap is at most ``tol`` times yy / (2n).

    Features that the gap proves to be unused are left out of the sweeps. Fails if ``max_sweeps`` are not enough.
    """
    b = np.zeros(len(xy)) if start is None else start.copy()
    q, c, yy = gram_xx / n, xy / n, yy / n
    diag = np.diag(q)
    usable = diag > 1e-15
    b[~usable] = 0.0
    limit = tol * max(yy / 2, 1e-300)
    grad = c - q @ b
    for sweep in range(max_sweeps):
        if sweep % 10 == 0:
            grad = c - q @ b  # without the rounding of the updates
            gap, scale = map(float, duality_gap(q, c, yy, alpha, b))
            if gap <= limit:
                return b, gap
            idle = scale * np.abs(grad) + np.sqrt(2 * np.maximum(diag, 0.0) * gap) < alpha
            if (b[idle] != 0).any():
                b[idle] = 0.0
                grad = c - q @ b
            usable &= ~idle
        for j in np.flatnonzero(usable & ((b != 0) | (np.abs(grad) > alpha))):
            rho = grad[j] + diag[j] * b[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / diag[j]
            step = new - b[j]
            if step:
                grad -= q[:, j] * step
                b[j] = new
    raise NotSettled(f"lasso with penalty {alpha}: duality gap {gap} after {max_sweeps} sweeps, wanted {limit}")
