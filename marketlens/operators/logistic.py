"""Ridge logistic regression by Newton steps on sufficient statistics (M-04).

Each step is one aggregate over the rows: the weighted loss, the gradient and
the upper half of the Hessian, (d + 1) * (d + 4) / 2 + 1 sums whatever the
number of rows. The (d + 1)-square system is solved on the driver. The rows
stay in whole-stage code; nothing else is shuffled or collected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.session import plain_plans


@dataclass
class LogisticFit:
    coefficients: list[float]
    intercept: float
    steps: int
    gradient_norm: float


def margin(features: list[str], coefficients: list[float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for w, c in zip(coefficients, features, strict=True):
        out = out + F.lit(float(w)) * F.col(c)
    return out


def _step_sums(rows: DataFrame, features: list[str], label: str, weight: str, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, Hessian) of the weighted logistic loss at ``theta`` (coefficients, then intercept)."""
    m = rows.withColumn("_m", margin(features, theta[:-1].tolist(), theta[-1]))
    m = m.withColumn("_p", 1.0 / (1.0 + F.exp(-F.col("_m"))))
    y, w, p = F.col(label).cast("double"), F.col(weight), F.col("_p")
    x = [F.col(c) for c in features] + [F.lit(1.0)]
    residual, curve = w * (p - y), w * p * (1.0 - p)
    loss = w * (F.log1p(F.exp(-F.abs("_m"))) + F.greatest("_m", F.lit(0.0)) - y * F.col("_m"))
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = [F.sum(loss)] + [F.sum(residual * v) for v in x] + [F.sum(curve * x[i] * x[j]) for i, j in pairs]
    with plain_plans(rows.sparkSession):
        values = m.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).collect()[0]
    values = np.array([v or 0.0 for v in values])
    hessian = np.zeros((len(x), len(x)))
    for (i, j), v in zip(pairs, values[1 + len(x):], strict=True):
        hessian[i, j] = hessian[j, i] = v
    return values[0], values[1 : 1 + len(x)], hessian


def fit_logistic(rows: DataFrame, features: list[str], label: str, weight: str, ridge: float = 1.0, tol: float = 1e-9,
                 max_steps: int = 60) -> LogisticFit:
    """Minimum of sum(weight * log loss) + ridge / 2 * |coefficients|**2 (the intercept is free) over ``rows``, which should be persisted.

    A step is halved while it raises the objective. The fit ends when the
    largest gradient entry is at most ``tol`` times that at the start."""
    theta = np.zeros(len(features) + 1)
    penalty = np.append(np.full(len(features), ridge), 0.0)
    base, step, best, first = theta, np.zeros_like(theta), np.inf, None
    norm, n = np.inf, 0
    for n in range(1, max_steps + 1):
        loss, gradient, hessian = _step_sums(rows, features, label, weight, theta)
        objective = loss + 0.5 * float(penalty @ theta**2)
        if objective > best * (1 + 1e-12) + 1e-12:
            step = step / 2
            theta = base - step
            continue
        gradient = gradient + penalty * theta
        norm = float(np.abs(gradient).max())
        first = norm if first is None else first
        if norm <= tol * first:
            break
        best, base = objective, theta
        step = np.linalg.lstsq(hessian + np.diag(penalty), gradient, rcond=None)[0]  # singular if the intercept has no curvature left
        theta = base - step
    return LogisticFit(theta[:-1].tolist(), float(theta[-1]), n, norm)
