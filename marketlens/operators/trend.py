"""Monthly series with a piecewise-linear trend and yearly seasonality (M-09), numpy only: runs inside tasks.

    y(t) = level + slope * t + sum_j change_j * max(0, t - knot_j) + yearly Fourier terms

Level and slope are free, the Fourier terms have a ridge penalty, the slope
changes an L1 penalty, so that few knots are used. The free and ridge terms
are projected out; the changes are then found by coordinate descent on the
Gram matrix of the projected knots. The penalty is the universal threshold
sigma * sqrt(2 log(knots)) with sigma estimated along with the changes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KNOTS, KNOT_SHARE = 25, 0.8  # candidate knots, in the first part of the history
HARMONICS, RIDGE = 3, 1.0


@dataclass
class Trend:
    yhat: np.ndarray  # history, then the future months
    sd: np.ndarray  # of an observation around yhat
    knots: list[tuple[int, float]]  # (month position, change of the slope per month)


def descend(gram: np.ndarray, target: np.ndarray, penalty: float, start: np.ndarray, tol: float = 1e-10, rounds: int = 2000) -> np.ndarray:
    """Minimum of b'Gb / 2 - b't + penalty * |b|_1 by coordinate descent."""
    b, scale = start.copy(), np.diag(gram)
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(scale > 0):
            pull = target[j] - gram[j] @ b + scale[j] * b[j]
            new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / scale[j]
            moved, b[j] = max(moved, abs(new - b[j])), new
        if moved <= tol:
            break
    return b


def fit(y: np.ndarray, first_month: int, periods: int) -> Trend:
    """Fit the history ``y``, whose first value is of calendar month ``first_month`` (1 to 12), and go on for ``periods`` months."""
    n = len(y)
    unit = float(np.abs(y).max()) or 1.0
    span = max(n - 1, 1)
    t = np.arange(n + periods) / span
    angle = 2 * np.pi * (np.arange(n + periods) + first_month - 1) / 12
    free = np.column_stack([np.ones_like(t), t, *(f(k * angle) for k in range(1, HARMONICS + 1) for f in (np.sin, np.cos))])
    places = np.unique(np.linspace(1, max(KNOT_SHARE * (n - 1), 1), KNOTS).astype(int)) if n > 3 else np.zeros(0, int)
    bend = np.maximum(0.0, t[:, None] - places / span)
    z, d, target = free[:n], bend[:n], y / unit
    inner = z.T @ z + np.diag([0.0, 1e-9] + [RIDGE] * (2 * HARMONICS))
    without = lambda x: x - z @ np.linalg.solve(inner, z.T @ x)
    rest, resid = without(d), without(target)
    gram, pull = d.T @ rest, d.T @ resid
    size = np.sqrt(np.maximum(np.diag(gram), 0.0))
    usable = size > 1e-9
    size = np.where(usable, size, 1.0)
    gram, pull = gram / np.outer(size, size) * np.outer(usable, usable), pull / size * usable
    taken = float(np.trace(np.linalg.solve(inner, z.T @ z)))
    change = np.zeros(len(places))
    for _ in range(20):  # sigma and changes in turn
        left = resid - rest @ (change / size * usable)
        sigma = float(np.sqrt(left @ left / max(n - taken - np.count_nonzero(change), 1.0)))
        before = change
        change = descend(gram, pull, sigma * np.sqrt(2 * np.log(max(len(places), 2))), change)
        if np.abs(change - before).max(initial=0.0) <= 1e-8:
            break
    change = change / size * usable
    own = np.linalg.solve(inner, z.T @ (target - d @ change))
    yhat = free @ own + bend @ change
    left = target - yhat[:n]
    used = np.flatnonzero(change)
    sigma = float(np.sqrt(left @ left / max(n - taken - len(used), 1.0)))
    # later slope changes come as often, and are on average as large, as those found
    step = np.arange(1, periods + 1)
    spread = len(used) / n * 2 * (np.abs(change[used]).mean() / span if len(used) else 0.0) ** 2 * np.cumsum(step.astype(float) ** 2)
    sd = np.sqrt(sigma**2 + np.concatenate([np.zeros(n), spread]))
    return Trend(yhat * unit, sd * unit, [(int(places[j]), float(change[j] / span * unit)) for j in used])
