"""Student-t tail probabilities for the regression reports (vectorised, one call per batch)."""

from __future__ import annotations

import math

import numpy as np


def two_sided_p(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(|T| > |t|), by the continued fraction of the incomplete beta function."""
    t = np.asarray(t, float)
    dof = np.broadcast_to(np.asarray(dof, float), t.shape)
    ok = np.isfinite(t) & (dof > 0)
    out = np.where(np.isinf(t) & (dof > 0), 0.0, np.nan)
    if ok.any():
        v = dof[ok]
        out[ok] = _beta_ratio(v / 2.0, np.full(v.shape, 0.5), v / (v + t[ok] ** 2))
    return out


def _beta_ratio(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    swap = x > (a + 1.0) / (a + b + 2.0)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    gamma = np.vectorize(math.lgamma)
    with np.errstate(divide="ignore"):
        front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    value = front * _fraction(a, b, x)
    value = np.where(x <= 0, 0.0, value)
    return np.where(swap, 1.0 - value, value)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300

    def guard(z: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) < tiny, tiny, z)

    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 / guard(1.0 + step * d)
            c = guard(1.0 + step / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h
