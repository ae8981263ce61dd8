"""Least squares from grouped moments: the sums are Spark aggregates, the solve is one
stacked call over a batch of groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.functions.student import two_sided_p

FIT_SCHEMA = T.StructType(
    [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("coef", "se", "t", "p")]
    + [T.StructField(n, T.DoubleType()) for n in ("mse", "rsq", "adj_rsq")]
    + [T.StructField("rank", T.IntegerType())]
)


def moments(y: Column, xs: Sequence[Column], where: Column | None = None) -> list[Column]:
    """Count, means and (co)variances of complete rows; merged map-side, stable under shifts."""
    series = [*xs, y]
    complete = series[0].isNotNull()
    for s in series[1:]:
        complete = complete & s.isNotNull()
    if where is not None:
        complete = complete & where
    kept = [F.when(complete, s.cast("double")) for s in series]
    pairs = [F.covar_samp(kept[i], kept[j]) for i in range(len(kept)) for j in range(i, len(kept))]
    return [
        F.count(kept[0]).alias("fit_n"),
        F.array(*[F.avg(s) for s in kept]).alias("fit_means"),
        F.array(*pairs).alias("fit_cov"),
    ]


def _solved(n: np.ndarray, means: np.ndarray, packed: np.ndarray) -> dict[str, np.ndarray]:
    """Coefficients, errors and fit of a stack of groups with equally many variables."""
    rows, m = means.shape
    k = m - 1
    out = {c: np.full((rows, m), np.nan) for c in ("coef", "se", "t")}
    out |= {c: np.full(rows, np.nan) for c in ("mse", "rsq", "adj_rsq")} | {"rank": np.zeros(rows, int)}
    ok = (n >= 2) & np.isfinite(packed).all(axis=1)
    if not ok.any():
        return out
    n, means = n[ok], means[ok]
    cov = np.zeros((len(n), m, m))
    upper = np.triu_indices(m)
    cov[:, upper[0], upper[1]] = packed[ok]
    cov[:, upper[1], upper[0]] = packed[ok]
    xbar, ybar = means[:, :k], means[:, k]
    sx, sy = cov[:, :k, :k], cov[:, :k, k]
    spread = np.sqrt(np.diagonal(sx, axis1=1, axis2=2))
    scale = np.where(spread > 0, spread, 1.0)
    corr = sx / (scale[:, :, None] * scale[:, None, :])
    rank = (np.linalg.eigvalsh(corr) > 1e-12).sum(axis=1) if k else np.zeros(len(n), int)

    coef, diag = np.zeros((len(n), m)), np.zeros((len(n), m))
    full = rank == k
    if full.any():
        inv = np.linalg.inv(corr[full]) / (scale[full][:, :, None] * scale[full][:, None, :])
        slopes = np.einsum("rij,rj->ri", inv, sy[full])
        cross = inv / (n[full] - 1)[:, None, None]
        coef[full] = np.column_stack([ybar[full] - (slopes * xbar[full]).sum(axis=1), slopes])
        own = np.einsum("ri,rij,rj->r", xbar[full], cross, xbar[full])
        diag[full] = np.column_stack([1.0 / n[full] + own, np.diagonal(cross, axis1=1, axis2=2)])
    short = ~full
    if short.any():
        # minimum-norm solution, as a pseudo-inverse of the design would give; moments of [const, xs] in original units
        raw = np.empty((short.sum(), m, m))
        raw[:, 0, 0] = n[short]
        raw[:, 0, 1:] = raw[:, 1:, 0] = n[short][:, None] * xbar[short]
        raw[:, 1:, 1:] = (n[short] - 1)[:, None, None] * sx[short] + n[short][:, None, None] * xbar[short][:, :, None] * xbar[short][:, None, :]
        inv = np.linalg.pinv(raw, rcond=1e-13, hermitian=True)
        right = (n[short] - 1)[:, None] * sy[short] + (n[short] * ybar[short])[:, None] * xbar[short]
        coef[short] = np.einsum("rij,rj->ri", inv, np.column_stack([n[short] * ybar[short], right]))
        diag[short] = np.diagonal(inv, axis1=1, axis2=2)
    slopes = coef[:, 1:]
    tss = (n - 1) * cov[:, k, k]
    left = cov[:, k, k] - 2 * (slopes * sy).sum(axis=1) + np.einsum("ri,rij,rj->r", slopes, sx, slopes)
    ssr = np.maximum((n - 1) * left, 0.0)
    dof = n - rank - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        mse = np.where(dof > 0, ssr / dof, np.nan)
        rsq = np.where(tss > 0, 1.0 - ssr / tss, np.nan)
        adj = np.where(dof > 0, 1.0 - (n - 1) / dof * (1.0 - rsq), np.nan)
        se = np.sqrt(np.maximum(diag, 0.0) * mse[:, None])
        t = coef / se
    for name, value in (("coef", coef), ("se", se), ("t", t), ("mse", mse), ("rsq", rsq), ("adj_rsq", adj), ("rank", rank)):
        out[name][ok] = value
    return out


def _fitted(n: pd.Series, means: pd.Series, cov: pd.Series, with_p: bool) -> pd.DataFrame:
    if not len(n):
        return pd.DataFrame({f.name: [] for f in FIT_SCHEMA})
    # all groups of a call have the same variables
    found = _solved(n.to_numpy(float), np.array(means.tolist(), float), np.array(cov.tolist(), float))
    dof = n.to_numpy(float) - found["rank"] - 1
    found["p"] = two_sided_p(found["t"], dof[:, None]) if with_p else np.full_like(found["t"], np.nan)
    return pd.DataFrame({f.name: list(found[f.name]) for f in FIT_SCHEMA})


@F.pandas_udf(FIT_SCHEMA)
def fit(n: pd.Series, means: pd.Series, cov: pd.Series) -> pd.DataFrame:
    """Ordinary least squares with intercept for each row of moments, a batch at a time."""
    return _fitted(n, means, cov, True)


@F.pandas_udf(FIT_SCHEMA)
def fit_only(n: pd.Series, means: pd.Series, cov: pd.Series) -> pd.DataFrame:
    """As `fit`, without p-values."""
    return _fitted(n, means, cov, False)
