"""Box-Cox Cole-Green regression: median, spread and skewness each linear in covariates (spread on the log scale)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.functions.draws import hash_uniform_np, poisson_weight_np
from cohortframe.operators.clean_rows import numeric_rows
from cohortframe.operators.iterate import newton
from cohortframe.session import small_rows

_erf = np.vectorize(math.erf, otypes=[float])


def bccg_terms(y: np.ndarray, mu: np.ndarray, sigma: np.ndarray, nu: np.ndarray):
    """Log density and its derivatives in (mu, sigma, nu); the density is cut off at zero."""
    ratio = np.log(y / mu)
    flat = np.abs(nu * ratio) < 1e-6
    safe = np.where(np.abs(nu) < 1e-12, 1e-12, nu)
    power = np.where(flat, 0.0, np.expm1(safe * ratio) / safe)
    z = np.where(flat, ratio * (1 + nu * ratio / 2), power) / sigma
    cut = 1 / (sigma * np.maximum(np.abs(nu), 1e-12))
    inside = 0.5 * (1 + _erf(np.minimum(cut, 40.0) / math.sqrt(2)))
    hazard = np.where(cut < 38, np.exp(-np.minimum(cut, 40.0) ** 2 / 2) / math.sqrt(2 * math.pi) / inside, 0.0)
    loglik = nu * ratio - np.log(sigma) - z * z / 2 - np.log(y) - 0.5 * math.log(2 * math.pi) - np.log(inside)
    d_mu = (z / sigma + nu * (z * z - 1)) / mu
    d_sigma = (z * z - 1) / sigma + hazard * cut / sigma
    # derivative of z in nu, with its limit at zero
    dz = np.where(flat, ratio * ratio / (2 * sigma) + nu * ratio**3 / (3 * sigma), (ratio * (1 + nu * sigma * z) / sigma - z) / safe)
    d_nu = ratio - z * dz + np.where(np.abs(nu) < 1e-12, 0.0, hazard * cut / safe)
    return loglik, d_mu, d_sigma, d_nu


def gradient(y: np.ndarray, eta: list[np.ndarray], log_mu: bool):
    """Row scores in the three linear predictors, and the log density."""
    mu = np.exp(eta[0]) if log_mu else eta[0]
    sigma = np.exp(eta[1])
    loglik, d_mu, d_sigma, d_nu = bccg_terms(y, mu, sigma, eta[2])
    return (d_mu * (mu if log_mu else 1.0), d_sigma * sigma, d_nu), loglik


def bccg_kernel(terms: int, log_mu: bool, seed: int):
    """Columns: key, weight, y, design. Payload: (theta, replicate); replicate 0 keeps the rows as they are."""
    size = 3 * terms

    def kernel(values: np.ndarray, payload) -> np.ndarray:
        with np.errstate(all="ignore"):
            return sums(values, payload)

    def sums(values: np.ndarray, payload) -> np.ndarray:
        theta, replicate = payload
        key, w, y, x = values[:, 0], values[:, 1], values[:, 2], values[:, 3:]
        if replicate:
            w = w * poisson_weight_np(hash_uniform_np(key.astype(np.int64), np.int64(replicate), seed))
        used = (w > 0) & (y > 0)
        w, y, x = w[used], y[used], x[used]
        out = np.zeros(1 + size + size * size)
        eta = [x @ theta[i * terms : (i + 1) * terms] for i in range(3)]
        mu = np.exp(eta[0]) if log_mu else eta[0]
        sigma = np.exp(eta[1])
        if len(y) and (np.any(mu <= 0) or not np.all(np.isfinite(sigma))):
            out[0] = -np.inf
            return out
        score, loglik = gradient(y, eta, log_mu)
        out[0] = np.sum(w * loglik)
        out[1 : 1 + size] = np.concatenate([x.T @ (w * score[i]) for i in range(3)])
        # observed information from central differences of the exact scores, per row and predictor
        info = np.zeros((size, size))
        for b in range(3):
            h = 1e-5 * np.maximum(np.abs(eta[b]), 1e-2)
            up = gradient(y, [e + h if i == b else e for i, e in enumerate(eta)], log_mu)[0]
            down = gradient(y, [e - h if i == b else e for i, e in enumerate(eta)], log_mu)[0]
            for a in range(3):
                curve = -(up[a] - down[a]) / (2 * h)
                info[a * terms : (a + 1) * terms, b * terms : (b + 1) * terms] = x.T @ (x * (w * curve)[:, None])
        info = (info + info.T) / 2
        out[1 + size :] = info.ravel()
        return out

    return kernel


def bccg_fit(
    df: DataFrame, y: str, xs: list[str], by: list[str], log_mu: bool = False, replicates: int = 0,
    key: str | None = None, seed: int = 1, iterations: int = 60,
) -> DataFrame:
    """Coefficients per group, replicate (0 = the data) and term: columns mu, sigma, nu; plus n and log-likelihood.

    Every group and bootstrap replicate is fitted in the same passes, replicates starting from the main fit.
    """
    rows = numeric_rows(df.filter(F.col(y) > 0), by, y, xs, key, None)
    terms = 1 + len(xs)
    stats = small_rows(rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("__y", 0.5, 1000).alias("mid"),
        (F.stddev_samp("__y") / F.avg("__y")).alias("cv"),
    ), "model groups")
    start, n = {}, {}
    for r in stats:
        group = tuple(r[b] for b in by)
        theta = np.zeros(3 * terms)
        theta[0] = math.log(r["mid"]) if log_mu else r["mid"]
        theta[terms] = math.log(max(r["cv"] or 0.1, 1e-3))
        theta[2 * terms] = 1.0
        start[(group, 0)], n[group] = theta, r["n"]
    columns = ["__key", "__w", "__y", "__one", *xs]
    kernel = bccg_kernel(terms, log_mu, seed)
    payload = lambda theta, k: (theta, k[1])
    fits = newton(rows, by, columns, kernel, start, payload, 3 * terms, iterations)
    if replicates:
        again = {(g, b): f["theta"] for (g, _), f in fits.items() for b in range(1, replicates + 1)}
        fits |= newton(rows, by, columns, kernel, again, payload, 3 * terms, iterations)
    out, names = [], ["(Intercept)", *xs]
    for (group, b), fit in fits.items():
        for i, name in enumerate(names):
            mu, sigma, nu = (float(fit["theta"][i + j * terms]) for j in range(3))
            out.append([*group, b, name, mu, sigma, nu, int(n[group]), float(fit["loglik"]), bool(fit.get("converged"))])
    frame = pd.DataFrame(out, columns=[*by, "replicate", "term", "mu", "sigma", "nu", "n", "loglik", "converged"])
    result = df.sparkSession.createDataFrame(frame)
    return result.withColumns({b: F.col(b).cast(df.schema[b].dataType) for b in by})
