"""Linear mixed models for repeated measures from one small moment row per person.

With random effects on (1, spline columns) and covariates constant within a person, a person's design is Z A where Z
holds the spline columns and A the covariates. Everything the likelihood needs is then n, Z'Z, Z'y, y'y per person: waves
are aggregated once, and every later pass runs over persons.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.operators.clean_rows import complete_rows
from cohortframe.operators.iterate import grouped_sums, squarem
from cohortframe.session import small_rows, stage

Q = 3
MOMENTS = ["k", "s00", "s01", "s02", "s11", "s12", "s22", "t0", "t1", "t2", "u"]


def person_moments(df: DataFrame, ids: list[str], y: str, basis: list[str], covariates: list[str]) -> DataFrame:
    """One row per person (and whatever else is in ``ids``): moments of (1, basis) and y, plus the covariates.

    Covariates are constant within a person; the result is staged for repeated passes.
    """
    a, b = (F.col(c).cast("double") for c in basis)
    v = F.col(y).cast("double")
    rows = complete_rows(df, [y, *basis, *covariates])
    sums = rows.groupBy(*ids).agg(
        F.count(F.lit(1)).cast("double").alias("k"),
        F.count(F.lit(1)).cast("double").alias("s00"), F.sum(a).alias("s01"), F.sum(b).alias("s02"),
        F.sum(a * a).alias("s11"), F.sum(a * b).alias("s12"), F.sum(b * b).alias("s22"),
        F.sum(v).alias("t0"), F.sum(a * v).alias("t1"), F.sum(b * v).alias("t2"), F.sum(v * v).alias("u"),
        *[F.any_value(F.col(c).cast("double")).alias(c) for c in covariates],
    )
    return stage(sums)


def unpack(values: np.ndarray):
    """n, S (persons x 3 x 3), t (persons x 3), u from moment columns."""
    k, u = values[:, 0], values[:, 10]
    s = np.empty((len(values), Q, Q))
    for c, (i, j) in enumerate([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)], start=1):
        s[:, i, j] = s[:, j, i] = values[:, c]
    return k, s, values[:, 7:10], u


def pack_cov(d: np.ndarray) -> np.ndarray:
    """Covariance to free parameters: Cholesky factor with log diagonal."""
    factor = np.linalg.cholesky(d + 1e-10 * np.trace(d) * np.eye(len(d)))
    out = factor.copy()
    out[np.diag_indices(len(d))] = np.log(np.diag(factor))
    return out[np.tril_indices(len(d))]


def open_cov(free: np.ndarray) -> np.ndarray:
    factor = np.zeros((Q, Q))
    factor[np.tril_indices(Q)] = free
    factor[np.diag_indices(Q)] = np.exp(np.clip(np.diag(factor), -20, 20))
    return factor @ factor.T


def person_designs(slopes: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """A per person (3 x p): identity for the curve, covariate times identity for ``slopes``, first row ``shifts``."""
    n = len(slopes) if slopes.size else len(shifts)
    p = Q * (1 + slopes.shape[1]) + shifts.shape[1]
    a = np.zeros((n, Q, p))
    a[:, :, :Q] = np.eye(Q)
    for c in range(slopes.shape[1]):
        a[:, :, Q * (c + 1) : Q * (c + 2)] = slopes[:, c, None, None] * np.eye(Q)
    a[:, 0, Q * (1 + slopes.shape[1]) :] = shifts
    return a


def _posterior(s: np.ndarray, d: np.ndarray, sigma2: float):
    """Posterior covariance of a person's effects, and log det(I + D S / sigma2)."""
    inner = np.eye(Q) + d @ s / sigma2
    cov = np.linalg.solve(inner, np.broadcast_to(d, s.shape))
    return (cov + cov.transpose(0, 2, 1)) / 2, np.linalg.slogdet(inner)[1]


def lmm_kernel(n_slopes: int, n_shifts: int):
    """Sums for one REML EM step given (D, sigma2): generalised least squares parts and, given beta and its
    covariance, the expected squares. Payload holds ("gls", D, sigma2) or ("em", D, sigma2, beta, C)."""
    m = len(MOMENTS)

    def kernel(values: np.ndarray, payload) -> np.ndarray:
        stage_, d, sigma2, *rest = payload
        k, s, t, u = unpack(values[:, :m])
        a = person_designs(values[:, m : m + n_slopes], values[:, m + n_slopes : m + n_slopes + n_shifts])
        post, logdet = _posterior(s, d, sigma2)
        if stage_ == "gls":
            w = s / sigma2 - s @ post @ s / sigma2**2
            ty = t / sigma2 - np.einsum("nij,nj->ni", s @ post, t) / sigma2**2
            xx = np.einsum("nia,nij,njb->ab", a, w, a, optimize=True)
            xy = np.einsum("nia,ni->a", a, ty)
            yy = np.sum(u / sigma2 - np.einsum("ni,nij,nj->n", t, post, t) / sigma2**2)
            const = np.sum(k) * np.log(2 * np.pi * sigma2) + np.sum(logdet)
            return np.concatenate([[np.sum(k), len(k), yy, const], xy, xx.ravel()])
        beta, cov = rest
        gamma = a @ beta
        zr = t - np.einsum("nij,nj->ni", s, gamma)
        b = np.einsum("nij,nj->ni", post, zr) / sigma2
        pull = post @ s @ a / sigma2
        spread = post + pull @ cov @ pull.transpose(0, 2, 1)
        dd = np.einsum("ni,nj->ij", b, b) + spread.sum(axis=0)
        rss = u - 2 * np.einsum("ni,ni->n", t, gamma) + np.einsum("ni,nij,nj->n", gamma, s, gamma)
        rss = rss - 2 * np.einsum("ni,ni->n", b, zr) + np.einsum("ni,nij,nj->n", b, s, b)
        left = a - pull
        extra = np.einsum("nij,nji->n", s, post) + np.einsum("nij,nja,ab,nib->n", s, left, cov, left, optimize=True)
        return np.concatenate([dd.ravel(), [np.sum(rss + extra)]])

    return kernel


def growth_curve(
    moments: DataFrame, by: list[str], slopes: list[str], shifts: list[str], cycles: int | None = 60, tolerance: float = 1e-8
) -> dict:
    """REML fits per group: beta, cov, D, sigma2, loglik, names. ``slopes`` interact with the curve, ``shifts`` do not.

    All groups share every pass. Columns that do not vary are left out of a group by the pseudo-inverse.
    """
    columns = [*MOMENTS, *slopes, *shifts]
    kernel = lmm_kernel(len(slopes), len(shifts))
    p = Q * (1 + len(slopes)) + len(shifts)
    keys = small_rows(moments.groupBy(*by).agg(
        (F.sum("u") / F.sum("k") - F.pow(F.sum("t0") / F.sum("k"), 2)).alias("v")
    ), "model groups")
    variance = {tuple(r[b] for b in by): max(r["v"], 1e-6) for r in keys}
    start = {
        g: np.concatenate([pack_cov(np.diag([v / 2, v / 4, v / 4])), [np.log(v / 2)]]) for g, v in variance.items()
    }
    best: dict = {}

    def evaluate(thetas: dict) -> dict:
        parts = {g: (open_cov(t[:6]), float(np.exp(np.clip(t[6], -40, 40)))) for g, t in thetas.items()}
        sums = grouped_sums(moments, by, columns, kernel, {(g, 0): ("gls", *v) for g, v in parts.items()})
        solved, out = {}, {}
        for g, (d, sigma2) in parts.items():
            value = sums[(g, 0)]
            n, persons, yy, const = value[:4]
            xy, xx = value[4 : 4 + p], value[4 + p :].reshape(p, p)
            scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
            cov = np.linalg.pinv(xx / np.outer(scale, scale), rcond=1e-11, hermitian=True) / np.outer(scale, scale)
            beta = cov @ xy
            values = np.linalg.eigvalsh(xx / np.outer(scale, scale))
            values = values[values > 1e-11 * values.max()]
            logdet = np.sum(np.log(values)) + 2 * np.sum(np.log(scale[np.diag(xx) > 0]))
            loglik = -0.5 * (const + yy - xy @ beta + logdet - len(values) * np.log(2 * np.pi))
            solved[g] = (beta, cov, n, persons, loglik)
        em = grouped_sums(
            moments, by, columns, kernel, {(g, 0): ("em", *parts[g], solved[g][0], solved[g][1]) for g in parts}
        )
        for g in parts:
            beta, cov, n, persons, loglik = solved[g]
            value = em[(g, 0)]
            d, sigma2 = value[:9].reshape(Q, Q) / persons, value[9] / n
            out[g] = (loglik, np.concatenate([pack_cov((d + d.T) / 2), [np.log(max(sigma2, 1e-12))]]))
            best[g] = dict(beta=beta, cov=cov, D=parts[g][0], sigma2=parts[g][1], loglik=loglik, n=int(n), persons=int(persons))
        return out

    fits = squarem(evaluate, start, cycles, tolerance)
    for g, s in fits.items():
        best[g]["converged"], best[g]["path"] = s["converged"], s["path"]
    return best


def coefficient_names(basis: list[str], slopes: list[str], shifts: list[str]) -> list[str]:
    curve = ["age_ns0", *basis]
    return curve + [c if i == 0 else f"{c}:{basis[i - 1]}" for c in slopes for i in range(Q)] + list(shifts)


def growth_curve_table(df: DataFrame, fits: dict, by: list[str], names: list[str]) -> DataFrame:
    """Fits as result rows: one per group and term with beta and se, plus variance components."""
    out = []
    for g, fit in fits.items():
        se = np.sqrt(np.clip(np.diag(fit["cov"]), 0, None))
        rows = [(n, float(b), float(s)) for n, b, s in zip(names, fit["beta"], se)]
        rows += [(f"var_{i}{j}", float(fit["D"][i, j]), None) for i in range(Q) for j in range(i + 1)]
        rows.append(("sigma2", float(fit["sigma2"]), None))
        out += [[*g, *r, float(fit["loglik"]), fit["n"], fit["persons"], bool(fit["converged"])] for r in rows]
    frame = pd.DataFrame(out, columns=[*by, "term", "beta", "se", "loglik", "n", "persons", "converged"])
    schema = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)
    schema = (schema + ", " if schema else "") + "term string, beta double, se double, loglik double, n long, persons long, converged boolean"
    return df.sparkSession.createDataFrame([tuple(None if v != v else v for v in r) for r in frame.astype(object).to_numpy()], schema)
