"""Weighted multinomial logit, every group (imputation) in the same passes; baseline is the first level."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.operators.clean_rows import model_rows
from cohortframe.operators.iterate import newton
from cohortframe.session import small_rows

BLOCK = 4096


def softmax_sums(levels: int, terms: int):
    """Kernel: columns are weight, level code (0-based), design. Blocks of rows keep what it makes in the processor's cache."""
    free = (levels - 1) * terms
    first, second = np.triu_indices(levels - 1)
    left, right = np.triu_indices(terms)

    def part(values: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        columns = np.ascontiguousarray(values.T)
        w, code, x = columns[0], columns[1].astype(int), columns[2:]
        eta = np.zeros((levels, len(w)))
        eta[1:] = beta @ x
        eta -= eta.max(axis=0)
        p = np.exp(eta)
        p /= p.sum(axis=0)
        loglik = w @ np.log(p[code, np.arange(len(w))])
        hit = (code == np.arange(1, levels)[:, None]).astype(float)
        score = ((hit - p[1:]) * w) @ x.T
        both = p[1:][first] * -p[1:][second]
        both[first == second] += p[1:]
        return loglik, score, both @ (x[left] * x[right] * w).T

    def kernel(values: np.ndarray, theta: np.ndarray) -> np.ndarray:
        beta = theta.reshape(levels - 1, terms)
        loglik, score, sums = 0.0, np.zeros((levels - 1, terms)), np.zeros((len(first), len(left)))
        for start in range(0, len(values), BLOCK):
            found = part(values[start : start + BLOCK], beta)
            loglik, score, sums = loglik + found[0], score + found[1], sums + found[2]
        square = np.zeros((len(first), terms, terms))
        square[:, left, right] = square[:, right, left] = sums
        info = np.zeros((levels - 1, terms, levels - 1, terms))
        for k, (a, b) in enumerate(zip(first, second)):
            info[a, :, b] = info[b, :, a] = square[k]
        return np.concatenate([[loglik], score.ravel(), info.reshape(free, free).ravel()])

    return kernel


def fit_groups(
    rows: DataFrame, by: list[str], design: list[str], levels: int, iterations: int = 40, ridge: float = 0.0
) -> dict:
    """Newton fits per group on prepared rows (by, __w, __y code, design columns).

    ``ridge`` is a prior precision on every coefficient, which keeps separated groups finite.
    """
    size = (levels - 1) * len(design)
    keys = [tuple(r) for r in small_rows(rows.select(*by).distinct(), "model groups")] if by else [()]
    start = {(k, 0): np.zeros(size) for k in keys}
    kernel = softmax_sums(levels, len(design))
    return newton(rows, by, ["__w", "__y", *design], kernel, start, lambda theta, _: theta, size, iterations, ridge=ridge)


def multinomial_logit(
    df: DataFrame, level: str, levels: list[str], xs: list[str], by: list[str], weight: str | None = None
) -> DataFrame:
    """One row per group, level and term: beta and se from the inverse information."""
    rows = model_rows(df, by, level, levels, xs, weight)
    design = ["__one", *xs]
    fits = fit_groups(rows, by, design, len(levels))
    names, out = ["(Intercept)", *xs], []
    for (key, _), fit in fits.items():
        se = np.sqrt(np.clip(np.diag(fit["cov"]), 0, None))
        for a, name in enumerate(levels[1:]):
            for t, term in enumerate(names):
                i = a * len(names) + t
                out.append([*key, name, term, float(fit["theta"][i]), float(se[i]), float(fit["loglik"])])
    frame = pd.DataFrame(out, columns=[*by, "y_level", "term", "beta", "se", "loglik"])
    result = df.sparkSession.createDataFrame(frame)
    return result.withColumns({b: F.col(b).cast(df.schema[b].dataType) for b in by})
