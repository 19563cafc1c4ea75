"""Engine for iterative fits: one distributed pass sums a small vector for every model at once.

Rows stay partitioned in Spark; a task turns its Arrow batches into one vector per model with numpy, and Spark adds the
vectors. The driver only sees parameters, and loops over iterations, never over groups.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Key = tuple
Kernel = Callable[[np.ndarray, object], np.ndarray]


def plain_key(key: tuple) -> Key:
    """A pandas group key as Spark has it: missing values as None."""
    return tuple(None if v is None or v != v else v for v in key)


def grouped_sums(
    df: DataFrame, by: list[str], columns: list[str], kernel: Kernel, tasks: dict[tuple[Key, Hashable], object], prepare: Callable | None = None
) -> dict[tuple[Key, Hashable], np.ndarray]:
    """Sum of ``kernel(values, payload)`` over the rows of a group, for every (group key, model) in ``tasks``.

    ``prepare`` makes of a batch's values, once for all models, what the kernel takes in their place.
    """
    order = list(tasks)
    per_group: dict[Key, list[tuple[int, object]]] = {}
    for index, (key, model) in enumerate(order):
        per_group.setdefault(key, []).append((index, tasks[(key, model)]))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            groups = batch.groupby(by, sort=False, dropna=False) if by else [((), batch)]
            for key, part in groups:
                todo = per_group.get(plain_key(key))
                if not todo:
                    continue
                values = part[columns].to_numpy(dtype=float)
                values = prepare(values) if prepare else values
                for index, payload in todo:
                    value = kernel(values, payload)
                    totals[index] = value if index not in totals else totals[index] + value
        for index, value in totals.items():
            yield pd.DataFrame({"task": index, "pos": np.arange(len(value)), "value": value})

    sums = (
        df.select(*by, *columns)
        .mapInPandas(partial, "task int, pos int, value double")
        .groupBy("task", "pos")
        .agg(F.sum("value").alias("value"))
        .toPandas()
    )
    out = {}
    for index, part in sums.sort_values(["task", "pos"]).groupby("task"):
        out[order[index]] = part["value"].to_numpy()
    return out


def _inverse(info: np.ndarray) -> np.ndarray:
    """Inverse of an information matrix; directions of wrong curvature are turned, flat ones dropped."""
    scale = np.sqrt(np.maximum(np.abs(np.diag(info)), 1e-300))
    values, vectors = np.linalg.eigh(info / np.outer(scale, scale))
    size = np.abs(values)
    inverse = np.where(size > 1e-10 * size.max(), 1 / np.maximum(size, 1e-300), 0.0)
    return (vectors * inverse) @ vectors.T / np.outer(scale, scale)


def newton(
    df: DataFrame, by: list[str], columns: list[str], kernel: Kernel, start: dict, payload: Callable, size: int,
    iterations: int = 60, tolerance: float = 1e-9, ridge: float = 0.0, sums_of: Callable | None = None,
) -> dict:
    """Scoring steps with step halving, all groups and models in the same passes.

    The kernel returns [log-likelihood, score (size), information (size x size)] at ``payload(theta, id)``. Result per
    model: theta, loglik, covariance (inverse information), score, converged. ``sums_of`` replaces the pass over ``df``.
    """
    sums_of = sums_of or (lambda live: grouped_sums(df, by, columns, kernel, live))
    state = {
        k: dict(theta=None, loglik=-np.inf, base=np.asarray(t, float), step=np.zeros(size), scale=1.0, done=False)
        for k, t in start.items()
    }
    for _ in range(iterations):
        live = {k: payload(s["base"] + s["scale"] * s["step"], k) for k, s in state.items() if not s["done"]}
        if not live:
            break
        sums = sums_of(live)
        for k in live:
            s = state[k]
            if k not in sums:
                s["done"] = True
                continue
            value = sums[k]
            point = s["base"] + s["scale"] * s["step"]
            loglik, score, info = value[0], value[1 : 1 + size], value[1 + size :].reshape(size, size)
            if ridge:
                loglik, score, info = loglik - ridge * point @ point / 2, score - ridge * point, info + ridge * np.eye(size)
            if not np.all(np.isfinite(value)) or loglik < s["loglik"] - 1e-9 * (1 + abs(loglik)):
                s["scale"] /= 2
                if s["scale"] < 1e-8:
                    s["done"] = True
                continue
            s["theta"] = point
            s["base"], s["loglik"], s["score"] = s["theta"], loglik, score
            s["cov"] = _inverse(info)
            s["step"], s["scale"] = s["cov"] @ score, 1.0
            s["converged"] = bool(score @ s["step"] < tolerance * (1 + abs(loglik)))
            s["done"] = s["converged"]
            if s["done"]:
                # the last step is below the tolerance: taking it costs no further pass
                s["theta"] = s["base"] + s["step"]
    return {k: s for k, s in state.items() if s["theta"] is not None}


def squarem(
    evaluate: Callable[[dict], dict], start: dict, cycles: int | None = 60, tolerance: float = 1e-8
) -> dict:
    """EM with squared extrapolation for many models at once.

    ``evaluate`` maps {model: theta} to {model: (log-likelihood at theta, EM update of theta)} in one pass. The
    log-likelihood of kept points never falls: an extrapolation that lowers it is dropped. Without a limit of ``cycles`` every
    model goes on until its gain over a cycle is below the tolerance.
    """
    state = {k: dict(t0=np.asarray(t, float), done=False, path=[]) for k, t in start.items()}

    def run(name: str, source: str, models: list) -> None:
        result = evaluate({k: state[k][source] for k in models})
        for k in models:
            state[k][f"ll_{name}"], state[k][name] = result[k]

    for _ in itertools.count() if cycles is None else range(cycles):
        live = [k for k, s in state.items() if not s["done"]]
        if not live:
            break
        run("t1", "t0", live)
        run("t2", "t1", live)
        for k in live:
            s = state[k]
            r, v = s["t1"] - s["t0"], (s["t2"] - s["t1"]) - (s["t1"] - s["t0"])
            size = np.linalg.norm(v)
            alpha = -np.linalg.norm(r) / size if size > 0 else -1.0
            alpha = min(alpha, -1.0)
            s["te"] = s["t0"] - 2 * alpha * r + alpha * alpha * v
        run("t3", "te", live)
        for k in live:
            s = state[k]
            s["path"] += [s["ll_t1"], s["ll_t2"]]
            better = np.isfinite(s["ll_t3"]) and s["ll_t3"] >= s["ll_t2"] and np.all(np.isfinite(s["t3"]))
            s["t0"] = s["t3"] if better else s["t2"]
            gain = (s["ll_t3"] if better else s["ll_t2"]) - s["ll_t1"]
            s["loglik"] = s["ll_t3"] if better else s["ll_t2"]
            s["done"] = gain < tolerance * (1 + abs(s["loglik"]))
    final = evaluate({k: s["t0"] for k, s in state.items()})
    for k, s in state.items():
        s["loglik"], s["theta"], s["converged"] = final[k][0], s["t0"], s["done"]
        s["path"].append(s["loglik"])
    return state
