"""Weighted quantile regression by an interior-point method: every quantile, group and replicate in the same passes.

The dual problem keeps each row's multiplier between two bounds. With a logarithmic barrier of weight mu on the bounds, the
multiplier has a closed form in the row's residual, so no state is kept per row: what a pass sums up are, per model, the
gradient and the matrix of the barrier's normal equations at the present coefficients. Newton steps follow the path of
centres while mu falls; the gap between the check loss and the dual value bounds the distance from the optimum.

In a group of many rows nearly all are far from a model's plane, and where one is above it, its loss is a line. A model is
solved on the rows nearest to the plane of a fit close by, with the others as a sum of lines; that is never above the whole
loss, and equals it where no line was taken on the wrong side. What wrong sides add counts as gap, and a model whose gap is
then too wide is solved with more rows, in the end with all.
"""

from __future__ import annotations

import copy

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.functions.draws import hash_uniform_np, poisson_weight_np
from cohortframe.operators.clean_rows import numeric_rows
from cohortframe.operators.iterate import plain_key
from cohortframe.session import small_rows, stage

CELLS = 400_000  # rows x models that a task holds at once
BLOCK = 16_000  # of which it works on so many, to stay in the processor's cache
UNIT_ROWS = 1_000_000
SCREEN_ROWS = 500  # groups above are solved on the rows near the plane
ROUGH = 3e-3  # share of the start down to which mu falls before the first plane
FALL, CENTRAL = 0.3, 2.0  # what mu falls by, and the Newton decrement below which it does
FAR = 1e-14  # share of the start at which mu no longer falls


def barrier_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray, tau: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Per model (columns of ``w``): gradient, upper triangle of the matrix, check loss, gap, sum of weights.

    A row's multiplier is w tau - s = t - w (1 - tau), with s and t the distances from its bounds.
    """
    p = x.shape[1]
    r = y[:, None] - x @ theta.T
    some = w > 0
    rw = r * w
    d = np.sqrt(rw * rw + 4 * mu * mu)
    plus = np.where(rw >= 0, rw + d, 4 * mu * mu / np.maximum(d - rw, 1e-300))
    minus = np.where(rw <= 0, d - rw, 4 * mu * mu / np.maximum(d + rw, 1e-300))
    s = 2 * mu * w / (2 * mu + plus)
    t = 2 * mu * w / (2 * mu + minus)
    curve = np.where(some, (s * t) ** 2 / np.maximum(mu * (s * s + t * t), 1e-300), 0.0)
    pull = w * tau - s
    loss = np.where(r >= 0, tau, tau - 1) * rw
    gap = np.where(r >= 0, s * r, -t * r)
    out = [x.T @ pull]
    for i in range(p):
        for j in range(i, p):
            out.append(((x[:, i] * x[:, j]) @ curve)[None])
    out += [loss.sum(0)[None], gap.sum(0)[None], w.sum(0)[None]]
    return np.vstack(out).T


def near_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray, tau: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """``barrier_sums`` from the smaller of s and t alone, in fewer steps."""
    upper = np.triu_indices(x.shape[1])
    r = y[:, None] - x @ theta.T
    size = np.abs(r)
    z = size * w
    loss = np.einsum("rm,rm->m", z, np.where(r >= 0, tau, 1 - tau))
    z /= 2 * mu
    grown = z + np.sqrt(z * z + 1)
    small = w / (1 + grown)
    grown *= grown
    curve = small * small
    curve *= grown / (1 + grown)
    pull = np.where(r >= 0, w * tau - small, small - w * (1 - tau))
    matrix = (x[:, upper[0]] * x[:, upper[1]]).T @ curve / mu
    return np.vstack([x.T @ pull, matrix, loss, np.einsum("rm,rm->m", small, size), w.sum(0)]).T


def replicate_weights(keys: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Poisson weights of rows (by key) in replicates (columns); 1 in replicate 0."""
    u = hash_uniform_np(keys.astype(np.int64)[:, None], replicates[None, :].astype(np.int64), seed)
    return np.where(replicates[None, :] == 0, 1.0, poisson_weight_np(u))


class _Path:
    """The models of one group on their way along the path: coefficients (of the raw columns), mu, loss and gap."""

    def __init__(self, models: np.ndarray, starts: np.ndarray, means: np.ndarray, spreads: np.ndarray, spread: float, weight: float, tolerance: float):
        p = 1 + len(means)
        self.models, self.tolerance, self.floor = models, tolerance, 1e-3 * spread
        self.theta = np.zeros((len(models), p))
        self.theta[:, 0] = starts
        self.first = 0.5 * spread * weight
        self.mu = np.full(len(models), self.first)
        self.best, self.loss = self.theta.copy(), np.full(len(models), np.nan)
        self.gap, self.done, self.live = np.full(len(models), np.inf), np.zeros(len(models), bool), np.ones(len(models), bool)
        self.turn = np.eye(p)  # standardised columns are turn x
        self.turn[1:, 0] = -means / spreads
        self.turn[np.arange(1, p), np.arange(1, p)] = 1 / spreads

    def some(self, which: np.ndarray) -> _Path:
        """Some of the models, from where they are."""
        part = copy.copy(self)
        for name in ("models", "theta", "mu", "best", "loss", "gap", "done", "live"):
            setattr(part, name, getattr(self, name)[which].copy())
        return part

    def keep(self, which: np.ndarray, part: _Path) -> None:
        for name in ("theta", "mu", "best", "loss", "gap", "done", "live"):
            getattr(self, name)[which] = getattr(part, name)

    def asked(self) -> np.ndarray:
        return np.flatnonzero(self.live)

    def sums(self, x: np.ndarray, y: np.ndarray, keys: np.ndarray, weight: np.ndarray, seed: int) -> np.ndarray:
        """``barrier_sums`` of the live models over some rows of the group."""
        todo = self.asked()
        replicates, column = np.unique(self.models[todo, 1], return_inverse=True)
        step, total = max(1, CELLS // len(todo)), 0.0
        for start in range(0, len(y), step):
            part = slice(start, start + step)
            w = (replicate_weights(keys[part], replicates, seed) * weight[part, None])[:, column]
            total = total + barrier_sums(x[part], y[part], w, self.theta[todo], self.models[todo, 0], self.mu[todo])
        return total

    def move(self, value: np.ndarray) -> None:
        """One Newton step of the live models; mu falls where the step was short."""
        todo = self.asked()
        p = self.theta.shape[1]
        upper = np.triu_indices(p)
        matrix = np.zeros((len(todo), p, p))
        matrix[:, upper[0], upper[1]] = matrix[:, upper[1], upper[0]] = value[:, p : p + len(upper[0])]
        gradient = value[:, :p] @ self.turn.T
        now, apart, weights = value[:, -3], value[:, -2], value[:, -1]
        inverse = np.linalg.pinv(self.turn @ matrix @ self.turn.T, rcond=1e-13, hermitian=True)
        step = np.einsum("mij,mj->mi", inverse, gradient)
        short = np.sqrt(np.maximum((step * gradient).sum(1) / self.mu[todo], 0.0))
        step *= np.minimum(1.0, 2 / (1 + short))[:, None]
        better = now < np.nan_to_num(self.loss[todo], nan=np.inf)
        self.best[todo[better]], self.loss[todo[better]] = self.theta[todo[better]], now[better]
        self.theta[todo] += step @ self.turn
        central = short < CENTRAL
        self.gap[todo] = np.where(central, np.minimum(self.gap[todo], apart), self.gap[todo])
        close = central & (apart <= self.tolerance * (now + self.floor * weights)) & (weights > 0)
        lost = (weights <= 0) | ~np.isfinite(now) | (self.mu[todo] < FAR * self.first)
        self.loss[todo[weights <= 0]] = np.nan
        self.done[todo[close]] = True
        self.live[todo[close | lost]] = False
        self.mu[todo[central & ~close]] *= FALL

    def table(self, names: list[str]) -> dict:
        p, none = len(names), np.isnan(self.loss)
        return {
            "tau": np.repeat(self.models[:, 0], p), "replicate": np.repeat(self.models[:, 1].astype(np.int32), p), "term": names * len(self.models),
            "beta": np.where(none[:, None], np.nan, self.best).ravel(), "loss": np.repeat(self.loss, p),
            "gap": np.repeat(np.where(none, np.nan, self.gap), p), "converged": np.repeat(self.done, p),
        }


class _Screen:
    """The rows of one group with the weights of all replicates."""

    def __init__(self, path: _Path, x: np.ndarray, y: np.ndarray, keys: np.ndarray, weight: np.ndarray, seed: int):
        self.path, self.x, self.y, self.weight = path, x, y, weight
        self.replicates = np.unique(path.models[:, 1])
        self.drawn = np.empty((len(y), len(self.replicates)), np.int8)
        for part in self.parts(np.arange(len(y)), len(self.replicates)):
            self.drawn[part] = replicate_weights(keys[part], self.replicates, seed)
        self.size = np.sqrt(((x @ path.turn.T) ** 2).sum(1))

    def parts(self, rows: np.ndarray, models: int):
        step = max(1, BLOCK // max(1, models))
        return (rows[start : start + step] for start in range(0, len(rows), step))

    def weights(self, rows: np.ndarray, column: np.ndarray) -> np.ndarray:
        return self.drawn[rows][:, column] * self.weight[rows, None]

    def rough(self, which: np.ndarray) -> np.ndarray:
        """Planes of all rows from the first part of the models' paths."""
        part, column = self.path.some(which), np.searchsorted(self.replicates, self.path.models[which, 1])
        while part.live.any() and part.mu.max() > ROUGH * part.first:
            todo = part.asked()
            rows = self.parts(np.arange(len(self.y)), len(todo))
            part.move(sum(near_sums(self.x[at], self.y[at], self.weights(at, column[todo]), part.theta[todo], part.models[todo, 0], part.mu[todo]) for at in rows))
        return part.theta

    def solve(self, which: np.ndarray, centre: np.ndarray) -> None:
        """Models of one quantile, near a plane."""
        path, tau = self.path, self.path.models[which[0], 0]
        away = self.y - self.x @ centre
        rank = np.abs(away) / self.size
        take = int(7 * np.sqrt(len(rank))) + 50
        while len(which):
            near = np.argpartition(rank, take)[:take] if 2 * take < len(rank) else np.arange(len(rank))
            far = np.setdiff1d(np.arange(len(rank)), near, assume_unique=True)
            part, column = path.some(which), np.searchsorted(self.replicates, path.models[which, 1])
            wide = 0.5 * np.abs(away[near]).max() * (self.weight.mean() or 1.0)
            part.theta[:], part.mu[:] = centre, min(part.first, max(wide, 1e-9 * part.first))
            above = away[far] >= 0
            slope = np.where(above, tau, tau - 1)
            lines, apart, weights = np.zeros((len(which), self.x.shape[1])), np.zeros(len(which)), np.zeros(len(which))
            for at in self.parts(np.arange(len(far)), len(which)):
                w = self.weights(far[at], column)
                lines += (w * slope[at, None]).T @ self.x[far[at]]
                apart += (slope[at] * self.y[far[at]]) @ w
                weights += w.sum(0)
            while part.live.any():
                todo = part.asked()
                total = 0.0
                for at in self.parts(near, len(todo)):
                    total = total + near_sums(self.x[at], self.y[at], self.weights(at, column[todo]), part.theta[todo], part.models[todo, 0], part.mu[todo])
                total[:, : self.x.shape[1]] += lines[todo]
                total[:, -3] += apart[todo] - (part.theta[todo] * lines[todo]).sum(1)
                total[:, -1] += weights[todo]
                part.move(total)
            wrong, whole = np.zeros(len(which)), weights.copy()
            for at in self.parts(np.arange(len(far)), len(which)):
                r = self.y[far[at], None] - self.x[far[at]] @ part.best.T
                row, model = np.nonzero(np.where(above[at, None], r < 0, r > 0))
                np.add.at(wrong, model, np.abs(r[row, model]) * self.drawn[far[at[row]], column[model]] * self.weight[far[at[row]]])
            for at in self.parts(near, len(which)):
                whole += self.weights(at, column).sum(0)
            part.loss, part.gap = part.loss + wrong, part.gap + wrong
            fine = (wrong == 0) | (part.gap <= part.tolerance * (part.loss + part.floor * whole)) | ~np.isfinite(part.loss)
            path.keep(which[fine], part.some(fine))
            which, take = which[~fine], 2 * take


def _by_screens(path: _Path, x: np.ndarray, y: np.ndarray, keys: np.ndarray, weight: np.ndarray, seed: int) -> None:
    """All models of a group of many rows: rough fits of all rows, the rows' own fits near those, the replicates near these."""
    own = np.flatnonzero(path.models[:, 1] == 0)
    screen = _Screen(path, x, y, keys, weight, seed)
    for first, plane in zip(own, screen.rough(own)):
        screen.solve(np.array([first]), plane)
        others = np.flatnonzero((path.models[:, 0] == path.models[first, 0]) & (path.models[:, 1] != 0))
        screen.solve(others, path.best[first])


def _by_passes(rows: DataFrame, by: list[str], xs: list[str], paths: dict, seed: int) -> None:
    """All groups step together, a pass over the rows a step."""
    order = {key: g for g, key in enumerate(paths)}
    keys = list(paths)
    while any(path.live.any() for path in paths.values()):

        def partial(batches):
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for key, part in batch.groupby(by, sort=False, dropna=False) if by else [((), batch)]:
                    g = plain_key(key)
                    if paths[g].live.any():
                        sums = paths[g].sums(
                            part[["__one", *xs]].to_numpy(float), part["__y"].to_numpy(float), part["__key"].to_numpy(), part["__w"].to_numpy(float), seed
                        )
                        totals[order[g]] = totals[order[g]] + sums if order[g] in totals else sums
            yield pd.DataFrame({"g": list(totals), "sums": [v.tobytes() for v in totals.values()]})

        def add(parts: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"g": parts["g"][:1], "sums": [sum(np.frombuffer(v) for v in parts["sums"]).tobytes()]})

        summed = rows.mapInPandas(partial, "g int, sums binary").groupBy("g").applyInPandas(add, "g int, sums binary")
        for r in summed.toLocalIterator():  # a row a group
            path = paths[keys[r.g]]
            path.move(np.frombuffer(r.sums).reshape(len(path.asked()), -1))


def quantile_regression(
    df: DataFrame, y: str, xs: list[str], by: list[str], taus: list[float], weight: str | None = None,
    replicates: int = 0, key: str | None = None, seed: int = 1, tolerance: float = 1e-9, unit_rows: int = UNIT_ROWS,
    screen_rows: int = SCREEN_ROWS,
) -> DataFrame:
    """Coefficients per group, tau, replicate (0 = the data) and term, with the check loss and how far it may be from the least.

    A model is done when that gap is below ``tolerance`` of its loss (and of the spread of y). ``converged`` is false only for
    models without any weight, or where rounding keeps the gap from closing. Groups up to ``unit_rows`` rows are solved by one
    task each, above ``screen_rows`` on the rows near each model's plane; otherwise every step is a pass over all rows.
    """
    rows = numeric_rows(df, by, y, xs, key, weight)
    names = ["(Intercept)", *xs]
    levels = F.percentile_approx("__y", [float(t) for t in taus], 1000)
    scale = [F.stddev_pop("__y").alias("sd"), levels.alias("q"), F.avg("__w").alias("w"), F.count(F.lit(1)).alias("n")]
    shape = [f(x).alias(f"{n}_{k}") for k, x in enumerate(xs) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    models = np.array([(t, b) for t in taus for b in range(replicates + 1)], float)
    paths, largest = {}, 0
    for r in small_rows(rows.groupBy(*by).agg(*scale, *shape), "model groups"):
        means, spreads = np.array([[r[f"m_{k}"], r[f"s_{k}"] or 1.0] for k in range(len(xs))]).reshape(-1, 2).T
        paths[tuple(r[b] for b in by)] = _Path(models, np.repeat(r["q"], replicates + 1), means, spreads, r["sd"] or 1.0, r["w"] or 1.0, tolerance)
        largest = max(largest, r["n"])
    fields = [f"{b} {df.schema[b].dataType.simpleString()}" for b in by]
    schema = ", ".join([*fields, "tau double, replicate int, term string, beta double, loss double, gap double, converged boolean"])
    if largest <= unit_rows:

        def solve(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
            path = paths[plain_key(group)]
            x, target, keys, weights = part[["__one", *xs]].to_numpy(float), part["__y"].to_numpy(float), part["__key"].to_numpy(), part["__w"].to_numpy(float)
            if len(target) > screen_rows and np.isfinite(target).all() and np.isfinite(x).all() and weights.min() >= 0 and weights.max() > 0:
                _by_screens(path, x, target, keys, weights, seed)
            while path.live.any():
                path.move(path.sums(x, target, keys, weights, seed))
            out = pd.DataFrame(path.table(names))
            for b, value in zip(by, group):
                out[b] = value
            return out[[*by, *list(out.columns[: -len(by)] if by else out.columns)]]

        # a group is a long computation on few rows: spread by groups, not by bytes
        spread = rows.repartition(2 * len(paths), *by) if by else rows
        out = stage(spread.groupBy(*by).applyInPandas(solve, schema))
    else:
        _by_passes(rows, by, xs, paths, seed)
        tables = [pd.DataFrame({**{b: [v] * (len(models) * len(names)) for b, v in zip(by, g)}, **path.table(names)}) for g, path in paths.items()]
        out = df.sparkSession.createDataFrame(pd.concat(tables).astype({b: object for b in by}), schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("beta", "loss", "gap")})


def bootstrap_summary(fits: DataFrame, by: list[str]) -> DataFrame:
    """Median and 95% limits of the replicates per tau and term."""
    boots = fits.filter("replicate > 0").groupBy(*by, "tau", "term").agg(
        F.percentile("beta", F.lit([0.5, 0.025, 0.975])).alias("q")
    )
    return boots.select(*by, "tau", "term", *[F.col("q")[i].alias(n) for i, n in enumerate(("beta", "lci", "uci"))])


def summary_by_source(fits: DataFrame, by: list[str], imp: str = "imp") -> DataFrame:
    """``bootstrap_summary`` of the observed rows (imputation 0: cc) and of all imputed copies together (mi)."""
    source = F.when(F.col(imp) == 0, "cc").otherwise("mi").alias("type")
    return bootstrap_summary(fits.select("*", source), [*by, "type"])
