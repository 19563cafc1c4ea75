"""Latent class models: fitting by EM over per-person moments, and their summaries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortframe.functions.draws import hash_uniform_np
from cohortframe.operators.iterate import grouped_sums, squarem
from cohortframe.operators.mixed import MOMENTS, Q, _posterior, open_cov, pack_cov, unpack
from cohortframe.operators.posteriors import entropy


def class_fit_stats(long: DataFrame, ident: str, classes: int, log_lik: float, parameters: int) -> DataFrame:
    """BIC, AIC, log-likelihood and relative entropy of one model; ``long`` has a row per id and class."""
    row = entropy(long, ident, classes).withColumn("groups", F.lit(classes))
    members = long.agg((F.count(F.lit(1)) / classes).alias("n"))
    n = members.first()[0]
    return row.select(
        "groups", F.lit(float(log_lik)).alias("log_lik"), F.lit(-2 * log_lik + 2 * parameters).cast("double").alias("aic"),
        F.lit(-2 * log_lik + parameters * math.log(n)).alias("bic"), "entropy",
    )


def class_trajectory(coefficients: DataFrame, basis: DataFrame, order: DataFrame, terms: list[str]) -> DataFrame:
    """Marginal predicted curve per class and age: sum of coefficient times basis value.

    ``coefficients`` has (class, term, beta) rows; the intercept's basis value is 1. All three tables are small.
    """
    long = basis.withColumn("(Intercept)", F.lit(1.0)).unpivot("age", ["(Intercept)", *terms], "term", "value")
    joined = coefficients.join(order.select("class", "class_long"), "class", "left").join(long, "term")
    return joined.groupBy("class_long", "age").agg(F.sum(F.col("beta") * F.col("value")).alias("pred"))


def conditional_trajectory(fixed: DataFrame, effects: DataFrame, basis: DataFrame, terms: list[str]) -> DataFrame:
    """Predicted curve per person: class coefficients plus the person's random effects.

    ``effects`` has one row per id with class and re_0, re_1, ...; ``fixed`` one row per class with fe_0, fe_1, ...
    """
    rows = effects.join(F.broadcast(fixed), "class").withColumn("__one", F.lit(1))
    points = F.broadcast(basis.select("age", F.lit(1.0).alias("v_0"), *[F.col(t).alias(f"v_{i}") for i, t in enumerate(terms, 1)]).withColumn("__one", F.lit(1)))
    value = F.lit(0.0)
    for i in range(len(terms) + 1):
        value = value + (F.col(f"fe_{i}") + F.col(f"re_{i}")) * F.col(f"v_{i}")
    return rows.join(points, "__one").select("id", "class", "age", value.alias("pred"))


# ---- fitting -----------------------------------------------------------------------------------------------------


class ClassModel:
    """Parameters of one mixture: class shares, a curve per class, residual variance and, for growth mixtures, a random
    effect covariance with an optional scale per class (the last class has scale 1)."""

    def __init__(self, classes: int, random: bool, scaled: bool = False):
        self.classes, self.random, self.scaled = classes, random, scaled and random and classes > 1

    @property
    def parameters(self) -> int:
        extra = (6 if self.random else 0) + (self.classes - 1 if self.scaled else 0)
        return self.classes - 1 + Q * self.classes + 1 + extra

    def pack(self, shares, curves, sigma2, d=None, scales=None) -> np.ndarray:
        log_shares = np.log(np.maximum(shares, 1e-12))
        parts = [log_shares[:-1] - log_shares[-1], np.ravel(curves), [math.log(max(sigma2, 1e-12))]]
        if self.random:
            parts.append(pack_cov(d))
        if self.scaled:
            parts.append(np.log(scales[:-1]))
        return np.concatenate(parts)

    def open(self, theta: np.ndarray):
        k = self.classes
        logits = np.concatenate([theta[: k - 1], [0.0]])
        logits = np.clip(logits - logits.max(), -50, 0)
        shares = np.exp(logits) / np.exp(logits).sum()
        curves = theta[k - 1 : k - 1 + Q * k].reshape(k, Q)
        place = k - 1 + Q * k
        sigma2 = float(np.exp(np.clip(theta[place], -40, 40)))
        d = open_cov(theta[place + 1 : place + 7]) if self.random else None
        scales = np.ones(k)
        if self.scaled:
            scales[:-1] = np.exp(np.clip(theta[place + 7 :], -10, 10))
        return shares, curves, sigma2, d, scales


def class_densities(values: np.ndarray, model: ClassModel, theta: np.ndarray):
    """Log of share times density per person and class, with the pieces the EM step needs."""
    k, s, t, u = unpack(values)
    shares, curves, sigma2, d, scales = model.open(theta)
    logs, parts = np.empty((len(values), model.classes)), []
    for c in range(model.classes):
        g = curves[c]
        zr = t - s @ g
        rr = u - 2 * t @ g + np.einsum("i,nij,j->n", g, s, g)
        value = k * np.log(2 * np.pi * sigma2) + rr / sigma2
        effect = post = None
        if model.random:
            post, logdet = _posterior(s, d * scales[c], sigma2)
            effect = np.einsum("nij,nj->ni", post, zr) / sigma2
            value = value + logdet - np.einsum("ni,ni->n", zr, effect) / sigma2
        logs[:, c] = np.log(shares[c]) - value / 2
        parts.append((zr, rr, effect, post))
    return logs, parts, (k, s, t, u), (shares, curves, sigma2, d, scales)


def mixture_kernel(values: np.ndarray, payload) -> np.ndarray:
    """Sums of one EM step. Payload: (ClassModel, theta)."""
    model, theta = payload
    logs, parts, (k, s, t, _), (_, _, _, d, scales) = class_densities(values, model, theta)
    top = logs.max(axis=1)
    weights = np.exp(logs - top[:, None])
    total = weights.sum(axis=1)
    p = weights / total[:, None]
    out = [np.array([np.sum(top + np.log(total)), np.sum(k), len(k)])]
    inverse = np.linalg.inv(d) if model.random else None
    for c, (zr, rr, effect, post) in enumerate(parts):
        w = p[:, c]
        target, resid = t, rr
        cov, size = np.zeros((Q, Q)), 0.0
        if model.random:
            target = t - np.einsum("nij,nj->ni", s, effect)
            resid = rr - 2 * np.einsum("ni,ni->n", effect, zr) + np.einsum("ni,nij,nj->n", effect, s, effect)
            resid = resid + np.einsum("nij,nji->n", s, post)
            square = np.einsum("ni,nj->nij", effect, effect) + post
            cov = np.einsum("n,nij->ij", w, square) / scales[c]
            size = np.sum(w * np.einsum("ij,nji->n", inverse, square))
        out.append(np.concatenate([
            [w.sum()], np.einsum("n,nij->ij", w, s).ravel(), w @ target, [w @ resid], cov.ravel(), [size]
        ]))
    return np.concatenate(out)


PAIRS = np.triu_indices(Q)
BLOCK = 2048  # persons whose class probabilities are made at once
PATTERN_PERSONS = 2_000


class Waves:
    """Persons by their moments of the waves (k, s00 .. s22): persons seen at the same ages share them. With those fixed, all that
    an EM step needs of a person is linear in 11 products of t and u, so a step is two matrix products a pattern. Fewer than
    ``least`` persons are summed one by one, as are persons whose ages are their own."""

    def __init__(self, values: np.ndarray, least: int = PATTERN_PERSONS):
        self.values, self.patterns, self.tables = values, None, None
        if len(values) < least:
            return
        place = pd.DataFrame(values[:, :7]).groupby(list(range(7)), sort=False).ngroup().to_numpy()
        found, first = np.unique(place, return_index=True)
        if len(found) * 16 <= len(values):
            order = np.argsort(place, kind="stable")
            ends = np.cumsum(np.bincount(place, minlength=len(found)))
            k, s, _, _ = unpack(values[first])
            self.patterns = [(k[g], s[g], values[order[end - size : end], 7:].T) for g, (end, size) in enumerate(zip(ends, np.diff(ends, prepend=0)))]
            self.values = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}

    def products(self) -> list[np.ndarray]:
        """Per pattern 1, t, the products of t, and u (11 x persons)."""
        if self.tables is None:
            self.tables = [np.vstack([np.ones(tu.shape[1]), tu[:Q], tu[:Q][PAIRS[0]] * tu[:Q][PAIRS[1]], tu[Q]]) for _, _, tu in self.patterns]
        return self.tables

    def sums(self, model: ClassModel, theta: np.ndarray) -> np.ndarray:
        """As ``mixture_kernel``."""
        if self.patterns is None:
            return mixture_kernel(self.values, (model, theta))
        shares, curves, sigma2, d, scales = model.open(theta)
        inverse = np.linalg.inv(d) if model.random else None
        out = np.zeros((model.classes, 24))
        loglik = persons = observations = 0.0
        for (k, s, _), table in zip(self.patterns, self.products()):
            weights, pulls = np.zeros((model.classes, len(table))), []
            for c, g in enumerate(curves):
                constant = k * np.log(2 * np.pi * sigma2) + g @ s @ g / sigma2
                linear, square = -2 * g / sigma2, np.zeros((Q, Q))
                post = pull = None
                if model.random:
                    post, logdet = (v[0] for v in _posterior(s[None], d * scales[c], sigma2))
                    pull = post / sigma2  # the expected effects are pull (t - s g)
                    square = -pull / sigma2
                    constant = constant + logdet + g @ s @ square @ s @ g
                    linear = linear - 2 * square @ s @ g
                pulls.append((post, pull))
                weights[c, 0], weights[c, 1:4], weights[c, 10] = np.log(shares[c]) - constant / 2, -linear / 2, -0.5 / sigma2
                weights[c, 4:10] = -(square[PAIRS] * np.where(PAIRS[0] == PAIRS[1], 1, 2)) / 2
            total = np.zeros((model.classes, len(table)))
            for start in range(0, table.shape[1], BLOCK):
                part = table[:, start : start + BLOCK]
                p = weights @ part
                top = p.max(axis=0)
                np.exp(p - top, out=p)
                size = p.sum(axis=0)
                loglik += np.sum(top) + np.sum(np.log(size))
                total += (p / size) @ part.T
            persons, observations = persons + table.shape[1], observations + k * table.shape[1]
            for c, (g, (post, pull)) in enumerate(zip(curves, pulls)):
                w, t, u = total[c, 0], total[c, 1:4], total[c, 10]
                tt = np.zeros((Q, Q))
                tt[PAIRS] = tt[PAIRS[::-1]] = total[c, 4:10]
                target, resid = t, u - 2 * g @ t + w * (g @ s @ g)
                cov, size = np.zeros((Q, Q)), 0.0
                if model.random:
                    sg = s @ g
                    zz = tt - np.outer(t, sg) - np.outer(sg, t) + w * np.outer(sg, sg)  # sums of (t - s g)(t - s g)'
                    effect = pull @ (t - w * sg)
                    both = pull @ zz @ pull.T
                    target = t - s @ effect
                    resid = resid - 2 * np.sum(pull * zz) + np.sum(both * s) + w * np.sum(s * post)
                    cov, size = (both + w * post) / scales[c], np.sum(inverse * (both + w * post))
                out[c] += np.concatenate([[w], w * s.ravel(), target, [resid], cov.ravel(), [size]])
        return np.concatenate([[loglik, observations, persons], out.ravel()])


def em_update(model: ClassModel, theta: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray]:
    loglik, observations, persons = sums[:3]
    _, old, _, d, scales = model.open(theta)
    blocks = sums[3:].reshape(model.classes, -1)
    shares, curves = blocks[:, 0] / persons, np.array(old)
    rss, cov, sizes = 0.0, np.zeros((Q, Q)), np.ones(model.classes)
    for c, block in enumerate(blocks):
        matrix, target = block[1:10].reshape(Q, Q), block[10:13]
        # class-weighted normal equations; the residual sum follows the moved curve
        curves[c] = np.linalg.lstsq(matrix, target, rcond=None)[0]
        shift = curves[c] - old[c]
        rss += block[13] - 2 * shift @ (target - matrix @ old[c]) + shift @ matrix @ shift
        cov += block[14:23].reshape(Q, Q)
        if model.scaled:
            sizes[c] = max(block[23] / (Q * max(block[0], 1e-9)), 1e-4)
    if model.random:
        d = (cov + cov.T) / (2 * persons)
    if model.scaled:
        d, sizes = d * sizes[-1], sizes / sizes[-1]
    return loglik, model.pack(shares, curves, rss / observations, d, sizes)


UNIT_PERSONS = 600_000  # so many persons' moments go to every task, which then fits whole models; more are summed by passes


def fit_classes(
    moments: DataFrame, models: dict, start: dict, cycles: int | None = 60, tolerance: float = 1e-8, unit_persons: int = UNIT_PERSONS
) -> dict:
    """EM fits of many mixtures (numbers of classes, restarts) over the same persons.

    Few persons are sent to the tasks, a task for each model; otherwise all models share each pass over the persons.
    """
    few = moments.select(*MOMENTS).limit(unit_persons + 1).toArrow()
    if few.num_rows > unit_persons:

        def evaluate(thetas: dict) -> dict:
            tasks = {((), k): (models[k], t) for k, t in thetas.items()}
            sums = grouped_sums(moments, [], MOMENTS, lambda waves, task: waves.sums(*task), tasks, Waves)
            return {k: em_update(models[k], t, sums[((), k)]) for k, t in thetas.items()}

        return squarem(evaluate, start, cycles, tolerance)
    waves = Waves(np.column_stack([few[c].to_numpy().astype(float) for c in MOMENTS]))
    order = list(models)

    def fit(batches):
        for batch in batches:
            for place in batch["place"]:
                k = order[place]
                steps = lambda thetas, m=models[k]: {0: em_update(m, thetas[0], waves.sums(m, thetas[0]))}
                state = squarem(steps, {0: start[k]}, cycles, tolerance)[0]
                yield pd.DataFrame({
                    "place": [place], "theta": [state["theta"].tolist()], "loglik": [float(state["loglik"])],
                    "converged": [bool(state["converged"])], "path": [[float(v) for v in state["path"]]],
                })

    spark = moments.sparkSession
    places = spark.createDataFrame([(k,) for k in range(len(order))], "place int").repartition(len(order), "place")
    found = places.mapInPandas(fit, "place int, theta array<double>, loglik double, converged boolean, path array<double>").collect()
    return {order[r.place]: dict(theta=np.array(r.theta), loglik=r.loglik, converged=r.converged, path=list(r.path)) for r in found}


def one_class_start(moments: DataFrame, random: bool) -> tuple[ClassModel, np.ndarray]:
    """Pooled least squares as the start of the one-class model."""
    row = moments.agg(*[F.sum(c).alias(c) for c in MOMENTS]).first()
    k, s, t, u = unpack(np.array([[row[c] for c in MOMENTS]], dtype=float))
    curve = np.linalg.lstsq(s[0], t[0], rcond=None)[0]
    sigma2 = max((u[0] - curve @ t[0]) / k[0], 1e-9)
    model = ClassModel(1, random)
    return model, model.pack([1.0], curve, sigma2 / (2 if random else 1), np.eye(Q) * sigma2 / 2)


def spread_start(base: ClassModel, theta: np.ndarray, classes: int, scaled: bool = False, draw: np.ndarray | None = None) -> tuple[ClassModel, np.ndarray]:
    """Start of a K-class model around the one-class fit: intercepts spread evenly, or curves moved by ``draw``."""
    shares, curves, sigma2, d, _ = base.open(theta)
    spread = math.sqrt(d[0, 0] if base.random else sigma2)
    curve = np.repeat(curves, classes, axis=0)
    if draw is None:
        curve[:, 0] += spread * np.linspace(-1, 1, classes)
    else:
        curve += spread * draw
    model = ClassModel(classes, base.random, scaled)
    return model, model.pack(np.full(classes, 1 / classes), curve, sigma2, d, np.ones(classes))


def class_models(
    moments: DataFrame, most: int = 5, random: bool = False, cycles: int | None = 60, tolerance: float = 1e-8
) -> dict[int, dict]:
    """Mixtures with 1 .. ``most`` classes; the larger ones start from the one-class fit."""
    base, theta = one_class_start(moments, random)
    one = fit_classes(moments, {1: base}, {1: theta}, cycles, tolerance)
    models, start = {}, {}
    for k in range(2, most + 1):
        models[k], start[k] = spread_start(base, one[1]["theta"], k)
    fits = one | (fit_classes(moments, models, start, cycles, tolerance) if models else {})
    for k, fit in fits.items():
        fit["model"] = base if k == 1 else models[k]
    return fits


def random_restarts(
    moments: DataFrame, classes: list[int], restarts: int = 100, short_cycles: int = 10, cycles: int | None = 60,
    scaled: bool = True, random: bool = True, seed: int = 1, tolerance: float = 1e-8,
) -> tuple[dict[int, dict], list[tuple[int, int, float]]]:
    """Short runs from many random starts, then the best start of each class count is run to convergence.

    All starts of all class counts share the passes of the short runs (three passes per cycle).
    """
    base, theta = one_class_start(moments, random)
    one = fit_classes(moments, {1: base}, {1: theta}, cycles, tolerance)[1]["theta"]
    models, start = {}, {}
    for k in classes:
        for r in range(1, restarts + 1):
            u = hash_uniform_np(np.arange(k * Q) + 1000 * k, np.full(k * Q, r), seed).reshape(k, Q)
            models[(k, r)], start[(k, r)] = spread_start(base, one, k, scaled, 3 * (u - 0.5))
    short = fit_classes(moments, models, start, short_cycles, 0.0)
    tried = [(k, r, float(f["loglik"])) for (k, r), f in short.items()]
    best = {k: max((r for c, r in short if c == k), key=lambda r: short[(k, r)]["loglik"]) for k in classes}
    fits = fit_classes(
        moments, {k: models[(k, r)] for k, r in best.items()}, {k: short[(k, r)]["theta"] for k, r in best.items()},
        cycles, tolerance,
    )
    for k, r in best.items():
        fits[k]["model"], fits[k]["restart"] = models[(k, r)], r
    return fits, tried


def posterior_table(moments: DataFrame, ident: list[str], fits: dict[int, dict]) -> DataFrame:
    """Class probabilities per person and model: (id, groups, class, prob1 ... probK with K the largest model)."""
    most = max(fits)
    names = [f"prob{k}" for k in range(1, most + 1)]
    payload = {k: (f["model"], f["theta"]) for k, f in fits.items()}
    schema = T.StructType([
        *[moments.schema[c] for c in ident], T.StructField("groups", T.IntegerType()), T.StructField("class", T.IntegerType()),
        *[T.StructField(n, T.DoubleType()) for n in names],
    ])

    def score(batches):
        for batch in batches:
            values = batch[MOMENTS].to_numpy(dtype=float)
            for k, (model, theta) in payload.items():
                logs = class_densities(values, model, theta)[0]
                p = np.exp(logs - logs.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                out = batch[ident].copy()
                out["groups"] = k
                out["class"] = p.argmax(axis=1) + 1
                for i, n in enumerate(names):
                    out[n] = p[:, i] if i < k else None
                yield out[schema.names]

    return moments.select(*ident, *MOMENTS).mapInPandas(score, schema)


def person_effects(moments: DataFrame, ident: list[str], fit: dict) -> DataFrame:
    """Most likely class and expected random effects per person of one growth mixture."""
    model, theta = fit["model"], fit["theta"]
    schema = T.StructType([
        *[moments.schema[c] for c in ident], T.StructField("class", T.IntegerType()),
        *[T.StructField(f"re_{i}", T.DoubleType()) for i in range(Q)],
    ])

    def score(batches):
        for batch in batches:
            logs, parts, *_ = class_densities(batch[MOMENTS].to_numpy(dtype=float), model, theta)
            best = logs.argmax(axis=1)
            effects = np.stack([part[2] for part in parts], axis=1)[np.arange(len(best)), best]
            out = batch[ident].copy()
            out["class"] = best + 1
            for i in range(Q):
                out[f"re_{i}"] = effects[:, i]
            yield out[schema.names]

    return moments.select(*ident, *MOMENTS).mapInPandas(score, schema)


def fit_table(df: DataFrame, fits: dict[int, dict], persons: int) -> DataFrame:
    """One row per class count: log-likelihood, parameters, AIC, BIC, shares and curves as rows per class."""
    out = []
    for k, fit in fits.items():
        shares, curves, sigma2, _, _ = fit["model"].open(fit["theta"])
        free, ll = fit["model"].parameters, float(fit["loglik"])
        for c in range(k):
            out.append((k, c + 1, float(shares[c]), *map(float, curves[c]), sigma2, ll, -2 * ll + 2 * free, -2 * ll + free * math.log(persons), bool(fit["converged"])))
    schema = "groups int, class int, share double, intercept double, age_ns1 double, age_ns2 double, sigma2 double, log_lik double, aic double, bic double, converged boolean"
    return df.sparkSession.createDataFrame(out, schema)
