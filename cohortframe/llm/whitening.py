"""Embedding whitening: leading components by contour integration (FEAST), projections scaled to unit variance.

Spark counts the distinct scaled vectors and adds up their centred products exactly; what reaches the driver is the d x d
covariance, whatever the number of rows. There, inertia counts of shifted matrices (Sturm counts of the tridiagonal form)
bracket the leading eigenvalues. For each bracket, Gauss-Legendre quadrature around a circle through its ends solves
``(zI - V) Y = Q`` at complex shifts, which projects random vectors onto the eigenspace inside; Rayleigh-Ritz takes the
components from the projection. A bracket is done when its residuals are at rounding level and the components found are as
many as the inertia counts say; until then the projection is repeated, and the subspace grows where repeating does not help.

Edge cases: rows without a vector, or with a null or non-finite entry, are left out; a null id is kept. Scaled entries beyond
64 bits take the nearest long. Vectors of each length are a space of their own, with their own count and components; empty
vectors have no components. Repeated vectors count once in the fit and get equal rows. Components of (numerically) no
variance have a null ``whitened`` and take no part in ``identity_error``. ``deviation`` is exact up to 38 digits and null
beyond. Equal eigenvalues have any orthonormal basis of their space. An empty table gives no rows; further columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import table, written
from cohortframe.llm.registry import query

SCALE = 256
COMPONENTS = 4
NODES = 8  # quadrature points on the half circle
LOOPS = 12  # projections before the subspace grows
LIMB = 40  # bits of the lower part of an exact sum
SAFE = 2.0**53
CLOSE = 1e-10  # gaps below this share of the spectrum are not cut
DIGITS = 38


# ---- the eigenproblem, on one small symmetric matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder reflections)."""
    a = matrix.astype(float).copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        p -= x * (x @ p)
        rest -= 2 * (np.outer(x, p) + np.outer(p, x))
        a[k + 1, k] = -np.copysign(size, a[k + 1, k])
        a[k + 2 :, k] = 0
    return np.diag(a).copy(), np.array([a[k + 1, k] for k in range(d - 1)])


def above(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Inertia count: how many eigenvalues exceed ``shift``, by the signs of the pivots of T - shift I."""
    diagonal, off = form
    least = np.finfo(float).tiny ** 0.5
    count, pivot = 0, 1.0
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shift - (off[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < least:
            pivot = -least
        count += pivot > 0
    return count


def lower_end(form: tuple[np.ndarray, np.ndarray], wanted: int, low: float, high: float) -> float:
    """A shift below the ``wanted`` largest eigenvalues, in the middle of the gap under them.

    Where the gap is too narrow for a contour, the shift goes below the eigenvalues that are (nearly) equal.
    """
    narrow = CLOSE * max(abs(low), abs(high))
    a, b = low, high  # more than ``wanted`` above a, fewer above b
    while b - a > narrow:
        middle = (a + b) / 2
        found = above(form, middle)
        if found == wanted:
            top = middle
            while top - a > (middle - a) / 256 and middle - a > narrow:  # find the eigenvalue below the gap
                step = (a + top) / 2
                a, top = (a, step) if above(form, step) == wanted else (step, top)
            if middle - a > narrow:
                return (top + middle) / 2
            break
        a, b = (middle, b) if found > wanted else (a, middle)
    return a - narrow


def projected(matrix: np.ndarray, vectors: np.ndarray, low: float, high: float, nodes: int = NODES) -> np.ndarray:
    """Quadrature of the resolvent around the circle through ``low`` and ``high``, applied to ``vectors``."""
    points, weights = np.polynomial.legendre.leggauss(nodes)
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(vectors)
    identity = np.eye(len(matrix))
    for t, weight in zip(points, weights):
        turn = np.exp(1j * np.pi * (1 - t) / 2)
        out += weight / 2 * np.real(radius * turn * np.linalg.solve((centre + radius * turn) * identity - matrix, vectors))
    return out


def inside(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs in (low, high], largest first."""
    d = len(matrix)
    size = min(d, 2 * count + 4)
    draws = np.random.default_rng(seed)
    norm = max(np.abs(matrix).sum(1).max(), np.finfo(float).tiny)
    basis = draws.standard_normal((d, size))
    while True:
        best = np.inf
        for _ in range(LOOPS):
            space = np.linalg.qr(projected(matrix, basis, low, high))[0]
            small = space.T @ matrix @ space
            values, turn = np.linalg.eigh((small + small.T) / 2)
            basis = space @ turn
            kept = np.argsort(-values)[:count]
            kept = kept[(values[kept] > low) & (values[kept] <= high)]
            error = np.linalg.norm(matrix @ basis[:, kept] - basis[:, kept] * values[kept], axis=0).max(initial=0.0) / norm
            done = len(kept) == count
            if done and error <= np.finfo(float).eps * np.sqrt(d):
                return values[kept], basis[:, kept]
            if done and error <= 64 * np.finfo(float).eps * np.sqrt(d) and error > best / 2:
                return values[kept], basis[:, kept]  # rounding level: repeating gains nothing
            best = min(best, error) if done else best
        if size == d:
            return np.sort(values)[::-1][:count], basis[:, np.argsort(-values)[:count]]
        size = min(d, 2 * size)
        basis = np.hstack([basis, draws.standard_normal((d, size - basis.shape[1]))])


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and unit eigenvectors (columns) of a symmetric matrix without negative eigenvalues."""
    d = len(matrix)
    wanted = min(wanted, d)
    scale = float(np.trace(matrix))
    if scale <= 0 or not wanted:
        return np.zeros(wanted), np.eye(d)[:, :wanted]
    unit = matrix / scale
    form = tridiagonal(unit)
    high = float(np.abs(unit).sum(1).max()) * 1.01  # no eigenvalue exceeds the largest row sum
    low = lower_end(form, wanted, -0.01 * high, high)
    count = above(form, low)
    values, vectors = inside(unit, low, high, count)
    return values[:wanted] * scale, vectors[:, :wanted]


# ---- sums over rows, in Spark


@dataclass(frozen=True)
class Space:
    """What is known of the vectors of one length."""

    n: int
    sums: tuple[int, ...]
    trace: float = 0.0
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None

    @property
    def centre(self) -> list[int]:
        """The mean, rounded to whole numbers."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def fraction(self) -> np.ndarray:
        """Mean less the rounded mean."""
        return np.array([float(s - c * self.n) / self.n for s, c in zip(self.sums, self.centre)])


def scaled(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key`` and the whole-number vector ``x`` of every usable row."""
    doubles = embeddings.where(F.col(vector).isNotNull()).select(key, F.transform(vector, lambda c: c.cast("double")).alias("_c"))
    rows = doubles.where(F.forall("_c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    largest = float(2**63 - 1024)
    x = F.transform("_c", lambda c: F.floor(F.greatest(F.lit(-largest), F.least(F.lit(largest), c * float(SCALE)))).cast("long"))
    return rows.select(key, x.alias("x"))


def spaces_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length of vectors: the length, which rows have it, and their entries as a matrix."""
    column = batch["x"]
    lengths = np.asarray(pa.compute.list_value_length(column))
    starts = np.asarray(column.offsets)[:-1]
    values = np.asarray(column.values)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, values[starts[rows][:, None] + np.arange(d)[None, :]].astype(np.int64)


def moved(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x less a whole vector: as longs where they are sure to hold the difference, else as Python's whole numbers."""
    bound = max((abs(int(c)) for c in centre), default=0) + (int(np.abs(x.astype(float)).max()) if x.size else 0)
    return x - np.array(centre, np.int64)[None, :] if bound < 2**62 else x.astype(object) - np.array(centre, object)[None, :]


def products(y: np.ndarray) -> np.ndarray:
    """Exact cross products: float blocks while every sum stays below 2^53, whole numbers of any size otherwise."""
    largest = int(abs(y).max()) if y.size else 0
    block = int(min(len(y), SAFE // max(1, largest * largest)))
    if not block or y.dtype == object and largest >= 2**26:
        y = y.astype(object)
        return y.T @ y
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for start in range(0, len(y), block):
        part = y[start : start + block].astype(float)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def limbs(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    """(dim, i, j, whole number) as rows that Spark can add up exactly: value = hi * 2^LIMB + lo."""
    dim, i, j, value = zip(*rows) if rows else ((), (), (), ())
    exact = pa.decimal128(DIGITS, 0)
    return pa.RecordBatch.from_arrays(
        [pa.array(dim, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
         pa.array([Decimal(v >> LIMB) for v in value], exact), pa.array([v & ((1 << LIMB) - 1) for v in value], pa.int64())],
        ["dim", "i", "j", "hi", "lo"],
    )


LIMBS = f"dim int, i int, j int, hi decimal({DIGITS},0), lo long"


def added(parts: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """Totals of ``limbs`` rows: at most d (d + 1) / 2 + d + 1 numbers a length."""
    exact = f"decimal({DIGITS},0)"
    sums = parts.groupBy("dim", "i", "j").agg(F.sum("hi").cast(exact).alias("hi"), F.sum(F.col("lo").cast(exact)).cast(exact).alias("lo"))
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in sums.toLocalIterator():
        out.setdefault(r.dim, {})[r.i, r.j] = int(r.hi) * (1 << LIMB) + int(r.lo)
    return out


def counted(fit: DataFrame) -> dict[int, Space]:
    """Count and sums of the distinct vectors, by length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for d, rows, x in spaces_of(batch):
                n, s = totals.get(d, (0, np.zeros(d, object)))
                # halves of 32 bits cannot overflow a long within a batch
                totals[d] = n + len(rows), s + ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        for d, (n, s) in totals.items():
            yield limbs([(d, -1, -1, n), *((d, -1, k, int(v)) for k, v in enumerate(s))])

    found = added(fit.mapInArrow(add, LIMBS))
    return {d: Space(cells[-1, -1], tuple(cells[-1, k] for k in range(d))) for d, cells in found.items()}


def fitted(fit: DataFrame, wanted: int) -> dict[int, Space]:
    """The components of every length, from two passes over the distinct vectors."""
    spaces = {d: s for d, s in counted(fit).items() if d}
    centres = {d: s.centre for d, s in spaces.items()}

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in spaces_of(batch):
                if d:
                    totals[d] = totals.get(d, 0) + products(moved(x, centres[d]))
        for d, total in totals.items():
            for i in range(d):
                yield limbs([(d, i, j, int(total[i, j])) for j in range(i, d)])

    found = added(fit.mapInArrow(multiply, LIMBS)) if spaces else {}
    out = {}
    for d, space in spaces.items():
        rest = [s - c * space.n for s, c in zip(space.sums, space.centre)]
        matrix = np.zeros((d, d))
        for (i, j), value in found[d].items():
            matrix[i, j] = matrix[j, i] = (value * space.n - rest[i] * rest[j]) / space.n**2
        values, vectors = leading(matrix, wanted)
        trace = float(np.trace(matrix))
        values = np.where(values > 4 * d * np.finfo(float).eps * trace, values, 0.0)
        out[d] = Space(space.n, space.sums, trace, values, vectors)
    return out


def projections(x: np.ndarray, space: Space) -> np.ndarray:
    """Whitened coordinates of the rows of ``x``; NaN for components of no variance."""
    y = moved(x, space.centre).astype(float) - space.fraction
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(space.values > 0, (y @ space.vectors) / np.sqrt(space.values), np.nan)


def identity_errors(fit: DataFrame, spaces: dict[int, Space]) -> dict[int, float | None]:
    """Largest absolute entry of the whitened covariance less the identity, by length, from a pass over the fit list."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in spaces_of(batch):
                if d:
                    w = projections(x, spaces[d])
                    totals[d] = totals.get(d, 0) + np.vstack([w.T @ w, w.sum(0)])
        for d, total in totals.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(total.size, d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())],
                ["dim", "i", "j", "value"],
            )

    sums = fit.mapInArrow(multiply, "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("value"))
    cells: dict[int, np.ndarray] = {d: np.zeros((len(s.values) + 1, len(s.values))) for d, s in spaces.items()}
    for r in sums.collect() if spaces else []:  # COMPONENTS^2 + COMPONENTS numbers a length
        cells[r.dim][r.i, r.j] = r.value
    out: dict[int, float | None] = {}
    for d, total in cells.items():
        mean = total[-1] / spaces[d].n
        gap = np.abs(total[:-1] / spaces[d].n - np.outer(mean, mean) - np.eye(len(mean)))
        gap = gap[np.ix_(spaces[d].values > 0, spaces[d].values > 0)]
        out[d] = float(gap.max()) if gap.size else None
    return out


def deviations(x: np.ndarray, space: Space) -> pa.Array:
    """Exact sum over dimensions of (n x - S)^2; null beyond 38 digits."""
    exact = pa.decimal128(DIGITS, 0)
    largest = int(np.abs(x.astype(float)).max()) + 1 if x.size else 0
    reach = space.n * largest + max(abs(s) for s in space.sums)
    if reach * reach * x.shape[1] < 2**63:
        y = space.n * x - np.array(space.sums, np.int64)
        return pa.array((y * y).sum(1)).cast(exact)
    y = x.astype(object) * space.n - np.array(space.sums, object)
    return pa.array([Decimal(v) if v < 10**DIGITS else None for v in (y * y).sum(1)], exact)


WHITENED = f"component int, n long, deviation decimal({DIGITS},0), whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row per usable vector and component (numbered from 1 by falling variance)."""
    rows = written(scaled(embeddings, vector, key), "scaled")
    fit = written(rows.select("x").distinct(), "distinct-vectors")
    spaces = fitted(fit, components)
    errors = identity_errors(fit, spaces)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in spaces_of(batch):
                if not d:
                    continue
                space = spaces[d]
                k = len(space.values)
                values = projections(x, space).ravel()
                each = np.repeat(np.arange(len(at)), k)
                explained = space.values / space.trace if space.trace > 0 else np.zeros(k)
                yield pa.RecordBatch.from_arrays(
                    [batch[key].take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                     pa.array(np.full(len(each), space.n, np.int64)), deviations(x, space).take(pa.array(each)),
                     pa.array(values, mask=np.isnan(values)), pa.array(np.tile(explained, len(at))),
                     pa.array([errors[d]] * len(each), pa.float64())],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(spread, f"{key} {rows.schema[key].dataType.simpleString()}, {WHITENED}")


@query("op11_whitening")
def op11(spark, folder):
    rows = whitened(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))
