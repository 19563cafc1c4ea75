"""Regression forests grown level by level from histograms, many of them at once.

Predictors are cut into bins at the quantiles of their group, the outcome is a whole number, and bootstrap weights, the
predictors a node may use and all orders come from hashes. So every sum is exact, every choice is a function of sums, and a
forest is the same however its rows are spread: a node's histogram may be added up from any number of parts.

A node has number 1 at the root and 2k, 2k + 1 below node k; rows in a node that is not split keep its number.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

from cohortframe.functions.draws import hash_uniform_np, poisson_weight_np

BINS = 32
LEAST = 5  # rows (bootstrap weight) on each side of a split
STEPS = 1 << 20  # an outcome's range in whole numbers
CELLS = 400_000  # trees x combinations whose levels are grown at once
BLOCK = 4096  # rows whose weights are drawn at once


def key_code(*parts) -> int:
    """A number for a group, chain, tree or round, the same everywhere."""
    return zlib.crc32(repr(parts).encode())


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers (rows x predictors); what is missing is in bin 0."""
    out = np.zeros(values.shape, np.int64)
    for k, cuts in enumerate(edges):
        out[:, k] = np.where(np.isnan(values[:, k]), 0, np.searchsorted(cuts, values[:, k], side="left"))
    return out


def whole(y: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.rint((y - low) / (high - low) * STEPS).astype(np.int64) if high > low else np.zeros(len(y), np.int64)


def tree_weights(ids: np.ndarray, trees: int, code: int, seed: int) -> np.ndarray:
    """Poisson weights, trees x rows."""
    out = np.empty((trees, len(ids)), np.int8)
    numbers = (code * 64 + np.arange(trees, dtype=np.int64)[:, None]) % (2**31)
    for start in range(0, len(ids), BLOCK):
        part = slice(start, start + BLOCK)
        out[:, part] = poisson_weight_np(hash_uniform_np(ids[None, part], numbers, seed))
    return out


def bootstrap(ids: np.ndarray, trees: int, code: int, seed: int) -> np.ndarray:
    """Poisson weights, rows x trees."""
    return tree_weights(ids, trees, code, seed).T.astype(np.int64)


class Forest:
    """Splits of one forest as tables (tree x node): predictor (-1: none) and bin (rows up to it go left)."""

    def __init__(self, trees: int, depth: int):
        self.depth = depth
        self.feature = np.full((trees, 2 ** (depth + 1)), -1, np.int64)
        self.bin = np.zeros((trees, 2 ** (depth + 1)), np.int64)

    @property
    def trees(self) -> int:
        return len(self.feature)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node of every row in every tree (rows x trees)."""
        node = np.ones((len(bins), self.trees), np.int64)
        tree, row = np.arange(self.trees)[None, :], np.arange(len(bins))[:, None]
        for _ in range(self.depth):
            feature = self.feature[tree, node]
            right = bins[row, np.maximum(feature, 0)] > self.bin[tree, node] if bins.shape[1] else np.zeros(node.shape, bool)
            node = np.where(feature >= 0, 2 * node + right, node)
        return node


def histograms(bins: np.ndarray, y: np.ndarray, weights: np.ndarray, node: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of one level as tree * 2^30 + node, and per node, predictor and bin the weight and the weighted outcome (n x 2 x p x BINS)."""
    row, tree = np.nonzero((weights > 0) & (node >= 1 << level))
    cells, place = np.unique(tree << 30 | node[row, tree], return_inverse=True)
    p = bins.shape[1]
    out = np.zeros((len(cells), 2, p, BINS), np.int64)
    w = weights[row, tree].astype(float)
    wy = w * y[row]
    for k in range(p):
        at = place * BINS + bins[row, k]
        out[:, 0, k] = np.bincount(at, w, len(cells) * BINS).astype(np.int64).reshape(-1, BINS)
        out[:, 1, k] = np.bincount(at, wy, len(cells) * BINS).astype(np.int64).reshape(-1, BINS)
    return cells, out


def allowed(p: int, code: int, cells: np.ndarray) -> np.ndarray:
    """Which predictors each node may use: a third of them, at least one, by hash."""
    u = np.stack([hash_uniform_np(cells, np.full(len(cells), (code + 7 * k + 1) % (2**31)), 11) for k in range(p)], 1)
    return np.argsort(np.argsort(u, axis=1, kind="stable"), axis=1) < math.ceil(p / 3)


def best_splits(sums: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per node the predictor (-1: no split) and bin with the largest drop of squares; the first of equal ones."""
    left = np.cumsum(sums, axis=3)[..., :-1]
    total = sums.sum(3)[..., None]
    w, s = left[:, 0].astype(float), left[:, 1].astype(float)
    wr, sr = (total[:, 0] - left[:, 0]).astype(float), (total[:, 1] - left[:, 1]).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s * s / w + sr * sr / wr - (s + sr) ** 2 / (w + wr)
    gain = np.where((w >= LEAST) & (wr >= LEAST) & usable[:, :, None], gain, -1.0).reshape(len(sums), -1)
    best = gain.argmax(1)
    good = gain[np.arange(len(sums)), best] > 1e-9 * STEPS
    return np.where(good, best // (BINS - 1), -1), best % (BINS - 1)


def combinations(columns: list[np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' distinct combinations of bins: the number of each row's, and the bins of each (combinations x columns).

    A tree tells rows apart by their bins only, so what it sums up and splits are combinations, however many rows share one.
    """
    code, size = np.zeros(rows, np.int64), 1
    for column in columns:
        radix = int(column.max(initial=0)) + 1
        if size * radix >= 1 << 62:
            found, code = np.unique(code, return_inverse=True)
            size = len(found)
        code, size = code * radix + column, size * radix
    if size <= 4 * rows + BLOCK:
        there = np.zeros(size, bool)
        there[code] = True
        count = int(there.sum())
        code = (np.cumsum(there) - 1)[code]
    else:
        found, code = np.unique(code, return_inverse=True)
        count = len(found)
    sample = np.zeros(count, np.int64)
    sample[code] = np.arange(rows)
    return code, np.stack([c[sample] for c in columns], 1).astype(np.int64) if columns else np.zeros((count, 0), np.int64)


def grow_on(place: np.ndarray, table: np.ndarray, y: np.ndarray, ids: np.ndarray, trees: int, depth: int, code: int, seed: int) -> tuple[Forest, np.ndarray]:
    """A forest of rows at ``place`` among the combinations of ``table``, and every combination's node (trees x combinations).

    The sums of a tree are taken once by combination; its levels then go over combinations, not over rows.
    """
    forest = Forest(trees, depth)
    node = np.empty((trees, len(table)), np.int16 if depth < 14 else np.int64)
    step = max(1, CELLS // max(1, len(table)))
    outcome = y.astype(float)
    weights = tree_weights(ids, trees, code, seed)
    for start in range(0, trees, step):
        node[start : start + step] = _grow_some(forest, start, weights[start : start + step], place, table, outcome, code)
    return forest, node


def _grow_some(forest: Forest, start: int, weights: np.ndarray, place: np.ndarray, table: np.ndarray, outcome: np.ndarray, code: int) -> np.ndarray:
    """The trees from number ``start`` on, as many as ``weights`` has rows."""
    trees, (count, p) = len(weights), table.shape
    features, cuts = forest.feature[start : start + trees], forest.bin[start : start + trees]
    sums = np.empty((2, trees, count))
    for t in range(trees):
        w = weights[t].astype(float)
        sums[0, t], sums[1, t] = np.bincount(place, w, count), np.bincount(place, w * outcome, count)
    node = np.ones((trees, count), np.int64)
    full = 2 ** (forest.depth + 1)
    base, column = np.arange(trees)[:, None] * full, np.arange(count)[None, :] * p
    flat = table.ravel()
    used = sums[0] > 0
    for level in range(forest.depth if p else 0):
        number = base + node
        live = used & (node >= 1 << level)
        cells, at = np.unique(number[live], return_inverse=True) if trees * full > 1 << 20 else _numbered(number[live], trees * full)
        if not len(cells):
            break
        w, wy, bins = sums[0][live], sums[1][live], np.broadcast_to(np.arange(count), node.shape)[live]
        out = np.empty((len(cells), 2, p, BINS), np.int64)
        for k in range(p):
            key = at * BINS + table[bins, k]
            out[:, 0, k] = np.bincount(key, w, len(cells) * BINS).reshape(-1, BINS)
            out[:, 1, k] = np.bincount(key, wy, len(cells) * BINS).reshape(-1, BINS)
        tree, which = cells // full, cells % full
        features[tree, which], cuts[tree, which] = best_splits(out, allowed(p, code, tree + start << 30 | which))
        feature = features.ravel()[number]
        right = flat[column + np.maximum(feature, 0)] > cuts.ravel()[number]
        node = np.where(feature >= 0, 2 * node + right, node)
    return node


def _numbered(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with inverse for whole numbers below ``size``."""
    there = np.zeros(size, bool)
    there[values] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[values]


def grow(bins: np.ndarray, y: np.ndarray, ids: np.ndarray, trees: int, depth: int, code: int, seed: int) -> Forest:
    """A forest of rows that are all here; the passes over spread rows take the same sums and choices."""
    place, table = combinations(list(bins.T), len(bins))
    return grow_on(place, table, y, ids, trees, depth, code, seed)[0]


def donor_order(ids: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of donors and the places of the donors in the order (hash, id)."""
    hashed = hash_uniform_np(ids, np.zeros(len(ids), np.int64), seed)
    return hashed, np.lexsort((ids, hashed))


def draw_donors(known: np.ndarray, known_ids: np.ndarray, asking: np.ndarray, u: np.ndarray, seed: int) -> np.ndarray:
    """For each asking row (its nodes, rows x trees) the place of a donor: one of all donors in its leaves, pooled over trees.

    ``u`` picks a number below the size of the pool; the pool is in the order of trees, then of ``donor_order``.
    """
    _, order = donor_order(known_ids, seed)
    return order[draw_ordered(known[order].T, asking.T, u)]


def draw_ordered(known: np.ndarray, asking: np.ndarray, u: np.ndarray) -> np.ndarray:
    """``draw_donors`` for donors that are in ``donor_order`` already; nodes are trees x rows."""
    trees, top = len(known), int(max(known.max(initial=0), asking.max(initial=0))) + 1
    small = np.uint8 if top <= 1 << 8 else np.uint16 if top <= 1 << 16 else np.int64
    sizes = np.stack([np.bincount(leaf, minlength=top) for leaf in known])
    ends = np.cumsum(np.take_along_axis(sizes, asking, 1), axis=0)
    pick = np.floor(u * ends[-1]).astype(np.int64)
    tree = (ends <= pick).sum(0)
    column = np.arange(asking.shape[1])
    leaf = asking[tree, column]
    starts = np.cumsum(sizes, axis=1) - sizes
    place = starts[tree, leaf] + pick - (ends[tree, column] - sizes[tree, leaf])
    out = np.empty(len(pick), np.int64)
    for t in range(trees):
        mine = np.flatnonzero(tree == t)
        if len(mine):
            out[mine] = np.argsort(known[t].astype(small), kind="stable")[place[mine]]
    return out
