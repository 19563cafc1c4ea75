"""Forests and chained imputation against plain loops, and the two plans against each other."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.functions.draws import hash_uniform_np
from cohortframe.operators import forest, impute
from cohortframe.plans.fixtures import Data


def plain_tree(rows, p, depth, code, tree, node=1, level=0):
    """{node: (predictor, bin)} by trying every split of every node; rows are (bins, y, weight)."""
    if level == depth or not rows:
        return {}
    cell = tree << 30 | node
    u = [hash_uniform_np(np.array([cell]), np.array([(code + 7 * k + 1) % 2**31]), 11)[0] for k in range(p)]
    usable = sorted(range(p), key=lambda k: (u[k], k))[: math.ceil(p / 3)]
    best = (1e-9 * forest.STEPS, None)
    w, s = sum(r[2] for r in rows), sum(r[1] * r[2] for r in rows)
    for k in sorted(usable):
        for b in range(forest.BINS - 1):
            wl, sl = sum(r[2] for r in rows if r[0][k] <= b), sum(r[1] * r[2] for r in rows if r[0][k] <= b)
            if min(wl, w - wl) < forest.LEAST:
                continue
            gain = float(sl) * float(sl) / wl + float(s - sl) * float(s - sl) / (w - wl) - float(s) ** 2 / w
            if gain > best[0]:
                best = (gain, (k, b))
    if best[1] is None:
        return {}
    k, b = best[1]
    left, right = [r for r in rows if r[0][k] <= b], [r for r in rows if r[0][k] > b]
    return {node: best[1]} | plain_tree(left, p, depth, code, tree, 2 * node, level + 1) | plain_tree(right, p, depth, code, tree, 2 * node + 1, level + 1)


def sample(n=120, p=4, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = forest.whole(2 * x[:, 0] - x[:, 1] ** 2 + rng.normal(size=n), -8, 8)
    edges = [np.quantile(x[:, k], np.arange(1, 32) / 32) for k in range(p)]
    return forest.binned(x, edges), y, np.arange(1000, 1000 + n)


def test_trees_against_trying_every_split():
    bins, y, ids = sample()
    grown = forest.grow(bins, y, ids, trees=3, depth=4, code=99, seed=5)
    weights = forest.bootstrap(ids, 3, 99, 5)
    for t in range(3):
        wanted = plain_tree([(b, int(v), int(w)) for b, v, w in zip(bins.tolist(), y, weights[:, t]) if w], 4, 4, 99, t)
        assert {n: (int(grown.feature[t, n]), int(grown.bin[t, n])) for n in np.flatnonzero(grown.feature[t] >= 0)} == wanted and wanted
        for i, row in enumerate(bins):
            node = 1
            while node in wanted:
                node = 2 * node + int(row[wanted[node][0]] > wanted[node][1])
            assert grown.nodes(bins)[i, t] == node


def test_histograms_add_up_in_any_parts():
    bins, y, ids = sample()
    weights, node = forest.bootstrap(ids, 3, 7, 1), np.ones((len(ids), 3), np.int64)
    cells, sums = forest.histograms(bins, y, weights, node, 0)
    parts = defaultdict(int)
    for part in np.array_split(np.random.default_rng(0).permutation(len(ids)), 5):
        for c, s in zip(*forest.histograms(bins[part], y[part], weights[part], node[part], 0)):
            parts[c] = parts[c] + s
    assert all((parts[c] == s).all() for c, s in zip(cells, sums)) and len(parts) == len(cells) == 3
    assert sums[0, 0, 0].sum() == weights[:, 0].sum() and sums[1, 1, 2].sum() == (weights[:, 1] * y).sum()


def test_donors_are_drawn_evenly_from_the_pooled_leaves():
    known = np.array([[2, 3], [2, 2], [3, 3], [2, 3]])
    ids = np.array([5, 6, 7, 8])
    u = (np.arange(600) + 0.5) / 600
    got = forest.draw_donors(known, ids, np.tile([[2, 3]], (600, 1)), u, 1)
    # leaf 2 of the first tree holds rows 0, 1, 3; leaf 3 of the second 0, 2, 3: a pool of six
    assert [int((got == k).sum()) for k in range(4)] == [200, 100, 100, 200]


ARGS = dict(
    ident="id", by=["cohort", "male"], numeric=["cog", "bmi_20", "bmi_40"],
    categorical={"mother_edu_level": [0, 1], "father_class": [1, 2, 3, 4, 5, 6]}, m=2, sweeps=2, trees=3,
)


def table(df):
    return sorted((r.imp, r.id, r.cog, r.bmi_20, r.bmi_40, r.mother_edu_level, r.father_class) for r in df.collect())


@pytest.fixture(scope="module")
def study(spark, folder):
    rows = Data(spark, folder).study().select("id", "cohort", "male", "cog", "bmi_20", "bmi_40", "father_class", "mother_edu_level")
    unknown = {"cohort": F.expr("nullif(cohort, 'BUILDING')"), "bmi_20": F.when(F.col("id") % 5 > 0, F.col("bmi_20"))}
    return rows.withColumns(unknown).cache()


def test_small_and_large_groups_take_the_same_donors(study):
    """One task per chain and group, or passes over all rows in other partitions: the same values, with a missing group too."""
    small = table(impute.chained_imputation(study, **ARGS))
    assert small == table(impute.chained_imputation(study.repartition(7), **ARGS, unit_rows=0))
    assert len(small) == 2 * study.count() and len({tuple(r[1:]) for r in small}) > study.count()


def test_values_come_from_the_group_and_observed_cells_stay(study):
    observed = {r.id: r for r in study.collect()}
    donors = defaultdict(set)
    for r in observed.values():
        for c in ARGS["numeric"]:
            donors[r.cohort, r.male, c].add(r[c])
    for r in impute.chained_imputation(study, **ARGS).collect():
        base = observed[r.id]
        assert (r.cohort, r.male) == (base.cohort, base.male)
        for c in (*ARGS["numeric"], *ARGS["categorical"]):
            if base[c] is not None:
                assert r[c] == base[c]
        assert all(r[c] in donors[r.cohort, r.male, c] for c in ARGS["numeric"])
        assert r.mother_edu_level in (0, 1) and r.father_class in range(1, 7)


def test_forests_follow_their_own_group(spark):
    """Where x predicts y upwards in one group and downwards in the other, donors follow the group's own relation."""
    rows = []
    for i in range(600):
        g, x = "ab"[i % 2], (i * 37 % 600) / 600
        rows.append((i, g, x, None if i % 3 == 0 else (x if g == "a" else 1 - x)))
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    done = impute.chained_imputation(df, "id", ["g"], ["y"], {}, m=5, sweeps=1, helpers=["x"]).collect()
    error = [abs(r.y - (r.x if r.g == "a" else 1 - r.x)) for r in done if r.id % 3 == 0]
    assert np.mean(error) < 0.1
    alone = impute.chained_imputation(df, "id", ["g"], ["y", "x"], {}, m=1, sweeps=1, excluded=["x"]).collect()
    assert np.mean([abs(r.y - (r.x if r.g == "a" else 1 - r.x)) for r in alone if r.id % 3 == 0]) > 0.2


def test_nothing_observed_and_nothing_missing(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], None if i % 2 else float(i), float(i % 5), None) for i in range(30)], "id long, g string, y double, x double, z double")
    for unit_rows in (0, 1000):
        done = {r.id: r for r in impute.chained_imputation(df, "id", ["g"], ["y", "x", "z"], {}, m=1, sweeps=1, unit_rows=unit_rows).collect()}
        assert len(done) == 30 and done[1].y is None and done[2].y == 2.0 and done[3].z is None and done[3].x == 3.0


def test_rows_are_summed_once_a_tree(monkeypatch):
    """Levels go over the combinations of bins that occur, not over rows."""
    rng = np.random.default_rng(4)
    bins = np.stack([rng.integers(0, 4, 20_000), rng.integers(0, 3, 20_000)], 1)
    y, seen, plain = rng.integers(0, 1000, 20_000), [], np.bincount
    monkeypatch.setattr(forest.np, "bincount", lambda x, *rest: seen.append(len(x)) or plain(x, *rest))
    forest.grow(bins, y, np.arange(20_000), trees=3, depth=5, code=3, seed=1)
    assert sum(seen) < 2.1 * 3 * 20_000


@pytest.mark.parametrize("width", [0, 1, 3, 20])
def test_combinations_tell_rows_apart(width):
    columns = list(np.random.default_rng(1).integers(0, 32 if width > 3 else 3, (width, 500)).astype(np.int8))
    place, table = forest.combinations(columns, 500)
    assert (table[place] == np.array(columns).reshape(width, 500).T).all() and len(table) == len(np.unique(table, axis=0)) == place.max() + 1


def test_ids_that_repeat_or_are_missing(spark):
    """Rows of one id are rows of their own; all chains of a task come back, also where they do not fill the last task."""
    rows = [(None if i == 7 else i // 2, "ab"[i % 2], None if i % 3 == 0 else float(i), float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, y double, x double")
    done = impute.chained_imputation(df, "id", ["g"], ["y"], {}, m=impute.TASK_CHAINS + 2, sweeps=1, helpers=["x"]).collect()
    assert sorted({r.imp for r in done}) == list(range(1, impute.TASK_CHAINS + 3)) and len(done) == 60 * (impute.TASK_CHAINS + 2)
    assert all(r.y is not None for r in done) and sum(r.id is None for r in done) == impute.TASK_CHAINS + 2


def test_trees_grown_in_blocks_are_the_same(monkeypatch):
    """A large group's trees are grown a few at a time, so what a task holds does not follow their number."""
    bins, y, ids = sample()
    whole = forest.grow(bins, y, ids, trees=5, depth=4, code=99, seed=5)
    monkeypatch.setattr(forest, "CELLS", 250)
    blocks = forest.grow(bins, y, ids, trees=5, depth=4, code=99, seed=5)
    assert (whole.feature == blocks.feature).all() and (whole.bin == blocks.bin).all() and (whole.feature >= 0).any()
