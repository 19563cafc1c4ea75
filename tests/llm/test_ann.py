import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.llm import ann


def brute(rows, k, asked):
    """Exact answers by (query id): all rows, largest inner product first, ties to the smaller id."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if asked(i):
            out[i] = sorted(((-float((q * v).sum()), j) for j, v in good if j != i))[:k]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_all_lists_give_exact_neighbours_with_ties(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(600, 8)).round(2) * draw.integers(1, 5, (600, 1))
    vectors[100:400] = vectors[100]  # a crowded vector
    rows = [(int(i), v.tolist()) for i, v in zip(draw.permutation(600), vectors)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] * 8), (1005, [float("inf")] * 8), (None, [1.0] * 8), (1020, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, list int")
    got = answers(ann.search(df, df.where(F.col("vec_id") % 20 == 0), 20, probed=1.0))
    want = brute([r for r in rows if r[0] != 1020], 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    for q in want:
        assert [x[1] for x in got[q]] == [x[1] for x in want[q]], q
        assert np.allclose([x[0] for x in got[q]], [x[0] for x in want[q]], rtol=1e-12)


def test_recall(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = answers(ann.search(df, df.where(F.col("vec_id") % 20 == 0)))
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 20, lambda i: i % 20 == 0)
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 2.0])], [(20, [1.0, 2.0]), (3, [2.0, 1.0])], [(20, [0.0, 0.0])]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = answers(ann.search(df, df.where(F.col("vec_id") % 20 == 0)))
    assert got == {q: w for q, w in brute(rows, 20, lambda i: i % 20 == 0).items() if w}


def test_a_scan_abandons_most_candidates_early_and_keeps_the_nearest():
    draw = np.random.default_rng(1)
    turn = ann.rotation(65)
    points = draw.normal(size=(3000, 65))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    q = points[0] + 0.3 * draw.normal(size=65) / 8
    far = ((points - q) ** 2).sum(1)
    bound = np.sort(far)[19]
    kept = ann.scan(q @ turn, np.ascontiguousarray((points @ turn).T), bound, 20)
    assert set(np.argsort(far)[:20]) <= set(kept.tolist()) and len(kept) <= 25
