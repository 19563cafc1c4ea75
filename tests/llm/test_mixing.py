from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortframe.llm import mixing


def levels(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Share by weight, stop at the bound, reshare the excess, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if cap * sizes[s] < level * weight[s]}
        if not above:
            return out | {s: level * weight[s] for s in free}
        for s in above:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        free -= above
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, "d": 70, None: 3}, {"x": 4}, {"a": 0, "b": 9}, {"a": 0}, {"é": 5, "z": 50, "Z": 500}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(levels(sizes))


def sized_rows(docs):
    text = F.col("text")
    return mixing.numbered(docs.select("doc_id", "source", mixing.words(text).alias("size"), mixing.digest(text).alias("digest")))


def test_mix_takes_what_rates_say(documents):
    want = {r.doc_id: r.copies for r in mixing.rates(sized_rows(documents)).collect()}
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    got = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert got == {k: n for k, n in want.items() if n} and max(want.values()) <= 2


@pytest.mark.parametrize("doc_id", ["id", "CAST(NULL AS LONG)", "id % 3"])
@pytest.mark.parametrize("tail", ["", "id"])
def test_taken_words_come_near_the_targets(spark, doc_id, tail):
    text = f"concat(repeat('a ', CAST(1 + id % 7 AS INT)), '{tail}')" if not tail else "concat(repeat('a ', CAST(id % 7 AS INT)), id)"
    docs = spark.range(60_000).selectExpr(f"{doc_id} AS doc_id", "CAST(id % 5 AS STRING) AS source", f"{text} AS text")
    taken, target, rows = defaultdict(int), {}, mixing.rates(sized_rows(docs)).collect()
    assert len(rows) == 60_000
    for r in rows:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) < 0.03 * target[s] for s in target)


def test_equal_rows_are_numbered_alike_in_both_forms(spark):
    docs = spark.createDataFrame([(7, "a", "x y", i) for i in range(25)] + [(None, "a", "x y z", 0), (None, "b", None, 0)], "doc_id long, source string, text string, n long")
    want = Counter()
    for r in mixing.rates(sized_rows(docs.unionAll(docs))).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixing.mix(docs.unionAll(docs)).collect())
    assert got == +want and 0 < want[7, "a", 2] < 100


def test_edges(edge, empty):
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns
    assert {r.doc_id: r.size for r in mixing.rates(sized_rows(edge)).collect()} == {None: 5, 1: 0, 2: 0, 3: 0, 4: 30_000, 5: 7, 6: 7, 7: 1, 8: 8, 9: 5}
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(edge).collect()))
    assert mixing.mix(empty).count() == 0
