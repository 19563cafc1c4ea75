import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohortframe.llm import neardup


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def brute(rows, size):
    """doc_id -> (set size, least doc_id reachable), by comparing all pairs."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(rng, base, n, change):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, change)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    out = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(150)]
    for change in (3, 8, 14):  # chains of copies on both sides of the bound
        out += copies(rng, rng.choices(vocabulary, k=90), 60, change)
    out += [out[0]] * 40 + ["short one", "Short ONE", "x", "x", "", " "]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("size", [2, 5])
@pytest.mark.parametrize("limits", [None, (8, 300)])
def test_components(spark, texts, size, limits, monkeypatch):
    if limits:  # groups beyond a chunk are cut, with the same result
        monkeypatch.setattr(neardup, "CELL_ROWS", limits[0])
        monkeypatch.setattr(neardup, "CELL_SHINGLES", limits[1])
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, size).collect()}
    assert got == brute(texts, size)


def test_joined_rows():
    rng = np.random.default_rng(2)
    for _ in range(100):
        n = int(rng.integers(2, 30))
        links = rng.random((n, n)) < rng.choice([0.02, 0.1, 0.5])
        links = links | links.T | np.eye(n, dtype=bool)
        reach = links.copy()
        for _ in range(5):
            reach = reach @ reach
        assert np.array_equal(neardup.joined_rows(n, lambda i: links[i]), reach.argmax(1))


def test_long_chains_end_in_their_least_node(spark):
    rng = random.Random(1)
    names = list(range(1, 400))
    rng.shuffle(names)
    edges = [(a, b) for a, b in zip(names, names[1:]) if names.index(a) % 100 != 99] + [(1000, 1000)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parts = [names[k : k + 100] for k in range(0, len(names), 100)]
    assert got == {x: min(p) for p in parts for x in p if len(p) > 1}


def test_planted_copies_are_caught_and_one_of_each_group_stays(spark, documents):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    chosen = [r for r in rows if 100 < len(r[1].split()) < 900][:40]
    planted = [(10_000 + k, " ".join(copies(rng, t.split(), 1, max(1, len(t.split()) // 60))[0].split())) for k, (_, t) in enumerate(chosen)]
    docs = spark.createDataFrame(rows + planted, "doc_id long, text string")
    want = brute(rows + planted, 5)
    got = {r.doc_id for r in neardup.deduplicated(docs).collect()}
    assert got == {i for i, (_, c) in want.items() if i == c} and len(got & {i for i, _ in planted}) < 10


def test_edges(edge, empty):
    rows = neardup.near_duplicates(edge, 2).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter(
        [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (5, 5, True), (6, 5, False), (None, None, True), (7, 7, True), (8, 8, True), (9, 9, True)]
    )
    left = neardup.deduplicated(edge, 2)
    assert left.columns == edge.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, 2, 3, 4, 5, None, 7, 8, 9])
    assert neardup.near_duplicates(empty, 2).count() == 0 and neardup.deduplicated(empty).count() == 0


def test_texts_under_one_id_are_judged_on_their_own(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near_a, near_b = a + " more", b + " more"
    rows = [(3, a), (5, near_a), (5, b), (7, near_b), (8, c), (8, c + " more"), (8, c.upper()), (9, "alone"), (9, "")]
    left = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = Counter((r.doc_id, r.text) for r in left if r.doc_id != 8)
    assert kept == Counter([(3, a), (5, b), (9, "alone"), (9, "")])
    assert len([r for r in left if r.doc_id == 8]) == 1


def test_exact_bound():
    part = pa.table({"shingles": pa.array([np.arange(a, b, dtype=np.uint64).tobytes() for a, b in ((0, 9), (1, 10), (0, 8), (2, 10))])})
    linked = neardup.near(part)
    assert linked(0).tolist() == [True, True, True, False] and linked(2).tolist() == [True, False, True, False]


def test_kept_is_the_rows_own_component(spark):
    """Two linked texts under the least doc_id are both kept by the query's rule; one of them stands for the group."""
    words = [f"w{i}" for i in range(200)]
    a, b, c = " ".join(words), " ".join(words[:199]), " ".join(words[1:])
    docs = spark.createDataFrame([(5, a), (5, b), (7, c), (9, "on its own here")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 2).collect())
    assert rows == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True)]
    assert sorted(r.doc_id for r in neardup.deduplicated(docs, 2).collect()) == [5, 9]
