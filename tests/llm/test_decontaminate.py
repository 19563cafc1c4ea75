import random

import numpy as np
import pytest

from cohortframe.llm import decontaminate as d


def edits(a, b):
    """Least edits from a to any stretch of b, by the plain table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return min(row)


def test_alignment():
    rng = random.Random(4)
    for _ in range(300):
        a = np.array([rng.randint(1, 5) for _ in range(rng.randint(1, 70))], np.uint64)
        b = np.array([rng.randint(1, 5) for _ in range(rng.randint(0, 90))], np.uint64)
        best, end = d.align(a, b)
        assert best == edits(a.tolist(), b.tolist())
        assert best == len(a) or best == edits(a.tolist(), b[:end].tolist())


def changed(words, n, rng):
    words = list(words)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(words))
        if kind == 0:
            words[at] = f"q{rng.random()}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"q{rng.random()}")
    return words


@pytest.fixture(scope="module")
def cases(spark, folder):
    rng = random.Random(9)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    docs, planted = [], set()
    for k, (item, text) in enumerate(items * 5):
        words = text.split()
        n = int(0.15 * len(words)) * (k % 3) // 2
        before, after = (rng.choice(clean)[1].split()[:60] for _ in range(2))
        docs.append((10_000 + k, " ".join([*before, *changed(words, n, rng), *after])))
        planted.add((10_000 + k, item))
    return items, clean + docs, planted


def test_recall_and_exactness_against_brute_force(spark, cases):
    items, docs, planted = cases
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = d.leaks(docs_df, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r for r in rows}
    assert len(got) == len(rows) and len(planted & got.keys()) >= 0.97 * len(planted)
    memo = d.Hashes()
    words = {i: d.word_hashes(t.encode(), memo).tolist() for i, t in docs}
    known = {i: d.word_hashes(t.encode(), memo).tolist() for i, t in items}
    for (doc, item), r in got.items():
        a = known[item]
        assert r.edits <= d.allowed(len(a)) and r.edits == edits(a, words[doc])
        assert edits(a, words[doc][r.first_word : r.end_word]) == r.edits
    whole = {(i, item) for i, t in docs for item, text in items if text in t}
    assert whole <= got.keys()


def test_items_without_their_first_words_alone_in_a_piece(spark, folder):
    known = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    memo, items = d.Hashes(), d.Items(known)
    before = d.word_hashes(b"some other words of a text that stands before it", memo)
    found = {True: set(), False: set()}
    for item, text in known:
        words = d.word_hashes(text, memo)
        for lost in range(1, d.allowed(len(words)) + 1):
            for alone in found:
                rows = [words[lost:]] if alone else [before, words[lost:]]
                stream = np.concatenate([np.append(x, np.uint64(0)) for x in rows])
                ends = np.cumsum([len(x) + 1 for x in rows]) - 1
                got = {(items.ids[x[1]], *x[2:]) for x in d.matches(items, stream, ends) if x[0] == len(rows) - 1}
                found[alone] |= {(item, lost, *x) for x in got}
    assert found[True] == found[False] and len(found[True]) > 0


def test_clean_documents_stay(spark, cases):
    items, docs, planted = cases
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs_df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, row string")
    bad = {r.doc_id for r in d.leaks(docs_df, bench).collect()}
    left = d.without_leaks(docs_df, bench)
    assert left.columns == docs_df.columns and {r.doc_id for r in left.collect()} == {i for i, _ in docs} - bad


def test_blocks_of_items_give_the_same(spark, cases, monkeypatch):
    items, docs, _ = cases
    bench, docs_df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs[:300], "doc_id long, text string")
    one = {tuple(r) for r in d.leaks(docs_df, bench).collect()}
    monkeypatch.setattr(d.blocks, "__defaults__", (7,))
    assert {tuple(r) for r in d.leaks(docs_df, bench).collect()} == one
    assert len(list(d.blocks(bench))) > 3


def test_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (1, "One two three four five six seven!"), (2, None), (3, ""), (4, "x"), (5, "漢字 😀")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits) for r in d.leaks(edge, bench).collect())
    assert got == sorted([(5, 1, 0)] * 4 + [(6, 1, 0)] * 2 + [(7, 4, 0), (9, 5, 0)])
    left = d.without_leaks(edge, bench)
    assert left.columns == edge.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "4", "8", "None"]
    assert d.leaks(empty, bench).count() == 0 and d.leaks(edge, bench.limit(0)).count() == 0
    assert d.without_leaks(edge, bench.limit(0)).count() == edge.count()
