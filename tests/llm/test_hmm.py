import itertools
import math
from collections import Counter

import numpy as np

from cohortframe.llm import hmm


def tables(seed=0):
    out = hmm.Tables(np.random.default_rng(seed).integers(0, 50, hmm.CLASSES).astype(float))
    draw = np.random.default_rng(seed + 1)
    out.learn(draw.random((2, hmm.STATES)), draw.random((hmm.STATES, hmm.STATES)) * 5, draw.random((hmm.CLASSES, hmm.STATES)) * 3)
    return out


def test_forward_is_the_sum_over_all_paths(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 3)
    model = tables()
    stream = np.array([5, 17, 5, hmm.END_CLASS, hmm.END_CLASS, 9, 9, 9, 2, hmm.END_CLASS], np.uint16)
    lengths = np.array([4, 1, 5])
    got = hmm.log_likelihoods(stream, lengths, model)
    for k, (start, n) in enumerate(zip((0, 4, 5), lengths)):
        total = 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            p = model.start[0, path[0]]
            for t, s in enumerate(path):
                p *= model.emit[stream[start + t], s] * (model.move[path[t - 1], s] if t else 1)
            total += p
        assert math.isclose(got[k], math.log10(total), rel_tol=1e-9)


def test_expected_counts_by_brute_force(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 2)
    model = tables(4)
    stream = np.array([3, 3, 8, 1, 8, 3], np.uint16)
    start, move, emit = hmm.expected_counts(stream, np.array([0, 4]), np.array([4, 2]), np.array([0, 1]), model)
    want = np.zeros((2, 2)), np.zeros((2, 2)), np.zeros((hmm.CLASSES, 2))
    for begin, n, opening in ((0, 4, 0), (4, 2, 1)):
        seen = stream[begin : begin + n]
        weights = {}
        for path in itertools.product(range(2), repeat=n):
            p = model.start[opening, path[0]]
            for t, s in enumerate(path):
                p *= model.emit[seen[t], s] * (model.move[path[t - 1], s] if t else 1)
            weights[path] = p
        for path, p in weights.items():
            p /= sum(weights.values())
            want[0][opening, path[0]] += p
            for t, s in enumerate(path):
                want[2][seen[t], s] += p
                if t:
                    want[1][path[t - 1], s] += p
    for a, b in zip((start, move, emit), want):
        assert np.allclose(a, b, atol=1e-4)


def test_emissions_of_a_state_sum_to_one():
    """Over the words of a small corpus, the end and one unseen word per tail class."""
    draw = np.random.default_rng(2)
    counts = hmm.Counts.__new__(hmm.Counts)
    counts.rest_words, counts.own_words = draw.integers(0, 4, hmm.TAILS).astype(float), draw.integers(0, 3, hmm.TAILS).astype(float)
    counts.rest_tokens, counts.mass = counts.rest_words.copy(), draw.integers(0, 9, hmm.CLASSES).astype(float)
    sums = draw.random((hmm.SUMS + 1 + hmm.TAILS, hmm.STATES))
    tails = np.repeat(np.arange(hmm.TAILS), counts.own_words.astype(int))
    found = draw.random((len(tails), hmm.STATES))
    sums[hmm.SUMS + 1 :] = [found[tails == k].sum(0) for k in range(hmm.TAILS)]
    model = vars(hmm.WordModel(counts, tables(), sums))
    rest = np.repeat(np.arange(hmm.TAILS), counts.rest_words.astype(int))
    classes = np.concatenate([np.arange(hmm.TOP), hmm.TOP + tails, hmm.TOP + rest, hmm.TOP + np.arange(hmm.TAILS), [hmm.END_CLASS]])
    seen = np.concatenate([np.full(hmm.TOP + len(tails), 2), np.ones(len(rest), int), np.zeros(hmm.TAILS, int)])
    out = hmm.emissions(model, classes, seen, hmm.TOP + np.arange(len(tails)), found)
    assert np.allclose(out.sum(0), 1)


def test_stretches_cover_texts():
    first, length, opening = hmm.stretches(np.array([1, hmm.STRETCH, 2 * hmm.STRETCH + 3]), np.array([True, False, True]))
    assert length.tolist() == [1, hmm.STRETCH, hmm.STRETCH, 3] and opening.tolist() == [0, 0, 1, 1]
    assert first.tolist() == [0, 1 + hmm.STRETCH, 1 + 2 * hmm.STRETCH, 1 + 3 * hmm.STRETCH]


def counts(rows):
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    seen = Counter(w for i, ws in tokens if not hmm.held_out(i) for w in ws)
    n, v = sum(seen.values()), len(seen)
    return [(i, hmm.held_out(i), len(ws), sum(seen[w] > 0 for w in ws), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens]


def told(df):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()]


def test_counts_and_a_better_model(documents):
    found = hmm.score_texts(documents)
    rows = found.collect()
    assert sorted(told(found)) == sorted(counts([(r.doc_id, r.text) for r in documents.collect()]))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and all(r.score < 0 for r in rows)


def test_likelihood_never_falls_and_words_get_their_sums(documents, monkeypatch):
    monkeypatch.setattr(hmm, "TOP", 64)
    monkeypatch.setattr(hmm, "CLASSES", 64 + hmm.TAILS + 1)
    monkeypatch.setattr(hmm, "END_CLASS", 64 + hmm.TAILS)
    monkeypatch.setattr(hmm, "SUMS", 2 + hmm.STATES + hmm.CLASSES)
    blocks = hmm.blocks_of(documents)
    words = hmm.word_counts(blocks)
    counts = hmm.Counts(words, sum(not hmm.held_out(r.doc_id) for r in documents.collect()))
    texts, tables = hmm.encoded(blocks, words, counts), hmm.Tables(counts.mass)
    path = hmm.learn_classes(texts, tables)
    assert len(path) >= 2 and all(b > a for a, b in zip(path, path[1:])) and path[-1] - path[-2] < hmm.TOLERANCE * abs(path[-1])
    sums = hmm.pass_sums(texts, tables, by_word=True)
    got = {r.key: sum(r[n] for n in hmm.NAMES) for r in sums.where(f"at = {hmm.WORD_SUM}").collect()}
    want = {r.key: r.c for r in words.where(f"first AND c >= {hmm.OWN}").collect() if bytes(r.word) not in counts.top}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.02 * want[k] + 0.05 for k in want) and len(want) > 500
    block = texts.first()
    keys = np.frombuffer(block["keys"], "<i8")
    placed = hmm.placed_sums(texts, sums).where(f"block = {block.block}").collect()
    assert sorted(r.place for r in placed) == list(range(len(block.own) // 4))
    assert all(math.isclose(sum(r[n] for n in hmm.NAMES), got[keys[r.place]], rel_tol=1e-5) for r in placed)


def test_edges(edge, empty, spark):
    key = lambda r: (str(r[0]), r[2])
    assert sorted(told(hmm.score_texts(edge)), key=key) == sorted(counts([(r.doc_id, r.text) for r in edge.collect()]), key=key)
    assert hmm.score_texts(empty).count() == 0
    only = next(i for i in range(100) if hmm.held_out(i))
    alone = hmm.score_texts(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score) == (3, 0, 0, 0.0)


def test_texts_without_words(spark):
    rows = [(1, ""), (2, None), (3, " ")]
    found = hmm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(told(found)) == sorted(counts(rows))


def test_slices_of_a_block_add_up(monkeypatch):
    model, draw = tables(6), np.random.default_rng(1)
    lengths = draw.integers(1, 700, 40)
    stream = draw.integers(0, hmm.CLASSES, lengths.sum()).astype(np.uint16)
    found = hmm.stretches(lengths, draw.random(40) < 0.8)
    whole = hmm.baum_welch(stream, *found, model)
    monkeypatch.setattr(hmm, "SLICE", 1000)
    for a, b in zip(whole, hmm.baum_welch(stream, *found, model)):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-4)
    assert math.isclose(whole[2].sum(), found[1].sum(), rel_tol=1e-5)
    none = hmm.baum_welch(stream, *hmm.stretches(lengths, np.zeros(40, bool)), model)
    assert none[3] == 0 and not none[2].any()
