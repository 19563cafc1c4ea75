import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortframe.llm import collocations as phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=None):
    """{(lang, phrase): (a, l, r, n, score)} by counting every phrase on its own."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        scored = {}
        for p, a in candidates.items():
            if any(100 * b >= 80 * a for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, _, left, right = min((2_000_000 * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            scored[p] = (a, left, right, totals[lang], score)
        best = sorted(scored.items(), key=lambda x: (-x[1][4], -x[1][0], " ".join(x[0]).encode()))[:top]
        out |= {(lang, " ".join(p)): (i + 1, *v) for i, (p, v) in enumerate(best)}
    return out


def mined(docs, least, top=None):
    return {(r.lang, r.phrase): (r["rank"], r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(docs, least, top).collect()}


def pairs(docs):
    return [(r.lang, r.text) for r in docs.collect()]


def test_against_counting_every_phrase(spark, documents):
    assert mined(documents, 12, 300) == brute(pairs(documents), 12, 300)


def test_every_candidate_without_a_limit(spark, documents):
    some = documents.where("lang = 'de'").drop("source")
    wanted = brute(pairs(some), 6)
    assert {k: v[1:] for k, v in mined(some, 6).items()} == {k: v[1:] for k, v in wanted.items()} and wanted


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_full_filters_change_no_count(spark, documents, monkeypatch, bits):
    monkeypatch.setattr(phrases, "FEWEST_BITS", bits)
    monkeypatch.setattr(phrases, "FILTER_BITS", bits)
    some = documents.where("doc_id < 60")
    assert mined(some, 8, 300) == brute(pairs(some), 8, 300)


def test_filters_hold_every_frequent_phrase(spark, documents):
    texts, filters = documents.select("lang", "text"), []
    for size in (2, 3):
        frequent = phrases.frequent(texts, size, filters, 20)
        filters.append(phrases.bit_filter(frequent))
        hashed = np.array([r.phrase for r in frequent.collect()], np.int64)
        assert len(hashed) == len({p for p in every(documents, 20) if len(p[1]) == size}) and phrases.passes(filters[-1], hashed).all()
        assert phrases.passes(filters[-1], np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)).mean() < 0.05


def every(docs, least):
    counts = Counter()
    for lang, text in pairs(docs):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            counts.update(("und" if lang is None else lang, tuple(words[i : i + k])) for k in (2, 3) for i in range(len(words) - k + 1))
    return {p for p, n in counts.items() if n >= least}


@pytest.mark.parametrize("chunk", [1, 2, 3, 4, 9, 64])
def test_runs_see_the_words_after_them(monkeypatch, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rows = [("x", " ".join(f"w{i % 13}{'.' if i % 7 == 0 else ''}" for i in range(40))), ("x", "a b"), ("y", "a B c"), ("y", None), (None, " \t")]
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})
    found, wanted = Counter(), Counter()
    for lang, words, codes, linked, heads in phrases.by_language(iter([batch])):
        grown, _ = phrases.grow(codes, linked, phrases.word_hashes(words, lang), [], 4)
        columns, counts = phrases.unique_windows(phrases.lead_columns(codes, grown, heads))
        names = [None, *(w.decode() for w in words.to_pylist())]
        for *window, n in zip(*columns, counts.tolist()):
            found[(lang, *(names[c] for c in window))] += n
    for lang, text in rows:
        for piece in re.split(r"[.]", (text or "").translate(LOWER)):
            words = piece.split()
            for i in range(len(words)):
                wanted[(lang, *(words[i : i + 4] + [None] * 3)[:4])] += 1
    assert found == wanted


def test_long_texts_are_cut_into_runs(spark, documents, monkeypatch):
    """The task functions carry the module's values, so a small CHUNK holds in them as well."""
    some = documents.where("doc_id < 60").select("lang", "text")
    wanted = brute(pairs(some), 5)
    monkeypatch.setattr(phrases, "CHUNK", 50)
    assert {k: v[1:] for k, v in mined(some, 5).items()} == {k: v[1:] for k, v in wanted.items()}


def test_rules_by_hand(spark):
    texts = ["New York City, new york city. NEW YORK CITY"] * 10 + ["new york\tstate\nof new. york"] * 10 + ["É É é"] * 31
    rows = [("en", t) for t in texts] + [(None, "a b a b"), ("und", "a b")] * 11
    docs = spark.createDataFrame(rows, "lang string, text string")
    wanted = brute(rows, 30)
    assert {k: v[1:] for k, v in mined(docs, 30).items()} == {k: v[1:] for k, v in wanted.items()}
    assert ("en", "new york") in wanted and ("en", "york city") not in wanted and ("en", "new york city") in wanted
    assert ("en", "york of") not in wanted and wanted["und", "a b"][1] == 33


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 5 * 10**12
    found = spark.createDataFrame([("x", ["a", "b"], big), ("x", ["a"], big + 1), ("x", ["b"], big + 7)], "lang string, words array<string>, f long")
    monkeypatch.setattr(phrases, "phrases", lambda docs, least: (found, spark.createDataFrame([("x", 2 * big)], "lang string, n long")))
    r = phrases.collocations(None).first()
    assert (r.score, r.a, r.l, r.r, r.n) == (2_000_000 * big // (2 * big + 8), big, big + 1, big + 7, 2 * big)


def test_edges(spark, edge, empty):
    small = edge.where("doc_id IS NULL OR doc_id <> 4")
    assert {k: v[1:] for k, v in mined(small, 1).items()} == {k: v[1:] for k, v in brute(pairs(small), 1).items()}
    assert mined(empty, 1) == {} and phrases.collocations(edge).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert mined(edge.select("lang", F.lit(None).cast("string").alias("text")), 1) == {}
