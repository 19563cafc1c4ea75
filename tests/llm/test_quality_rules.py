import math
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cohortframe.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The base statistics by simple loops."""
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    places = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, repeated = len(words), len(places)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated, n < 50 or 100 * repeated > 50 * n


SHOWN = [*rules.BASE, "base_failed"]


def test_statistics_against_loops(spark, documents):
    extra = ["a a a a a", "a b a b a b", "x y z x y z", "x y z q x y z", "# # #\n# # #\n\n \n# # #", "a\x0bb\x0cc\rd", "  é é é é", "b c d b c d b c d", "one", "one two"]
    rows = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(extra)], "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    found = rules.measured(rows, [F.col("doc_id"), F.col("text")]).collect()
    assert len(found) == 210
    for r in found:
        assert tuple(r[c] for c in SHOWN) == plain(r.text), r.doc_id


def test_equal_hashes_are_compared_as_texts(spark, monkeypatch):
    monkeypatch.setattr(rules.F, "hash", lambda *cols: F.lit(7))
    text = "one two three four one two five six one two three"
    r = rules.measured(spark.createDataFrame([(1, text)], "doc_id long, text string"), [F.col("doc_id")]).first()
    assert r.n_repeat_words == plain(text)[4] == 6


def test_binomial_bound_is_exact(spark):
    cases = [(k, n) for n in (1, 2, 40, 460, 5000) for k in {0, 1, n // 200, n // 90} if k < 0.0125 * n]
    for r in spark.createDataFrame(cases, "k long, n long").select("k", "n", rules.at_most(F.col("k"), F.col("n"), 0.0125).alias("chance")).collect():
        p = Fraction(1, 80)
        wanted = float(sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1)))
        assert r.chance == pytest.approx(wanted, rel=1e-10)


STATS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean, label int"


def stat(i, lang, symbols, label, failed=False):
    return (i, lang, 100, 500, symbols, 0, 0, 5, failed, label)


def cutoffs_of(spark, rows):
    return {r._lang: r.cutoffs.asDict() for r in rules.thresholds(spark.createDataFrame(rows, STATS)).collect()}


def test_thresholds_by_hand(spark):
    good = [stat(i, "a", 0, 1) for i in range(1000)]
    bad = [stat(5000 + i, "a", 60, 0) for i in range(50)]
    found = cutoffs_of(spark, good + bad)
    assert found["a"] == {"symbols_per_word": 0.5, "repeated_lines": None, "repeated_words": None, "word_length": None}
    # 30 good ones at 0.45 are too many for the limit of 1.25 %: 0.5 stays, and nothing stricter is tried after the failure
    found = cutoffs_of(spark, good + bad + [stat(9000 + i, "a", 45, 1) for i in range(30)] + [stat(9500 + i, "a", 30, 0) for i in range(400)])
    assert found["a"]["symbols_per_word"] == 0.5
    # few labels certify nothing; a null stratum is one of its own; failures of the base rules are no evidence
    small = [stat(i, None, 0, 1) for i in range(300)] + [stat(400 + i, None, 60, 0) for i in range(9)] + [stat(900 + i, None, 0, 1, True) for i in range(900)]
    found = cutoffs_of(spark, good + bad + small)
    assert found["a"]["symbols_per_word"] == 0.5 and found[None]["symbols_per_word"] is None
    # what rejects label 1 as often as label 0 is not chosen
    even = [stat(i, "a", 60 if i % 251 == 0 else 0, i % 2) for i in range(20_000)]
    assert cutoffs_of(spark, even)["a"]["symbols_per_word"] is None


def test_guarantee_over_repeated_holdouts(spark):
    """Rules that truly reject more good documents than allowed are certified in at most DOUBT of the strata."""
    import random

    draw = random.Random(4)
    rows = []
    for stratum in range(120):
        for i in range(800):
            high = draw.random() < 0.0135  # above the limit of 0.0125
            rows.append(stat(stratum * 10_000 + i, f"s{stratum:03d}", 60 if high else 0, 1))
        rows.append(stat(stratum * 10_000 + 9999, f"s{stratum:03d}", 60, 0))
    labelled = spark.createDataFrame(rows, STATS)
    one = [r.cutoffs.symbols_per_word for r in rules.thresholds(labelled).collect()]
    assert sum(c is not None for c in one) <= 0.05 * 120


def test_holdout_ignores_unclear_labels(spark):
    stats = spark.createDataFrame([stat(i, "a", i, None)[:-1] for i in (1, 2, 3, 3, 4, 5)], STATS.removesuffix(", label int"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (4, None), (None, 1), (5, 7), (99, 1)], "doc_id long, quality int")
    assert sorted((r._id, r.label) for r in rules.holdout(stats, labels).collect()) == [(1, 1), (3, 0)]


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 4, 5, 5, 6, 7, 9, 99)], "doc_id long, quality int")
    found = rules.judged(edge, labels).collect()
    assert len(found) == edge.count()
    texts = {r.doc_id: r.text for r in edge.collect()}
    for r in found:
        assert tuple(r[c] for c in SHOWN) == plain(texts[r.doc_id]) and r.kept == (not r.base_failed)
    kept = rules.accepted(edge, labels)
    assert kept.columns == edge.columns and [r.doc_id for r in kept.collect()] == [4]
    assert rules.judged(empty, labels).collect() == [] and rules.judged(edge, labels.limit(0)).count() == edge.count()


def test_query_keeps_labelled_good_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = rules.judged(docs, labels).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.95 and kept[0] < 0.3
