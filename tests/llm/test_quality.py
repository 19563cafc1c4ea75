import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.llm import quality


def test_statistics_by_hand():
    text = b"Aa bb bb, 12.\nAa bb bb, 12.\n#"
    row = dict(zip(quality.STATISTICS, quality.statistics_of([text, b""])[0]))
    assert row["log_bytes"] == np.log1p(len(text)) and row["log_words"] == np.log1p(9)
    assert row["distinct_words"] == pytest.approx(5 / 9) and row["top_word"] == pytest.approx(2 / 9) and row["repeated_next"] == 0
    assert row["digits"] == pytest.approx(4 / len(text)) and row["symbols"] == 1 / len(text) and row["upper"] == 2 / len(text)
    assert row["distinct_lines"] == 2 / 3 and row["lines"] == pytest.approx(3 / len(text)) and row["sentence_length"] == pytest.approx(9 / 3)
    assert not quality.statistics_of([text, b""])[1].any()


def test_rules_are_the_paths_of_the_trees():
    debug = """Forest
  Tree 0 (weight 1.0):
    If (feature 2 <= 0.5)
     If (feature 1 <= 3.0)
      If (feature 2 <= 0.25)
       Predict: 0.0
      Else (feature 2 > 0.25)
       Predict: 1.0
     Else (feature 1 > 3.0)
      Predict: 1.0
    Else (feature 2 > 0.5)
     Predict: 1.0
"""
    assert quality.tree_rules(debug) == {
        frozenset(x) for x in (
            [(2, "<=", 0.5)], [(2, ">", 0.5)], [(2, "<=", 0.5), (1, "<=", 3.0)], [(2, "<=", 0.5), (1, ">", 3.0)],
            [(2, "<=", 0.25), (1, "<=", 3.0)], [(2, "<=", 0.5), (2, ">", 0.25), (1, "<=", 3.0)],
        )
    }


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    ones, zeros = labels.sum(), (1 - labels).sum()
    return (order[labels == 1].sum() - ones * (ones - 1) / 2) / ones / zeros


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    intercept, rules = model = quality.train(docs, labels)
    measured = quality.with_statistics(docs, ["doc_id"]).select("doc_id", quality.score(model).alias("score"))
    rows = [r for r in measured.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    scores, wanted = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert auc(scores, wanted) > 0.97 and ((scores >= quality.THRESHOLD) == (wanted == 1)).mean() > 0.95
    assert 0 < len(rules) < 200 and all(0 <= s <= 1 for s in scores)


def test_column_expression_is_the_rules_sum(documents):
    model = (0.25, [(frozenset([(1, ">", 3.0)]), 1.5), (frozenset([(1, "<=", 6.0), (9, ">", 0.01)]), -2.0)])
    for r in quality.with_statistics(documents, ["doc_id"]).withColumn("score", quality.score(model)).limit(50).collect():
        total = 0.25 + 1.5 * (r.log_words > 3) - 2 * (r.log_words <= 6 and r[quality.STATISTICS[9]] > 0.01)
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)))


def test_training_ignores_held_out_labels(spark, documents):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2] + [(5, None, 0), (6, 7, 1)], "doc_id long, quality int, toxic int")
    assert quality.train(documents, labels) == (0.0, [])


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 4, 5, 5, 6, 7, 9, 99)], "doc_id long, quality int")
    model = quality.train(edge, labels)
    assert quality.accepted(edge, model).columns == edge.columns
    assert quality.accepted(edge, (9.0, [])).count() == edge.count() and quality.accepted(edge, (-9.0, [])).count() == 0
    scores = {r.doc_id: r.score for r in quality.with_statistics(edge.drop(*quality.STATISTICS), ["doc_id"]).select("doc_id", quality.score(model).alias("score")).collect()}
    assert scores[1] == scores[2] and len(scores) == 10
    assert quality.accepted(empty, model).count() == 0
    assert quality.train(edge, labels.limit(0)) == (0.0, []) and quality.train(empty, labels) == (0.0, [])
    assert edge.select(quality.held_out(F.col("doc_id"), 4, 2)).where("doc_id IS NULL").first()[0] is False
