"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on a bounded sample of labelled documents, every path from a root is a conjunctive rule over the
statistics, a lasso logistic regression keeps few of the rules, and the kept ones become one Spark column expression.

Only the fit is on a sample: the ``SAMPLE`` labelled documents of the smallest hash of their id (all, if fewer). Scores
cover every document and see its text's statistics alone.

Edge cases: a null text counts as empty; an empty text has statistics of 0 and gets the score they lead to; documents
labelled more than once, or with a label other than 0 or 1, teach nothing for the labels that are missing; without any
label of both kinds the score is the share of label 1 (0.5 without labels); repeated rows are scored alike; an empty
table gives no rows; further columns of the input stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cohortframe.llm.common import blobs, pieces, table, written
from cohortframe.llm.registry import query

SAMPLE = 20_000
TREES, DEPTH, PENALTY, SEED = 30, 3, 0.001, 7
THRESHOLD = 0.7

STATISTICS = (
    "log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "top_word", "repeated_next", "letters", "upper",
    "digits", "marks", "symbols", "white", "lines", "distinct_lines", "sentence_length",
)

# Classes of byte values (fixed values).
MARKS = b".,;:!?'\"()-"
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"


def _classes() -> np.ndarray:
    """A row per byte value, a column per class: letters, upper, digits, marks, symbols, white, sentence ends."""
    out = np.zeros((256, 7))
    for k, values in enumerate((
        [*range(65, 91), *range(97, 123), *range(192, 256)], range(65, 91), range(48, 58), MARKS, SYMBOLS, [32, *range(9, 14)], b".!?",
    )):
        out[list(values), k] = 1
    return out


def statistics_of(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS per text."""
    counts = np.zeros((len(texts), 256))
    out = np.zeros((len(texts), len(STATISTICS)))
    for i, text in enumerate(texts):
        if not text:
            continue
        counts[i] = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words, lines = text.split(), text.split(b"\n")
        n = len(words)
        if n:
            seen = Counter(words)
            out[i, 1:7] = (
                np.log1p(n), sum(map(len, words)) / n, np.log1p(max(map(len, words))), len(seen) / n, max(seen.values()) / n,
                sum(a == b for a, b in zip(words, words[1:])) / n,
            )
        out[i, 13:15] = len(lines) / len(text), len(set(lines)) / len(lines)
    size = counts.sum(1)
    classes = counts @ _classes()
    out[:, 0] = np.log1p(size)
    out[:, 7:13] = classes[:, :6] / np.maximum(size, 1)[:, None]
    out[:, 15] = np.expm1(out[:, 1]) / (1 + classes[:, 6])
    return out


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the statistics of the whole text."""
    kept = docs.select(*keep, F.col("text").alias("_text"))
    fields = [f for f in kept.schema.fields if f.name != "_text"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            values = statistics_of(blobs(batch["_text"]))
            columns = [pa.array(values[:, k]) for k in range(values.shape[1])]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), *columns], [*keep, *STATISTICS])

    return kept.mapInArrow(measure, StructType([*fields, *(StructField(x, DoubleType()) for x in STATISTICS)]))


def tree_rules(debug: str) -> set[frozenset[tuple[int, str, float]]]:
    """Every path of every tree, as conditions (statistic, <= or >, bound)."""
    rules, path = set(), []
    line = re.compile(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)")
    for text in debug.splitlines():
        if text.lstrip().startswith("Tree "):
            path = []
        elif found := line.match(text):
            depth = len(found[1])
            path = [x for x in path if x[0] < depth]
            path.append((depth, (int(found[2]), found[3], float(found[4]))))
            bounds: dict[tuple[int, str], float] = {}
            for _, (k, side, bound) in path:
                join = min if side == "<=" else max
                bounds[k, side] = join(bound, bounds.get((k, side), bound))
            rules.add(frozenset((k, side, bound) for (k, side), bound in bounds.items()))
    return rules


def condition(rule: frozenset) -> Column:
    out = None
    for k, side, bound in sorted(rule):
        name = F.col(STATISTICS[k])
        part = name <= F.lit(bound) if side == "<=" else name > F.lit(bound)
        out = part if out is None else out & part
    return out


def fit(labelled: DataFrame) -> tuple[float, list[tuple[frozenset, float]]]:
    """Intercept and weighted rules from rows with STATISTICS and ``label`` (0 or 1)."""
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    if not ones or not zeros:
        share = (ones + 0.5) / (ones + zeros + 1)
        return float(np.log(share / (1 - share))), []
    rows = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(labelled.withColumn("label", F.col("label").cast("double")))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=5)
    rules = sorted(tree_rules(forest.fit(rows).toDebugString), key=lambda r: (len(r), sorted(r)))
    if not rules:  # labels too few for a single split
        return float(np.log(ones / zeros)), []
    hits = F.array(*[condition(r).cast("double") for r in rules])
    design = written(rows.select("label", hits.alias("hits")), "rules").select("label", array_to_vector("hits").alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=True).fit(design)
    return float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w]


def score(model: tuple[float, list[tuple[frozenset, float]]]) -> Column:
    """The model as a column expression over STATISTICS."""
    intercept, rules = model
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.when(condition(rule), F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Fit on labelled documents that are not held out (crc32 of the id mod 4 other than 2)."""
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & ~held_out(F.col("_id"), 4, 2)
    )
    chosen = usable.orderBy(F.xxhash64("_id"), "_id", "label").limit(sample)
    texts = documents.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id")  # at most ``sample`` rows
    return fit(written(with_statistics(texts, ["label"]), "labelled"))


def accepted(docs: DataFrame, model) -> DataFrame:
    """The documents that the model predicts to be of label 1, with all their columns."""
    whole = docs.select(F.struct("*").alias("row"), "text")
    return with_statistics(whole, ["row"]).where(score(model) >= THRESHOLD).select("row.*")


@query("op10_quality")
def op10(spark, folder):
    docs = table(spark, folder, "documents")
    model = train(docs, table(spark, folder, "labels"))
    narrow = docs.select("doc_id", "text")
    measured = with_statistics(narrow, ["doc_id"])
    return measured.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), score(model).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
