"""A training corpus from raw documents: reject junk, drop near-duplicates, remove benchmark leaks, mix, write token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept; ``run`` writes each stage's rows as
Parquet in the shared folder and reads them for the next. All stages but the last return the columns of ``documents``.

Edge cases: null, empty and very long texts are scored by their statistics like any other and go on where accepted; they
are never cut. Rows with a null doc_id are not linked and stay, once per text; rows that repeat a doc_id and its text
count once; a null source is mixed as a source of its own; equal rows draw by their number too. Further columns stay up to the last
stage, whatever their names. An empty table gives no rows at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortframe.llm import decontaminate, mixing, neardup, quality, token_output
from cohortframe.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among the stage's input."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five-word shingles and a similarity of 0.8."""
    return neardup.deduplicated(docs, size=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of the mix; a row per document in the files."""
    return token_output.read_ids(token_output.write_ids(docs, token_output.default_tokenizer()))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token ids", token_stage),
]

# trees, signatures and a tokenizer have no SQL form; tests hold the pipeline against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
