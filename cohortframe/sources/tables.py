"""Reading and writing cohort tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Parquet scan; the column list and the predicate reach the file reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def cohort_union(tables: dict[str, DataFrame], key: str = "cohort") -> DataFrame:
    """Stack one table per cohort under a key column; columns a cohort lacks become null."""
    tagged = [df.withColumn(key, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def decode_labels(df: DataFrame, column: str, labels: dict[int, str], out: str) -> DataFrame:
    """Attach the text of a value label; codes without a label become null."""
    pairs = [item for code, text in labels.items() for item in (F.lit(code), F.lit(text))]
    return df.withColumn(out, F.create_map(*pairs)[F.col(column)])


def decode_labels_from(df: DataFrame, column: str, dimension: DataFrame, code: str, text: str, out: str) -> DataFrame:
    """The same from a label table; the join method follows that table's size."""
    dim = dimension.select(F.col(code).alias("__code"), F.col(text).alias(out))
    return df.join(dim, F.col(column) == F.col("__code"), "left").drop("__code")


def save_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("cohort",)) -> None:
    """Write one result table, partitioned by cohort so that later reads prune folders."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
