"""Helpers shared by the training-data operators: staged tables, global order, streamed groups, small pieces of batches."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortframe.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it from there: later work survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by ``written`` that no later plan reads."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def process_state(name: str) -> dict:
    """A dict that lives as long as the worker process, over the tasks it runs.

    Task functions travel by value, so their module's globals start anew with every task; this does not.
    """
    module = sys.modules.setdefault("cohortframe_task_state", types.ModuleType("cohortframe_task_state"))
    return module.__dict__.setdefault(name, {})


def blobs(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds some ``limit`` bytes of ``column`` (a longer row stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(batch[column]).to_pylist()], np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
        for start, end in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            yield batch.slice(start, end - start)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows that come sorted by ``keys``; only the last, open group is carried over."""
    carried: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.Table.from_batches([*carried, batch]).combine_chunks() if carried else pa.Table.from_batches([batch])
        starts = group_starts(both, keys)
        last = int(starts[-1])
        if last:
            yield both.slice(0, last)
        carried = both.slice(last).to_batches()
    if carried:
        yield pa.Table.from_batches(carried).combine_chunks()


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a new key begins in rows sorted by ``keys``."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for key in keys:
        codes = rows[key].combine_chunks().dictionary_encode(null_encoding="encode")
        values = codes.combine_chunks().indices if isinstance(codes, pa.ChunkedArray) else codes.indices
        values = np.asarray(values)
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def ranked(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Number all rows from 0 in a total order without one task seeing them all: column ``rank``.

    Rows are range partitioned and written with their place in their partition; the driver adds up one row count per
    partition. Rows equal in ``order`` are numbered in any order.
    """
    spark = df.sparkSession
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    row = F.monotonically_increasing_id()
    placed = written(
        spread.sortWithinPartitions(*order).select(
            "*", F.shiftright(row, 33).cast("int").alias("_part"), row.bitwiseAND((1 << 33) - 1).alias("_row")
        ),
        name,
    )
    counts = placed.groupBy("_part").agg((F.max("_row") + 1).alias("n")).orderBy("_part").collect()
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    starts = spark.createDataFrame(offsets, "_part int, _start long")
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)
