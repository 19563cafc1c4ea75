"""Sharding by best-fit-decreasing bin packing.

Groups of documents that must stay together (here: equal texts) enter bins of a fixed capacity, largest first, each the
bin with the least room that still holds it. Only a histogram of group sizes meets the packer, not the groups: a run of
equal sizes fills the tightest bin, then the next one, so the packing is a list of stretches of the groups' order, and
Spark gives every group its shard by its rank in that order. Sizes enter the histogram with 16 significant bits, rounded
up, which bounds it at some 32,768 entries for each doubling of size; a shard is over-estimated by at most 2^-15.

Edge cases: a null text is one of no bytes and groups with empty texts; a group beyond the capacity gets a bin of its own;
repeated rows and null doc_ids are rows like others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import ranked, table, written
from cohortframe.llm.registry import query

SHARDS = 40
OVERHEAD = 16
BITS = 16
HOT = 1000  # a group with over 1/HOT of all documents is joined by broadcast: there are fewer than HOT of them


class Rooms:
    """Bins ordered by (room left, number) in a height-balanced tree."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # a node is [key, left, right, height]

    @staticmethod
    def _height(node):
        return node[3] if node else 0

    def _balanced(self, node):
        height = self._height
        lean = height(node[1]) - height(node[2])
        if lean > 1:
            if height(node[1][1]) < height(node[1][2]):
                node[1] = self._turn(node[1], 2)
            return self._turn(node, 1)
        if lean < -1:
            if height(node[2][2]) < height(node[2][1]):
                node[2] = self._turn(node[2], 1)
            return self._turn(node, 2)
        node[3] = 1 + max(height(node[1]), height(node[2]))
        return node

    def _turn(self, node, side):
        """Lift the child at ``side`` over the node."""
        child, other = node[side], 3 - side
        node[side], child[other] = child[other], node
        for x in (node, child):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return child

    def add(self, key):
        def into(node):
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = into(node[side])
            return self._balanced(node)

        self.root = into(self.root)

    def tightest(self, size: int):
        """The least key whose room is ``size`` or more, taken out; None if there is none."""
        node, found = self.root, None
        while node:
            if node[0][0] >= size:
                found, node = node[0], node[1]
            else:
                node = node[2]
        if found is not None:
            self.root = self._without(self.root, found)
        return found

    def _without(self, node, key):
        if key < node[0]:
            node[1] = self._without(node[1], key)
        elif key > node[0]:
            node[2] = self._without(node[2], key)
        elif not node[1] or not node[2]:
            return node[1] or node[2]
        else:
            least = node[2]
            while least[1]:
                least = least[1]
            node[0] = least[0]
            node[2] = self._without(node[2], least[0])
        return self._balanced(node)


def best_fit(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """Pack ``(size, count)`` in falling order of size: stretches ``(count, bin)`` in the order of the groups.

    The count of bins is 1 + the largest bin; a size beyond the capacity takes a new bin alone.
    """
    rooms, bins, out = Rooms(), 0, []
    for size, count in sizes:
        while count:
            if size > capacity:
                out.append((1, bins))
                bins, count = bins + 1, count - 1
                continue
            found = rooms.tightest(size)
            if found is None:
                found = (capacity, bins)
                bins += 1
            room, number = found
            taken = min(count, room // size) if size else count
            out.append((taken, number))
            rooms.add((room - taken * size, number))
            count -= taken
    return out


def into_shards(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """Stretches for at most ``shards`` bins of the least capacity found by bisection.

    Groups above an even share get bins of their own first, and the rest is shared among the other bins.
    """
    alone, rest, left = 0, list(sizes), shards
    total = sum(s * n for s, n in rest)
    while rest and left > 1 and rest[0][0] * left > total:
        size, n = rest[0]
        take = 1
        alone, left, total = alone + take, left - take, total - size
        rest[0] = (size, n - 1)
        if n == 1:
            rest.pop(0)
    head = [(1, k) for k in range(alone)]
    if not rest:
        return head
    low = max(-(-total // left), rest[0][0])
    step, best = 0, None
    while best is None:  # nearly always ends in the first rounds
        packed = best_fit(rest, low + step)
        if max(b for _, b in packed) < left:
            best = packed
        else:
            step = 2 * step + max(1, low >> 20)
    high = low + step
    floor = low + (step - max(1, low >> 20)) // 2 if step else low
    while high - floor > max(1, low >> 17):
        middle = (high + floor) // 2
        packed = best_fit(rest, middle)
        if max(b for _, b in packed) < left:
            best, high = packed, middle
        else:
            floor = middle
    return head + [(n, alone + b) for n, b in best]


def rounded_up(size: Column) -> Column:
    """Size with ``BITS`` significant bits, upwards."""
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - BITS)
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return (F.floor((size + unit - 1) / unit) * unit).cast("long")


def pack_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``groups`` (group, bytes, n_docs) with their shard. The driver sees the histogram of sizes, never a group."""
    order = [F.col("size").desc(), F.col("group")]
    placed = ranked(groups.withColumn("size", rounded_up(F.col("bytes"))), order, "groups")
    histogram = [(r.size, r.n) for r in placed.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()]
    stretches = into_shards(histogram, shards)
    ends = np.cumsum([n for n, _ in stretches])
    bins = np.array([b for _, b in stretches], np.int32)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = bins[np.searchsorted(ends, np.asarray(batch["rank"]), side="right")]
            yield pa.RecordBatch.from_arrays([batch["group"], batch["n_docs"], pa.array(shard, pa.int32())], ["group", "n_docs", "shard"])

    return placed.select("group", "n_docs", "rank").mapInArrow(give, "group binary, n_docs long, shard int")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every document's shard of ``shards``, equal texts together: doc_id, size, text_crc32, group, shard, slot.

    Slots number the documents of a shard from 0 without gaps. Wide texts are read once; what is shuffled is one narrow
    row per document and per group.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = written(
        docs.select(
            "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("group"),
        ),
        "sized",
    )
    groups = narrow.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_docs"))
    packed = written(pack_groups(groups, shards), "packed")
    total = packed.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.col("n_docs") * HOT > F.lit(total)
    few = F.broadcast(packed.where(hot).select("group", "shard"))
    placed = narrow.join(few, "group").unionByName(
        narrow.join(few, "group", "left_anti").join(packed.where(~hot).select("group", "shard"), "group")
    )
    return with_slots(placed, shards)


def with_slots(placed: DataFrame, shards: int) -> DataFrame:
    """Number the rows of each shard: within a task by counting, across tasks by adding up one count per task and shard."""
    fields = placed.schema.simpleString()[len("struct<") : -1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            shard = np.asarray(batch["shard"])
            order = np.argsort(shard, kind="stable")
            here = np.bincount(shard, minlength=shards)
            local = np.empty(len(shard), np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(here) - here, here)
            local += seen[shard]
            seen += here
            names = [*batch.schema.names, "_part", "_local"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(shard), pa.int32()), pa.array(local)], names)

    numbered = written(placed.mapInArrow(count, fields.replace(":", " ").replace(",", ", ") + ", _part int, _local long"), "slots")
    counts = numbered.groupBy("shard", "_part").agg((F.max("_local") + 1).alias("n")).orderBy("shard", "_part").collect()
    starts, at = [], {}
    for shard, part, n in counts:  # one count for each task and shard
        starts.append((shard, part, at.get(shard, 0)))
        at[shard] = at.get(shard, 0) + n
    before = F.broadcast(placed.sparkSession.createDataFrame(starts, "shard int, _part int, _before long"))
    return numbered.join(before, ["shard", "_part"]).withColumn("slot", F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


@query("op1_sharding")
def op1(spark, folder):
    return shard_documents(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
