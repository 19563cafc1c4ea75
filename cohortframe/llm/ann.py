"""Nearest neighbours by inner product with an adaptive scan over dimensions.

Vectors get one more component, which makes the largest inner product the least Euclidean distance, and are turned by a
random rotation, so that the first dimensions of a difference estimate the whole of it. They lie in lists around
centroids (fitted on a bounded sample; every vector is indexed). A query probes the share
``PROBED`` of the lists that is nearest to it (data without clusters, as in the tests, need a large share for a recall
of 0.9; clustered data much less). Within a list,
components lie in column blocks; after each block a hypothesis test on the partial distance abandons the candidates that
are too far with high confidence, and only what survives all blocks is measured exactly, in double precision on the
original vectors. The nearest list is scanned first and gives the bound that the others start with.

Equal vectors are searched for once: of a group of equal vectors only the ``k + 1`` smallest ids can be among anyone's
``k`` nearest, and equal queries have equal neighbours apart from themselves. Lists are cut into chunks of ``CHUNK``
vectors, so a crowded list is many tasks' work.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id; the
dimension is that of most vectors, and vectors of another one take no part; with fewer candidates than ``k`` all are
returned; rows that repeat an id count once per distinct vector; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortframe.llm.common import group_starts, runs, table, written
from cohortframe.llm.registry import query

K, PROBED, SAMPLE, ROUNDS = 20, 0.9, 20_000, 8
LISTS = 1024  # at most; a quarter of the square root of the count of distinct vectors, if less
CHUNK, COLUMNS, CONFIDENCE, SEED = 4096, 16, 2.5, 13


def usable(df: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, of the rows that take part."""
    wide = df.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return wide.where(finite & F.exists("v", lambda x: x != 0))


def rotation(n: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(n, n)))
    return q * np.sign(np.diag(r))


class Index:
    """Rotation, longest length and centroids: what a task needs to place vectors."""

    def __init__(self, sample: np.ndarray, longest: float, lists: int):
        self.longest = longest * (1 + 1e-9)
        self.turn = rotation(sample.shape[1] + 1)
        points = self.rotated(sample)
        draw = np.random.default_rng(SEED)
        centers = points[draw.choice(len(points), min(lists, len(points)), replace=False)]
        for _ in range(ROUNDS):
            near = nearest(points, centers, 1)[:, 0]
            counts = np.bincount(near, minlength=len(centers))
            sums = np.zeros_like(centers)
            np.add.at(sums, near, points)
            centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        self.centers = centers

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        """Candidates with the component that levels their lengths, rotated."""
        scaled = vectors / self.longest
        rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))
        return np.column_stack([scaled, rest]) @ self.turn

    def rotated_query(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.column_stack([unit, np.zeros(len(unit))]) @ self.turn


def nearest(points: np.ndarray, centers: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centers of each point, nearest first, in blocks of points."""
    out = []
    for at in range(0, len(points), 4096):
        far = (centers**2).sum(1) - 2 * points[at : at + 4096] @ centers.T
        k = min(k, far.shape[1])
        some = np.argpartition(far, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return np.asarray(flat.flatten()).reshape(n, -1) if n else np.zeros((0, 1))


def scan(query_: np.ndarray, columns: np.ndarray, bound: float, k: int) -> np.ndarray:
    """Rows of a chunk that may be among the k nearest of a rotated query.

    ``columns`` is the chunk with its dimensions in rows (column blocks lie together). ``bound`` is a squared distance
    that k candidates are known to keep; without one, the first rows are measured whole to get it.
    """
    n_dims, n = columns.shape
    if not np.isfinite(bound) and n > 4 * k:
        head = ((columns[:, : 4 * k] - query_[:, None]) ** 2).sum(0)
        bound = np.partition(head, k - 1)[k - 1]
    alive, far = np.arange(n), np.zeros(n)
    for start in range(0, n_dims, COLUMNS):
        end = min(start + COLUMNS, n_dims)
        part = columns[start:end] if len(alive) == n else columns[start:end, alive]
        far = far + ((part - query_[start:end, None]) ** 2).sum(0)
        if end < n_dims:
            limit = bound * (1 + CONFIDENCE / np.sqrt(end)) ** 2 * end / n_dims
        else:
            limit = bound * (1 + 1e-9)
        stay = far <= limit
        if not stay.all():
            alive, far = alive[stay], far[stay]
            if not len(alive):
                break
    if len(alive) > k:
        kth = np.partition(far, k - 1)[k - 1]
        alive = alive[far <= kth * (1 + 1e-9) + 1e-12]
    return alive


def probe(queries: DataFrame, vectors: DataFrame, index: Index, k: int) -> DataFrame:
    """Found candidates of every (query, list) pair: qid, cid, score. ``queries`` has qid, q, list, bound; ``vectors`` has
    cid, v, list, chunk."""
    chunks = vectors.select("list", "chunk").distinct()
    left = queries.join(chunks, "list").select("list", "chunk", F.lit(0).alias("side"), F.col("qid").alias("id"), F.col("q").alias("x"), "bound")
    right = vectors.select("list", "chunk", F.lit(1).alias("side"), F.col("cid").alias("id"), F.col("v").alias("x"), F.lit(None).cast("double").alias("bound"))
    both = left.unionByName(right).repartition("list", "chunk").sortWithinPartitions("list", "chunk", F.desc("side"), "id")
    model = vars(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.__new__(Index)
        index.__dict__ = model
        held, ids, columns = None, None, None
        for rows in runs(batches, ["list", "chunk", "side"]):
            starts = [*group_starts(rows, ["list", "chunk", "side"]).tolist(), rows.num_rows]
            for a, b in zip(starts, starts[1:]):
                part = rows.slice(a, b - a)
                place = (part["list"][0].as_py(), part["chunk"][0].as_py())
                x = matrix(part["x"])
                if part["side"][0].as_py() == 1:
                    held, ids, originals = place, np.asarray(part["id"].combine_chunks()), x
                    columns = np.ascontiguousarray(index.rotated(x).T)
                elif place == held:
                    turned = index.rotated_query(x)
                    bounds = part["bound"].to_numpy()
                    found = []
                    for i, name in enumerate(np.asarray(part["id"].combine_chunks()).tolist()):
                        bound = np.inf if bounds[i] is None or np.isnan(bounds[i]) else bounds[i]
                        at = scan(turned[i], columns, bound, k)
                        if len(at):
                            found.append((np.full(len(at), name), ids[at], (originals[at] * x[i]).sum(1)))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["qid", "cid", "score"])

    return both.mapInArrow(search, "qid long, cid long, score double")


def best(found: DataFrame, k: int, by: str, order: list[Column]) -> DataFrame:
    """The first k rows of each query. A query has at most k rows and ties from each of its chunks."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def search(candidates: DataFrame, queries: DataFrame, k: int = K, probed: float = PROBED) -> DataFrame:
    """query_id, rank, vec_id, score for every usable row of ``queries`` among those of ``candidates``."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = candidates.sparkSession
    rows = usable(candidates)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    n = sizes["n"]
    key = F.unhex(F.sha2(F.to_binary(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))), F.lit("utf-8")), 256))
    rows = written(rows.where(F.size("v") == n).select("vec_id", "v", key.alias("key")), "vectors")
    # the smallest ids of equal vectors: first within salts, so that a crowded vector is not one task's
    salted = Window.partitionBy("key", "salt").orderBy("vec_id")
    few = (
        rows.select("key", "vec_id").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
        .withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    )
    smallest = best(few.drop("r"), k + 1, "key", [F.col("vec_id")])
    members = written(smallest.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "members")
    single = rows.groupBy("key").agg(F.first("v").alias("v"))
    distinct = written(
        single.join(members, "key").select("key", "v", F.element_at("ids", 1).alias("cid"), F.xxhash64("key").alias("h")), "distinct"
    )
    total = distinct.count()
    longest = distinct.select(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] ** 0.5
    sample = distinct.orderBy("h", "cid").limit(SAMPLE).select("v").toArrow()
    index = Index(matrix(sample["v"]), longest, max(1, min(LISTS, int(total**0.5 / 4))))
    probes = math.ceil(probed * len(index.centers))
    model = vars(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.__new__(Index)
        index.__dict__ = model
        for batch in batches:
            if batch.num_rows:
                near = nearest(index.rotated(matrix(batch["v"])), index.centers, 1)[:, 0]
                yield batch.append_column("list", pa.array(near, pa.int32()))

    placed = written(distinct.select("cid", "v").mapInArrow(place, "cid long, v array<double>, list int"), "placed")
    chunks = F.broadcast(placed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("n")))  # LISTS rows at most
    vectors = placed.join(chunks, "list").select("cid", "v", "list", F.pmod(F.xxhash64("cid"), F.col("n")).cast("int").alias("chunk"))

    asked = usable(queries).where(F.size("v") == n).select("vec_id", "v", key.alias("key"))
    once = asked.groupBy("key").agg(F.first("v").alias("q"), F.min("vec_id").alias("qid"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.__new__(Index)
        index.__dict__ = model
        for batch in batches:
            if batch.num_rows:
                near = nearest(index.rotated_query(matrix(batch["q"])), index.centers, probes)
                yield batch.append_column("lists", pa.array(near.tolist(), pa.list_(pa.int32())))

    probing = written(once.select("key", "qid", "q").mapInArrow(choose, "key binary, qid long, q array<double>, lists array<int>"), "probing")
    nothing = F.lit(None).cast("double")
    home = written(probe(probing.select("qid", "q", F.element_at("lists", 1).alias("list"), nothing.alias("bound")), vectors, index, k + 1), "home")
    # the squared distance of a unit query at an inner product s: 2 - 2 s / (|q| longest)
    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x))
    kth = best(home, k + 1, "qid", [F.desc("score"), F.col("cid")]).where(F.col("rank") == k + 1).select("qid", F.col("score").alias("kth"))
    bounded = probing.join(kth, "qid", "left").withColumn("bound", F.lit(2.0) - 2 * F.col("kth") / (length * F.lit(index.longest)))
    others = bounded.select("qid", "q", F.explode(F.slice("lists", 2, probes)).alias("list"), "bound")
    found = home.unionByName(probe(others, vectors, index, k + 1))
    found = best(found, k + 1, "qid", [F.desc("score"), F.col("cid")]).select("qid", "cid", "score")
    # back to ids: equal candidates, then equal queries
    ids = members.select(F.element_at("ids", 1).alias("cid"), "ids")
    expanded = found.join(ids, "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    answers = best(expanded, k + 1, "qid", [F.desc("score"), F.col("vec_id")]).groupBy("qid").agg(
        F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("found")
    )  # k + 1 at most
    mine = asked.join(probing.select("key", "qid"), "key").select(F.col("vec_id").alias("query_id"), "qid").distinct().join(answers, "qid")
    kept = F.slice(F.array_sort(F.filter("found", lambda f: f["vec_id"] != F.col("query_id"))), 1, k)
    return mine.select("query_id", F.posexplode(kept).alias("at", "f")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.s")).alias("score")
    )


@query("op3_ann")
def op3(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
