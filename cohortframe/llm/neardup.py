"""MinHash near-duplicates with tensored banding.

A text is the set of its word shingles. Two small collections of ``SIDE`` bands, each of ``BAND`` minhashes, are computed;
every pair of a band of the first and a band of the second is a table key, so ``2 * SIDE * BAND`` minhashes serve
``SIDE ** 2`` tables of ``2 * BAND`` hashes. At a similarity of 0.8 a pair misses all tables with probability 3.6e-4.

Documents meet by the first half of their keys; there the second half is compared, together with the share of equal
minhashes (at least ``ALIKE``; a pair at 0.8 falls below it once in 10^9). What meets becomes candidate clusters, and
within a cluster links are confirmed on the full sets. Texts with equal sets are one node throughout.

Nothing grows with the square of a group where its links already join it: within a group every member outside the
component of a pivot is held against all others, and members of that component are not held against each other. Groups
beyond a task's size are cut into chunks and every pair of chunks becomes one cell of work, so no link is lost.

Edge cases: null and empty texts, and texts without words, have an empty set and stay alone; a text of fewer words than
a shingle is one shingle; rows with a null doc_id are not linked, stay and have no component; rows that repeat a doc_id
with other text are nodes of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import blobs, dropped, group_starts, pieces, process_state, runs, table, written
from cohortframe.llm.registry import query

SIDE, BAND, ALIKE, SEED = 12, 3, 0.5, 17
HASHES = 2 * SIDE * BAND
PERCENT = 80
CELL_ROWS = 4096  # signatures in a chunk
CELL_SHINGLES = 1 << 21  # shingles in a chunk
MEMO_WORDS = 100_000
PIVOTS = 6


class Hashes(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashes() -> Hashes:
    state = process_state("shingle_hashes")
    if "memo" not in state or len(state["memo"]) > MEMO_WORDS:
        state["memo"] = Hashes()
    return state["memo"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, size: int, memo: Hashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    codes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    return np.unique(out)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    a, b = draw.integers(0, 1 << 63, (2, HASHES), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """Minhashes (sets x HASHES) of sets that are not empty."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    flat = np.concatenate(sets)
    a, b = _functions()
    out = np.empty((len(sets), HASHES), np.uint64)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((flat ^ b[k]) * a[k], starts)
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (8 bytes of the set's digest), sig (a byte of every minhash), keys (of the first
    collection's bands). The last three are null for empty sets and missing ids."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            memo = hashes()
            sets = [shingles(x, size, memo) for x in blobs(batch["text"])]
            ids = batch["doc_id"].to_pylist()
            used = [i for i, s in enumerate(sets) if len(s) and ids[i] is not None]
            node, sig, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if used:
                low = minhashes([sets[i] for i in used])
                bytes_ = ((low >> np.uint64(24)) & np.uint64(255)).astype(np.uint8)
                bands = np.tile(np.arange(SIDE, dtype=np.uint64), (len(used), 1))
                for k in range(BAND):
                    bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + low[:, k : SIDE * BAND : BAND])
                for row, i in enumerate(used):
                    node[i] = int.from_bytes(hashlib.blake2b(sets[i].tobytes(), digest_size=8).digest(), "little", signed=True)
                    sig[i], keys[i] = bytes_[row].tobytes(), bands[row].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), batch["text_hash"], pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "node", "sig", "keys"],
            )

    schema = "doc_id long, text_hash long, n_shingles long, node long, sig binary, keys array<long>"
    return written(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sign, schema), "signatures")


def joined_rows(n: int, linked: Callable[[int], np.ndarray]) -> np.ndarray:
    """Component (its least row) of each of n rows, where ``linked(i)`` marks the rows linked to row i.

    Once the pivots are done, rows in the component of the most joined pivot are passed over: of any two rows of which
    one lies outside of it, that one is held against all.
    """
    label = np.arange(n)

    def take(i: int) -> None:
        met = np.unique(label[linked(i)])
        met = np.union1d(met, label[i])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]

    pivots = np.unique(np.linspace(0, n - 1, min(n, PIVOTS)).astype(int)).tolist()
    for i in pivots:
        take(i)
    main = max(pivots, key=lambda p: int((label == label[p]).sum()))
    for i in range(n):
        if i not in pivots and label[i] != label[main]:
            take(i)
    return label


def cells(rows: DataFrame, by: str, size, limit: int) -> DataFrame:
    """``rows`` with columns one, two: groups of ``by`` beyond ``limit`` (sum of ``size``) are cut into chunks by node, and
    a row goes to every pair of chunks that has its own. Other groups are the single cell 0, 0."""
    large = written(
        rows.groupBy(by).agg(F.sum(size).alias("_n")).where(F.col("_n") > limit).select(F.col(by).alias("_key"), F.ceil(F.col("_n") / limit).cast("int").alias("_m")),
        "large",
    )
    one = rows.join(large, rows[by] == large["_key"], "left")
    m = F.coalesce("_m", F.lit(1))
    chunk = F.pmod(F.xxhash64("node"), m).cast("int")
    spread = one.withColumn("_c", chunk).withColumn("_o", F.explode(F.sequence(F.lit(0), m - 1)))
    return spread.withColumns({"one": F.least("_c", "_o"), "two": F.greatest("_c", "_o")}).drop("_key", "_m", "_c", "_o")


def edges_in(rows: DataFrame, by: str, linker: Callable[[pa.Table], Callable[[int], np.ndarray]], columns: list[str]) -> DataFrame:
    """Edges (a, b) that join the rows of each cell which are linked: every node with the least row of its component."""
    dealt = rows.select(by, "one", "two", "node", *columns).repartition(by, "one", "two").sortWithinPartitions(by, "one", "two", "node")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, [by, "one", "two"]):
            starts = group_starts(part, [by, "one", "two"])
            ends = np.append(starts[1:], part.num_rows)
            nodes = np.asarray(part["node"].combine_chunks())
            a, b = [], []
            for start, end in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                label = joined_rows(end - start, linker(part.slice(start, end - start)))
                other = np.flatnonzero(label != np.arange(end - start))
                a.append(nodes[start + other])
                b.append(nodes[start + label[other]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return dealt.mapInArrow(find, "a long, b long")


def alike(part: pa.Table) -> Callable[[int], np.ndarray]:
    """Signatures that share a band of the second collection (the first is the group's) and enough minhashes."""
    sig = np.frombuffer(b"".join(part["sig"].to_pylist()), np.uint8).reshape(part.num_rows, HASHES)
    half = SIDE * BAND

    def linked(i: int) -> np.ndarray:
        same = sig == sig[i]
        banded = same[:, half:].reshape(len(sig), SIDE, BAND).all(2).any(1)
        return banded & (same.sum(1) >= ALIKE * HASHES)

    return linked


def near(part: pa.Table) -> Callable[[int], np.ndarray]:
    """Sets with 100 * intersection >= PERCENT * union."""
    sets = [np.frombuffer(x, np.uint64) for x in part["shingles"].to_pylist()]
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    known, local = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(known), np.int32)

    def linked(i: int) -> np.ndarray:
        mine = local[starts[i] : starts[i] + sizes[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[local], starts)
        mark[mine] = 0
        return 100 * both >= PERCENT * (sizes + sizes[i] - both)

    return linked


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for all nodes of ``edges`` (a, b), by alternating star contraction.

    Every round points the neighbours of a node to the least one of them; rounds go on until nothing changes, their count
    grows with the logarithm of the longest chain. Minima are aggregated before they are shuffled.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        check = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if tuple(check) == state or not check[0]:
            break
        state = tuple(check)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("c")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a != b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        small = large.join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).where("a != b")
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        after = written(small, "small-star")
        for used in (now, large):
            dropped(used)
        now = after
    found = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def decided(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (the least doc_id reachable over links), kept (whether the row is its
    component's least by doc_id and hash of its text), for every row."""
    signed = signatures(docs, size)
    nodes = written(
        signed.where("node IS NOT NULL").groupBy("node")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
        .select("node", "least.doc_id", "least", "n", "sig", "keys"), "nodes"
    )
    banded = nodes.select("node", "sig", F.explode("keys").alias("key"))
    candidates = edges_in(cells(banded, "key", F.lit(1), CELL_ROWS), "key", alike, ["sig"])
    clusters = components(candidates).withColumnRenamed("component", "cluster")
    members = written(clusters.join(nodes.select("node", "doc_id", "n"), "node"), "members")

    # full sets of the clusters' nodes; a node that several rows share is computed from each and kept once
    sought = members.select(F.col("doc_id").alias("_id"), "node", "cluster", "n")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            memo = hashes()
            sets = [shingles(x, size, memo).tobytes() for x in blobs(batch["text"])]
            names = [int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) for s in sets]
            keep = np.flatnonzero(np.array(names) == np.asarray(batch["node"]))
            yield pa.RecordBatch.from_arrays(
                [batch["cluster"].take(pa.array(keep)), batch["node"].take(pa.array(keep)), batch["n"].take(pa.array(keep)),
                 pa.array([sets[i] for i in keep], pa.binary())], ["cluster", "node", "n", "shingles"],
            )

    # joined by shuffle at every size: the list of clustered documents grows with the corpus
    texts = docs.select("doc_id", "text").join(sought.hint("merge"), F.col("doc_id") == F.col("_id")).select("text", "cluster", "node", "n")
    limits = cells(members.select("cluster", "node", "n"), "cluster", F.col("n"), CELL_SHINGLES).select("node", "one", "two")
    sets = texts.mapInArrow(full, "cluster long, node long, n long, shingles binary")
    large = limits.where("one != 0 OR two != 0").select(F.col("node").alias("_node")).distinct()
    sets = written(sets, "sets")
    usual = sets.join(large, F.col("node") == F.col("_node"), "left_anti").withColumns({"one": F.lit(0), "two": F.lit(0)})
    split = sets.join(limits.join(large, F.col("node") == F.col("_node"), "left_semi").withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).drop("_node")
    links = edges_in(usual.unionByName(split), "cluster", near, ["shingles"])
    found = written(components(links), "components")
    named = found.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("_linked"))
    linked = found.join(named, "component").select("node", "_linked")
    own = nodes.select("node", F.col("least").alias("_own")).join(linked, "node", "left").select(
        F.col("node").alias("_node"), F.coalesce("_linked", "_own").alias("_least")
    )
    out = signed.select("doc_id", "text_hash", "n_shingles", "node").join(own, F.col("node") == F.col("_node"), "left")
    least = F.coalesce("_least", F.struct("doc_id", "text_hash"))
    return out.select(
        "doc_id", "text_hash", "n_shingles", least["doc_id"].alias("component_id"),
        least["doc_id"].eqNullSafe(F.col("doc_id")).alias("kept"),
        (least["doc_id"].eqNullSafe(F.col("doc_id")) & (least["text_hash"] == F.col("text_hash"))).alias("stands"),
    )


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links), kept (whether that is the row's own id).

    Rows of different texts that share the least doc_id of their group are all kept here; ``deduplicated`` leaves one of them.
    """
    return decided(docs, size).drop("text_hash", "stands")


def deduplicated(docs: DataFrame, size: int = 5) -> DataFrame:
    """One row of every group of near-duplicates, the one of the least doc_id and hash of its text, with all its columns.

    Rows that repeat a document with its text are one; other texts under its doc_id are judged on their own. Rows with a
    null doc_id stay, once per text.
    """
    gone = decided(docs, size).where(~F.col("stands")).select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    gone = written(gone, "gone")  # of known size, so Spark can choose how to join it
    whole = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.struct("*").alias("row"))
    left = whole.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("_text") == F.col("_hash")), "left_anti")
    return left.dropDuplicates(["doc_id", "_text"]).select("row.*")


@query("op8_near_duplicates")
def op8(spark, folder):
    return near_duplicates(table(spark, folder, "documents"), size=2)
