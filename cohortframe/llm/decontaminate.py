"""Benchmark decontamination through a random-walk embedding of edit distance.

Texts are word sequences (A-Z lower-cased, ASCII punctuation removed). The CGK walk copies the word under a pointer at
every step and moves the pointer on by a random bit of (step, word): two sequences that differ by few edits fall into step
again, so their copies agree in most places, and edit distance becomes Hamming distance. Locality-sensitive keys sample
places of the copy. Every position of every document starts a window of an item's size; a window that shares a key with a
piece of an item is a candidate, and the item is then aligned to the document there by exact edit distance over words.

An item is found where it can be turned into a stretch of the document by at most ``MAX_EDITS`` of its words in edits.
Tables, samples per key and repetitions of the walk set the recall (tests measure it against brute force). Benchmarks of
any size are processed in blocks of items, each held against all documents.

Edge cases: null and empty texts hold nothing; null or empty items match nothing; items of a few words need an exact
match; repeated items are reported each; repeated rows are reported each; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import blobs, pieces, process_state, table
from cohortframe.llm.registry import query

MAX_EDITS = 0.2
SIZES = (8, 12, 24)  # words of a window; an item is cut into windows of the largest size it holds
SAMPLES, TABLES, WALKS = 6, 16, 2
BLOCK_ITEMS = 5_000
MEMO_WORDS = 100_000
SEED = 11
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PIECE = 1_000_000


class Hashes(dict):
    """64-bit hashes of words, each computed once; 0 is kept for the end of a text."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word) | 1
        return value


def hashes() -> Hashes:
    state = process_state("word_hashes")
    if len(state.get("memo", ())) > MEMO_WORDS or "memo" not in state:
        state["memo"] = Hashes()
    return state["memo"]


def word_hashes(text: bytes, memo: Hashes) -> np.ndarray:
    words = text.lower().translate(None, PUNCTUATION).split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def plan(size: int, walk: int) -> list[list[int]]:
    """The sampled steps of each table, in rising order, for windows of ``size`` words (a walk takes some 2 * size steps)."""
    draw = np.random.default_rng([SEED, size, walk])
    steps = max(1, 2 * size - 1)
    return [sorted(draw.choice(steps, min(SAMPLES, steps), replace=False).tolist()) for _ in range(TABLES)]


def embed(stream: np.ndarray, steps: int, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """The walks from every position: per step the 16-bit code of the word under the pointer, and how far it has come.

    Texts in the stream end with a 0, on which a pointer stays.
    """
    start = np.arange(len(stream), dtype=np.int64)
    at, word = start.copy(), np.empty(len(stream), np.uint64)
    codes, moved = np.empty((steps, len(stream)), np.uint16), np.empty((steps, len(stream)), np.uint8)
    one = np.uint64(1)
    for step in range(steps):
        if step % 48 == 0:  # fresh bits of the words for the next steps, above the code
            mixed = stream * np.uint64(0x9E3779B97F4A7C15 + 2 * (walk * 1000 + step))
            mixed ^= mixed >> np.uint64(29)
            bits = np.where(stream == 0, np.uint64(0), (mixed << np.uint64(16)) | (stream >> np.uint64(48)))
        np.take(bits, at, out=word, mode="clip")
        codes[step] = word & np.uint64(0xFFFF)
        moved[step] = at - start
        np.right_shift(word, np.uint64(16 + step % 48), out=word)
        np.bitwise_and(word, one, out=word)
        at += word.view(np.int64)
    return codes, moved


def sampled(codes: np.ndarray, moved: np.ndarray, step: int, at: np.ndarray, size: int) -> np.ndarray:
    """Codes of one step for windows of ``size`` words that begin ``at``: 0 once a pointer has left the window."""
    found = codes[step][at]
    return found if step < size else np.where(moved[step][at] < size, found, 0)


def joined(parts: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        key = (key ^ part) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key


def window_size(words: int) -> int:
    return max((x for x in SIZES if x <= words), default=words)


class Items:
    """A block of benchmark items with the keys of their windows."""

    def __init__(self, items: list[tuple[int, bytes]]):
        memo = Hashes()
        self.ids, self.words = [], []
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            words = word_hashes(text, memo)
            if not len(words):
                continue
            size = window_size(len(words))
            starts = {*range(0, len(words) - size + 1, size), len(words) - size}
            windows[size] += [(len(self.ids), s) for s in sorted(starts)]
            self.ids.append(item)
            self.words.append(words)
        self.windows = {size: np.array(w, np.int64) for size, w in windows.items()}
        self.tables = {}  # (size, walk) -> per table: steps, the codes known at each, sorted keys, windows in that order
        for size, found in self.windows.items():
            stream = np.concatenate([np.append(self.words[i][s : s + size], np.uint64(0)) for i, s in found])
            first = np.arange(len(found)) * (size + 1)
            for walk in range(WALKS):
                codes, moved = embed(stream, 2 * size, walk)
                self.tables[size, walk] = made = []
                for steps in plan(size, walk):
                    parts = [sampled(codes, moved, step, first, size) for step in steps]
                    known = np.zeros((len(steps), 1 << 16), bool)
                    for k, part in enumerate(parts):
                        known[k, part] = True
                    keys = joined(parts)
                    order = np.argsort(keys, kind="stable")
                    made.append((steps, known, keys[order], order))

    def candidates(self, stream: np.ndarray) -> np.ndarray:
        """Distinct (item, position where the item would begin) of windows that share a key."""
        found = []
        everywhere = np.arange(len(stream))
        for walk in range(WALKS):
            codes, moved = embed(stream, 2 * max(self.windows, default=0), walk)
            for size, windows in self.windows.items():
                for steps, known, keys, order in self.tables[size, walk]:
                    at, parts = everywhere, []
                    for k, step in enumerate(steps):  # a position stays while its word is known at every sampled step
                        part = codes[step] if k == 0 and step < size else sampled(codes, moved, step, at, size)
                        stay = np.flatnonzero(known[k][part])
                        at, parts = at[stay], [x[stay] for x in [*parts, part]]
                    mine = joined(parts)
                    low = np.searchsorted(keys, mine, "left")
                    count = np.searchsorted(keys, mine, "right") - low
                    hit = np.flatnonzero(count)
                    if len(hit):
                        low, count = low[hit], count[hit]
                        flat = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                        met = windows[order[flat]]
                        found.append(np.stack([met[:, 0], np.repeat(at[hit], count) - met[:, 1]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edits that turn ``item`` into some stretch of ``text``, and where the stretch ends (bit-parallel, exact)."""
    masks: dict[int, int] = defaultdict(int)
    for i, word in enumerate(item.tolist()):
        masks[word] |= 1 << i
    n = len(item)
    full, last = (1 << n) - 1, 1 << (n - 1)
    plus, minus, edits = full, 0, n
    best, end = n, 0
    for j, word in enumerate(text.tolist(), 1):
        same = masks.get(word, 0)
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up = minus | (full & ~(across | plus))
        down = plus & across
        edits += bool(up & last) - bool(down & last)
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if edits < best:
            best, end = edits, j
    return best, end


def allowed(words: int) -> int:
    return int(MAX_EDITS * words)


def matches(items: Items, stream: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Verified (text number, item number, first word, end word, edits), the best place of each item in each text.

    ``ends`` has the place of each text's 0 in the stream.
    """
    candidates = items.candidates(stream)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    reach: dict[tuple[int, int], int] = {}
    for item, begin in candidates[np.lexsort((candidates[:, 1], candidates[:, 0]))].tolist():
        words = items.words[item]
        slack = allowed(len(words))
        text = int(np.searchsorted(ends, max(begin, 0)))
        low = int(ends[text - 1]) + 1 if text else 0
        if text < len(ends) and begin + len(words) - slack > ends[text]:  # begins before its own text does
            nearer = int(np.searchsorted(ends, begin + len(words) // 2))
            text, low = (nearer, int(ends[nearer - 1]) + 1) if nearer < len(ends) else (text, low)
        if text >= len(ends) or ((item, text) in reach and reach[item, text] >= begin):
            continue
        first = max(low, begin - 2 * slack)
        last = min(int(ends[text]), begin + len(words) + 2 * slack)
        reach[item, text] = begin + slack
        edits, end = align(words, stream[first:last])
        if edits > slack:
            continue
        backward, length = align(words[::-1], stream[first : first + end][::-1])
        found = (edits, first + end - length - low, first + end - low)
        if (text, item) not in best or found < best[text, item]:
            best[text, item] = found
    return [(text, item, start, end, edits) for (text, item), (edits, start, end) in sorted(best.items())]


def blocks(benchmark: DataFrame, size: int = BLOCK_ITEMS) -> Iterator[list[tuple[int, bytes]]]:
    block = []
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text.encode()))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def searched(docs: DataFrame, benchmark: DataFrame, schema, give: Callable, chained: bool) -> DataFrame:
    """``give`` the rows for each batch and its matches, over all blocks of items.

    One pass over the documents per block and no shuffle; the items of a block go along with the tasks. Blocks are
    chained (each sees what the one before gave) or their rows are put together.
    """
    out = docs if chained else docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark):
        items = Items(block)
        if not items.ids:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(items.__dict__)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items.__new__(Items)
            items.__dict__ = sent.value
            for batch in pieces(batches, "text", PIECE):
                memo = hashes()
                rows = [word_hashes(x, memo) for x in blobs(batch["text"])]
                ends = np.cumsum([len(x) + 1 for x in rows]) - 1
                stream = np.zeros(int(ends[-1]) + 1, np.uint64)
                stream[np.delete(np.arange(len(stream)), ends)] = np.concatenate(rows)
                yield give(batch, items, matches(items, stream, ends))

        out = out.mapInArrow(find, schema) if chained else out.unionByName(docs.mapInArrow(find, schema))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every benchmark item found in a document: doc_id, item_id, first_word, end_word, edits, similarity."""

    def give(batch: pa.RecordBatch, items: Items, found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "doc_id": batch["doc_id"].take(pa.array([x[0] for x in found], pa.int64())).cast(pa.int64()),
            "item_id": pa.array([items.ids[x[1]] for x in found], pa.int64()),
            "first_word": pa.array([x[2] for x in found], pa.int32()),
            "end_word": pa.array([x[3] for x in found], pa.int32()),
            "edits": pa.array([x[4] for x in found], pa.int32()),
            "similarity": pa.array([1 - x[4] / len(items.words[x[1]]) for x in found], pa.float64()),
        })

    schema = "doc_id long, item_id long, first_word int, end_word int, edits int, similarity double"
    return searched(docs.select("doc_id", "text").where(F.col("text").isNotNull()), benchmark, schema, give, chained=False)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""

    def give(batch: pa.RecordBatch, items: Items, found: list) -> pa.RecordBatch:
        clean = np.ones(batch.num_rows, bool)
        clean[[x[0] for x in found]] = False
        return batch.filter(pa.array(clean))

    whole = docs.select(F.struct("*").alias("row"), "text")
    return searched(whole, benchmark, whole.schema, give, chained=True).select("row.*")


@query("op6_decontaminate")
def op6(spark, folder):
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
