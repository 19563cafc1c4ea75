"""Language-model scoring with a hidden Markov model.

Training has two steps. In the first, every token belongs to a class: the ``TOP`` most frequent training words and the
end of a text are classes of their own, all other words share one by their ending. Baum-Welch passes over all training
texts go on until the gain in log-likelihood is below ``TOLERANCE`` of it: tasks add up expected counts for their blocks
(in stretches of ``STRETCH`` tokens; a stretch within a text has a start distribution of its own), Spark adds the tasks'
sums, and the driver re-estimates the tables. In the second, every word seen at least ``OWN`` times leaves its class: one
more pass gives expected counts per word and state, a Spark table with a row per word that grows with the corpus, and each
word gets emissions of its own, (counts + its class's share of states) / total. Words seen less often, and unseen ones,
share what is left of their class by their smoothed counts. A text's score is its exact likelihood under the final model
by the scaled forward recursion over the whole text.

Texts are turned into blocks of ``BLOCK_BYTES`` once: a block holds its distinct words and a stream of numbers into them.
Word counts come from the blocks' counts, summed per word by a shuffle that holds a word once per block (a word in every
block is one of the hundred thousands a block has, so no key holds a large share), and go back to the blocks. The
words' expected counts go the same way: summed per word by its 64-bit hash, joined to the blocks that hold the word. Words
with rows in nearly every block are among the ``TOP``, whose sums stay with the driver's tables of bounded size.

Edge cases: a null or empty text has the end token alone; a null doc_id is learned from; without training texts every
count is 0 and the tables stay even; words of equal count at the border of ``TOP`` are taken in byte order; a very long
text is a block of its own; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortframe.llm.common import blobs, dropped, pieces, table, written
from cohortframe.llm.registry import query

STATES, TOP, TAILS, OWN = 8, 4096, 512, 2
TOLERANCE = 0.002  # least gain of a pass, as a part of the log-likelihood
BLOCK_BYTES, STRETCH, SEED = 24_000_000, 256, 3
SLICE = 1 << 19  # tokens that one step of a pass holds the states of
CLASSES = TOP + TAILS + 1
END_CLASS = CLASSES - 1


class Numbers(dict):
    """Numbers words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


BLOCK_SCHEMA = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, words binary, counts binary, stream binary"


def blocks_of(docs: DataFrame) -> DataFrame:
    """One row per block of documents: ids, lengths in words, the distinct words, their counts in training texts, the
    stream of word numbers (32 bits, compressed)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        numbers, ids, streams, size = Numbers(), [], [], 0

        def row() -> pa.RecordBatch:
            held = [held_out(x) for x in ids]
            counts = np.zeros(len(numbers), np.uint32)
            learned = [s for s, h in zip(streams, held) if not h]
            if learned:
                counts += np.bincount(np.concatenate(learned), minlength=len(numbers)).astype(np.uint32)
            values = (
                [block], [ids], [held], [[len(s) for s in streams]], [b" ".join(numbers)], [counts.tobytes()],
                [pa.compress(np.concatenate(streams).astype("<u4").tobytes(), codec="zstd", asbytes=True)],
            )
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
            names = ("block", "doc_ids", "held", "lengths", "words", "counts", "stream")
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], list(names))

        for batch in pieces(batches, "text"):
            for name, text in zip(batch["doc_id"].to_pylist(), blobs(batch["text"])):
                words = text.lower().split()
                ids.append(name)
                streams.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)).astype(np.uint32))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield row()
                    block, numbers, ids, streams, size = block + 1, Numbers(), [], [], 0
        if ids:
            yield row()

    return written(docs.select("doc_id", "text").mapInArrow(build, BLOCK_SCHEMA), "blocks")


def word_counts(blocks: DataFrame) -> DataFrame:
    """A row per word of each block: block, at (its number there), word, c (its training count in the corpus), tail (its
    class unless it is frequent), first (one row of every word), key (its hash)."""

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*(batch[x].to_pylist() for x in ("block", "words", "counts"))):
                found = words.split(b" ") if words else []
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(found, pa.binary()),
                     pa.array(np.frombuffer(counts, np.uint32), pa.int64())],
                    ["block", "at", "word", "n"],
                )

    rows = blocks.select("block", "words", "counts").mapInArrow(list_words, "block long, at int, word binary, n long")
    same = Window.partitionBy("word")
    tail = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(TAILS)).cast("int")
    return written(
        rows.select(
            "block", "at", "word", F.sum("n").over(same).alias("c"), tail.alias("tail"),
            (F.min("block").over(same) == F.col("block")).alias("first"), F.xxhash64("word").alias("key"),
        ),
        "words",
    )


class Counts:
    """What is kept of the corpus in the tasks: totals, the frequent words, the tail classes' sums."""

    def __init__(self, words: DataFrame, training_texts: int):
        once = words.where("first")
        size = F.floor(4 * F.log2("c")).cast("int")
        sizes = once.where("c > 0").groupBy(size.alias("size")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).orderBy(F.desc("size")).collect()
        self.tokens = sum(r.n for r in sizes) + training_texts
        self.distinct = sum(r.v for r in sizes) + (training_texts > 0)
        self.texts = training_texts
        # words above the size at which there are TOP of them: few more than TOP, so that one task can put them in order
        held = np.cumsum([r.v for r in sizes])
        least = sizes[min(int(np.searchsorted(held, TOP)), len(sizes) - 1)]["size"] if sizes else 0
        top = once.where((F.col("c") > 0) & (size >= least)).orderBy(F.desc("c"), "word").limit(TOP).select("word", "c").collect()
        self.top = {bytes(r.word): k for k, r in enumerate(top)}
        rare = (F.col("c") > 0) & (F.col("c") < OWN)
        sums = once.groupBy("tail").agg(
            F.sum("c").alias("n"), F.count_if(F.col("c") >= OWN).alias("own"), F.count_if(rare).alias("v"), F.sum(F.when(rare, F.col("c"))).alias("rest")
        ).collect()
        # training tokens of a tail class, its words with emissions of their own, its other words and their tokens
        self.tail_tokens, self.own_words, self.rest_words, self.rest_tokens = np.zeros((4, TAILS))
        for r in sums:
            k = r["tail"]
            self.tail_tokens[k], self.own_words[k], self.rest_words[k], self.rest_tokens[k] = r.n, r.own, r.v, r.rest or 0
        self.mass = np.zeros(CLASSES)  # training tokens per class
        for r in top:
            k = zlib.crc32(bytes(r.word)[-2:]) % TAILS
            self.tail_tokens[k] -= r.c
            if r.c >= OWN:
                self.own_words[k] -= 1
            else:
                self.rest_words[k] -= 1
                self.rest_tokens[k] -= r.c
            self.mass[self.top[bytes(r.word)]] = r.c
        self.mass[TOP : TOP + TAILS] = self.tail_tokens
        self.mass[END_CLASS] = training_texts


ENCODED = (
    "block long, doc_ids array<long>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, stream binary, "
    "classes binary, counts binary, own binary, keys binary"
)


def encoded(blocks: DataFrame, words: DataFrame, counts: Counts) -> DataFrame:
    """Blocks with a stream of word numbers (the number behind the last word is the end of a text); per word its class, its
    count up to ``OWN``, and the numbers and keys of those with emissions of their own; per document the sums that need no
    model."""
    tokens, distinct, texts = counts.tokens, counts.distinct, counts.texts
    top = blocks.sparkSession.createDataFrame([(bytearray(w), k) for w, k in counts.top.items()], "word binary, top int")
    # keys of other words are of no use and would be most of the shuffled bytes
    own_key = F.when(F.col("top").isNull() & (F.col("c") >= OWN), F.col("key")).otherwise(F.lit(0).cast("long"))
    classed = words.join(F.broadcast(top), "word", "left").select(
        "block", "at", "c", F.coalesce("top", F.col("tail") + TOP).cast("short").alias("class"), own_key.alias("key")
    )

    def encode(key, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(right["at"].combine_chunks()), kind="stable")
        c, classes, keys = (np.asarray(right[x].combine_chunks())[order] for x in ("c", "class", "key"))
        own = np.flatnonzero((classes >= TOP) & (c >= OWN)).astype("<u4")
        classes = np.append(classes, END_CLASS).astype(np.uint16)
        base, rest = np.log10(c.astype(np.float64) + 1), np.log10(tokens + distinct + 1)
        names = [x.split()[0] for x in ENCODED.split(", ")]
        out = {x: [] for x in names}
        for block, ids, held, lengths, stream in zip(*(left[x].to_pylist() for x in ("block", "doc_ids", "held", "lengths", "stream"))):
            numbers = np.frombuffer(pa.decompress(stream, 4 * sum(lengths), codec="zstd", asbytes=True), "<u4")
            ends = np.cumsum(lengths)
            starts = ends - lengths

            def summed(values: np.ndarray) -> np.ndarray:
                running = np.concatenate([[0.0], np.cumsum(values)])
                return running[ends] - running[starts]

            flat = np.empty(len(numbers) + len(ids), "<u4")
            places = ends + np.arange(len(ids))
            flat[places] = len(c)
            flat[np.delete(np.arange(len(flat)), places)] = numbers
            n = np.array(lengths, np.int64) + 1
            row = (
                block, ids, held, n, summed(c[numbers] > 0).round().astype(np.int64) + (texts > 0),
                summed(base[numbers]) + np.log10(texts + 1) - n * rest, pa.compress(flat.tobytes(), codec="zstd", asbytes=True),
                classes.tobytes(), np.minimum(c, OWN).astype(np.uint8).tobytes(), own.tobytes(), keys[own].astype("<i8").tobytes(),
            )
            for name, value in zip(names, row):
                out[name].append(value)
        lists = (pa.bool_(), pa.int64(), pa.int64(), pa.float64())
        kinds = (pa.int64(), pa.list_(pa.int64()), *map(pa.list_, lists), *[pa.binary()] * 5)
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    sides = blocks.select("block", "doc_ids", "held", "lengths", "stream").groupBy("block"), classed.groupBy("block")
    return written(sides[0].cogroup(sides[1]).applyInArrow(encode, ENCODED), "encoded")


def rows_of(batch: pa.RecordBatch, arrays: dict[str, str], lists: tuple[str, ...]) -> Iterator[list]:
    """Rows of encoded blocks: the stream, ``arrays`` (name: type) and ``lists``."""
    for stream, *values in zip(*(batch[x].to_pylist() for x in ("stream", *arrays, *lists))):
        found = [np.frombuffer(x, t) for x, t in zip(values, arrays.values())]
        sizes = np.array(values[len(arrays)], np.int64)  # the first list holds the texts' tokens
        numbers = np.frombuffer(pa.decompress(stream, 4 * int(sizes.sum()), codec="zstd", asbytes=True), "<u4")
        yield [numbers, *found, sizes, *values[len(arrays) + 1 :]]


class Tables:
    """Start (of texts, of later stretches), transition and emission probabilities."""

    def __init__(self, mass: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.prior = (mass + 1) / (mass.sum() + len(mass))
        self.start = np.full((2, STATES), 1 / STATES)
        self.move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        self.move /= self.move.sum(1, keepdims=True)
        tilted = self.prior[:, None] * np.exp(draw.normal(0, 1, (len(mass), STATES)))
        self.emit = tilted / tilted.sum(0)

    def learn(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start = (start + 1) / (start + 1).sum(1, keepdims=True)
        self.move = (move + 1) / (move + 1).sum(1, keepdims=True)
        smoothed = emit + 10 * self.prior[:, None]
        self.emit = smoothed / smoothed.sum(0)


def by_time(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Sequences by falling length, and how many of them have more than t tokens, for every t."""
    order = np.argsort(-length, kind="stable")
    longest = int(length.max(initial=0))
    active = np.searchsorted(-length[order], -np.arange(longest), side="left").tolist()
    return order, active


def expected_counts(stream: np.ndarray, first: np.ndarray, length: np.ndarray, opening: np.ndarray, tables: Tables):
    """Baum-Welch sums over sequences of ``stream``: start, transition and emission counts."""
    return baum_welch(stream, first, length, opening, tables)[:3]


def baum_welch(stream: np.ndarray, first: np.ndarray, length: np.ndarray, opening: np.ndarray, tables: Tables):
    """Start, transition and emission counts over sequences of ``stream``, and their log-likelihood.

    Some ``SLICE`` tokens at a time, so that a large block needs no more memory than a small one.
    """
    starts, moves, emitted, likelihood = np.zeros((2, STATES)), np.zeros((STATES, STATES)), np.zeros((len(tables.emit), STATES)), 0.0
    narrow = tuple(x.astype(np.float32, copy=False) for x in (tables.emit, tables.move, tables.start))
    cut = np.flatnonzero(np.diff(np.cumsum(length) // SLICE)) + 1
    for begin, end in zip([0, *cut.tolist()], [*cut.tolist(), len(length)]):
        part = slice(begin, end)
        found = sequence_sums(stream, first[part], length[part], opening[part], *narrow, emitted)
        starts, moves, likelihood = starts + found[0], moves + found[1], likelihood + found[2]
    return starts, moves, emitted, likelihood


def sequence_sums(
    stream: np.ndarray, first: np.ndarray, length: np.ndarray, opening: np.ndarray,
    emit: np.ndarray, move: np.ndarray, start: np.ndarray, emitted: np.ndarray,
):
    """Start and transition counts and the log-likelihood of some sequences; emission counts are added to ``emitted``.

    ``opening`` is 0 for the first stretch of a text and 1 for later ones. All sequences advance together.
    """
    order, active = by_time(first, length)
    first, opening = first[order], opening[order]
    offsets = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
    seen = np.empty(offsets[-1], np.int64)
    forward = np.empty((offsets[-1], STATES), np.float32)
    scale = np.empty((offsets[-1], 1), np.float32)
    every = np.ones((STATES, 1), np.float32)  # a product with it is a faster sum over states
    state = None
    for t, n in enumerate(active):
        now = slice(offsets[t], offsets[t + 1])
        seen[now] = stream[first[:n] + t]
        state = np.multiply(start[opening] if t == 0 else state[:n] @ move, emit.take(seen[now], 0), out=forward[now])
        np.matmul(state, every, out=scale[now])
        state /= scale[now]
    moves = np.zeros((STATES, STATES))
    behind = np.ones((0, STATES), np.float32)
    for t in range(len(active) - 1, -1, -1):
        n, at, m = active[t], offsets[t], len(behind)
        # what follows a token: nothing where its sequence ends
        factor = emit.take(seen[at : at + n], 0)
        factor /= scale[at : at + n]
        if m:
            moves += forward[at : at + m].T @ behind
            back = behind @ move.T
            factor[:m] *= back
            forward[at : at + m] *= back
        behind = factor
    moves *= move
    for k in range(STATES):
        emitted[:, k] += np.bincount(seen, weights=forward[:, k], minlength=len(emit))
    starts = np.zeros((2, STATES))
    if len(active):
        np.add.at(starts, opening, forward[: active[0]])
    return starts, moves, float(np.log(scale, dtype=np.float64).sum())


def stretches(lengths: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, length and opening of the stretches of the texts to learn from."""
    ends = np.cumsum(lengths)
    begins, sizes = (ends - lengths)[learned], lengths[learned]
    parts = -(-sizes // STRETCH)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(begins, parts) + number * STRETCH
    length = np.minimum(STRETCH, np.repeat(begins + sizes, parts) - first)
    return first, length, (number > 0).astype(np.int64)


NAMES = [f"s{k}" for k in range(STATES)]
SUMS = 2 + STATES + CLASSES  # places of the tables' sums: starts, transitions, classes; then one for the log-likelihood
WORD_SUM = -1  # place of a word's sums


def pass_sums(texts: DataFrame, tables: Tables, by_word: bool) -> DataFrame:
    """Sums of one Baum-Welch pass over all training texts: at, key, a column per state.

    Rows with ``at`` from 0 are places of the tables. ``by_word`` adds the counts of words with emissions of their own as
    rows with their key, in steps of 1/1024, and their totals per tail class behind the other places.
    """
    sent = vars(tables)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables.__new__(Tables)
        tables.__dict__ = sent
        sums = np.zeros((SUMS + 1 + TAILS, STATES))

        def row(at: np.ndarray, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(values[:, k], pa.float64()) for k in range(STATES)]
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys, pa.int64()), *columns], ["at", "key", *NAMES])

        for batch in batches:
            arrays = {"classes": "<u2", "own": "<u4", "keys": "<i8"}
            for numbers, classes, own, keys, lengths, held in rows_of(batch, arrays, ("n_tokens", "held")):
                first, length, opening = stretches(lengths, ~np.array(held, bool))
                if not by_word:
                    starts, moves, emitted, likelihood = baum_welch(classes[numbers], first, length, opening, tables)
                else:
                    local = Tables.__new__(Tables)
                    local.__dict__ = sent | {"emit": tables.emit.astype(np.float32)[classes]}
                    starts, moves, words, likelihood = baum_welch(numbers, first, length, opening, local)
                    found = np.round(words[own] * 1024) / 1024
                    words[own] = 0
                    emitted = np.stack([np.bincount(classes, words[:, k], CLASSES) for k in range(STATES)], 1)
                    tails = classes[own] - TOP
                    sums[SUMS + 1 :] += np.stack([np.bincount(tails, found[:, k], TAILS) for k in range(STATES)], 1)
                    some = np.flatnonzero(found.any(1))
                    yield row(np.full(len(some), WORD_SUM), keys[some], found[some])
                sums[:SUMS] += np.concatenate([starts, moves, emitted])
                sums[SUMS, 0] += likelihood
        kept = np.flatnonzero(sums.any(1))
        yield row(kept, np.zeros(len(kept), np.int64), sums[kept])

    schema = "at int, key long, " + ", ".join(f"{x} double" for x in NAMES)
    read = texts.select("n_tokens", "held", "stream", "classes", "own", "keys")
    return read.mapInArrow(count, schema).groupBy("at", "key").agg(*[F.sum(x).alias(x) for x in NAMES])


def table_sums(sums: DataFrame) -> np.ndarray:
    """The sums of the tables, a few thousand rows at any size of the corpus."""
    out = np.zeros((SUMS + 1 + TAILS, STATES))
    for row in sums.where("at >= 0").select("at", *NAMES).collect():
        out[row[0]] = row[1:]
    return out


def learn_classes(texts: DataFrame, tables: Tables, tolerance: float = TOLERANCE) -> list[float]:
    """Baum-Welch on classes until the gain is below the tolerance; the log-likelihoods before each pass."""
    path: list[float] = []
    while len(path) < 2 or path[-1] - path[-2] >= tolerance * abs(path[-1]):
        sums = table_sums(pass_sums(texts, tables, by_word=False))
        tables.learn(sums[:2], sums[2 : 2 + STATES], sums[2 + STATES : SUMS])
        path.append(float(sums[SUMS, 0]))
    return path


class WordModel:
    """The final tables: of classes without the words that left them, and what a word's own emissions are made of."""

    def __init__(self, counts: Counts, tables: Tables, sums: np.ndarray | None):
        self.start, self.move = tables.start, tables.move
        rest = counts.rest_tokens + counts.rest_words + 1
        self.share = (np.arange(OWN)[:, None] + 1) / rest  # of a tail class, by a word's count
        weight = tables.emit[TOP : TOP + TAILS] * self.weights(tables, sums)
        self.lean = weight / weight.sum(1, keepdims=True)  # states of a tail class
        if sums is None:
            self.total, self.emit = np.ones(STATES), tables.emit
            return
        mass = counts.mass.copy()
        mass[TOP : TOP + TAILS] = counts.rest_tokens
        left = sums[2 + STATES : SUMS] + 10 * ((mass + 1) / (mass.sum() + len(mass)))[:, None]
        own = sums[SUMS + 1 :] + counts.own_words[:, None] * self.lean
        self.total = left.sum(0) + own.sum(0)
        self.emit = left / self.total
        tables.learn(sums[:2], sums[2 : 2 + STATES], sums[2 + STATES : SUMS])
        self.start, self.move = tables.start, tables.move

    @staticmethod
    def weights(tables: Tables, sums: np.ndarray | None) -> np.ndarray:
        """How often each state is taken."""
        return np.ones(STATES) if sums is None else sums[2 + STATES : SUMS].sum(0) + sums[SUMS + 1 :].sum(0) + 1


def emissions(model: dict, classes: np.ndarray, counts: np.ndarray, own: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Emissions of a block's words (the last is the end): ``found`` holds the expected counts of the words ``own``."""
    out = model["emit"][classes]
    tails = classes.astype(np.int64) - TOP
    rest = np.flatnonzero((tails[:-1] >= 0))
    out[rest] *= model["share"][np.minimum(counts[rest], OWN - 1), tails[rest], None]
    out[own] = (found + model["lean"][tails[own]]) / model["total"]
    return out


def log_likelihoods(stream: np.ndarray, lengths: np.ndarray, tables: Tables) -> np.ndarray:
    """Log10 probability of every text's classes by the scaled forward recursion."""
    first = np.cumsum(lengths) - lengths
    order, active = by_time(first, lengths)
    first, out, every = first[order], np.zeros(len(lengths)), np.ones(STATES)
    state = None
    for t, n in enumerate(active):
        now = (np.repeat(tables.start[:1], n, 0) if t == 0 else state[:n] @ tables.move) * tables.emit[stream[first[:n] + t]]
        total = now @ every
        out[:n] += np.log10(total)
        state = now / total[:, None]
    back = np.empty(len(lengths))
    back[order] = out
    return back


def placed_sums(texts: DataFrame, sums: DataFrame) -> DataFrame:
    """Expected counts of words with emissions of their own, for every block that holds them: block, place (in the block's
    ``own``), a column per state."""

    def list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys in zip(batch["block"].to_pylist(), batch["keys"].to_pylist()):
                found = np.frombuffer(keys, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), block), pa.int64()), pa.array(np.arange(len(found)), pa.int32()), pa.array(found)], ["block", "place", "key"]
                )

    index = texts.select("block", "keys").mapInArrow(list_keys, "block long, place int, key long")
    values = sums.where(F.col("at") == WORD_SUM).select("key", *[F.col(x).cast("float").alias(x) for x in NAMES])
    return index.join(values, "key").drop("key")


def scores(texts: DataFrame, sums: DataFrame, model: WordModel) -> DataFrame:
    """Scores of the texts of encoded blocks. ``sums`` holds the expected counts of words with emissions of their own; a
    block meets those of its words and is scored in the same step."""
    sent = vars(model)

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        (block,) = left.to_batches()
        arrays = {"classes": "<u2", "counts": "u1", "own": "<u4"}
        ((numbers, classes, counts, own, n, ids, held, known, base),) = rows_of(block, arrays, ("n_tokens", "doc_ids", "held", "n_known", "base"))
        found = np.zeros((len(own), STATES), np.float32)
        if right.num_rows:
            places = np.asarray(right["place"].combine_chunks())
            for k, name in enumerate(NAMES):
                found[places, k] = np.asarray(right[name].combine_chunks())
        tables = Tables.__new__(Tables)
        tables.__dict__ = {**sent, "emit": emissions(sent, classes, counts, own, found)}
        values = (ids, held, n, known, base, log_likelihoods(numbers, n, tables))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        return pa.table({x: pa.array(v, k) for x, v, k in zip(names, values, kinds)})

    sides = texts.drop("keys").groupBy("block"), placed_sums(texts, sums).groupBy("block")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return sides[0].cogroup(sides[1]).applyInArrow(score, schema)


def score_texts(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and score all of them."""
    blocks = blocks_of(docs)
    training = blocks.select(F.explode("held").alias("held")).where(~F.col("held")).count()
    words = word_counts(blocks)
    counts = Counts(words, training)
    texts = encoded(blocks, words, counts)
    for used in (blocks, words):
        dropped(used)
    tables = Tables(counts.mass)
    if training:
        learn_classes(texts, tables)
    sums = written(pass_sums(texts, tables, by_word=True), "word-sums")
    model = WordModel(counts, tables, table_sums(sums) if training else None)
    return scores(texts, sums, model).withColumn("train_tokens", F.lit(counts.tokens).cast("long"))


@query("op4_hmm_scoring")
def op4(spark, folder):
    return score_texts(table(spark, folder, "documents"))
