"""Phrase collocation mining by top-order marginalisation.

Every word heads one window of ORDER words: the word and its lead words, padded with null where its piece of text ends. Only
these longest windows are counted; a ROLLUP over (lang, w1, ..., w4) adds their counts up over ever shorter prefixes, which
gives the exact count of every phrase of one to ORDER words, and of all words of a language.

Most windows occur once and hold no candidate, so passes before find out which phrases of 2 and then of 3 words may occur LEAST
times: a pass adds up the counts of 64-bit hashes of the phrases whose parts may be frequent, and the hashes that reach LEAST
set bits of a filter of at most FILTER_BITS bits. Windows end where the phrase they begin with is not in its filter. Equal hashes
and full filters only let more windows pass whole; no phrase with LEAST occurrences loses one, so the filters save shuffling
and never decide a count.

A task adds up equal windows of a piece of its texts, and Spark adds them up per task before the shuffle, so a frequent word,
pair or passage is a row a task at most. Windows of a single word skip the longer levels of the ROLLUP.

Scores are whole-number divisions of decimals. Counts of parts and containing phrases come by joins on the phrase.

Edge cases: a null or empty text has no words; a null lang counts as ``und`` together with that value; words are compared as
bytes after lower-casing A-Z; a very long text is cut into runs of CHUNK words that see the lead words after them; ties are
ordered by score, count and phrase, which no two rows share; repeated rows count as often as they occur; an empty table gives
no rows; further columns are not read. A lang without candidates has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortframe.llm.common import pieces, table, written
from cohortframe.llm.registry import query

ORDER = 4
LEAST = 30
SHARE = 80  # percent of its occurrences from which a phrase inside a longer one is dropped
FACTOR = 2_000_000
TOP = 2000
CHUNK = 1_000_000  # words counted together; fewer than 2^20, so that three word numbers fit a long
PIECE = 2_000_000
FILTER_BITS, FEWEST_BITS, PROBES = 1 << 28, 1 << 16, 4  # 32 MB at most; 16 bits a phrase or more keep 99 of 100 others out
MULTIPLIER = 0x9E3779B97F4A7C15
ROWS = 50_000
LOW = (1 << 20) - 1
WORDS = [f"w{k + 1}" for k in range(ORDER)]


def _classes() -> np.ndarray:
    """0 for bytes of words, 1 for blanks, 2 for bytes that end a piece."""
    out = np.zeros(256, np.uint8)
    out[[0x20, 0x09]] = 1
    out[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
    return out


def runs_of(text: bytes) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int]]:
    """Words of a text in runs: the distinct ones in byte order, their numbers (from 1), the number of each word's piece, and
    how many of them head windows in this run: the last ORDER - 1 do not, where more words follow.
    """
    data = np.frombuffer(text, np.uint8)
    kinds = _classes()[data]
    edges = np.flatnonzero(np.diff((kinds == 0).astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    for first in range(0, len(starts), CHUNK):
        heads = min(CHUNK, len(starts) - first)
        last = min(len(starts), first + CHUNK + ORDER - 1)
        begin, end = starts[first], ends[last - 1]
        part, kind = data[begin:end].copy(), kinds[begin:end]
        part[(part >= 65) & (part <= 90)] += 32
        offsets = np.zeros(last - first + 1, np.int64)
        np.cumsum(ends[first:last] - starts[first:last], out=offsets[1:])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(offsets), pa.py_buffer(part[kind == 0])])
        coded = words.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        yield coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()], np.cumsum(kind == 2)[starts[first:last] - begin], heads


def lead_columns(codes: np.ndarray, grown: list[np.ndarray], heads: int) -> list[np.ndarray]:
    """Numbers of the first to last word of the window at each of the first ``heads`` words; 0 where the phrase of that many words has not grown."""
    out = [codes[:heads]]
    for k in range(1, ORDER):
        lead = np.append(codes[k:], np.zeros(min(k, len(codes)), np.int64))
        out.append(np.where(grown[k][:heads], lead[:heads], 0))
    return out


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray, int]]:
    """Per run of words of one language: the language, the distinct words, the words' numbers, whether a word has a next one
    in its piece, and how many of the words head windows here."""
    for batch in pieces(batches, "text", PIECE):
        langs = pc.fill_null(batch["lang"], "und")
        texts = batch["text"].cast(pa.binary())
        for lang in sorted(pc.unique(langs).to_pylist()):
            mine = texts.filter(pc.equal(langs, lang)).drop_null()
            for words, codes, piece, heads in runs_of(b"\n".join(mine.to_pylist())):
                yield lang, words, codes, np.append(piece[1:] == piece[:-1], False), heads


def unique_windows(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct windows in the order of their words, and how often each occurs."""
    heads, head = np.unique(columns[0] << 20 | columns[1], return_inverse=True)
    packed, counts = np.unique(head.astype(np.int64) << 40 | columns[2] << 20 | columns[3], return_counts=True)
    head = heads[packed >> 40]
    return [head >> 20, head & LOW, packed >> 20 & LOW, packed & LOW], counts


def word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    """64-bit hashes by the numbers of the words (0: none)."""
    salt = xxhash.xxh64_intdigest(lang.encode())
    return np.array([0, *(xxhash.xxh64_intdigest(w, salt & 0xFFFFFFFF) for w in words.to_pylist())], np.uint64)


def mixed(hashed: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hashes of phrases and of the words after them, as hashes of the longer phrases."""
    out = hashed * np.uint64(MULTIPLIER) + (following >> np.uint64(29) | following << np.uint64(35))
    out = (out ^ out >> np.uint64(31)) * np.uint64(MULTIPLIER)
    return out ^ out >> np.uint64(32)


def grow(codes: np.ndarray, linked: np.ndarray, hashes: np.ndarray, filters: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per size up to ``size`` whether the phrase that begins at a word may be frequent as far as the filters tell (those of 2, 3,
    ... words), and the hashes of the phrases of the largest size."""
    out, hashed = [np.ones(len(codes), bool)], hashes[codes]
    for k in range(2, size + 1):
        more = out[-1] & linked & np.append(out[-1][1:], False)
        out.append(more)
        following = np.append(hashes[codes[k - 1 :]], np.zeros(min(k - 1, len(codes)), np.uint64))
        hashed = mixed(hashed, following)
        if k - 2 < len(filters):
            at = np.flatnonzero(more)
            more[at] = passes(filters[k - 2], hashed[at].view(np.int64))
    return out, hashed


def frequent(docs: DataFrame, size: int, filters: list[np.ndarray], least: int) -> DataFrame:
    """Hashes (``phrase``) of the phrases of ``size`` words whose counts reach ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes, linked, heads in by_language(batches):
            grown, hashed = grow(codes, linked, word_hashes(words, lang), shared.value, size)
            found, counts = np.unique(hashed[:heads][grown[-1][:heads]].view(np.int64), return_counts=True)
            for start in range(0, len(found), ROWS):
                part = slice(start, start + ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(found[part]), pa.array(counts[part])], ["phrase", "n"])

    sums = docs.mapInArrow(count, "phrase long, n long").groupBy("phrase").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= least).select("phrase")


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """A filter (PROBES bits a hash) in groups of 32 bits; at most FILTER_BITS / 32 groups come to the driver."""
    staged = written(hashes, "hashes")
    bits = FEWEST_BITS
    wanted = 16 * staged.count()
    while bits < min(wanted, FILTER_BITS):
        bits *= 2
    low, high = F.col("phrase").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("phrase", 32).bitwiseOR(F.lit(1))
    places = F.explode(F.array(*[(low + k * high).bitwiseAND(bits - 1) for k in range(PROBES)])).alias("at")
    groups = staged.select(places).groupBy(F.shiftright("at", 5).alias("group")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(31).cast("int"))).alias("bits")
    )
    found = groups.toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[found["group"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out


def passes(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    low, high = hashed & 0xFFFFFFFF, (hashed.view(np.uint64) >> np.uint64(32)).astype(np.int64) | 1
    out = np.ones(len(hashed), bool)
    for k in range(PROBES):
        at = (low + k * high) & (len(bits) * 32 - 1)
        out &= (bits[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)) > 0
    return out


def windows(docs: DataFrame, filters: list[np.ndarray]) -> DataFrame:
    """The longest windows with their counts, added up within runs: lang, w1..w4 (null: padding), n."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes, linked, heads in by_language(batches):
            grown, _ = grow(codes, linked, word_hashes(words, lang), shared.value, ORDER)
            columns, counts = unique_windows(lead_columns(codes, grown, heads))
            texts = words.cast(pa.large_string()).cast(pa.string())
            for start in range(0, len(counts), ROWS):
                part = slice(start, start + ROWS)
                shown = [texts.take(pa.array(c[part] - 1, mask=c[part] == 0)) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(shown[0])), *shown, pa.array(counts[part])], ["lang", *WORDS, "n"])

    return docs.mapInArrow(count, "lang string, " + ", ".join(f"{w} string" for w in WORDS) + ", n long")


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of every phrase of one to ORDER words with ``least`` occurrences or more, and (lang, n) of all words."""
    texts, filters = docs.select("lang", "text"), []
    for size in range(2, ORDER):
        filters.append(bit_filter(frequent(texts, size, filters, least)))
    top = written(windows(texts, filters), "windows")
    level, several = F.grouping_id(), F.col("w2").isNotNull()
    sums = top.where(several).rollup("lang", *WORDS).agg(F.sum("n").alias("f"), level.alias("_level"))
    one = 2 ** (ORDER - 1) - 1  # the level of single words
    staged = written(sums.where((F.col("_level") == one) | ((F.col("_level") < one) & (F.col("f") >= least))), "sums")
    found = None
    for k in range(2, ORDER + 1):
        words = [F.col(w) for w in WORDS[:k]]
        part = staged.where((F.col("_level") == 2 ** (ORDER - k) - 1) & words[-1].isNotNull()).select("lang", F.array(*words).alias("words"), "f")
        found = part if found is None else found.unionByName(part)
    heads = staged.where(F.col("_level") == one).select("lang", "w1", "f").unionByName(top.where(~several).select("lang", "w1", F.col("n").alias("f")))
    singles = written(heads.groupBy("lang", "w1").agg(F.sum("f").alias("f")), "words")
    n = singles.groupBy("lang").agg(F.sum("f").alias("n"))
    return found.unionByName(singles.where(F.col("f") >= least).select("lang", F.array("w1").alias("words"), "f")), n


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """The best phrases of every lang: lang, rank, phrase, a, l, r, n, score (all candidates that stay, where ``top`` is None)."""
    found, totals = phrases(docs, least)
    joined = found.select("lang", F.size("words").alias("k"), F.array_join("words", " ").alias("phrase"), "words", "f")
    known = written(joined, "phrases")
    part = known.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    candidates = known.where("k > 1")

    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(
        i.alias("at"), F.array_join(F.slice("words", F.lit(1), i), " ").alias("first"), F.array_join(F.slice("words", i + 1, F.col("k") - i), " ").alias("rest"),
    ))
    halves = candidates.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "k", "a", "c.*")
    for side, name in (("first", "l"), ("rest", "r")):
        halves = halves.join(part, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part"))).withColumnRenamed("_f", name).drop("_lang", "_part")
    exact = F.expr(f"(CAST(a AS DECIMAL(20,0)) * {FACTOR}) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    worst = F.min(F.struct(exact.alias("score"), "at", "l", "r"))
    scored = halves.groupBy("lang", "phrase", "a").agg(worst.alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: F.array_join(F.slice("words", i, size), " ")
    )))
    longer = candidates.where("k > 2").select(F.col("lang").alias("_lang"), F.explode(inner).alias("_part"), F.col("f").alias("_f"))
    holders = longer.groupBy("_lang", "_part").agg(F.max("_f").alias("_f"))
    held = scored.join(holders, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_part")), "left")
    wide = [F.col(c).cast("decimal(20,0)") for c in ("_f", "a")]
    kept = held.where(F.col("_f").isNull() | (100 * wide[0] < SHARE * wide[1])).drop("_lang", "_part", "_f")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    if top is None:
        ranked = kept.withColumn("rank", F.lit(None).cast("int"))
    else:
        ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_A = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13_SQL = rf"""
WITH split AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_A}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM split
), totals AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM words GROUP BY lang HAVING sum(len(words)) > 0
), grams AS (
  SELECT lang, size, array_to_string(words[i : i + size - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, words, size, unnest(generate_series(1, len(words) - size + 1)) AS i FROM words, (SELECT unnest(generate_series(1, {ORDER})) AS size))
  GROUP BY ALL HAVING count(*) >= {LEAST}
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM grams WHERE size > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST((CAST(a AS HUGEINT) * {FACTOR}) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM candidates) c
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(words[: k], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(words[k + 1 :], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, part, max(a) AS most
  FROM (SELECT lang, a, array_to_string(words[i : i + inside - 1], ' ') AS part
        FROM (SELECT *, unnest(generate_series(1, size - inside + 1)) AS i FROM (SELECT *, unnest(generate_series(2, size - 1)) AS inside FROM candidates)))
  GROUP BY lang, part
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.part = s.phrase
  WHERE h.most IS NULL OR 100 * CAST(h.most AS HUGEINT) < {SHARE} * CAST(s.a AS HUGEINT)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, CAST(encode(phrase) AS BLOB)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""


@query("op13_collocations", OP13_SQL)
def op13(spark, folder):
    return collocations(table(spark, folder, "documents")).withColumn("rank", F.col("rank").cast("long"))
