"""Token ids in fixed-width bit-packed files.

Every document is encoded whole, an end id is appended, and the ids are written in ascending document order. A file is a
Parquet part whose rows are packed segments: each segment is a self-contained image (``pack_segment``) with a header, the
document ids, where each document's ids begin, the byte offset of every block, and the blocks, each holding ``BLOCK``
ids at the fewest bits that hold the vocabulary. Blocks begin at known bytes, so ids can be unpacked by numpy a block at
a time and read from any place (``unpack``) without the rest. Spark's writer commits the parts, so a lost executor only
repeats its tasks.

Edge cases: a null or empty text gives the end id alone; a text that holds an added token of the vocabulary (such as an
end mark) gets its id there, as the library does at its defaults; equal or null document ids are kept as separate
documents, in the order of their text's hash, null first; a segment always holds whole documents, a very long one too; an
empty table gives no segments; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import pieces, process_state, table, written
from cohortframe.llm.registry import query

MAGIC = b"CFID"
HEADER = "<4sBxxxIQQ"  # magic, bits, block, documents, ids
BLOCK = 4096
SEGMENT_IDS = 1 << 18
MEMO_WORDS = 300_000
JOINED = 1000  # chunks encoded as one text
# White space of the vocabulary's own splitting rule (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
CHUNK = re.compile(f" ?[{LETTERS}]+(?=[ \n.,;:!?]|$)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PLAIN = re.compile(f" ?[^{SPACE}]+")
LETTERED = re.compile(f" ?[{LETTERS}]+")
NEWLINE = "\n"


def width(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 to ``vocabulary - 1``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive little-endian fields of ``bits`` bits; the last byte is filled up with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(fields.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_fields(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    fields = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return fields @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray], bits: int) -> bytes:
    starts = np.cumsum([0, *map(len, ids)], dtype="<u8")
    stream = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = [pack(stream[at : at + BLOCK], bits) for at in range(0, len(stream), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    names = np.array([0 if x is None else x for x in doc_ids], "<i8")
    missing = np.array([x is None for x in doc_ids], np.uint8)
    head = struct.pack(HEADER, MAGIC, bits, BLOCK, len(doc_ids), len(stream))
    return b"".join([head, names.tobytes(), missing.tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class Segment:
    """A packed segment, read in place."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.bits, self.block, n, self.n_ids = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a packed segment")
        at = struct.calcsize(HEADER)
        names = np.frombuffer(data, "<i8", n, at)
        missing = np.frombuffer(data, np.uint8, n, at := at + 8 * n)
        self.doc_ids = [None if gone else int(x) for x, gone in zip(names, missing)]
        self.starts = np.frombuffer(data, "<u8", n + 1, at := at + n).astype(np.int64)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at := at + 8 * (n + 1)).astype(np.int64)
        self.base = at + 8 * (n_blocks + 1)

    def unpack(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end - 1`` of the segment; only the blocks that hold them are touched."""
        if end <= start:
            return np.zeros(0, np.uint32)
        out = []
        for k in range(start // self.block, (end - 1) // self.block + 1):
            n = min(self.block, self.n_ids - k * self.block)
            data = self.data[self.base + self.offsets[k] : self.base + self.offsets[k + 1]]
            out.append(unpack_fields(data, self.bits, n))
        first = start // self.block * self.block
        return np.concatenate(out)[start - first : end - first]

    def document(self, i: int) -> np.ndarray:
        return self.unpack(int(self.starts[i]), int(self.starts[i + 1]))


def added_tokens(tokenizer) -> tuple[list[str], bool, re.Pattern]:
    """Contents of the added tokens, whether some match more than their content, and a pattern that splits at them."""
    found = tokenizer.get_added_tokens_decoder().values()
    contents = sorted((x.content for x in found), key=len, reverse=True)
    whole = any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in found)
    return contents, whole, re.compile("(" + "|".join(map(re.escape, contents)) + ")")


def word_model(tokenizer):
    """For a byte-level vocabulary that splits by its own rule: the library's model, which encodes single words, and the
    byte-level form of each character of ``LETTERED`` chunks, which that rule never splits. Else null."""
    from tokenizers.pre_tokenizers import ByteLevel

    rule = tokenizer.pre_tokenizer
    if tokenizer.normalizer is not None or not isinstance(rule, ByteLevel) or rule.add_prefix_space or not rule.use_regex:
        return None
    form = ByteLevel(add_prefix_space=False, use_regex=False)
    letters = [x for x in map(chr, range(256)) if x == " " or LETTERED.fullmatch(x)]
    return tokenizer.model, {ord(x): form.pre_tokenize_str(x)[0][0] for x in letters}


def encoder(vocabulary: str):
    """A function from texts to the little-endian 32-bit ids of each, by the tokenizers library.

    The vocabulary never joins text over a space that lies between two other characters, nor a letter with a mark behind
    it, so a text may be encoded in such chunks; a chunk met before is not encoded again. Added tokens of the vocabulary
    are cut out before, as the library does; a text with one that also takes up its surroundings is encoded whole. What was
    met is kept by the worker process: of up to ``MEMO_WORDS`` chunks, and of as many before them, which are dropped unless
    met again; this changes speed only.
    """
    from tokenizers import Tokenizer

    state = process_state("encoder")
    if state.get("vocabulary") != hash(vocabulary):
        tokenizer = Tokenizer.from_str(vocabulary)
        state.update(vocabulary=hash(vocabulary), tokenizer=tokenizer, memo={}, old={}, added=added_tokens(tokenizer))
        state["newline"] = tokenizer.encode(NEWLINE, add_special_tokens=False).ids
        state["words"] = word_model(tokenizer)
    tokenizer, newline, (added, whole, marks) = state["tokenizer"], state["newline"], state["added"]

    def learn(memo: dict[str, bytes], new: set[str]) -> None:
        """Chunks of letters go to the model as words; others without white space but a leading space are encoded as one
        text with line ends between them."""
        if state["words"]:
            model, form = state["words"]
            words = [x for x in new if LETTERED.fullmatch(x) and x not in added]
            for word, bytewise in zip(words, NEWLINE.join(words).translate(form).split(NEWLINE)):
                ids = [x.id for x in model.tokenize(bytewise)]
                memo[word] = struct.pack(f"<{len(ids)}I", *ids)
            new.difference_update(words)
        plain = [x for x in new if PLAIN.fullmatch(x) and x not in added] if len(newline) == 1 else []
        for at in range(0, len(plain), JOINED):
            part = plain[at : at + JOINED]
            text = NEWLINE.join(part) + NEWLINE
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == newline[0])
            if len(ends) != len(part):
                raise ValueError("the vocabulary joins line ends with words")
            data = ids.tobytes()
            for word, start, end in zip(part, [0, *(4 * (ends[:-1] + 1)).tolist()], (4 * ends).tolist()):
                memo[word] = data[start:end]
        new.difference_update(plain)
        rest = list(new)
        for word, found in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            memo[word] = np.array(found.ids, "<u4").tobytes()

    def chunked(text: str) -> list[str]:
        if not any(x in text for x in added):
            return CHUNK.findall(text)
        if whole:
            return [text]
        return [x for i, part in enumerate(marks.split(text)) for x in ([part] if i % 2 else CHUNK.findall(part))]

    def encode(texts: list[str]) -> list[bytes]:
        chunks = [chunked(x) for x in texts]
        if len(state["memo"]) > MEMO_WORDS:
            state.update(memo={}, old=state["memo"])
        memo, old = state["memo"], state["old"]
        new = set().union(*chunks).difference(memo)
        again = [x for x in new if x in old]
        memo.update(zip(again, map(old.__getitem__, again)))
        new.difference_update(again)
        if new:
            learn(memo, new)
        return [b"".join(map(memo.__getitem__, found)) for found in chunks]

    return encode


def write_ids(docs: DataFrame, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the packed segments; returns the written table.

    Columns: part (order of the files), segment (order in the part), start (ids before it in its part), n_docs, n_ids,
    data. The tokenizer's file is read by the driver and sent along (its size is that of the vocabulary).
    """
    from tokenizers import Tokenizer

    with open(tokenizer_file, encoding="utf-8") as file:
        vocabulary = file.read()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    bits = width(Tokenizer.from_str(vocabulary).get_vocab_size(with_added_tokens=True))
    last = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(sent.value), TaskContext.get().partitionId()
        names: list[int | None] = []
        held: list[np.ndarray] = []
        segment = start = size = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()),
                "start": pa.array([start], pa.int64()), "n_docs": pa.array([len(names)], pa.int64()),
                "n_ids": pa.array([size], pa.int64()), "data": pa.array([pack_segment(names, held, bits)], pa.binary()),
            })

        for batch in pieces(batches, "text"):
            texts = ["" if x is None else x for x in batch["text"].to_pylist()]
            for name, ids in zip(batch["doc_id"].to_pylist(), encode(texts)):
                names.append(name)
                held.append(np.frombuffer(ids + last, "<u4"))
                size += len(held[-1])
                if size >= SEGMENT_IDS:
                    yield row()
                    segment, start, size, names, held = segment + 1, start + size, 0, [], []
        if names:
            yield row()

    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "part int, segment int, start long, n_docs long, n_ids long, data binary"
    return written(ordered.mapInArrow(write, schema), "ids")


def read_ids(segments: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, bits.

    Only one number per file, its count of ids, goes through the driver.
    """
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, offsets = 0, []
    for part, n in totals:
        offsets.append((part, before))
        before += n
    files = segments.sparkSession.createDataFrame(offsets, "part int, before long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, before, data in zip(*(batch[x].to_pylist() for x in ("start", "before", "data"))):
                segment = Segment(data)
                ids = segment.unpack(0, segment.n_ids).astype("<u4")
                at = segment.starts.tolist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(segment.doc_ids, pa.int64()),
                    "start": pa.array(segment.starts[:-1] + (start + before)),
                    "n_tokens": pa.array(np.diff(segment.starts)),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:])], pa.int64()),
                    "bits": pa.array([segment.bits] * len(segment.doc_ids), pa.int32()),
                })

    placed = segments.select("part", "start", "data").join(F.broadcast(files), "part").select("start", "before", "data")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, bits int")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_token_output")
def op2(spark, folder):
    return read_ids(write_ids(table(spark, folder, "documents"), default_tokenizer(), end_id=0))
