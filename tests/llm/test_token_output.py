import json
import zlib

import numpy as np
import pytest

from cohortframe.llm import token_output as t


@pytest.mark.parametrize("bits", [1, 7, 8, 11, 16, 17, 19, 32])
def test_pack_round_trip_and_random_access(bits):
    draw = np.random.default_rng(bits)
    ids = [draw.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 5000, 9000, 3)]
    segment = t.Segment(t.pack_segment([4, None, 7, 7, 9], ids, bits))
    stream = np.concatenate(ids)
    assert segment.doc_ids == [4, None, 7, 7, 9] and segment.n_ids == len(stream)
    for i, x in enumerate(ids):
        assert np.array_equal(segment.document(i), x)
    for a, b in ((0, 1), (4095, 4097), (8192, 9001), (14000, 14004), (5, 5)):
        assert np.array_equal(segment.unpack(a, b), stream[a:b])


def test_width():
    assert [t.width(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(t.default_tokenizer())
    out, at = [], 0
    for name, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((name, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_whole_texts(documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    got = t.read_ids(t.write_ids(documents, t.default_tokenizer())).drop("bits").collect()
    assert sorted(map(tuple, got)) == expected(rows)


TRICKY = [
    "a  b\n\nc \n d\t e", "don't we'll 'tis it's", "x.y,z; (q) \"r\" end.", " lead", "trail ", "\x1c\x85  wide　space", "<|endoftext|> in text",
    "a <|endoftext|> b", "a<|endoftext|><|endoftext|>\n b", "x <|endoftext| y<|endoftext|>",
    "é.ü!ß? ñ:  ,,", "naïve's 12 34.5 a1b2", "😀😀 漢字 ok.\r\n", "a×b a÷b c.", "",
]


def test_chunks_encode_like_whole_texts():
    encode = t.encoder(open(t.default_tokenizer(), encoding="utf-8").read())
    for text, ids in zip(TRICKY, encode(TRICKY)):
        assert zlib.crc32(ids + b"\0\0\0\0") == expected([(0, text)])[0][3], repr(text)


def test_edges(edge, empty):
    got = t.read_ids(t.write_ids(edge, t.default_tokenizer())).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    assert got[1].n_tokens == got[2].n_tokens == 1
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    assert t.read_ids(t.write_ids(empty, t.default_tokenizer())).count() == 0


def vocabulary(**changes):
    return json.dumps(json.loads(open(t.default_tokenizer(), encoding="utf-8").read()) | changes)


def test_letters_go_to_the_model_and_chunks_met_again_outlive_a_full_memo(monkeypatch):
    letters = "".join(x for x in map(chr, range(256)) if t.LETTERED.fullmatch(x) and x != " ")
    texts = [" ".join(a + b for b in letters) for a in letters] + ["oft Mot", "fünf oft", "Größe où", "oft"]
    monkeypatch.setattr(t, "MEMO_WORDS", 2)
    encode = t.encoder(vocabulary())
    state = t.process_state("encoder")
    state.update(memo={}, old={})
    for text in texts:
        assert zlib.crc32(encode([text])[0] + b"\0\0\0\0") == expected([(0, text)])[0][3], text
    assert set(state["memo"]) == {"Größe", " où", "oft"} and set(state["old"]) == {"oft", " Mot", "fünf", " oft"}
    state.update(memo={}, old={"Mot": b"kept"})
    assert encode(["Mot"]) == [b"kept"] and state["memo"] == {"Mot": b"kept"}
    state.clear()


def test_only_a_plain_byte_level_rule_gives_a_word_model():
    from tokenizers import Tokenizer

    rule = json.loads(vocabulary())["pre_tokenizer"]
    assert t.word_model(Tokenizer.from_str(vocabulary()))
    for changes in ({"pre_tokenizer": rule | {"add_prefix_space": True}}, {"pre_tokenizer": rule | {"use_regex": False}},
                    {"pre_tokenizer": None}, {"normalizer": {"type": "Lowercase"}}):
        assert t.word_model(Tokenizer.from_str(vocabulary(**changes))) is None


def test_texts_with_a_mark_that_takes_up_its_surroundings():
    from tokenizers import Tokenizer

    mark = json.loads(vocabulary())["added_tokens"][0] | {"lstrip": True}
    texts = [" two\nlines  <|endoftext|> end", " one <|endoftext|>", " two\nlines"]
    tokenizer = Tokenizer.from_str(vocabulary(added_tokens=[mark]))
    want = [np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert t.encoder(vocabulary(added_tokens=[mark]))(texts) == want
