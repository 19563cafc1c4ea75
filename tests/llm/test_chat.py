import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortframe.llm import chat

PARTS = st.lists(st.sampled_from(["\\", "### User:", "### Assistant:", "</turn>", "\n", " ", "a", '### role="x":', '### role="', "</tur", ":"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", 'odd "role"\n', "User"]), PARTS), max_size=4))
def test_round_trip(turns):
    out = "".join(chat.render(*turn)[0] for turn in turns)
    assert [(r, x) for r, x, _, _ in chat.parsed(out)] == turns


def test_mask_and_plain_text():
    out, start, end = chat.render("assistant", "fine # text \\ here")
    assert out[start:end] == "fine # text \\ here"
    with pytest.raises(ValueError):
        list(chat.parsed("### User:\nno end"))


def brute(rows):
    out = {}
    for conv, _turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    digests = {}
    for conv, turns in out.items():
        learned = "".join(x for r, x in turns if r == "assistant")
        joined = "".join(f"{r}\n{x}\n" for r, x in turns)
        digests[conv] = (len(turns), hashlib.sha256(joined.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return digests


def test_edges(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", "😀 ok"), (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "user", "hi"), (3, None, "tool", ""),
        (3, 0, "assistant", chat.TRICK * 3), (4, 0, "assistant", "long " * 200_000), (5, 0, "we\nird", "</turn>"),
    ]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "conv_id long, turn long, role string, text string, seq string, formatted string")
    got = {r.conv_id: tuple(r[1:5]) for r in chat.read_conversations(chat.format_conversations(df)).collect()}
    assert got == brute(rows)
    assert chat.read_conversations(chat.format_conversations(df.limit(0))).count() == 0


def test_runs_of_backslashes_take_one_look():
    """Patterns that begin at a run of backslashes find what ones that may begin anywhere find, and a megabyte takes no time."""
    import random
    import re
    import time

    active, escaped = re.compile(rf"(\\*)({chat.CONTROL})"), re.compile(rf"\\(\\*(?:{chat.CONTROL}))")
    draw = random.Random(3)
    parts = ["\\", "\\\\", "</turn>", "### User:", '### role="a\\"b":', "x", "\n", '"', "### role="]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(12)))
        assert chat.escaped(text) == active.sub(r"\\\1\2", text) and chat.unescaped(text) == escaped.sub(r"\1", text)
        assert [m.span() for m in chat.ACTIVE.finditer(text)] == [m.span() for m in active.finditer(text)]
    start = time.time()
    for text in ("\\" * 1_000_000, "\\" * 1_000_000 + "</turn>", ("\\" * 1000 + "x") * 1000):
        body, begin, end = chat.render("user", text)
        assert [t for _, t, _, _ in chat.parsed(body)] == [text]
    assert time.time() - start < 20
