import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CLASHES = ("size", "score", "rank", "node", "log_bytes", "copies", "row", "_text", "shard", "label", "target", "source_size", "list", "start")
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000)) + "x" * 50_000
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, LONG, "en", "b"), (5, "One two three four five six seven.", "en", "b"),
    (5, "One two three four five six seven.", "en", "b"), (6, "one TWO three four five six seven.", "de", "b"), (None, "No id here at all.", None, None),
    (7, "x", "en", "c"), (8, "Mail me: jo.doe@mail.example.com or +1 (555) 010-9999, 10.0.0.255", "en", "c"), (9, "ÉÈ ñandú 漢字 😀 end", "fr", "ü"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty, blank, very long and repeated texts, and further columns whose names clash."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, len(r[1] or ""), *("z" for _ in CLASHES)) for r in ROWS], schema)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
