"""Inequality joins against all pairs, with large keys cut into cells and without."""

import operator
import random

import pytest

from cohortframe.operators.inequality import inequality_join

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "!=": operator.ne}


def sides():
    draw = random.Random(5)
    rows = []
    for side in range(2):
        made = [("hot", 3.0, i) for i in range(40)]  # one value holds a third of the rows
        made += [("hot", float(draw.randint(0, 30)), 100 + i) for i in range(70)]
        made += [("cold", float(draw.randint(0, 5)), 300 + i) for i in range(6 + side)]
        made += [(None, 1.0, 400), ("hot", None, 401), (f"only{side}", 1.0, 402), ("hot", 3.0, 1), ("cold", 2.0, 300)]
        rows.append(made)
    return rows


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("keys", [["g"], []])
def test_pairs_by_brute_force(spark, op, keys):
    a, b = sides()
    left = spark.createDataFrame(a, "g string, x double, i int")
    right = spark.createDataFrame(b, "g string, y double, i int")
    want = sorted(
        (p[2], q[2]) for p in a for q in b
        if None not in (p[1], q[1]) and OPS[op](p[1], q[1]) and (not keys or (p[0] is not None and p[0] == q[0]))
    )
    for chunk_rows in (8, 1_000):
        found = inequality_join(left, right, "x", op, "y", keys, chunk_rows)
        assert found.columns == (["g", "x", "i", "y", "i_right"] if keys else ["g", "x", "i", "g_right", "y", "i_right"])
        assert sorted((r.i, r.i_right) for r in found.collect()) == want


def test_empty_sides(spark):
    some = spark.createDataFrame([(i, i) for i in range(30)], "k int, x int")
    none = some.filter("false")
    for left, right in ((some, none), (none, some), (none, none)):
        assert inequality_join(left, right, "x", "<", "x", [], 4).count() == 0
