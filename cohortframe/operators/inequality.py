"""Joins by an inequality between two columns, with or without equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortframe.operators.joins import join_null_safe
from cohortframe.session import bounded, stage

CHUNK_ROWS = 4_096
BUCKETS = 256  # most value ranges of a key; ranges of more rows are cut by row
CELL = ["__lb", "__ls", "__rb", "__rs"]


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "!=": a != b}[op]


def inequality_join(
    left: DataFrame, right: DataFrame, x: str, op: str, y: str, keys: list[str] | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Pairs of rows with equal ``keys`` (none: all rows) and ``x op y``, for <, <=, >, >= or !=.

    ``x`` and ``y`` are numbers. Returns the left columns, then the right ones without the keys; a name the left side has
    too ends in ``_right``. Rows without a value or key pair with nothing; repeated rows pair each.

    Keys of up to ``chunk_rows`` rows a side are an ordinary join. Rows of larger ones (or all rows, without keys) are cut
    into value ranges of some ``chunk_rows`` and ranges of one frequent value into parts of that size. A row goes to the
    cells of its part and each part of the other side that the inequality can reach, so that every cell is a bounded
    join, parts that cannot match never meet and a row is sent once per ``chunk_rows`` rows it can pair with.
    """
    by = list(keys or [])
    names = {c: f"{c}_right" if c in left.columns else c for c in right.columns if c not in by}
    if not by:
        by, left, right = ["__all"], left.withColumn("__all", F.lit(0)), right.withColumn("__all", F.lit(0))
    left, right = left.dropna(subset=[*by, x]), right.dropna(subset=[*by, y])
    counts = [df.groupBy(*by).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "__nl"), (right, "__nr"))]
    most = F.greatest("__nl", "__nr")
    large, _ = bounded(counts[0].join(counts[1], by).filter(most > chunk_rows).select(*by, most.alias("__n")))
    if large.isEmpty():
        return _matched(left, right, x, op, y, by, [], names)
    cold = [df.join(large.select(*by), by, "left_anti") for df in (left, right)]
    # row numbers place a row in its part: they are written, so that a repeated task gives the same ones
    hot = [
        stage(df.join(large.select(*by), by, "left_semi").withColumn("__row", F.monotonically_increasing_id()))
        for df in (left, right)
    ]
    cells = _cells(hot[0], hot[1], x, op, y, by, large, chunk_rows)
    return _matched(*cold, x, op, y, by, [], names).unionByName(_matched(*cells, x, op, y, by, CELL, names))


def _matched(
    left: DataFrame, right: DataFrame, x: str, op: str, y: str, by: list[str], cell: list[str], names: dict[str, str]
) -> DataFrame:
    equal = [*by, *cell]
    other = right.select(*[F.col(c).alias(f"__r_{c}") for c in [*equal, *names]])
    condition = _compare(left[x], op, other[f"__r_{y}"])
    for c in equal:
        condition = condition & (left[c] == other[f"__r_{c}"])
    kept = [c for c in left.columns if c not in ("__all", "__row", *cell)]
    return left.join(other, condition).select(*kept, *[F.col(f"__r_{c}").alias(n) for c, n in names.items()])


def _cells(
    left: DataFrame, right: DataFrame, x: str, op: str, y: str, by: list[str], large: DataFrame, chunk_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides, once for each cell they take part in."""
    values = left.select(*by, F.col(x).cast("double").alias("v")).unionByName(
        right.select(*by, F.col(y).cast("double").alias("v"))
    )
    points = values.groupBy(*by).agg(
        F.percentile_approx("v", [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS).alias("__points")
    )
    ranges = F.least(F.lit(BUCKETS), F.greatest(F.lit(2), F.ceil(F.col("__n") / chunk_rows))).cast("int")
    splits, _ = bounded(
        points.join(large, by).withColumn("__ranges", ranges).select(
            *by,
            F.transform(
                F.sequence(F.lit(1), F.col("__ranges") - 1),
                lambda i: F.element_at("__points", F.floor(i * BUCKETS / F.col("__ranges")).cast("int")),
            ).alias("__splits"),
        )
    )

    def ranged(df: DataFrame, value: str) -> DataFrame:
        at = F.size(F.filter("__splits", lambda s: s < F.col(value).cast("double")))
        return join_null_safe(df, splits, by, "inner").withColumn("__at", at).drop("__splits")

    sides = ranged(left, x), ranged(right, y)
    part = F.struct(F.col("__at").alias("at"), F.ceil(F.col("__rows") / (2 * chunk_rows)).cast("int").alias("parts"))
    tables = [
        side.groupBy(*by, "__at").agg(F.count(F.lit(1)).alias("__rows")).groupBy(*by).agg(F.collect_list(part).alias(name))
        for side, name in zip(sides, ("__lparts", "__rparts"))
    ]
    parts, _ = bounded(tables[0].join(tables[1], by))
    reach = {"<": lambda l, r: r >= l, "<=": lambda l, r: r >= l, ">": lambda l, r: r <= l, ">=": lambda l, r: r <= l}
    meets = reach.get(op, lambda l, r: F.lit(True))

    def sent(df: DataFrame, own: str, others: str, reached, mine: list[str], theirs: list[str]) -> DataFrame:
        joined = join_null_safe(df, parts, by, "inner")
        place = F.filter(own, lambda p: p["at"] == F.col("__at"))[0]["parts"]
        partners = F.flatten(F.transform(
            F.filter(others, reached),
            lambda p: F.transform(F.sequence(F.lit(0), p["parts"] - 1), lambda k: F.struct(p["at"].alias("at"), k.alias("part"))),
        ))
        number = F.pmod(F.xxhash64("__row"), place).cast("int")
        spread = joined.withColumn("__part", number).withColumn("__to", F.explode(partners))
        return spread.select(
            *[c for c in df.columns if c != "__at"], F.col("__at").alias(mine[0]), F.col("__part").alias(mine[1]),
            F.col("__to.at").alias(theirs[0]), F.col("__to.part").alias(theirs[1]),
        )

    at = F.col("__at")
    return (
        sent(sides[0], "__lparts", "__rparts", lambda p: meets(at, p["at"]), CELL[:2], CELL[2:]),
        sent(sides[1], "__rparts", "__lparts", lambda p: meets(p["at"], at), CELL[2:], CELL[:2]),
    )
