"""Merges with left precedence, keyed folds and lookups, and joins that survive hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.session import bounded


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which a null key matches a null key; the right side adds its other columns."""
    if not keys:
        raise ValueError("a join needs at least one key")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def attach_stats(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Join group statistics to rows. ``stats`` comes from ``bounded``: broadcast when its size was checked."""
    if not keys:
        row = stats.first()
        return df.withColumns({c: F.lit(row[c]).cast(stats.schema[c].dataType) for c in stats.columns})
    return join_null_safe(df, stats, keys, "left")


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """One row per key, or the job fails.

    Rows are partitioned by the merge key once; the aggregate and the join that follows both work on that partitioning.
    A repeated key streams through the sorted aggregate, however often it occurs, and fails there.
    """
    others = [c for c in df.columns if c not in keys]
    grouped = df.repartition(*keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.any_value(F.col(c)).alias(c) for c in others]
    )
    message = f"merge key is not unique in {what}"
    return grouped.filter(F.assert_true(F.col("__rows") == 1, message).isNull()).select(*df.columns)


def _merge(left: DataFrame, right: DataFrame, keys: list[str], flag: str | None) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    right_only = [c for c in right.columns if c not in left.columns]
    r = right.withColumnsRenamed({c: f"__r_{c}" for c in shared}).withColumn("__in_right", F.lit(True))
    joined = left.withColumn("__in_left", F.lit(True)).join(r, keys, "outer")
    in_left = F.col("__in_left").isNotNull()
    in_right = F.col("__in_right").isNotNull()
    columns = [
        F.when(in_left, F.col(c)).otherwise(F.col(f"__r_{c}")).alias(c) if c in shared else F.col(c)
        for c in left.columns
    ]
    columns += [F.col(c) for c in right_only]
    if flag:
        columns.append(F.when(in_left & in_right, 3).when(in_left, 1).otherwise(2).cast("int").alias(flag))
    return joined.select(*columns)


def merge_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], flag: str | None = None) -> DataFrame:
    """Full outer merge on a key unique on both sides.

    For columns both sides have, the left value stands wherever the left side has the row, even if it is null.
    ``flag`` names a column with 1 = left only, 2 = right only, 3 = both.
    """
    return _merge(require_unique(left, keys, "left table"), require_unique(right, keys, "right table"), keys, flag)


HOT_ROWS = 1_000_000
HOT_SHARE = 1_000


def hot_keys(df: DataFrame, keys: list[str], least: int = HOT_ROWS) -> DataFrame | None:
    """Keys that hold more than 1/1000 of the rows (and more than ``least`` rows): at most 1000 of them, or None."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    total, top = counts.agg(F.sum("__rows"), F.max("__rows")).first()
    limit = max(least, (total or 0) // HOT_SHARE)
    if (top or 0) <= limit:
        return None
    return bounded(counts.filter(F.col("__rows") > limit).select(*keys), 2 * HOT_SHARE)[0]


def merge_many_to_one(
    left: DataFrame, right: DataFrame, keys: list[str], flag: str | None = None, least: int = HOT_ROWS
) -> DataFrame:
    """Full outer merge on a key unique on the right side only.

    Left rows look their match up, hot left keys through a bounded broadcast; right rows without a left row follow by
    an anti join against the distinct left keys.
    """
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    right_only = [c for c in right.columns if c not in left.columns]
    unique = require_unique(right, keys, "right table")
    known = unique.dropna(subset=keys)
    table = known.select(*keys, *right_only).withColumn("__in_right", F.lit(True))
    hot = hot_keys(left, keys, least)
    if hot is not None:
        hot, _ = bounded(table.join(hot, keys, "left_semi"), 2 * HOT_SHARE)
    matched = lookup_hot(left, table, keys, hot)
    marks = {flag: F.when(F.col("__in_right"), 3).otherwise(1).cast("int")} if flag else {}
    matched = matched.withColumns(marks).drop("__in_right")
    alone = unique.join(left.select(*keys).distinct(), keys, "left_anti").select(*keys, *shared, *right_only)
    if flag:
        alone = alone.withColumn(flag, F.lit(2))
    return matched.unionByName(alone, allowMissingColumns=True)


def full_reduce(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Fold tables by full outer join on shared keys; every join reuses the same hash partitioning."""
    return reduce(lambda a, b: a.join(b, keys, "outer"), tables)


def align_on_key(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Combine column blocks of the same rows, always by key."""
    return reduce(lambda a, b: a.join(b, keys, "inner"), tables)


def flag_membership(df: DataFrame, members: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """0/1 column: is the key in ``members``? Rows of ``df`` stay as they are."""
    marks = members.select(*keys).distinct().withColumn(flag, F.lit(1))
    return df.join(marks, keys, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(0)))


def lookup_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """Left join to a table with unique keys when a few left keys hold a large share of the rows.

    ``hot`` holds the rows of ``right`` for those keys (bounded by the caller). They are broadcast; left rows that
    found theirs are spread by a salt, so no task gets a whole hot key.
    """
    if hot is None:
        return join_null_safe(left, right, keys, "left")
    values = [c for c in right.columns if c not in keys]
    pre = hot.withColumnsRenamed({c: f"__h_{c}" for c in values}).withColumn("__hot", F.lit(True))
    marked = join_null_safe(left, F.broadcast(pre), keys, "left")
    salt = F.when(F.col("__hot"), 1 + F.pmod(F.xxhash64(*left.columns), F.lit(4096))).otherwise(F.lit(0))
    marked = marked.withColumn("__salt", salt.cast("long"))
    cold = right.withColumn("__salt", F.lit(0).cast("long"))
    joined = join_null_safe(marked, cold, [*keys, "__salt"], "left")
    picked = [F.coalesce(F.col(f"__h_{c}"), F.col(c)).alias(c) for c in values]
    return joined.select(*left.columns, *picked)


def interpolate_by_age(
    df: DataFrame, reference: DataFrame, by: list[str], age: str, values: list[str]
) -> DataFrame:
    """Attach reference values linearly interpolated in age within ``by``; null outside the table's ages.

    The reference table must be small (checked): it becomes one broadcast row per ``by`` with its ages in order, and each row
    finds its bracket in that array, so the big side is never shuffled or paired with several candidates.
    """
    reference, small = bounded(reference)
    if not small:
        raise ValueError("the reference table is too large to look ages up in")
    node = F.struct(F.col(age).cast("double").alias("a"), *[F.col(v).cast("double").alias(v) for v in values])
    nodes, _ = bounded(reference.groupBy(*by).agg(F.sort_array(F.collect_list(node)).alias("__nodes")))
    joined = join_null_safe(df, nodes, by, "left")
    x = F.col(age).cast("double")
    below = F.filter("__nodes", lambda n: n["a"] <= x)
    above = F.filter("__nodes", lambda n: n["a"] >= x)
    joined = joined.withColumn("__lo", F.try_element_at(below, F.lit(-1))).withColumn(
        "__hi", F.try_element_at(above, F.lit(1))
    )
    gap = F.col("__hi.a") - F.col("__lo.a")
    share = F.when(gap > 0, (x - F.col("__lo.a")) / gap).when(gap == 0, F.lit(0.0))
    for v in values:
        joined = joined.withColumn(v, F.col(f"__lo.{v}") + share * (F.col(f"__hi.{v}") - F.col(f"__lo.{v}")))
    return joined.drop("__nodes", "__lo", "__hi")
