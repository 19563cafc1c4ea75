"""Analysis samples: wave counts, dropout, retention, balanced panels, draws per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortframe.functions.clean import any_missing
from cohortframe.functions.draws import hash_uniform
from cohortframe.operators.ranks import add_ranks
from cohortframe.operators.reshape import densify
from cohortframe.session import bounded


def analysis_samples(wide: DataFrame, ids: list[str], waves: list[str]) -> DataFrame:
    """``all`` for everyone and ``balanced`` for members with no wave missing, one row each."""
    labels = F.when(any_missing([F.col(w) for w in waves]), F.array(F.lit("all"))).otherwise(
        F.array(F.lit("all"), F.lit("balanced"))
    )
    return wide.select(*ids, F.explode(labels).alias("sample"))


def missing_by_wave(wide: DataFrame, ids: list[str], waves: list[str]) -> DataFrame:
    """Ids missing each wave."""
    gaps = F.array_compact(F.array(*[F.when(F.col(w).isNull(), F.lit(w)) for w in waves]))
    return wide.select(*ids, F.explode(gaps).alias("wave"))


def min_observations(df: DataFrame, ids: list[str], least: int) -> DataFrame:
    """Rows of ids with at least ``least`` rows.

    Counts are aggregated first and joined back, so a person with very many rows is never one window partition.
    """
    enough = df.groupBy(*ids).agg(F.count(F.lit(1)).alias("__k")).filter(F.col("__k") >= least).select(*ids)
    return df.join(enough, ids, "left_semi")


def dropout_wave(long: DataFrame, group: str, ident: str, age: str, value: str) -> DataFrame:
    """Per id the first age with a value whose next wave in the group has none."""
    dense = densify(long.select(group, ident, age, value), group, ident, age)
    order = Window.partitionBy(group, ident).orderBy(age)
    last = F.col(value).isNotNull() & F.lead(value).over(order).isNull()
    marked = dense.withColumn("__last", F.when(last, F.col(age)))
    return marked.groupBy(group, ident).agg(F.min("__last").alias("last_age")).dropna(subset=["last_age"])


def retention(long: DataFrame, group: str, ident: str, max_waves: int) -> DataFrame:
    """Percent of members with at least k waves, one column per k."""
    per_id = long.groupBy(group, ident).agg(F.count(F.lit(1)).alias("fups"))
    per_k = per_id.groupBy(group, "fups").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    share = per_k.withColumn("prop", 100 * F.col("n") / F.sum("n").over(w))
    before = w.orderBy("fups").rowsBetween(Window.unboundedPreceding, -1)
    kept = share.withColumn("kept", 100 - F.coalesce(F.sum("prop").over(before), F.lit(0.0)))
    return kept.groupBy(group).agg(
        *[F.max(F.when(F.col("fups") == k, F.col("kept"))).alias(f"waves_{k}") for k in range(1, max_waves + 1)]
    )


def sample_per_group(df: DataFrame, group: str, ident: str, k: int, seed: int = 1) -> DataFrame:
    """k ids per group in the order of a hash draw.

    The ids that can qualify are cut down by a partial top-k per slice before the final order within the group.
    """
    slices = 64
    drawn = df.select(group, ident).distinct().withColumn("__u", hash_uniform(F.col(ident), F.lit(0), seed))
    drawn = drawn.withColumn("__slice", F.pmod(F.xxhash64(ident), F.lit(slices)))
    within = Window.partitionBy(group, "__slice").orderBy("__u", ident)
    top = drawn.withColumn("__r", F.row_number().over(within)).filter(F.col("__r") <= k)
    overall = Window.partitionBy(group).orderBy("__u", ident)
    return top.withColumn("draw", F.row_number().over(overall)).filter(F.col("draw") <= k).select(group, ident, "draw")


def normalised_weight(df: DataFrame, weight: str, out: str) -> DataFrame:
    """Weights scaled to mean 1: w * N / sum of w, from one global aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("total")).first()
    factor = row["n"] / row["total"] if row["total"] else None
    return df.withColumn(out, F.col(weight) * F.lit(factor).cast("double"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in a given order, as an aggregate: min of (order, rest) keeps one row per key and task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.min(F.struct(*order, *rest)).alias("r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"r.{c}").alias(c) for c in [*order, *rest]])


def group_extreme(df: DataFrame, group: list[str], value: str, which: str = "both") -> DataFrame:
    """Rows at the group's minimum and/or maximum."""
    ends, _ = bounded(df.groupBy(*group).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")))
    hit_low, hit_high = F.col(value) == F.col("__lo"), F.col(value) == F.col("__hi")
    test = {"min": hit_low, "max": hit_high, "both": hit_low | hit_high}[which]
    return df.join(ends, group).filter(test).drop("__lo", "__hi")


def top_rows(df: DataFrame, by: list[str], x: str, n: int) -> DataFrame:
    """Rows whose rank of x within the group is at most n, ties kept."""
    return add_ranks(df, x, by).filter(F.col("__rank") <= n).select(*df.columns)
