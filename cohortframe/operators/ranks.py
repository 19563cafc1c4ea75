"""Ranks, ridits, z-scores and quantiles within groups of any size.

A group here is often a whole cohort, i.e. a large share of all rows. Group moments are aggregates joined back. Ranks
of moderate groups use a window; beyond ``max_group_rows`` they are built from counts per distinct value, cut into
value ranges so that no task sorts a whole group, and joined back with hot values broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortframe.operators.joins import attach_stats, join_null_safe, lookup_hot
from cohortframe.session import bounded

MAX_GROUP_ROWS = 2_000_000
CELLS = 32
HOT_SHARE = 1_000


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(F.when(x.isNotNull(), w) * x) / F.sum(F.when(x.isNotNull(), w))


def group_stats(df: DataFrame, x: str, by: list[str], weight: str | None = None) -> tuple[DataFrame, bool]:
    """n, mean and sd of non-null x per group. Weighted: variance has denominator (sum of weights - 1)."""
    n = F.count(F.col(x)).alias("__n")
    if weight is None:
        grouped = df.groupBy(*by).agg(n, F.avg(x).alias("__mean"), F.stddev_samp(x).alias("__sd"))
        return bounded(grouped)
    w, v = F.col(weight), F.col(x)
    total = F.sum(F.when(v.isNotNull(), w))
    means, _ = bounded(df.groupBy(*by).agg(n, weighted_mean(v, w).alias("__mean"), total.alias("__w")))
    centred = attach_stats(df.select(*by, x, weight), means, by)
    spread, _ = bounded(
        centred.groupBy(*by, "__n", "__mean", "__w").agg(
            F.sum(w * F.pow(v - F.col("__mean"), 2)).alias("__ss")
        )
    )
    out = spread.withColumn("__sd", F.when(F.col("__w") > 1, F.sqrt(F.col("__ss") / (F.col("__w") - 1))))
    return bounded(out.select(*by, "__n", "__mean", "__sd"))


def add_zscore(df: DataFrame, x: str, by: list[str], out: str, weight: str | None = None) -> DataFrame:
    stats, _ = group_stats(df, x, by, weight)
    z = F.when(F.col("__sd") != 0, (F.col(x) - F.col("__mean")) / F.col("__sd"))
    return attach_stats(df, stats, by).withColumn(out, z).drop("__n", "__mean", "__sd")


def _cell(x: Column, splits: Column) -> Column:
    """Position of x among nested split points: coarse block first, then place within the block."""
    block = F.size(F.filter(F.transform(splits, lambda b: b[0]), lambda head: head < x))
    inside = F.when(
        block > 0, F.size(F.filter(F.element_at(splits, F.greatest(block, F.lit(1))), lambda s: s < x))
    ).otherwise(F.lit(0))
    return (block * 4096 + inside).cast("int")


def value_ranks(df: DataFrame, x: str, by: list[str], cells: int = CELLS) -> tuple[DataFrame, DataFrame | None]:
    """One row per group and distinct value: __ties, __rank (minimum rank), __dense; plus the rows of hot values."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("__ties"))
    points = cells * cells
    grid = [i / points for i in range(points)]
    shape, small = bounded(
        counts.groupBy(*by).agg(
            F.percentile_approx(x, grid, 10 * points).alias("__points"),
            F.max("__ties").alias("__top"),
            F.sum("__ties").alias("__all"),
        )
    )
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.slice("__points", i * cells + 1, F.lit(cells))
    )
    shape = shape.withColumn("__splits", blocks)
    lookup = shape.select(*by, "__splits")
    if not by:
        first = lookup.first()["__splits"] or []
        celled = counts.withColumn("__splits", F.lit(first) if first else F.array(F.array(F.lit(0.0))))
    else:
        celled = join_null_safe(counts, F.broadcast(lookup) if small else lookup, by, "inner")
    celled = celled.withColumn("__cell", _cell(F.col(x), F.col("__splits"))).drop("__splits")
    totals = celled.groupBy(*by, "__cell").agg(
        F.sum("__ties").alias("__rows"), F.count(F.lit(1)).alias("__values")
    )
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets, _ = bounded(
        totals.select(
            *by,
            "__cell",
            F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
            F.coalesce(F.sum("__values").over(before), F.lit(0)).alias("__values_before"),
        )
    )
    inner = Window.partitionBy(*by, "__cell").orderBy(x)
    running = F.coalesce(F.sum("__ties").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = join_null_safe(celled, offsets, [*by, "__cell"], "inner").select(
        *by,
        x,
        "__ties",
        (F.col("__rows_before") + running + 1).alias("__rank"),
        (F.col("__values_before") + F.row_number().over(inner)).alias("__dense"),
    )
    total = shape.agg(F.sum("__all"), F.max("__top")).first()
    limit = max(1, (total[0] or 0) // HOT_SHARE)
    hot = None
    if (total[1] or 0) > max(limit, 1):
        hot, _ = bounded(ranked.filter(F.col("__ties") > limit), max_rows=2 * HOT_SHARE)
    return ranked, hot


def rank_windows(x: str, by: list[str]) -> dict[str, Column]:
    """Ranks by window, nulls last and nulled out. Every window clusters on ``by``, so several variables share one
    shuffle."""
    keys = [F.col(b) for b in by]
    order = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())
    ties = Window.partitionBy(*keys, F.col(x))
    known = F.col(x).isNotNull()
    return {
        "__rank": F.when(known, F.rank().over(order)),
        "__dense": F.when(known, F.dense_rank().over(order)),
        "__ties": F.when(known, F.count(F.lit(1)).over(ties)),
    }


def add_ranks(
    df: DataFrame, x: str, by: list[str], max_group_rows: int = MAX_GROUP_ROWS, cells: int = CELLS
) -> DataFrame:
    """Adds __n, __mean, __sd of the group and __rank, __dense, __ties of the value; all null-aware."""
    stats, largest = many_stats(df, [x], by)
    names = {f"__n_{x}": "__n", f"__mean_{x}": "__mean", f"__sd_{x}": "__sd"}
    with_stats = attach_stats(df, stats.drop("__rows").withColumnsRenamed(names), by)
    if largest <= max_group_rows:
        return with_stats.withColumns(rank_windows(x, by))
    ranked, hot = value_ranks(df, x, by, cells)
    return lookup_hot(with_stats, ranked, [*by, x], hot)


def many_stats(df: DataFrame, columns: list[str], by: list[str]) -> tuple[DataFrame, int]:
    """n, mean, sd of several variables per group from one aggregate, and the size of the largest group."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for x in columns:
        aggs += [F.count(x).alias(f"__n_{x}"), F.avg(x).alias(f"__mean_{x}"), F.stddev_samp(x).alias(f"__sd_{x}")]
    stats, _ = bounded(df.groupBy(*by).agg(*aggs))
    return stats, stats.agg(F.max("__rows")).first()[0] or 0


HELPERS = ("__n", "__mean", "__sd", "__rank", "__dense", "__ties")


def score_columns(x: str) -> dict[str, Column]:
    """The score family from the helper columns of ``add_ranks``."""
    n, rank, ties = F.col("__n"), F.col("__rank"), F.col("__ties")
    known = F.col(x).isNotNull()
    return {
        "raw": F.col(x).cast("double"),
        "std": F.when(known & (F.col("__sd") != 0), (F.col(x) - F.col("__mean")) / F.col("__sd")),
        "rank": F.when(known & (n > 1), (rank - 1) / (n - 1)),
        "ridit": F.when(known, (rank - 1 + F.lit(0.5) * ties) / n),
        "dense": F.when(known, F.col("__dense")),
        "average": F.when(known, rank + (ties - 1) / 2.0),
    }


def add_scores(
    df: DataFrame, x: str, by: list[str], kinds: dict[str, str], max_group_rows: int = MAX_GROUP_ROWS,
    cells: int = CELLS,
) -> DataFrame:
    """Scores of x within groups: ``kinds`` maps raw / std / rank / ridit / dense / average to output names.

    Null stays null and does not count; a percent rank among one value is null.
    """
    ranked = add_ranks(df, x, by, max_group_rows, cells)
    scores = score_columns(x)
    return ranked.withColumns({out: scores[kind] for kind, out in kinds.items()}).drop(*HELPERS)


def weighted_value_ranks(df: DataFrame, x: str, by: list[str], weight: str, max_values: int = MAX_GROUP_ROWS) -> DataFrame:
    """Average rank of each distinct value under whole-number weights: mass below plus (own mass + 1) / 2.

    Large groups are cut into cells by the order of the values, as in ``value_ranks``.
    """
    values = df.groupBy(*by, x).agg(F.sum(weight).alias("__mass"))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__k"))
    largest = sizes.agg(F.max("__k")).first()[0] or 0
    if largest <= max_values:
        order = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
        below = F.coalesce(F.sum("__mass").over(order), F.lit(0.0))
        return values.select(*by, x, (below + (F.col("__mass") + 1) / 2).alias("__wrank"))
    points = CELLS * CELLS
    probs = [i / points for i in range(points)]
    splits, _ = bounded(values.groupBy(*by).agg(F.percentile_approx(x, probs, 10 * points).alias("__points")))
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.slice("__points", i * CELLS + 1, F.lit(CELLS))
    )
    celled = join_null_safe(values, splits.withColumn("__splits", blocks).drop("__points"), by, "inner")
    celled = celled.withColumn("__cell", _cell(F.col(x), F.col("__splits"))).drop("__splits")
    totals = celled.groupBy(*by, "__cell").agg(F.sum("__mass").alias("__total"))
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__before", F.coalesce(F.sum("__total").over(before), F.lit(0.0))).drop("__total")
    inner = Window.partitionBy(*by, "__cell").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    joined = join_null_safe(celled, offsets, [*by, "__cell"], "inner")
    below = F.col("__before") + F.coalesce(F.sum("__mass").over(inner), F.lit(0.0))
    return joined.select(*by, x, (below + (F.col("__mass") + 1) / 2).alias("__wrank"))


def add_scores_many(
    df: DataFrame, columns: dict[str, str], by: list[str], kinds: list[str], max_group_rows: int = MAX_GROUP_ROWS,
    cells: int = CELLS,
) -> DataFrame:
    """Scores of several variables within the same groups; outputs are ``<stub>_<kind>``.

    While groups are moderate all windows cluster on the same keys: one shuffle serves every variable.
    """
    stats, largest = many_stats(df, list(columns), by)
    out = attach_stats(df, stats.drop("__rows"), by) if largest <= max_group_rows else df
    for x, stub in columns.items():
        if largest <= max_group_rows:
            own = {f"__{k}": F.col(f"__{k}_{x}") for k in ("n", "mean", "sd")}
            out = out.withColumns({**own, **rank_windows(x, by)})
        else:
            out = add_ranks(out, x, by, max_group_rows, cells)
        scores = score_columns(x)
        out = out.withColumns({f"{stub}_{k}": scores[k] for k in kinds}).drop(*HELPERS)
        out = out.drop(f"__n_{x}", f"__mean_{x}", f"__sd_{x}")
    return out


def group_quantiles(
    df: DataFrame, x: str, by: list[str], probs: list[float], max_group_rows: int = MAX_GROUP_ROWS,
    cells: int = CELLS,
) -> DataFrame:
    """Exact quantiles (linear interpolation between order statistics): one array ``quantiles`` per group."""
    stats, _ = group_stats(df, x, by)
    largest = stats.agg(F.max("__n")).first()[0] or 0
    if largest <= max_group_rows:
        return df.groupBy(*by).agg(F.percentile(x, F.lit(probs)).alias("quantiles"))
    ranked, _ = value_ranks(df, x, by, cells)
    last = F.col("__rank") + F.col("__ties") - 1
    with_n = attach_stats(ranked, stats.select(*by, "__n"), by)
    parts = []
    for i, p in enumerate(probs):
        place = (F.col("__n") - 1) * F.lit(float(p)) + 1
        low, share = F.floor(place), place - F.floor(place)
        high = F.least(low + 1, F.col("__n"))
        at = lambda k: (F.col("__rank") <= k) & (k <= last)
        parts.append(
            F.sum(F.when(at(low), F.col(x) * (1 - share)).otherwise(0.0) + F.when(at(high), F.col(x) * share)
                  .otherwise(0.0)).alias(f"__q{i}")
        )
    wide = with_n.groupBy(*by).agg(*parts)
    found = wide.select(*by, F.array(*[f"__q{i}" for i in range(len(probs))]).alias("quantiles"))
    # a group without values has a row here too
    return join_null_safe(stats.select(*by), found, by, "left") if by else found


def group_ids(df: DataFrame, keys: list[str], out: str, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Dense number of each distinct key in key order, from 1: the last key is numeric, the others form groups.

    Numbers within a group come from the ranked distinct values, the offset of a group from group sizes, so there is
    no window over the whole table.
    """
    *groups, last = keys
    distinct = df.select(*keys).distinct()
    ranked = add_ranks(distinct, last, groups, max_group_rows)
    if not groups:
        return ranked.select(*keys, F.col("__dense").cast("long").alias(out))
    before = Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    sizes, small = bounded(distinct.groupBy(*groups).agg(F.count(F.lit(1)).alias("__size")))
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    joined = join_null_safe(ranked, F.broadcast(offsets) if small else offsets, groups, "left")
    return joined.select(*keys, (F.col("__offset") + F.col("__dense")).cast("long").alias(out))
