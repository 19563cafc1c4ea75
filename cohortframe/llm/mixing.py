"""Mixing sources to target weights.

Tokens (words) are summed per source, each source gets a share of a total by weight, bounded by a multiple of its own
size, and every document is emitted floor(rate) times plus one more copy with probability equal to the fraction. The
draw is a hash of seed and doc_id, so reruns and retried tasks agree.

Edge cases: a null text counts no words; a null source is a source of its own, last in order; a source without words
has target and rate 0; rows of equal or null doc_id draw by their text and number too; a very long text is one document,
taken whole; an empty table gives no rows; further columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortframe.llm.common import WORD, ranked, table, written
from cohortframe.llm.registry import query

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2, "mix-1"
HEX = 13  # hexadecimal digits of a draw: 52 bits
RUN = 10_000  # equal rows are counted out in arrays of at most so many numbers


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(text: Column) -> Column:
    return F.coalesce(F.md5(text), F.lit("-"))


def numbered(sized: DataFrame) -> DataFrame:
    """``sized`` (doc_id, source, size, digest) with ``k``, a row's number among its equals.

    Equal rows are counted with partial sums and counted out again, so that no task holds a group.
    """
    groups = sized.groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("_n"))
    runs = groups.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / RUN))))
    last = F.least(F.col("_n"), (F.col("_run") + 1) * RUN) - 1
    return runs.withColumn("k", F.explode(F.sequence(F.col("_run") * RUN, last))).drop("_n", "_run")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Per source of ``sizes`` (source, size): source_size, weight, target.

    Targets are ``level * weight``, bounded by ``cap * source_size``, where level is raised until the sum is ``share`` of
    all sizes or all are at their bound. Each round is one aggregate over the sources that Spark holds; the driver sees
    three sums.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    values = F.array(*[F.lit(w) for w in weights])
    sources = written(
        ranked(sources, order, "sources").withColumn("weight", F.get(values, (F.col("rank") % len(weights)).cast("int"))).drop("rank"),
        "sources",
    )
    bound = cap * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = bound < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.count_if(above).alias("n"), F.sum(F.when(above, bound)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("free")
        ).first()
        if row.n == capped or not row.free:
            break
        capped, level = row.n, (share * total - (row.held or 0)) / row.free
    target = F.least(bound.cast("double"), F.lit(level) * F.col("weight"))
    return sources.withColumn("target", target)


def rates(sized: DataFrame, seed: str = SEED, **rule) -> DataFrame:
    """``sized`` (doc_id, source, size, digest, k, and others) with source_size, target and copies (how often a row is taken)."""
    targets = source_targets(sized.select("source", "size"), **rule).withColumnRenamed("source", "_source")
    # Spark measures the written table and broadcasts it while it is small; beyond, the skew of a source is split by AQE
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    name = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "digest", F.col("k").cast("string"))
    drawn = F.conv(F.substring(F.md5(name), 1, HEX), 16, 10).cast("double")
    extra = (drawn / float(16**HEX) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", F.floor(rate) + extra)


def mix(docs: DataFrame, seed: str = SEED, **rule) -> DataFrame:
    """The mixed documents, each as often as it is taken, with the columns of ``docs``.

    Whole rows are shuffled to number equal ones only if there are any.
    """
    equal = ["doc_id", "source", "digest"]
    sized = docs.select(
        "doc_id", "source", words(F.col("text")).alias("size"), digest(F.col("text")).alias("digest"), F.struct("*").alias("row")
    )
    if sized.groupBy(*equal).count().where("count > 1").isEmpty():
        sized = sized.withColumn("k", F.lit(0))
    else:
        sized = sized.withColumn("k", F.row_number().over(Window.partitionBy(*equal).orderBy("size")) - 1)
    taken = rates(sized, seed, **rule).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


OP7_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         coalesce(md5(text), '-') AS digest, row_number() OVER (PARTITION BY doc_id, source, md5(text)) - 1 AS k FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT source, 2.0 * source_size / weight AS bound, row_number() OVER w AS place,
         1.5 * sum(source_size) OVER () - (sum(2 * source_size) OVER w - 2 * source_size) AS rest,
         sum(weight) OVER () - sum(weight) OVER w + weight AS free
  FROM sources WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT arg_min(CAST(rest AS DOUBLE) / free, place) FILTER (WHERE bound >= CAST(rest AS DOUBLE) / free) AS level FROM ordered
), targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN 2.0 * source_size ELSE least(CAST(2 * source_size AS DOUBLE), level * weight) END AS target
  FROM sources, level
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), '-'), digest, k)), 1, {HEX}) AS BIGINT) AS DOUBLE) / {float(16**HEX)} AS drawn
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies,
       CAST((floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""


@query("op7_mixing", OP7_SQL)
def op7(spark, folder):
    text = F.col("text")
    sized = table(spark, folder, "documents").select("doc_id", "source", words(text).alias("size"), digest(text).alias("digest"))
    taken = F.col("copies") * F.col("size")
    return rates(numbered(sized)).select("doc_id", "size", "source_size", "target", "copies", taken.alias("taken"))
