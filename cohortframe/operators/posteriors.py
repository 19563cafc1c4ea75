"""Reporting on class membership probabilities: order, quality, entropy, random draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortframe.functions.draws import hash_uniform
from cohortframe.functions.text import fixed


def _number(name: str) -> Column:
    """The number at the end of a class's name."""
    return F.regexp_extract(name, r"(\d+)$", 1).cast("int")


def class_order(long: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Classes by falling share with display names. ``long`` has one row per id and ``prob<k>``.

    The windows run over one row per class.
    """
    sizes = long.groupBy(_number(name).alias("class")).agg(F.sum(value).alias("n"))
    prop = F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 2)
    shares = sizes.select("class", prop.alias("class_prop"))
    place = F.row_number().over(Window.orderBy(F.col("class_prop").desc(), "class"))
    named = shares.withColumn("class_ord", F.concat(F.lit("Class "), place.cast("string")))
    label = F.concat("class_ord", F.lit(" ("), fixed(F.col("class_prop"), 1), F.lit("%)"))
    return named.select("class", "class_ord", "class_prop", label.alias("class_long"))


def class_quality(long: DataFrame, classes: list[int]) -> DataFrame:
    """Per class in size order: mean probability, and mean probability of every class among those assigned to it."""
    order = class_order(long)
    mean = long.groupBy(_number("name").alias("class")).agg(
        (100 * F.avg("value")).alias("mean_prob")
    )
    target = order.select(F.col("class").alias("to"), _number("class_ord").alias("place"))
    cells = long.groupBy("class", _number("name").alias("to")).agg(
        F.round(F.avg("value"), 3).alias("m")
    )
    placed = cells.join(F.broadcast(target), "to")
    matrix = placed.groupBy("class").agg(
        *[F.max(F.when(F.col("place") == k, F.col("m"))).alias(f"prop{k}") for k in range(1, len(classes) + 1)]
    )
    return order.join(mean, "class", "left").join(matrix, "class", "left").select(
        "class_ord", "mean_prob", *[f"prop{k}" for k in range(1, len(classes) + 1)]
    )


def entropy(long: DataFrame, ident: str, classes: int) -> DataFrame:
    """Relative entropy 1 + sum p ln p / (N ln K), with 0 ln 0 = 0; null for one class."""
    p = F.col("value")
    rows = long.agg(
        F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0)).alias("s"), F.count(F.lit(1)).alias("k")
    )
    members = F.col("k") / classes
    value = F.when(F.lit(classes > 1), 1 + F.col("s") / (members * F.log(F.lit(float(max(classes, 2))))))
    return rows.select(value.alias("entropy"))


def pseudo_class_draws(wide: DataFrame, ident: str, probs: list[str], draws: int, seed: int = 1) -> DataFrame:
    """Random class per id and draw: the smallest class whose cumulative probability exceeds a uniform draw."""
    total = sum((F.col(p) for p in probs[1:]), F.col(probs[0]))
    drawn = wide.withColumn("imp", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = hash_uniform(F.col(ident), F.col("imp"), seed) * total
    running, chain = F.lit(0.0), None
    for k, p in enumerate(probs[:-1], start=1):
        running = running + F.col(p)
        chain = F.when(running > F.col("__u"), k) if chain is None else chain.when(running > F.col("__u"), k)
    pick = F.lit(1) if chain is None else chain.otherwise(len(probs))
    return drawn.withColumn("__u", u).withColumn("pseudo", pick.cast("int")).drop("__u", *probs)
