"""Repeatable uniform draws from integer keys: the same value on any partitioning and in plain SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the mixing rule: a prime modulus and three multipliers.
PRIME = 2147483647
KEY_FACTOR = 7919
DRAW_FACTOR = 104729
ROUND_SHIFT = 48271


ROUNDS = 3


def hash_uniform(key: Column, draw: Column, seed: int = 1) -> Column:
    """Uniform number in (0, 1) for an integer key and draw number.

    The mixing rounds run inside one ``aggregate``, so the expression stays small however often it is referenced.
    """
    start = F.pmod(
        F.pmod(key.cast("long"), F.lit(PRIME)) * KEY_FACTOR
        + F.pmod(draw.cast("long"), F.lit(PRIME)) * DRAW_FACTOR
        + F.lit(seed * 15485863 % PRIME),
        F.lit(PRIME),
    )
    shifts = F.array(*[F.lit(ROUND_SHIFT).cast("long")] * ROUNDS)
    mixed = F.aggregate(shifts, start.cast("long"), lambda v, s: F.pmod(v * (v + s), F.lit(PRIME).cast("long")))
    return (mixed + 0.5) / float(PRIME)


def hash_uniform_sql(key: str, draw: str, seed: int = 1) -> str:
    text = (
        f"(((CAST({key} AS BIGINT) % {PRIME}) * {KEY_FACTOR} + (CAST({draw} AS BIGINT) % {PRIME}) * {DRAW_FACTOR}"
        f" + {seed * 15485863 % PRIME}) % {PRIME})"
    )
    for _ in range(ROUNDS):
        text = f"({text} * ({text} + {ROUND_SHIFT}) % {PRIME})"
    return f"(({text} + CAST(0.5 AS DOUBLE)) / CAST({PRIME} AS DOUBLE))"


def hash_uniform_np(key: np.ndarray, draw: np.ndarray, seed: int = 1) -> np.ndarray:
    value = (
        (np.asarray(key, dtype=np.int64) % PRIME) * KEY_FACTOR
        + (np.asarray(draw, dtype=np.int64) % PRIME) * DRAW_FACTOR
        + seed * 15485863 % PRIME
    ) % PRIME
    for _ in range(ROUNDS):
        value = value * (value + ROUND_SHIFT) % PRIME
    return (value + 0.5) / float(PRIME)


# Cumulative Poisson(1) probabilities, from the rule p(k) = exp(-1)/k!.
POISSON_CUTS = tuple(np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(10)]).tolist())


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count for a uniform draw: the weight of a row in one resample."""
    total = F.lit(0)
    for cut in POISSON_CUTS:
        total = total + (u > cut).cast("int")
    return total.cast("double")


def poisson_weight_sql(u: str) -> str:
    return "CAST(" + " + ".join(f"CAST({u} > CAST({c!r} AS DOUBLE) AS INTEGER)" for c in POISSON_CUTS) + " AS DOUBLE)"


# How many cut points lie below each 4096th, and the 4096ths with a cut point inside.
POISSON_TABLE = np.searchsorted(np.array(POISSON_CUTS), np.arange(4097) / 4096, side="left")
POISSON_SPLIT = POISSON_TABLE[1:] > POISSON_TABLE[:-1]


def poisson_weight_np(u: np.ndarray) -> np.ndarray:
    u = np.asarray(u, dtype=float)
    place = np.minimum((u * 4096).astype(np.intp), 4095)
    weight = POISSON_TABLE.astype(float)[place]
    split = POISSON_SPLIT[place]
    if np.any(split):
        weight = np.where(split, 0.0, weight)
        weight[split] = np.searchsorted(np.array(POISSON_CUTS), u[split], side="left")
    return weight
