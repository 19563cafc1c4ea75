"""Standard normal distribution as Column expressions, and small-table t / beta tails in plain Python."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published rational approximation to the normal quantile (AS 241, double precision):
# fixed values, lowest order first.
CENTRE_NUM = (
    3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
    45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727,
)
CENTRE_DEN = (
    1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
    21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610,
)
MIDDLE_NUM = (
    1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
    1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640,
)
MIDDLE_DEN = (
    1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
    0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 0.00000000105075007164441684324,
)
TAIL_NUM = (
    6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
    0.0265321895265761230930, 0.00124266094738807843860, 0.0000271155556874348757815, 0.000000201033439929228813265,
)
TAIL_DEN = (
    1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
    0.000786869131145613259100, 0.0000184631831751005468180, 0.000000142151175831644588870,
    0.00000000000000204426310338993978564,
)

Z975 = NormalDist().inv_cdf(0.975)


def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[-1])
    for value in reversed(coefficients[:-1]):
        total = total * x + F.lit(value)
    return total


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function on (0, 1); null outside."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    centre = q * horner(r, CENTRE_NUM) / horner(r, CENTRE_DEN)
    s = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    middle = horner(s - 1.6, MIDDLE_NUM) / horner(s - 1.6, MIDDLE_DEN)
    tail = horner(s - 5.0, TAIL_NUM) / horner(s - 5.0, TAIL_DEN)
    outer = F.when(s <= 5.0, middle).otherwise(tail)
    value = F.when(F.abs(q) <= 0.425, centre).when(q < 0, -outer).otherwise(outer)
    return F.when((p > 0) & (p < 1), value)


def quantile_sql(p: str) -> str:
    """The same formula as SQL text."""

    def poly(x: str, cs: tuple[float, ...]) -> str:
        text = f"CAST({cs[-1]!r} AS DOUBLE)"
        for c in reversed(cs[:-1]):
            text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
        return text

    q = f"({p} - CAST(0.5 AS DOUBLE))"
    r = f"(CAST(0.180625 AS DOUBLE) - {q} * {q})"
    s = f"sqrt(-ln(least({p}, CAST(1 AS DOUBLE) - {p})))"
    a = f"({s} - CAST(1.6 AS DOUBLE))"
    b = f"({s} - CAST(5 AS DOUBLE))"
    outer = (
        f"(CASE WHEN {s} <= 5 THEN {poly(a, MIDDLE_NUM)} / {poly(a, MIDDLE_DEN)} "
        f"ELSE {poly(b, TAIL_NUM)} / {poly(b, TAIL_DEN)} END)"
    )
    return (
        f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN abs({q}) <= 0.425 THEN "
        f"{q} * {poly(r, CENTRE_NUM)} / {poly(r, CENTRE_DEN)} "
        f"WHEN {q} < 0 THEN -{outer} ELSE {outer} END)"
    )


FRACTION_DEPTH = 40


def _density(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


SERIES_TERMS = 60
SERIES_LIMIT = 3.0


def normal_cdf(z: Column) -> Column:
    """Normal distribution function: power series near zero, continued fraction in the tails."""
    a = F.abs(z)
    square = a * a
    series = F.lit(1.0)
    for k in range(SERIES_TERMS, 0, -1):
        series = F.lit(1.0) + series * square / (2 * k + 1)
    inner = F.lit(0.5) + _density(a) * a * series
    fraction = a
    for k in range(FRACTION_DEPTH, 0, -1):
        fraction = a + F.lit(float(k)) / fraction
    upper = F.when(a < SERIES_LIMIT, F.lit(1.0) - inner).otherwise(_density(a) / fraction)
    return F.when(z < 0, upper).otherwise(F.lit(1.0) - upper)


def cdf_sql(z: str) -> str:
    """The same formula as SQL text; ``z`` should be a plain column name."""
    a = f"abs({z})"
    series = "CAST(1 AS DOUBLE)"
    for k in range(SERIES_TERMS, 0, -1):
        series = f"(1 + {series} * {a} * {a} / {2 * k + 1})"
    density = f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()))"
    fraction = a
    for k in range(FRACTION_DEPTH, 0, -1):
        fraction = f"({a} + {k} / {fraction})"
    upper = (
        f"(CASE WHEN {a} < {SERIES_LIMIT} THEN 0.5 - {density} * {a} * {series} ELSE {density} / {fraction} END)"
    )
    return f"(CASE WHEN {z} < 0 THEN {upper} ELSE 1 - {upper} END)"


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by the modified Lentz rule."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    if not (math.isfinite(t) and df > 0):
        return math.nan
    if math.isinf(df) or df > 1e7:
        return math.erfc(abs(t) / math.sqrt(2))
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile of the t distribution for p > 0.5, by bisection on its tail."""
    if not df > 0:
        return math.nan
    if math.isinf(df) or df > 1e7:
        return NormalDist().inv_cdf(p)
    target, low, high = 2 * (1 - p), 0.0, 2.0
    while t_two_sided(high, df) > target:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if t_two_sided(mid, df) > target:
            low = mid
        else:
            high = mid
        if high - low < 1e-14 * max(1.0, high):
            break
    return (low + high) / 2
