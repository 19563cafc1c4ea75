"""SQL text for the regression oracles: moments, in-place inversion one pivot at a time, robust variances, pooling."""

from __future__ import annotations

from statistics import NormalDist

Z = NormalDist().inv_cdf(0.975)


def t975(nu: str) -> str:
    """97.5% point of the t distribution as a series in 1/df; good beyond some 30 degrees of freedom."""
    z = Z
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    text = f"CAST({z!r} AS DOUBLE)"
    for power, value in enumerate(terms, start=1):
        text += f" + CAST({value!r} AS DOUBLE) / pow({nu}, {power})"
    return f"({text})"


def inverse_ctes(name: str, source: str, k: int, keys: str) -> tuple[str, str]:
    """CTEs inverting the symmetric matrix columns a_i_j of ``source``; dependent columns become zero."""
    cells = [(i, j) for i in range(k) for j in range(k)]
    start = ", ".join(f"a_{min(i, j)}_{max(i, j)} AS m_{i}_{j}" for i, j in cells)
    diag = ", ".join(f"a_{i}_{i} AS o_{i}" for i in range(k))
    ctes = [f"{name}_0 AS MATERIALIZED (SELECT {keys}, {start}, {diag} FROM {source})"]
    keep: list[str] = []
    for p in range(k):
        ok = f"m_{p}_{p} > 1e-10 * o_{p}"
        cols = []
        for i, j in cells:
            if i == p and j == p:
                new = f"1 / m_{p}_{p}"
            elif i == p:
                new = f"m_{p}_{j} / m_{p}_{p}"
            elif j == p:
                new = f"-m_{i}_{p} / m_{p}_{p}"
            else:
                new = f"m_{i}_{j} - m_{i}_{p} * m_{p}_{j} / m_{p}_{p}"
            old = "0" if p in (i, j) else f"m_{i}_{j}"
            cols.append(f"CASE WHEN {ok} THEN {new} ELSE {old} END AS m_{i}_{j}")
        carried = "".join(f", kept_{q}" for q in keep)
        keep.append(str(p))
        cols.append(f"CAST({ok} AS INTEGER) AS kept_{p}")
        rest = ", ".join(f"o_{i}" for i in range(k))
        ctes.append(f"{name}_{p + 1} AS MATERIALIZED (SELECT {keys}{carried}, {', '.join(cols)}, {rest} FROM {name}_{p})")
    return ", ".join(ctes), f"{name}_{k}"


def wls(name: str, source: str, y: str, xs: list[str], by: list[str], w: str = "1", robust: bool = True) -> str:
    """CTEs ``<name>_fit`` (by, n, df, b_i, v_i_j, rss) for a weighted regression with intercept on complete rows."""
    k = len(xs) + 1
    keys = ", ".join(by)
    cols = ", ".join([f"CAST({x} AS DOUBLE) AS x_{i}" for i, x in enumerate(xs, start=1)])
    present = " AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])
    rows = (
        f"{name}_rows AS MATERIALIZED (SELECT {keys}, CAST({y} AS DOUBLE) AS y, CAST({w} AS DOUBLE) AS w, "
        f"CAST(1 AS DOUBLE) AS x_0, {cols} FROM {source} WHERE {present})"
    )
    sums = ", ".join(f"sum(w * x_{i} * x_{j}) AS a_{i}_{j}" for i in range(k) for j in range(i, k))
    crosses = ", ".join(f"sum(w * x_{i} * y) AS c_{i}" for i in range(k))
    mom = (
        f"{name}_mom AS MATERIALIZED (SELECT {keys}, count(*) AS n, sum(w * y * y) AS yy, {sums}, {crosses} "
        f"FROM {name}_rows GROUP BY {keys})"
    )
    inv, last = inverse_ctes(f"{name}_inv", f"{name}_mom", k, keys)
    using = f"USING ({keys})"
    betas = ", ".join("(" + " + ".join(f"m_{i}_{j} * c_{j}" for j in range(k)) + f") AS b_{i}" for i in range(k))
    inverse = ", ".join(f"m_{i}_{j}" for i in range(k) for j in range(k))
    kept = " + ".join(f"kept_{i}" for i in range(k))
    flags = ", ".join(f"kept_{i}" for i in range(k))
    beta = (
        f"{name}_beta AS MATERIALIZED (SELECT {keys}, n, yy, n - ({kept}) AS df, {betas}, {inverse}, {flags}, "
        f"{', '.join(f'c_{i}' for i in range(k))} FROM {name}_mom JOIN {last} {using})"
    )
    fitted = " + ".join(f"b_{i} * x_{i}" for i in range(k))
    if not robust:
        rss = "yy - (" + " + ".join(f"b_{i} * c_{i}" for i in range(k)) + ")"
        v = ", ".join(f"({rss}) / df * m_{i}_{j} AS v_{i}_{j}" for i in range(k) for j in range(k))
        bs = ", ".join(f"b_{i}" for i in range(k))
        fit = f"{name}_fit AS MATERIALIZED (SELECT {keys}, n, CAST(df AS DOUBLE) AS df, {rss} AS rss, {bs}, {v} FROM {name}_beta)"
        return ", ".join([rows, mom, inv, beta, fit])
    ax = ", ".join("(" + " + ".join(f"m_{i}_{j} * x_{j}" for j in range(k)) + f") AS ax_{i}" for i in range(k))
    xs_kept = ", ".join(f"x_{i}" for i in range(k))
    res = (
        f"{name}_res AS (SELECT {keys}, w, {xs_kept}, y - ({fitted}) AS e, {ax} FROM {name}_rows JOIN {name}_beta {using})"
    )
    h = " + ".join(f"x_{i} * ax_{i}" for i in range(k))
    axs = ", ".join(f"ax_{i}" for i in range(k))
    lev = (
        f"{name}_lev AS (SELECT {keys}, {axs}, CASE WHEN 1 - w * ({h}) > 1e-9 THEN w * w * e * e / (1 - w * ({h})) "
        f"ELSE 0 END AS g FROM {name}_res)"
    )
    vs = ", ".join(f"sum(g * ax_{i} * ax_{j}) AS v_{i}_{j}" for i in range(k) for j in range(k))
    meat = f"{name}_meat AS (SELECT {keys}, {vs} FROM {name}_lev GROUP BY {keys})"
    bs = ", ".join(f"b_{i}" for i in range(k))
    fit = (
        f"{name}_fit AS MATERIALIZED (SELECT {keys}, n, CAST(df AS DOUBLE) AS df, {bs}, {flags}, "
        f"{', '.join(f'v_{i}_{j}' for i in range(k) for j in range(k))} FROM {name}_beta JOIN {name}_meat {using})"
    )
    return ", ".join([rows, mom, inv, beta, res, lev, meat, fit])


def rubin(name: str, source: str, by: str) -> str:
    """CTE ``<name>`` (by, m, beta, se, df) pooling columns beta, se, df of ``source``."""
    return f"""{name}_q AS (SELECT {by}, count(*) AS m, avg(beta) AS beta, avg(se * se) AS u, coalesce(var_samp(beta), 0) AS b,
        min(df) AS nu FROM {source} GROUP BY {by}),
      {name}_t AS (SELECT *, u + (1 + CAST(1 AS DOUBLE) / m) * b AS total, (1 + CAST(1 AS DOUBLE) / m) * b / (u + (1 + CAST(1 AS DOUBLE) / m) * b) AS lam FROM {name}_q),
      {name}_d AS (SELECT *, (nu + 1) / (nu + 3) * nu * (1 - lam) AS obs FROM {name}_t),
      {name} AS (SELECT {by}, m, beta, sqrt(total) AS se,
        CASE WHEN lam > 0 THEN ((m - 1) / (lam * lam)) * obs / ((m - 1) / (lam * lam) + obs) ELSE obs END AS df FROM {name}_d)"""
