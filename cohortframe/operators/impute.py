"""Imputation stacks and chained imputation by forests and logistic models."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortframe.functions.draws import hash_uniform_np
from cohortframe.operators import forest
from cohortframe.operators.iterate import newton, plain_key
from cohortframe.operators.joins import attach_stats
from cohortframe.operators.multinomial import softmax_sums
from cohortframe.operators.ranks import group_quantiles
from cohortframe.session import bounded, small_rows, stage


def imputed_long(observed: DataFrame, cells: DataFrame, ident: list[str], columns: list[str], m: int) -> DataFrame:
    """Observed rows as imp 0 and m completed copies.

    ``cells`` holds one row per imputed cell: (imp, id, variable, value); only missing cells are filled from it.
    """
    wide = cells.groupBy("imp", *ident).agg(
        *[F.max(F.when(F.col("variable") == c, F.col("value"))).alias(f"__i_{c}") for c in columns]
    )
    stack = observed.withColumn("imp", F.explode(F.sequence(F.lit(0), F.lit(m))))
    joined = stack.join(wide, ["imp", *ident], "left")
    filled = {
        c: F.when(F.col("imp") == 0, F.col(c)).otherwise(
            F.coalesce(F.col(c), F.col(f"__i_{c}").cast(observed.schema[c].dataType))
        )
        for c in columns
    }
    return joined.withColumns(filled).select("imp", *observed.columns)


# ---- chained imputation ------------------------------------------------------------------------------------------

UNIT_ROWS = 1_500_000  # a group up to this size is one task's work per chain; larger ones are imputed by passes over all rows
TASK_CELLS = 600_000  # rows x chains that a task returns at once
TASK_CHAINS = 8  # chains of a group that share a task
BUCKETS = 16  # parts of a leaf's donors, by hash


def chained_imputation(
    df: DataFrame,
    ident: str,
    by: list[str],
    numeric: list[str],
    categorical: dict[str, list],
    m: int,
    sweeps: int = 5,
    helpers: list[str] | None = None,
    trees: int = 10,
    depth: int = 5,
    seed: int = 1,
    excluded: list[str] | None = None,
    unit_rows: int = UNIT_ROWS,
) -> DataFrame:
    """m completed copies (column ``imp``) by chained equations, each chain within each of the groups ``by``.

    Numeric variables are drawn from the observed donors that share a leaf with the row, pooled over the trees of a forest of
    the row's own chain and group; categorical ones (codes) from a multinomial model of the chain and group with drawn
    coefficients. ``helpers`` are complete numeric predictors; ``excluded`` variables are imputed but predict nothing; the id
    (a whole number) never predicts. Chains start at the group's median or most common code; a variable that a group never
    observes stays missing there.

    Small groups go through all sweeps in one job, a task for some chains of a group. Otherwise a pass over the persons grows
    one level of all trees of all chains and groups, persons keep one row with the drawn values of their missing cells, and
    donors arrive by an equi-join on (leaf, bucket, number). Both give the same values, on any partitioning.
    """
    plan = _Plan(ident, by, numeric, categorical, m, sweeps, helpers or [], trees, depth, seed, excluded or [])
    types = {c: df.schema[c].dataType for c in plan.variables}
    start = _start_values(df.select(ident, *by, *plan.helpers, *plan.variables), ident, by, numeric, categorical)
    plan.missing = [c for c, n in start.agg(*[F.sum(f"__miss_{c}").alias(c) for c in plan.variables]).first().asDict().items() if n]
    plan.groups = _group_scales(start, plan)
    largest = start.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    done = _by_units(start, plan, largest) if largest <= unit_rows else _by_passes(start, plan)
    return done.select("imp", ident, *by, *plan.helpers, *[F.col(c).cast(types[c]).alias(c) for c in plan.variables])


@dataclass
class _Plan:
    ident: str
    by: list[str]
    numeric: list[str]
    categorical: dict[str, list]
    m: int
    sweeps: int
    helpers: list[str]
    trees: int
    depth: int
    seed: int
    excluded: list[str]
    missing: list[str] = field(default_factory=list)
    groups: dict[tuple, dict] = field(default_factory=dict)

    @property
    def variables(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def predictors(self, target: str) -> list[str]:
        return [*self.helpers, *[c for c in self.variables if c != target and c not in self.excluded]]

    def round(self, sweep: int, target: str) -> int:
        return (sweep * 1000 + self.variables.index(target)) * 1000

    def code(self, key: tuple, imp: int, round_: int) -> int:
        plain = [k.item() if isinstance(k, np.generic) else k for k in key]
        return forest.key_code(plain, int(imp), round_, self.seed)

    def pick(self, ids: np.ndarray, imp: int, round_: int) -> np.ndarray:
        return hash_uniform_np(ids, np.full(len(ids), imp + round_), self.seed)

    def bins(self, key: tuple, target: str, values: dict[str, np.ndarray]) -> np.ndarray:
        names = self.predictors(target)
        n = len(next(iter(values.values())))
        columns = np.column_stack([values[c] for c in names]) if names else np.zeros((n, 0))
        return forest.binned(columns, [self.groups[key][c][0] for c in names])

    def outcome(self, key: tuple, target: str, y: np.ndarray) -> np.ndarray:
        return forest.whole(y, *self.groups[key][target][1:3])

    def design(self, key: tuple, target: str, values: dict[str, np.ndarray]) -> np.ndarray:
        """Intercept and standardised predictors."""
        names = self.predictors(target)
        scaled = [np.nan_to_num((values[c] - self.groups[key][c][3]) / (self.groups[key][c][4] or 1.0)) for c in names]
        return np.column_stack([np.ones(len(next(iter(values.values())))), *scaled])

    def theta(self, fit: dict, key: tuple, imp: int, round_: int) -> np.ndarray:
        """Coefficients drawn around a fit."""
        size = len(fit["theta"])
        noise = np.random.default_rng(self.code(key, imp, round_)).standard_normal(size)
        cov = (fit["cov"] + fit["cov"].T) / 2
        return fit["theta"] + np.linalg.cholesky(cov + 1e-12 * np.trace(cov) * np.eye(size)) @ noise

    def codes(self, target: str, theta: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        levels = self.categorical[target]
        eta = np.column_stack([np.zeros(len(x)), x @ theta.reshape(len(levels) - 1, -1).T])
        p = np.exp(eta - eta.max(1, keepdims=True))
        running = np.cumsum(p, axis=1) / p.sum(1, keepdims=True)
        return np.array(levels, float)[np.minimum((running <= u[:, None]).sum(1), len(levels) - 1)]

    def known_codes(self, target: str, y: np.ndarray) -> np.ndarray:
        """Place of each code among the levels; -1 for others."""
        levels = np.array(self.categorical[target], float)
        return np.where(np.isin(y, levels), np.searchsorted(np.sort(levels), y), -1)


def _start_values(df, ident, by, numeric, categorical) -> DataFrame:
    """Missing cells start at the group's middle value (numeric) or most common code; flags remember them."""
    rows = df
    for c in numeric:
        middle = group_quantiles(df.filter(F.col(c).isNotNull()), c, by, [0.5])
        fill, _ = bounded(middle.select(*by, F.col("quantiles")[0].alias(f"__f_{c}")))
        rows = attach_stats(rows, fill, by)
    if categorical:
        modes = [F.mode(F.col(c).cast("double"), True).alias(f"__f_{c}") for c in categorical]
        rows = attach_stats(rows, bounded(df.groupBy(*by).agg(*modes))[0], by)
    flags = {f"__miss_{c}": F.col(c).isNull().cast("int") for c in [*numeric, *categorical]}
    values = {c: F.coalesce(F.col(c).cast("double"), F.col(f"__f_{c}")) for c in [*numeric, *categorical]}
    return stage(rows.withColumns(flags).withColumns(values).drop(*[f"__f_{c}" for c in [*numeric, *categorical]]))


def _group_scales(start: DataFrame, plan: _Plan) -> dict[tuple, dict]:
    """Per group and variable: inner cut points, least and largest value, mean and spread of the start values."""
    names = [*plan.helpers, *plan.variables]
    probs = [k / forest.BINS for k in range(forest.BINS + 1)]
    moments = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in names for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    out = {tuple(r[b] for b in plan.by): {"__sd": r} for r in small_rows(start.groupBy(*plan.by).agg(*moments), "imputation groups")}
    for c in names:
        for r in small_rows(group_quantiles(start.withColumn(c, F.col(c).cast("double")), c, plan.by, probs), "imputation groups"):
            group = out[tuple(r[b] for b in plan.by)]
            q = np.array(r["quantiles"] or [0.0] * len(probs), float)
            mean, sd = group["__sd"][f"mean_{c}"], group["__sd"][f"sd_{c}"]
            group[c] = (np.unique(q[1:-1]), q[0], q[-1], mean or 0.0, sd or 0.0)
    return out


class _Unit:
    """The rows of a group in the order of its donors, and what its chains share: an observed value never changes."""

    def __init__(self, plan: _Plan, group: tuple, rows: pa.Table):
        ids = pc.fill_null(rows[plan.ident].cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
        _, order = forest.donor_order(ids, plan.seed)
        self.plan, self.group, self.ids, self.rows = plan, group, ids[order], rows.take(pa.array(order))
        self.values = {c: self.rows[c].to_numpy().astype(float) for c in (*plan.helpers, *plan.variables)}
        flags = {c: self.rows[f"__miss_{c}"].to_numpy() == 1 for c in plan.missing}
        self.asking = {c: np.flatnonzero(miss) for c, miss in flags.items()}
        self.known = {c: np.flatnonzero(~miss) for c, miss in flags.items()}
        self.bins = {c: self.binned(c, v) for c, v in self.values.items()}
        self.outcome, self.use, self.codes = {}, {}, {}
        for c, known in self.known.items():
            if c in plan.categorical:
                codes = plan.known_codes(c, self.values[c][known])
                self.use[c], self.codes[c] = known[codes >= 0], codes[codes >= 0]
            else:
                self.outcome[c] = plan.outcome(group, c, self.values[c][known])

    def binned(self, c: str, values: np.ndarray) -> np.ndarray:
        return forest.binned(values[:, None], [self.plan.groups[self.group][c][0]])[:, 0].astype(np.int8)

    def chain(self, imp: int) -> dict[str, np.ndarray]:
        """The values of the missing cells after all sweeps of a chain."""
        plan, group = self.plan, self.group
        values, bins = dict(self.values), dict(self.bins)
        for target in plan.missing:
            values[target], bins[target] = values[target].copy(), bins[target].copy()
        for sweep in range(1, plan.sweeps + 1):
            for target in plan.missing:
                miss, known = self.asking[target], self.known[target]
                if not len(miss) or not len(known):
                    continue
                round_ = plan.round(sweep, target)
                u = plan.pick(self.ids[miss], imp, round_)
                if target in plan.categorical:
                    x, use = plan.design(group, target, values), self.use[target]
                    kernel = softmax_sums(len(plan.categorical[target]), x.shape[1])
                    table = np.column_stack([np.ones(len(use)), self.codes[target], x[use]])
                    size = (len(plan.categorical[target]) - 1) * x.shape[1]
                    sums = lambda live, k=kernel, t=table: {key: k(t, theta) for key, theta in live.items()}
                    fit = newton(None, [], [], None, {0: np.zeros(size)}, lambda theta, _: theta, size, 40, ridge=1.0, sums_of=sums).get(0)
                    if fit is not None and "cov" in fit:
                        values[target][miss] = plan.codes(target, plan.theta(fit, group, imp, round_), x[miss], u)
                        bins[target][miss] = self.binned(target, values[target][miss])
                    continue
                place, table = forest.combinations([bins[c] for c in plan.predictors(target)], len(self.ids))
                mine = place[known]
                code = plan.code(group, imp, round_)
                node = forest.grow_on(mine, table, self.outcome[target], self.ids[known], plan.trees, plan.depth, code, plan.seed)[1]
                donors = known[forest.draw_ordered(node[:, mine], node[:, place[miss]], u)]
                values[target][miss], bins[target][miss] = values[target][donors], bins[target][donors]
        return {c: values[c][self.asking[c]] for c in plan.missing}


def _by_units(start: DataFrame, plan: _Plan, largest: int) -> DataFrame:
    """All sweeps of some chains of a group as one task's work. A row comes back once for them, with an array of a value per
    chain for every missing cell."""
    kept = [plan.ident, *plan.by, *plan.helpers, *plan.variables, *[f"__miss_{c}" for c in plan.variables]]
    each = min(plan.m, TASK_CHAINS, max(1, TASK_CELLS // max(1, largest)))
    arrays = [f"__f_{c}" for c in plan.missing]
    schema = T.StructType([
        *[start.schema[c] for c in kept], T.StructField("__first", T.IntegerType()), *[T.StructField(a, T.ArrayType(T.DoubleType())) for a in arrays],
    ])

    def chains(key: tuple, rows: pa.Table) -> pa.Table:
        *group, first = [k.as_py() for k in key]
        unit = _Unit(plan, plain_key(tuple(group)), rows)
        numbers = range(first, min(first + each, plan.m + 1))
        done = [unit.chain(imp) for imp in numbers]
        out = [unit.rows[c] for c in kept] + [pa.array(np.full(len(unit.ids), first, np.int32))]
        for c in plan.missing:
            flat = pa.array(np.column_stack([d[c] for d in done]).ravel(), from_pandas=True)
            missing = np.ones(len(unit.ids), bool)
            missing[unit.asking[c]] = False
            ends = np.concatenate([[0], np.cumsum(~missing) * len(numbers)]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(missing)))
        return pa.table(out, names=schema.names)

    parts = start.select(*kept).withColumn("__first", F.explode(F.sequence(F.lit(1), F.lit(plan.m), F.lit(each))))
    # chains are a long computation on few rows: spread by chains, not by bytes, over partitions enough that few share one
    units = len(plan.groups) * -(-plan.m // each)
    spread = parts.repartition(min(max(units, min(16 * units, 64)), 100_000), *plan.by, "__first")
    persons = stage(spread.groupBy(*plan.by, "__first").applyInArrow(chains, schema))
    last = F.least(F.col("__first") + (each - 1), F.lit(plan.m))
    rows = persons.withColumn("imp", F.explode(F.sequence("__first", last)))
    drawn = {c: F.when(F.col(f"__miss_{c}") == 1, F.get(f"__f_{c}", F.col("imp") - F.col("__first"))).otherwise(F.col(c)) for c in plan.missing}
    whole = {c: F.when(~F.isnan(v), v) for c in (*plan.helpers, *plan.variables) for v in [drawn.get(c, F.col(c)).cast("double")]}
    return rows.withColumns(whole)


def _by_passes(start: DataFrame, plan: _Plan) -> DataFrame:
    """Sweeps as passes over all persons; a person is one row, with an array of a value per chain for every missing cell."""
    persons = start.withColumns({f"__f_{c}": F.when(F.col(f"__miss_{c}") == 1, F.array_repeat(c, plan.m)) for c in plan.variables})
    persons = stage(persons)
    for sweep in range(1, plan.sweeps + 1):
        for target in plan.missing:
            draw = _codes_by_passes if target in plan.categorical else _donors_by_passes
            drawn = draw(persons, plan, target, plan.round(sweep, target))
            ordered = F.transform(F.array_sort(F.collect_list(F.struct("imp", "__new"))), lambda x: x["__new"])  # a value per chain
            persons = stage(persons.join(drawn.groupBy(plan.ident).agg(ordered.alias("__drawn")), plan.ident, "left").withColumn(
                f"__f_{target}", F.coalesce("__drawn", f"__f_{target}")
            ).drop("__drawn"))
    chains = persons.withColumn("imp", F.explode(F.sequence(F.lit(1), F.lit(plan.m))))
    return chains.withColumns({c: F.when(F.col(f"__miss_{c}") == 1, F.get(f"__f_{c}", F.col("imp") - 1)).otherwise(F.col(c)) for c in plan.variables})


def _unit_batches(batches, plan: _Plan):
    """Per batch, group and chain: the group's key, the chain, the rows, and the current values of all variables."""
    for batch in batches:
        for key, rows in batch.groupby(plan.by, sort=False, dropna=False) if plan.by else [((), batch)]:
            filled = {}
            for c in plan.variables:
                miss = rows[f"__miss_{c}"].to_numpy() == 1
                filled[c] = (miss, np.stack(rows[f"__f_{c}"][miss].to_list()).astype(float) if miss.any() else None)
            for imp in range(1, plan.m + 1):
                values = {c: rows[c].to_numpy(float) for c in (*plan.helpers, *plan.variables)}
                for c, (miss, drawn) in filled.items():
                    if drawn is not None:
                        values[c] = values[c].copy()
                        values[c][miss] = drawn[:, imp - 1]
                yield plain_key(key if isinstance(key, tuple) else (key,)), imp, rows, values


def _grow_by_passes(persons: DataFrame, plan: _Plan, target: str, round_: int) -> dict[tuple, forest.Forest]:
    """The forests of all groups and chains, a level a pass. Histograms of a node meet in one small group; splits come back."""
    names = plan.predictors(target)
    order = {key: k for k, key in enumerate(plan.groups)}
    forests = {(key, imp): forest.Forest(plan.trees, plan.depth) for key in plan.groups for imp in range(1, plan.m + 1)}
    codes = {(k, imp): plan.code(key, imp, round_) for key, k in order.items() for imp in range(1, plan.m + 1)}

    def splits(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        unit, imp, cell = key
        total = sum(np.frombuffer(p, np.int64) for p in parts["sums"]).reshape(1, 2, len(names), forest.BINS)
        feature, cut = forest.best_splits(total, forest.allowed(len(names), codes[unit, imp], np.array([cell])))
        return pd.DataFrame({"unit": [unit], "imp": [imp], "cell": [cell], "feature": feature, "cut": cut})

    for level in range(plan.depth if names else 0):

        def count(batches, level=level):
            totals: dict[tuple, np.ndarray] = {}
            for key, imp, rows, values in _unit_batches(batches, plan):
                known = rows[f"__miss_{target}"].to_numpy() == 0
                bins = plan.bins(key, target, {c: v[known] for c, v in values.items()})
                ids = rows[plan.ident].to_numpy(np.int64)[known]
                weights = forest.bootstrap(ids, plan.trees, codes[order[key], imp], plan.seed)
                node = forests[key, imp].nodes(bins)
                for cell, sums in zip(*forest.histograms(bins, plan.outcome(key, target, values[target][known]), weights, node, level)):
                    at = (order[key], imp, int(cell))
                    totals[at] = totals[at] + sums if at in totals else sums
            for start in range(0, len(totals), 5000):
                some = list(totals.items())[start : start + 5000]
                yield pd.DataFrame([(*at, sums.tobytes()) for at, sums in some], columns=["unit", "imp", "cell", "sums"])

        parts = persons.mapInPandas(count, "unit int, imp int, cell long, sums binary")
        found = parts.groupBy("unit", "imp", "cell").applyInPandas(splits, "unit int, imp int, cell long, feature int, cut int")
        keys = list(order)
        live = False
        for r in found.where("feature >= 0").toLocalIterator():  # at most chains x groups x trees x 2^level
            forests[keys[r.unit], r.imp].feature[r.cell >> 30, r.cell & (1 << 30) - 1] = r.feature
            forests[keys[r.unit], r.imp].bin[r.cell >> 30, r.cell & (1 << 30) - 1] = r.cut
            live = True
        if not live:
            break
    return forests


def _donors_by_passes(persons: DataFrame, plan: _Plan, target: str, round_: int) -> DataFrame:
    """(imp, id, __new) for missing cells. Donors are numbered within (chain, group, tree, leaf, bucket of their hash), so a
    draw is a number and the value arrives by an equi-join: no row ever meets its whole donor pool."""
    forests = _grow_by_passes(persons, plan, target, round_)
    order = {key: k for k, key in enumerate(plan.groups)}
    ident = persons.schema[plan.ident].dataType.simpleString()

    def place(batches):
        for key, imp, rows, values in _unit_batches(batches, plan):
            ids = rows[plan.ident].to_numpy(np.int64)
            node = forests[key, imp].nodes(plan.bins(key, target, values))
            hashed = hash_uniform_np(ids, np.zeros(len(ids), np.int64), plan.seed)
            each = np.repeat(np.arange(len(ids)), plan.trees)
            yield pd.DataFrame({
                plan.ident: ids[each], "unit": order[key], "imp": imp, "tree": np.tile(np.arange(plan.trees), len(ids)), "leaf": node.ravel(),
                "h": hashed[each], "bucket": (hashed[each] * BUCKETS).astype(int), "value": values[target][each],
                "miss": rows[f"__miss_{target}"].to_numpy()[each], "u": plan.pick(ids, imp, round_)[each],
            })

    schema = f"{plan.ident} {ident}, unit int, imp int, tree int, leaf int, h double, bucket int, value double, miss int, u double"
    placed = stage(persons.mapInPandas(place, schema))
    cell = ["unit", "imp", "tree", "leaf", "bucket"]
    number = F.row_number().over(Window.partitionBy(*cell).orderBy("h", plan.ident))
    donors = placed.where("miss = 0").select(*cell, number.alias("number"), F.col("value").alias("__new"))
    sizes = placed.where("miss = 0").groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    asking = placed.where("miss = 1").select("imp", plan.ident, "unit", "tree", "leaf", "u").join(sizes, ["unit", "imp", "tree", "leaf"])
    person = Window.partitionBy("imp", plan.ident)
    below = F.sum("n").over(person.orderBy("tree", "bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    asking = asking.withColumn("below", below).withColumn("pick", F.floor(F.col("u") * F.sum("n").over(person)))
    chosen = asking.where((F.col("pick") >= F.col("below")) & (F.col("pick") < F.col("below") + F.col("n")))
    chosen = chosen.select(plan.ident, *cell, (F.col("pick") - F.col("below") + 1).cast("int").alias("number"))
    return chosen.join(donors, [*cell, "number"]).select("imp", plan.ident, "__new")


def _codes_by_passes(persons: DataFrame, plan: _Plan, target: str, round_: int) -> DataFrame:
    """(imp, id, __new) for missing codes, from multinomial fits of all chains and groups in the same passes."""
    levels, width = len(plan.categorical[target]), 1 + len(plan.predictors(target))
    size = (levels - 1) * width
    kernel = softmax_sums(levels, width)
    ident = persons.schema[plan.ident].dataType.simpleString()

    def sums_of(live: dict) -> dict:
        def add(batches):
            totals = {}
            for key, imp, rows, values in _unit_batches(batches, plan):
                if (key, imp) not in live:
                    continue
                codes = plan.known_codes(target, values[target])
                use = (rows[f"__miss_{target}"].to_numpy() == 0) & (codes >= 0)
                x = plan.design(key, target, values)
                part = kernel(np.column_stack([np.ones(use.sum()), codes[use], x[use]]), live[key, imp])
                totals[key, imp] = totals[key, imp] + part if (key, imp) in totals else part
            for unit, vector in totals.items():
                yield pd.DataFrame({"unit": index[unit], "place": np.arange(len(vector)), "value": vector})

        parts = persons.mapInPandas(add, "unit int, place int, value double").groupBy("unit", "place").agg(F.sum("value").alias("value"))
        out: dict = {}
        for r in parts.toLocalIterator():
            out.setdefault(units[r.unit], np.zeros(1 + size + size * size))[r.place] = r.value
        return out

    units = [(key, imp) for key in plan.groups for imp in range(1, plan.m + 1)]
    index = {unit: k for k, unit in enumerate(units)}
    fits = newton(None, [], [], None, {unit: np.zeros(size) for unit in units}, lambda theta, _: theta, size, 40, ridge=1.0, sums_of=sums_of)
    thetas = {unit: plan.theta(fit, *unit, round_) for unit, fit in fits.items() if "cov" in fit}

    def draw(batches):
        for key, imp, rows, values in _unit_batches(batches, plan):
            miss = rows[f"__miss_{target}"].to_numpy() == 1
            if not miss.any() or (key, imp) not in thetas:
                continue
            ids = rows[plan.ident].to_numpy(np.int64)[miss]
            x = plan.design(key, target, values)[miss]
            yield pd.DataFrame({"imp": imp, plan.ident: ids, "__new": plan.codes(target, thetas[key, imp], x, plan.pick(ids, imp, round_))})

    return persons.mapInPandas(draw, f"imp int, {plan.ident} {ident}, __new double")


def impute_age(
    df: DataFrame, ident: str, by: list[str], ages: list[str], tests: list[str], sweeps: int = 10, seed: int = 1
) -> DataFrame:
    """One forest imputation of missing test ages, then null again for rows with no test score at all."""
    done = chained_imputation(df, ident, by, [*ages, *tests], {}, m=1, sweeps=sweeps, seed=seed).select(ident, *ages)
    seen = df.select(ident, F.coalesce(*[F.col(t).cast("double") for t in tests]).isNotNull().alias("__seen"))
    joined = done.join(seen, ident)
    return joined.select(ident, *[F.when(F.col("__seen"), F.col(a)).alias(a) for a in ages])
