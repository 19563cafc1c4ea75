"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document whose statistic exceeds a cutoff. Labelled documents are the holdout: for every stratum (lang) and
rule, the cutoffs of a fixed grid are tested from the most lenient on, each by the exact binomial probability of as few
rejected documents of label 1 as were seen if the rate of false rejections were at its limit (RISK shared evenly by the
rules). Testing of a rule stops at the first cutoff that fails, so its chain needs no correction of its own; the chains of all
strata and rules share DOUBT by Bonferroni. With probability 1 - DOUBT, then, no stratum rejects more than RISK of its good
documents, whatever is chosen among the certified cutoffs: the one with the largest surplus of label 0 over label 1 among the
rejected, the most lenient of equal ones, and only where label 0 is rejected GAIN times as often as label 1. Documents that
fail the base rules are rejected before, and are not in the holdout.

Windows of three words are compared within a document's row: hashed, sorted as longs, and only windows that share a hash are
compared as texts. No word or window leaves its row.

Edge cases: a null or empty text has no words and fails the base rules; a null lang is a stratum of its own; a stratum without
enough labels has no cutoffs and rejects nothing more. Labels other than 0 and 1, of null ids, or for ids with both labels
teach nothing; a repeated label counts once; rows that share an id count once for each set of statistics. A statistic equal
to its cutoff (a tie) is accepted. Very long texts are read whole, in one row. Repeated rows get equal verdicts; an empty
table gives no rows; further columns are not read by the query and kept by ``accepted``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortframe.llm.common import WORD, table, written
from cohortframe.llm.registry import query

RISK = 0.05
DOUBT = 0.05
GAIN = 5
WINDOW = 3
SYMBOLS = "#*$%&|<>"
# Per rule: the statistic's numerator and denominator, and its cutoffs from lenient to strict.
RULES = {
    "symbols_per_word": ("n_symbols", "n_words", (2.0, 1.0, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05, 0.02)),
    "repeated_lines": ("n_dup_lines", "n_lines", (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    "repeated_words": ("n_repeat_words", "n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "word_length": ("word_chars", "n_words", (20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0, 6.5)),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bound_to(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """How many of the words stand in a window of WINDOW words that the array holds twice or more."""
    place = (1 << 31) - 1

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.shiftleft(F.hash(*[F.get(w, i + k) for k in range(WINDOW)]).cast("long"), 31).bitwiseOR(i.cast("long")),
        )

    def neighbours(sorted_rows: Column, key) -> Column:
        """The rows whose key equals that of the row before or after."""
        return F.filter(sorted_rows, lambda x, i: (key(F.get(sorted_rows, i - 1)) == key(x)) | (key(F.get(sorted_rows, i + 1)) == key(x)))

    def covered(starts: Column) -> Column:
        """Words in the union of the windows at the (sorted) starts."""
        state = F.aggregate(
            starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
            lambda s, x: F.struct((s["n"] + F.least(F.lit(WINDOW), x - s["at"])).alias("n"), x.alias("at")),
        )
        return state["n"].cast("long")

    def confirmed(w: Column, places: Column) -> Column:
        texts = F.array_sort(F.transform(places, lambda i: F.struct(F.array(*[F.get(w, i + k) for k in range(WINDOW)]).alias("window"), i.alias("i"))))
        return bound_to(texts, lambda t: covered(F.sort_array(F.transform(neighbours(t, lambda x: x["window"]), lambda x: x["i"]))))

    def counted(w: Column) -> Column:
        hashed = F.sort_array(windows(w))
        suspects = F.transform(bound_to(hashed, lambda h: neighbours(h, lambda x: F.shiftright(x, 31))), lambda x: x.bitwiseAND(place).cast("int"))
        return bound_to(suspects, lambda p: F.when(F.size(p) > 0, confirmed(w, p)).otherwise(F.lit(0).cast("long")))

    return bound_to(words, lambda w: F.when(F.size(w) > WINDOW, counted(w)).otherwise(F.lit(0).cast("long")))


def measured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep``, the base statistics of the whole text, n_lines (with a word) and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    length = F.length(text)
    counts = docs.select(
        *keep,
        bound_to(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("_w"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound_to(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("different"))).alias("_l"),
    )
    kept = [F.col(c) for c in counts.columns[: len(keep)]]
    flat = counts.select(
        *kept, F.col("_w.n_words"), "word_chars", "n_symbols", (F.col("_l.n") - F.col("_l.different")).alias("n_dup_lines"),
        F.col("_w.n_repeat_words"), F.col("_l.n").alias("n_lines"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return flat.withColumn("base_failed", failed)


def ratio(rule: str) -> Column:
    above, below, _ = RULES[rule]
    return F.col(above).cast("double") / F.greatest(F.col(below), F.lit(1))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series at x + 8, stepped back."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    back = sum((F.log(x + float(k)) for k in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - back


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial (n, p), for k < n p; the terms fall from k down, so a few times sqrt(k) of them are summed.

    What the sum leaves out is bounded by a geometric series and added, so the result is never too small.
    """
    x, m = k.cast("double"), n.cast("double")
    top = F.exp(log_gamma(m + 1) - log_gamma(x + 1) - log_gamma(m - x + 1) + x * math.log(p) + (m - x) * math.log1p(-p))
    steps = F.least(k, (60 + 40 * F.sqrt(x)).cast("long"))
    odds = (1 - p) / p

    def add(state: Column, i: Column) -> Column:
        term = state["term"] * (x - i + 1) / (m - x + i) * odds
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    done = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1))), start, add)).otherwise(start)
    step = (x - steps) / (m - x + steps + 1) * odds
    return F.least(F.lit(1.0), top * (done["sum"] + done["term"] * step / F.greatest(F.lit(1e-9), 1 - step)))


def thresholds(labelled: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """Per stratum (lang) a struct ``cutoffs`` with each rule's chosen cutoff (null: none), from rows with statistics and label 0 or 1."""
    share = risk / len(RULES)
    rejected = []
    for rule, (_, _, cutoffs) in RULES.items():
        for k, cutoff in enumerate(cutoffs):
            over = ratio(rule) > cutoff
            rejected += [F.count_if(over & (F.col("label") == y)).alias(f"{rule}_{k}_{y}") for y in (0, 1)]
    totals = [F.count_if(F.col("label") == y).alias(f"n_{y}") for y in (0, 1)]
    counts = written(labelled.where(~F.col("base_failed")).groupBy("lang").agg(*totals, *rejected), "holdout")
    cells = [
        F.struct(F.lit(rule).alias("rule"), F.lit(k).alias("k"), F.lit(cutoff).alias("cutoff"), F.col(f"{rule}_{k}_0").alias("bad"), F.col(f"{rule}_{k}_1").alias("good"))
        for rule, (_, _, cutoffs) in RULES.items() for k, cutoff in enumerate(cutoffs)
    ]
    strata = counts.agg(F.count("*").alias("n_strata"))
    tested = counts.select("lang", "n_0", "n_1", F.explode(F.array(*cells)).alias("c")).select("lang", "n_0", "n_1", "c.*").crossJoin(F.broadcast(strata))  # one row
    chance = F.when(F.col("good") < share * F.col("n_1"), at_most(F.col("good"), F.col("n_1"), share)).otherwise(1.0)
    passed = tested.withColumn("passed", chance <= doubt / (F.col("n_strata") * len(RULES)))
    chain = Window.partitionBy("lang", "rule")  # a row for each cutoff
    certified = F.col("k") < F.coalesce(F.min(F.when(~F.col("passed"), F.col("k"))).over(chain), F.lit(1 << 30))
    exact = "decimal(38,0)"
    for_bad, for_good = (F.col("bad") * F.col("n_1")).cast(exact), (F.col("good") * F.col("n_0")).cast(exact)
    useful = certified & (F.col("bad") > 0) & (for_bad >= GAIN * for_good)
    offer = F.struct((for_bad - for_good).alias("surplus"), (-F.col("k")).alias("lenient"), F.col("cutoff"))
    offers = passed.withColumn("offer", F.when(useful, offer))
    chosen = [F.max(F.when(F.col("rule") == rule, F.col("offer")))["cutoff"].alias(rule) for rule in RULES]
    return offers.groupBy("lang").agg(F.struct(*chosen).alias("cutoffs")).withColumnRenamed("lang", "_lang")


def holdout(stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Statistics of the labelled documents with their label."""
    clear = labels.where(F.col(key).isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col(key).alias("_id")).agg(
        F.min("quality").alias("label"), F.max("quality").alias("_most")
    ).where("label = _most").drop("_most")
    return stats.join(clear, F.col(key) == F.col("_id")).select("_id", "lang", *BASE, "n_lines", "base_failed", "label").distinct()


def verdict(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``stats`` with kept."""
    joined = stats.join(cutoffs, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    fired = F.lit(False)
    for rule in RULES:
        fired = fired | F.coalesce(ratio(rule) > F.col(f"cutoffs.{rule}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~fired).drop("_lang", "cutoffs")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, the statistics, base_failed and kept of every document."""
    stats = written(measured(docs, [F.col("doc_id"), F.col("lang")]), "statistics")
    return verdict(stats, thresholds(holdout(stats, labels)))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents kept, with all their columns."""
    cutoffs = thresholds(holdout(measured(docs, [F.col("doc_id"), F.col("lang")]), labels))
    whole = measured(docs, [F.struct("*").alias("_row"), F.col("lang")])
    return verdict(whole, cutoffs).where("kept").select("_row.*")


def _sql() -> str:
    rules = ", ".join(
        f"('{rule}', {k}, {cutoff}::DOUBLE)" for rule, (_, _, cutoffs) in RULES.items() for k, cutoff in enumerate(cutoffs)
    )
    values = " ".join(f"WHEN '{rule}' THEN CAST({above} AS DOUBLE) / greatest({below}, 1)" for rule, (above, below, _) in RULES.items())
    share = RISK / len(RULES)
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), windows AS (
  SELECT r, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS gram
  FROM (SELECT r, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS i FROM texts)
), repeated AS (
  SELECT r, count(DISTINCT i + step) AS n
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM windows), (SELECT unnest(generate_series(0, {WINDOW - 1})) AS step)
  WHERE n > 1 GROUP BY r
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '{WORD}') GROUP BY r
), counted AS (
  SELECT doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(repeated.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM texts LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r)
), stats AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), grid AS (
  SELECT * FROM (VALUES {rules}) AS g (rule, k, cutoff)
), clear AS (
  SELECT doc_id, min(quality) AS label FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)
), holdout AS (
  SELECT DISTINCT stats.*, label FROM stats JOIN clear USING (doc_id) WHERE NOT base_failed
), strata AS (
  SELECT lang, count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1, count(*) OVER () AS n_strata FROM holdout GROUP BY lang
), cells AS (
  SELECT lang, rule, k, cutoff, count(*) FILTER (label = 0 AND value > cutoff) AS bad, count(*) FILTER (label = 1 AND value > cutoff) AS good
  FROM (SELECT *, CASE rule {values} END AS value FROM holdout, grid) GROUP BY lang, rule, k, cutoff
), tested AS (
  SELECT c.*, n_0, n_1, good < {share} * n_1 AND (
           SELECT sum(exp(lgamma(n_1 + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n_1 - i + 1) + i * ln({share}) + (n_1 - i) * ln(1 - {share})))
           FROM (SELECT unnest(generate_series(0, good)) AS i)
         ) <= {DOUBT} / (n_strata * {len(RULES)}) AS passed
  FROM cells c JOIN strata s ON c.lang IS NOT DISTINCT FROM s.lang
), certified AS (
  SELECT *, bool_and(passed) OVER (PARTITION BY lang, rule ORDER BY k) AS safe FROM tested
), chosen AS (
  SELECT lang, rule, arg_max(cutoff, (CAST(bad * n_1 - good * n_0 AS BIGINT), -k)) AS cutoff
  FROM certified WHERE safe AND bad > 0 AND bad * n_1 >= {GAIN} * good * n_0 GROUP BY lang, rule
)
SELECT doc_id, {", ".join(BASE)}, base_failed, NOT base_failed AND NOT EXISTS (
  SELECT 1 FROM chosen WHERE chosen.lang IS NOT DISTINCT FROM stats.lang AND CASE rule {values} END > cutoff
) AS kept
FROM stats
"""


@query("op12_quality_rules", _sql())
def op12(spark, folder):
    rows = judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rows.select("doc_id", *BASE, "base_failed", "kept")
