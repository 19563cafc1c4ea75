r"""Personal data by weak supervision, in DataFrame operations only.

Four kinds of spans (email, ip, card, phone) have a base rule that always holds. Around it, looser candidates (addresses
spelled out with "at" and "dot", numbers without a plus or a valid check digit) get votes from three labelers: the rule's
own check, a gazetteer of cue words, top-level domains, country codes and issuer prefixes, and the characters
and words beside the span. Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability
per kind, a span classifier (naive Bayes over span and context features) is trained on the resulting probabilities, and
candidates it is sure of are added. Vote patterns and features have a fixed number of values, so what reaches the driver
is at most 4 * 27 patterns and some hundred weights, each counted over all documents.

Places come from cutting a text at its matches and adding up lengths, in code points. The rules are written without
repeated groups, so very long runs of digits or labels need no deep recursion, and with look-behinds that start a match
only where a run starts.

Edge cases: a null text counts as empty; a text without matches gives counts of 0, the digest of an empty string and an
empty span list; repeated rows and null ids are scored like others; an empty table gives no rows; further columns are
ignored. The base counts and digest hold base spans only; ``spans`` holds them and the added ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import table, written
from cohortframe.llm.registry import query

KINDS = ("email", "ip", "card", "phone")
SURE = 0.95
ROUNDS = 40

# Private-use characters that stand for a separator between two digits, and for a dot between two labels.
JOIN, DOT = "\ue000", "\ue001"
LOCAL, LABEL = r"A-Za-z0-9._%+\-", r"A-Za-z0-9\-"
EMAIL = rf"(?:\G|(?<![{LOCAL}{DOT}]))[{LOCAL}{DOT}]++@[{LABEL}]++{DOT}[{LABEL}{DOT}]*"
SPELLED = rf"(?<![{LOCAL}])[{LOCAL}]++ (?:at|\(at\)|\[at\]) [{LABEL}]++ (?:dot|\(dot\)|\[dot\]) [A-Za-z]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
NUMBER = rf"[0-9{JOIN}]{{7,}}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Gazetteers (fixed values).
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu")
COUNTRY_CODES = ("1", "33", "34", "39", "41", "43", "44", "49", "52", "54", "55", "61", "81", "86", "91")
ISSUERS = "^(4|5[1-5]|2[2-7]|3[47]|6011|65)"
CUES = {
    "email": r"(?i)\b(e-?mail|mail|contact|correo|courriel|kontakt|write to)\W*$",
    "ip": r"(?i)\b(ip|host|address|server|client|adresse)\W*$",
    "card": r"(?i)\b(card|visa|mastercard|credit|tarjeta|carte|karte)\b.{0,12}$",
    "phone": r"(?i)\b(tel|phone|call|mobile|fax|contact|tel[eé]fono|t[eé]l[eé]phone|telefon|anruf)\b.{0,12}$",
}
NOT_CUES = r"(?i)\b(token|key|secret|id|isbn|order|version|serial|no|nr|number|page)\b.{0,6}$"


SPAN = "struct<kind:string,start:bigint,end:bigint,text:string,left:string,after:string>"
GROUP = 256


def none(kind: str) -> Column:
    return F.array().cast(kind)


def cut(found: Column, gaps: Column, kind: str) -> Column:
    """Spans of all matches from the matches and the texts around them; code points, end exclusive.

    ``left`` is up to 24 characters before a match, ``after`` the one behind it. Places add up within groups of matches,
    then over the groups, so that a text of very many matches costs little more than their number.
    """
    n = F.size(found)
    around = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n), lambda x, y: F.struct(x.alias("before"), F.left(y, F.lit(1)).alias("after")))
    pairs = F.zip_with(found, around, lambda f, g: F.struct(f.alias("found"), g["before"].alias("before"), g["after"].alias("after")))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.char_length(pair["before"])
        end = start + F.char_length(pair["found"])
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["found"].alias("text"),
            F.right(pair["before"], F.lit(24)).alias("left"), pair["after"].alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def group(i: Column) -> Column:
        return F.aggregate(F.slice(pairs, i * GROUP + 1, F.lit(GROUP)), F.struct(F.lit(0).cast("long").alias("at"), none(f"array<{SPAN}>").alias("out")), add)

    def shift(state: Column, part: Column) -> Column:
        moved = F.struct(state["at"].alias("at"), part["out"].alias("out"))
        return F.struct((state["at"] + part["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    groups = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / GROUP).cast("int")), group)
    first = F.struct(F.lit(0).cast("long").alias("at"), none(f"array<struct<at:bigint,out:array<{SPAN}>>>").alias("out"))
    placed = F.aggregate(groups, first, shift, lambda x: x["out"])

    def spans(part: Column) -> Column:
        return F.transform(part["out"], lambda x: F.struct(
            x["kind"].alias("kind"), (x["start"] + part["at"]).alias("start"), (x["end"] + part["at"]).alias("end"), x["text"].alias("text"),
            x["left"].alias("left"), x["after"].alias("after"),
        ))

    return F.when(n > 0, F.flatten(F.transform(placed, spans))).otherwise(none(f"array<{SPAN}>"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the check of card numbers."""
    n = F.length(number)

    def value(i: Column) -> Column:
        d = F.ascii(F.substr(number, n - i, F.lit(1))) - 48
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def small_parts(address: Column) -> Column:
    bare = F.transform(F.split(address, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    return F.forall(bare, lambda x: (F.length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255))


def base_rule(span: Column) -> Column:
    number = digits(span["text"])
    n = F.length(number)
    return (
        F.when(span["kind"] == "ip", small_parts(span["text"]))
        .when(span["kind"] == "card", n.between(16, 19) & luhn(F.when(n.between(16, 19), number).otherwise("0")))
        .when(span["kind"] == "phone", n.between(8, 15))
        .otherwise(True)
    )


def extracted(docs: DataFrame) -> DataFrame:
    """Per document: base spans, and all candidates with votes and features.

    A text is scanned for a kind only if it holds what every span of the kind needs.
    """
    text = F.col("text")
    plain = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), JOIN + DOT, "\ufffd\ufffd").alias("text"))
    marked = plain.select(
        "doc_id", "text",
        F.when(F.contains("text", F.lit("@")), F.regexp_replace("text", rf"(?<=[{LABEL}])\.(?=[{LABEL}])", DOT)).alias("dotted"),
        F.when(text.rlike(r"[0-9][\x20-]?[0-9]"), F.regexp_replace("text", r"(?<=[0-9])[\x20-](?=[0-9])", JOIN)).alias("joined"),
        F.when(text.rlike(r"[0-9]\.[0-9]"), text).alias("numbered"), F.when(text.rlike(r"\+[0-9]"), text).alias("plus"),
        F.when(text.rlike(r" (dot|\(dot\)|\[dot\]) "), text).alias("worded"),
    )
    scans = {
        "email": ("dotted", EMAIL, "email"), "ip": ("numbered", IP, "ip"), "number": ("joined", NUMBER, "card"),
        "phone": ("plus", PHONE, "phone"), "spelled": ("worded", SPELLED, "email"),
    }
    matched = marked.select("doc_id", *scans_of(scans))
    spans = matched.select("doc_id", *[cut(F.col(f"{k}_found"), F.col(f"{k}_gaps"), kind).alias(k) for k, (_, _, kind) in scans.items()])
    base = F.filter(F.concat("email", "ip", "number", "phone"), base_rule)
    found = spans.select("doc_id", "number", "spelled", base.alias("base"))

    def apart(span: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))

    def loose(span: Column) -> Column:
        """A number is offered as a card or a phone by its count of digits."""
        kind = F.when(F.length(digits(span["text"])) >= 16, "card").otherwise("phone")
        return F.struct(kind.alias("kind"), *[span[x].alias(x) for x in ("start", "end", "text", "left", "after")])

    number = F.filter("number", lambda s: F.length(digits(s["text"])).between(7, 19) & apart(s))
    extra = F.concat(F.transform(number, loose), F.filter("spelled", apart))
    apart_from_base = found.select("doc_id", "base", extra.alias("extra"))
    candidates = F.concat(
        F.transform("base", lambda s: judged(s, F.lit(True))), F.transform("extra", lambda s: judged(s, F.lit(False)))
    )
    return apart_from_base.select("doc_id", candidates.alias("candidates"))


def scans_of(scans: dict[str, tuple[str, str, str]]) -> list[Column]:
    """The matches of every scan and the texts around them; both empty where a text is not scanned."""
    out, empty = [], F.array().cast("array<string>")
    for name, (source, pattern, _kind) in scans.items():
        text = F.col(source)
        out.append(F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), empty).alias(f"{name}_found"))
        out.append(F.coalesce(F.split(text, pattern, -1), empty).alias(f"{name}_gaps"))
    return out


def judged(span: Column, base: Column) -> Column:
    """A candidate with the votes of its labelers (1 for, -1 against, 0 none) and its features."""
    kind, left, after = span["kind"], span["left"], span["after"]
    before = F.right(left, F.lit(1))
    number, n = digits(span["text"]), F.length(digits(span["text"]))
    separators = F.length(span["text"]) - n
    domain = F.lower(F.substring_index(F.translate(span["text"], DOT + " ", ".."), ".", -1))
    cue = F.lit(False)
    for name, pattern in CUES.items():
        cue = cue | ((kind == name) & left.rlike(pattern))
    rule = (
        F.when(base, 1)
        .when(kind == "email", 1)
        .when((kind == "phone") & (separators >= 2) & n.between(9, 12), 1)
        .otherwise(-1)
    )
    known = (
        F.when(left.rlike(NOT_CUES), -1)
        .when(cue, 1)
        .when((kind == "email") & domain.isin(*TOP_DOMAINS), 1)
        .when((kind == "card") & number.rlike(ISSUERS), 1)
        .when((kind == "phone") & span["text"].rlike(r"^\+(" + "|".join(COUNTRY_CODES) + ")[^0-9]"), 1)
        .otherwise(0)
    )
    clear = (before == "") | before.rlike(r"[\s(:,;]")
    closed = (after == "") | after.rlike(r"[\s).,;:]")
    context = F.when(before.rlike(r"[A-Za-z0-9_=\"'/#-]"), -1).when(clear & closed, 1).otherwise(0)
    shape = F.concat_ws(
        "", kind, F.when(n >= 16, "L").when(n >= 13, "M").when(n >= 10, "S").otherwise("T"),
        F.when(separators == 0, "0").when(separators < 4, "1").otherwise("2"),
    )
    return F.struct(
        kind.alias("kind"), span["start"].alias("start"), span["end"].alias("end"), base.alias("base"),
        rule.alias("rule"), known.alias("known"), context.alias("context"),
        shape.alias("shape"), F.when(clear, "w").when(before.rlike("[A-Za-z0-9]"), "a").otherwise("o").alias("before"),
        F.when(closed, "w").otherwise("o").alias("after"), F.when(cue, "c").otherwise("n").alias("cue"),
    )


VOTES = ("rule", "known", "context")
FEATURES = ("shape", "before", "after", "cue")


def reliabilities(patterns: list) -> dict[tuple, float]:
    """Probability that a candidate is personal data, per (kind, votes), by expectation-maximisation.

    ``patterns`` has (kind, votes..., n). Each labeler has per kind a distribution over its votes for spans that are and
    for spans that are not; it starts better than chance and is smoothed by one count.
    """
    out = {}
    for kind in KINDS:
        rows = [(tuple(p[1:-1]), p[-1]) for p in patterns if p[0] == kind]
        if not rows:
            continue
        share = 0.5
        tables = [({1: 0.6, 0: 0.3, -1: 0.1}, {1: 0.1, 0: 0.3, -1: 0.6}) for _ in VOTES]
        for _ in range(ROUNDS):
            chance = {}
            for votes, _n in rows:
                yes = math.log(share) + sum(math.log(t[0][v]) for t, v in zip(tables, votes))
                no = math.log(1 - share) + sum(math.log(t[1][v]) for t, v in zip(tables, votes))
                chance[votes] = 1 / (1 + math.exp(min(700.0, no - yes)))
            total = sum(n for _, n in rows)
            sure = sum(n * chance[v] for v, n in rows)
            share = (sure + 1) / (total + 2)
            for k in range(len(VOTES)):
                yes, no = {1: 1.0, 0: 1.0, -1: 1.0}, {1: 1.0, 0: 1.0, -1: 1.0}
                for votes, n in rows:
                    yes[votes[k]] += n * chance[votes]
                    no[votes[k]] += n * (1 - chance[votes])
                tables[k] = tuple({v: x / sum(d.values()) for v, x in d.items()} for d in (yes, no))
        out |= {(kind, *votes): p for votes, p in chance.items()}
    return out


def chain(cases: list[tuple[Column, float]], rest: float) -> Column:
    out = None
    for when, value in cases:
        out = F.when(when, F.lit(value)) if out is None else out.when(when, F.lit(value))
    return F.lit(rest) if out is None else out.otherwise(F.lit(rest))


def classifier(found: DataFrame):
    """The trained span classifier: a function from a candidate to its probability as a column expression."""
    spans = found.select(F.explode("candidates").alias("c")).select("c.*")
    counted = written(spans.groupBy("kind", *VOTES, *FEATURES).agg(F.count("*").alias("n")), "patterns")
    patterns = counted.groupBy("kind", *VOTES).agg(F.sum("n").alias("n")).collect()  # 27 for a kind at most
    chance = reliabilities([tuple(p) for p in patterns])
    soft = chain(
        [((F.col("kind") == k[0]) & (F.col("rule") == k[1]) & (F.col("known") == k[2]) & (F.col("context") == k[3]), p) for k, p in sorted(chance.items())], 0.0
    )
    weighed = counted.withColumn("p", soft)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])).alias("f")
    sums = (
        weighed.select("kind", "n", "p", pairs).groupBy("kind", "f.feature", "f.value")
        .agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()
    )  # a row per kind and value of a feature
    weights, prior = {}, {}
    for kind in KINDS:
        mine = [r for r in sums if r.kind == kind]
        for feature in FEATURES:
            rows = sorted((r for r in mine if r.feature == feature), key=lambda r: r.value)
            yes, no = sum(r.yes for r in rows), sum(r.no for r in rows)
            prior[kind] = math.log((yes + 1) / (no + 1))
            for r in rows:
                weights[kind, feature, r.value] = math.log((r.yes + 1) / (yes + len(rows))) - math.log((r.no + 1) / (no + len(rows)))

    def probability(span: Column) -> Column:
        total = chain([(span["kind"] == k, v) for k, v in prior.items()], -20.0)
        for feature in FEATURES:
            cases = [((span["kind"] == k) & (span[feature] == v), w) for (k, f, v), w in sorted(weights.items()) if f == feature]
            total = total + chain(cases, 0.0)
        return 1 / (1 + F.exp(-total))

    return probability


def listed(spans: Column) -> Column:
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans' counts and digest, all spans, and n_added."""
    found = written(extracted(docs), "candidates")
    probability = classifier(found)
    base = F.filter("candidates", lambda c: c["base"])
    kept = F.filter("candidates", lambda c: c["base"] | (probability(c) >= SURE))

    def of(kind: str) -> Column:
        return F.size(F.filter(base, lambda c: c["kind"] == kind)).cast("long")

    counts = [of(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(kept).alias("spans"),
        (F.size(kept) - F.size(base)).cast("long").alias("n_added"),
    )


@query("op9_pii")
def op9(spark, folder):
    return personal_data(table(spark, folder, "documents"))
