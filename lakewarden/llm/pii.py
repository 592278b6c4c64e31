"""Personal data by boosted trees over candidate spans, in DataFrame functions only.

Base spans come from the formats of e-mail addresses, IPv4 addresses, card numbers and phone numbers with their checks.
Wider generators propose further spans, which may overlap: addresses written with (at) or without a domain ending,
dotted numbers of any length, digit groups with other separators, phone numbers without a plus sign. Each candidate
gets features of its format and of its surroundings. Trees are boosted on all candidates, counted by their features so that
equal ones are one row with a weight: those that hold a
base span of their kind are positive, those that break a rule of the kind (digits, check digit, octets, an ending, letters
right beside them, another kind's base span in their place) are negative, and the rest is unlabelled and left out. The
features do not name the format's literal signs, so that other spellings of the same thing score high. Per kind, the lowest threshold at which the held-out half of the candidates reaches ``PRECISION`` is taken.
Chosen candidates that do not overlap base spans or better candidates are added to the base spans.

All of it is expressions: matches are split and extracted by possessive patterns, which need neither backtracking
nor recursion on long texts, and trees become CASE expressions. The text is scanned once; what is staged is a few
numbers per candidate.

Defined results: a null text is empty and has no spans; nulls, repeated and extra columns do no harm; rows are
reported as often as they come; an empty table gives no rows. Offsets count code points, ends are exclusive. Without
candidates of both labels no tree is grown and only base spans are reported. Texts are scanned whole.
"""

from __future__ import annotations

from math import isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_text

TREES, DEPTH, SEED = 8, 3, 7
BINS = 32  # of a feature, at least
PRECISION = 0.98
KINDS = ("email", "ip", "card", "phone")

# The base formats. A match starts where the one before ended or where its first class of characters
# starts, which is where a leftmost search finds it; possessive groups match the same as greedy ones here.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[(\[{]at[)\]}]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{]dot[)\]}]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:(?:\.|\[\.\])[0-9]++)++",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}+[0-9]){11,22}+",
    "phone": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,17}+(?![0-9])",
}
ANY = r"[0-9@]|[(\[{]at[)\]}]"
CUES = {
    "email": r"(?i)mail|contact|write|@",
    "ip": r"(?i)\bip\b|host|server|address|addr",
    "card": r"(?i)card|visa|master|amex|credit|payment",
    "phone": r"(?i)phone|tel|call|fax|mobile|cell",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
FEATURES = ("kind", "digits", "letters", "groups", "longest", "length", "luhn", "octets", "ending", "before", "after", "cue")
#: Rules that a span of a kind never breaks.
BREAKS = {
    "email": lambda x: x["ending"] < 2, "ip": lambda x: x["octets"] == 0, "card": lambda x: x["luhn"] == 0,
    "phone": lambda x: ~x["digits"].between(9, 15) | (x["octets"] == 1),
}
_SPAN = "array<struct<start:int,end:int,hit:string,left:string,right:string>>"


def _spans(hits: Column, parts: Column) -> Column:
    """Start, end, text and surroundings of each match, from the matches and the texts between them."""
    step = lambda acc, i: F.struct(
        (acc["at"] + F.length(parts[i]) + F.length(hits[i])).alias("at"),
        F.array_append(acc["out"], F.struct(
            (acc["at"] + F.length(parts[i])).alias("start"), (acc["at"] + F.length(parts[i]) + F.length(hits[i])).alias("end"),
            hits[i].alias("hit"), F.right(parts[i], F.lit(30)).alias("left"), F.left(parts[i + 1], F.lit(1)).alias("right"),
        )).alias("out"),
    )
    none = F.expr(f"cast(array() as {_SPAN})")
    walked = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, walked).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit holds; the digits are at most a few dozen."""
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    digit = lambda i: F.substring(digits, -i, F.lit(1)).cast("int")
    double = lambda i: digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)
    each = F.transform(at, lambda i: F.coalesce(F.when(i % 2 == 0, double(i)).otherwise(digit(i)), F.lit(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    """The check of a base match; email addresses need none."""
    if kind == "ip":
        return hit.rlike(OCTETS)
    if kind == "card":
        return _luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _features(kind: str, x: Column) -> Column:
    """A candidate with its features. Signs that only the base format asks for ('+', '@', '.') are not among them."""
    hit = x["hit"]
    digits, groups = _digits(hit), F.regexp_extract_all(hit, F.lit("([0-9]+|[A-Za-z]+)"), F.lit(1))
    side = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike("[A-Za-z_=:/]"), 2).when(c.rlike("[0-9]"), 3).otherwise(1)
    lengths = F.transform(groups, lambda g: F.length(g))
    card_size = F.length(digits).between(13, 19)
    values = {
        "kind": F.lit(KINDS.index(kind)), "digits": F.length(digits), "letters": F.length(F.regexp_replace(hit, "[^A-Za-z]", "")),
        "groups": F.size(groups), "longest": F.coalesce(F.array_max(lengths), F.lit(0)), "length": F.length(hit),
        "luhn": F.when(card_size, _luhn(digits).cast("int")).otherwise(0),
        "octets": F.regexp_replace(hit, r"\[\.\]", ".").rlike(OCTETS).cast("int"),
        "ending": F.length(F.regexp_extract(hit, r"(?:\.|dot[)\]}]\x20?)([A-Za-z]+)$", 1)),
        "before": side(F.right(x["left"], F.lit(1))), "after": side(x["right"]), "cue": x["left"].rlike(CUES[kind]).cast("int"),
    }
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), *[values[f].cast("double").alias(f) for f in FEATURES])


def candidates(docs: DataFrame) -> DataFrame:
    """Per document its base spans and candidates: doc_id, base_<kind>, wide_<kind>; staged, in one scan of the texts."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    names = [(f"{group}_{kind}", pattern) for group, patterns in (("base", BASE), ("wide", WIDE)) for kind, pattern in patterns.items()]
    any_hit, none = F.col("text").rlike(ANY), F.expr("cast(array() as array<string>)")
    rows = rows.select("*", *[F.when(any_hit, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(n) for n, p in names])
    rows = rows.select("doc_id", *[n for n, _ in names], *[
        F.when(F.size(n) > 0, F.split("text", p, -1)).otherwise(none).alias(f"parts_{n}") for n, p in names
    ])
    rows = rows.select("doc_id", *[_spans(F.col(n), F.col(f"parts_{n}")).alias(n) for n, _ in names])
    ends = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))

    def base(kind: str) -> Column:
        return F.transform(F.filter(f"base_{kind}", lambda x: _valid(kind, x["hit"])), ends).alias(f"base_{kind}")

    def wide(kind: str) -> Column:
        return F.transform(f"wide_{kind}", lambda x: _features(kind, x)).alias(f"wide_{kind}")

    return staged(rows.select("doc_id", *[base(k) for k in KINDS], *[wide(k) for k in KINDS]), "pii")


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _counted(rows: DataFrame) -> DataFrame:
    """All candidates with label (a base span of the kind lies in it) and fold (by hash): how many (n) of each have the same features."""

    def labelled(kind: str) -> DataFrame:
        """The labels are set inside the array: an exploded row carries its candidate and nothing of its document."""
        others = F.concat(*[F.col(f"base_{k}") for k in KINDS if k != kind])

        def label(x: Column) -> Column:
            hit = F.exists(f"base_{kind}", lambda b: _overlaps(x, b) & (b["end"] <= x["end"]) & (b["start"] >= x["start"] - 1))
            beside = x["after"].isin(2.0, 3.0) | (x["before"].isin(2.0, 3.0) & F.lit(kind != "email"))
            wrong = BREAKS[kind](x) | beside | F.exists(others, lambda b: _overlaps(x, b))
            return F.when(hit, 1.0).when(wrong, 0.0)

        marked = F.transform(f"wide_{kind}", lambda x: F.struct(label(x).alias("label"), F.xxhash64("doc_id", x).alias("mark"), *[x[f].alias(f) for f in FEATURES]))
        return rows.select(F.explode(marked).alias("x")).select("x.*").filter("label is not null")

    found = labelled(KINDS[0])
    for kind in KINDS[1:]:
        found = found.union(labelled(kind))
    folded = found.withColumn("fold", F.pmod(F.shiftright("mark", 32), F.lit(2)))
    return staged(folded.groupBy("fold", "label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n")), "pii")


def _tree(node, x: Column) -> Column:
    """A fitted tree as a CASE expression."""
    if not node.getClass().getSimpleName().startswith("Internal"):
        return F.lit(float(node.prediction()))
    split = node.split()
    test = x[FEATURES[split.featureIndex()]] <= F.lit(float(split.threshold()))
    return F.when(test, _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


class Model:
    """Boosted trees and a threshold per kind."""

    def __init__(self, roots: list, weights: list[float], thresholds: dict[str, float]):
        self.roots, self.weights, self.thresholds = roots, weights, thresholds

    def score(self, x: Column) -> Column:
        margin = sum((F.lit(w) * _tree(r, x) for w, r in zip(self.weights, self.roots)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def fit(rows: DataFrame, precision: float = PRECISION) -> Model | None:
    """Trees from one half of the candidates, thresholds from the other; None without both labels."""
    seen = _counted(rows)
    half = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(seen.filter("fold = 0"))
    if half.select("label").distinct().count() < 2:
        return None
    bins = max(BINS, isqrt(half.count()) + 1)  # with as many squared as rows, the splits too are found on all of them
    boosted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=bins, seed=SEED, stepSize=0.3, checkpointInterval=-1, weightCol="n").fit(half)
    roots = [t._call_java("rootNode") for t in boosted.trees]
    model = Model(roots, [float(w) for w in boosted.treeWeights], {})
    x = F.struct(*[F.col(f) for f in FEATURES])
    scored = seen.filter("fold = 1").select("label", "kind", "n", x.alias("x")).select("label", "kind", "n", F.floor(model.score(F.col("x")) * 50).alias("bin"))
    scores = scored.groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good")).collect()
    for i, kind in enumerate(KINDS):
        own, n, good = sorted((r for r in scores if r["kind"] == i), key=lambda r: -r["bin"]), 0.0, 0.0
        for r in own:
            n, good = n + r["n"], good + r["good"]
            if r["bin"] >= 25 and good / n >= precision:
                model.thresholds[kind] = r["bin"] / 50
    return model


def selected(rows: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, base_<kind> and all_<kind>: the base spans and those with the chosen candidates, each by start."""
    if model is None:
        return rows.select("doc_id", *[f"base_{k}" for k in KINDS], *[F.col(f"base_{k}").alias(f"all_{k}") for k in KINDS])
    bases = F.concat(*[F.col(f"base_{k}") for k in KINDS])

    def chosen(kind: str) -> Column:
        free = F.filter(f"wide_{kind}", lambda x: ~F.exists("bases", lambda b: _overlaps(x, b)))
        span = lambda x: F.struct(model.score(x).alias("score"), x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))
        return F.filter(F.transform(free, span), lambda x: x["score"] >= model.thresholds.get(kind, 2.0))

    rows = rows.withColumn("bases", bases)
    rows = rows.select("doc_id", *[f"base_{k}" for k in KINDS], F.concat(*[chosen(k) for k in KINDS]).alias("new"))
    better = lambda y, x: (y["score"] > x["score"]) | ((y["score"] == x["score"]) & (y["start"] < x["start"])) | (
        (y["score"] == x["score"]) & (y["start"] == x["start"]) & (y["kind"] < x["kind"])
    )
    rows = rows.withColumn("new", F.filter("new", lambda x: ~F.exists("new", lambda y: _overlaps(x, y) & better(y, x))))
    added = lambda kind: F.transform(F.filter("new", lambda x: x["kind"] == kind), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return rows.select("doc_id", *[f"base_{k}" for k in KINDS], *[F.array_sort(F.concat(f"base_{k}", added(k))).alias(f"all_{k}") for k in KINDS])


def _listed(group: str) -> Column:
    def texts(kind: str) -> Column:
        return F.transform(f"{group}_{kind}", lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    return F.array_join(F.concat(*[texts(k) for k in KINDS]), ",")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_<kind> (base spans), base_sha256, spans (base and added), n_added."""
    rows = candidates(docs)
    found = selected(rows, fit(rows))
    counts = [F.size(f"base_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS]
    n_all = sum((F.size(f"all_{k}") for k in KINDS), F.lit(0)) - sum((F.size(f"base_{k}") for k in KINDS), F.lit(0))
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("all").alias("spans"), n_all.cast("bigint").alias("n_added"))
