"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, replaces letters of other scripts that look like Latin ones and full-width forms, and turns
digits and signs inside words into the letters they stand for. Everything but letters then separates words.

The lexicon holds whole words and word beginnings, learned from a bounded sample of labelled rows: an entry must be
clearly more frequent in toxic than in other texts, and its weight is the log ratio of the two rates. Toxic texts count
once per least hash of three words, which near copies share, so that a family of copies does not make its rare words toxic. A
beginning counts if several words share it, so that unseen endings are caught. All entries and the exception phrases form one
automaton. Within a word the heaviest entry counts; entries inside an exception phrase (given, or learned as a phrase
that only other texts contain) count nothing. The weights' sum is divided by the root of the number of words, and a
logistic curve over this and the heaviest entry gives the score.

Defined results: null and empty texts and texts without letters score as texts without a match. Rows with null ids are
scored and are not held out. Without labelled rows every score is 0; with one class only, it is that class's smoothed
rate plus what matches add. Repeated rows score alike; extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, packed, staged, training_sample, whole_text

SAMPLE = 12_000  # labelled rows that the lexicon and the curve are fitted on
MIN_TEXTS = 3  # toxic texts, near copies counting once, that must contain an entry
MIN_WEIGHT = 4.0  # of a word; at one toxic text in ten, an entry is then six times as often in toxic as in other texts
MIN_START = 4.5  # of a beginning, which meets more innocent words
PURITY = 30  # toxic texts per other text, at least, among those that contain an entry
PREFIXES = (4, 5, 6, 7)
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown")

# Letters of other scripts by the Latin letter they look like, and signs by the letter they stand for.
HOMOGLYPHS = str.maketrans("авекмнорстухіјѕԁԛԝαεικνορτυχ", "abekmhopctyxijsdqwaeikvoptux")
SUBSTITUTES = str.maketrans("01345789@$!", "oieastbgasi")

_OTHER_SCRIPT = re.compile("[Ͱ-ԯ]")
_FULL_WIDTH = re.compile("[！-～]")
_SIGN = re.compile(r"[0-9@$]|!(?=[^\W\d_])")
_MIXED = re.compile(r"[^\W\d_][0-9@$!]+[^\W\d_]|\b[0-9@$]+[^\W\d_]{2}|[^\W\d_]{2}[0-9@$]+\b")
_TOKEN = re.compile(r"[\w@$!]+")
_BLANK = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def fold(text: str) -> str:
    """Folded words between single or several blanks, with one blank at either end."""
    text = text.lower()
    if not text.isascii():
        if _FULL_WIDTH.search(text):
            text = _FULL_WIDTH.sub(lambda m: chr(ord(m[0]) - 0xFEE0), text).lower()
        if _OTHER_SCRIPT.search(text):
            text = text.translate(HOMOGLYPHS)
    if _SIGN.search(text):
        text = _TOKEN.sub(lambda m: m[0].translate(SUBSTITUTES) if _MIXED.search(m[0]) else m[0], text)
    return f" {text.encode('utf-8', 'replace').translate(_BLANK).decode()} "


@dataclass(frozen=True)
class Model:
    """Entries are ' word ' or ' beginning' with their weights; the curve is (bias, by mean, by heaviest)."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    fitted: bool = False


class Matcher:
    """The automaton of a model's entries and exception phrases."""

    def __init__(self, model: Model):
        self.machine = ahocorasick.Automaton()
        for entry, weight in model.entries.items():
            self.machine.add_word(entry, (len(entry), weight))
        for phrase in model.exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(self.machine):
            self.machine.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Weight of the heaviest entry by the position of its word, without words inside exceptions."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if not len(self.machine):
            return found
        for end, (length, weight) in self.machine.iter(folded):
            at = end - length + 1
            if weight is None:
                spared.append((at, end))
            elif weight > found.get(at, 0):
                found[at] = weight
        for at, end in spared:
            for i in [i for i in found if at <= i < end]:
                del found[i]
        return found

    def features(self, text: str | None) -> tuple[float, float, int]:
        folded = fold(text or "")
        weights = self.hits(folded).values()
        return (sum(weights) / max(1, len(folded.split())) ** 0.5, max(weights, default=0.0), len(weights)) if weights else (0.0, 0.0, 0)


def _labelled(found: Callable[[str], set[str]], name: str):
    """A task that yields what ``found`` returns for each text, with the text's label and its least shingle hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items = sorted(found(text))
                words = fold(text).split()
                family = min((zlib.crc32(" ".join(w).encode()) for w in zip(words, words[1:], words[2:])), default=zlib.crc32(text.encode()))
                values = [pa.array(items, pa.string()), pa.array([label] * len(items), pa.int64()), pa.array([family] * len(items), pa.int64())]
                yield pa.RecordBatch.from_arrays(values, [name, "label", "family"])

    return run


def _counted(rows: DataFrame, found: Callable[[str], set[str]], name: str) -> DataFrame:
    """(name, bad, good): families of toxic texts and number of other texts that contain each item."""
    each = rows.mapInArrow(_labelled(found, name), f"{name} string, label long, family long")
    families = each.groupBy(name, "family").agg(F.max("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    return families.groupBy(name).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _phrases_of(model: Model) -> Callable[[str], set[str]]:
    """Two-word phrases around a text's matches."""
    built: list[Matcher] = []

    def found(text: str) -> set[str]:
        if not built:  # once per task
            built.append(Matcher(model))
        folded, phrases = fold(text), set()
        for at in built[0].hits(folded):
            before, after = folded[max(0, at - 60) : at].split(), folded[at : at + 120].split()
            phrases |= {f"{before[-1]} {after[0]}"} if before else set()
            phrases |= {f"{after[0]} {after[1]}"} if len(after) > 2 else set()
        return phrases

    return found


def _weighted(counts: DataFrame, toxic: int, clean: int, least: float) -> DataFrame:
    """(entry, weight) of the entries that are clearly more frequent in toxic texts."""
    rate = (F.col("bad") + 0.5) / F.lit(toxic + 1.0) / ((F.col("good") + 0.5) / F.lit(clean + 1.0))
    return counts.withColumn("weight", F.log(rate)).filter(f"bad >= {MIN_TEXTS} and weight >= {least} and bad >= {PURITY} * good")


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small penalty."""
    z, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 0.1 * np.eye(3), z.T @ (p - y) + 0.1 * w)
        w -= np.clip(step, -2, 2)
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Lexicon, exceptions and curve from at most about ``sample`` labelled rows outside the held-out fold.

    The lexicon comes from two thirds of the sample and the curve from the rest, so that it knows how far chance entries
    can be trusted. Exact copies in the sample count once. Counting is done by Spark; what reaches the driver is the lexicon and
    three numbers per sampled row.
    """
    rows = staged(training_sample(docs, labels, label, sample).groupBy("text").agg(F.max("label").alias("label")), "toxicity")
    if rows.isEmpty():
        return Model({}, exceptions)
    third = F.pmod(F.xxhash64("text"), F.lit(3))
    rows, rest = rows.filter(third > 0), rows.filter(third == 0)
    sizes = {r["label"] > 0: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    counts = staged(_counted(rows, lambda text: set(fold(text).split()), "word"), "toxicity")
    words = _weighted(counts, toxic, clean, MIN_WEIGHT).select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("entry"), "weight")
    starts = counts.select("*", F.explode(F.array(*[F.lit(n) for n in PREFIXES])).alias("n")).filter("length(word) > n")
    starts = starts.groupBy(F.concat(F.lit(" "), F.substring("word", F.lit(1), F.col("n"))).alias("entry")).agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count_if(F.col("bad") > 0).alias("endings")
    )
    starts = _weighted(starts, toxic, clean, MIN_START).filter("endings >= 3").select("entry", "weight")
    model = Model({r["entry"]: r["weight"] for r in words.union(starts).collect()}, exceptions)
    phrases = _counted(rows, _phrases_of(model), "phrase")
    learned = [r["phrase"] for r in phrases.filter(f"good >= {MIN_TEXTS} and bad * 10 < good").collect()]
    model = Model(model.entries, (*exceptions, *sorted(learned)))
    seen = rest.select("label", features_column(model)(F.col("text")).alias("f")).select("label", "f.*").toPandas()
    curve = _curve(seen[["mean", "heaviest"]].to_numpy(float), seen["label"].to_numpy(float))
    return Model(model.entries, model.exceptions, curve, True)


def features_column(model: Model):
    @F.pandas_udf("mean double, heaviest double, hits long")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(model)
        for texts in batches:
            yield pd.DataFrame([matcher.features(t) for t in texts], columns=["mean", "heaviest", "hits"])

    return features


def score_of(model: Model, features: Column) -> Column:
    if not model.fitted:
        return F.lit(0.0)
    bias, mean, heaviest = model.curve
    return 1 / (1 + F.exp(-(F.lit(bias) + F.lit(mean) * features["mean"] + F.lit(heaviest) * features["heaviest"])))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, hits."""
    model = fit(docs, labels)
    rows = docs.select("doc_id", features_column(model)(whole_text()).alias("f"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_of(model, F.col("f")).alias("score"), F.col("f.hits").alias("hits"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged."""
    model = fit(docs, labels)
    rows = packed(docs, features_column(model)(whole_text()).alias("f"))
    return rows.filter(score_of(model, F.col("f")) < threshold).select("row.*")
