"""Benchmark decontamination by template canonicalisation.

Words (runs without white space, stripped of outer punctuation, lower-cased) become template tokens: numbers, quantities
(a number with a unit in one word), units after a number, and names (capitalised words inside a sentence) are replaced by
typed placeholders. Every window of ``WINDOW`` = 5 tokens is hashed by its words, whatever their case or type. Windows with slots are hashed
by their placeholders as well, each grown, forward from every start and backward from every end, until ``LITERALS`` of
its tokens are plain words, so that runs of placeholders do not match everything.

The windows of documents are equi-joined on their hash with those of the benchmark. Before the join, tasks drop windows
that a Bloom filter of the benchmark's windows rules out; its size is fixed by ``BLOOM_BITS`` and it never drops a match, so
what is shuffled follows the matches and not the corpus. A match lies on a diagonal (position in the document minus
position in the item). On one diagonal a slot value of the item must always meet the same value in the document and
the other way round; where more than ``SLACK`` of the slots break this, the diagonal is not a re-parameterised question
and only its windows of equal words count. A document leaks an item if these cover ``ENOUGH`` tokens of it or ``SHARE`` of
a shorter one, and ``LITERALS`` of every two windows' tokens (all plain words of an item that has fewer) are the same in both.

Defined results: null and empty texts have no tokens and no matches, on either side. Items of fewer than five tokens are
one window of their own length, compared word by word. Rows that repeat an id and a text are reported once; rows that share
an id only are judged apart by the text's hash. Null ids are reported as null. Repeated items count as one. Empty tables
give no rows. Extra columns are ignored by ``leaks`` and kept by ``clean``. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, staged, whole_text

WINDOW, LITERALS = 5, 3
ENOUGH, SHARE, SLACK = 13, 0.8, 0.2
BLOOM_BITS = 1 << 24
BATCH = 1 << 18  # tokens of windows that are handed over at once
KNOWN = 400_000  # words that a Python worker remembers before it starts afresh
WORD, NUMBER, QUANTITY, UNIT, NAME, NOTHING = range(6)
PLACEHOLDERS = ("", "<number>", "<quantity>", "<unit>", "<name>", "")

# Number words and units of the usual benchmark questions.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half".split()
)
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres centimeters kilometers "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon "
    "gallons cup cups s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "mph kph % percent degrees dollar dollars cent cents euro euros usd eur $ € £ hz khz mhz ghz kb mb gb tb w kw v j n pa".split()
)
_NUMBER = re.compile(r"[$€£]?[+-]?[0-9][0-9.,:/]*%?")
_QUANTITY = re.compile(r"[+-]?[0-9][0-9.,]*-?([^\W\d_]+|[$€£])")
_OUTER = ".,;:!?()[]{}\"'“”‘’«»*_#|&~^<>="
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


class Lexicon(dict):
    """Numbers of the distinct chunks between white space, and what is known of each in arrays under its number."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.cores: list[str] = []
        self.hashes, self.kinds = np.zeros(KNOWN, np.uint64), np.zeros(KNOWN, np.int8)
        self.units, self.capitals, self.stops = (np.zeros(KNOWN, bool) for _ in range(3))

    def __missing__(self, chunk: str) -> int:
        bare = chunk.strip(_OUTER)
        core, kind = bare.lower(), WORD
        if bare in ("%", "$", "€", "£"):
            core = bare
        elif bare.isalpha():
            kind = NUMBER if core in NUMBER_WORDS else WORD
        else:
            core = _EDGE.sub("", chunk).lower()
            if not core:
                kind = NOTHING
            elif core in NUMBER_WORDS or _NUMBER.fullmatch(bare):
                kind = NUMBER
            elif (m := _QUANTITY.fullmatch(core)) and m[1] in UNITS:
                kind = QUANTITY
        n = self[chunk] = len(self.cores)
        self.cores.append(core)
        if n == len(self.hashes):  # one text with more distinct words than are remembered
            for name in ("hashes", "kinds", "units", "capitals", "stops"):
                setattr(self, name, np.concatenate([getattr(self, name)] * 2))
        self.hashes[n], self.kinds[n], self.units[n] = _hash(core), kind, core in UNITS
        letters = chunk.lstrip("\"'“‘«([")
        self.capitals[n] = letters[:1].isupper() and len(core) > 1 and not letters[1:].isupper() and core.isalpha()
        self.stops[n] = chunk.rstrip("\"'”’»)]").endswith((".", "!", "?", ":"))
        return n

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk number, type and hash of each token of a text, without chunks of punctuation."""
        if len(self) > KNOWN * 0.9:
            self.forget()
        chunks = text.split()
        ids = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        ids = ids[self.kinds[ids] != NOTHING]
        kinds = self.kinds[ids]
        start = np.ones(len(ids), dtype=bool)
        start[1:] = self.stops[ids[:-1]]
        kinds[(kinds == WORD) & self.capitals[ids] & ~start] = NAME
        after = np.zeros(len(ids), dtype=bool)
        after[1:] = kinds[:-1] == NUMBER
        kinds[self.units[ids] & after] = UNIT
        return ids, kinds, self.hashes[ids]


_MARKS = np.array([_hash(p) for p in PLACEHOLDERS], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TEMPLATE = np.uint64(1 << 63)  # tells the hashes of placeholders from those of words


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_kept = [_powers(_STEP, 1 << 15), _powers(_BACK, 1 << 15)]  # for all but long texts


def _hashed(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the runs start to stop: a polynomial from running sums, which wrap, so that its cost knows no length."""
    n = len(values)
    up, down = _kept if n < 1 << 15 else (_powers(_STEP, n), _powers(_BACK, n))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    h = (sums[stop] - sums[start]) * down[start]
    h ^= h >> np.uint64(32)
    h *= _STEP
    return h ^ (h >> np.uint64(29))


def windows(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and hash of every window of ``size`` words."""
    start = np.arange(max(0, len(hashes) - size + 1))
    return start, start + size, _hashed(hashes, start, start + size) & ~_TEMPLATE


def template_windows(kinds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and hash of the windows with slots, grown until LITERALS of their tokens are plain words."""
    n, plain = len(kinds), kinds == WORD
    literal = np.flatnonzero(plain)
    if n < WINDOW or len(literal) < LITERALS or len(literal) == n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    before = np.concatenate([[0], np.cumsum(plain)])  # plain words before each place
    first = np.flatnonzero(before[:n] + LITERALS <= len(literal))
    until = np.maximum(first + WINDOW, literal[before[first] + LITERALS - 1] + 1)
    fits = until <= n
    start, stop = first[fits], until[fits]
    ends = np.flatnonzero(before >= LITERALS)
    since = np.minimum(ends - WINDOW, literal[before[ends] - LITERALS])
    grown = np.full(n, -1)
    grown[start] = stop
    new = (since >= 0) & (ends - since > WINDOW)
    new &= grown[np.maximum(since, 0)] != ends
    start, stop = np.concatenate([start, since[new]]), np.concatenate([stop, ends[new]])
    slots = before[stop] - before[start] < stop - start
    start, stop = start[slots], stop[slots]
    return start, stop, _hashed(np.where(plain, hashes, _MARKS[kinds]), start, stop) | _TEMPLATE


_lexicon = Lexicon()


def lexicon() -> Lexicon:
    """The one of this Python worker, so that later tasks find its memory filled."""
    return _lexicon


def _task(sizes: tuple[int, ...] | None, possible: Callable[[np.ndarray], np.ndarray] | None):
    """Windows of (key columns..., text); of ``sizes`` words, or of one size per text (its length, WINDOW at most).

    With WINDOW words come the grown windows of placeholders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon()
        for batch in batches:
            keys = batch.columns[:2]

            def made(rows, *columns):
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                return pa.RecordBatch.from_arrays([*[c.take(pa.array(rows, pa.int64())) for c in keys], *arrays], names)  # noqa: B023

            out, weight = [], 0
            for i, text in enumerate(batch.column(2)):
                ids, kinds, hashes = known.tokens(text.as_py())
                for s in sizes if sizes is not None else (min(len(ids), WINDOW),):
                    for start, stop, h in (windows(hashes, s), *([template_windows(kinds, hashes)] if s == WINDOW else [])) if s else ():
                        hit = np.flatnonzero(possible(h)) if possible else np.arange(len(h))
                        for a, b, x in zip(start[hit].tolist(), stop[hit].tolist(), h[hit].view(np.int64).tolist()):
                            out.append((i, x, a, b - a, len(ids), int((kinds == WORD).sum()) if possible is None else 0, kinds[a:b].tolist(), [known.cores[k] for k in ids[a:b]]))
                            weight += b - a
                            if weight > BATCH:
                                yield made(*zip(*out))
                                out, weight = [], 0
            yield made(*(zip(*out) if out else [()] * 8))

    names = [c.split()[0] for c in _WINDOWS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string())]
    return run


_WINDOWS = "id bigint, text_key bigint, h bigint, pos int, size int, n_tokens int, n_plain int, kinds array<int>, vals array<string>"


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(whole_text()).alias("text_key"), whole_text().alias("text"))


def _bloom(h: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test for hashes that is true for every ``h``; its bits are gathered as at most BLOOM_BITS / 64 words."""
    spots = h.select(F.explode(F.array("h", F.shiftrightunsigned("h", 32))).alias("s")).select(F.col("s").bitwiseAND(F.lit(BLOOM_BITS - 1)).alias("s"))
    bits = spots.select(F.shiftright("s", 6).alias("word"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("bit"))
    words = np.zeros(BLOOM_BITS // 64, dtype=np.uint64)
    for word, value in bits.groupBy("word").agg(F.bit_or("bit")).collect():
        words[word] = np.array(value, dtype=np.int64).view(np.uint64)
    shipped = h.sparkSession.sparkContext.broadcast(words)
    mask, six, low = np.uint64(BLOOM_BITS - 1), np.uint64(6), np.uint64(63)

    def possible(x: np.ndarray) -> np.ndarray:
        bit = lambda s: (shipped.value[(s >> six).astype(np.int64)] >> (s & low)) & np.uint64(1)
        return (bit(x & mask) & bit((x >> np.uint64(32)) & mask)).astype(bool)

    return possible


def _matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Matched windows: doc id and text key, item, its number of tokens, diagonal, position in the item, slots of both."""
    items = _keyed(benchmark, "item_id").dropDuplicates(["id", "text_key"]).mapInArrow(_task(None, None), _WINDOWS)
    items = staged(items, "template-items")
    sizes = tuple(sorted(r[0] for r in items.select(F.least("size", F.lit(WINDOW))).distinct().collect()))
    found = _keyed(docs, "doc_id").mapInArrow(_task(sizes, _bloom(items.select("h"))), _WINDOWS)
    item = items.select("h", "size", F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), F.col("pos").alias("item_pos"),
                        F.col("n_tokens").alias("item_tokens"), F.col("n_plain").alias("item_plain"), F.col("kinds").alias("item_kinds"), F.col("vals").alias("item_vals"))
    same_words = F.forall(F.zip_with("kinds", "item_kinds", lambda a, b: a == b), lambda x: x)
    plain = F.transform(F.arrays_zip("kinds", "vals"), lambda x: F.when(x["kinds"] == WORD, x["vals"]))
    item_plain = F.transform(F.arrays_zip("item_kinds", "item_vals"), lambda x: F.when(x["item_kinds"] == WORD, x["item_vals"]))
    exact = (F.col("vals") == F.col("item_vals")) | (same_words & (plain == item_plain))  # hashes may collide
    joined = found.drop("n_tokens", "n_plain").join(item, ["h", "size"]).filter(exact)
    return joined.select("id", "text_key", "item_id", "item_key", "item_tokens", "item_plain", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_pos", "kinds", "vals", "item_vals")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document text and item it leaks: doc_id, text_key, item_id, item_tokens, covered, slots, changed_slots."""
    pair = ["id", "text_key", "item_id", "item_key", "item_tokens", "item_plain"]
    place = [*pair, "diagonal"]
    zipped = F.arrays_zip("kinds", "vals", "item_vals")
    spots = staged(_matches(docs, benchmark), "template-matches").select(
        *place, "item_pos", (F.col("vals") == F.col("item_vals")).alias("equal"), F.posexplode(zipped).alias("i", "t")
    )
    spots = spots.groupBy(
        *place, (F.col("item_pos") + F.col("i")).alias("at"), F.col("t.kinds").alias("kind"), F.col("t.vals").alias("doc_val"), F.col("t.item_vals").alias("item_val")
    ).agg(F.max("equal").alias("equal"))
    slots = spots.filter(F.col("kind") != WORD)
    # A value that meets several others is at odds at all of its places.
    forth = slots.groupBy(*place, "kind", "item_val").agg(F.count(F.lit(1)).alias("n"), (F.min("doc_val") != F.max("doc_val")).alias("odd"))
    back = slots.groupBy(*place, "kind", "doc_val").agg(F.count(F.lit(1)).alias("n"), (F.min("item_val") != F.max("item_val")).alias("odd"))
    odds = forth.select(*place, "n", "odd").union(back.select(*place, "n", "odd"))
    odds = odds.groupBy(*place).agg((F.sum("n") / 2).alias("slots"), (F.sum(F.when(F.col("odd"), F.col("n")).otherwise(0)) / 2).alias("odd"))
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in place] + [~F.col("s.equal")]
    held = spots.alias("s").join(odds.filter(f"odd > {SLACK} * slots").alias("o"), on, "left_anti")
    same = F.col("doc_val") == F.col("item_val")
    kept = held.groupBy(*pair, "at").agg(
        F.max(F.when(F.col("kind") != WORD, 1).otherwise(0)).alias("slot"),
        F.max(F.when((F.col("kind") != WORD) & ~same, 1).otherwise(0)).alias("changed"),
        F.max(same.cast("int")).alias("same"),
    )
    whole = kept.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("covered"), F.sum("slot").alias("slots"), F.sum("changed").alias("changed_slots"), F.sum("same").alias("same")
    )
    worded = F.col("same") >= F.least(F.ceil(F.col("covered") / (2 * WINDOW)) * LITERALS, F.col("item_plain"))
    enough = whole.filter(worded & ((F.col("covered") >= ENOUGH) | (F.col("covered") >= F.col("item_tokens") * SHARE)))
    return enough.select(F.col("id").alias("doc_id"), "text_key", "item_id", F.col("item_tokens").cast("bigint").alias("item_tokens"), "covered", "slots", "changed_slots")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, unchanged."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_leak_id"), F.col("text_key").alias("_leak_key")).distinct()
    rows = packed(docs, F.col("doc_id").alias("id"), F.xxhash64(whole_text()).alias("text_key"))
    on = rows["id"].eqNullSafe(bad["_leak_id"]) & (rows["text_key"] == bad["_leak_key"])
    return rows.join(bad, on, "left_anti").select("row.*")
