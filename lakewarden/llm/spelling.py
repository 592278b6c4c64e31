"""Spelling variants of a vocabulary by blocked Gram matrices.

Words are the letter runs of all texts with their counts. Two words are near if one code point inserted, deleted or replaced
turns one into the other. A word's form is its most frequent near word, if that is at least ``TIMES`` as frequent; its root
is where the forms lead.

Search: one replacement changes the letter counts of a word by a squared distance of 2, one insertion or deletion by 1. Squared
distances of all words of a block against all of another come from one matrix product (the Gram matrix of their letter counts),
and only words at such a distance are compared letter by letter. A block has the words of one length that also agree in
how many of their letters fall into each of ``GROUPS`` groups of the alphabet. An edit changes the length by one at most
and moves one letter between groups at most, so a block meets few others: itself, those of the same length with one letter in
another group, and those one letter longer. Finer groups than the length keep blocks small as the vocabulary grows. A block with more than
``TILE`` words is dealt to several tiles; every pair of tiles of two blocks that meet is one row of work, so a full
block is spread over many tasks and no task holds more than two tiles at once.

Defined results: null and empty texts have no words; a null id counts as an empty one in the rule that plants damage. A table
without words gives no rows. Very long runs are words like others and have blocks of their own. Ties of the best near word
go to the first in code-point order. Repeated rows count as often as they come. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_text

SHORTEST, LEAST, TIMES, DAMAGED = 5, 3, 2, 97
GROUPS, TILE, TILE_LETTERS = 4, 2048, 1 << 20
HELD = 1 << 18  # words a task counts before it hands the counts on
LETTERS = [chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]

# One byte per code point (Latin-1): letters stay, A-Z become a-z, and all else is a blank.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))


def runs(text: str) -> list[bytes]:
    """The letter runs of a text, A-Z lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def damaged(doc: bytes, run: bytes) -> bytes:
    """The run as it counts in one document: where the checksum of id and run is divisible, one letter is missing."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(doc))
    return run if h % DAMAGED else run[: h % len(run)] + run[h % len(run) + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in total], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], ["word", "n"])

    total: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            doc = (doc_id.as_py() or "").encode() + b":"
            for run, n in Counter(runs(text.as_py())).items():
                if len(run) >= SHORTEST and len(word := damaged(doc, run)) >= SHORTEST:
                    total[word] += n
            if len(total) > HELD:
                yield out()
                total = Counter()
    if total:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least SHORTEST letters that occur LEAST times or more in all texts."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def _steps() -> list[tuple[int, ...]]:
    """What separates the blocks that meet: nothing, a letter more in one group, a letter moved between two groups (one way)."""
    unit = [tuple(int(i == g) for i in range(GROUPS)) for g in range(GROUPS)]
    moved = [tuple(a - b for a, b in zip(unit[g], unit[h])) for g in range(GROUPS) for h in range(g)]
    return [(0,) * GROUPS, *unit, *moved]


def _tiles(words: DataFrame) -> DataFrame:
    """(block, tile, words, ns): words (word, n) by block, at most about TILE of them a tile, and less of very long ones."""
    members = ["".join(c for c in LETTERS if ord(c) % GROUPS == g) for g in range(GROUPS)]
    length = F.length("word")
    counts = [length - F.length(F.translate("word", m, "")) for m in members]
    keyed = words.select("word", "n", length.alias("length"), F.array(*counts).alias("block"))
    sizes = keyed.groupBy("block").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("length") / TILE_LETTERS)).alias("tiles"))
    dealt = keyed.join(sizes, "block").withColumn("tile", F.pmod(F.xxhash64("word"), "tiles").cast("int"))
    packed = dealt.groupBy("block", "tile").agg(F.collect_list(F.struct("word", "n")).alias("rows"))
    return packed.select("block", "tile", F.col("rows.word").alias("words"), F.col("rows.n").alias("ns"))


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of one length, a row each, and their letter counts."""
    codes = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)
    used = np.unique(codes)
    counts = np.zeros((len(words), 256), dtype=np.float64 if codes.shape[1] > 2000 else np.float32)
    for c in used:
        counts[:, c] = (codes == c).sum(axis=1)
    return codes, counts


def _near(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the near words of two lists; each list has words of one length, ``b`` the same as ``a`` or one more."""
    (codes, x), (longer, y) = _letters(a), _letters(b)
    used = x.any(axis=0) | y.any(axis=0)
    x, y = x[:, used], y[:, used]
    inserted = longer.shape[1] - codes.shape[1]
    gram = x @ y.T
    distance = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * gram
    i, j = np.nonzero(distance == (1 if inserted else 2))
    left, right = [], []
    step = max(1, TILE_LETTERS * 4 // codes.shape[1])
    for at in range(0, len(i), step):  # candidates letter by letter, in bounded pieces
        p, q = i[at : at + step], j[at : at + step]
        if inserted:
            same = codes[p] == longer[q][:, :-1]
            moved = codes[p] == longer[q][:, 1:]
            ok = np.logical_and.accumulate(same, axis=1).sum(axis=1) + np.logical_and.accumulate(moved[:, ::-1], axis=1).sum(axis=1) >= codes.shape[1]
        else:
            ok = (codes[p] != longer[q]).sum(axis=1) == 1
        left.append(p[ok])
        right.append(q[ok])
    return np.concatenate(left or [i]), np.concatenate(right or [j])


def _best(words: list[str], ns: np.ndarray, of: np.ndarray, others: list[str], other_ns: np.ndarray, to: np.ndarray) -> tuple[list, ...]:
    """Per word with near words in a tile: the word, how many there are, and the best with its count."""
    rank = np.empty(len(others), dtype=np.int64)
    rank[sorted(range(len(others)), key=lambda k: (-other_ns[k], others[k]))] = np.arange(len(others))
    order = np.lexsort((rank[to], of))
    of, to = of[order], to[order]
    who, first, count = np.unique(of, return_index=True, return_counts=True)
    return [words[w] for w in who], count.tolist(), [int(other_ns[t]) for t in to[first]], [others[t] for t in to[first]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            a, na, b, nb, same = (batch.column(c)[row].as_py() for c in range(5))
            i, j = _near(a, b)
            na, nb = np.array(na, dtype=np.int64), np.array(nb, dtype=np.int64)
            sides = [_best(a, na, i, b, nb, j)] + ([] if same else [_best(b, nb, j, a, na, i)])
            words, counts, ns, forms = ([v for side in sides for v in side[c]] for c in range(4))
            if words:
                columns = [pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(ns, pa.int64()), pa.array(forms, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["word", "near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of every word of (word, n) that has near words."""
    tiles = staged(_tiles(words), "spelling-tiles")
    steps = F.array(*[F.array(*[F.lit(s) for s in step]) for step in _steps()])
    left = tiles.select("block", F.col("tile").alias("ta"), F.col("words").alias("a"), F.col("ns").alias("na"), F.explode(steps).alias("step"))
    left = left.withColumn("meets", F.zip_with("block", "step", lambda x, y: x + y))
    right = tiles.select(F.col("block").alias("meets"), F.col("tile").alias("tb"), F.col("words").alias("b"), F.col("ns").alias("nb"))
    own = F.col("block") == F.col("meets")
    pairs = left.join(right, "meets").filter(~own | (F.col("ta") <= F.col("tb")))
    work = pairs.select("a", "na", "b", "nb", (own & (F.col("ta") == F.col("tb"))).alias("same"))
    # A row is a product of two tiles, so rows and not bytes are dealt out.
    parts = max(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.count() * 4 // TILE)
    found = work.repartition(parts).mapInArrow(_compare, "word string, near bigint, best_n bigint, best string")
    best = F.min(F.struct(F.negative("best_n").alias("less"), F.col("best"))).alias("first")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", "first.best", F.negative("first.less").alias("best_n"))


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form) with a form: each round doubles the steps taken, until no word goes further.

    Counts at least double from word to form, so forms have no cycles and the rounds are few.
    """
    now = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = staged(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if stepped.filter("moved").isEmpty():
            return stepped.select("word", "root")
        now = stepped.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word of the texts: word, form, root, n, n_near, form_n."""
    words = staged(vocabulary(docs), "spelling-words")
    near = words.join(near_words(words), "word", "left")
    has = F.col("best_n") >= TIMES * F.col("n")
    found = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    found = staged(found, "spelling-forms")
    roots = _rooted(found.filter("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
