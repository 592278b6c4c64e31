"""Ranked lexical search by presence masks.

For each item the ``TOP`` documents with the highest weighted sum of saturated term frequencies are found among all
documents. The score of a document is the sum over the item's terms (repeats included) of the term's weight times
``(1000000000 * tf) div (1000 * tf + 12 * m)``, where ``m`` follows the document's length.

1. One pass over the texts keeps, per document, its length and the frequencies of the terms that any item has. Document
   frequencies, the number of documents with terms and the number of all terms are sums over all documents.
2. Each task takes its documents in blocks. A block has one bitmap per term over its documents. An item's bitmaps are
   transposed into a mask per document, which says what terms of the item it holds, and documents are grouped by their mask.
3. A mask's best possible score is the sum, over its terms, of the highest that any document of the block gets from the term.
   Masks are evaluated in descending order of it, all their documents exactly, until it is lower than the score of the
   task's ``TOP``-th best: no document left can come before it, so the rest is skipped safely.
4. The tasks' lists, at most ``TOP`` rows per item each, are ranked once more per item.

Items are a stated query set. They are searched in turns of items with ``TERMS`` terms in all at most, so what a task gets
of them is bounded however many there are.

Defined results: null and empty texts have no terms; they match nothing and don't count as documents. An item without terms, or whose
terms no document has, gives no rows. Equal scores are ranked by ascending id, null ids last. Repeated rows of documents are
ranked each; items that repeat an id are searched each, so that id has several rows of a rank. An empty table on
either side gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, whole_text

TOP, BLOCK, BITS, TERMS = 20, 8192, 1 << 26, 1 << 18
LAST = 2**63 - 1  # stands for a null id while ranking

# Bytes of UTF-8: digits, letters and all of non-ASCII stay, A-Z become a-z, the rest is a blank.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in their order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _counted(vocabulary: dict[bytes, int]) -> Callable:
    """A task that gives each document's id, number of terms, and the numbers and frequencies of known terms."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                lengths, offsets, which, often = [], [0], [], []
                for text in rows.column(1):
                    words = terms(text.as_py())
                    count = Counter(words)
                    found = sorted((vocabulary[t], count[t]) for t in count.keys() & known)
                    lengths.append(len(words))
                    which += [t for t, _ in found]
                    often += [n for _, n in found]
                    offsets.append(len(which))
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, kind)) for v, kind in ((which, pa.int32()), (often, pa.int64()))]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return task


def _norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """75 + (25 * n * N) div L per document, in exact integers."""
    if len(n) and int(n.max()) * 25 * n_docs >= 2**63:
        return np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], dtype=np.int64)
    return 75 + 25 * n * n_docs // max(1, n_terms)


def _masks(held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents grouped by their mask: the distinct masks as bits, and the documents in the order of their masks with each group's start.

    ``held`` has a packed bitmap over the documents per term; documents without any of the terms are left out.
    """
    some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(held, axis=0)))
    bits = np.unpackbits(held, axis=1)[:, some].T
    packed = np.packbits(bits, axis=1)
    wide = np.zeros((len(some), -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : packed.shape[1]] = packed
    words = wide.view("<u8")
    order = np.lexsort(words.T)
    new = np.concatenate([[True], (words[order[1:]] != words[order[:-1]]).any(axis=1)]) if len(some) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    return bits[order[first]], some[order], np.append(first, len(some))


class _Best:
    """The TOP best (score, id) of an item so far in a task, best first."""

    def __init__(self) -> None:
        self.scores, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == TOP else 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        near = (scores > 0) & (scores >= self.least())
        scores, ids = np.concatenate([self.scores, scores[near]]), np.concatenate([self.ids, ids[near]])
        order = np.lexsort((ids, -scores))[:TOP]
        self.scores, self.ids = scores[order], ids[order]


def _searched(items: list[tuple[int, list[tuple[int, int]]]], weights: np.ndarray, n_docs: int, n_terms: int) -> Callable:
    """A task that gives its best documents per item; ``items`` have a number and (term, repeats)."""

    def search(best: dict[int, _Best], ids: np.ndarray, n: np.ndarray, which: np.ndarray, of: np.ndarray, tf: np.ndarray) -> None:
        parts = 1_000_000_000 * tf // (1000 * tf + 12 * _norms(n, n_docs, n_terms)[of])
        order = np.argsort(which, kind="stable")
        which, of, parts = which[order], of[order], parts[order]
        present, start = np.unique(which, return_index=True)
        end = np.append(start[1:], len(which))
        bitmaps = np.zeros((len(present), -(-len(ids) // 8)), dtype=np.uint8)
        for row, (s, e) in enumerate(zip(start, end)):
            held = np.zeros(len(ids), dtype=bool)
            held[of[s:e]] = True
            bitmaps[row] = np.packbits(held)
        most = np.maximum.reduceat(parts, start) if len(which) else parts
        row_of = {t: row for row, t in enumerate(present.tolist())}
        for number, needed in items:
            rows = [(row_of[t], weights[t] * r) for t, r in needed if t in row_of]
            if not rows:
                continue
            at, scale = np.array([r for r, _ in rows]), np.array([w for _, w in rows], dtype=np.int64)
            bits, docs, starts = _masks(bitmaps[at])
            bounds = bits.astype(np.int64) @ (scale * most[at])
            found = best[number]
            for g in np.argsort(-bounds, kind="stable").tolist():
                if bounds[g] <= 0 or bounds[g] < found.least():
                    break
                group = docs[starts[g] : starts[g + 1]]
                scores = np.zeros(len(group), dtype=np.int64)
                for k in np.flatnonzero(bits[g]).tolist():
                    s, e = start[at[k]], end[at[k]]
                    scores += scale[k] * parts[s + np.searchsorted(of[s:e], group)]
                found.add(scores, ids[group])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {number: _Best() for number, _ in items}
        block = max(8, min(BLOCK, BITS // max(len(needed) for _, needed in items))) if items else BLOCK
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                rows = batch.slice(at, block)
                ids, n = (rows.column(c).fill_null(LAST).to_numpy(zero_copy_only=False) for c in range(2))
                which, tf = (rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
                of = np.repeat(np.arange(rows.num_rows), rows.column(2).value_lengths().to_numpy(zero_copy_only=False))
                search(best, ids, n, which, of, tf)
        for number, found in best.items():
            if len(found.ids):
                missing = pa.array(found.ids == LAST)
                columns = [pa.array([number] * len(found.ids), pa.int64()), pa.array(found.ids, mask=missing.to_numpy(zero_copy_only=False)), pa.array(found.scores)]
                yield pa.RecordBatch.from_arrays(columns, ["number", "doc_id", "score"])

    return task


def _turns(items: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items (number, text) from the driver's iterator over the query set, in runs of bounded size."""
    every = ((r.number, terms(r.text)) for r in items.select("number", "text").toLocalIterator())
    run, size = [], 0
    for item in every:
        if run and size + len(item[1]) > TERMS:
            yield run
            run, size = [], 0
        run.append(item)
        size += len(item[1])
    if run:
        yield run


def _turn(docs: DataFrame, items: list[tuple[int, list[bytes]]]) -> DataFrame:
    """The best documents (number, rank, doc_id, score) of some items."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, words in items for t in words}))}
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    counted = staged(rows.mapInArrow(_counted(vocabulary), "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"), "ranking-terms")
    total = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    frequencies = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for r in frequencies.collect():  # one row per term of the items of this turn
        weights[r.t] = weight(total.docs, r.df)
    needed = [(number, sorted(Counter(vocabulary[t] for t in words).items())) for number, words in items]
    task = _searched([(number, n) for number, n in needed if n], weights, total.docs, total.terms)
    found = counted.filter(F.size("terms") > 0).mapInArrow(task, "number bigint, doc_id bigint, score bigint")
    first = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= TOP)


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The TOP best documents of each item (item_id, text): item_id, rank, doc_id, score."""
    numbered = staged(items.select("item_id", whole_text().alias("text")).withColumn("number", F.monotonically_increasing_id()), "ranking-items")
    turns = [_turn(docs, run) for run in _turns(numbered)]
    names = numbered.select("number", "item_id")
    if not turns:
        return names.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score"))
    return reduce(DataFrame.union, turns).join(names, "number").select("item_id", "rank", "doc_id", "score")
