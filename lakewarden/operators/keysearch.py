"""Minimal keys of wide tables by hitting sets.

Two rows differ in some set of columns, and every key must hold a column of each such *difference set*; a set of columns that
meets all of them is a key. Instead of going through column sets, the search learns difference sets: the next candidate is the
smallest set of columns that meets all that are known (of several, the first in the order of the columns); whole-table
aggregates look for rows that agree on it; what these rows differ in is learnt. The first candidate without such rows is the
smallest key there is, because every key meets all known sets and none that comes before it does. Pairs that were
learnt decide how fast the search ends, never what it finds.

Candidates first meet the rows of a share of their values, which refutes most at the cost of one scan; only those that
pass are grouped over the whole table. Groups hold counts and two hashes, so they are combined before the shuffle and a
frequent value costs one row per task. The driver gets ``LEARNT`` pairs per refutation at most, as hashes of their
columns, and holds the difference sets as bit masks, of which supersets of others are dropped.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEARNT = 1000  # pairs learnt from one refutation
SEEDS = 8  # column sets whose colliding rows start the search
TRIAL = 1_000_000  # rows on whose values a candidate is tried first


def minimal(masks: set[int]) -> list[int]:
    """The masks that hold no other mask, those of fewest columns first."""
    kept: list[int] = []
    for mask in sorted(masks, key=lambda m: (m.bit_count(), m)):
        if not any(k & mask == k for k in kept):
            kept.append(mask)
    return kept


def _disjoint(masks: list[int], open_columns: int) -> int:
    """How many columns ``masks`` need at least: so many of them share no open column."""
    seen = count = 0
    for mask in masks:
        if not mask & open_columns & seen:
            seen |= mask & open_columns
            count += 1
    return count


def smallest_hitting_set(masks: list[int], reach: list[float], least: float) -> tuple[int, ...] | None:
    """The smallest set of columns that meets every mask and whose distinct counts multiply to ``least`` at least.

    Columns are numbers; of several sets of the smallest size the first in lexicographic order. None if there is no set.
    """
    width = len(reach)
    best_left = [sorted(reach[i:], reverse=True) for i in range(width + 1)]

    def extend(chosen: tuple[int, ...], after: int, unmet: list[int], product: float, size: int) -> tuple[int, ...] | None:
        left = size - len(chosen)
        if not left:
            return chosen if not unmet and product >= least else None
        most = product
        for r in best_left[after][:left]:
            most *= r
        open_columns = ((1 << width) - 1) >> after << after
        if most < least or width - after < left or any(not m & open_columns for m in unmet) or _disjoint(unmet, open_columns) > left:
            return None
        last = min([(m & open_columns).bit_length() for m in unmet], default=width)  # a mask's last column must not be passed
        for column in range(after, last):
            bit = 1 << column
            found = extend((*chosen, column), column + 1, [m for m in unmet if not m & bit], product * reach[column], size)
            if found:
                return found
        return None

    if any(not m for m in masks):
        return None
    return next((s for size in range(1, width + 1) if (s := extend((), 0, masks, 1.0, size))), None)


def _collisions(df: DataFrame, names: list[str], chosen: tuple[int, ...], share: int) -> set[int]:
    """Difference sets of rows that agree on the chosen columns, of one value in ``share`` only; empty if no rows agree."""
    row = F.xxhash64(*[part for n in names for part in (F.col(f"`{n}`"), F.col(f"`{n}`").isNull())])
    key = [F.col(f"`{names[i]}`") for i in chosen]
    some = df if share == 1 else df.filter(F.pmod(F.xxhash64(*key), F.lit(share)) == 0)
    groups = some.select(*[k.alias(f"k{i}") for i, k in enumerate(key)], row.alias("h"))
    groups = groups.groupBy(*[f"k{i}" for i in range(len(key))]).agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("a"), F.max("h").alias("b"))
    pairs = [(r.a, r.b) for r in groups.filter("n > 1").select("a", "b").limit(LEARNT).collect()]
    if any(a == b for a, b in pairs):
        return {0}  # whole rows repeat
    wanted = df.sparkSession.createDataFrame([(h,) for h in sorted({h for p in pairs for h in p})], "h bigint")
    cell = [F.when(F.col(f"`{n}`").isNotNull(), F.xxhash64(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(names)]
    rows = df.select(row.alias("h"), *cell).join(F.broadcast(wanted), "h").groupBy("h").agg(*[F.first(f"c{i}").alias(f"c{i}") for i in range(len(names))])
    cells = {r.h: r[1:] for r in rows.collect()} if pairs else {}
    return {sum(1 << i for i, (x, y) in enumerate(zip(cells[a], cells[b])) if x != y) for a, b in pairs}


def _seed(names: list[str]) -> int:
    """A seed that follows the column names, so that a search can be repeated."""
    return sum(ord(c) * (i + 1) for i, c in enumerate("|".join(names)))


def smallest_key(df: DataFrame, names: list[str], distinct: list[float], rows: int) -> tuple[tuple[int, ...] | None, int]:
    """The smallest key among the columns, as their numbers, or None; and how many column sets were tested.

    ``names`` stand in the order in which keys of one size are preferred. ``distinct`` are upper bounds of the columns'
    distinct values, NULL included: a set whose bounds multiply to less than ``rows`` can't be a key.
    """
    if not rows:
        return None, 0
    width, share, rng = len(names), max(1, rows // TRIAL), random.Random(_seed(names))
    known: set[int] = set()
    tested = 0
    for _ in range(SEEDS if width > 2 else 0):  # sets that nearly tell rows apart: what agrees on them differs in little
        order, chosen, product = rng.sample(range(width), width), [], 1.0
        while order and product < rows / 4:
            chosen.append(order.pop())
            product *= distinct[chosen[-1]]
        if order:
            known |= _collisions(df, names, tuple(chosen), share)
            tested += 1
    everything = False
    while True:
        masks = minimal(known)
        candidate = smallest_hitting_set(masks, distinct, rows)
        if candidate is None:
            return None, tested
        tested += 1
        found = _collisions(df, names, candidate, share)
        if not found and share > 1:
            found = _collisions(df, names, candidate, 1)
            if found and not everything:  # a table without any key is told by one more pass
                everything = True
                found |= _collisions(df, names, tuple(range(width)), 1)
        if not found:
            return candidate, tested
        known = set(masks) | found
