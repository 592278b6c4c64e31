"""Reconciliation by range checksums: two tables are compared key by key only where they differ.

Both sides sum up key ranges: the number of rows and two sums of row hashes, which no order of rows changes. Ranges with equal sums
are equal and are not looked at again. Those that differ are cut into smaller ranges and summed again, read by a filter on the key
that reaches the scan, until a range holds ``LEAF`` rows at most. The exact comparisons of ``reconcile`` then run inside the
ranges that are left. Sums are combined before the shuffle, and the driver holds sums of ranges, never keys of rows beyond
``CUTS`` sampled bounds per level.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import reconcile

FAN = 64  # ranges that a level cuts the table, or what is left of it, into
CUTS = 4096  # keys sampled for the bounds of a level
LEAF = 20_000  # rows of a range that is not cut any further
MOST = 1000  # ranges in a filter; if more differ, neighbours are joined


@dataclass(frozen=True)
class KeyRange:
    """Keys from ``low`` on and below ``high``; None is open. NULL keys belong to the range that is open below."""

    low: object = None
    high: object = None
    left_rows: int = 0
    right_rows: int = 0

    @property
    def rows(self) -> int:
        return max(self.left_rows, self.right_rows)

    def holds(self, key: str) -> Column:
        c = F.col(f"`{key}`")
        above = F.lit(True) if self.low is None else c >= F.lit(self.low)
        inside = above if self.high is None else above & (c < F.lit(self.high)) if self.low is not None else c < F.lit(self.high)
        return inside if self.low is not None else inside | c.isNull()


def within(df: DataFrame, key: str, ranges: list[KeyRange]) -> DataFrame:
    """The rows whose key lies in one of the ranges."""
    if any(r.low is None and r.high is None for r in ranges):
        return df
    return df.filter(reduce(lambda a, b: a | b, [r.holds(key) for r in ranges], F.lit(False)))


def outside(df: DataFrame, key: str, ranges: list[KeyRange]) -> DataFrame:
    """The rows whose key lies in none of the ranges."""
    held = reduce(lambda a, b: a | b, [r.holds(key) for r in ranges], F.lit(False))
    return df.filter(~F.coalesce(held, F.lit(False)))


def _cut(df: DataFrame, key: str, ranges: list[KeyRange]) -> list[KeyRange]:
    """The ranges cut at sampled keys, about FAN pieces in all."""
    c = F.col(f"`{key}`")
    picked = df.select(c.alias("key")).filter(c.isNotNull()).orderBy(F.xxhash64("key"), "key").limit(CUTS)
    keys = sorted(r.key for r in picked.collect())
    step = max(1, len(keys) // FAN)
    bounds = sorted({k for k in keys[step::step]})
    out = []
    for r in ranges:
        cuts = [b for b in bounds if (r.low is None or b > r.low) and (r.high is None or b < r.high)]
        edges = [r.low, *cuts, r.high]
        out += [KeyRange(a, b) for a, b in zip(edges, edges[1:])]
    return out


def _number(key: str, ranges: list[KeyRange]) -> Column:
    """The number of the range that holds the key: how many of the sorted lower bounds are at or below it."""
    c = F.col(f"`{key}`")
    lows = [r.low for r in ranges if r.low is not None]
    first = 0 if ranges[0].low is None else -1
    passed = F.size(F.filter(F.array(*[F.lit(v) for v in lows]), lambda b: b <= c)) if lows else F.lit(0)
    return F.when(c.isNull(), F.lit(0)).otherwise(passed + first).cast("int")


def _sums(df: DataFrame, key: str, columns: list[str], ranges: list[KeyRange]) -> dict[int, tuple]:
    row = F.xxhash64(*[p for n in columns for p in (F.col(f"`{n}`"), F.col(f"`{n}`").isNull())])
    low, high = row.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(row, 33)
    hashed = df.select(_number(key, ranges).alias("number"), low.alias("a"), high.alias("b"))
    found = hashed.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    return {r.number: (r.n, r.a, r.b) for r in found}  # at most one row per range


def _joined(ranges: list[KeyRange]) -> list[KeyRange]:
    """Neighbouring ranges in one, and all in fewer where they are too many for a filter."""
    out: list[KeyRange] = []
    for r in ranges:
        if out and out[-1].high is not None and out[-1].high == r.low:
            out[-1] = KeyRange(out[-1].low, r.high, out[-1].left_rows + r.left_rows, out[-1].right_rows + r.right_rows)
        else:
            out.append(r)
    while len(out) > MOST:
        out = [KeyRange(a.low, b.high, a.left_rows + b.left_rows, a.right_rows + b.right_rows) for a, b in zip(out[::2], [*out[1::2], out[-1]])]
    return out


@dataclass(frozen=True)
class Comparison:
    """Ranges in which two tables differ, and how many rows each has in all."""

    ranges: list[KeyRange]
    left_rows: int
    right_rows: int
    levels: int


def compare(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str] | None = None) -> Comparison:
    """Find the ranges of the first key column in which two tables differ.

    ``columns`` are compared beside the keys, such as a row hash. Rows that repeat count as often as they come.
    """
    key, compared = keys[0], [*keys, *(columns or [])]
    ranges, totals, levels, settled = [KeyRange()], None, 0, []
    while ranges:
        a, b = within(left, key, ranges), within(right, key, ranges)
        cut = _cut(a, key, ranges)
        x, y = _sums(a, key, compared, cut), _sums(b, key, compared, cut)
        if totals is None:
            totals = sum(v[0] for v in x.values()), sum(v[0] for v in y.values())
        levels += 1
        differ = [KeyRange(r.low, r.high, x.get(i, (0,))[0], y.get(i, (0,))[0]) for i, r in enumerate(cut) if x.get(i) != y.get(i)]
        settled += [r for r in differ if r.rows <= LEAF or r in ranges or len(cut) == len(ranges)]
        ranges = [r for r in differ if r not in settled]
        if len(ranges) * 2 > len(cut):  # most of what is left differs: reading it beats cutting it
            settled, ranges = settled + ranges, []
        if len(ranges) + len(settled) > MOST:
            settled, ranges = settled + ranges, []
    order = {v: i for i, v in enumerate(sorted({r.low for r in settled if r.low is not None}))}
    return Comparison(_joined(sorted(settled, key=lambda r: -1 if r.low is None else order[r.low])), *totals, levels)


def active(target: DataFrame) -> DataFrame:
    return target.filter(~F.coalesce("_is_deleted", F.lit(False))) if "_is_deleted" in target.columns else target


def missing_at_source(target: DataFrame, source_keys: DataFrame, keys: list[str]) -> DataFrame:
    """Active rows without a source row; only ranges in which the keys differ are joined."""
    found = compare(active(target).select(*keys), source_keys.select(*keys), keys).ranges
    return active(within(target, keys[0], found)).join(within(source_keys, keys[0], found).select(*keys), keys, "left_anti")


def flag_deleted(target: DataFrame, source_keys: DataFrame, keys: list[str]) -> DataFrame:
    """The target with ``_is_deleted`` set on active rows without a source row; rows of equal ranges pass as they are."""
    found = compare(active(target).select(*keys), source_keys.select(*keys), keys).ranges
    same = outside(target, keys[0], found).withColumn("_is_deleted", F.coalesce("_is_deleted", F.lit(False)))
    return same.unionByName(reconcile.flag_deleted(within(target, keys[0], found), within(source_keys, keys[0], found), keys))


def detect_changes(source: DataFrame, target: DataFrame, keys: list[str], hash_column: str = "_row_hash") -> DataFrame:
    """Source rows that are NEW or CHANGED against the target; only ranges whose keys or hashes differ are joined."""
    found = compare(source.select(*keys, hash_column), target.select(*keys, hash_column), keys, [hash_column]).ranges
    return reconcile.detect_changes(within(source, keys[0], found), within(target, keys[0], found), keys, hash_column)


def range_report(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Source and target counts with their difference, and how many rows lie in ranges that differ, in one row."""
    found = compare(source, target, keys, columns)
    left, right = found.left_rows, found.right_rows
    row = (left, right, left - right, round((left - right) * 100.0 / left, 2) if left else 0.0, left == right, len(found.ranges), sum(r.left_rows for r in found.ranges))
    names = "source_count bigint, target_count bigint, difference bigint, difference_pct double, identical boolean, ranges int, rows_in_ranges bigint"
    return source.sparkSession.createDataFrame([row], names)
