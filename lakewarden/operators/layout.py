"""Table layout and reading by ranges of equal depth: space-filling order, pages from a directory, balanced reads.

All three cut a column at quantiles of a sample of its values. The sample is bounded and taken by a hash, so it does not depend on
partitions; it decides how even the pieces are and never which rows they hold.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 8192  # values whose quantiles bound the pieces
FINE = 32  # a column is cut FINE * FINE times for the space-filling order: first in FINE parts, then each part in FINE
BITS = 10  # of a rank, as 2 ** BITS = FINE * FINE


def quantile_bounds(df: DataFrame, column: str, pieces: int) -> list:
    """Up to ``pieces`` - 1 rising values that cut a column into pieces of about equal numbers of rows; NULLs don't count."""
    value = F.col(f"`{column}`")
    picked = df.select(value.alias("v")).filter(value.isNotNull()).withColumn("h", F.xxhash64("v", F.monotonically_increasing_id()))
    values = sorted(r.v for r in picked.orderBy("h").limit(max(SAMPLE, 8 * pieces)).collect())
    return sorted({values[len(values) * i // pieces] for i in range(1, pieces)} - {values[0]}) if values else []


def _passed(bounds: Column, value: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b <= value))


def rank_column(df: DataFrame, column: str) -> Column:
    """The value's place among FINE * FINE quantiles, found in two steps and spread over all ranks; NULL is first."""
    bounds = quantile_bounds(df, column, FINE * FINE)
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if not bounds:
        return F.lit(0)
    step = -(-(len(bounds) + 1) // FINE)
    parts = [bounds[i : i + step - 1] for i in range(0, len(bounds), step)]
    heads = bounds[step - 1 :: step]
    typed = lambda vs: F.array(*[F.lit(v).cast(kind) for v in vs]) if vs else F.array().cast(f"array<{kind.simpleString()}>")
    table = F.array(*[typed(p) for p in [*parts, *[[]] * (len(heads) + 1 - len(parts))]])
    coarse = _passed(typed(heads), value)
    fine = _passed(F.element_at(table, coarse + 1), value)
    scaled = F.floor((coarse * step + fine) * (FINE * FINE) / (len(bounds) + 1))  # few values still use the highest bits
    return F.when(value.isNull(), F.lit(0)).otherwise(scaled).cast("int")


def z_value(ranks: list[Column]) -> Column:
    """The bits of several ranks interleaved, the first one's bit highest."""
    out, n = F.lit(0).cast("bigint"), len(ranks)
    for j, rank in enumerate(ranks):
        for bit in range(BITS):
            one = F.shiftright(rank.cast("bigint"), bit).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(one, bit * n + (n - 1 - j)))
    return out


def z_ordered(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Rows in ranges of a space-filling order of up to six key columns, so that file statistics prune filters on each of them."""
    z = z_value([rank_column(df, k) for k in keys[:6]])
    placed = df.withColumn("_z", z)
    ranged = placed.repartitionByRange(partitions, "_z") if partitions else placed.repartitionByRange("_z")
    return ranged.sortWithinPartitions("_z").drop("_z")


@dataclass(frozen=True)
class PageDirectory:
    """Where the pages of a table in the order of a column begin: bounds of ranges, and the rows before each range.

    Built by one scan that counts rows per range; a page then reads the ranges that hold it and sorts only these. NULLs come last.
    """

    column: str
    tie: tuple[str, ...]
    bounds: tuple
    before: tuple[int, ...]  # rows before each range, then all rows; the last range has the NULLs
    descending: bool = False

    @staticmethod
    def build(df: DataFrame, column: str, tie: list[str], pieces: int = 256, descending: bool = False) -> "PageDirectory":
        bounds = quantile_bounds(df, column, pieces)
        counts = dict(map(tuple, df.groupBy(_range_number(column, bounds)).agg(F.count(F.lit(1))).collect()))  # one row per range
        order = range(len(bounds), -1, -1) if descending else range(len(bounds) + 1)
        before = [0]
        for r in [*order, len(bounds) + 1]:
            before.append(before[-1] + counts.get(r, 0))
        return PageDirectory(column, tuple(tie), tuple(bounds), tuple(before), descending)

    def _holds(self, place: int) -> Column:
        """Whether a row lies in the range at a place of the order."""
        value, n = F.col(f"`{self.column}`"), len(self.bounds)
        if place > n:
            return value.isNull()
        r = n - place if self.descending else place
        low = value >= F.lit(self.bounds[r - 1]) if r else value.isNotNull()
        return low & (value < F.lit(self.bounds[r])) if r < n else low

    def page(self, df: DataFrame, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1) of ``size`` rows, ties in the order of the tie columns."""
        start, total = (number - 1) * size, self.before[-1]
        if size <= 0 or start < 0 or start >= total:
            return df.limit(0)
        first, last = bisect_right(self.before, start) - 1, bisect_right(self.before, min(start + size, total) - 1) - 1
        held = self._holds(first)
        for place in range(first + 1, last + 1):
            held = held | self._holds(place)
        value = F.col(f"`{self.column}`")
        order = value.desc_nulls_last() if self.descending else value.asc_nulls_last()
        return df.filter(held).orderBy(order, *self.tie).offset(start - self.before[first]).limit(size)


def _range_number(column: str, bounds: list) -> Column:
    value = F.col(f"`{column}`")
    passed = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= value)) if bounds else F.lit(0)
    return F.when(value.isNull(), F.lit(len(bounds) + 1)).otherwise(passed)


def literal(value) -> str:
    """A bound as SQL text."""
    return str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) or type(value).__name__ == "Decimal" else "'" + str(value).replace("'", "''") + "'"


def read_predicates(column: str, bounds: list) -> list[str]:
    """Conditions for a parallel read, one per reader, of which every row meets exactly one; the first takes the NULLs."""
    if not bounds:
        return ["1 = 1"]
    inner = [f"{column} >= {literal(a)} AND {column} < {literal(b)}" for a, b in zip(bounds, bounds[1:])]
    return [f"{column} < {literal(bounds[0])} OR {column} IS NULL", *inner, f"{column} >= {literal(bounds[-1])}"]
