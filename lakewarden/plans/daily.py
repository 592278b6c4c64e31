"""Percentiles of long logs from daily sketches.

Each day's values are kept as one quantile sketch per key, made once from that day's rows. Any window is answered by merging its days,
without reading the log again, within a stated rank error. Where a value has to be exact, the merged sketch says in what range it
lies: rows outside the ranges are only counted, by one stand-in value per gap, and the ranks are found among the rest. A
result outside its range would show that a sketch was off by more than ``MARGIN`` times its error; those keys are
then read in full, so exact means exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import commit
from ..operators.keyed import lookup, nearest_rank_percentiles
from ..session import settle

SKETCH_K, RANK_ERROR = 800, 0.004  # size of a sketch and the share of ranks by which a percentile may be off (99% confidence)
MARGIN = 4


def sketches(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """(keys, month, day, sketch, n): one sketch per key and day; rows without a value or a time are left out."""
    known = rows.filter(F.col(value).isNotNull() & F.col(at).isNotNull())
    day = F.col(at).cast("date")
    return known.groupBy(*keys, F.date_format(day, "yyyy-MM").alias("month"), day.alias("day")).agg(
        F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), SKETCH_K).alias("sketch"), F.count(F.lit(1)).alias("n")
    )


def store(daily: DataFrame, table: str, root: str) -> None:
    """Keep sketches in a table by month; the months among them are replaced, so bring whole months."""
    commit.commit_partitions(daily, table, root, "month", plain=True)


def merged(stored: DataFrame, keys: list[str], since=None, until=None) -> DataFrame:
    """(keys, sketch, n) over the days from ``since`` to ``until``, both included."""
    days = stored
    if since is not None:
        days = days.filter((F.col("day") >= F.lit(since).cast("date")) & (F.col("month") >= F.date_format(F.lit(since).cast("date"), "yyyy-MM")))
    if until is not None:
        days = days.filter((F.col("day") <= F.lit(until).cast("date")) & (F.col("month") <= F.date_format(F.lit(until).cast("date"), "yyyy-MM")))
    return days.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch", SKETCH_K).alias("sketch"), F.sum("n").alias("n"))


def _quantile(rank: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(F.col("sketch"), F.lit(float(min(max(rank, 0.0), 1.0))))


def percentiles(window: DataFrame, keys: list[str], percents: dict[str, float]) -> DataFrame:
    """Percentiles of a merged window, each within RANK_ERROR of its rank."""
    return window.select(*keys, *[_quantile(p / 100).alias(name) for name, p in percents.items()], F.col("n").alias("sample_size"))


def exact_percentiles(rows: DataFrame, window: DataFrame, keys: list[str], value: str, percents: dict[str, float], width: float) -> DataFrame:
    """Exact nearest-rank percentiles of ``rows``, whose sketches are merged in ``window``."""
    off = MARGIN * RANK_ERROR
    bounds = settle(window.select(*keys, *[_quantile(p / 100 + s).alias(f"_{end}_{n}") for n, p in percents.items() for end, s in (("low", -off), ("high", off))]))
    v, names = F.col(value), list(percents)
    near = lookup(rows.filter(v.isNotNull()), bounds, keys)
    inside = F.lit(False)
    for n in names:
        inside = inside | v.between(F.col(f"_low_{n}"), F.col(f"_high_{n}"))
    above = F.least(*[F.when(F.col(f"_low_{n}") > v, F.col(f"_low_{n}") - 1) for n in names], F.lit(None).cast("bigint"))
    top = F.greatest(*[F.col(f"_high_{n}") for n in names], F.lit(None).cast("bigint")) + 1
    coarse = near.withColumn(value, F.when(F.coalesce(inside, F.lit(True)), v).otherwise(F.coalesce(above, top))).select(*keys, value)
    found = settle(nearest_rank_percentiles(coarse, keys, value, percents, width))
    checked = lookup(found, bounds, keys)
    missed = F.lit(False)
    for n in names:
        missed = missed | F.coalesce(~F.col(n).between(F.col(f"_low_{n}"), F.col(f"_high_{n}")), F.lit(False))
    wrong = checked.filter(missed).select(*keys)
    if wrong.isEmpty():
        return found
    again = nearest_rank_percentiles(rows.join(wrong, keys, "left_semi"), keys, value, percents, width)
    return found.join(wrong, keys, "left_anti").unionByName(again)
