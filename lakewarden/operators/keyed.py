"""Per-key operators that do not gather a whole key in one task.

A registry may hold one dataset with a third of all runs, so nothing here sorts a complete key in one
partition: top-n filters are cut before the shuffle, group values come from partial aggregates, and
"previous row" is solved per time bucket with a small carry between buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNORDERABLE = (T.MapType, T.VariantType)


def tie_columns(df: DataFrame, skip: list[str]) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in skip and not isinstance(f.dataType, _UNORDERABLE)]


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which NULL keys meet; the result has the left side's keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str = "_rn") -> DataFrame:
    """The first ``n`` rows per key. Spark applies the limit before the shuffle as well as after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def latest_per_key(df: DataFrame, keys: list[str], order_column: str, tie_break: list[str] | None = None) -> DataFrame:
    """Last write wins: the newest row per key, NULLs oldest; ties are settled by all other columns."""
    ties = tie_break if tie_break is not None else tie_columns(df, [*keys, order_column])
    order = [F.col(order_column).desc_nulls_last(), *[F.col(f"`{c}`").asc() for c in ties]]
    return top_per_key(df, keys, order).drop("_rn")


def carry_previous(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], prefix: str = "prev_",
    when: Column | None = None, bucket: Column | None = None,
) -> DataFrame:
    """Values of the closest earlier row of the same key for which ``when`` holds.

    ``order`` must start with a timestamp; ``bucket`` must rise with it (the hour by default). Rows are
    ordered inside (key, bucket) only. The last match of each bucket, a small aggregate, is carried on
    to later buckets, which gives the same answer as one window per key.
    """
    cond = when if when is not None else F.lit(True)
    work = df.withColumn("_b", bucket if bucket is not None else F.date_trunc("hour", F.col(order[0])))
    item = F.when(cond, F.struct(*[F.col(v) for v in values]))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = work.withColumn("_near", F.last(item, ignorenulls=True).over(inside))
    ends = work.groupBy(*keys, "_b").agg(F.max_by(item, F.when(cond, F.struct(*order))).alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_b", F.last("_end", ignorenulls=True).over(across).alias("_far"))
    joined = null_safe_join(rows, carried, [*keys, "_b"], "left")
    best = F.coalesce("_near", "_far")
    return joined.select(*df.columns, *[best[v].alias(f"{prefix}{v}") for v in values])


def number_rows(df: DataFrame, order: list[Column], buckets: list[Column], name: str = "rownum") -> DataFrame:
    """Row numbers over the whole table without sorting it in one task.

    ``buckets`` rise with the order, the first one slowest; a crowded first bucket is divided by the next.
    Rows are numbered inside their bucket and shifted by the row count of the earlier buckets.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    work = df.withColumns(dict(zip(names, buckets)))
    sizes = work.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    # Two levels again: totals of the first bucket are few, the others are summed inside it.
    outer = sizes.groupBy(names[0]).agg(F.sum("_n").alias("_n"))
    starts = outer.select(names[0], F.coalesce(F.sum("_n").over(_before(Window.orderBy(names[0]))), F.lit(0)).alias("_start"))
    if len(names) > 1:
        w = _before(Window.partitionBy(names[0]).orderBy(*names[1:]))
        inner = sizes.select(*names, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_more"))
        starts = null_safe_join(inner, starts, names[:1]).select(*names, (F.col("_start") + F.col("_more")).alias("_start"))
    inside = Window.partitionBy(*names).orderBy(*order)
    numbered = work.withColumn("_i", F.row_number().over(inside))
    numbered = null_safe_join(numbered, starts, names)
    return numbered.withColumn(name, F.col("_start") + F.col("_i")).drop(*names, "_i", "_start")


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def lookup(df: DataFrame, side: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join many rows with one row per key of ``side``.

    A plain equi-join: a small side is broadcast by the planner, and adaptive execution divides a hot key's rows by their
    measured size, however large the table is.
    """
    return df.join(side, keys, how)


def attach_group_values(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Each row with aggregates of its group, as a window without ordering would give; NULL keys get none."""
    return lookup(df, df.groupBy(*keys).agg(*aggs), keys)


def values_at_ranks(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], width: float, count: str = "sample_size",
) -> DataFrame:
    """The values at given ranks (from 1) of each group, exactly and without sorting a group in one task.

    Equal values are counted first (partial aggregate), then summed into ranges of ``width``. A rank is
    located among the ranges, and only the range that holds it is read value by value. ``ranks`` are
    expressions over the group's row count ``_total``.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    hist = hist.withColumn("_r", F.floor(F.col("_v") / F.lit(width)))
    ranges = hist.groupBy(*keys, "_r").agg(F.sum("_n").alias("_rn"))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_rn").over(before), F.lit(0))).withColumn(
        "_total", F.sum("_rn").over(Window.partitionBy(*keys))
    )
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), r.cast("bigint").alias("rank")) for n, r in ranks.items()])
    hit = ranges.select("*", F.explode(wanted).alias("_w")).filter(
        (F.col("_w.rank") > F.col("_before")) & (F.col("_w.rank") <= F.col("_before") + F.col("_rn"))
    )
    inside = Window.partitionBy(*keys, "_r", "_w").orderBy("_v")
    found = (
        null_safe_join(hist, hit.select(*keys, "_r", "_before", "_total", "_w"), [*keys, "_r"])
        .withColumn("_cum", F.col("_before") + F.sum("_n").over(inside))
        .filter(F.col("_cum") >= F.col("_w.rank"))
    )
    return found.groupBy(*keys).agg(
        *[F.min(F.when(F.col("_w.name") == n, F.col("_v"))).alias(n) for n in ranks], F.max("_total").cast("bigint").alias(count),
    )


def nearest_rank_percentiles(
    df: DataFrame, keys: list[str], value: str, percents: dict[str, float], width: float = 1024, count: str = "sample_size",
) -> DataFrame:
    """Exact nearest-rank percentiles per group."""
    ranks = {n: F.greatest(F.lit(1), F.ceil(F.lit(p) / 100.0 * F.col("_total"))) for n, p in percents.items()}
    return values_at_ranks(df, keys, value, ranks, width, count)


def medians(df: DataFrame, keys: list[str], value: str, width: float, name: str = "median") -> DataFrame:
    """Exact medians per group: the mean of the two middle values."""
    ranks = {"_lo": F.floor((F.col("_total") + 1) / 2), "_hi": F.ceil((F.col("_total") + 1) / 2)}
    return values_at_ranks(df, keys, value, ranks, width, "_n").select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(name))


def within_band(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, low: Column, high: Column, width_seconds: int,
) -> DataFrame:
    """Rows of ``left`` matched with the ``right`` rows of the same keys whose time ``at`` lies in [low, high].

    ``low`` and ``high`` are expressions over ``left``. Time is cut into slots and the join is an equi-join on keys, slot
    width and slot, so a hot key is divided by time and never paired with itself as a whole. The width is
    ``width_seconds``, doubled until a span covers three slots at most; a point is repeated once per width that occurs,
    of which there are as many as the logarithm of the longest span. One wrong date therefore costs a row or two, not
    a row per slot up to that date. Only the widths, a few dozen numbers at most, come to the driver.
    """
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    slot = lambda c, level: F.floor(seconds(c) / (F.lit(width_seconds) * F.pow(F.lit(2), level)))
    spans = left.withColumns({"_lo": low, "_hi": high}).filter("_lo <= _hi")
    length = (seconds(F.col("_hi")) - seconds(F.col("_lo"))) / F.lit(width_seconds)
    spans = spans.withColumn("_level", F.ceil(F.log2(F.greatest(length, F.lit(1.0)))).cast("int"))
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())
    spans = spans.withColumn("_slot", F.explode(F.sequence(slot(F.col("_lo"), F.col("_level")), slot(F.col("_hi"), F.col("_level")))))
    points = right.withColumn("_level", F.explode(F.lit(levels).cast("array<int>"))).withColumn("_slot", slot(F.col(at), F.col("_level")))
    hit = spans.join(points, [*keys, "_level", "_slot"], "inner").filter(F.col(at).between(F.col("_lo"), F.col("_hi")))
    return hit.drop("_lo", "_hi", "_slot", "_level")
