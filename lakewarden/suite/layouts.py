"""Checked queries: layout, pages and reads by ranges of equal depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout, writes
from . import query
from .tables import Tables

FILES, POINTS = 32, (0.2, 0.7)


def _files_met(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Per column, how many files filters on values at two quantiles have to open, by the files' least and greatest values."""
    points = df.agg(*[F.percentile_approx(c, list(POINTS)).alias(c) for c in columns]).first()
    ends = [end for c in columns for end in (F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"))]
    files = df.groupBy(F.col("_metadata.file_name").alias("file")).agg(*ends)
    met = [sum([F.lit(v).between(F.col(f"low_{c}"), F.col(f"high_{c}")).cast("int") for v in points[c]], F.lit(0)) for c in columns]
    return files.agg(*[F.sum(m).alias(c) for m, c in zip(met, columns)]).first().asDict()


@query(
    "z_layout",
    """select n as total_rows, s as checksum, true as second_prunes, true as fewer_in_all from (
         select count(*) as n, cast(sum(l_orderkey * 7 + l_partkey * 3 + l_suppkey) as bigint) as s from @lineitem) x""",
)
def z_layout(t: Tables):
    """The same rows in linear and in space-filling order: filters on the second and third key open fewer files."""
    keys, rows = ["l_partkey", "l_suppkey", "l_orderkey"], t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
    writes.clustered(rows, keys, FILES).write.parquet(f"{t.scratch}/linear")
    layout.z_ordered(rows, keys, FILES).write.parquet(f"{t.scratch}/z")
    linear, z = t.spark.read.parquet(f"{t.scratch}/linear"), t.spark.read.parquet(f"{t.scratch}/z")
    before, now = _files_met(linear, keys), _files_met(z, keys)
    prunes, fewer = all(now[k] < before[k] for k in keys[1:]), sum(now.values()) < sum(before.values())
    return z.agg(F.count(F.lit(1)).alias("total_rows"), F.sum(F.expr("l_orderkey * 7 + l_partkey * 3 + l_suppkey")).alias("checksum")).select(
        "*", F.lit(prunes).alias("second_prunes"), F.lit(fewer).alias("fewer_in_all")
    )


PAGES = {"first": 1, "middle": 40, "last": 75}


@query(
    "page_directory",
    """select 'first' as page, o_orderkey, o_orderdate from (select * from (select o_orderkey, o_orderdate from @orders order by o_orderdate desc nulls last, o_orderkey limit 20 offset 0) a)
       union all select 'middle', * from (select o_orderkey, o_orderdate from @orders order by o_orderdate desc nulls last, o_orderkey limit 20 offset 780) b
       union all select 'last', * from (select o_orderkey, o_orderdate from @orders order by o_orderdate desc nulls last, o_orderkey limit 20 offset 1480) c""",
)
def page_directory(t: Tables):
    """First, middle and late pages of a table; each reads the ranges that hold it, ties included."""
    rows = t.orders.select("o_orderkey", "o_orderdate")
    directory = layout.PageDirectory.build(rows, "o_orderdate", ["o_orderkey"], descending=True)
    pages = [directory.page(rows, n, 20).select(F.lit(name).alias("page"), "*") for name, n in PAGES.items()]
    return reduce(DataFrame.unionByName, pages)


@query("balanced_read", "select 8 as readers, true as balanced, count(*) as total_rows, count(distinct l_orderkey) as keys, true as each_once from @lineitem")
def balanced_read(t: Tables):
    """A read of a skewed column by eight conditions: every row meets exactly one, and none has twice its share."""
    rows = t.lineitem.select("l_orderkey", F.when(F.col("l_orderkey") % 10 != 0, F.pow("l_orderkey", F.lit(3))).alias("skewed"))  # doubles: cubes of large keys pass the largest bigint
    conditions = layout.read_predicates("skewed", layout.quantile_bounds(rows, "skewed", 8))
    met = [F.expr(f"case when {c} then 1 else 0 end") for c in conditions]
    counts = [F.sum(m).alias(f"n{i}") for i, m in enumerate(met)]
    one = rows.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct("l_orderkey").alias("keys"), F.every(sum(met, F.lit(0)) == 1).alias("each_once"), *counts)
    most = F.greatest(*[F.col(f"n{i}") for i in range(len(met))])
    return one.select(F.lit(len(met)).alias("readers"), (most * len(met) <= F.col("total_rows") * 2).alias("balanced"), "total_rows", "keys", "each_once")
