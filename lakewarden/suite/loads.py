"""Checked queries: loads that write tables in several runs, read back and compared with what the runs should leave."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import load, merge
from ..operators.incremental import LoadConfig
from . import query
from .ingest import AS_OF, CURRENT, DAY3, DELTA, ORDER_COLS, ORDERS, TARGET, UPSERT, business, typed_orders
from .tables import Tables

AFTER, LAST = "2001-01-02 00:00:00", "2001-01-03 00:00:00"


def _place(t: Tables, partition: str | None = None, silver: bool = False) -> load.Place:
    name = f"lakewarden_load_{uuid.uuid4().hex}"
    return load.Place(f"{name}_bronze", f"{t.scratch}/tables", f"{name}_", f"{name}_silver" if silver else None, partition, partition if silver else None)


def _by_year(df: DataFrame) -> DataFrame:
    return typed_orders(df).withColumn("y", F.year("o_orderdate").cast("int"))


def _by_period(df: DataFrame) -> DataFrame:
    """Partitions of a year, and of a day inside the window."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return typed_orders(df).withColumn("p", F.when(day >= DAY3[:10], day).otherwise(F.substring(day, 1, 4)))


@query("load_snapshot", DELTA)
def load_snapshot(t: Tables):
    """A second snapshot of a partitioned table: partitions of years that the source no longer has are gone."""
    at, cfg = _place(t, "y"), replace(CURRENT, bronze_mode="SNAPSHOT", strategy="SNAPSHOT")
    load.run_load(_by_year(t.orders_target), at, cfg, "r1", AS_OF)
    load.run_load(_by_year(t.orders_delta), at, cfg, "r2", AFTER)
    return business(t.spark.table(at.bronze))


GAP = "2000-12-30"


@query("load_window", f"select {ORDER_COLS} from @orders where cast(o_orderdate as date) <> cast('{GAP}' as date)")
def load_window(t: Tables):
    """A replaced window whose source has no rows of one day: that day's partition goes, older ones are not read."""
    at, day = _place(t, "p"), F.date_format("o_orderdate", "yyyy-MM-dd")
    load.run_load(_by_period(t.orders_target), at, replace(CURRENT, bronze_mode="SNAPSHOT"), "r1", AS_OF)
    load.run_load(_by_period(t.orders).filter(day != GAP), at, replace(CURRENT, primary_key=()), "r2", AS_OF)
    return business(t.spark.table(at.bronze))


@query("load_append", f"select {ORDER_COLS} from @orders")
def load_append(t: Tables):
    """Three appends, the third of which finds nothing above the watermark: every row is there once."""
    at, cfg = _place(t), replace(CURRENT, bronze_mode="APPEND_LOG", primary_key=())
    for run, rows in (("r1", t.orders_target), ("r2", t.orders), ("r3", t.orders)):
        load.run_load(typed_orders(rows), at, cfg, run, AS_OF)
    return business(t.spark.table(at.bronze))


NEW = "(select count(*) from orders_delta where o_orderkey not in (select o_orderkey from orders_target))"
CHANGED = "(select count(*) from orders_delta d join orders_target o on o.o_orderkey = d.o_orderkey where o.o_orderstatus <> d.o_orderstatus)"


@query(
    "load_layer_log",
    f"""select l.run_id, l.layer, l.operation, n as row_count, i as inserted_count, u as updated_count from (
          select 'r1' as run_id, 'BRONZE' as layer, 'HASH_MERGE' as operation, count(*) as n, count(*) as i, cast(0 as bigint) as u from orders_target
          union all select 'r1', 'SILVER', 'MERGE', count(*), count(*), 0 from orders_target
          union all select 'r2', 'BRONZE', 'HASH_MERGE', {NEW} + {CHANGED}, {NEW}, {CHANGED}
          union all select 'r2', 'SILVER', 'MERGE', {NEW} + {CHANGED}, {NEW}, {CHANGED}) l""",
)
def load_layer_log(t: Tables):
    """What two hash-guarded runs write into the layer log: inserted and updated rows of bronze and silver."""
    at, cfg = _place(t, "y", silver=True), replace(CURRENT, strategy="HASH_MERGE")
    for run, rows, now in (("r1", t.orders_target, AS_OF), ("r2", t.orders_delta, AFTER)):
        load.run_load(_by_year(rows), at, cfg, run, now, ORDERS, compact_after=None)
    return t.spark.table(at.control_table("layers")).select("run_id", "layer", "operation", "row_count", "inserted_count", "updated_count")


@query(
    "load_gate",
    """select 'r2' as after_run, 'BLOCKED_SCHEMA_CHANGE' as execution_state, (select count(*) from @orders) as bronze_rows, (select count(*) from orders_target) as silver_rows
       union all select 'r3', 'ACTIVE', (select count(*) from @orders), (select count(*) from @orders)""",
)
def load_gate(t: Tables):
    """A closed gate lets bronze succeed and silver wait; the next open run brings what waited."""
    at, out = _place(t, "y", silver=True), []
    for run, rows, now, allowed in (("r1", t.orders_target, AS_OF, True), ("r2", t.orders, AFTER, False), ("r3", t.orders, LAST, True)):
        gate = t.spark.range(1).select(F.lit("orders").alias("dataset_id"), F.lit(allowed).alias("silver_allowed"))
        load.run_load(_by_year(rows), at, CURRENT, run, now, ORDERS, gate, compact_after=None)
        if run != "r1":
            state, seen = load.dataset_state(t.spark, at, "orders").execution_state, t.spark.table(at.silver).count()  # as it is after this run
            counts = t.spark.table(at.bronze).agg(F.count(F.lit(1)).alias("bronze_rows"))
            out.append(counts.select(F.lit(run).alias("after_run"), F.lit(state).alias("execution_state"), "bronze_rows", F.lit(seen).cast("bigint").alias("silver_rows")))
    return out[0].unionByName(out[1])


@query("index_upsert", UPSERT)
def index_upsert(t: Tables):
    """The upsert of a partitioned table through its key index: the same state as the upsert of the whole table."""
    at = _place(t, "y")
    merge.merge(_by_year(t.orders_target), at.bronze, at.root, ["o_orderkey"], "y", "o_orderdate")
    merge.merge(_by_year(t.orders_delta), at.bronze, at.root, ["o_orderkey"], "y", "o_orderdate")
    return business(t.spark.table(at.bronze))


RECENT = "o_orderdate >= TS'2001-07-25 00:00:00'"


@query(
    "index_pruning",
    f"""select count(distinct date_trunc('month', o_orderdate)) as partitions, count(distinct case when {RECENT} then date_trunc('month', o_orderdate) end) as written,
          true as own_read, true as few_read, count(case when {RECENT} then 1 end) as updated from @orders""",
)
def index_pruning(t: Tables):
    """Of a table by month, an upsert of the last week reads the partitions that the index names and writes those that change."""
    at = _place(t, "m")
    rows = typed_orders(t.orders).withColumn("m", F.date_format("o_orderdate", "yyyy-MM"))
    merge.merge(rows, at.bronze, at.root, ["o_orderkey"], "m", "o_orderdate")
    done = merge.merge(rows.filter(F.col("o_orderdate") >= F.lit("2001-07-25").cast("timestamp_ntz")), at.bronze, at.root, ["o_orderkey"], "m", "o_orderdate")
    total = t.spark.table(at.bronze).agg(F.count_distinct("m").alias("partitions"))
    return total.select(
        "partitions", F.lit(len(done.written)).cast("bigint").alias("written"), F.lit(set(done.written) <= set(done.read)).alias("own_read"),
        (F.lit(len(done.read)) * 2 <= F.col("partitions")).alias("few_read"), F.lit(done.updated).cast("bigint").alias("updated"),
    )


@query(
    "interleaved_watermarks",
    f"""select 'orders' as dataset_id, max(cast(o_orderdate as varchar)) as watermark_value from ({DELTA}) a
        union all select 'target', max(cast(o_orderdate as varchar)) from ({TARGET}) b""",
)
def interleaved_watermarks(t: Tables):
    """Two loads read the same control state and save one after the other; a fold of the day before keeps both."""
    at = _place(t)
    kind = t.orders.schema["o_orderdate"].dataType
    mark = lambda df: df.agg(F.max("o_orderdate").cast("string")).first()[0]
    load.save_watermark("1999-01-01 00:00:00", kind, at, CURRENT, "r0", AS_OF, t.spark)
    first, second = mark(t.orders_delta), mark(t.orders_target)
    load.save_watermark(second, kind, at, LoadConfig("target", "SRC", watermark="o_orderdate"), "r2", AFTER, t.spark)
    load.save_watermark(first, kind, at, CURRENT, "r1", AFTER, t.spark)
    load.fold_watermarks(t.spark, at, AFTER)
    return load.stored_watermarks(t.spark, at).select("dataset_id", "watermark_value")
