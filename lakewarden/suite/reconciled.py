"""Checked queries: reconciliation by range checksums, with the results of the plain comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bronze, rangesums
from . import ORACLES, query
from .ingest import hashed_orders
from .tables import Tables

KEYS = ["o_orderkey"]


@query("delete_flags_ranges")
def delete_flags_ranges(t: Tables):
    target = t.orders.select("o_orderkey").withColumn("_is_deleted", F.lit(False))
    return rangesums.flag_deleted(target, t.orders_source_keys, KEYS)


@query("missing_at_source_ranges")
def missing_at_source_ranges(t: Tables):
    target = t.orders.select("o_orderkey").withColumn("_is_deleted", F.lit(False))
    return rangesums.missing_at_source(target, t.orders_source_keys, KEYS).select("o_orderkey")


@query("change_detection_ranges")
def change_detection_ranges(t: Tables):
    return rangesums.detect_changes(hashed_orders(t.orders_delta), hashed_orders(t.orders_target), KEYS).select("o_orderkey", "change")


@query("count_reconciliation_ranges")
def count_reconciliation_ranges(t: Tables):
    report = rangesums.range_report(t.orders.select("o_orderkey"), t.orders_target.select("o_orderkey"), KEYS)
    return report.select("source_count", "target_count", "difference", "difference_pct", "identical")


for name in ("delete_flags", "missing_at_source", "change_detection", "count_reconciliation"):
    ORACLES[f"{name}_ranges"] = ORACLES[name]


@query("single_change_ranges", "select o_orderkey, 'CHANGED' as change from @orders where o_orderkey % 1000 = 17 and o_orderstatus <> 'X'")
def single_change_ranges(t: Tables):
    """A few changed rows of a whole table: only the ranges that hold them are compared row by row."""
    status = F.when(F.col("o_orderkey") % 1000 == 17, F.lit("X")).otherwise(F.col("o_orderstatus"))
    keyed = lambda df: df.withColumn("_row_hash", bronze.row_hash(df))
    return rangesums.detect_changes(keyed(t.orders.withColumn("o_orderstatus", status)), keyed(t.orders), KEYS).select("o_orderkey", "change")
