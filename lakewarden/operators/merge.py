"""Keyed writes into existing tables that cost what they touch.

Incoming rows meet the stored keys once, and that join decides everything: what each row does (insert, update, unchanged, late), how
many rows of each kind there are, and which partitions change. In a partitioned table the key index names the partitions that
may hold an incoming key; only these are read, and only those that change are written, by dynamic overwrite.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import commit, keyindex
from .writes import one_per_key, require_keys


@dataclass(frozen=True)
class Merged:
    """What a merge did: counts of rows, the changed rows, and the partitions that were read for keys and written."""

    inserted: int = 0
    updated: int = 0
    unchanged: int = 0
    late: int = 0
    changes: DataFrame | None = None
    read: tuple = ()
    written: tuple = ()

    @property
    def changed(self) -> int:
        return self.inserted + self.updated


def actions(
    fresh: DataFrame, stored: DataFrame, keys: list[str], hash_column: str | None = None, newest: str | None = None, partition: str | None = None,
) -> DataFrame:
    """The rows of ``fresh`` with ``_action`` and the stored row's partition in ``_held``.

    UNCHANGED if ``hash_column`` is given and equal; LATE if the stored row has a newer value of ``newest``; a stored row without
    the value is older than any, and on a tie the incoming row wins.
    """
    null = F.lit(None)
    side = stored.select(
        *[F.col(f"`{k}`") for k in keys], F.lit(True).alias("_known"),
        (F.col(f"`{hash_column}`") if hash_column else null).alias("_hash"),
        (F.col(f"`{newest}`") if newest else null).alias("_at"), (F.col(f"`{partition}`") if partition else null.cast("string")).alias("_held"),
    )
    action = F.when(F.col("_known").isNull(), F.lit("INSERT"))
    if hash_column:
        action = action.when(F.col("_hash") == F.col(f"`{hash_column}`"), F.lit("UNCHANGED"))
    if newest:
        action = action.when(F.col("_at").isNotNull() & F.coalesce(F.col("_at") > F.col(f"`{newest}`"), F.lit(True)), F.lit("LATE"))
    return fresh.join(side, keys, "left").withColumn("_action", action.otherwise(F.lit("UPDATE"))).drop("_known", "_hash", "_at")


def merge(
    rows: DataFrame, table: str, root: str, keys: list[str], partition: str | None = None, order_column: str | None = None,
    hash_column: str | None = None, newest: bool = False,
) -> Merged:
    """Update or insert rows by key in a table, creating it on first use.

    Of several incoming rows of a key the newest by ``order_column`` counts. With ``hash_column`` unchanged rows are not written; with
    ``newest`` a late row never replaces a newer stored one. Repeating a merge changes nothing.
    """
    spark, columns = rows.sparkSession, rows.columns
    fresh = one_per_key(require_keys(rows, keys), keys, order_column)
    exists = spark.catalog.tableExists(table)
    if not exists:
        fresh = stage(fresh)
        if partition:
            keyindex.record(fresh, table, root, keys, partition)
            done = commit.commit_partitions(fresh, table, root, partition)
        else:
            done = commit.commit_snapshot(fresh, table, root)
        return Merged(inserted=done.rows, changes=fresh, written=done.partitions)
    target, read = spark.table(table), []
    if partition:
        if not spark.catalog.tableExists(keyindex.index_table(table)):
            keyindex.rebuilt(spark, table, root, keys, partition)
        read = keyindex.candidate_partitions(spark, table, rows, keys, partition)
        target = target.filter(F.col(partition).isin(read))
    decided = stage(actions(fresh, target, keys, hash_column, order_column if newest else None, partition))
    counts: dict[str, int] = {}
    touched = set()
    for r in decided.groupBy("_action", "_held").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per action and partition
        counts[r["_action"]] = counts.get(r["_action"], 0) + r["n"]
        if r["_action"] == "UPDATE":
            touched.add(r["_held"])
    changes = decided.filter(F.col("_action").isin("INSERT", "UPDATE")).select(*[F.col(f"`{c}`") for c in columns])
    if not changes.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        changes = stage(changes.dropDuplicates(keys))  # the table holds a key more than once
    out = dict(inserted=counts.get("INSERT", 0), updated=counts.get("UPDATE", 0), unchanged=counts.get("UNCHANGED", 0), late=counts.get("LATE", 0))
    if not out["inserted"] + out["updated"]:
        return Merged(**out, changes=changes, read=tuple(read))
    kept = target
    if partition:
        touched |= {r[0] for r in changes.select(partition).distinct().collect()}
        kept = target.filter(F.col(partition).isin(sorted(touched)))
    state = kept.join(changes.select(*[F.col(f"`{k}`") for k in keys]), keys, "left_anti").unionByName(changes, allowMissingColumns=True)
    if partition:
        keyindex.record(changes, table, root, keys, partition)
        held = decided.filter("_action = 'UPDATE'").select(F.col("_held").alias(partition))
        commit.commit_partitions(state, table, root, partition, touched=sorted(touched), checked=changes.select(partition).union(held))
    else:
        commit.commit_snapshot(state, table, root)
    return Merged(**out, changes=changes, read=tuple(read), written=tuple(sorted(touched)) if partition else ())


def replace_window(rows: DataFrame, table: str, root: str, column: str, cutoff, partition: str) -> tuple[int, int]:
    """Replace the rows of a partitioned table at or after the cutoff; counts of rows brought in and of rows replaced.

    Only partitions that hold such rows or receive some are read and written; one that the window empties is dropped.
    """
    from .writes import replace_window as replaced

    spark, rows = rows.sparkSession, stage(rows)
    target = spark.table(table)
    inside = target.filter(F.col(column) >= cutoff).groupBy(F.col(partition).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    own = [r[0] for r in rows.select(partition).distinct().collect()]
    touched = sorted({*own, *[r.part for r in inside]})
    state = replaced(target.filter(F.col(partition).isin(touched)), rows, column, cutoff)
    if touched:
        commit.commit_partitions(state, table, root, partition, touched=touched)
    return rows.count(), sum(r.n for r in inside)
