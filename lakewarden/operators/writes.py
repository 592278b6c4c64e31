"""Table states after a write, as DataFrames; nothing here touches storage.

Each function takes the current target and the incoming rows and returns the rows the table holds
afterwards. ``commit.py`` makes a state durable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contract import Contract
from .keyed import latest_per_key, tie_columns, top_per_key


def snapshot(incoming: DataFrame) -> DataFrame:
    """SNAPSHOT: the incoming rows replace everything, schema included."""
    return incoming


def append_log(target: DataFrame, incoming: DataFrame, merge_schema: bool = True) -> DataFrame:
    """APPEND_LOG: all rows are kept; new columns are added when schemas may merge."""
    return target.unionByName(incoming, allowMissingColumns=merge_schema)


def require_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fail the job on a NULL key. Key equality is not null-safe, so such a row would be inserted again each run."""
    guarded = {
        k: F.when(F.col(k).isNull(), F.raise_error(F.lit(f"NULL_KEY: {k}"))).otherwise(F.col(k)) for k in keys
    }
    return df.withColumns(guarded)


def one_per_key(incoming: DataFrame, keys: list[str], order_column: str | None) -> DataFrame:
    if order_column and order_column in incoming.columns:
        return latest_per_key(incoming, keys, order_column)
    order = [F.col(f"`{c}`").asc() for c in tie_columns(incoming, keys)] or [F.lit(0)]
    return top_per_key(incoming, keys, order).drop("_rn")


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], order_column: str | None = None) -> DataFrame:
    """CURRENT: incoming rows update or insert by key.

    The target is only filtered by an anti join against the incoming keys. When the increment is small
    the keys are broadcast by the planner and the target is not shuffled.
    """
    fresh = one_per_key(require_keys(incoming, keys), keys, order_column)
    return target.join(incoming.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def newest_rows(target: DataFrame, incoming: DataFrame, keys: list[str], order_column: str) -> DataFrame:
    """The incoming rows, except where the target already holds a newer row of the key; on a tie the incoming row wins."""
    fresh = one_per_key(require_keys(incoming, keys), keys, order_column).withColumn("_incoming", F.lit(1))
    stored = target.join(incoming.select(*keys), keys, "left_semi").select(*incoming.columns).withColumn("_incoming", F.lit(0))
    order = [F.col(order_column).desc_nulls_last(), F.col("_incoming").desc()]
    return top_per_key(fresh.unionByName(stored), keys, order).drop("_rn", "_incoming")


def upsert_newest(target: DataFrame, incoming: DataFrame, keys: list[str], order_column: str) -> DataFrame:
    """Upsert in which a late row never replaces a newer stored one; both sides need the same columns."""
    fresh = newest_rows(target, incoming, keys, order_column)
    return target.join(incoming.select(*keys), keys, "left_anti").unionByName(fresh)


def changed_rows(
    target: DataFrame, incoming: DataFrame, keys: list[str], hash_column: str = "_row_hash",
    order_column: str | None = None,
) -> DataFrame:
    """Incoming rows that are new or whose hash differs from the stored one; only keys and hash of the target are read."""
    fresh = one_per_key(require_keys(incoming, keys), keys, order_column)
    stored = target.select(*keys, F.col(hash_column).alias("_stored"), F.lit(True).alias("_known"))
    differs = F.col("_known").isNull() | F.col("_stored").isNull() | (F.col(hash_column) != F.col("_stored"))
    return fresh.join(stored, keys, "left").filter(differs).drop("_stored", "_known")


def upsert_changed(
    target: DataFrame, incoming: DataFrame, keys: list[str], hash_column: str = "_row_hash",
    order_column: str | None = None,
) -> DataFrame:
    """Hash-guarded upsert: unchanged rows keep their stored version.

    Such a load usually reads the whole source, so both sides meet in one full join and each is shuffled once.
    """
    fresh = one_per_key(require_keys(incoming, keys), keys, order_column)
    columns = target.columns + [c for c in fresh.columns if c not in target.columns]
    types = {**{f.name: f.dataType for f in fresh.schema.fields}, **{f.name: f.dataType for f in target.schema.fields}}

    def packed(df: DataFrame, name: str) -> DataFrame:
        fields = [(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in columns]
        return df.select(*keys, F.struct(*fields).alias(name))

    both = packed(target, "_t").join(packed(fresh, "_s"), keys, "full")
    differs = F.col("_t").isNull() | F.col(f"_t.{hash_column}").isNull() | (F.col(f"_t.{hash_column}") != F.col(f"_s.{hash_column}"))
    return both.select(F.when(F.col("_s").isNotNull() & differs, F.col("_s")).otherwise(F.col("_t")).alias("r")).select("r.*")


def replace_window(target: DataFrame, incoming: DataFrame, column: str, cutoff: Column) -> DataFrame:
    """Rows at or after the cutoff are replaced by the incoming ones; older rows and NULLs stay.

    An incoming row before the cutoff fails the job: it would be duplicated by the next run.
    """
    late = F.col(column).isNull() | (F.col(column) < cutoff)
    fresh = incoming.withColumn(
        column, F.when(late, F.raise_error(F.lit(f"OUTSIDE_WINDOW: {column}"))).otherwise(F.col(column))
    )
    return target.filter(late).unionByName(fresh, allowMissingColumns=True)


def replace_window_touched(target: DataFrame, incoming: DataFrame, column: str, cutoff: Column, partition: str, boundary) -> DataFrame:
    """The replaced window of a table partitioned by a value that rises with ``column``.

    ``boundary`` is the partition that holds the cutoff. Only it and later partitions are read and
    returned; the filter on the partition column prunes the others.
    """
    return replace_window(target.filter(F.col(partition) >= F.lit(boundary)), incoming, column, cutoff)


def merge_actions(
    target: DataFrame, incoming: DataFrame, keys: list[str], hash_column: str | None = None,
    order_column: str | None = None,
) -> DataFrame:
    """The incoming rows with what a merge does to them: INSERT, UPDATE or UNCHANGED in ``action``."""
    fresh = one_per_key(require_keys(incoming, keys), keys, order_column)
    stored = target.select(*keys, *([F.col(hash_column).alias("_stored")] if hash_column else []), F.lit(True).alias("_known"))
    action = F.when(F.col("_known").isNull(), F.lit("INSERT"))
    if hash_column:
        action = action.when(F.col("_stored") == F.col(hash_column), F.lit("UNCHANGED"))
    joined = fresh.join(stored, keys, "left").withColumn("action", action.otherwise(F.lit("UPDATE")))
    return joined.drop("_known", "_stored")


def merge_metrics(actions: DataFrame) -> DataFrame:
    """Inserted, updated and unchanged counts of a merge, in one row."""
    return actions.agg(
        F.count_if(F.col("action") == "INSERT").alias("inserted_count"),
        F.count_if(F.col("action") == "UPDATE").alias("updated_count"),
        F.count_if(F.col("action") == "UNCHANGED").alias("unchanged_count"),
    )


def silver_state(
    target: DataFrame | None, incoming: DataFrame, contract: Contract, mode: str = "auto",
    window_column: str | None = None, cutoff: Column | None = None,
) -> tuple[str, DataFrame]:
    """The silver write and its name: MERGE with a key, else REPLACE_WHERE, APPEND or OVERWRITE."""
    if contract.primary_key:
        if target is None:
            keys = list(contract.primary_key)
            return "MERGE", one_per_key(require_keys(incoming, keys), keys, contract.order_column)
        return "MERGE", upsert(target, incoming, list(contract.primary_key), contract.order_column)
    if mode == "REPLACE_WHERE" and target is not None and window_column and cutoff is not None:
        return "REPLACE_WHERE", replace_window(target, incoming, window_column, cutoff)
    if mode == "APPEND":
        return "APPEND", incoming if target is None else append_log(target, incoming)
    return "OVERWRITE", snapshot(incoming)


def touched_partitions(target: DataFrame, incoming: DataFrame, keys: list[str], partition: str) -> DataFrame:
    """Partition values an upsert has to rewrite: those of the incoming rows and those now holding their keys."""
    now = target.select(*keys, partition).join(incoming.select(*keys), keys, "left_semi").select(partition)
    return now.union(incoming.select(partition)).distinct()


def upsert_touched(
    target: DataFrame, incoming: DataFrame, keys: list[str], partition: str, order_column: str | None = None,
) -> DataFrame:
    """The upsert state restricted to the touched partitions of a partitioned table.

    The semi join on the partition column prunes the target's files at run time, so the cost follows
    the increment, not the table. Write with ``commit.commit_partitions``.
    """
    fresh = one_per_key(require_keys(incoming, keys), keys, order_column)
    touched = touched_partitions(target, incoming, keys, partition)
    kept = target.join(touched, partition, "left_semi").join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


ROWS_PER_FILE = 1_000_000


def write_partitions(estimated_rows: int | None, configured: int | None = None) -> int | None:
    """Files for a bulk write: the configured number, else one per ROWS_PER_FILE; None leaves it to the engine."""
    if configured or estimated_rows is None:
        return configured
    return max(1, -(-estimated_rows // ROWS_PER_FILE))


def write_partitions_column(estimated_rows: Column, configured: Column) -> Column:
    """The same rule for many tables at once."""
    return F.coalesce(configured.cast("bigint"), F.greatest(F.lit(1), F.ceil(estimated_rows / F.lit(ROWS_PER_FILE))).cast("bigint"))


def compaction_due(merges_since: int | None, threshold: int | None, last_done) -> bool:
    """Whether a layout rewrite is due: never done, or enough merges since."""
    return last_done is None or (merges_since or 0) >= (threshold or 100)


def clustered(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Rows in key ranges, sorted inside each file, so that file statistics prune key lookups."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def sized_for_write(df: DataFrame, estimated_rows: int | None = None, configured: int | None = None) -> DataFrame:
    """Spread rows for a bulk write. Without a configured number adaptive execution picks the size and splits skew."""
    if configured:
        return df.repartition(write_partitions(estimated_rows, configured))
    return df.hint("rebalance")
