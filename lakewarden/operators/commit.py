"""Making table states durable with Spark's own table writes.

A partitioned table is written with ``insertInto`` in dynamic overwrite mode: only the partitions among the rows are
replaced, each after its new files are complete, so a state may be computed from the table itself and an increment costs
what it touches. Partitions that a state leaves without rows are dropped in one statement afterwards. A table without partitions is
replaced as a whole; a state that may read the table is staged in the shared checkpoint folder first. Where
a table format is installed, its tables take the same states with real transactions.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from importlib.util import find_spec

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .layout import z_ordered
from .writes import clustered, compaction_due

PLAIN = "[A-Za-z0-9_.-]+"  # partition values that statements and folders spell alike


def has_delta() -> bool:
    """Whether the Delta package is installed."""
    try:
        return find_spec("delta.tables") is not None
    except ModuleNotFoundError:
        return False


@dataclass(frozen=True)
class Written:
    """What a write put into a table, observed by the write itself: rows, highest value of a column, partitions."""

    rows: int
    highest: str | None = None
    partitions: tuple = ()


def _observed(df: DataFrame, highest: str | None, partition: str | None) -> tuple[DataFrame, Observation]:
    seen = Observation()
    most = F.max(f"`{highest}`").cast("string") if highest and highest in df.columns else F.lit(None).cast("string")
    values = F.collect_set(f"`{partition}`") if partition else F.array()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), most.alias("highest"), values.alias("partitions")), seen


def _written(seen: Observation) -> Written:
    got = seen.get
    return Written(got["rows"], got["highest"], tuple(got["partitions"]))


def _location(table: str, root: str) -> str:
    return f"{root.rstrip('/')}/{table.replace('.', '_')}-{uuid.uuid4().hex}"


def _matched(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table in its order, by name; columns that ``df`` lacks are NULL."""
    given = {c.lower(): c for c in df.columns}
    fields = df.sparkSession.table(table).schema.fields
    values: list[Column] = [F.col(f"`{given[f.name.lower()]}`") if f.name.lower() in given else F.lit(None) for f in fields]
    return df.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(values, fields)])


def _add_columns(df: DataFrame, table: str) -> None:
    known = {c.lower() for c in df.sparkSession.table(table).columns}
    added = [f for f in df.schema.fields if f.name.lower() not in known]
    if added:
        df.sparkSession.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in added)})")


def commit_snapshot(df: DataFrame, table: str, root: str, fmt: str = "parquet", highest: str | None = None, reads_table: bool = True) -> Written:
    """Make ``df`` the whole content of a table without partitions; a new table gets a folder below ``root``.

    ``reads_table`` says that ``df`` may be computed from the table, which is then staged first. With another schema the new table is
    complete under a name of its own before the names are changed, so a failure loses neither.
    """
    spark = df.sparkSession
    exists = spark.catalog.tableExists(table)
    same = exists and spark.table(table).dtypes == df.dtypes
    rows, seen = _observed(settle(df) if same and reads_table else df, highest, None)
    if same:
        rows.write.insertInto(table, overwrite=True)
    else:
        name = f"{table}__{uuid.uuid4().hex}" if exists else table
        rows.write.format(fmt).option("path", _location(table, root)).saveAsTable(name)
        if exists:
            spark.sql(f"ALTER TABLE {table} RENAME TO {name}_old")
            spark.sql(f"ALTER TABLE {name} RENAME TO {table}")
            spark.sql(f"DROP TABLE {name}_old")
    spark.catalog.refreshTable(table)
    return _written(seen)


def commit_append(df: DataFrame, table: str, root: str, fmt: str = "parquet", highest: str | None = None, partition: str | None = None) -> Written:
    """Add rows to a table, creating it on first use, with a partition column if one is given. Columns that the table lacks
    are added to it first, with NULL in its older rows; columns that ``df`` lacks are NULL in the new ones. Columns are
    matched by name."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        rows, seen = _observed(df, highest, None)
        writer = rows.write.format(fmt).option("path", _location(table, root))
        (writer.partitionBy(partition) if partition else writer).saveAsTable(table)
        return _written(seen)
    _add_columns(df, table)
    rows, seen = _observed(_matched(df, table), highest, None)
    rows.write.insertInto(table)
    spark.catalog.refreshTable(table)
    return _written(seen)


def commit_partitions(
    df: DataFrame, table: str, root: str, partition: str, touched: list | None = None, fmt: str = "parquet", whole: bool = False,
    highest: str | None = None, plain: bool = False, checked: DataFrame | None = None,
) -> Written:
    """Replace whole partitions of a table by dynamic overwrite, creating the table on first use.

    The partitions among the rows of ``df`` are replaced. ``touched`` names the partitions the state was computed for, ``whole``
    says that it is the state of the whole table: those that ended up without rows are dropped. Partition
    values, not rows, come to the driver. ``df`` may read the table. Values are checked first unless the caller knows them
    to be ``plain``; of rows kept from the table the check reads partition names only. A caller whose ``df`` is expensive gives
    rows with the same partitions as ``checked``.
    """
    spark = df.sparkSession
    if not plain:
        odd = (df if checked is None else checked).select(F.col(partition).cast("string").alias("value")).filter(~F.coalesce(F.col("value").rlike(f"^{PLAIN}$"), F.lit(False)))
        if found := [r.value for r in odd.limit(3).collect()]:
            raise ValueError(f"Partition values must be plain and not NULL: {found}")
    if not spark.catalog.tableExists(table):
        rows, seen = _observed(df, highest, partition)
        rows.write.format(fmt).partitionBy(partition).option("path", _location(table, root)).saveAsTable(table)
        return _written(seen)
    _add_columns(df, table)
    rows, seen = _observed(_matched(df, table), highest, partition)
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    found = _written(seen)
    before = partition_values(spark, table, partition) if whole else touched or []
    drop_partitions(spark, table, partition, sorted(set(before) - set(found.partitions)))
    spark.catalog.refreshTable(table)
    return found


def partition_values(spark: SparkSession, table: str, partition: str) -> list:
    """The values of a table's partitions, from its catalog entry."""
    kind = spark.table(table).schema[partition].dataType
    names = spark.sql(f"SHOW PARTITIONS {table}").select(F.substring_index("partition", "=", -1).cast(kind).alias("value"))
    return [r.value for r in names.collect()]


def drop_partitions(spark: SparkSession, table: str, partition: str, values: list) -> None:
    """Drop partitions in one statement."""
    kind = spark.table(table).schema[partition].dataType
    if values:
        specs = ", ".join(f"PARTITION (`{partition}` = {_literal(v, kind)})" for v in values)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")


def _literal(value, kind) -> str:
    return str(value) if kind.typeName() in ("integer", "long", "short", "byte") else f"'{value}'"


def publish_view(spark: SparkSession, name: str, query: DataFrame | str) -> None:
    """Publish a query under a name. It is tried first, so that a broken query leaves the old view.

    SQL text becomes a view in the catalog, which outlives the session where the catalog does; a DataFrame has no text to
    keep and becomes a view of the session.
    """
    if isinstance(query, str):
        spark.sql(query).schema  # analysis errors surface here
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS {query}")
        return
    trial = f"_trial_{uuid.uuid4().hex}"
    query.createOrReplaceTempView(trial)
    try:
        spark.table(trial).schema  # analysis errors surface here
        query.createOrReplaceTempView(name)
    finally:
        spark.catalog.dropTempView(trial)


def compact(
    table: str, keys: list[str], root: str, spark: SparkSession, merges_since: int | None = None,
    threshold: int | None = None, last_done=None, partitions: int | None = None,
) -> bool:
    """Rewrite a table, or each of its partitions, in key order (space-filling for several keys) when due; the caller resets its
    merge counter on True."""
    if not compaction_due(merges_since, threshold, last_done):
        return False
    state = spark.table(table)
    rows = state.hint("rebalance") if not keys else clustered(state, keys, partitions) if len(keys) == 1 else z_ordered(state, keys, partitions)
    parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    if len(parts) > 1:
        raise ValueError("Tables with several partition columns are compacted by their table format")
    if parts:
        commit_partitions(rows, table, root, parts[0], whole=True)
    else:
        commit_snapshot(rows, table, root)
    return True


RUN_LOG_SCHEMA = (
    "run_id string, dataset_id string, queue_id string, status string, started_at timestamp_ntz, "
    "finished_at timestamp_ntz, bronze_row_count bigint, silver_row_count bigint, error_class string, "
    "error_message string, load_type string, incremental_rows_read bigint, watermark_start string, watermark_end string"
)
LAYER_LOG_SCHEMA = (
    "run_id string, dataset_id string, layer string, table_name string, operation string, row_count bigint, "
    "inserted_count bigint, updated_count bigint, deleted_count bigint, status string"
)
STEP_LOG_SCHEMA = (
    "run_id string, dataset_id string, phase string, step_key string, status string, progress_current bigint, "
    "progress_total bigint, details_json string, started_at timestamp_ntz, finished_at timestamp_ntz"
)


def log_rows(spark: SparkSession, schema: str, rows: list[dict]) -> DataFrame:
    """Run, layer or step entries as a DataFrame; missing fields are NULL."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
