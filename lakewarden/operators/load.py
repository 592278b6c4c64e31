"""One load from source to bronze and silver, committed and recorded.

A write is as large as the increment where the table allows it: an append adds the new rows, a keyed write to a partitioned table reads
the partitions that the key index names and replaces those that change, a window replaces the partitions it covers; tables without
partitions are written whole. Silver receives the rows of the batches that it has not seen. The watermark is saved after the
write, from the rows that were written, so a run that fails in between reads its rows again, which a keyed write does not mind.
Watermarks, events and logs are ledgers: loads of several datasets may run at once.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ntz, shift
from . import commit, incremental, keyindex, ledger, merge, reconcile, writes
from .contract import Contract
from .incremental import BronzeLoad, LoadConfig

EVENT_SCHEMA = "dataset_id string, event string, run_id string, detail string, at timestamp_ntz"
BLOCKED, ACTIVE = "BLOCKED_SCHEMA_CHANGE", "ACTIVE"  # fixed values: execution states of a dataset
MERGED, COMPACTED, PROMOTED = "MERGED", "COMPACTED", "PROMOTED"


@dataclass(frozen=True)
class Place:
    """Where a dataset's tables live: bronze and silver names and partition columns, folder, prefix of the control tables."""

    bronze: str
    root: str
    control: str
    silver: str | None = None
    partition: str | None = None
    silver_partition: str | None = None

    def control_table(self, name: str) -> str:
        return f"{self.control}{name}"


@dataclass
class Outcome:
    """What a layer's write did."""

    operation: str
    rows: int = 0
    inserted: int | None = None
    updated: int | None = None
    deleted: int | None = None
    highest: str | None = None
    changes: DataFrame | None = None  # the rows brought in, where they are staged
    status: str = "SUCCEEDED"


@dataclass
class _Run:
    """A run's progress, for the logs."""

    steps: list = field(default_factory=list)
    bronze: Outcome | None = None
    silver: Outcome | None = None


def _table(spark: SparkSession, name: str) -> DataFrame | None:
    return spark.table(name) if spark.catalog.tableExists(name) else None


def newest_watermark() -> list[Column]:
    """The order of a dataset's watermark entries; of those made at one time the highest counts, numbers by value."""
    value = F.col("watermark_value")
    number = F.when(F.col("watermark_type") == "NUMERIC", value.try_cast("decimal(38,9)"))
    return [F.col("last_updated_at").desc_nulls_last(), number.desc_nulls_last(), value.desc(), F.col("last_run_id").desc()]


def stored_watermarks(spark: SparkSession, place: Place) -> DataFrame:
    """The current watermark of every dataset."""
    return ledger.current(ledger.entries(spark, place.control_table("watermarks"), incremental.WATERMARK_SCHEMA), ["dataset_id"], newest_watermark())


def fold_watermarks(spark: SparkSession, place: Place, before) -> int:
    """Fold the watermark entries of days before ``before``; the number of entries dropped."""
    return ledger.fold(spark, place.control_table("watermarks"), place.root, ["dataset_id"], newest_watermark(), before)


def events(spark: SparkSession, place: Place, dataset_id: str) -> DataFrame:
    return ledger.entries(spark, place.control_table("events"), EVENT_SCHEMA).filter(F.col("dataset_id") == dataset_id)


def add_events(spark: SparkSession, place: Place, dataset_id: str, run_id: str, found: list[tuple[str, str | None]], as_of) -> None:
    """Add (event, detail) entries of one run."""
    rows = spark.createDataFrame([(dataset_id, e, run_id, d) for e, d in found], "dataset_id string, event string, run_id string, detail string")
    ledger.append(rows.withColumn("at", ntz(as_of)), place.control_table("events"), place.root, as_of)


@dataclass(frozen=True)
class DatasetState:
    """What a dataset's events add up to."""

    execution_state: str = ACTIVE
    compacted_at: object = None
    merges_since: int = 0


def dataset_state(spark: SparkSession, place: Place, dataset_id: str) -> DatasetState:
    """Whether silver waits for an approval (bronze never does), and the merges since the last compaction."""
    of = events(spark, place, dataset_id)
    when = lambda *names: F.when(F.col("event").isin(*names), F.struct("at", "event"))
    got = of.agg(F.max(when(BLOCKED, ACTIVE)).alias("state"), F.max(when(COMPACTED)).alias("done")).first()
    merges = of.filter(F.col("event") == MERGED)
    since = (merges.filter(F.col("at") > F.lit(got.done.at)) if got.done else merges).count()
    return DatasetState(got.state.event if got.state else ACTIVE, got.done.at if got.done else None, since)


def write_bronze(load: BronzeLoad, place: Place, cfg: LoadConfig, as_of) -> Outcome:
    """Make a planned load durable. Writes other than keyed ones leave no key index behind, which would miss their keys."""
    spark, mark, keys = load.rows.sparkSession, cfg.watermark, list(cfg.primary_key)
    exists, operation = spark.catalog.tableExists(place.bronze), load.operation
    if operation in ("MERGE", "HASH_MERGE"):
        guard = "_row_hash" if operation == "HASH_MERGE" else None
        done = merge.merge(load.rows, place.bronze, place.root, keys, place.partition, mark, guard)
        return Outcome(operation, done.changed, done.inserted, done.updated, 0, changes=done.changes)
    spark.sql(f"DROP TABLE IF EXISTS {keyindex.index_table(place.bronze)}")
    if operation == "APPEND":
        done = commit.commit_append(load.rows, place.bronze, place.root, highest=mark, partition=place.partition)
        return Outcome(operation, done.rows, done.rows, 0, 0, done.highest, load.rows)
    if operation == "REPLACE_WHERE" and exists:
        low = shift(ntz(as_of), "DAY", -cfg.lookback_days)
        if place.partition:
            brought, replaced = merge.replace_window(load.rows, place.bronze, place.root, mark, low, place.partition)
        else:
            brought, replaced = load.rows_read, spark.table(place.bronze).filter(F.col(mark) >= low).count()
            commit.commit_snapshot(load.state, place.bronze, place.root)
        return Outcome(operation, brought, brought, 0, replaced)
    state = load.rows if operation == "REPLACE_WHERE" else load.state
    if place.partition:
        done = commit.commit_partitions(state, place.bronze, place.root, place.partition, whole=True, highest=mark)
    else:
        done = commit.commit_snapshot(state, place.bronze, place.root, highest=mark, reads_table=False)
    return Outcome(operation, done.rows, done.rows, 0, None, done.highest)


def save_watermark(value: str | None, source_type, place: Place, cfg: LoadConfig, run_id: str, as_of, spark: SparkSession) -> None:
    """Add a dataset's watermark to the ledger; entries of other loads stay, whatever the order in which they arrive."""
    if value is None:
        return
    row = (cfg.dataset_id, incremental.type_tag(source_type), cfg.watermark, value, run_id)
    df = spark.createDataFrame([row], "dataset_id string, watermark_type string, watermark_column string, watermark_value string, last_run_id string")
    ledger.append(df.withColumn("last_updated_at", ntz(as_of)), place.control_table("watermarks"), place.root, as_of)


def pending_batches(spark: SparkSession, place: Place, dataset_id: str) -> list[str]:
    """Runs whose bronze rows silver has not seen, as the layer log and the events tell."""
    layers = _table(spark, place.control_table("layers"))
    if layers is None:
        return []
    bronze = layers.filter((F.col("dataset_id") == dataset_id) & (F.col("layer") == "BRONZE")).select("run_id").distinct()
    seen = events(spark, place, dataset_id).filter(F.col("event") == PROMOTED).select(F.col("detail").alias("run_id"))
    return sorted(r.run_id for r in bronze.join(seen, "run_id", "left_anti").collect())


def write_silver(spark: SparkSession, place: Place, contract: Contract, run_id: str, brought: Outcome, waiting: list[str], as_of) -> Outcome:
    """Bring the rows of this run, and of runs that waited, to silver.

    With a key only those batches are cast and merged, and a newer stored row stays. Without one silver takes all of bronze. After a
    bronze write that replaced rows as a whole, or on the first promotion, all of bronze is read as well.
    """
    bronze, keys = spark.table(place.bronze), list(contract.primary_key)
    target = _table(spark, place.silver)
    if not keys:
        name, state = incremental.promote_to_silver(bronze, target, contract, as_of=as_of)
        done = commit.commit_snapshot(state, place.silver, place.root)
        return Outcome(name, done.rows, done.rows, 0)
    if target is None or brought.operation in ("OVERWRITE", "REPLACE_WHERE"):
        rows = bronze
    elif not waiting and brought.changes is not None:
        rows = brought.changes
    else:
        rows = bronze.filter(F.col("_batch_id").isin([*waiting, run_id]))
    typed = incremental.silver_rows(rows, contract)
    if place.silver_partition and place.silver_partition not in typed.columns:
        typed = typed.join(rows.select(*keys, place.silver_partition), keys)
    done = merge.merge(typed, place.silver, place.root, keys, place.silver_partition, contract.order_column, newest=bool(contract.order_column))
    return Outcome("MERGE", done.changed, done.inserted, done.updated, 0)


def compact_if_due(spark: SparkSession, place: Place, cfg: LoadConfig, state: DatasetState, threshold: int) -> bool:
    """Rewrite bronze in key order after ``threshold`` merges, this one included, or if that was never done."""
    keys = list(cfg.primary_key)
    if not commit.compact(place.bronze, keys, place.root, spark, state.merges_since + 1, threshold, state.compacted_at):
        return False
    if place.partition:
        keyindex.rebuilt(spark, place.bronze, place.root, keys, place.partition)
    return True


def mark_deleted(source_keys: DataFrame, place: Place, cfg: LoadConfig) -> Outcome:
    """Set ``_is_deleted`` in bronze on active rows whose key the source no longer has; only their partitions are written."""
    spark, keys = source_keys.sparkSession, list(cfg.primary_key)
    gone = reconcile.missing_at_source(spark.table(place.bronze), source_keys, keys).withColumn("_is_deleted", F.lit(True))
    done = merge.merge(gone, place.bronze, place.root, keys, place.partition)
    return Outcome("DELETE_FLAGS", done.changed, done.inserted, 0, done.updated, changes=done.changes)


def run_load(
    source: DataFrame, place: Place, cfg: LoadConfig, run_id: str, as_of, contract: Contract | None = None,
    gate: DataFrame | None = None, override: str | None = None, compact_after: int | None = 100,
) -> str:
    """Read, write, move the watermark, promote to silver and record the run; the run's status.

    A closed gate lets bronze succeed, leaves silver waiting and sets the dataset's state; the first run with an open gate brings
    all batches that waited. Keyed bronze tables are compacted after ``compact_after`` merges (None: never). An error is
    recorded with its whole text and raised again.
    """
    spark, found = source.sparkSession, []
    began, status, error, run = time.monotonic(), "SUCCEEDED", None, _Run()
    load = BronzeLoad("NONE", cfg.strategy, None, None, None)
    try:
        last = incremental.last_watermark(stored_watermarks(spark, place), cfg.dataset_id, override) if cfg.watermark else None
        load = incremental.load_bronze(source, _table(spark, place.bronze), cfg, run_id, as_of, last)
        run.steps.append(("BRONZE", "read", load.operation))
        promotes = contract is not None and bool(place.silver)
        state = dataset_state(spark, place, cfg.dataset_id)
        waiting = pending_batches(spark, place, cfg.dataset_id) if promotes else []
        if not load.short_circuited:
            run.bronze = write_bronze(load, place, cfg, as_of)
            run.steps.append(("BRONZE", "write", load.operation))
            load.watermark_end = run.bronze.highest or load.watermark_end
            if cfg.watermark and cfg.watermark in source.columns:
                save_watermark(load.watermark_end, source.schema[cfg.watermark].dataType, place, cfg, run_id, as_of, spark)
                run.steps.append(("BRONZE", "watermark", load.watermark_end))
            if load.operation in ("MERGE", "HASH_MERGE"):
                found.append((MERGED, None))
                if compact_after is not None and compact_if_due(spark, place, cfg, state, compact_after):
                    found.append((COMPACTED, None))
                    run.steps.append(("BRONZE", "compact", load.operation))
        if promotes and (run.bronze or waiting):
            closed = gate is not None and not gate.filter((F.col("dataset_id") == cfg.dataset_id) & ~F.col("silver_allowed")).isEmpty()
            if closed != (state.execution_state == BLOCKED):
                found.append((BLOCKED, "SCHEMA_CHANGE_DETECTED") if closed else (ACTIVE, None))
            if closed:
                run.silver = Outcome("NONE", status=BLOCKED)
                run.steps.append(("SILVER", "gate", BLOCKED))
            else:
                run.silver = write_silver(spark, place, contract, run_id, run.bronze or Outcome("NONE"), waiting, as_of)
                found += [(PROMOTED, batch) for batch in [*waiting, run_id]]
                run.steps.append(("SILVER", "write", run.silver.operation))
    except Exception as e:
        status, error = "FAILED", e
    if found:
        add_events(spark, place, cfg.dataset_id, run_id, found, as_of)
    _record(spark, place, cfg, run_id, as_of, time.monotonic() - began, load, status, error, run)
    if error is not None:
        raise error
    return status


def _record(spark, place: Place, cfg: LoadConfig, run_id: str, as_of, took: float, load: BronzeLoad, status: str, error, run: _Run) -> None:
    """Append the run, its layers and its steps to the control tables."""
    base, counted = {"run_id": run_id, "dataset_id": cfg.dataset_id}, run.bronze.rows if run.bronze else 0
    entry = base | {
        "status": status, "load_type": load.strategy, "bronze_row_count": counted, "silver_row_count": run.silver.rows if run.silver else None,
        "incremental_rows_read": load.rows_read if load.rows_read is not None else counted,
        "watermark_start": load.watermark_start, "watermark_end": load.watermark_end,
        "error_class": type(error).__name__ if error else None, "error_message": str(error) if error else None,
    }
    layers = [
        base | {"layer": layer, "table_name": table, "operation": o.operation, "row_count": o.rows, "inserted_count": o.inserted, "updated_count": o.updated, "deleted_count": o.deleted, "status": o.status}
        for layer, table, o in (("BRONZE", place.bronze, run.bronze), ("SILVER", place.silver, run.silver)) if o is not None
    ]
    logs = (
        ("runs", commit.RUN_LOG_SCHEMA, [entry]), ("layers", commit.LAYER_LOG_SCHEMA, layers),
        ("steps", commit.STEP_LOG_SCHEMA, [base | {"phase": a, "step_key": b, "status": "DONE", "details_json": json.dumps({"detail": c})} for a, b, c in run.steps]),
    )
    finished = ntz(as_of) + F.make_dt_interval(secs=F.lit(round(took, 3)))
    for name, schema, rows in logs:
        if rows:
            df = commit.log_rows(spark, schema, rows)
            stamped = df.withColumn("started_at", ntz(as_of)).withColumn("finished_at", finished) if "started_at" in df.columns else df
            ledger.append(stamped, place.control_table(name), place.root, as_of)
