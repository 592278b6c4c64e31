"""Incremental loading: watermark, cutoff, write mode, bronze load and silver promotion."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ntz, shift
from ..session import stage as staged
from . import writes
from .bronze import add_full_refresh_columns, add_technical_columns, clean_names
from .contract import Contract, cast_to_contract
from .keyed import latest_per_key

DEFAULT_LOOKBACK_DAYS = 3
WATERMARK_SCHEMA = (
    "dataset_id string, watermark_type string, watermark_column string, watermark_value string, "
    "last_run_id string, last_updated_at timestamp_ntz"
)


@dataclass(frozen=True)
class LoadConfig:
    """One dataset's load settings, as the registry holds them."""

    dataset_id: str
    source_name: str
    bronze_mode: str = "SNAPSHOT"
    strategy: str = "SNAPSHOT"
    primary_key: tuple[str, ...] = ()
    watermark: str | None = None
    lookback_days: int = DEFAULT_LOOKBACK_DAYS
    volatile: tuple[str, ...] = ()
    enable_incremental: bool = True

    @property
    def reads_by_watermark(self) -> bool:
        return bool(self.watermark) and choose_write(self).strategy == "WATERMARK"

    @staticmethod
    def from_metadata(dataset_id: str, source_name: str, bronze_mode: str, strategy: str, meta: dict) -> "LoadConfig":
        """From registry metadata; both spellings of the watermark entry are read."""
        return LoadConfig(
            dataset_id, source_name, bronze_mode, strategy, tuple(meta.get("pk") or ()),
            meta.get("watermark_column") or meta.get("watermark_col"),
            int(meta.get("lookback_days", DEFAULT_LOOKBACK_DAYS)), tuple(meta.get("hash_exclude_cols") or ()),
        )


@dataclass(frozen=True)
class WritePlan:
    operation: str
    strategy: str
    reason: str


def choose_write(cfg: LoadConfig) -> WritePlan:
    """Strategy and mode to the operation that is run.

    A SNAPSHOT strategy with CURRENT mode and a watermark is promoted to WATERMARK. CURRENT without a
    key replaces the lookback window when there is a watermark and everything otherwise, so that a
    windowed read is never written over a whole table.
    """
    strategy, why = cfg.strategy, "as configured"
    if strategy == "SNAPSHOT" and cfg.bronze_mode == "CURRENT" and cfg.watermark:
        strategy, why = "WATERMARK", "promoted: CURRENT mode with a watermark"
    if not cfg.enable_incremental or cfg.bronze_mode == "SNAPSHOT":
        return WritePlan("OVERWRITE", strategy if cfg.enable_incremental else "SNAPSHOT", why)
    if cfg.bronze_mode == "APPEND_LOG":
        return WritePlan("APPEND", strategy, why)
    if cfg.primary_key:
        return WritePlan("HASH_MERGE" if strategy == "HASH_MERGE" else "MERGE", strategy, why)
    if cfg.watermark:
        return WritePlan("REPLACE_WHERE", "WATERMARK", "no key: the lookback window is replaced")
    return WritePlan("OVERWRITE", "SNAPSHOT", "POLICY_VIOLATION: CURRENT without key or watermark")


def choose_write_column(mode: Column, strategy: Column, has_key: Column, watermark: Column, enabled: Column) -> Column:
    """The operation of ``choose_write`` for many registry rows at once."""
    return (
        F.when(~enabled, F.lit("OVERWRITE"))
        .when(mode == "APPEND_LOG", F.lit("APPEND"))
        .when(mode != "CURRENT", F.lit("OVERWRITE"))
        .when(has_key & (strategy == "HASH_MERGE"), F.lit("HASH_MERGE"))
        .when(has_key, F.lit("MERGE"))
        .when(watermark.isNotNull(), F.lit("REPLACE_WHERE"))
        .otherwise(F.lit("OVERWRITE"))
    )


def last_watermark(stored: DataFrame, dataset_id: str, override: str | None = None) -> str | None:
    """The override of this run, else the stored value."""
    if override:
        return override
    row = stored.filter(F.col("dataset_id") == dataset_id).select("watermark_value").limit(1).collect()
    return row[0][0] if row else None


def effective_watermarks(registry: DataFrame, stored: DataFrame) -> DataFrame:
    """Every dataset's watermark: manual override before stored value."""
    joined = registry.select("dataset_id", "override_watermark_value").join(
        stored.select("dataset_id", "watermark_value"), "dataset_id", "left"
    )
    manual = F.nullif(F.col("override_watermark_value"), F.lit(""))
    return joined.select(
        "dataset_id", F.coalesce(manual, "watermark_value").alias("effective_watermark"),
        manual.isNotNull().alias("is_override"),
    )


def cutoff_text(watermark: str, lookback_days: int) -> str:
    """Watermark minus lookback. Dates and times are read in ISO form, with or without a zone (zoned ones become UTC);
    numbers, which have no days, are used unchanged; anything else is an error, as its late rows would be missed."""
    if re.fullmatch(r"[+-]?[0-9]+([.][0-9]+)?", watermark.strip()):
        return watermark
    at = datetime.fromisoformat(watermark.strip())
    if at.tzinfo is not None:
        at = at.astimezone(timezone.utc).replace(tzinfo=None)
    return str(at.replace(microsecond=0) - timedelta(days=lookback_days))


def typed_bound(df: DataFrame, column: str, value: str) -> Column:
    """A bound in the column's own type, so that the comparison can be pushed into the source."""
    return F.lit(value).cast(df.schema[column].dataType)


def read_increment(source: DataFrame, cfg: LoadConfig, watermark: str | None, as_of) -> DataFrame:
    """The rows a run has to read: from the cutoff on with a key, a rolling window without, else all."""
    if cfg.reads_by_watermark:
        if not cfg.primary_key:
            return source.filter(F.col(cfg.watermark) >= shift(ntz(as_of), "DAY", -cfg.lookback_days))
        if watermark:
            low = typed_bound(source, cfg.watermark, cutoff_text(watermark, cfg.lookback_days))
            return source.filter(F.col(cfg.watermark) >= low)
    return source


def has_newer(source: DataFrame, column: str, watermark: str) -> bool:
    """Whether the source holds anything after the watermark; one row is enough to know."""
    return not source.filter(F.col(column) > typed_bound(source, column, watermark)).select(column).isEmpty()


def arrival_report(source: DataFrame, column: str, watermark: Column, lookback_days: int) -> DataFrame:
    """Rows after the watermark, late rows inside the lookback, older rows, and the resulting decision."""
    low = shift(watermark, "DAY", -lookback_days)
    c = F.col(column)
    one = source.agg(
        F.count_if(c > watermark).alias("newer_rows"), F.count_if(c.between(low, watermark)).alias("lookback_rows"),
        F.count_if(c < low).alias("older_rows"), F.max(c).alias("max_watermark"),
    )
    decision = (
        F.when(F.col("newer_rows") > 0, F.lit("LOAD")).when(F.col("lookback_rows") > 0, F.lit("LATE_ARRIVALS"))
        .otherwise(F.lit("SKIP"))
    )
    return one.withColumn("decision", decision)


def high_water_mark(df: DataFrame, column: str, batch_id: str | None = None) -> DataFrame:
    """Minimum and maximum watermark and row count, optionally of one batch."""
    rows = df.filter(F.col("_batch_id") == batch_id) if batch_id else df
    return rows.agg(F.min(column).alias("watermark_start"), F.max(column).alias("watermark_end"), F.count(F.lit(1)).alias("rows"))


def type_tag(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "TIMESTAMP"
    return "NUMERIC" if isinstance(data_type, T.NumericType) else "STRING"


def watermark_rows(
    df: DataFrame, dataset: Column, column: str, run: Column, as_of,
) -> DataFrame:
    """New watermark entries, one per dataset, stored as text with a type tag. NULL maxima save nothing."""
    tag = type_tag(df.schema[column].dataType)
    return (
        df.groupBy(dataset.alias("dataset_id"))
        .agg(F.max(column).alias("_m"), F.max(run).alias("last_run_id"))
        .filter(F.col("_m").isNotNull())
        .select(
            "dataset_id", F.lit(tag).alias("watermark_type"), F.lit(column).alias("watermark_column"),
            F.col("_m").cast("string").alias("watermark_value"), "last_run_id", ntz(as_of).alias("last_updated_at"),
        )
    )


def save_watermarks(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """The watermark table after an upsert of the new entries."""
    return writes.upsert(stored, entries, ["dataset_id"], "last_updated_at")


def watermark_report(registry: DataFrame, stored: DataFrame) -> DataFrame:
    """Watermarks of registered datasets, for a report."""
    return registry.select("dataset_id", "dataset_name").join(
        stored.select("dataset_id", "watermark_column", "watermark_type", "watermark_value", "last_updated_at"),
        "dataset_id", "inner",
    )


def collection_window(last_collected: Column, as_of: Column, overlap_minutes: int = 10) -> tuple[Column, Column]:
    """Start and end of the next collection; the start overlaps the last one."""
    return shift(last_collected, "MINUTE", -overlap_minutes), as_of


@dataclass
class BronzeLoad:
    """A planned bronze load: what is written, how, and what the increment contained."""

    operation: str
    strategy: str
    state: DataFrame | None
    increment: DataFrame | None
    watermark_start: str | None
    watermark_end: str | None = None
    rows_read: int | None = None
    short_circuited: bool = False
    late_arrivals: bool = False
    metrics: dict = field(default_factory=dict)
    rows: DataFrame | None = None  # what the run brings in, with technical columns; ``state`` is the table afterwards


def load_bronze(
    source: DataFrame, target: DataFrame | None, cfg: LoadConfig, run_id: str, as_of, watermark: str | None = None,
    stage: bool = True,
) -> BronzeLoad:
    """Plan one bronze load.

    With ``stage`` the increment is read once into the shared folder, so that counting, measuring and
    merging see the same rows even when the source changes meanwhile or an executor is lost; leave it out
    for sources that do not change. Full loads use each row once and are neither staged nor counted: the write observes
    them. An append with a watermark reads strictly above the stored one, as it can't absorb rows that it has already; rows
    without a watermark come with the first run only. When nothing is newer and the lookback is empty, nothing is written.
    """
    source = clean_names(source)
    plan = choose_write(cfg)
    if not cfg.enable_incremental:
        rows = add_full_refresh_columns(source, run_id, cfg.source_name, as_of)
        return BronzeLoad(plan.operation, plan.strategy, rows, source, watermark, rows=rows)
    appends = plan.operation == "APPEND" and bool(cfg.watermark) and cfg.watermark in source.columns
    if plan.operation == "OVERWRITE" or plan.operation == "APPEND" and not appends:
        rows = add_technical_columns(source, run_id, cfg.source_name, as_of, cfg.watermark, list(cfg.volatile))
        keep = plan.operation == "APPEND" and target is not None
        return BronzeLoad(plan.operation, plan.strategy, writes.append_log(target, rows) if keep else rows, source, watermark, rows=rows)
    if appends:
        increment = source.filter(F.col(cfg.watermark) > typed_bound(source, cfg.watermark, watermark)) if watermark else source
    else:
        increment = source if plan.operation == "HASH_MERGE" else read_increment(source, cfg, watermark, as_of)
    newer = not (appends and watermark)
    if plan.operation == "MERGE" and watermark and cfg.watermark:
        newer = has_newer(source, cfg.watermark, watermark)
    if stage:
        increment = staged(increment)
    stats = [F.count(F.lit(1)).alias("rows")]
    if cfg.watermark and cfg.watermark in increment.columns:
        stats.append(F.max(cfg.watermark).cast("string").alias("mark"))
    got = increment.agg(*stats).collect()[0].asDict()
    load = BronzeLoad(plan.operation, plan.strategy, None, increment, watermark, rows_read=got["rows"])
    if not newer and not got["rows"]:
        load.short_circuited, load.watermark_end = True, watermark
        return load
    load.late_arrivals = not newer and not appends
    load.watermark_end = got.get("mark") or watermark
    rows = add_technical_columns(increment, run_id, cfg.source_name, as_of, cfg.watermark, list(cfg.volatile))
    load.rows, keys = rows, list(cfg.primary_key)
    if appends:
        load.state = rows if target is None else writes.append_log(target, rows)
    elif plan.operation == "REPLACE_WHERE":
        low = shift(ntz(as_of), "DAY", -cfg.lookback_days)
        load.state = rows if target is None else writes.replace_window(target, rows, cfg.watermark, low)
    elif target is None:
        load.state = writes.one_per_key(writes.require_keys(rows, keys), keys, cfg.watermark)
    elif plan.operation == "HASH_MERGE":
        load.state = writes.upsert_changed(target, rows, keys, order_column=cfg.watermark)
    else:
        load.state = writes.upsert(target, rows, keys, cfg.watermark)
    return load


def merge_metrics(load: BronzeLoad, target: DataFrame, cfg: LoadConfig) -> DataFrame:
    """What the load did to the target: inserted, updated and unchanged rows."""
    rows = load.increment
    hashed = add_technical_columns(rows, "-", cfg.source_name, "1970-01-01", cfg.watermark, list(cfg.volatile))
    return writes.merge_metrics(
        writes.merge_actions(target, hashed, list(cfg.primary_key), "_row_hash", cfg.watermark)
    )


def silver_rows(bronze: DataFrame, contract: Contract, check_nulls: bool = True) -> DataFrame:
    """Bronze rows that are not deleted, cast to the contract; with a key, the newest row of each."""
    rows = bronze
    if "_is_deleted" in bronze.columns:
        rows = rows.filter(~F.coalesce("_is_deleted", F.lit(False)))
    typed = cast_to_contract(rows, contract, check_nulls)
    if not contract.primary_key:
        return typed
    return latest_per_key(writes.require_keys(typed, list(contract.primary_key)), list(contract.primary_key), contract.order_column)


def promote_to_silver(
    bronze: DataFrame, target: DataFrame | None, contract: Contract, mode: str = "auto",
    window_column: str | None = None, lookback_days: int = DEFAULT_LOOKBACK_DAYS, as_of=None, check_nulls: bool = True,
    batch_id: str | None = None,
) -> tuple[str, DataFrame]:
    """Cast, keep the newest row per key, write by key or mode.

    Without a key only the lookback window is read. With a key, ``batch_id`` limits the work to the rows
    of one load; a stored row that is newer is kept, so the result is that of reading all of bronze.
    """
    cutoff = None
    rows = bronze
    if "_is_deleted" in bronze.columns:
        rows = rows.filter(~F.coalesce("_is_deleted", F.lit(False)))
    if mode == "REPLACE_WHERE" and not contract.primary_key and window_column and target is not None:
        cutoff = shift(ntz(as_of), "DAY", -lookback_days)
        rows = rows.filter(F.col(window_column) >= cutoff)
    by_batch = bool(batch_id and contract.primary_key and target is not None)
    if by_batch:
        rows = rows.filter(F.col("_batch_id") == batch_id)
    typed = cast_to_contract(rows, contract, check_nulls)
    if contract.primary_key:
        typed = writes.require_keys(typed, list(contract.primary_key))
    if by_batch:
        return "MERGE", writes.upsert_newest(target, typed, list(contract.primary_key), contract.order_column)
    if contract.primary_key:
        typed = latest_per_key(typed, list(contract.primary_key), contract.order_column)
    return writes.silver_state(target, typed, contract, mode, window_column, cutoff)
