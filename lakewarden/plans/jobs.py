"""Reports that relate job executions to queue items.

Inputs: executions(execution_id, job_id, started_at, finished_at, status, datasets_total), queue items whose
``correlation_id`` is a job id, and job_datasets(job_id, dataset_id, enabled, execution_order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.health import half_up
from ..operators.keyed import top_per_key, within_band
from ..session import ntz, shift

MATCH_SECONDS = 30


def _items(queue: DataFrame) -> DataFrame:
    return queue.select(
        F.col("correlation_id").alias("job_id"), "queue_id", "dataset_id", F.col("status").alias("item_status"), "requested_at",
        F.col("finished_at").alias("item_finished_at"), "last_error_class",
    )


def requested_with(executions: DataFrame, queue: DataFrame, seconds: int = MATCH_SECONDS) -> DataFrame:
    """Queue items requested within ``seconds`` of an execution's start."""
    ex = executions.select("execution_id", "job_id", F.col("started_at").alias("execution_started_at"))
    at = F.col("execution_started_at")
    return within_band(
        ex, _items(queue), ["job_id"], "requested_at", shift(at, "SECOND", -seconds), shift(at, "SECOND", seconds), 2 * seconds
    )


def finished_within(executions: DataFrame, queue: DataFrame, slack_seconds: int = 60, slot_seconds: int = 900) -> DataFrame:
    """Queue items that ended inside an execution, with a minute of slack at its end."""
    ex = executions.select(
        "execution_id", "job_id", F.col("started_at").alias("execution_started_at"), F.col("finished_at").alias("execution_finished_at")
    )
    return within_band(
        ex, _items(queue), ["job_id"], "item_finished_at", F.col("execution_started_at"),
        shift(F.col("execution_finished_at"), "SECOND", slack_seconds), slot_seconds,
    )


def item_counters(matched: DataFrame) -> DataFrame:
    s = F.upper("item_status")
    return matched.groupBy("execution_id").agg(
        F.count_if(s == "SUCCEEDED").alias("succeeded"), F.count_if(s == "FAILED").alias("failed"),
        F.count_if(s == "PENDING").alias("pending"), F.count_if(s.isin("RUNNING", "CLAIMED")).alias("running"),
    )


def _with_counters(executions: DataFrame, queue: DataFrame) -> DataFrame:
    counted = executions.select("execution_id", "job_id", "datasets_total").join(
        item_counters(requested_with(executions, queue)), "execution_id", "left"
    )
    return counted.fillna(0, ["succeeded", "failed", "pending", "running"]).withColumn(
        "items", F.col("succeeded") + F.col("failed") + F.col("pending") + F.col("running")
    )


def _expected() -> Column:
    stated = F.coalesce("datasets_total", F.lit(0))
    return F.when(stated > 0, stated).otherwise(F.col("items"))


def outcomes(executions: DataFrame, queue: DataFrame) -> DataFrame:
    """SUCCEEDED, FAILED or PARTIAL once no item is open; RUNNING before; NO_ITEMS when nothing matches."""
    open_items = (F.col("pending") > 0) | (F.col("running") > 0)
    result = (
        F.when(F.col("items") == 0, F.lit("NO_ITEMS")).when(open_items, F.lit("RUNNING")).when(F.col("failed") > 0, F.lit("FAILED"))
        .when(F.col("succeeded") < _expected(), F.lit("PARTIAL")).otherwise(F.lit("SUCCEEDED"))
    )
    return _with_counters(executions, queue).withColumn("outcome", result)


def progress(executions: DataFrame, queue: DataFrame) -> DataFrame:
    """Finished items in percent of the expected ones."""
    done = F.col("succeeded") + F.col("failed")
    pct = F.coalesce(half_up(F.try_divide(done * 100.0, _expected())), F.lit(0))
    return _with_counters(executions, queue).withColumn("expected", _expected().cast("bigint")).withColumn("progress_pct", pct)


def dataset_counts(job_datasets: DataFrame) -> DataFrame:
    """Enabled datasets of every job, in one aggregate."""
    return job_datasets.filter("enabled").groupBy("job_id").agg(F.count(F.lit(1)).alias("dataset_count"))


def latest_execution(executions: DataFrame) -> DataFrame:
    return top_per_key(executions, ["job_id"], [F.desc_nulls_last("started_at"), F.desc("execution_id")]).drop("_rn")


def _done_since(queue: DataFrame, status: str, day) -> DataFrame:
    return (
        queue.filter((F.col("status") == status) & (F.col("finished_at") >= ntz(day)))
        .select(F.col("correlation_id").alias("job_id"), "dataset_id").distinct()
    )


def replay_set(job_datasets: DataFrame, queue: DataFrame, day, mode: str = "ALL", selected: DataFrame | None = None) -> DataFrame:
    """The enabled job datasets to run again: REMAINING_TODAY, FAILED_ONLY, SELECTED or ALL."""
    enabled, keys = job_datasets.filter("enabled"), ["job_id", "dataset_id"]
    if mode == "REMAINING_TODAY":
        return enabled.join(_done_since(queue, "SUCCEEDED", day), keys, "left_anti")
    if mode == "FAILED_ONLY":
        return enabled.join(_done_since(queue, "FAILED", day), keys, "left_semi")
    if mode == "SELECTED":
        if selected is None:
            raise ValueError("SELECTED needs the selected datasets")
        return enabled.join(selected.select("dataset_id").distinct(), "dataset_id", "left_semi")
    return enabled


def replay_preview(executions: DataFrame, job_datasets: DataFrame, queue: DataFrame, day) -> DataFrame:
    """What each dataset of a job did in an execution: SUCCEEDED, FAILED, PENDING or NOT_ENQUEUED.

    A dataset without an item counts as succeeded when any run of the day succeeded. Of several items the
    latest request decides.
    """
    items = requested_with(executions, queue).groupBy("execution_id", "dataset_id").agg(
        F.max_by(F.upper("item_status"), F.struct("requested_at", "queue_id")).alias("item_status")
    )
    today = _done_since(queue, "SUCCEEDED", day).withColumn("succeeded_today", F.lit(True))
    base = executions.select("execution_id", "job_id").join(
        job_datasets.filter("enabled").select("job_id", "dataset_id"), "job_id", "inner"
    )
    s, good = F.col("item_status"), F.coalesce("succeeded_today", F.lit(False))
    status = (
        F.when(s == "SUCCEEDED", F.lit("SUCCEEDED")).when(s == "FAILED", F.lit("FAILED"))
        .when(s.isin("PENDING", "CLAIMED", "RUNNING"), F.lit("PENDING")).when(good, F.lit("SUCCEEDED"))
        .otherwise(F.lit("NOT_ENQUEUED"))
    )
    return (
        base.join(items, ["execution_id", "dataset_id"], "left").join(today, ["job_id", "dataset_id"], "left")
        .select("execution_id", "job_id", "dataset_id", status.alias("replay_status"), good.alias("succeeded_today"))
    )


def replay_summary(preview: DataFrame) -> DataFrame:
    r = F.col("replay_status")
    return preview.groupBy("execution_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(r == n).alias(n.lower()) for n in ("SUCCEEDED", "FAILED", "PENDING", "NOT_ENQUEUED")],
    )
