"""Reports over the run queue and its transitions.

Inputs: queue(queue_id, dataset_id, status, priority, attempt, requested_at, claimed_at, started_at,
finished_at, next_retry_at, correlation_id, ...) and transitions(queue_id, new_status, created_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.health import idempotency_key
from ..operators.keyed import lookup, nearest_rank_percentiles
from ..session import millis_between, ntz, seconds_between, shift, trunc_ntz

TERMINAL = ("SUCCEEDED", "FAILED", "CANCELLED")


def is_eligible(as_of) -> Column:
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= ntz(as_of))
    return (F.col("status") == "PENDING") & due


def eligible(queue: DataFrame, as_of) -> DataFrame:
    """Items that may run now."""
    return queue.filter(is_eligible(as_of))


def stuck(queue: DataFrame, as_of, run_minutes: int = 120, claim_minutes: int = 30) -> DataFrame:
    """Work that started too long ago without an end, and claims nobody picked up, with the kind in ``stuck_kind``."""
    now = ntz(as_of)
    running = (
        F.col("status").isin("RUNNING", "PENDING") & F.col("started_at").isNotNull() & F.col("finished_at").isNull()
        & (F.col("started_at") < shift(now, "MINUTE", -run_minutes))
    )
    claimed = (F.col("status") == "CLAIMED") & (F.col("claimed_at") < shift(now, "MINUTE", -claim_minutes))
    kind = F.when(running, F.lit("TIMEOUT")).when(claimed, F.lit("CLAIM_TIMEOUT"))
    return queue.filter(running | claimed).withColumn("stuck_kind", kind)


def backlog(queue: DataFrame, as_of, hours: int = 1) -> DataFrame:
    return queue.filter((F.col("status") == "PENDING") & (F.col("requested_at") < shift(ntz(as_of), "HOUR", -hours)))


def counters(queue: DataFrame, as_of, claim_minutes: int = 30) -> DataFrame:
    """All status counters and stale claims in one pass."""
    s = F.col("status")
    names = ("PENDING", "CLAIMED", "RUNNING", "FAILED", "SUCCEEDED")
    stale = (s == "CLAIMED") & (F.col("claimed_at") < shift(ntz(as_of), "MINUTE", -claim_minutes))
    return queue.agg(
        F.count(F.lit(1)).alias("total_items"), *[F.count_if(s == n).alias(f"{n.lower()}_count") for n in names],
        F.count_if(stale).alias("stale_claimed_count"),
    )


def wait_times(queue: DataFrame) -> DataFrame:
    """Milliseconds from request to claim and from claim to running."""
    return queue.withColumns(
        {
            "to_claim_ms": millis_between(F.col("requested_at"), F.col("claimed_at")),
            "to_running_ms": millis_between(F.col("claimed_at"), F.col("started_at")),
        }
    )


WAITS = ("to_claim_ms", "to_running_ms")


def latency(queue: DataFrame, as_of=None, hours: int | None = None, exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """p50 and p95 of both waits, in one row: sketches by default, or exact nearest-rank percentiles."""
    rows = queue if hours is None else queue.filter(F.col("requested_at") >= shift(ntz(as_of), "HOUR", -hours))
    waits, points = wait_times(rows), {"p50": 50, "p95": 95}
    if not exact:
        return waits.agg(
            *[F.percentile_approx(w, q / 100, accuracy).cast("bigint").alias(f"{p}_{w}") for w in WAITS for p, q in points.items()]
        )
    long = waits.unpivot([], list(WAITS), "wait", "ms")
    per_wait = nearest_rank_percentiles(long, ["wait"], "ms", points, width=1000)
    return per_wait.agg(*[F.max(F.when(F.col("wait") == w, F.col(p))).alias(f"{p}_{w}") for w in WAITS for p in points])


def timeline(transitions: DataFrame, since=None, unit: str = "minute") -> DataFrame:
    """Claims, starts and ends per minute."""
    rows = transitions if since is None else transitions.filter(F.col("created_at") >= ntz(since))
    s = F.col("new_status")
    return rows.groupBy(trunc_ntz(unit, F.col("created_at")).alias("ts_min")).agg(
        F.count_if(s == "CLAIMED").alias("claims"), F.count_if(s == "RUNNING").alias("starts"), F.count_if(s.isin(*TERMINAL)).alias("ends")
    )


def with_dataset(queue: DataFrame, datasets: DataFrame) -> DataFrame:
    names = datasets.select("dataset_id", "dataset_name", "source_type", "execution_state", "bronze_table", "silver_table")
    return lookup(queue, names, ["dataset_id"])


def open_with_dataset(queue: DataFrame, datasets: DataFrame, source_type: str | None = None, preview: int = 200) -> DataFrame:
    """Open or failed items of registered datasets with a short error text."""
    ds = datasets if source_type is None else datasets.filter(F.col("source_type") == source_type)
    open_items = queue.filter(F.col("status").isin("PENDING", "FAILED", "CLAIMED", "RUNNING"))
    short = open_items.withColumn("error_preview", F.substring("last_error_message", 1, preview))
    return lookup(short, ds.select("dataset_id", "dataset_name"), ["dataset_id"], "inner")


def next_to_run(queue: DataFrame, as_of, n: int) -> DataFrame:
    """Eligible items by priority, oldest request first."""
    return eligible(queue, as_of).orderBy("priority", "requested_at", "queue_id").limit(n)


def oldest_claims(queue: DataFrame, as_of, n: int = 100) -> DataFrame:
    claimed = queue.filter((F.col("status") == "CLAIMED") & F.col("claimed_at").isNotNull())
    aged = claimed.withColumn("claim_age_seconds", seconds_between(F.col("claimed_at"), ntz(as_of)))
    return aged.orderBy("claimed_at", "queue_id").limit(n)


def oldest_pending(queue: DataFrame, as_of, n: int = 10) -> DataFrame:
    return eligible(queue, as_of).orderBy("requested_at", "queue_id").limit(n)


def activity(queue: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """Pending and running counts, and whether something seems to work the queue: running items or a recent end."""
    s = F.col("status")
    one = queue.agg(
        F.count_if(is_eligible(as_of)).alias("pending"), F.count_if(s.isin("CLAIMED", "RUNNING")).alias("running"),
        F.max(F.when(s.isin("SUCCEEDED", "FAILED"), F.col("finished_at"))).alias("last_finished_at"),
    )
    recent = F.coalesce(F.col("last_finished_at") > shift(ntz(as_of), "MINUTE", -minutes), F.lit(False))
    active = (F.col("running") > 0) | recent
    return one.withColumn("likely_active", active).withColumn("warning", (F.col("pending") > 0) & ~active)


def recently_finished(queue: DataFrame, n: int = 5) -> DataFrame:
    done = queue.filter(F.col("status").isin("SUCCEEDED", "FAILED") & F.col("finished_at").isNotNull())
    return done.orderBy(F.desc("finished_at"), "queue_id").limit(n)


def remove_replays(items: DataFrame, *parts: str) -> DataFrame:
    """One row per idempotency key."""
    return items.withColumn("idempotency_key", idempotency_key(*[F.col(p) for p in parts])).dropDuplicates(["idempotency_key"])
