"""Reports over the run log.

Inputs: runs(run_id, dataset_id, job_id, status, started_at, finished_at, row_count, load_type,
error_class, error_message), datasets(dataset_id, dataset_name, ...) and
layers(run_id, dataset_id, layer, operation, row_count, inserted_count, updated_count, started_at).
"Now" is always the argument ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import health
from ..operators.keyed import carry_previous, lookup, nearest_rank_percentiles, top_per_key
from ..session import millis_between, ntz, seconds_between, shift

PERIODS = {"24h": ("HOUR", 24), "7d": ("DAY", 7), "30d": ("DAY", 30)}
NEWEST = ("started_at", "run_id")


def newest_first() -> list[Column]:
    return [F.desc_nulls_last(c) for c in NEWEST]


def ended_at() -> Column:
    return F.coalesce("finished_at", "started_at")


def duration_seconds() -> Column:
    return seconds_between(F.col("started_at"), F.col("finished_at"))


def duration_ms() -> Column:
    return millis_between(F.col("started_at"), F.col("finished_at"))


def in_period(df: DataFrame, column: str, as_of, period: str) -> DataFrame:
    """Rows of the last 24h, 7d or 30d; a plain range that reaches the scan."""
    unit, n = PERIODS[period]
    return df.filter(F.col(column) >= shift(ntz(as_of), unit, -n))


def between_days(df: DataFrame, column: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows from the first day's start to the last day's last second."""
    if first:
        df = df.filter(F.col(column) >= ntz(f"{first} 00:00:00"))
    if last:
        df = df.filter(F.col(column) <= ntz(f"{last} 23:59:59"))
    return df


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def kpis(runs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Totals, successes, failures, average seconds of successes and success rate, in one row."""
    recent = runs.filter(F.col("started_at") >= shift(ntz(as_of), "HOUR", -hours))
    good = F.col("status") == "SUCCEEDED"
    one = recent.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(good).alias("success"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.round(F.avg(F.when(good & F.col("finished_at").isNotNull(), duration_seconds().cast("double"))), 0).alias("avg_duration_sec"),
    )
    rate = F.try_divide(F.col("success") * 1000.0, F.col("total"))
    return one.withColumn("success_rate", F.coalesce(F.floor(rate + 0.5) / 10.0, F.lit(0.0)))


def with_context(runs: DataFrame, datasets: DataFrame, layers: DataFrame) -> DataFrame:
    """Runs with dataset name and strategy and the counts of their bronze step."""
    bronze = layers.filter(F.col("layer") == "BRONZE").select(
        "run_id", F.col("inserted_count").alias("bronze_inserted_count"), F.col("updated_count").alias("bronze_updated_count"),
        F.col("operation").alias("bronze_operation"),
    )
    names = datasets.select("dataset_id", "dataset_name", "incremental_strategy", "enable_incremental")
    timed = runs.withColumn("duration_seconds", duration_seconds()).join(bronze, "run_id", "left")
    return lookup(timed, names, ["dataset_id"])


def failed_with_dataset(runs: DataFrame, datasets: DataFrame, source_type: str | None = None, preview: int = 500) -> DataFrame:
    """Failed runs of registered datasets with a short error text."""
    ds = datasets if source_type is None else datasets.filter(F.col("source_type") == source_type)
    failed = runs.filter(F.col("status") == "FAILED")
    return lookup(failed, ds.select("dataset_id", "dataset_name"), ["dataset_id"], "inner").select(
        "run_id", "dataset_id", "dataset_name", "status", "error_class",
        F.substring("error_message", 1, preview).alias("error_preview"), "started_at", "finished_at",
    )


def activity(datasets: DataFrame, runs: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Every dataset with its runs and incremental runs in the window. Runs are counted before the join."""
    recent = runs.filter(F.col("started_at") >= shift(ntz(as_of), "DAY", -days)).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("executions"), F.count_if(F.col("load_type") == "INCREMENTAL").alias("incremental_executions")
    )
    zero = F.lit(0).cast("bigint")
    return datasets.select("dataset_id", "dataset_name").join(recent, "dataset_id", "left").select(
        "dataset_id", "dataset_name", F.coalesce("executions", zero).alias("executions"),
        F.coalesce("incremental_executions", zero).alias("incremental_executions"),
    )


def last_success(runs: DataFrame) -> DataFrame:
    return runs.groupBy("dataset_id").agg(
        F.max(F.when(F.col("status") == "SUCCEEDED", F.col("finished_at"))).alias("last_success_at")
    )


def with_last_success(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    return datasets.join(last_success(runs), "dataset_id", "left")


def load_type_stats(runs: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    rows = runs if days is None else runs.filter(F.col("started_at") >= shift(ntz(as_of), "DAY", -days))
    return rows.groupBy("load_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("dataset_id").alias("datasets"),
        F.round(F.avg(F.col("row_count").cast("double")), 4).alias("avg_rows"),
        F.min("started_at").alias("first_occurrence"), F.max("started_at").alias("last_occurrence"),
    )


def rows_by(layers: DataFrame, column: str, since=None) -> DataFrame:
    """Rows written per layer or per dataset since a time."""
    rows = layers if since is None else layers.filter(F.col("started_at") >= ntz(since))
    return rows.groupBy(column).agg(F.sum("row_count").alias("rows"))


def recent_failures(runs: DataFrame, n: int = 50) -> DataFrame:
    failed = runs.filter(F.col("status") == "FAILED").withColumn("ended_at", ended_at())
    return failed.orderBy(F.col("ended_at").desc_nulls_last(), F.col("run_id")).limit(n)


def latest_run(runs: DataFrame, key: str = "dataset_id") -> DataFrame:
    return top_per_key(runs, [key], newest_first()).drop("_rn")


def previous_success(runs: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Each run with the run id, rows and seconds of the dataset's previous success."""
    timed = runs.withColumn("seconds", duration_seconds())
    return carry_previous(
        timed, [key], list(NEWEST), ["run_id", "row_count", "seconds"], when=F.col("status") == "SUCCEEDED"
    )


def volume_change(runs: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Row count against the previous run: percent, label, severity."""
    before = carry_previous(runs, [key], list(NEWEST), ["row_count"])
    pct = health.change_percent(F.col("prev_row_count"), F.col("row_count"))
    return before.withColumn("change_pct", pct).withColumns(
        {"change_label": health.change_label(F.col("change_pct")), "severity": health.change_severity(F.col("change_pct"))}
    )


def run_risk(runs: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Risk level of each run, against the previous success of its dataset."""
    before = previous_success(runs, key)
    pct = health.change_percent(F.col("prev_row_count"), F.col("row_count"))
    return before.withColumn("change_pct", pct).withColumn(
        "risk",
        health.run_risk(F.col("status"), F.col("row_count"), F.col("change_pct"), F.col("seconds"), F.col("prev_seconds")),
    )


def status_distribution(runs: DataFrame, key: str) -> DataFrame:
    g = health.status_group(F.col("status"))
    return runs.groupBy(key).agg(
        *[F.count_if(g == name).alias(name) for name in ("succeeded", "failed", "running", "other")],
        F.count(F.lit(1)).alias("total"),
    )


def success_rate(runs: DataFrame, key: str) -> DataFrame:
    """Whole percent of successes."""
    d = status_distribution(runs, key)
    return d.select(key, "total", health.half_up(F.col("succeeded") * 100.0 / F.col("total")).alias("success_rate"))


def _timed(runs: DataFrame) -> DataFrame:
    return runs.withColumn("duration_ms", F.coalesce(duration_ms(), F.lit(0)))


def duration_variance(runs: DataFrame, key: str) -> DataFrame:
    """Average and latest duration, their difference in percent and the trend; runs without duration do not count."""
    known = F.col("duration_ms") > 0
    g = _timed(runs).groupBy(key).agg(
        F.coalesce(health.half_up(F.avg(F.when(known, F.col("duration_ms")))), F.lit(0)).alias("avg_ms"),
        F.coalesce(F.max_by("duration_ms", F.when(known, F.struct(*NEWEST))), F.lit(0)).alias("last_ms"),
    )
    return with_trend(g)


def with_trend(g: DataFrame) -> DataFrame:
    pct = F.coalesce(health.half_up(F.try_divide((F.col("last_ms") - F.col("avg_ms")) * 100.0, F.col("avg_ms"))), F.lit(0))
    trend = F.when(F.abs("variation_pct") < 15, F.lit("stable")).when(F.col("variation_pct") > 0, F.lit("slower")).otherwise(F.lit("faster"))
    return g.withColumn("variation_pct", pct).withColumn("trend", trend)


def failures_in_last(runs: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Failures among the newest ``n`` runs."""
    return top_per_key(runs.select(key, "status", *NEWEST), [key], newest_first(), n).groupBy(key).agg(
        F.count_if(F.upper("status") == "FAILED").alias("recent_failures")
    )


def sparkline(runs: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The newest runs, oldest first, with a height relative to the longest of them."""
    last = top_per_key(_timed(runs).select(key, "run_id", "status", "started_at", "duration_ms"), [key], newest_first(), n)
    w = Window.partitionBy(key)
    top = F.greatest(F.max("duration_ms").over(w), F.lit(1))
    return last.select(
        key, "run_id", (F.max("_rn").over(w) - F.col("_rn") + 1).cast("bigint").alias("point"),
        health.point_status(F.col("status")).alias("point_status"), "duration_ms",
        F.round(F.greatest(F.lit(0.08), F.col("duration_ms") / top), 6).alias("height"),
    )


def job_risk(runs: DataFrame, key: str, jobs: DataFrame | None = None) -> DataFrame:
    """critical, unstable or stable per job. ``jobs`` may hold ``enabled``; unknown jobs count as enabled.

    One aggregate gives counters, last status and durations; the newest five runs are cut before the shuffle.
    """
    known, g = F.col("duration_ms") > 0, health.status_group(F.col("status"))
    stats = _timed(runs).groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(g == "succeeded").alias("succeeded"), F.count_if(g == "failed").alias("failed"),
        F.max_by(F.upper("status"), F.struct(*NEWEST)).alias("last_status"),
        F.coalesce(health.half_up(F.avg(F.when(known, F.col("duration_ms")))), F.lit(0)).alias("avg_ms"),
        F.coalesce(F.max_by("duration_ms", F.when(known, F.struct(*NEWEST))), F.lit(0)).alias("last_ms"),
    )
    joined = with_trend(stats).join(failures_in_last(runs, key), key, "left")
    enabled = F.lit(True)
    if jobs is not None:
        joined, enabled = joined.join(jobs.select(key, "enabled"), key, "left"), F.coalesce("enabled", F.lit(True))
    critical = (
        (F.col("last_status") == "FAILED")
        | ((F.col("succeeded") * 100 / F.col("total") < 50) & (F.col("total") >= 3))
        | (~enabled & (F.col("failed") > 0))
    )
    unstable = (F.col("recent_failures") >= 2) | ((F.col("trend") == "slower") & (F.col("variation_pct") > 100))
    level = F.when(critical, F.lit("critical")).when(unstable, F.lit("unstable")).otherwise(F.lit("stable"))
    return joined.select(key, "total", "succeeded", "failed", "last_status", "recent_failures", "variation_pct", level.alias("risk"))


def duration_baseline(runs: DataFrame, key: str) -> DataFrame:
    """Exact p50, p95 and p99 (nearest rank) of positive durations in milliseconds."""
    ms = runs.select(key, duration_ms().alias("ms")).filter("ms > 0")
    return nearest_rank_percentiles(ms, [key], "ms", {"p50_ms": 50, "p95_ms": 95, "p99_ms": 99}, width=60_000)


def near_misses(runs: DataFrame, key: str, buffer_percent: float = 10, baseline: DataFrame | None = None) -> DataFrame:
    """Runs far above their baseline, which is computed from the runs or given (key, p95_ms, sample_size)."""
    timed = runs.withColumn("duration_ms", duration_ms())
    base = (duration_baseline(runs, key) if baseline is None else baseline).select(key, "p95_ms", "sample_size")
    return lookup(timed, base, [key]).withColumn(
        "near_miss", health.near_miss(F.col("duration_ms"), F.col("p95_ms"), F.col("sample_size"), buffer_percent)
    )


def error_groups(runs: DataFrame, frames: str | None = None) -> DataFrame:
    """Failures that differ only in variable parts, grouped by signature."""
    sig = health.error_signature(F.col("error_class"), F.col("error_message"), F.col(frames) if frames else None)
    return runs.filter(F.col("status") == "FAILED").groupBy(sig.alias("signature")).agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_distinct("dataset_id").alias("datasets"),
        F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"), F.min("error_message").alias("sample_message"),
    )


def guardrail_report(runs: DataFrame, config: DataFrame, key: str, mode: str = "monitor", enabled: bool = True) -> DataFrame:
    """Runs checked against their job's guardrails.

    runs also needs records_written, dq_fail_count, watermark_before and watermark_after; config needs the
    key and watermark_required, volume_min, volume_max, dq_required, silent_failure_check.
    """
    names = ("watermark_required", "volume_min", "volume_max", "dq_required", "silent_failure_check")
    joined = lookup(runs, config.select(key, *names), [key], "inner")
    checks = health.guardrail_checks(
        *[F.col(c) for c in ("status", "records_written", "dq_fail_count", "watermark_before", "watermark_after", *names)]
    )
    final, attention = health.guarded_status(F.col("status"), checks, mode, enabled)
    shown = {f"check_{k}": v for k, v in checks.items()} if enabled else {}
    return joined.withColumns({**shown, "final_status": final, "needs_attention": attention})


def checks_long(report: DataFrame) -> DataFrame:
    """One row per run and check."""
    names = ("watermark", "volume", "dq", "silent_failure")
    return report.unpivot(["run_id"], [F.col(f"check_{n}").alias(n) for n in names], "check_name", "check_status")


def attention_board(runs: DataFrame, n: int | None = None) -> DataFrame:
    """Runs by attention score; needs needs_attention, near_miss_percent and tier."""
    scored = runs.withColumn(
        "priority_score", health.attention_score(F.col("needs_attention"), F.col("near_miss_percent"), F.col("tier"))
    )
    return scored if n is None else scored.orderBy(F.desc("priority_score"), F.col("run_id")).limit(n)
