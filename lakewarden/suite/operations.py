"""Checked queries: run log, queue, jobs, registry, health rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import health
from ..operators import keyed
from ..plans import business, daily, jobs, queue, registry, runs
from . import query
from .tables import Tables

AS_OF = "2001-03-01 00:00:00"
TODAY = "2001-02-28 00:00:00"
DUR = "date_sub('second', started_at, finished_at)"
MS = "date_sub('millisecond', started_at, finished_at)"

# --- filters ------------------------------------------------------------------------------------


@query(
    "search_any_case",
    """select dataset_id, dataset_name from datasets where lower(dataset_name) like '%er_00000001%' or lower(bronze_table) like '%er_00000001%'
       or lower(silver_table) like '%er_00000001%' or lower(source_type) like '%er_00000001%' or lower(project_id) like '%er_00000001%' or lower(area_id) like '%er_00000001%'""",
)
def search_any_case(t: Tables):
    return registry.search(t.datasets, "ER_00000001").select("dataset_id", "dataset_name")


@query(
    "period_filter",
    " union all ".join(
        f"select '{p}' as period, count(*) as n from runs where started_at >= TS'{AS_OF}' - SECS[{s}]"
        for p, s in (("24h", 86400), ("7d", 7 * 86400), ("30d", 30 * 86400))
    )
    + " union all select 'range', count(*) from runs where started_at between TS'2000-01-01 00:00:00' and TS'2000-01-31 23:59:59'",
)
def period_filter(t: Tables):
    r, n = t.runs, F.count(F.lit(1)).alias("n")
    parts = [(p, runs.in_period(r, "started_at", AS_OF, p)) for p in runs.PERIODS]
    parts.append(("range", runs.between_days(r, "started_at", "2000-01-01", "2000-01-31")))
    out = None
    for name, df in parts:
        one = df.agg(n).select(F.lit(name).alias("period"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "load_type_filter",
    """select dataset_id, 'FULL' as kind from datasets where enable_incremental = false or enable_incremental is null
       union all select dataset_id, 'INCREMENTAL' from datasets where enable_incremental and coalesce(incremental_strategy, '') <> 'SNAPSHOT'
       union all select dataset_id, 'SNAPSHOT' from datasets where incremental_strategy = 'SNAPSHOT'""",
)
def load_type_filter(t: Tables):
    d = t.datasets
    pick = lambda k: registry.by_load_type(d, k).select("dataset_id", F.lit(k).alias("kind"))
    return pick("FULL").unionByName(pick("INCREMENTAL")).unionByName(pick("SNAPSHOT"))


@query("has_watermark_filter", """select dataset_id, coalesce(incremental_metadata like '%watermark_column%', false) as has_watermark from datasets""")
def has_watermark_filter(t: Tables):
    d = t.datasets
    pick = lambda w: registry.has_watermark(d, w).select("dataset_id", F.lit(w).alias("has_watermark"))
    return pick(True).unionByName(pick(False))


@query(
    "stale_datasets",
    f"""select d.dataset_id, l.last_success_at from datasets d
        left join (select dataset_id, max(case when status = 'SUCCEEDED' then finished_at end) as last_success_at from runs group by dataset_id) l
        on l.dataset_id = d.dataset_id where coalesce(l.last_success_at, d.created_at) < TS'{AS_OF}' - SECS[31536000]""",
)
def stale_datasets(t: Tables):
    return registry.stale(runs.with_last_success(t.datasets, t.runs), AS_OF, 365).select("dataset_id", "last_success_at")


@query("eligible_items", f"select queue_id from queue where status = 'PENDING' and (next_retry_at is null or next_retry_at <= TS'{AS_OF}')")
def eligible_items(t: Tables):
    return queue.eligible(t.queue, AS_OF).select("queue_id")


@query(
    "stuck_work",
    f"""select queue_id, case when status = 'CLAIMED' then 'CLAIM_TIMEOUT' else 'TIMEOUT' end as stuck_kind from queue
        where (status in ('RUNNING', 'PENDING') and started_at is not null and finished_at is null and started_at < TS'{AS_OF}' - SECS[7200])
           or (status = 'CLAIMED' and claimed_at < TS'{AS_OF}' - SECS[1800])""",
)
def stuck_work(t: Tables):
    return queue.stuck(t.queue, AS_OF).select("queue_id", "stuck_kind")


@query("pending_backlog", f"select queue_id, requested_at from queue where status = 'PENDING' and requested_at < TS'{AS_OF}' - SECS[3600]")
def pending_backlog(t: Tables):
    return queue.backlog(t.queue, AS_OF).select("queue_id", "requested_at")


@query(
    "stale_watermarks",
    f"""select dataset_id, cast(floor(date_sub('second', last_updated_at, TS'{AS_OF}') / 3600) as bigint) as stale_hours from watermarks
        where date_sub('second', last_updated_at, TS'{AS_OF}') > 48 * 3600""",
)
def stale_watermarks(t: Tables):
    return registry.stale_watermarks(t.watermarks, AS_OF).select("dataset_id", "stale_hours")


# --- joins --------------------------------------------------------------------------------------


@query(
    "runs_with_context",
    f"""select r.run_id, r.dataset_id, d.dataset_name, d.incremental_strategy, {DUR.replace('started_at', 'r.started_at').replace('finished_at', 'r.finished_at')} as duration_seconds,
          l.inserted_count as bronze_inserted_count, l.updated_count as bronze_updated_count, l.operation as bronze_operation
        from runs r left join datasets d on d.dataset_id = r.dataset_id left join layers l on l.run_id = r.run_id and l.layer = 'BRONZE'""",
)
def runs_with_context(t: Tables):
    return runs.with_context(t.runs, t.datasets, t.layers).select(
        "run_id", "dataset_id", "dataset_name", "incremental_strategy", "duration_seconds", "bronze_inserted_count",
        "bronze_updated_count", "bronze_operation",
    )


@query(
    "queue_with_dataset",
    """select q.queue_id, q.status, d.dataset_name, d.source_type, d.execution_state, d.bronze_table, d.silver_table
       from queue q left join datasets d on d.dataset_id = q.dataset_id""",
)
def queue_with_dataset(t: Tables):
    return queue.with_dataset(t.queue, t.datasets).select(
        "queue_id", "status", "dataset_name", "source_type", "execution_state", "bronze_table", "silver_table"
    )


@query(
    "pending_approvals",
    """select d.dataset_id, d.dataset_name, d.execution_state, p.schema_version as pending_version, a.schema_version as active_version,
         p.expect_schema_json is not null and a.expect_schema_json is not null as both_known
       from datasets d join versions p on p.dataset_id = d.dataset_id and p.status = 'PENDING'
       left join versions a on a.dataset_id = d.dataset_id and a.status = 'ACTIVE'""",
)
def pending_approvals(t: Tables):
    out = registry.pending_approvals(t.datasets, t.versions)
    return out.select(
        "dataset_id", "dataset_name", "execution_state", "pending_version", "active_version",
        (F.col("pending_fingerprint").isNotNull() & F.col("active_fingerprint").isNotNull()).alias("both_known"),
    )


@query(
    "dataset_activity",
    f"""select d.dataset_id, d.dataset_name, count(r.run_id) as executions, count(case when r.load_type = 'INCREMENTAL' then 1 end) as incremental_executions
        from datasets d left join runs r on r.dataset_id = d.dataset_id and r.started_at >= TS'{AS_OF}' - SECS[7776000] group by 1, 2""",
)
def dataset_activity(t: Tables):
    return runs.activity(t.datasets, t.runs, AS_OF, 90)


@query(
    "dataset_last_success",
    """select d.dataset_id, d.execution_state, l.last_success_at from datasets d left join (
         select dataset_id, max(case when status = 'SUCCEEDED' then finished_at end) as last_success_at from runs group by dataset_id) l on l.dataset_id = d.dataset_id""",
)
def dataset_last_success(t: Tables):
    return runs.with_last_success(t.datasets, t.runs).select("dataset_id", "execution_state", "last_success_at")


BAND = """select e.execution_id, q.queue_id, q.status as item_status from executions e join queue q on q.correlation_id = e.job_id
          and q.requested_at between e.started_at - SECS[30] and e.started_at + SECS[30]"""


@query("requested_with_execution", BAND)
def requested_with_execution(t: Tables):
    return jobs.requested_with(t.executions, t.queue).select("execution_id", "queue_id", "item_status")


@query(
    "finished_within_execution",
    """select e.execution_id, q.status as item_status, count(*) as n from executions e join queue q on q.correlation_id = e.job_id
       and q.finished_at between e.started_at and e.finished_at + SECS[60] group by 1, 2""",
)
def finished_within_execution(t: Tables):
    hit = jobs.finished_within(t.executions, t.queue)
    return hit.groupBy("execution_id", "item_status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "replay_sets",
    f"""with jd as (select job_id, dataset_id from job_datasets where enabled),
        ok as (select distinct correlation_id as job_id, dataset_id from queue where status = 'SUCCEEDED' and finished_at >= TS'{TODAY}'),
        ko as (select distinct correlation_id as job_id, dataset_id from queue where status = 'FAILED' and finished_at >= TS'{TODAY}')
        select 'REMAINING_TODAY' as mode, jd.* from jd where not exists (select 1 from ok where ok.job_id = jd.job_id and ok.dataset_id = jd.dataset_id)
        union all select 'FAILED_ONLY', jd.* from jd where exists (select 1 from ko where ko.job_id = jd.job_id and ko.dataset_id = jd.dataset_id)
        union all select 'SELECTED', jd.* from jd where dataset_id in (select dataset_id from datasets where area_id = 'BUILDING')
        union all select 'ALL', jd.* from jd""",
)
def replay_sets(t: Tables):
    out, picked = None, t.datasets.filter("area_id = 'BUILDING'")
    for mode in ("REMAINING_TODAY", "FAILED_ONLY", "SELECTED", "ALL"):
        one = jobs.replay_set(t.job_datasets, t.queue, TODAY, mode, picked).select(F.lit(mode).alias("mode"), "job_id", "dataset_id")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "failed_with_dataset",
    """select r.run_id, r.dataset_id, d.dataset_name, r.status, r.error_class, substring(r.error_message, 1, 500) as error_preview, r.started_at, r.finished_at
       from runs r join datasets d on d.dataset_id = r.dataset_id where r.status = 'FAILED' and d.source_type = 'ORACLE'""",
)
def failed_with_dataset(t: Tables):
    return runs.failed_with_dataset(t.runs, t.datasets, "ORACLE")


@query(
    "open_items_with_dataset",
    """select q.queue_id, d.dataset_name, q.status, substring(q.last_error_message, 1, 200) as error_preview from queue q join datasets d on d.dataset_id = q.dataset_id
       where d.source_type = 'ORACLE' and q.status in ('PENDING', 'FAILED', 'CLAIMED', 'RUNNING')""",
)
def open_items_with_dataset(t: Tables):
    return queue.open_with_dataset(t.queue, t.datasets, "ORACLE").select("queue_id", "dataset_name", "status", "error_preview")


@query(
    "business_star",
    """select c.c_custkey, c.c_name, n.n_name, r.r_name, max(o.o_orderdate) as last_order, max(l.l_shipdate) as last_shipment
       from @customer c left join @nation n on n.n_nationkey = c.c_nationkey left join @region r on r.r_regionkey = n.n_regionkey
       left join @orders o on o.o_custkey = c.c_custkey left join @lineitem l on l.l_orderkey = o.o_orderkey
       where c.c_acctbal > 0 and c.c_mktsegment <> 'MACHINERY' group by 1, 2, 3, 4""",
)
def business_star(t: Tables):
    """The order side is reduced to one row per customer before it meets the dimensions."""
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    per_customer = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate").join(shipped, "o_orderkey", "left").groupBy("c_custkey").agg(
        F.max("o_orderdate").alias("ordered"), F.max("shipped").alias("shipped")
    )
    base = t.customer.withColumnRenamed("c_nationkey", "n_nationkey")
    region = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    return business.star(
        base, [(t.nation, ["n_nationkey"]), (region, ["n_regionkey"]), (per_customer, ["c_custkey"])],
        (F.col("c_acctbal") > 0) & (F.col("c_mktsegment") != "MACHINERY"), ["c_custkey", "c_name", "n_name", "r_name"],
        {"last_order": "ordered", "last_shipment": "shipped"},
    )


# --- aggregations -------------------------------------------------------------------------------


@query("status_counts", "select status, count(*) as n from queue group by status")
def status_counts(t: Tables):
    return runs.count_by(t.queue, "status")


@query("result_summary", "select error_class, count(*) as n from runs group by error_class")
def result_summary(t: Tables):
    return runs.count_by(t.runs, "error_class")


@query(
    "queue_counters",
    f"""select count(*) as total_items, count(*) filter (status = 'PENDING') as pending_count, count(*) filter (status = 'CLAIMED') as claimed_count,
          count(*) filter (status = 'RUNNING') as running_count, count(*) filter (status = 'FAILED') as failed_count,
          count(*) filter (status = 'SUCCEEDED') as succeeded_count,
          count(*) filter (status = 'CLAIMED' and claimed_at < TS'{AS_OF}' - SECS[1800]) as stale_claimed_count from queue""",
)
def queue_counters(t: Tables):
    return queue.counters(t.queue, AS_OF)


@query(
    "kpis_24h",
    f"""select *, case when total > 0 then floor(success * 1000.0 / total + 0.5) / 10.0 else 0.0 end as success_rate from (
         select count(*) as total, count(*) filter (status = 'SUCCEEDED') as success, count(*) filter (status = 'FAILED') as failed,
           round(avg(case when status = 'SUCCEEDED' and finished_at is not null then cast({DUR} as double) end), 0) as avg_duration_sec
         from runs where started_at >= TS'{AS_OF}' - SECS[86400]) s""",
)
def kpis_24h(t: Tables):
    return runs.kpis(t.runs, AS_OF)


QUANT = """select cast(quantile_disc(date_sub('millisecond', requested_at, claimed_at), 0.5) as bigint) as p50_to_claim_ms,
  cast(quantile_disc(date_sub('millisecond', requested_at, claimed_at), 0.95) as bigint) as p95_to_claim_ms,
  cast(quantile_disc(date_sub('millisecond', claimed_at, started_at), 0.5) as bigint) as p50_to_running_ms,
  cast(quantile_disc(date_sub('millisecond', claimed_at, started_at), 0.95) as bigint) as p95_to_running_ms from queue"""


@query("claim_latency_exact", QUANT)
def claim_latency_exact(t: Tables):
    return queue.latency(t.queue, exact=True)


@query("claim_latency_sketch", "select 'p50_to_claim_ms' as measure, true as within union all select 'p95_to_claim_ms', true union all select 'p50_to_running_ms', true union all select 'p95_to_running_ms', true")
def claim_latency_sketch(t: Tables):
    """The sketch used at scale: each percentile lies between the exact ones a hundredth of the ranks lower and higher."""
    guess = queue.latency(t.queue)
    waits = queue.wait_times(t.queue).unpivot([], list(queue.WAITS), "wait", "ms")
    ranks = {f"{side}{p}": p + off for p in (50, 95) for side, off in (("lo", -1), ("hi", 1))}
    exact = keyed.nearest_rank_percentiles(waits, ["wait"], "ms", ranks, width=1000)
    long = guess.unpivot([], guess.columns, "measure", "ms")
    long = long.withColumns({"wait": F.substring("measure", 5, 100), "p": F.substring("measure", 2, 2)})
    low, high = (F.when(F.col("p") == "50", F.col(f"{side}50")).otherwise(F.col(f"{side}95")) for side in ("lo", "hi"))
    return long.join(exact, "wait").select("measure", F.col("ms").between(low, high).alias("within"))


def _stored(t: Tables, rows, keys: list[str], at: str, value: str):
    """Daily sketches written to a table and read back."""
    import uuid

    table = f"lakewarden_sketches_{uuid.uuid4().hex}"
    daily.store(daily.sketches(rows, keys, at, value), table, f"{t.scratch}/tables")
    return t.spark.table(table)


@query("claim_latency_days", "select 'to_claim_ms' as wait, true as p50_within, true as p95_within, count(*) filter (requested_at is not null and claimed_at is not null) as sample_size from queue union all select 'to_running_ms', true, true, count(*) filter (requested_at is not null and claimed_at is not null and started_at is not null) from queue")
def claim_latency_days(t: Tables):
    """Latency from stored days: each percentile lies between the exact ones its stated error in ranks lower and higher."""
    waits = queue.wait_times(t.queue).unpivot(["requested_at"], list(queue.WAITS), "wait", "ms")
    guess = daily.percentiles(daily.merged(_stored(t, waits, ["wait"], "requested_at", "ms"), ["wait"]), ["wait"], {"p50": 50, "p95": 95})
    off = 100 * daily.RANK_ERROR * 2
    exact = keyed.nearest_rank_percentiles(waits.select("wait", "ms"), ["wait"], "ms", {f"{side}{p}": p + s * off for p in (50, 95) for side, s in (("lo", -1), ("hi", 1))}, width=1000)
    within = [F.col(f"p{p}").between(F.col(f"lo{p}"), F.col(f"hi{p}")).alias(f"p{p}_within") for p in (50, 95)]
    return guess.join(exact.drop("sample_size"), "wait").select("wait", *within, "sample_size")


@query(
    "transition_timeline",
    """select date_trunc('minute', created_at) as ts_min, count(*) filter (new_status = 'CLAIMED') as claims, count(*) filter (new_status = 'RUNNING') as starts,
         count(*) filter (new_status in ('SUCCEEDED', 'FAILED', 'CANCELLED')) as ends from transitions group by 1""",
)
def transition_timeline(t: Tables):
    return queue.timeline(t.transitions)


@query(
    "load_type_stats",
    f"""select load_type, count(*) as n, count(distinct dataset_id) as datasets, round(avg(cast(row_count as double)), 4) as avg_rows,
          min(started_at) as first_occurrence, max(started_at) as last_occurrence from runs where started_at >= TS'{AS_OF}' - SECS[604800] group by load_type""",
)
def load_type_stats(t: Tables):
    return runs.load_type_stats(t.runs, AS_OF, 7)


@query("rows_per_layer", f"select layer, cast(sum(row_count) as bigint) as rows from layers where started_at >= TS'2000-01-01 00:00:00' group by layer")
def rows_per_layer(t: Tables):
    return runs.rows_by(t.layers, "layer", "2000-01-01 00:00:00")


@query("rows_per_dataset", "select dataset_id, cast(sum(row_count) as bigint) as rows from layers group by dataset_id")
def rows_per_dataset(t: Tables):
    return runs.rows_by(t.layers, "dataset_id")


def _ranked(p: int) -> str:
    return f"min(case when rn >= greatest(1, ceil({p} / 100.0 * n)) then ms end)"


BASE = f"""(select job_id, {_ranked(50)} as p50_ms, {_ranked(95)} as p95_ms, {_ranked(99)} as p99_ms, max(n) as sample_size from (
   select job_id, ms, row_number() over (partition by job_id order by ms) as rn, count(*) over (partition by job_id) as n
   from (select job_id, {MS} as ms from runs) a where ms > 0) b group by job_id)"""


@query("duration_baseline", f"select * from {BASE} s")
def duration_baseline(t: Tables):
    return runs.duration_baseline(t.runs, "job_id")


@query(
    "status_distribution",
    """select job_id, count(*) filter (status in ('SUCCESS', 'SUCCEEDED')) as succeeded, count(*) filter (status = 'FAILED') as failed,
         count(*) filter (status in ('RUNNING', 'PENDING', 'CLAIMED')) as running, count(*) filter (status = 'CANCELLED') as other, count(*) as total
       from (select correlation_id as job_id, status from queue) q group by job_id""",
)
def status_distribution(t: Tables):
    return runs.status_distribution(t.queue.withColumnRenamed("correlation_id", "job_id"), "job_id")


VARIANCE = f"""(select *, case when abs(variation_pct) < 15 then 'stable' when variation_pct > 0 then 'slower' else 'faster' end as trend from (
   select *, case when avg_ms > 0 then cast(floor((last_ms - avg_ms) * 100.0 / avg_ms + 0.5) as bigint) else 0 end as variation_pct from (
     select KEY, cast(coalesce(floor(avg(case when ms > 0 then ms end) + 0.5), 0) as bigint) as avg_ms,
       coalesce(max(case when rk = 1 and ms > 0 then ms end), 0) as last_ms from (
         select *, row_number() over (partition by KEY, ms > 0 order by started_at desc, run_id desc) as rk from (select *, coalesce({MS}, 0) as ms from runs) a) b
     group by KEY) c) d)"""


@query("duration_variance", f"select * from {VARIANCE.replace('KEY', 'dataset_id')} v")
def duration_variance(t: Tables):
    return runs.duration_variance(t.runs, "dataset_id")


@query("job_success_rate", """select job_id, count(*) as total, cast(floor(count(*) filter (status = 'SUCCEEDED') * 100.0 / count(*) + 0.5) as bigint) as success_rate
  from runs group by job_id""")
def job_success_rate(t: Tables):
    return runs.success_rate(t.runs, "job_id")


COUNTED = f"""(select e.execution_id, e.job_id, e.datasets_total, count(*) filter (b.item_status = 'SUCCEEDED') as succeeded, count(*) filter (b.item_status = 'FAILED') as failed,
   count(*) filter (b.item_status = 'PENDING') as pending, count(*) filter (b.item_status in ('RUNNING', 'CLAIMED')) as running
   from executions e left join ({BAND}) b on b.execution_id = e.execution_id group by 1, 2, 3)"""


@query(
    "execution_outcomes",
    f"""select *, case when items = 0 then 'NO_ITEMS' when pending > 0 or running > 0 then 'RUNNING' when failed > 0 then 'FAILED'
          when succeeded < case when datasets_total > 0 then datasets_total else items end then 'PARTIAL' else 'SUCCEEDED' end as outcome
        from (select *, succeeded + failed + pending + running as items from {COUNTED} c) d""",
)
def execution_outcomes(t: Tables):
    return jobs.outcomes(t.executions, t.queue)


@query(
    "execution_progress",
    f"""select execution_id, expected, cast(floor((succeeded + failed) * 100.0 / expected + 0.5) as bigint) as progress_pct
        from (select *, case when datasets_total > 0 then datasets_total else succeeded + failed + pending + running end as expected from {COUNTED} c) d""",
)
def execution_progress(t: Tables):
    return jobs.progress(t.executions, t.queue).select("execution_id", "expected", "progress_pct")


@query("job_dataset_counts", "select job_id, count(*) as dataset_count from job_datasets where enabled group by job_id")
def job_dataset_counts(t: Tables):
    return jobs.dataset_counts(t.job_datasets)


# --- windows ------------------------------------------------------------------------------------


@query("latest_run", "select dataset_id, run_id, status from (select *, row_number() over (partition by dataset_id order by started_at desc, run_id desc) as rn from runs) r where rn = 1")
def latest_run(t: Tables):
    return runs.latest_run(t.runs).select("dataset_id", "run_id", "status")


@query("latest_execution", "select job_id, execution_id from (select *, row_number() over (partition by job_id order by started_at desc, execution_id desc) as rn from executions) r where rn = 1")
def latest_execution(t: Tables):
    return jobs.latest_execution(t.executions).select("job_id", "execution_id")


PREV = f"""(select r.*, {DUR} as seconds, last(case when status = 'SUCCEEDED' then run_id end ignore nulls) over w as prev_run_id,
   last(case when status = 'SUCCEEDED' then row_count end ignore nulls) over w as prev_row_count,
   last(case when status = 'SUCCEEDED' then {DUR} end ignore nulls) over w as prev_seconds
   from runs r window w as (partition by KEY order by started_at, run_id rows between unbounded preceding and 1 preceding))"""


@query("previous_success", f"select run_id, dataset_id, seconds, prev_run_id, prev_row_count, prev_seconds from {PREV.replace('KEY', 'dataset_id')} p")
def previous_success(t: Tables):
    return runs.previous_success(t.runs).select("run_id", "dataset_id", "seconds", "prev_run_id", "prev_row_count", "prev_seconds")


@query("recent_job_failures", "select job_id, count(*) filter (status = 'FAILED') as recent_failures from (select *, row_number() over (partition by job_id order by started_at desc, run_id desc) as rn from runs) r where rn <= 5 group by job_id")
def recent_job_failures(t: Tables):
    return runs.failures_in_last(t.runs, "job_id")


@query(
    "job_sparkline",
    f"""select job_id, run_id, mx - rn + 1 as point, case status when 'SUCCEEDED' then 'success' when 'FAILED' then 'failure' else 'running' end as point_status,
          ms as duration_ms, round(greatest(0.08, ms / greatest(mm, 1)), 6) as height
        from (select *, max(rn) over (partition by job_id) as mx, max(ms) over (partition by job_id) as mm from (
          select *, coalesce({MS}, 0) as ms, row_number() over (partition by job_id order by started_at desc, run_id desc) as rn from runs) a where rn <= 10) b""",
)
def job_sparkline(t: Tables):
    return runs.sparkline(t.runs, "job_id")


@query(
    "volume_change",
    """select run_id, change_pct, case when change_pct is null then 'FIRST_RUN' when change_pct > 0 then '+' || cast(change_pct as varchar) || '%' else cast(change_pct as varchar) || '%' end as change_label,
         case when change_pct is null or abs(change_pct) <= 5 then 'normal' when abs(change_pct) <= 20 then 'warning' else 'critical' end as severity
       from (select run_id, case when p is not null and p <> 0 then cast(floor((row_count - p) * 100.0 / p + 0.5) as bigint) end as change_pct
         from (select run_id, row_count, lag(row_count) over (partition by job_id order by started_at, run_id) as p from runs) a) b""",
)
def volume_change(t: Tables):
    return runs.volume_change(t.runs, "job_id").select("run_id", "change_pct", "change_label", "severity")


@query(
    "duplicate_names",
    """select p_partkey, first_index, p_partkey > first_index as is_duplicate from (
         select p_partkey, min(p_partkey) over (partition by upper(trim(p_name))) as first_index from @part) s""",
)
def duplicate_names(t: Tables):
    return registry.mark_duplicates(t.part.select("p_partkey", "p_name"), "p_partkey", "p_name").select("p_partkey", "first_index", "is_duplicate")


# --- order and limit ----------------------------------------------------------------------------


@query("registry_page", "select dataset_id, dataset_name, updated_at from datasets order by updated_at desc nulls last, dataset_id limit 25 offset 50")
def registry_page(t: Tables):
    return registry.page(t.datasets, "updated_at", True, 3, 25).select("dataset_id", "dataset_name", "updated_at")


@query("registry_page_count", "select count(*) as total, cast(greatest(1, ceil(count(*) / 25.0)) as bigint) as total_pages from datasets")
def registry_page_count(t: Tables):
    return registry.page_count(t.datasets, 25)


@query("recent_failures", "select run_id, coalesce(finished_at, started_at) as ended_at, error_class from runs where status = 'FAILED' order by ended_at desc nulls last, run_id limit 50")
def recent_failures(t: Tables):
    return runs.recent_failures(t.runs).select("run_id", "ended_at", "error_class")


@query("next_to_run", f"""select queue_id, priority, requested_at from queue where status = 'PENDING' and (next_retry_at is null or next_retry_at <= TS'{AS_OF}')
   order by priority, requested_at, queue_id limit 20""")
def next_to_run(t: Tables):
    return queue.next_to_run(t.queue, AS_OF, 20).select("queue_id", "priority", "requested_at")


@query("attention_board", f"""select run_id, case when status = 'FAILED' then 100 else 0 end + cast(row_count % 100 as bigint) + 10 * cast(4 - priority as bigint) as priority_score
   from (select run_id, status, row_count, cast(row_count % 4 as bigint) as priority from runs) r order by priority_score desc, run_id limit 100""")
def attention_board(t: Tables):
    r = t.runs.withColumns(
        {
            "needs_attention": F.col("status") == "FAILED", "near_miss_percent": F.col("row_count") % 100,
            "tier": F.concat(F.lit("T"), (F.col("row_count") % 4).cast("string")),
        }
    )
    return runs.attention_board(r, 100).select("run_id", "priority_score")


@query("oldest_claims", f"""select queue_id, claimed_at, date_sub('second', claimed_at, TS'{AS_OF}') as claim_age_seconds from queue
   where status = 'CLAIMED' and claimed_at is not null order by claimed_at, queue_id limit 100""")
def oldest_claims(t: Tables):
    return queue.oldest_claims(t.queue, AS_OF).select("queue_id", "claimed_at", "claim_age_seconds")


@query("oldest_pending", f"""select queue_id, requested_at from queue where status = 'PENDING' and (next_retry_at is null or next_retry_at <= TS'{AS_OF}')
   order by requested_at, queue_id limit 10""")
def oldest_pending(t: Tables):
    return queue.oldest_pending(t.queue, AS_OF).select("queue_id", "requested_at")


@query("queue_activity", f"""select *, running > 0 or coalesce(last_finished_at > TS'{AS_OF}' - SECS[300], false) as likely_active,
   pending > 0 and not (running > 0 or coalesce(last_finished_at > TS'{AS_OF}' - SECS[300], false)) as warning from (
   select count(*) filter (status = 'PENDING' and (next_retry_at is null or next_retry_at <= TS'{AS_OF}')) as pending,
     count(*) filter (status in ('CLAIMED', 'RUNNING')) as running, max(case when status in ('SUCCEEDED', 'FAILED') then finished_at end) as last_finished_at from queue) s""")
def queue_activity(t: Tables):
    return queue.activity(t.queue, AS_OF)


@query("recently_finished", "select queue_id, finished_at from queue where status in ('SUCCEEDED', 'FAILED') and finished_at is not null order by finished_at desc, queue_id limit 5")
def recently_finished(t: Tables):
    return queue.recently_finished(t.queue).select("queue_id", "finished_at")


# --- sets ---------------------------------------------------------------------------------------


@query("union_distinct", "select c_nationkey as nation from @customer union select s_nationkey from @supplier")
def union_distinct(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey")).distinct()


@query("intersect_sets", "select o_custkey as k from @orders where o_orderstatus = 'F' intersect select o_custkey from @orders where o_orderstatus = 'P'")
def intersect_sets(t: Tables):
    pick = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return pick("F").intersect(pick("P"))


@query("except_sets", "select c_custkey as k from @customer except select o_custkey from @orders where o_orderstatus = 'F'")
def except_sets(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.filter("o_orderstatus = 'F'").select("o_custkey"))


# --- health -------------------------------------------------------------------------------------

MASK = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\d{{4}}-\d{{2}}-\d{{2}}t\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?z?', '<ts>', 'g'), '[a-f0-9]{{8,}}', '<hex>', 'g'), '\d+', '<num>', 'g'), '\s+', ' ', 'g'))"
SIG = "'sig_' || md5({0} || '|' || {1} || '|')".format(
    MASK.format("coalesce(nullif(error_class, ''), 'unknown_code')"), MASK.format("coalesce(nullif(error_message, ''), 'unknown_message')")
)


@query(
    "error_groups",
    f"""select {SIG} as signature, count(*) as occurrences, count(distinct dataset_id) as datasets, min(started_at) as first_seen, max(started_at) as last_seen,
          min(error_message) as sample_message from runs where status = 'FAILED' group by 1""",
)
def error_groups(t: Tables):
    return runs.error_groups(t.runs)


@query(
    "error_categories",
    """select run_id, case when m = '' and c = '' then null
          when contains(m, 'timeout') or contains(c, 'timeout') then 'timeout' when contains(m, 'connect') or contains(c, 'connection') then 'connection'
          when contains(m, 'schema') or contains(m, 'column') or contains(c, 'schema') then 'schema'
          when contains(m, 'permission') or contains(m, 'access') or contains(c, 'auth') then 'permission'
          when contains(m, 'memory') or contains(m, 'oom') or contains(c, 'resource') then 'resource'
          when contains(m, 'duplicate') or contains(m, 'unique') or contains(m, 'constraint') then 'duplicate' else 'other' end as category
       from (select run_id, lower(coalesce(error_message, '')) as m, lower(coalesce(error_class, '')) as c from runs) s""",
)
def error_categories(t: Tables):
    return t.runs.select("run_id", health.error_category(F.col("error_message"), F.col("error_class")).alias("category"))


@query(
    "human_errors",
    """select human, count(*) as n from (select case
          when c = 'SCHEMA_ERROR' and (contains(lower(m), 'drift') or contains(lower(m), 'schema')) then 'SCHEMA_CHANGE_BLOCKED'
          when c = 'SCHEMA_ERROR' and (contains(lower(m), 'cast_invalid_input') or contains(lower(m), 'invalid input')) then 'CAST_FAILURE'
          when c = 'SCHEMA_ERROR' then 'CONTRACT_FAILURE' when c = 'SOURCE_ERROR' then 'SOURCE_READ_FAILURE' when c = 'RUNTIME_ERROR' then 'EXECUTION_FAILURE'
          when m <> '' then m else 'UNKNOWN_ERROR' end as human
        from (select upper(coalesce(error_class, '')) as c, trim(coalesce(error_message, '')) as m from runs) s) u group by human""",
)
def human_errors(t: Tables):
    human = health.human_error(F.col("error_class"), F.col("error_message")).alias("human")
    return t.runs.select(human).groupBy("human").agg(F.count(F.lit(1)).alias("n"))


@query(
    "failure_speed",
    f"""select run_id, case when coalesce({MS}, 0) = 0 then null when {MS} / 1000.0 < 10 then 'immediate' when {MS} / 1000.0 < 60 then 'fast'
          when {MS} / 1000.0 > 600 then 'late' end as speed from runs where status = 'FAILED'""",
)
def failure_speed(t: Tables):
    return t.runs.filter("status = 'FAILED'").select("run_id", health.failure_speed(runs.duration_ms()).alias("speed"))


GUARD = """(select r.*, case when w_ok then 'PASS' else 'FAIL' end as check_watermark, case when v_ok then 'PASS' else 'FAIL' end as check_volume,
   case when d_ok then 'PASS' else 'FAIL' end as check_dq, case when s_ok then 'PASS' else 'FAIL' end as check_silent_failure,
   not (w_ok and v_ok and d_ok and s_ok) as needs_attention from (
     select run_id, job_id, status, cast(job_id as varchar) as j,
       not (k % 2 = 0) or coalesce(wb <> '' and wa <> '' and wb <> wa, false) as w_ok, row_count >= k and row_count <= 4000 as v_ok,
       not (k % 3 = 0) or dq = 0 as d_ok, not (status = 'SUCCEEDED' and row_count = 0) as s_ok
     from (select *, cast(substring(job_id, 5) as bigint) as k, cast(started_at as varchar) as wb, cast(coalesce(finished_at, started_at) as varchar) as wa,
             case when row_count % 11 = 0 then 1 else 0 end as dq from runs) a) r)"""


def _guarded(t: Tables, mode: str):
    k = F.substring("job_id", 5, 10).cast("bigint")
    telemetry = t.runs.withColumns(
        {
            "records_written": F.col("row_count"), "dq_fail_count": F.when(F.col("row_count") % 11 == 0, 1).otherwise(0),
            "watermark_before": F.col("started_at").cast("string"),
            "watermark_after": F.coalesce("finished_at", "started_at").cast("string"),
        }
    )
    config = t.job_datasets.select("job_id").distinct().withColumns(
        {
            "watermark_required": k % 2 == 0, "volume_min": k, "volume_max": F.lit(4000), "dq_required": k % 3 == 0,
            "silent_failure_check": F.lit(True),
        }
    )
    return runs.guardrail_report(telemetry, config, "job_id", mode)


@query(
    "guardrails_enforced",
    f"""select run_id, check_watermark, check_volume, check_dq, check_silent_failure, needs_attention,
          case when needs_attention and status = 'SUCCEEDED' then 'SUCCEEDED_WITH_ISSUES' else status end as final_status from {GUARD} g""",
)
def guardrails_enforced(t: Tables):
    return _guarded(t, "enforce").select(
        "run_id", "check_watermark", "check_volume", "check_dq", "check_silent_failure", "needs_attention", "final_status"
    )


@query(
    "guardrail_checks_monitored",
    " union all ".join(
        f"select run_id, '{c}' as check_name, check_{c} as check_status from {GUARD} g" for c in ("watermark", "volume", "dq", "silent_failure")
    ),
)
def guardrail_checks_monitored(t: Tables):
    return runs.checks_long(_guarded(t, "monitor"))


@query(
    "near_misses",
    f"""select r.run_id, {MS} as duration_ms, b.p95_ms, coalesce(b.sample_size >= 10 and {MS} > b.p95_ms * 1.05, false) as near_miss
        from runs r left join {BASE} b on b.job_id = r.job_id""",
)
def near_misses(t: Tables):
    return runs.near_misses(t.runs, "job_id", 5).select("run_id", "duration_ms", "p95_ms", "near_miss")


@query("duration_baseline_days", f"select * from {BASE} s")
def duration_baseline_days(t: Tables):
    """Exact baselines whose ranks are sought only where the merged days say they lie."""
    return _baseline_days(t)


def _baseline_days(t: Tables):
    timed = t.runs.select("job_id", "started_at", runs.duration_ms().alias("ms")).filter("ms > 0")
    window = daily.merged(_stored(t, timed, ["job_id"], "started_at", "ms"), ["job_id"])
    return daily.exact_percentiles(timed.select("job_id", "ms"), window, ["job_id"], "ms", {"p50_ms": 50, "p95_ms": 95, "p99_ms": 99}, 60_000)


@query(
    "near_misses_days",
    f"""select r.run_id, {MS} as duration_ms, b.p95_ms, coalesce(b.sample_size >= 10 and {MS} > b.p95_ms * 1.05, false) as near_miss
        from runs r left join {BASE} b on b.job_id = r.job_id""",
)
def near_misses_days(t: Tables):
    """Near misses against baselines from stored days."""
    return runs.near_misses(t.runs, "job_id", 5, _baseline_days(t)).select("run_id", "duration_ms", "p95_ms", "near_miss")


STATES = ("PENDING", "RUNNING", "TERMINATING", "TERMINATED", "SKIPPED", "INTERNAL_ERROR", "UNKNOWN")


@query(
    "engine_reconciliation",
    f"""with m as (select queue_id, status as p, cast(substring(queue_id, 3) as bigint) % 7 as k from queue),
        e as (select queue_id, case when k = 5 then 'ORPHANED' else p end as p, case k {' '.join(f"when {i} then '{s}'" for i, s in enumerate(STATES))} end as s from m),
        x as (select *, case s when 'PENDING' then 'QUEUED' when 'RUNNING' then 'RUNNING' when 'TERMINATING' then 'RUNNING' when 'TERMINATED' then 'SUCCEEDED'
              when 'SKIPPED' then 'CANCELLED' when 'INTERNAL_ERROR' then 'FAILED' else 'INCONSISTENT' end as run_status from e)
        select queue_id, run_status, case when run_status = 'INCONSISTENT' then true when p = 'ORPHANED' and run_status in ('RUNNING', 'QUEUED') then false
            when p = 'RUNNING' and run_status = 'SUCCEEDED' then true else run_status <> p and p <> 'SUCCEEDED_WITH_ISSUES' end as inconsistent,
          case when run_status = 'INCONSISTENT' then 'UNKNOWN_ENGINE_STATE' when p = 'ORPHANED' and run_status in ('RUNNING', 'QUEUED') then 'RECONCILED_WITH_ACTIVE_ENGINE'
            when p = 'RUNNING' and run_status = 'SUCCEEDED' then 'LOG_BEHIND_ENGINE' end as reason from x""",
)
def engine_reconciliation(t: Tables):
    k = F.substring("queue_id", 3, 20).cast("bigint") % 7
    engine = F.element_at(F.array(*[F.lit(s) for s in STATES]), (k + 1).cast("int"))
    logged = F.when(k == 5, F.lit("ORPHANED")).otherwise(F.col("status"))
    return t.queue.select("queue_id", health.reconciled_status(engine, logged).alias("r")).select("queue_id", "r.*")


@query("idempotent_items", "select distinct 'ws1|' || job_id || '|' || dataset_id || '|' || cast(row_count % 3 as varchar) as idempotency_key from runs")
def idempotent_items(t: Tables):
    r = t.runs.withColumns({"ws": F.lit("ws1"), "attempt": F.col("row_count") % 3})
    return queue.remove_replays(r, "ws", "job_id", "dataset_id", "attempt").select("idempotency_key")


PCT = "case when prev_row_count is not null and prev_row_count <> 0 then cast(floor((row_count - prev_row_count) * 100.0 / prev_row_count + 0.5) as bigint) end"


@query(
    "run_risk",
    f"""select run_id, change_pct, case when status = 'FAILED' or (status = 'SUCCEEDED' and coalesce(row_count, 0) = 0) or change_pct < -50 then 'high'
          when change_pct < -20 or change_pct > 50 then 'medium' when prev_seconds > 0 and seconds > prev_seconds * 2 then 'low' else 'none' end as risk
        from (select *, {PCT} as change_pct from {PREV.replace('KEY', 'job_id')} p) q""",
)
def run_risk(t: Tables):
    return runs.run_risk(t.runs, "job_id").select("run_id", "change_pct", "risk")


@query(
    "processing_types",
    """select l.run_id, l.layer, case l.operation when 'MERGE' then 'INCREMENTAL_CHANGES' when 'REPLACE_WHERE' then 'INCREMENTAL_WINDOW' when 'APPEND' then 'APPEND_HISTORY'
          when 'OVERWRITE' then 'FULL_REFRESH' end as processing_type,
        case when l.operation = 'OVERWRITE' then 'table replaced' when l.operation = 'MERGE' and ins <= 0 and upd <= 0 then 'no changes'
          when l.operation = 'MERGE' then concat_ws(', ', case when ins > 0 then ins || ' inserted' end, case when upd > 0 then upd || ' updated' end)
          when l.operation = 'APPEND' then l.row_count || ' added to history' when l.operation = 'REPLACE_WHERE' then 'window replaced' end as result_fact
       from (select *, coalesce(inserted_count, 0) as ins, coalesce(updated_count, 0) as upd from layers) l""",
)
def processing_types(t: Tables):
    return t.layers.select(
        "run_id", "layer", health.processing_type(F.col("operation"), F.lit("FULL")).alias("processing_type"),
        health.result_fact(F.col("operation"), F.col("row_count"), F.col("inserted_count"), F.col("updated_count")).alias("result_fact"),
    )


@query(
    "load_type_processing",
    """select run_id, case when load_type = 'INCREMENTAL' then 'INCREMENTAL_CHANGES' else 'FULL_REFRESH' end as processing_type, row_count || ' rows' as result_fact from runs""",
)
def load_type_processing(t: Tables):
    none = F.lit(None).cast("string")
    return t.runs.select(
        "run_id", health.processing_type(none, F.col("load_type")).alias("processing_type"),
        health.result_fact(none, F.col("row_count"), none.cast("bigint"), none.cast("bigint")).alias("result_fact"),
    )


@query(
    "job_risk",
    f"""with d as (select dataset_id, count(*) as total, count(*) filter (status = 'SUCCEEDED') as succeeded, count(*) filter (status = 'FAILED') as failed from runs group by 1),
        l as (select * from (select *, row_number() over (partition by dataset_id order by started_at desc, run_id desc) as rn from runs) r where rn <= 5),
        f as (select dataset_id, max(case when rn = 1 then status end) as last_status, count(*) filter (status = 'FAILED') as recent_failures from l group by 1)
        select d.*, f.last_status, f.recent_failures, v.variation_pct,
          case when f.last_status = 'FAILED' or (d.succeeded * 100 / d.total < 50 and d.total >= 3) or (not e.enabled and d.failed > 0) then 'critical'
            when f.recent_failures >= 2 or (v.trend = 'slower' and v.variation_pct > 100) then 'unstable' else 'stable' end as risk
        from d join f on f.dataset_id = d.dataset_id join {VARIANCE.replace('KEY', 'dataset_id')} v on v.dataset_id = d.dataset_id
        left join (select dataset_id, execution_state = 'ACTIVE' as enabled from datasets) e on e.dataset_id = d.dataset_id""",
)
def job_risk(t: Tables):
    enabled = t.datasets.select("dataset_id", (F.col("execution_state") == "ACTIVE").alias("enabled"))
    return runs.job_risk(t.runs, "dataset_id", enabled)


PREVIEW = f"""
 le as (select job_id, execution_id, started_at from (select *, row_number() over (partition by job_id order by started_at desc, execution_id desc) as rn from executions) r where rn = 1),
 it as (select execution_id, dataset_id, status from (select e.execution_id, q.dataset_id, q.status, row_number() over (partition by e.execution_id, q.dataset_id
          order by q.requested_at desc, q.queue_id desc) as rn from le e join queue q on q.correlation_id = e.job_id
          and q.requested_at between e.started_at - SECS[30] and e.started_at + SECS[30]) z where rn = 1),
 ok as (select distinct correlation_id as job_id, dataset_id from queue where status = 'SUCCEEDED' and finished_at >= TS'{TODAY}'),
 pv as (select le.execution_id, le.job_id, jd.dataset_id, ok.dataset_id is not null as succeeded_today,
          case when it.status = 'SUCCEEDED' then 'SUCCEEDED' when it.status = 'FAILED' then 'FAILED' when it.status in ('PENDING', 'CLAIMED', 'RUNNING') then 'PENDING'
            when ok.dataset_id is not null then 'SUCCEEDED' else 'NOT_ENQUEUED' end as replay_status
        from le join job_datasets jd on jd.job_id = le.job_id and jd.enabled left join it on it.execution_id = le.execution_id and it.dataset_id = jd.dataset_id
        left join ok on ok.job_id = le.job_id and ok.dataset_id = jd.dataset_id)"""


@query("replay_preview", f"with {PREVIEW} select * from pv")
def replay_preview(t: Tables):
    return jobs.replay_preview(jobs.latest_execution(t.executions), t.job_datasets, t.queue, TODAY)


@query(
    "replay_summary",
    f"""with {PREVIEW} select execution_id, count(*) as total, count(*) filter (replay_status = 'SUCCEEDED') as succeeded, count(*) filter (replay_status = 'FAILED') as failed,
        count(*) filter (replay_status = 'PENDING') as pending, count(*) filter (replay_status = 'NOT_ENQUEUED') as not_enqueued from pv group by 1""",
)
def replay_summary(t: Tables):
    return jobs.replay_summary(jobs.replay_preview(jobs.latest_execution(t.executions), t.job_datasets, t.queue, TODAY))


@query(
    "group_share",
    """select o_orderkey, o_orderpriority, sum(o_totalprice_c) over (partition by o_orderpriority) as group_total, count(*) over (partition by o_orderpriority) as group_rows
       from (select o_orderkey, o_orderpriority, cast(o_totalprice as decimal(18,2)) as o_totalprice_c from @orders) o""",
)
def group_share(t: Tables):
    """Group values next to each row for five hot groups, spread by salt."""
    o = t.orders.select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    out = keyed.attach_group_values(o, ["o_orderpriority"], [F.sum("p").cast("decimal(38,2)").alias("group_total"), F.count(F.lit(1)).alias("group_rows")])
    return out.drop("p")
