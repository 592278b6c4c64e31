"""The given tables and inputs derived from them.

A derived input is one SQL text for both engines: ``@name`` is a given table, ``STRING_T`` the text type,
``TS'...'`` a timestamp literal and ``SECS[x]`` an interval of x seconds. Dependencies are found by name.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)

DERIVED = {
    # One run per order; about a third each failed, succeeded and running.
    "runs": """
        select cast(o_orderkey as STRING_T) as run_id, 'ds_' || cast(o_custkey as STRING_T) as dataset_id,
               'job_' || cast(o_custkey % 20 as STRING_T) as job_id,
               case o_orderstatus when 'F' then 'FAILED' when 'O' then 'SUCCEEDED' else 'RUNNING' end as status,
               o_orderdate as started_at,
               case when o_orderstatus <> 'P' then o_orderdate + SECS[(o_orderkey * 37) % 7200] end as finished_at,
               case o_custkey % 3 when 0 then 'INCREMENTAL' when 1 then 'SNAPSHOT' else 'FULL' end as load_type,
               cast(o_orderkey % 5000 as bigint) as row_count,
               case when o_orderstatus = 'F' then
                 case o_orderkey % 3 when 0 then 'SCHEMA_ERROR' when 1 then 'SOURCE_ERROR' else 'RUNTIME_ERROR' end end as error_class,
               case when o_orderstatus = 'F' then
                 case o_orderkey % 8
                   when 0 then 'Connection timeout after ' || cast(o_orderkey % 90 as STRING_T) || ' s at 2001-03-01T01:01:01Z'
                   when 1 then 'CAST_INVALID_INPUT: value ' || cast(o_custkey as STRING_T) || ' in field C'
                   when 2 then 'Permission denied on TABLE_' || cast(o_custkey % 100 as STRING_T)
                   when 3 then 'Duplicate key deadbeef' || cast(10000000 + o_orderkey as STRING_T) || ' violates constraint'
                   when 4 then 'Schema drift:   column ' || o_orderpriority
                   when 5 then 'executor OOM in stage ' || cast(o_orderkey as STRING_T)
                   when 6 then '  ' end end as error_message
        from @orders""",
    # The registry: one dataset per customer.
    "datasets": """
        select 'ds_' || cast(c_custkey as STRING_T) as dataset_id, replace(upper(c_name), '#', '_') as dataset_name,
               'p_' || cast(c_nationkey % 5 as STRING_T) as project_id, c_mktsegment as area_id,
               case c_nationkey % 3 when 0 then 'ORACLE' when 1 then 'POSTGRES' else 'TABLE' end as source_type,
               case when c_custkey % 4 = 0 then 'PAUSED' else 'ACTIVE' end as execution_state,
               case c_custkey % 5 when 0 then null when 1 then true when 2 then true else false end as enable_incremental,
               case c_custkey % 4 when 0 then 'WATERMARK' when 1 then 'SNAPSHOT' when 3 then 'HASH_MERGE' end as incremental_strategy,
               case c_custkey % 3 when 0 then 'CURRENT' when 1 then 'SNAPSHOT' else 'APPEND_LOG' end as bronze_mode,
               case c_custkey % 7 when 0 then '{"watermark_column":"UPDATED_AT","lookback_days":5,"pk":["ID"]}'
                                  when 1 then '{"watermark_col":"DT_CHANGE","pk":["A","B"]}'
                                  when 2 then '{"pk":[]}' when 3 then '{"watermark_column":"DATALT"}' end as incremental_metadata,
               'cat.bronze.' || replace(lower(c_name), '#', '_') || case when c_nationkey % 2 = 0 then '@LINK_1' else '' end as bronze_table,
               'cat.silver.' || replace(lower(c_name), '#', '_') as silver_table,
               TS'1995-01-01 00:00:00' + SECS[(c_custkey % 2000) * 86400] as created_at,
               case when c_custkey % 3 <> 0 then TS'1996-01-01 00:00:00' + SECS[(c_custkey * 7 % 1500) * 86400] end as updated_at,
               case when c_custkey % 10 = 0 then '2000-01-01 00:00:00' when c_custkey % 10 = 1 then '' end as override_watermark_value
        from @customer""",
    # Bronze and silver steps of each run, with counts of its lines.
    "layers": """
        select cast(o.o_orderkey as STRING_T) as run_id, 'ds_' || cast(o.o_custkey as STRING_T) as dataset_id, s.layer,
               case o.o_orderkey % 4 when 0 then 'MERGE' when 1 then 'OVERWRITE' when 2 then 'APPEND' else 'REPLACE_WHERE' end as operation,
               s.n as row_count, s.ins as inserted_count, s.upd as updated_count, o.o_orderdate as started_at
        from @orders o join (
          select l_orderkey, 'BRONZE' as layer, count(*) as n, count(case when l_returnflag = 'N' then 1 end) as ins,
                 count(case when l_returnflag = 'R' then 1 end) as upd from @lineitem group by l_orderkey
          union all
          select l_orderkey, 'SILVER' as layer, count(distinct l_linenumber) as n,
                 count(distinct case when l_returnflag = 'N' then l_linenumber end) as ins,
                 count(distinct case when l_returnflag = 'R' then l_linenumber end) as upd from @lineitem group by l_orderkey
        ) s on s.l_orderkey = o.o_orderkey""",
    # One queue item per order.
    "queue": """
        select 'q_' || cast(o_orderkey as STRING_T) as queue_id, 'ds_' || cast(o_custkey as STRING_T) as dataset_id,
               'job_' || cast(o_custkey % 20 as STRING_T) as correlation_id, status, cast(o_custkey % 5 * 10 as bigint) as priority,
               cast(o_orderkey % 4 as bigint) as attempt, requested_at,
               case when status <> 'PENDING' then requested_at + SECS[(o_orderkey * 7) % 300] end as claimed_at,
               case when status in ('RUNNING', 'SUCCEEDED', 'FAILED')
                    then requested_at + SECS[(o_orderkey * 7) % 300 + (o_orderkey * 11) % 120] end as started_at,
               case when status in ('SUCCEEDED', 'FAILED')
                    then requested_at + SECS[(o_orderkey * 7) % 300 + (o_orderkey * 11) % 120 + (o_orderkey * 37) % 7200] end as finished_at,
               case when status = 'PENDING' and o_orderkey % 2 = 0 then requested_at + SECS[3600] end as next_retry_at,
               case when status = 'FAILED' then 'RUNTIME_ERROR' end as last_error_class,
               case when status = 'FAILED' then 'failed with code ' || cast(o_orderkey as STRING_T) end as last_error_message,
               case o_orderkey % 3 when 0 then 'SCHEDULE' when 1 then 'MANUAL' else 'BACKFILL' end as trigger_type
        from (select o_orderkey, o_custkey, o_orderdate + SECS[(o_orderkey * 13) % 120] as requested_at,
                     case o_orderkey % 9 when 0 then 'PENDING' when 1 then 'CLAIMED' when 2 then 'RUNNING' when 3 then 'FAILED'
                       when 4 then 'CANCELLED' else 'SUCCEEDED' end as status
              from @orders) q""",
    # An execution of a job: its items of one day.
    "executions": """
        select job_id || '_' || cast(cast(day as date) as STRING_T) as execution_id, job_id, started_at, finished_at, status,
               datasets_total
        from (select correlation_id as job_id, date_trunc('day', requested_at) as day, min(requested_at) as started_at,
                     max(finished_at) as finished_at, max(status) as status, count(distinct dataset_id) as datasets_total
              from queue group by correlation_id, date_trunc('day', requested_at)) e""",
    "job_datasets": """
        select 'job_' || cast(c_custkey % 20 as STRING_T) as job_id, 'ds_' || cast(c_custkey as STRING_T) as dataset_id,
               c_custkey % 6 <> 0 as enabled, c_custkey as execution_order
        from @customer""",
    "jobs": """
        select 'job_' || cast(r_regionkey * 3 as STRING_T) as job_id, r_regionkey % 2 = 0 as enabled from @region""",
    "transitions": """
        select event_id as transition_id, 'q_' || cast(user_id as STRING_T) as queue_id,
               case event_type when 'signup' then 'PENDING' when 'view' then 'CLAIMED' when 'click' then 'RUNNING'
                 when 'purchase' then 'SUCCEEDED' else 'FAILED' end as new_status, ts as created_at
        from @events""",
    "watermarks": """
        select dataset_id, 'TIMESTAMP' as watermark_type, 'UPDATED_AT' as watermark_column,
               cast(max(started_at) as STRING_T) as watermark_value, max(run_id) as last_run_id, max(finished_at) as last_updated_at
        from runs where status = 'SUCCEEDED' group by dataset_id""",
    # Two contract versions per dataset; the pending one differs by nation.
    "versions": """
        select 'ds_' || cast(c_custkey as STRING_T) as dataset_id, 1 as schema_version, 'ACTIVE' as status,
               '{"columns":[{"name":"ID","type":"long","nullable":false},{"name":"NAME","type":"string","nullable":true},' ||
               '{"name":"BAL","type":"decimal","nullable":true,"decimal":{"precision":12,"scale":2}}],"primary_key":["ID"],"order_column":"TS"}'
                 as expect_schema_json
        from @customer
        union all
        select 'ds_' || cast(c_custkey as STRING_T) as dataset_id, 2 as schema_version, 'PENDING' as status,
               '{"columns":[{"name":"name","type":"string","nullable":' || case when c_nationkey % 3 = 0 then 'false' else 'true' end || '}' ||
               case when c_nationkey % 5 = 0 then '' else ',{"name":"BAL","type":"' ||
                 case when c_nationkey % 2 = 0 then 'double","nullable":true}' else 'decimal","nullable":true,"decimal":{"precision":12,"scale":2}}' end end ||
               case when c_nationkey % 7 = 0 then ',{"name":"SEGMENT","type":"string","nullable":true}' else '' end ||
               ',{"name":"ID","type":"long","nullable":false}],"primary_key":["ID"],"order_column":"TS"}' as expect_schema_json
        from @customer where c_acctbal > 0""",
    "orders_target": "select * from @orders where o_orderdate < TS'2001-01-01 00:00:00'",
    "orders_delta": """
        select o_orderkey, o_custkey, case when o_orderkey % 2 = 0 then 'P' else o_orderstatus end as o_orderstatus, o_totalprice,
               o_orderdate, o_orderpriority
        from @orders where o_orderdate >= TS'2000-12-29 00:00:00'""",
    "orders_source_keys": "select o_orderkey from @orders where o_orderkey % 97 <> 0",
    # Lines as text, some of it not castable.
    "raw_lines": """
        select l_orderkey, l_linenumber, l_partkey,
               case when l_linenumber = 7 then 'n/a' when l_linenumber = 6 then '  ' else ' ' || cast(cast(l_quantity as int) as STRING_T) || ' ' end as qty,
               case when l_tax > 0.07 then '31/12/1999' else cast(cast(l_shipdate as date) as STRING_T) end as ship,
               case l_returnflag when 'A' then ' TRUE' when 'R' then 'false ' else '' end as flag
        from @lineitem""",
    # Names of a source and of a catalog that differ slightly.
    "source_names": """
        select distinct 'SRC.' || upper(replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '_') || '_' || p_type) ||
               case p_size % 4 when 0 then '' when 1 then 'S' when 2 then '_TB' else '_X' end as name
        from @part""",
    "catalog_names": """
        select distinct 'cat.silver.' || lower(replace(p_name, ' ', '__') || '_' || replace(p_brand, '#', '_') || '_' || p_type) ||
               case when p_size % 3 = 0 then '_t' else '' end as full_name
        from @part""",
}

SPARK_WORDS = {"STRING_T": "string", "TS'": "timestamp_ntz'"}
DUCKDB_WORDS = {"STRING_T": "varchar", "TS'": "timestamp '"}


def _words(text: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        text = re.sub(rf"(?<![A-Za-z_]){re.escape(k)}", lambda _m: v, text)
    return text


def _intervals(text: str, before: str, after: str) -> str:
    return re.sub(r"SECS\[(.*?)\]", lambda m: before + m.group(1) + after, text)


def used(text: str) -> list[str]:
    """Derived inputs a text needs, dependencies first."""
    order: list[str] = []

    def visit(t: str) -> None:
        for name in DERIVED:
            if name not in order and re.search(rf"(?<![\w@.'\"]){name}(?![\w.'\"])", t):
                visit(DERIVED[name])
                order.append(name)

    visit(text)
    return order


def _with(text: str) -> str:
    names = used(text)
    if not names:
        return text
    chain = ", ".join(f"{n} as ({DERIVED[n]})" for n in names)
    body = text.strip()
    if body.lower().startswith("with "):
        return f"with {chain}, {body[5:]}"
    return f"with {chain} {body}"


def duckdb_sql(text: str) -> str:
    out = _intervals(_words(_with(text), DUCKDB_WORDS), "to_seconds(cast(", " as bigint))")
    return re.sub(r"@(\w+)\b", lambda m: m.group(1) if m.group(1) in GIVEN else m.group(0), out)


def spark_sql(text: str, sf_dir: str) -> str:
    out = _intervals(_words(_with(text), SPARK_WORDS), "make_dt_interval(0, 0, 0, ", ")")
    return re.sub(r"@(\w+)\b", lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`" if m.group(1) in GIVEN else m.group(0), out)


class Tables:
    """Given and derived tables by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, str(sf_dir).rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in DERIVED:
            return self.spark.sql(spark_sql(f"select * from {name}", self.dir))
        raise AttributeError(name)

    @cached_property
    def scratch(self) -> str:
        """A new folder below the one that all executors share."""
        import uuid

        from ..session import shared_dir

        return f"{shared_dir(self.spark)}/suite-{uuid.uuid4().hex}"
