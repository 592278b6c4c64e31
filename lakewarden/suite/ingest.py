"""Checked queries: contract, bronze, table states, discovery, incremental loading, reconciliation."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bronze, commit, contract, discovery, incremental, keyed, load, reconcile, writes
from ..operators.contract import ColumnSpec, Contract, QualityRule
from ..session import ntz, shift
from ..sources import batch, tables as sources
from . import query
from .tables import Tables

LINES = Contract(
    "lineitem", 1,
    (
        ColumnSpec("l_orderkey", "long", False), ColumnSpec("l_linenumber", "int", False), ColumnSpec("l_partkey", "long"),
        ColumnSpec("l_suppkey", "long"), ColumnSpec("l_quantity", "decimal", True, 18, 2),
        ColumnSpec("l_extendedprice", "decimal", True, 18, 2), ColumnSpec("l_discount", "decimal", True, 18, 2),
        ColumnSpec("l_tax", "decimal", True, 18, 2), ColumnSpec("l_returnflag", "string"), ColumnSpec("l_linestatus", "string"),
        ColumnSpec("l_shipdate", "timestamp"),
    ),
    ("l_orderkey", "l_linenumber"), "l_shipdate", "l_shipdate", "timestamp",
)
ORDERS = Contract(
    "orders", 1,
    (
        ColumnSpec("o_orderkey", "long", False), ColumnSpec("o_custkey", "long", False), ColumnSpec("o_orderstatus", "string"),
        ColumnSpec("o_totalprice", "decimal", True, 18, 2), ColumnSpec("o_orderdate", "timestamp"),
        ColumnSpec("o_orderpriority", "string"),
    ),
    ("o_orderkey",), "o_orderdate", "o_orderdate", "timestamp",
)
AS_OF = "2001-01-01 00:00:00"
DAY3 = "2000-12-29 00:00:00"

LINE_SELECT = """l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as decimal(18,2)) as l_quantity,
 cast(l_extendedprice as decimal(18,2)) as l_extendedprice, cast(l_discount as decimal(18,2)) as l_discount,
 cast(l_tax as decimal(18,2)) as l_tax, l_returnflag, l_linestatus, l_shipdate from @lineitem"""
LINE_LWW = f"""select * from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc nulls last,
 l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as rn
 from (select {LINE_SELECT}) t) u where rn = 1"""
ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice as decimal(18,2)) as o_totalprice, o_orderdate, o_orderpriority"


def part(value: str) -> str:
    """SQL of an escaped part of a joined text."""
    return f"coalesce(length(cast({value} as varchar)) || ':' || cast({value} as varchar), '∅')"


def hashed(*values: str) -> str:
    return f"md5(concat_ws('|', {', '.join(part(v) for v in values)}))"


ORDER_HASH = hashed("o_orderkey", "o_custkey", "o_orderstatus", "cast(o_totalprice as decimal(18,2))", "o_orderpriority")


def typed_orders(df: DataFrame) -> DataFrame:
    return contract.cast_to_contract(df, ORDERS)


def hashed_orders(df: DataFrame, batch_id: str = "b1") -> DataFrame:
    return bronze.add_technical_columns(typed_orders(df), batch_id, "SRC.ORDERS", AS_OF, "o_orderdate")


def business(df: DataFrame) -> DataFrame:
    return df.select(*ORDERS.names)


# --- contract and bronze ------------------------------------------------------------------------


@query(
    "lww_return_flags",
    f"""select l_returnflag, count(*) as n, cast(sum(l_extendedprice) as decimal(18,2)) as total
        from ({LINE_LWW}) v group by l_returnflag""",
)
def lww_return_flags(t: Tables):
    """The first slice end to end: cast, technical columns, last write wins, report."""
    typed = contract.cast_to_contract(t.lineitem, LINES)
    rows = bronze.add_technical_columns(typed, "b1", "SRC.LINEITEM", AS_OF, "l_shipdate")
    latest = keyed.latest_per_key(rows, ["l_orderkey", "l_linenumber"], "l_shipdate", tie_break=LINES.names[2:10])
    return latest.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").cast("decimal(18,2)").alias("total")
    )


@query("contract_cast", f"select {LINE_SELECT}")
def contract_cast(t: Tables):
    return contract.cast_to_contract(t.lineitem, LINES)


RAW = Contract(
    "raw_lines", 1,
    (ColumnSpec("l_orderkey", "long"), ColumnSpec("l_linenumber", "int"), ColumnSpec("qty", "int"), ColumnSpec("ship", "date"),
     ColumnSpec("flag", "boolean")),
)


@query(
    "cast_audit",
    r"""with b as (select l_orderkey, l_linenumber, l_partkey, nullif(regexp_replace(qty, '\s+', '', 'g'), '') as q, nullif(trim(ship), '') as s from raw_lines)
        select l_orderkey, l_linenumber, l_partkey, 'qty' as column_name, q as bad_value from b where q is not null and try_cast(q as integer) is null
        union all
        select l_orderkey, l_linenumber, l_partkey, 'ship', s from b where s is not null and try_cast(s as date) is null""",
)
def cast_audit(t: Tables):
    return contract.audit_casts(t.raw_lines, RAW, ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "text_contract_cast",
    r"""select l_orderkey, l_linenumber, try_cast(nullif(regexp_replace(replace(qty, 'n/a', ''), '\s+', '', 'g'), '') as integer) as qty,
               cast(nullif(trim(flag), '') as boolean) as flag
        from raw_lines""",
)
def text_contract_cast(t: Tables):
    """Blank texts become NULL and blanks inside numbers are removed before the cast."""
    only = Contract("raw_lines", 1, tuple(c for c in RAW.columns if c.name != "ship"))
    return contract.cast_to_contract(t.raw_lines.withColumn("qty", F.replace("qty", F.lit("n/a"), F.lit(""))), only)


ALIASED = Contract(
    "customer", 1,
    (ColumnSpec("id", "long", False, aliases=("cust_id", "c_custkey")), ColumnSpec("segment", "string", aliases=("c_mktsegment",), transform="lower"),
     ColumnSpec("name", "string", aliases=("c_name",), transform="upper"), ColumnSpec("balance", "decimal", True, 18, 2, aliases=("c_acctbal",))),
)


@query(
    "contract_aliases",
    """select c_custkey as id, lower(c_mktsegment) as segment, upper(c_name) as name, cast(c_acctbal as decimal(18,2)) as balance
       from @customer""",
)
def contract_aliases(t: Tables):
    return contract.cast_to_contract(t.customer, ALIASED)


@query(
    "null_counts",
    " union all ".join(
        f"select '{c}' as column_name, count(*) filter ({c} is null) as null_count from queue"
        for c in ("queue_id", "claimed_at", "started_at", "finished_at", "next_retry_at")
    ),
)
def null_counts(t: Tables):
    return contract.null_counts(t.queue, ["queue_id", "claimed_at", "started_at", "finished_at", "next_retry_at"])


RULES = Contract(
    "orders", 1, ORDERS.columns,
    quality_rules=(
        QualityRule("not_null", "o_custkey"), QualityRule("in_set", "o_orderstatus", {"values": ["F", "O"]}),
        QualityRule("regex", "o_orderpriority", {"pattern": "^[1-3]-"}), QualityRule("min", "o_totalprice", {"value": 1000}),
        QualityRule("max", "o_totalprice", {"value": 400000}),
    ),
)


@query(
    "quality_rules",
    " union all ".join(
        f"select '{r}' as rule, '{c}' as column_name, count(*) as checked, count(*) filter (not ({p})) as violations from @orders"
        for r, c, p in (
            ("not_null", "o_custkey", "o_custkey is not null"), ("in_set", "o_orderstatus", "o_orderstatus in ('F', 'O')"),
            ("regex", "o_orderpriority", "regexp_matches(o_orderpriority, '^[1-3]-')"),
            ("min", "o_totalprice", "cast(o_totalprice as decimal(18,2)) >= 1000"),
            ("max", "o_totalprice", "cast(o_totalprice as decimal(18,2)) <= 400000"),
        )
    ),
)
def quality_rules(t: Tables):
    return contract.rule_violations(typed_orders(t.orders), RULES)


EXPECTED_QUEUE = Contract(
    "queue", 1,
    (ColumnSpec("queue_id", "string", False), ColumnSpec("claimed_at", "timestamp", False), ColumnSpec("attempt", "int", False),
     ColumnSpec("owner", "string")),
)


@query(
    "structure_validation",
    """select 'MISSING_COLUMN' as issue, 'owner' as column_name, count(*) as rows_affected from queue
       union all select 'TYPE_MISMATCH', 'attempt', count(*) from queue
       union all select 'UNEXPECTED_COLUMN', 'status', count(*) from queue
       union all select 'NULLABILITY_VIOLATION', 'claimed_at', count(*) from queue where claimed_at is null having count(*) > 0""",
)
def structure_validation(t: Tables):
    return contract.validate_structure(t.queue.select("queue_id", "claimed_at", "attempt", "status"), EXPECTED_QUEUE)


@query(
    "contract_inference",
    " union all ".join(
        f"select '{c}' as column_name, '{k}' as contract_type, count(*) filter ({c} is null) > 0 as nullable from runs"
        for c, k in (("run_id", "string"), ("started_at", "timestamp"), ("finished_at", "timestamp"), ("row_count", "long"), ("error_class", "string"))
    ),
)
def contract_inference(t: Tables):
    return contract.observed_contract(t.runs.select("run_id", "started_at", "finished_at", "row_count", "error_class").withColumn("_batch_id", F.lit(1)))


DUCK_DOC = """from_json(expect_schema_json, '{"columns":[{"name":"VARCHAR","type":"VARCHAR","nullable":"BOOLEAN","decimal":{"precision":"INTEGER","scale":"INTEGER"}}],"primary_key":["VARCHAR"],"order_column":"VARCHAR"}')"""
DUCK_FP = f"""(select dataset_id, schema_version, status, md5(array_to_string(list_sort(list_transform(doc.columns,
   lambda c: concat_ws(':', lower(c.name), lower(c.type), coalesce(cast(c.decimal.precision as varchar), ''), coalesce(cast(c.decimal.scale as varchar), ''), cast(c.nullable as varchar)))), ';')
   || '#' || array_to_string(list_sort(list_transform(doc.primary_key, lambda k: lower(k))), ';')) as fp
   from (select dataset_id, schema_version, status, {DUCK_DOC} as doc from versions) d)"""


@query("contract_fingerprints", f"select status, fp as fingerprint, count(*) as n from {DUCK_FP} f group by status, fp")
def contract_fingerprints(t: Tables):
    fp = contract.fingerprint(F.col("expect_schema_json")).alias("fingerprint")
    return t.versions.select("status", fp).groupBy("status", "fingerprint").agg(F.count(F.lit(1)).alias("n"))


TYPE_TEXT = "lower(c.type) || coalesce('(' || cast(c.decimal.precision as varchar) || ',' || cast(c.decimal.scale as varchar) || ')', '')"
CHANGES = f"""
 cols as (select dataset_id, status, unnest(({DUCK_DOC}).columns) as c from versions),
 a as (select dataset_id, lower(c.name) as column_name, {TYPE_TEXT} as ty, c.nullable as nu from cols where status = 'ACTIVE'),
 p as (select dataset_id, lower(c.name) as column_name, {TYPE_TEXT} as ty, c.nullable as nu from cols where status = 'PENDING'),
 j as (select coalesce(a.dataset_id, p.dataset_id) as dataset_id, coalesce(a.column_name, p.column_name) as column_name,
        a.ty as active_type, p.ty as pending_type, a.nu as active_nullable, p.nu as pending_nullable
       from a full join p on a.dataset_id = p.dataset_id and a.column_name = p.column_name),
 ch as (select *, 'ADD_COLUMN' as change from j where active_type is null
        union all select *, 'REMOVE_COLUMN' from j where pending_type is null
        union all select *, 'TYPE_CHANGE' from j where active_type <> pending_type
        union all select *, 'NULLABILITY_CHANGE' from j where active_nullable <> pending_nullable),
 d as (select * from ch where dataset_id in (select dataset_id from p))"""


@query("contract_changes", f"with {CHANGES} select dataset_id, column_name, change, active_type, pending_type, active_nullable, pending_nullable from d")
def contract_changes(t: Tables):
    return contract.contract_changes(t.versions)


@query(
    "contract_change_summary",
    f"""with {CHANGES} select dataset_id, count(*) as total, count(*) filter (change = 'ADD_COLUMN') as added,
        count(*) filter (change = 'REMOVE_COLUMN') as removed, count(*) filter (change = 'TYPE_CHANGE') as type_changes,
        count(*) filter (change = 'NULLABILITY_CHANGE') as nullability_changes from d group by dataset_id""",
)
def contract_change_summary(t: Tables):
    return contract.change_summary(t.versions)


@query(
    "contract_gate",
    f"""select p.dataset_id, a.fp as active_fp, p.fp as observed_fp,
          case when a.fp is null then 1 when a.fp <> p.fp then a.schema_version + 1 else a.schema_version end as schema_version,
          case when a.fp = p.fp then 'ACTIVE' else 'PENDING' end as version_status,
          case when a.fp = p.fp then 'ACTIVE' else 'BLOCKED_SCHEMA_CHANGE' end as execution_state,
          true as bronze_allowed, coalesce(a.fp = p.fp, false) as silver_allowed
        from {DUCK_FP} p left join {DUCK_FP} a on a.dataset_id = p.dataset_id and a.status = 'ACTIVE' and a.dataset_id not like '%9' where p.status = 'PENDING'""",
)
def contract_gate(t: Tables):
    """Datasets whose number ends with 9 have no ACTIVE version yet."""
    versions = t.versions
    active = versions.filter("status = 'ACTIVE' and dataset_id not like '%9'")
    return contract.gate_changes(active, versions.filter("status = 'PENDING'"))


@query("clean_column_names", "select p_partkey as p_part_key, p_name as pname, p_size as p_size_ from @part")
def clean_column_names(t: Tables):
    return bronze.clean_names(t.part.select(F.col("p_partkey").alias("p-part.key"), F.col("p_name").alias("p name"), F.col("p_size").alias("p_size-")))


@query(
    "technical_columns",
    f"""select {ORDER_COLS}, TS'{AS_OF}' as _ingestion_ts, 'b1' as _batch_id, 'SRC.ORDERS' as _source_table, 'UPSERT' as _op,
        'o_orderdate' as _watermark_col, cast(o_orderdate as varchar) as _watermark_value, {ORDER_HASH} as _row_hash, false as _is_deleted
        from @orders""",
)
def technical_columns(t: Tables):
    return hashed_orders(t.orders)


@query(
    "full_refresh_columns",
    f"""select o_orderkey, TS'{AS_OF}' as _ingestion_ts, 'b1' as _batch_id, 'SRC.ORDERS' as _source_table, 'FULL_REFRESH' as _op,
        cast(null as varchar) as _watermark_col, cast(null as varchar) as _watermark_value, cast(null as varchar) as _row_hash, false as _is_deleted
        from @orders""",
)
def full_refresh_columns(t: Tables):
    return bronze.add_full_refresh_columns(t.orders.select("o_orderkey"), "b1", "SRC.ORDERS", AS_OF)


@query(
    "volatile_columns_hash",
    f"""select {hashed('o_custkey', 'o_orderstatus')} as _row_hash, count(*) as n
       from @orders group by 1 having count(*) > 1""",
)
def volatile_columns_hash(t: Tables):
    """Volatile columns do not change the hash; rows that only differ there share it."""
    df = t.orders.select("o_custkey", "o_orderstatus", F.col("o_orderdate").alias("UPDATED_AT"), F.col("o_orderpriority").alias("AUDIT_USER"))
    hashed = df.withColumn("_row_hash", bronze.row_hash(df, volatile=discovery.volatile_columns(df)))
    return discovery.duplicated_hashes(hashed)


@query("duplicate_row_hashes", f"""select {hashed('l_orderkey', 'l_linenumber')} as _row_hash,
       count(*) as n from @lineitem group by 1 having count(*) > 1""")
def duplicate_row_hashes(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_linenumber")
    return discovery.duplicated_hashes(df.withColumn("_row_hash", bronze.row_hash(df)))


@query("contract_lww_rows", f"select * exclude (rn) from ({LINE_LWW}) v")
def contract_lww_rows(t: Tables):
    typed = contract.cast_to_contract(t.lineitem, LINES)
    return keyed.latest_per_key(typed, list(LINES.primary_key), LINES.order_column, tie_break=LINES.names[2:10])


@query("silver_first_load", f"select {ORDER_COLS} from @orders")
def silver_first_load(t: Tables):
    """A missing silver table is created from the contract and then filled."""
    empty = contract.empty_table(t.spark, Contract("orders", 1, tuple(c for c in ORDERS.columns if c.name != "o_orderdate")))
    rows = typed_orders(t.orders)
    return writes.append_log(empty.select(*empty.columns), rows)


# --- table states -------------------------------------------------------------------------------

TARGET = f"select {ORDER_COLS} from orders_target"
DELTA = f"select {ORDER_COLS} from orders_delta"


@query("snapshot_overwrite", DELTA)
def snapshot_overwrite(t: Tables):
    return writes.snapshot(typed_orders(t.orders_delta))


@query("append_log", f"select *, cast(null as varchar) as _op from ({TARGET}) a union all select *, 'INSERT' as _op from ({DELTA}) b")
def append_log(t: Tables):
    """History is kept and a new column is merged into the schema."""
    return writes.append_log(typed_orders(t.orders_target), typed_orders(t.orders_delta).withColumn("_op", F.lit("INSERT")))


UPSERT = f"select * from ({TARGET}) a where o_orderkey not in (select o_orderkey from orders_delta) union all select * from ({DELTA}) b"


@query("upsert_current", UPSERT)
def upsert_current(t: Tables):
    return writes.upsert(typed_orders(t.orders_target), typed_orders(t.orders_delta), ["o_orderkey"], "o_orderdate")


@query("upsert_touched_partitions", f"""
  select * from ({UPSERT}) u where date_trunc('month', o_orderdate) in (
    select date_trunc('month', o_orderdate) from orders_delta
    union select date_trunc('month', o_orderdate) from orders_target where o_orderkey in (select o_orderkey from orders_delta))""")
def upsert_touched_partitions(t: Tables):
    """Only the months an increment concerns are rewritten."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    target, delta = typed_orders(t.orders_target).withColumn("m", month), typed_orders(t.orders_delta).withColumn("m", month)
    return writes.upsert_touched(target, delta, ["o_orderkey"], "m", "o_orderdate").drop("m")


@query(
    "upsert_hash_guarded",
    f"""with h as (select *, {ORDER_HASH} as h from orders_target), d as (select *, {ORDER_HASH} as h from orders_delta),
        c as (select d.* from d left join h on d.o_orderkey = h.o_orderkey where h.o_orderkey is null or h.h is null or h.h <> d.h)
        select {ORDER_COLS}, h as _row_hash, 'old' as _batch_id from h where o_orderkey not in (select o_orderkey from c)
        union all select {ORDER_COLS}, h, 'new' from c""",
)
def upsert_hash_guarded(t: Tables):
    out = writes.upsert_changed(hashed_orders(t.orders_target, "old"), hashed_orders(t.orders_delta, "new"), ["o_orderkey"])
    return out.select(*ORDERS.names, "_row_hash", "_batch_id")


@query(
    "replace_window",
    f"""select * from ({TARGET}) a where o_orderdate is null or o_orderdate < TS'{DAY3}' union all select * from ({DELTA}) b""",
)
def replace_window(t: Tables):
    return writes.replace_window(typed_orders(t.orders_target), typed_orders(t.orders_delta), "o_orderdate", ntz(DAY3))


@query(
    "silver_dispatch",
    f"""select 'MERGE' as operation, count(*) as n, cast(sum(o_totalprice) as decimal(38,2)) as total from ({UPSERT}) u
        union all select 'REPLACE_WHERE', count(*), sum(o_totalprice) from (select * from ({TARGET}) a where o_orderdate < TS'{DAY3}' union all {DELTA}) v
        union all select 'APPEND', count(*), sum(o_totalprice) from ({TARGET} union all {DELTA}) w
        union all select 'OVERWRITE', count(*), sum(o_totalprice) from ({DELTA}) x""",
)
def silver_dispatch(t: Tables):
    target, delta = typed_orders(t.orders_target), typed_orders(t.orders_delta)
    no_key = Contract("orders", 1, ORDERS.columns)
    states = [
        writes.silver_state(target, delta, ORDERS),
        writes.silver_state(target, delta, no_key, "REPLACE_WHERE", "o_orderdate", ntz(DAY3)),
        writes.silver_state(target, delta, no_key, "APPEND"), writes.silver_state(target, delta, no_key),
    ]
    out = None
    for op, state in states:
        one = state.agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").cast("decimal(38,2)").alias("total")).withColumn("operation", F.lit(op))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "merge_metrics",
    f"""select count(*) filter (t.o_orderkey is null) as inserted_count,
         count(*) filter (t.o_orderkey is not null and t.h <> d.h) as updated_count,
         count(*) filter (t.o_orderkey is not null and t.h = d.h) as unchanged_count
        from (select *, {ORDER_HASH} as h from orders_delta) d left join (select *, {ORDER_HASH} as h from orders_target) t on t.o_orderkey = d.o_orderkey""",
)
def merge_metrics(t: Tables):
    actions = writes.merge_actions(hashed_orders(t.orders_target), hashed_orders(t.orders_delta), ["o_orderkey"], "_row_hash", "o_orderdate")
    return writes.merge_metrics(actions)


@query("clustered_layout", "select o_orderkey, o_custkey from @orders")
def clustered_layout(t: Tables):
    return writes.clustered(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query(
    "write_sizing",
    """select dataset_id, est as row_estimate, cast(case when k = 1 then 64 else greatest(1, (est + 999999) // 1000000) end as bigint) as write_partitions
       from (select dataset_id, cast(sum(row_count) * 1000 as bigint) as est, max(case when dataset_id like '%7' then 1 else 0 end) as k from runs group by dataset_id) s""",
)
def write_sizing(t: Tables):
    est = t.runs.groupBy("dataset_id").agg((F.sum("row_count") * 1000).cast("bigint").alias("row_estimate"))
    configured = F.when(F.col("dataset_id").endswith("7"), F.lit(64))
    return est.withColumn("write_partitions", writes.write_partitions_column(F.col("row_estimate"), configured))


@query("published_view", "select o_orderstatus, count(*) as n from @orders group by o_orderstatus")
def published_view(t: Tables):
    t.spark.catalog.dropTempView("lakewarden_order_status")
    sql = f"select o_orderstatus, count(*) as n from parquet.`{t.dir}/orders.parquet` group by o_orderstatus"
    commit.publish_view(t.spark, "lakewarden_order_status", sql)
    return t.spark.table("lakewarden_order_status")


@query(
    "run_log_append",
    """select run_id, dataset_id, status, started_at, finished_at from runs
       union all select 'r_' || queue_id, dataset_id, status, started_at, finished_at from queue where status in ('SUCCEEDED', 'FAILED')""",
)
def run_log_append(t: Tables):
    new = t.queue.filter(F.col("status").isin("SUCCEEDED", "FAILED")).select(
        F.concat(F.lit("r_"), "queue_id").alias("run_id"), "dataset_id", "status", "started_at", "finished_at"
    )
    return writes.append_log(t.runs.select("run_id", "dataset_id", "status", "started_at", "finished_at"), new)


# --- sources ------------------------------------------------------------------------------------


@query("existing_table_source", "select 'lineitem' as source_table, count(*) as row_estimate, 'COUNT' as origin from @lineitem")
def existing_table_source(t: Tables):
    t.lineitem.createOrReplaceTempView("lakewarden_source_lineitem")
    df = sources.read_existing(t.spark, "lakewarden_source_lineitem")
    return sources.estimate_rows(df).withColumn("source_table", F.lit("lineitem"))


@query("first_rows_sample", "select count(*) as rows_seen from (select * from @documents limit 5) d")
def first_rows_sample(t: Tables):
    return sources.first_rows(t.documents, 5).agg(F.count(F.lit(1)).alias("rows_seen"))


@query(
    "batch_load_summary",
    """select count(*) as total_processes, count(*) filter (status = 'SUCCEEDED') as success_count, count(*) filter (status = 'FAILED') as failed_count,
       cast(coalesce(sum(row_count), 0) as bigint) as total_rows from runs where status in ('SUCCEEDED', 'FAILED')""",
)
def batch_load_summary(t: Tables):
    done = t.runs.filter(F.col("status").isin("SUCCEEDED", "FAILED"))
    return batch.summarize(done.withColumn("status", F.when(F.col("status") == "SUCCEEDED", "SUCCESS").otherwise("FAILED")))


@query(
    "active_processes",
    """select dataset_id as process_id, dataset_id, bronze_table as source_table, cast(null as bigint) as expected_rows, silver_table as target_table,
        10000 as fetch_size, 800 as num_partitions, cast(null as varchar) as partition_column, cast(null as bigint) as lower_bound, cast(null as bigint) as upper_bound
       from datasets where execution_state = 'ACTIVE'""",
)
def active_processes(t: Tables):
    null = F.lit(None)
    params = t.datasets.select(
        F.col("dataset_id").alias("process_id"), "dataset_id", F.col("bronze_table").alias("source_table"), null.cast("bigint").alias("expected_rows"),
        F.col("silver_table").alias("target_table"), null.cast("int").alias("fetch_size"), null.cast("int").alias("num_partitions"),
        null.cast("string").alias("partition_column"), null.cast("bigint").alias("lower_bound"), null.cast("bigint").alias("upper_bound"),
        (F.col("execution_state") == "ACTIVE").alias("active"),
    )
    return batch.active_processes(params)


# --- discovery ----------------------------------------------------------------------------------


@query("metadata_projection", """
  select dataset_id, coalesce(json_extract_string(incremental_metadata, '$.watermark_column'), json_extract_string(incremental_metadata, '$.watermark_col')) as watermark_column,
    cast(json_extract_string(incremental_metadata, '$.lookback_days') as integer) as lookback_days,
    cast(coalesce(json_array_length(incremental_metadata, '$.pk'), 0) as bigint) as key_columns,
    case when coalesce(enable_incremental, false) then case when incremental_strategy = 'SNAPSHOT' then 'SNAPSHOT' else 'INCREMENTAL' end else 'FULL' end as load_kind
  from datasets""")
def metadata_projection(t: Tables):
    from ..plans.registry import with_metadata

    return with_metadata(t.datasets).select(
        "dataset_id", "watermark_column", "lookback_days", F.coalesce(F.array_size("pk"), F.lit(0)).cast("bigint").alias("key_columns"), "load_kind"
    )


@query("latest_rows_preview", "select o_orderkey, o_orderdate from @orders order by o_orderdate desc, o_orderkey limit 50")
def latest_rows_preview(t: Tables):
    return discovery.preview_latest(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", 50, tie=["o_orderkey"])


@query(
    "column_preview",
    """with h as (select * from runs order by run_id limit 20),
       s as (select 'run_id' as column_name, 'string' as type, run_id as v, run_id, false as is_date, true as is_pk from h
         union all select 'started_at', 'timestamp_ntz', cast(started_at as varchar), run_id, true, false from h
         union all select 'finished_at', 'timestamp_ntz', cast(finished_at as varchar), run_id, true, false from h
         union all select 'row_count', 'bigint', cast(row_count as varchar), run_id, false, false from h),
       n as (select *, row_number() over (partition by column_name order by run_id) as rn from s where v is not null)
       select column_name, type, string_agg(v, '|' order by run_id) as samples, is_date, is_pk from n where rn <= 3
       group by column_name, type, is_date, is_pk""",
)
def column_preview(t: Tables):
    out = discovery.preview_columns(t.runs.select("run_id", "started_at", "finished_at", "row_count"), ["run_id"], 20, order=["run_id"])
    return out.withColumn("samples", F.array_join("sample_values", "|")).drop("sample_values")


@query(
    "watermark_suggestion",
    """select 'o_orderdate' as column_name, 'first_date_column' as reason, cast(min(o_orderdate) as varchar) as min_value,
        cast(max(o_orderdate) as varchar) as max_value, count(*) as total_rows from @orders
       union all select 'ts_updated', 'partial_match', cast(min(ts) as varchar), cast(max(ts) as varchar), count(*) from @events
       union all select 'created_at', 'name_pattern', cast(min(created_at) as varchar), cast(max(created_at) as varchar), count(*) from transitions""",
)
def watermark_suggestion(t: Tables):
    out = None
    for df in (t.orders, t.events.select("event_id", F.col("ts").alias("ts_updated")), t.transitions):
        column, reason = discovery.suggest_watermark(df)
        one = discovery.date_ranges(df, [column]).withColumn("reason", F.lit(reason))
        out = one if out is None else out.unionByName(one)
    return out


PROFILED = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate",
)


@query(
    "column_profile",
    " union all ".join(
        f"""select '{c}' as column_name, n as total_rows, d as distinct_values, z as null_values, round(d / n, 6) as distinct_ratio,
            round(z / n, 6) as null_ratio, d / n > 0.01 and z / n < 0.5 as fits_watermark
            from (select count(*) as n, count(distinct {c}) as d, count(*) filter ({c} is null) as z from @lineitem) s"""
        for c in PROFILED
    ),
)
def column_profile(t: Tables):
    return discovery.column_profile(t.lineitem, list(PROFILED), exact=True)


WITHIN = "select column_name, true as rows_within, true as distinct_within, true as nulls_within from (values {0}) v(column_name)"


def _within(t: Tables, estimate: DataFrame, rows_off: float, distinct_off: float) -> DataFrame:
    """Whether each estimate of a profile lies within its bound of the exact value."""
    exact = discovery.column_profile(t.lineitem, t.lineitem.columns, exact=True)
    near = lambda c, off: F.abs(F.col(f"e.{c}") - F.col(f"x.{c}")) <= F.greatest(F.lit(2.0), F.col(f"x.{c}") * off)
    return estimate.alias("e").join(exact.alias("x"), "column_name").select(
        "column_name", near("total_rows", rows_off).alias("rows_within"), near("distinct_values", distinct_off).alias("distinct_within"),
        near("null_values", rows_off).alias("nulls_within"),
    )


LINE_COLUMNS = ", ".join(f"('{c}')" for c in PROFILED)


@query("column_profile_sketch", WITHIN.format(LINE_COLUMNS))
def column_profile_sketch(t: Tables):
    """The same pass with sketches, the form for large tables: every estimate within the sketch's stated error."""
    return _within(t, discovery.column_profile(t.lineitem, t.lineitem.columns), 0.0, discovery.SKETCH_ERROR)


@query("column_profile_sampled", "select true as rows_within")
def column_profile_sampled(t: Tables):
    """A 1% sample scaled by 100: the row count lies within six standard errors of the sample."""
    rows = t.lineitem.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("guess"))
    guess = discovery.sampled_profile(t.lineitem, t.lineitem.columns).agg(F.lit(0).cast("bigint").alias("n"), F.max("total_rows").alias("guess"))
    both = rows.unionByName(guess).agg(F.max("n").alias("n"), F.max("guess").alias("guess"))
    return both.select((F.abs(F.col("guess") - F.col("n")) <= 6 * F.sqrt(F.col("n") * 99.0)).alias("rows_within"))


@query(
    "date_column_ranges",
    """select 'l_shipdate' as column_name, cast(min(l_shipdate) as varchar) as min_value, cast(max(l_shipdate) as varchar) as max_value,
       count(*) as total_rows from @lineitem""",
)
def date_column_ranges(t: Tables):
    return discovery.date_ranges(t.lineitem)


@query(
    "key_uniqueness",
    """select *, total_rows - distinct_rows as duplicate_count, total_rows = distinct_rows as is_unique from (
        select 'lineitem' as t, count(*) as total_rows, count(distinct concat_ws('␟', coalesce(length(cast(l_orderkey as varchar)) || ':' || cast(l_orderkey as varchar), '∅'), coalesce(length(cast(l_linenumber as varchar)) || ':' || cast(l_linenumber as varchar), '∅'))) as distinct_rows from @lineitem
        union all select 'orders', count(*), count(distinct cast(o_orderkey as varchar)) from @orders
        union all select 'conversations', count(*), count(distinct concat_ws('␟', coalesce(length(cast(conv_id as varchar)) || ':' || cast(conv_id as varchar), '∅'), coalesce(length(cast(turn as varchar)) || ':' || cast(turn as varchar), '∅'))) from @conversations) s""",
)
def key_uniqueness(t: Tables):
    tag = lambda df, keys, n: discovery.uniqueness(df, keys).withColumn("t", F.lit(n))
    return tag(t.lineitem, ["l_orderkey", "l_linenumber"], "lineitem").unionByName(tag(t.orders, ["o_orderkey"], "orders")).unionByName(
        tag(t.conversations, ["conv_id", "turn"], "conversations")
    )


@query(
    "top_duplicate_keys",
    """select l_orderkey, l_linenumber, count(*) as dup_count from @lineitem group by 1, 2 having count(*) > 1
       order by dup_count desc, l_orderkey, l_linenumber limit 5""",
)
def top_duplicate_keys(t: Tables):
    return discovery.duplicated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


def _finding(t: Tables, name: str, f: discovery.KeyFinding, rows: DataFrame) -> DataFrame:
    """A finding next to the exact counts of the table it was made on."""
    keys = F.struct(*f.columns) if f.columns else F.lit(None)
    return rows.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct(keys).alias("distinct_keys")).select(
        F.lit(name).alias("t"), F.lit("+".join(f.columns)).alias("key_columns"), F.lit(f.confidence).alias("confidence"),
        F.lit(f.method or "none").alias("method"), "total_rows", "distinct_keys",
    )


def _smallest(name: str, columns: list[str], most: int) -> str:
    """SQL for the size of the smallest unique column set of a table, by counting every set of up to ``most`` columns."""
    size = "null"
    for n in range(most, 0, -1):
        unique = " or ".join(f"count(distinct row({', '.join(s)})) = count(*)" for s in combinations(columns, n))
        size = f"case when {unique} then {n} else {size} end"
    return f"select '{name}' as t, cast({size} as integer) as key_size, count(*) as total_rows, count(*) as distinct_keys from @{name}"


KEYLESS = ("l_shipdate", "o_orderdate")  # times are no key columns
SEARCHED = {
    "orders": (["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], 1),
    "part": (["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], 1),
    "lineitem": (["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"], 3),
    "conversations": (["conv_id", "turn", "role", "text"], 4),
}


def _sized(t: Tables, name: str, f: discovery.KeyFinding, rows: DataFrame) -> DataFrame:
    size = F.lit(len(f.columns) or None).cast("int").alias("key_size")
    return _finding(t, name, f, rows).select("t", size, "total_rows", F.when(size.isNotNull(), F.col("distinct_keys")).otherwise(F.col("total_rows")).alias("distinct_keys"))


@query("key_discovery", " union all ".join(_smallest(name, *how) for name, how in SEARCHED.items()))
def key_discovery(t: Tables):
    """The smallest key of whole tables, whatever it takes; it is unique on all rows."""
    found = [_sized(t, name, discovery.discover_key(df), df) for name, df in ((n, getattr(t, n)) for n in SEARCHED)]
    return reduce(DataFrame.unionByName, found)


@query(
    "single_key",
    """select 'orders' as t, 'o_orderkey' as key_columns, cast(0.95 as double) as confidence, 'single_col' as method, count(*) as total_rows, count(distinct o_orderkey) as distinct_keys from @orders
       union all select 'part', 'p_partkey', cast(0.95 as double), 'single_col', count(*), count(distinct p_partkey) from @part""",
)
def single_key(t: Tables):
    """Single keys, on whole tables."""
    found = [_finding(t, name, discovery.discover_key(df), df) for name, df in (("orders", t.orders), ("part", t.part))]
    return found[0].unionByName(found[1]).withColumn("confidence", F.col("confidence").cast("decimal(3,2)").cast("double"))


BITS = {f"f{i}": f"floor(o_orderkey / {2**i}) % 2" for i in range(12)} | {"f12": "floor(o_orderkey / 4096)"}
NEEDED = " + ".join(f"case when count(distinct {e}) > 1 then 1 else 0 end" for e in BITS.values())


@query("wide_key", f"select 'orders' as t, cast({NEEDED} as integer) as key_size, count(*) as total_rows, count(*) as distinct_keys from @orders")
def wide_key(t: Tables):
    """A key that needs every one of up to thirteen columns of two values, beside two columns that follow from others."""
    df = t.orders.select(*[F.expr(f"cast({e} as int)").alias(n) for n, e in BITS.items()], F.expr("cast(floor(o_orderkey / 2) + o_orderkey as int) % 2").alias("g0"), F.lit("x").alias("g1"))
    return _sized(t, "orders", discovery.discover_key(df), df)


CD = {f"cd_{i}": f"l_linenumber % {i + 2}" for i in range(10)}


@query(
    "key_behind_flags",
    """select 'lines' as t, 'g+h' as key_columns, cast(0.85 as double) as confidence, 'combo_2col' as method, count(*) as total_rows, count(distinct (g, h)) as distinct_keys
       from (select l_orderkey as g, row_number() over (partition by l_orderkey order by l_linenumber) as h from @lineitem) s""",
)
def key_behind_flags(t: Tables):
    """A key of two columns behind ten promising names of few values; a wider key that also holds is not returned."""
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    df = t.lineitem.select(*[F.expr(e).alias(n) for n, e in CD.items()], F.col("l_orderkey").alias("g"), F.row_number().over(at).alias("h"))
    return _finding(t, "lines", discovery.discover_key(df), df).withColumn("confidence", F.col("confidence").cast("decimal(3,2)").cast("double"))


@query("no_key", "select 'lines' as t, '' as key_columns, cast(0.0 as double) as confidence, 'none' as method, count(*) * 2 as total_rows, cast(0 as bigint) as distinct_keys from @lineitem")
def no_key(t: Tables):
    """Rows that repeat as a whole have no key."""
    df = t.lineitem.union(t.lineitem)
    return _finding(t, "lines", discovery.discover_key(df), df).withColumn("confidence", F.col("confidence").cast("double"))


@query("declared_key", "select 'orders' as t, 'o_orderkey' as key_columns, cast(1.0 as double) as confidence, 'declared' as method, count(*) as total_rows, count(distinct o_orderkey) as distinct_keys from @orders")
def declared_key(t: Tables):
    return _finding(t, "orders", discovery.discover_key(t.orders, declared=["o_orderkey"]), t.orders).withColumn("confidence", F.col("confidence").cast("double"))


@query(
    "strategy_decision",
    """select dataset_id, case when wm then 'WATERMARK' when conf >= 0.9 then 'HASH_MERGE' else 'SNAPSHOT' end as strategy
       from (select dataset_id, count(*) filter (load_type = 'INCREMENTAL') > 0 and sum(row_count) % 2 = 0 as wm,
                case when sum(row_count) % 3 = 0 then 0.85 when sum(row_count) % 3 = 1 then 0.95 end as conf from runs group by dataset_id) s""",
)
def strategy_decision(t: Tables):
    total = F.sum("row_count")
    g = t.runs.groupBy("dataset_id").agg(
        ((F.count_if(F.col("load_type") == "INCREMENTAL") > 0) & (total % 2 == 0)).alias("wm"),
        F.when(total % 3 == 0, F.lit(0.85)).when(total % 3 == 1, F.lit(0.95)).alias("conf"),
    )
    return g.select("dataset_id", discovery.decide_strategy_column(F.col("wm"), F.col("conf")).alias("strategy"))


# --- incremental loading ------------------------------------------------------------------------


@query(
    "effective_watermarks",
    """select d.dataset_id, coalesce(nullif(d.override_watermark_value, ''), w.watermark_value) as effective_watermark,
       nullif(d.override_watermark_value, '') is not null as is_override from datasets d left join watermarks w on w.dataset_id = d.dataset_id""",
)
def effective_watermarks(t: Tables):
    return incremental.effective_watermarks(t.datasets, t.watermarks)


CURRENT = incremental.LoadConfig("orders", "SRC.ORDERS", "CURRENT", "WATERMARK", ("o_orderkey",), "o_orderdate")


@query("incremental_read", f"select o_orderkey, o_orderdate from @orders where o_orderdate >= TS'{DAY3}'")
def incremental_read(t: Tables):
    """From watermark minus three days on, inclusive; the bound reaches the scan."""
    return incremental.read_increment(t.orders, CURRENT, AS_OF, AS_OF).select("o_orderkey", "o_orderdate")


@query("rolling_window_read", f"select o_orderkey, o_orderdate from @orders where o_orderdate >= TS'{DAY3}'")
def rolling_window_read(t: Tables):
    """Without a key the window counts back from now."""
    cfg = incremental.LoadConfig("orders", "SRC.ORDERS", "CURRENT", "WATERMARK", (), "o_orderdate")
    return incremental.read_increment(t.orders, cfg, None, AS_OF).select("o_orderkey", "o_orderdate")


ARRIVALS = ("2001-01-01 00:00:00", "2001-07-31 00:00:00", "2001-08-03 00:00:00", "2030-01-01 00:00:00")


@query(
    "arrival_report",
    " union all ".join(
        f"""select '{w}' as watermark, n as newer_rows, l as lookback_rows, o as older_rows, m as max_watermark,
              case when n > 0 then 'LOAD' when l > 0 then 'LATE_ARRIVALS' else 'SKIP' end as decision
            from (select count(*) filter (o_orderdate > TS'{w}') as n,
                   count(*) filter (o_orderdate between TS'{w}' - SECS[259200] and TS'{w}') as l,
                   count(*) filter (o_orderdate < TS'{w}' - SECS[259200]) as o, max(o_orderdate) as m from @orders) s"""
        for w in ARRIVALS
    ),
)
def arrival_report(t: Tables):
    """New rows, late rows and the short circuit, at four watermarks."""
    out = None
    for w in ARRIVALS:
        one = incremental.arrival_report(t.orders, "o_orderdate", ntz(w), 3).withColumn("watermark", F.lit(w))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "high_water_marks",
    """select _batch_id, min(o_orderdate) as watermark_start, max(o_orderdate) as watermark_end, count(*) as rows from (
         select o_orderdate, 'b0' as _batch_id from orders_target union all select o_orderdate, 'b1' from orders_delta) u group by _batch_id""",
)
def high_water_marks(t: Tables):
    table = writes.append_log(hashed_orders(t.orders_target, "b0"), hashed_orders(t.orders_delta, "b1"))
    one = lambda b: incremental.high_water_mark(table, "o_orderdate", b).withColumn("_batch_id", F.lit(b))
    return one("b0").unionByName(one("b1"))


@query(
    "watermark_save",
    f"""with e as (select dataset_id, 'TIMESTAMP' as watermark_type, 'finished_at' as watermark_column, cast(max(finished_at) as varchar) as watermark_value,
              max(run_id) as last_run_id, TS'2002-01-01 00:00:00' as last_updated_at
            from runs where load_type = 'INCREMENTAL' group by dataset_id having max(finished_at) is not null)
        select * from watermarks where dataset_id not in (select dataset_id from e) union all select * from e""",
)
def watermark_save(t: Tables):
    new = incremental.watermark_rows(
        t.runs.filter("load_type = 'INCREMENTAL'"), F.col("dataset_id"), "finished_at", F.col("run_id"), "2002-01-01 00:00:00"
    )
    return incremental.save_watermarks(t.watermarks, new)


@query(
    "write_mode_matrix",
    """select dataset_id, case when not coalesce(enable_incremental, true) then 'OVERWRITE' when bronze_mode = 'APPEND_LOG' then 'APPEND' when bronze_mode <> 'CURRENT' then 'OVERWRITE'
         when k and incremental_strategy = 'HASH_MERGE' then 'HASH_MERGE' when k then 'MERGE' when w is not null then 'REPLACE_WHERE' else 'OVERWRITE' end as operation
       from (select *, coalesce(json_array_length(incremental_metadata, '$.pk'), 0) > 0 as k,
                coalesce(json_extract_string(incremental_metadata, '$.watermark_column'), json_extract_string(incremental_metadata, '$.watermark_col')) as w from datasets) d""",
)
def write_mode_matrix(t: Tables):
    from ..plans.registry import with_metadata

    d = with_metadata(t.datasets)
    op = incremental.choose_write_column(
        F.col("bronze_mode"), F.coalesce("incremental_strategy", F.lit("")), F.coalesce(F.array_size("pk") > 0, F.lit(False)), F.col("watermark_column"),
        F.coalesce("enable_incremental", F.lit(True)),
    )
    return d.select("dataset_id", op.alias("operation"))


@query("bronze_load_current", f"select *, 'b0' as _batch_id from ({TARGET}) a where o_orderdate < TS'{DAY3}' union all select *, 'b1' from (select {ORDER_COLS} from @orders) b where o_orderdate >= TS'{DAY3}'")
def bronze_load_current(t: Tables):
    """A whole incremental load: cutoff, read, technical columns, upsert."""
    load = incremental.load_bronze(typed_orders(t.orders), hashed_orders(t.orders_target, "b0"), CURRENT, "b1", AS_OF, "2001-01-01", stage=False)
    return load.state.select(*ORDERS.names, "_batch_id")


@query("bronze_load_no_key", f"select *, 'b0' as _batch_id from ({TARGET}) a where o_orderdate < TS'{DAY3}' union all select *, 'b1' from (select {ORDER_COLS} from @orders) b where o_orderdate >= TS'{DAY3}'")
def bronze_load_no_key(t: Tables):
    """Without a key the lookback window is replaced and older rows stay."""
    cfg = incremental.LoadConfig("orders", "SRC.ORDERS", "CURRENT", "WATERMARK", (), "o_orderdate")
    load = incremental.load_bronze(typed_orders(t.orders), hashed_orders(t.orders_target, "b0"), cfg, "b1", AS_OF, stage=False)
    return load.state.select(*ORDERS.names, "_batch_id")


@query(
    "full_load",
    f"""select 'bronze' as layer, count(*) as n, cast(sum(o_totalprice) as decimal(38,2)) as total, count(distinct case when o_orderdate >= TS'{DAY3}' then o_orderkey end) as fresh
          from (select {ORDER_COLS} from @orders) o
        union all select 'silver', count(*), cast(sum(o_totalprice) as decimal(38,2)), 0 from (select {ORDER_COLS} from @orders) o
        union all select 'runs', 2, null, 1 union all select 'layers', 4, null, 0 union all select 'watermarks', 1, null, 0""",
)
def full_load(t: Tables):
    """Two runs from source to silver, with staging, watermark and logs; every table is read back. The second run
    writes the partitions that its increment touches."""
    import uuid

    name, years = f"lakewarden_load_{uuid.uuid4().hex}", F.year("o_orderdate").cast("int")
    place = load.Place(f"{name}_bronze", f"{t.scratch}/tables", f"{name}_", f"{name}_silver", "y")
    for run, rows in (("r1", t.orders_target), ("r2", t.orders)):
        load.run_load(typed_orders(rows).withColumn("y", years), place, CURRENT, run, AS_OF, ORDERS)
    read = lambda part: t.spark.table(f"{name}_{part}")
    price, none = F.sum("o_totalprice").cast("decimal(38,2)").alias("total"), F.lit(None).cast("decimal(38,2)").alias("total")
    fresh = F.count_distinct(F.when((F.col("_batch_id") == "r2") & (F.col("o_orderdate") >= F.lit(DAY3).cast("timestamp_ntz")), F.col("o_orderkey")))
    n, zero = F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("fresh")
    out = read("bronze").agg(n, price, fresh.alias("fresh")).select(F.lit("bronze").alias("layer"), "*")
    out = out.unionByName(read("silver").agg(n, price).select(F.lit("silver").alias("layer"), "*", zero))
    out = out.unionByName(read("runs").agg(n, F.count_if(F.col("watermark_start").isNotNull()).alias("fresh")).select(F.lit("runs").alias("layer"), "*", none))
    for part, rows in (("layers", read("layers")), ("watermarks", load.stored_watermarks(t.spark, place))):
        out = out.unionByName(rows.agg(n).select(F.lit(part).alias("layer"), "*", none, zero))
    return out


@query("backfill_rerun", f"select {ORDER_COLS} from @orders")
def backfill_rerun(t: Tables):
    """A load repeated with an older watermark: the upsert makes the second run change nothing."""
    first = incremental.load_bronze(typed_orders(t.orders), hashed_orders(t.orders_target, "b0"), CURRENT, "b1", AS_OF, "2001-01-01", stage=False)
    again = incremental.load_bronze(typed_orders(t.orders), first.state, CURRENT, "b2", AS_OF, "1999-06-01", stage=False)
    return business(again.state)


@query(
    "silver_promotion",
    f"""select 'lineitem' as t, count(*) as n, cast(sum(l_extendedprice) as decimal(38,2)) as total from ({LINE_LWW}) v
        union all select 'orders', count(*), cast(sum(o_totalprice) as decimal(38,2)) from ({UPSERT}) u""",
)
def silver_promotion(t: Tables):
    """Bronze to silver for a first load with duplicates and for an increment on an existing table."""
    bronze_lines = bronze.add_technical_columns(t.lineitem, "b1", "SRC.LINEITEM", AS_OF, "l_shipdate")
    _, lines = incremental.promote_to_silver(bronze_lines, None, LINES)
    _, orders = incremental.promote_to_silver(hashed_orders(t.orders_delta), typed_orders(t.orders_target), ORDERS)
    total = lambda df, c, n: df.agg(F.count(F.lit(1)).alias("n"), F.sum(c).cast("decimal(38,2)").alias("total")).withColumn("t", F.lit(n))
    return total(lines, "l_extendedprice", "lineitem").unionByName(total(orders, "o_totalprice", "orders"))


@query("silver_increment", UPSERT)
def silver_increment(t: Tables):
    """Only the rows of the latest load are cast and merged."""
    table = writes.append_log(hashed_orders(t.orders_target, "b0"), hashed_orders(t.orders_delta, "b1"))
    return incremental.promote_to_silver(table, typed_orders(t.orders_target), ORDERS, batch_id="b1")[1]


@query("replace_window_touched", f"select * from (select {ORDER_COLS} from @orders) o where o_orderdate >= TS'2000-12-01 00:00:00' and o_orderdate < TS'{DAY3}' union all select * from ({DELTA}) b")
def replace_window_touched(t: Tables):
    """Of a table partitioned by month, only the month of the cutoff and later ones are read and rewritten."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    target, delta = typed_orders(t.orders_target).withColumn("m", month), typed_orders(t.orders_delta).withColumn("m", month)
    return writes.replace_window_touched(target, delta, "o_orderdate", ntz(DAY3), "m", "2000-12").drop("m")


@query(
    "overlap_collection",
    """select e.* from @events e where ts >= (select max(ts) from @events) - SECS[259200] - SECS[900]""",
)
def overlap_collection(t: Tables):
    """Events since the last collection, which is taken three days before the end, with 15 minutes of overlap."""
    end = t.events.agg(F.max("ts").alias("m")).collect()[0]["m"]
    start, _ = incremental.collection_window(shift(ntz(end), "DAY", -3), ntz(end), 15)
    return t.events.filter(F.col("ts") >= start)


@query(
    "watermark_report",
    """select d.dataset_id, d.dataset_name, w.watermark_column, w.watermark_type, w.watermark_value, w.last_updated_at
       from datasets d join watermarks w on w.dataset_id = d.dataset_id""",
)
def watermark_report(t: Tables):
    return incremental.watermark_report(t.datasets, t.watermarks)


# --- reconciliation -----------------------------------------------------------------------------


@query(
    "delete_flags",
    """select o.o_orderkey, s.o_orderkey is null as _is_deleted from @orders o left join orders_source_keys s on s.o_orderkey = o.o_orderkey""",
)
def delete_flags(t: Tables):
    target = t.orders.select("o_orderkey").withColumn("_is_deleted", F.lit(False))
    return reconcile.flag_deleted(target, t.orders_source_keys, ["o_orderkey"])


@query(
    "delete_report",
    """select d as deleted_count, n as total_count, round(d / n, 6) as delete_ratio, d / n > 0.1 as alert from (
        select count(*) filter (s.o_orderkey is null) as d, count(*) as n from @orders o left join orders_source_keys s on s.o_orderkey = o.o_orderkey) x""",
)
def delete_report(t: Tables):
    return reconcile.delete_report(t.orders.withColumn("_is_deleted", F.lit(False)), t.orders_source_keys, ["o_orderkey"])


@query("missing_at_source", "select o_orderkey from @orders where o_orderkey not in (select o_orderkey from orders_source_keys)")
def missing_at_source(t: Tables):
    target = t.orders.select("o_orderkey").withColumn("_is_deleted", F.lit(False))
    return reconcile.missing_at_source(target, t.orders_source_keys, ["o_orderkey"]).select("o_orderkey")


@query(
    "change_detection",
    f"""select d.o_orderkey, case when t.o_orderkey is null then 'NEW' else 'CHANGED' end as change
        from (select *, {ORDER_HASH} as h from orders_delta) d left join (select *, {ORDER_HASH} as h from orders_target) t on t.o_orderkey = d.o_orderkey
        where t.o_orderkey is null or t.h <> d.h""",
)
def change_detection(t: Tables):
    out = reconcile.detect_changes(hashed_orders(t.orders_delta), hashed_orders(t.orders_target), ["o_orderkey"])
    return out.select("o_orderkey", "change")


@query(
    "count_reconciliation",
    """select s as source_count, t as target_count, s - t as difference, round((s - t) * 100.0 / s, 2) as difference_pct, s = t as identical
       from (select (select count(*) from @orders) as s, (select count(*) from orders_target) as t) x""",
)
def count_reconciliation(t: Tables):
    return reconcile.count_report(t.orders, t.orders_target)


@query(
    "orphan_tables",
    """select p.bronze_table from (select bronze_table from datasets) p where lower(split_part(bronze_table, '.', 3)) not in (
         select lower(split_part(bronze_table, '.', 3)) from datasets where execution_state = 'ACTIVE')""",
)
def orphan_tables(t: Tables):
    registered = t.datasets.filter("execution_state = 'ACTIVE'").select(F.upper("bronze_table").alias("known"))
    return reconcile.orphan_tables(t.datasets.select("bronze_table"), "bronze_table", registered, "known")


@query(
    "orphan_queue_items",
    """select queue_id, correlation_id as job_id, status from queue where status in ('PENDING', 'CLAIMED', 'RUNNING')
       and correlation_id not in (select job_id from jobs)""",
)
def orphan_queue_items(t: Tables):
    items = t.queue.withColumnRenamed("correlation_id", "job_id")
    return reconcile.orphan_items(items, t.jobs, "job_id").select("queue_id", "job_id", "status")


@query(
    "existing_names",
    """select c.c_name as candidate, replace(upper(c.c_name), '#', '_') in (select upper(dataset_name) from datasets where area_id = 'BUILDING') as already_registered
       from @customer c""",
)
def existing_names(t: Tables):
    candidates = t.customer.select(F.col("c_name").alias("candidate"), F.replace(F.lower("c_name"), F.lit("#"), F.lit("_")).alias("n"))
    return reconcile.flag_existing(candidates, "n", t.datasets.filter("area_id = 'BUILDING'"), "dataset_name").drop("n")
