"""Checked queries: streams that read the given files until all present input is processed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import streams
from . import query
from .tables import Tables


def _stream(t: Tables, name: str):
    """A given table as a file stream; the folder holds other tables too, so the file is picked by name."""
    schema = getattr(t, name).schema
    return t.spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", f"{name}.parquet").load(t.dir)


@query(
    "stream_upsert",
    """select l_orderkey, l_linenumber, l_shipdate from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc nulls last) as rn
         from (select l_orderkey, l_linenumber, l_shipdate from @lineitem) l) r where rn = 1""",
)
def stream_upsert(t: Tables):
    """Files into a keyed table, newest row per key; the table is partitioned by year of shipping."""
    scratch, table = t.scratch, f"lakewarden_stream_{uuid.uuid4().hex}"
    rows = _stream(t, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.year("l_shipdate").alias("y"))
    q = streams.upsert_stream(rows, table, ["l_orderkey", "l_linenumber"], "l_shipdate", f"{scratch}/tables", f"{scratch}/ckpt", "y")
    q.awaitTermination()
    return t.spark.table(table).drop("y")


@query(
    "stream_transition_counts",
    """select date_trunc('minute', created_at) as ts_min, count(*) filter (new_status = 'CLAIMED') as claims, count(*) filter (new_status = 'RUNNING') as starts,
         count(*) filter (new_status in ('SUCCEEDED', 'FAILED', 'CANCELLED')) as ends from transitions
       where date_trunc('minute', created_at) + SECS[60] <= (select max(created_at) from transitions) - SECS[259200] group by 1""",
)
def stream_transition_counts(t: Tables):
    """Counts per minute of all minutes that the lateness bound of three days has closed."""
    kind = F.create_map(*[F.lit(v) for kv in (("signup", "PENDING"), ("view", "CLAIMED"), ("click", "RUNNING"), ("purchase", "SUCCEEDED")) for v in kv])
    moves = _stream(t, "events").select(F.coalesce(kind[F.col("event_type")], F.lit("FAILED")).alias("new_status"), F.col("ts").alias("created_at"))
    streams.drain(streams.transition_counts(moves), f"{t.scratch}/out", f"{t.scratch}/ckpt").awaitTermination()
    return t.spark.read.parquet(f"{t.scratch}/out").withColumn("ts_min", F.col("ts_min").cast("timestamp_ntz"))


@query("stream_without_replays", "select event_id, user_id from @events")
def stream_without_replays(t: Tables):
    """Every event arrives twice and is kept once."""
    events = _stream(t, "events").select("event_id", "user_id", "ts")
    twice = events.union(events)
    streams.drain(streams.without_replays(twice, ["event_id"], "ts"), f"{t.scratch}/out", f"{t.scratch}/ckpt").awaitTermination()
    return t.spark.read.parquet(f"{t.scratch}/out").select("event_id", "user_id")
