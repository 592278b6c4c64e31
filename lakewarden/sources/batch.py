"""Loading many tables from a parameter table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.bronze import clean_names
from ..operators.commit import commit_snapshot
from ..operators.writes import sized_for_write
from .jdbc import FETCH_SIZE, JdbcConnection, Split, read_table

RESULT_SCHEMA = (
    "process_id string, status string, row_count bigint, duration_seconds double, rows_per_second double, error string"
)


def active_processes(params: DataFrame) -> DataFrame:
    """Active parameter rows with default fetch size and partitions."""
    return params.filter("active").select(
        "process_id", "dataset_id", "source_table", "expected_rows", "target_table",
        F.coalesce("fetch_size", F.lit(FETCH_SIZE)).alias("fetch_size"),
        F.coalesce("num_partitions", F.lit(800)).alias("num_partitions"),
        "partition_column", "lower_bound", "upper_bound",
    )


def load_all(spark: SparkSession, params: DataFrame, conn: JdbcConnection, root: str) -> DataFrame:
    """Load every active table; one result row each. A failing table does not stop the others.

    Only the parameter rows, one per table, come to the driver. Rows are counted while they are written.
    """
    results = []
    for p in active_processes(params).orderBy("process_id").toLocalIterator():
        began = time.monotonic()
        try:
            split = Split(p.partition_column, p.lower_bound, p.upper_bound, p.num_partitions)
            df = clean_names(read_table(spark, conn, p.source_table, split, p.fetch_size))
            seen = Observation()
            counted = sized_for_write(df, p.expected_rows).observe(seen, F.count(F.lit(1)).alias("rows"))
            commit_snapshot(counted, p.target_table, root)
            rows, status, error = seen.get["rows"], "SUCCESS", None
        except Exception as e:  # noqa: BLE001 - the error is the result
            rows, status, error = 0, "FAILED", str(e)
        took = time.monotonic() - began
        results.append((p.process_id, status, rows, took, rows / took if took else 0.0, error))
    return spark.createDataFrame(results, RESULT_SCHEMA)


def summarize(results: DataFrame) -> DataFrame:
    """Totals of a batch."""
    return results.agg(
        F.count(F.lit(1)).alias("total_processes"), F.count_if(F.col("status") == "SUCCESS").alias("success_count"),
        F.count_if(F.col("status") == "FAILED").alias("failed_count"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
    )
