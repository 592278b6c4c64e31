"""Streams: continuous upsert, transition counts, replay removal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge
from ..session import shared_dir

LATE_BOUND = "3 days"


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def upsert_batch(
    table: str, keys: list[str], order_column: str, root: str, partition: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """The batch function of a continuous upsert. Repeating a batch gives the same table, so a retry is harmless.

    With a partition column only the partitions that the key index names are read, and only those that change are rewritten.
    """

    def write(batch: DataFrame, _epoch: int) -> None:
        merge.merge(batch, table, root, keys, partition, order_column, newest=True)

    return write


def upsert_stream(
    stream: DataFrame, table: str, keys: list[str], order_column: str, root: str, checkpoint: str, partition: str | None = None,
) -> StreamingQuery:
    """Bring arriving files into a keyed table and stop when all present files are processed."""
    return (
        stream.writeStream.foreachBatch(upsert_batch(table, keys, order_column, root, partition))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def as_event_time(df: DataFrame, column: str) -> DataFrame:
    """Event time as a timestamp with zone, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def transition_counts(stream: DataFrame, at: str = "created_at", late: str = LATE_BOUND, size: str = "1 minute") -> DataFrame:
    """Claims, starts and ends per minute; minutes older than the bound are final."""
    s = F.col("new_status")
    return (
        as_event_time(stream, at).withWatermark(at, late).groupBy(F.window(at, size).alias("w"))
        .agg(
            F.count_if(s == "CLAIMED").alias("claims"), F.count_if(s == "RUNNING").alias("starts"),
            F.count_if(s.isin("SUCCEEDED", "FAILED", "CANCELLED")).alias("ends"),
        )
        .select(F.col("w.start").alias("ts_min"), "claims", "starts", "ends")
    )


def without_replays(stream: DataFrame, keys: list[str], at: str, late: str = LATE_BOUND) -> DataFrame:
    """Each key once within the lookback; state older than the bound is dropped."""
    return as_event_time(stream, at).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to files and stop when all present input is processed."""
    return (
        df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A query's checkpoint folder below the cluster's shared checkpoint folder."""
    return f"{shared_dir(spark)}/streams/{name}"
