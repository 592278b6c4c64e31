"""Session settings and small helpers that every module shares."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that matter at scale. Partition counts are left to adaptive execution, which merges small ones; the count it
# starts from belongs to the cluster and is an argument of ``configure``.
SCALE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder, initial_partitions: int | None = None) -> SparkSession.Builder:
    """Apply the scale settings to a session builder.

    ``initial_partitions`` is the number of shuffle partitions before adaptive execution merges small ones; on a
    cluster give about three per core, or what keeps a partition of the largest shuffle below some hundred MB.
    """
    if initial_partitions:
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(initial_partitions))
    for key, value in SCALE_SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def ntz(value) -> Column:
    """A timestamp without time zone, from text, ``datetime`` or a column."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    return F.lit(str(value)).cast("timestamp_ntz")


def shift(value: Column, unit: str, amount: int) -> Column:
    """``value`` moved by a fixed amount of DAY, HOUR, MINUTE or SECOND, keeping its type."""
    seconds = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}[unit.upper()] * amount
    return value + F.make_dt_interval(secs=F.lit(seconds))


def trunc_ntz(unit: str, value: Column) -> Column:
    """``date_trunc`` that stays a timestamp without time zone."""
    return F.date_trunc(unit, value).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole elapsed seconds."""
    return F.timestamp_diff("SECOND", start, end)


def millis_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    A session on one machine that has none gets a folder in its warehouse; on a cluster the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return path.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that a lost executor does not repeat an expensive read."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder in columns and read back: computed once, and later scans read only the columns they use."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
