"""Existing tables as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceError(RuntimeError):
    """The source cannot be read."""


def read_existing(spark: SparkSession, name: str) -> DataFrame:
    """A table that must exist."""
    if not spark.catalog.tableExists(name):
        raise SourceError(f"Source table does not exist: {name}")
    return spark.table(name)


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """A sample of the first rows, to check reachability."""
    return df.limit(n)


def estimate_rows(df: DataFrame, stated: int | None = None) -> DataFrame:
    """Existence and size before a scan: the stated statistics where given, else a count of the table's metadata columns."""
    if stated is not None:
        return df.sparkSession.range(1).select(F.lit(stated).cast("bigint").alias("row_estimate"), F.lit("STATS").alias("origin"))
    return df.agg(F.count(F.lit(1)).alias("row_estimate")).withColumn("origin", F.lit("COUNT"))


def existence_report(spark: SparkSession, names: list[str]) -> dict[str, bool]:
    return {n: spark.catalog.tableExists(n) for n in names}
