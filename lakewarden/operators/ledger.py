"""Control tables to which entries are only appended, so that loads running side by side never lose one another's.

The current value of a key is its newest entry. Every append is a partition of its own, named by its day, and is written in dynamic
overwrite mode, in which Spark stages each job's files apart: writers don't meet. ``fold`` keeps the newest entry per key of days
gone by and rewrites or drops only their partitions, so it never touches what others are adding.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commit
from .keyed import top_per_key

ENTRY = "entry"


def day_of(as_of) -> str:
    return str(datetime.fromisoformat(str(as_of)).date())


def append(rows: DataFrame, table: str, root: str, as_of) -> None:
    """Add entries made at ``as_of``; writers of one ledger may run at once, once the table exists."""
    commit.commit_partitions(rows.withColumn(ENTRY, F.lit(f"{day_of(as_of)}.{uuid.uuid4().hex}")), table, root, ENTRY, plain=True)


def entries(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """All entries of a ledger; none if nothing was ever appended."""
    return spark.table(table) if spark.catalog.tableExists(table) else spark.createDataFrame([], f"{schema}, {ENTRY} string")


def current(rows: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """The first entry per key in the order ``newest``."""
    return top_per_key(rows, keys, newest).drop("_rn", ENTRY)


def fold(spark: SparkSession, table: str, root: str, keys: list[str], newest: list[Column], before) -> int:
    """Keep only the newest entry per key among the days before ``before``; the number of entries dropped."""
    old = [e for e in commit.partition_values(spark, table, ENTRY) if e < day_of(before)]
    if not old:
        return 0
    rows = spark.table(table).filter(F.col(ENTRY).isin(old))
    count = rows.count()
    kept = commit.commit_partitions(top_per_key(rows, keys, newest).select(*rows.columns), table, root, ENTRY, touched=old, plain=True)
    return count - kept.rows
