"""The same writes on Delta tables, for clusters that have Delta installed.

Where the package is missing, ``commit.has_delta()`` is false and the table states of ``writes`` are
committed as ordinary tables instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .writes import one_per_key, require_keys


def merge_by_key(
    table: str, incoming: DataFrame, keys: list[str], order_column: str | None = None, hash_column: str | None = None,
) -> None:
    """Upsert by key; with a hash column only rows whose hash differs are updated."""
    from delta.tables import DeltaTable

    spark = incoming.sparkSession
    fresh = one_per_key(require_keys(incoming, keys), keys, order_column)
    if not spark.catalog.tableExists(table):
        fresh.write.format("delta").saveAsTable(table)
        return
    differs = f"t.{hash_column} IS NULL OR t.{hash_column} <> s.{hash_column}" if hash_column else None
    merge = DeltaTable.forName(spark, table).alias("t").merge(fresh.alias("s"), " AND ".join(f"t.`{k}` = s.`{k}`" for k in keys))
    merge.whenMatchedUpdateAll(condition=differs).whenNotMatchedInsertAll().execute()


def overwrite(incoming: DataFrame, table: str) -> None:
    incoming.write.format("delta").mode("overwrite").option("overwriteSchema", "true").saveAsTable(table)


def append(incoming: DataFrame, table: str, merge_schema: bool = True) -> None:
    incoming.write.format("delta").mode("append").option("mergeSchema", str(merge_schema).lower()).saveAsTable(table)


def replace_where(incoming: DataFrame, table: str, condition: str) -> None:
    """Replace the rows that satisfy a condition in one transaction."""
    writer = incoming.write.format("delta").mode("overwrite").option("replaceWhere", condition)
    writer.option("mergeSchema", "true").saveAsTable(table)


def optimize(spark: SparkSession, table: str, keys: list[str]) -> None:
    spark.sql(f"OPTIMIZE {table}" + (f" ZORDER BY ({', '.join(keys)})" if keys else ""))


def last_metrics(spark: SparkSession, table: str) -> DataFrame:
    """Inserted and updated rows of the latest merge, from the table's history."""
    history = spark.sql(f"DESCRIBE HISTORY {table}").filter("operation = 'MERGE'").orderBy("version", ascending=False).limit(1)
    return history.selectExpr(
        "cast(operationMetrics['numTargetRowsInserted'] as bigint) as inserted_count",
        "cast(operationMetrics['numTargetRowsUpdated'] as bigint) as updated_count",
    )
