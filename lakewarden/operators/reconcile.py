"""Comparing a table with its source: deletes, changes, counts, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALERT_RATIO = 0.10


def flag_deleted(target: DataFrame, source_keys: DataFrame, keys: list[str]) -> DataFrame:
    """The target with ``_is_deleted`` set on active rows whose key no longer exists at the source.

    Both sides are joined on the executors; the missing keys never pass through the driver.
    """
    alive = source_keys.select(*keys).distinct().withColumn("_alive", F.lit(True))
    return target.join(alive, keys, "left").withColumn(
        "_is_deleted", F.coalesce("_is_deleted", F.lit(False)) | F.col("_alive").isNull()
    ).drop("_alive")


def missing_at_source(target: DataFrame, source_keys: DataFrame, keys: list[str]) -> DataFrame:
    """Active rows without a source row."""
    return target.filter(~F.coalesce("_is_deleted", F.lit(False))).join(source_keys.select(*keys), keys, "left_anti")


def delete_report(target: DataFrame, source_keys: DataFrame, keys: list[str], alert_ratio: float = ALERT_RATIO) -> DataFrame:
    """Deleted and active counts, their ratio and whether it is alarming, in one row."""
    alive = source_keys.select(*keys).distinct().withColumn("_alive", F.lit(True))
    active = target.filter(~F.coalesce("_is_deleted", F.lit(False))).select(*keys)
    counted = active.join(alive, keys, "left").agg(
        F.count_if(F.col("_alive").isNull()).alias("deleted_count"), F.count(F.lit(1)).alias("total_count")
    )
    ratio = F.coalesce(F.try_divide(F.col("deleted_count").cast("double"), F.col("total_count")), F.lit(0.0))
    return counted.withColumn("delete_ratio", F.round(ratio, 6)).withColumn("alert", ratio > alert_ratio)


def detect_changes(source: DataFrame, target: DataFrame, keys: list[str], hash_column: str = "_row_hash") -> DataFrame:
    """Source rows that are NEW or CHANGED against the target, with the kind in ``change``."""
    stored = target.select(*keys, F.col(hash_column).alias("_stored"), F.lit(True).alias("_known"))
    joined = source.join(stored, keys, "left")
    kind = F.when(F.col("_known").isNull(), F.lit("NEW")).when(
        F.col("_stored").isNull() | (F.col("_stored") != F.col(hash_column)), F.lit("CHANGED")
    )
    return joined.withColumn("change", kind).filter(F.col("change").isNotNull()).drop("_stored", "_known")


def count_report(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source and target row counts with difference and percentage."""
    s = source.agg(F.count(F.lit(1)).alias("source_count"))
    t = target.agg(F.count(F.lit(1)).alias("target_count"))
    both = s.unionByName(t, allowMissingColumns=True).agg(
        F.sum("source_count").alias("source_count"), F.sum("target_count").alias("target_count")
    )
    diff = F.col("source_count") - F.col("target_count")
    pct = F.coalesce(F.try_divide(diff * 100.0, F.col("source_count")), F.lit(0.0))
    return both.select(
        "source_count", "target_count", diff.alias("difference"), F.round(pct, 2).alias("difference_pct"),
        (diff == 0).alias("identical"),
    )


def last_name_part(column: str) -> Column:
    """The last part of a dotted name, in lower case."""
    return F.lower(F.element_at(F.split(F.col(column), r"\."), -1))


def orphan_tables(physical: DataFrame, physical_name: str, registry: DataFrame, registry_name: str) -> DataFrame:
    """Physical tables no registry entry points at, compared by last name part."""
    known = registry.select(last_name_part(registry_name).alias("_n")).distinct()
    return physical.withColumn("_n", last_name_part(physical_name)).join(known, "_n", "left_anti").drop("_n")


def orphan_items(items: DataFrame, owners: DataFrame, key: str, states: tuple[str, ...] = ("PENDING", "CLAIMED", "RUNNING")) -> DataFrame:
    """Unfinished items whose owner no longer exists; items without an owner are not orphans."""
    open_items = items.filter(F.col("status").isin(*states) & F.col(key).isNotNull())
    return open_items.join(owners.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


def flag_existing(candidates: DataFrame, name: str, registry: DataFrame, registry_name: str) -> DataFrame:
    """Candidates with ``already_registered``, compared without letter case."""
    known = registry.select(F.upper(registry_name).alias("_u")).distinct().withColumn("_known", F.lit(True))
    joined = candidates.withColumn("_u", F.upper(F.col(name))).join(known, "_u", "left")
    return joined.withColumn("already_registered", F.col("_known").isNotNull()).drop("_u", "_known")
