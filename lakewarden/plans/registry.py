"""Reports and filters over the dataset registry.

Input: datasets(dataset_id, dataset_name, project_id, area_id, source_type, execution_state, enable_incremental,
incremental_strategy, incremental_metadata, bronze_table, silver_table, created_at, updated_at, last_success_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any_case
from ..operators.contract import fingerprint
from ..operators.discovery import audit_rank
from ..operators.keyed import attach_group_values
from ..session import ntz, shift

# Columns a page may be sorted by, searched columns, name patterns per source type.
SORTABLE = (
    "dataset_name", "execution_state", "source_type", "project_id", "area_id", "created_at", "updated_at",
    "bronze_table", "silver_table", "current_schema_ver", "last_success_at",
)
SEARCHED = ("dataset_name", "bronze_table", "silver_table", "source_type", "project_id", "area_id")
ORACLE_NAME = r"^[A-Za-z0-9_@.$#]+$"
PLAIN_NAME = r"^[A-Za-z0-9_]+$"
METADATA_JSON = "struct<watermark_column:string,watermark_col:string,lookback_days:int,pk:array<string>>"


def search(datasets: DataFrame, term: str, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    return datasets.filter(contains_any_case(term, *[F.col(c) for c in columns if c in datasets.columns]))


def by_load_type(datasets: DataFrame, kind: str) -> DataFrame:
    """FULL, INCREMENTAL or SNAPSHOT, with NULLs read as "not incremental"."""
    on = F.coalesce("enable_incremental", F.lit(False))
    strategy = F.coalesce("incremental_strategy", F.lit(""))
    conditions = {"FULL": ~on, "INCREMENTAL": on & (strategy != "SNAPSHOT"), "SNAPSHOT": strategy == "SNAPSHOT"}
    return datasets.filter(conditions[kind])


def has_watermark(datasets: DataFrame, wanted: bool = True) -> DataFrame:
    found = F.coalesce(F.col("incremental_metadata").contains("watermark_column"), F.lit(False))
    return datasets.filter(found if wanted else ~found)


def stale(datasets: DataFrame, as_of, days: int) -> DataFrame:
    """No success for ``days`` days; a dataset that never succeeded is as old as its creation."""
    return datasets.filter(F.coalesce("last_success_at", "created_at") < shift(ntz(as_of), "DAY", -days))


def with_metadata(datasets: DataFrame) -> DataFrame:
    """Typed fields of the metadata JSON and the load type they imply."""
    on = F.coalesce("enable_incremental", F.lit(False))
    kind = F.when(~on, F.lit("FULL")).when(F.col("incremental_strategy") == "SNAPSHOT", F.lit("SNAPSHOT")).otherwise(F.lit("INCREMENTAL"))
    meta = datasets.withColumn("_m", F.from_json("incremental_metadata", METADATA_JSON))
    return meta.withColumns(
        {
            "watermark_column": F.coalesce("_m.watermark_column", "_m.watermark_col"),
            "lookback_days": F.col("_m.lookback_days"), "pk": F.col("_m.pk"), "load_kind": kind,
        }
    ).drop("_m")


def page(
    df: DataFrame, sort: str | None, descending: bool = True, number: int = 1, size: int = 50, tie: str = "dataset_id",
    sortable: tuple[str, ...] = SORTABLE, default: Column | None = None,
) -> DataFrame:
    """One page in a permitted order, NULLs last, ties by key."""
    column = F.col(sort) if sort in sortable else (default if default is not None else F.coalesce("updated_at", "created_at"))
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    return df.orderBy(order, tie).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint")
    )


def name_status(source_type: Column, name: Column) -> Column:
    """Whether a name has the characters its source type permits."""
    ok = F.when(source_type == "ORACLE", name.rlike(ORACLE_NAME)).otherwise(name.rlike(PLAIN_NAME))
    return F.when(ok, F.lit("VALID")).otherwise(F.lit("ERROR"))


def mark_duplicates(names: DataFrame, index: str, name: str) -> DataFrame:
    """Later occurrences of a name point to its first index."""
    keyed = names.withColumn("_u", F.upper(F.trim(F.col(name))))
    out = attach_group_values(keyed, ["_u"], [F.min(index).alias("first_index")])
    return out.drop("_u").withColumn("is_duplicate", F.col(index) > F.col("first_index"))


def stale_watermarks(watermarks: DataFrame, as_of, hours: int = 48) -> DataFrame:
    """Watermarks that have not advanced for too long; a per-dataset threshold column wins over ``hours``."""
    limit = F.lit(hours)
    if "watermark_stale_threshold_hours" in watermarks.columns:
        limit = F.col("watermark_stale_threshold_hours")
    age = F.timestamp_diff("SECOND", F.col("last_updated_at"), ntz(as_of))
    return watermarks.withColumn("stale_hours", F.floor(age / 3600).cast("bigint")).filter(age > limit * 3600)


def pending_approvals(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """Datasets with a PENDING contract version, next to their ACTIVE one."""
    pick = lambda status, prefix: versions.filter(F.col("status") == status).select(
        "dataset_id", F.col("schema_version").alias(f"{prefix}_version"),
        fingerprint(F.col("expect_schema_json")).alias(f"{prefix}_fingerprint"),
    )
    return (
        datasets.select("dataset_id", "dataset_name", "execution_state").join(pick("PENDING", "pending"), "dataset_id", "inner")
        .join(pick("ACTIVE", "active"), "dataset_id", "left")
    )


def ranked_names(columns: DataFrame, name: str) -> DataFrame:
    """Column names with update-like ones first: rank 1 UPDATE, 2 ALTERACAO, 3 the rest."""
    return columns.withColumn("name_rank", audit_rank(F.col(name)))

