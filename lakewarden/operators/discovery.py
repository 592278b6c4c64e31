"""Finding out how a table can be loaded: volatile columns, watermark, key, strategy."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .bronze import key_text
from .keysearch import smallest_key

# Name lists and limits the suggestions are defined by.
VOLATILE_NAMES = (
    "UPDATED_AT", "LAST_MODIFIED", "MODIFIED_AT", "LAST_UPDATE",
    "LAST_ACCESS", "ACCESS_COUNT", "ACCESS_DATE", "LAST_LOGIN",
    "AUDIT_DATE", "AUDIT_USER", "AUDIT_TIMESTAMP",
    "LOG_DATE", "LOG_TIMESTAMP", "LOG_USER",
    "METADATA_UPDATE", "LAST_SYNC", "SYNC_DATE",
)
KEY_NAME_HINTS = (
    "ID", "CODIGO", "CD", "NR", "NUM", "CODE", "KEY", "SEQ",
    "IN_CODIGO", "CHAVE", "SK", "PK", "IDENT",
)
WATERMARK_NAMES = (
    "LAST_UPDATE_DATE", "UPDATED_AT", "DT_ALTERACAO", "DATA_ALTERACAO", "DATALT",
    "DT_ATUALIZACAO", "DATA_ATUALIZACAO", "TIMESTAMP_UPD", "DT_MODIFICACAO", "MODIFIED_AT",
    "DT_ULTIMA_ALTERACAO", "DATA_ULTIMA_ALTERACAO", "DT_ULT_ALTERACAO",
    "DATA_ULT_ATUALIZACAO", "DT_ULTIMA_ATUALIZACAO", "DT_ULT_ATUALIZACAO",
    "DATA_MODIFICACAO", "DATA_ULTIMA_MODIFICACAO", "LAST_MODIFIED_DATE",
    "LAST_UPDATED_DATE", "UPDATE_DATE", "MODIFY_DATE", "CHANGED_AT", "DT_CHANGE",
    "DATAINSERCAO", "DATA_INSERCAO", "CREATED_AT", "DT_INSERCAO", "DT_CRIACAO",
    "INSERT_DATE", "CREATION_DATE", "DT_CADASTRO", "DATA_CADASTRO",
    "DATA_INCLUSAO", "DT_INCLUSAO",
    "TIMESTAMP_COL", "TIMESTAMP", "DT_TIMESTAMP", "DATA_HORA",
    "DT_REGISTRO", "DATA_REGISTRO", "DT_PROCESSAMENTO", "DATA_PROCESSAMENTO",
)
WATERMARK_KEYWORDS = (
    "updated_at", "update_at", "dt_update", "dt_updated",
    "modified_at", "modify_at", "dt_modified", "dt_modify",
    "changed_at", "change_at", "dt_changed", "dt_change",
    "created_at", "create_at", "dt_created", "dt_create",
    "inserted_at", "insert_at", "dt_inserted", "dt_insert",
    "data_atualizacao", "dt_atualizacao", "data_alteracao",
    "data_modificacao", "data_criacao", "data_inclusao",
    "datalt", "dt_ultima_alteracao", "data_ultima_alteracao", "dt_ult_alteracao",
    "data_ult_atualizacao", "dt_ultima_atualizacao", "dt_ult_atualizacao",
    "data_ultima_modificacao", "last_update_date", "last_modified_date", "last_updated_date",
    "update_date", "modify_date", "dt_cadastro", "data_cadastro",
    "dt_inclusao", "dt_registro", "data_registro",
    "dt_processamento", "data_processamento",
    "timestamp", "dt_timestamp", "last_modified", "last_updated",
)
WATERMARK_PARTS = ("update", "modif", "alter", "ultima", "ult_", "atualizacao")
DATE_NAME_PARTS = ("date", "time", "dt", "created", "updated", "modified")
SKETCH_LOG = 12
SKETCH_ERROR = 6 * 1.04 / 2 ** (SKETCH_LOG / 2)  # six standard errors of the distinct sketch

_TIMELIKE = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NOT_KEYS = (T.BinaryType, T.ArrayType, T.MapType, T.StructType)


def volatile_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.upper() in VOLATILE_NAMES]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _TIMELIKE)]


def audit_watermark(df: DataFrame) -> str | None:
    """The first column on the audit name list; update-like names come before alteration-like ones."""
    found = [c for c in df.columns if c.upper() in WATERMARK_NAMES]
    return min(found, key=lambda c: _audit_rank(c), default=None)


def _audit_rank(name: str) -> int:
    up = name.upper()
    return 1 if "UPDATE" in up else 2 if "ALTERACAO" in up else 3


def audit_rank(name: Column) -> Column:
    """The same ranking as a column, for lists of column names."""
    up = F.upper(name)
    return F.when(up.contains("UPDATE"), 1).when(up.contains("ALTERACAO"), 2).otherwise(3)


def suggest_watermark(df: DataFrame, configured: str | None = None) -> tuple[str | None, str | None]:
    """A watermark column and the reason: already configured, known name, partial name, first date column."""
    if configured and configured in df.columns:
        return configured, "already_configured"
    dates = date_columns(df)
    by_name = {c.lower(): c for c in dates}
    for word in WATERMARK_KEYWORDS:
        if word in by_name:
            return by_name[word], "name_pattern"
    for c in dates:
        if any(part in c.lower() for part in WATERMARK_PARTS):
            return c, "partial_match"
    return (dates[0], "first_date_column") if dates else (None, None)


def distinct_estimate(value: Column) -> Column:
    """Distinct non-NULL values from a sketch (about 2% error). The sketch is one binary buffer, so a pass may hold
    hundreds of them for a wide table."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), F.lit(SKETCH_LOG))), F.lit(0))


def column_profile(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """Rows, distinct values and NULLs per column in one pass, with the watermark fitness test.

    Sketches keep the pass free of a shuffle of values. With ``exact`` each column's values are counted by a scan of that column
    alone: in one pass every row would be repeated per column. Stage a table that is expensive to compute first.
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        aggs.append(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{c}"))
        if not exact:
            aggs.append(distinct_estimate(F.col(f"`{c}`")).alias(f"d_{c}"))
    one = df.agg(*aggs)
    if exact and columns:
        each = [df.agg(F.count_distinct(F.col(f"`{c}`")).alias("d")).select(F.lit(i).alias("i"), "d") for i, c in enumerate(columns)]
        counts = reduce(DataFrame.union, each).agg(*[F.max(F.when(F.col("i") == i, F.col("d"))).alias(f"d_{c}") for i, c in enumerate(columns)])
        one = one.crossJoin(counts)
    return _profile_rows(one, columns, 1)


def _profile_rows(one: DataFrame, columns: list[str], scale: int) -> DataFrame:
    ratio = lambda c: F.coalesce(F.try_divide(c.cast("double"), F.col("_rows")), F.lit(0.0))
    items = []
    for c in columns:
        distinct, nulls = F.col(f"`d_{c}`"), F.col(f"`n_{c}`")
        fit = (F.col("_rows") > 0) & (ratio(distinct) > 0.01) & (ratio(nulls) < 0.5)
        items.append(
            F.struct(
                F.lit(c).alias("column_name"), (F.col("_rows") * scale).alias("total_rows"),
                (distinct * scale).alias("distinct_values"), (nulls * scale).alias("null_values"),
                F.round(ratio(distinct), 6).alias("distinct_ratio"), F.round(ratio(nulls), 6).alias("null_ratio"),
                fit.alias("fits_watermark"),
            )
        )
    return one.select(F.inline(F.array(*items)))


def sampled_profile(df: DataFrame, columns: list[str], seed: int = 7) -> DataFrame:
    """The profile from a 1% sample, scaled by 100."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        aggs += [distinct_estimate(F.col(f"`{c}`")).alias(f"d_{c}"), F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{c}")]
    return _profile_rows(df.select(*columns).sample(0.01, seed=seed).agg(*aggs), columns, 100)


def watermark_fits(df: DataFrame, column: str) -> bool:
    """Fitness by profile; a date or timestamp column is accepted even when the profile says no."""
    if isinstance(df.schema[column].dataType, _TIMELIKE):
        return True
    row = column_profile(df, [column]).collect()[0]
    return bool(row.fits_watermark)


def uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """Total, distinct and duplicate counts of a key. In a key of several columns NULL is a value of its own; the NULLs of
    a single column are not counted as a value, as in a plain distinct count."""
    text = F.col(keys[0]).cast("string") if len(keys) == 1 else key_text(keys)
    one = df.select(text.alias("k")).agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct("k").alias("distinct_rows"))
    return one.withColumn("duplicate_count", F.col("total_rows") - F.col("distinct_rows")).withColumn(
        "is_unique", F.col("duplicate_count") == 0
    )


def duplicated_keys(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The most repeated keys; ties are ordered by key."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("dup_count")).filter("dup_count > 1")
    return counted.orderBy(F.desc("dup_count"), *keys).limit(n)


def duplicated_hashes(df: DataFrame, hash_column: str = "_row_hash") -> DataFrame:
    """Row hashes held by more than one row."""
    return df.groupBy(hash_column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def date_ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Minimum, maximum and row count of every date-like column in one pass."""
    cols = columns or [c for c in df.columns if any(p in c.lower() for p in DATE_NAME_PARTS)]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in cols:
        aggs += [F.min(f"`{c}`").alias(f"lo_{c}"), F.max(f"`{c}`").alias(f"hi_{c}")]
    items = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"`lo_{c}`").cast("string").alias("min_value"),
            F.col(f"`hi_{c}`").cast("string").alias("max_value"), F.col("_rows").alias("total_rows"),
        )
        for c in cols
    ]
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def preview_columns(
    df: DataFrame, primary_key: list[str] | None = None, rows: int = 20, order: list[str] | None = None,
) -> DataFrame:
    """Each column with type, up to three sample values of the first rows, and date and key flags."""
    names = [c for c in df.columns if c != "_watermark_value"]
    picked = df.select(*[f"`{c}`" for c in names])
    head = (picked.orderBy(*order) if order else picked).limit(rows)
    samples = head.agg(*[F.slice(F.collect_list(F.col(f"`{c}`").cast("string")), 1, 3).alias(c) for c in names])
    dates, keys = set(date_columns(df)), set(primary_key or [])
    items = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias("type"),
            F.col(f"`{c}`").alias("sample_values"), F.lit(c in dates).alias("is_date"), F.lit(c in keys).alias("is_pk"),
        )
        for c in names
    ]
    return samples.select(F.inline(F.array(*items)))


def preview_latest(df: DataFrame, order_column: str | None, limit: int = 50, tie: list[str] | None = None) -> DataFrame:
    """The latest rows by the contract's order column."""
    if order_column not in df.columns:
        return df.limit(limit)
    return df.orderBy(F.col(order_column).desc(), *(tie or [])).limit(limit)


# --- key discovery ------------------------------------------------------------------------------


@dataclass(frozen=True)
class KeyFinding:
    columns: tuple[str, ...] = ()
    source: str | None = None
    confidence: float = 0.0
    method: str | None = None
    verified_full: bool = False
    verified_no_duplicate: bool = False
    tested: int = 0
    rows: int = 0


def eligible_key_columns(df: DataFrame, watermarks: list[str] | None = None) -> list[T.StructField]:
    skip = {w.upper() for w in (watermarks if watermarks is not None else WATERMARK_NAMES)} | set(VOLATILE_NAMES)
    return [
        f for f in df.schema.fields
        if not isinstance(f.dataType, (*_NOT_KEYS, *_TIMELIKE)) and f.name.upper() not in skip and not f.name.startswith("_")
    ]


def key_rank(name: str, data_type: T.DataType, required: bool, distinct: int | None, rows: int) -> float:
    """How promising a column is: cardinality, name, required, type."""
    score = 100.0 * distinct / rows if distinct is not None and rows else 0.0
    if any(h in name.upper() for h in KEY_NAME_HINTS):
        score += 20
    if required:
        score += 15
    if isinstance(data_type, T.NumericType):
        score += 10
    elif isinstance(data_type, T.StringType):
        score += 5
    return score


def discover_key(
    df: DataFrame, declared: list[str] | None = None, watermarks: list[str] | None = None, rows: int | None = None,
    required: list[str] | None = None,
) -> KeyFinding:
    """A minimal key for a table without a constraint, found on the whole table.

    A declared key wins. Otherwise the smallest key among the eligible columns, and of several of one size the first in the order
    of their columns' promise, is searched by hitting sets (``keysearch``): candidates are refuted by rows that agree on
    them, and the one returned was confirmed by an exact aggregate over all rows. A table whose rows repeat has none.
    The eligible columns are staged, so that the table is read, or computed, once.
    """
    if declared:
        return KeyFinding(tuple(declared), "CONSTRAINT", 1.0, "declared", rows=rows or 0)
    fields = eligible_key_columns(df, watermarks)
    if not fields:
        return KeyFinding()
    texts = {f.name for f in fields if isinstance(f.dataType, T.NullType)}  # files have no columns without a type
    df = stage(df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if f.name in texts else F.col(f"`{f.name}`") for f in fields]))
    sketch = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[distinct_estimate(F.col(f"`{f.name}`")).alias(f"d{i}") for i, f in enumerate(fields)],
        *[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"z{i}") for i, f in enumerate(fields)],
    ).collect()[0]
    total = sketch["_rows"]
    must = {c.upper() for c in (required or [])}
    distinct = {f.name: sketch[f"d{i}"] for i, f in enumerate(fields)}
    filled = {f.name: sketch[f"z{i}"] == 0 or f.name.upper() in must for i, f in enumerate(fields)}
    ranked = sorted(fields, key=lambda f: key_rank(f.name, f.dataType, filled[f.name], distinct[f.name], total), reverse=True)
    names = [f.name for f in ranked]
    bounds = [distinct[c] * (1 + SKETCH_ERROR) + 1 for c in names]  # NULL may be one more value
    key, tested = smallest_key(df, names, bounds, total)
    if key is None:
        return KeyFinding(tested=tested, rows=total)
    chosen = tuple(names[i] for i in key)
    score = 0.60 + 0.10
    if all(filled[c] for c in chosen):
        score += 0.15
    if all(distinct[c] / total > 0.8 for c in chosen):
        score += 0.10
    method = "single_col" if len(chosen) == 1 else f"combo_{len(chosen)}col"
    return KeyFinding(chosen, "CANDIDATE_DISCOVERY", round(min(score, 0.99), 2), method, True, True, tested, total)


# --- strategy -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Strategy:
    name: str
    reason: str
    metadata: dict = field(default_factory=dict)


def decide_strategy(
    watermark: str | None, watermark_valid: bool, key: KeyFinding, rows: int | None = None, volatile: list[str] | None = None,
) -> Strategy:
    """How to load a table: WATERMARK, HASH_MERGE or SNAPSHOT.

    Watermark fitness and key confidence decide alone. The row count is only recorded: a table does not change how
    it is loaded by growing, and no full read is ever appended, which would collect duplicates.
    """
    meta: dict = {"table_size_rows": rows}
    if key.columns:
        meta |= {"pk": list(key.columns), "pk_source": key.source, "pk_confidence": key.confidence}
    if watermark and watermark_valid:
        meta |= {"watermark_column": watermark, "hash_exclude_cols": list(volatile or [])}
        return Strategy("WATERMARK", "Auto-discovery selected WATERMARK", meta)
    sure = bool(key.columns) and key.confidence >= 0.90
    if sure:
        meta["hash_exclude_cols"] = list(volatile or [])
        return Strategy("HASH_MERGE", "Auto-discovery selected HASH_MERGE", meta)
    if key.columns:
        return Strategy("SNAPSHOT", f"PK candidate found but confidence too low ({key.confidence})", meta)
    return Strategy("SNAPSHOT", "No PK and no reliable timestamp column", meta)


def decide_strategy_column(watermark_valid: Column, key_confidence: Column) -> Column:
    """The same decision for many tables at once, as a column; NULL confidence means no key."""
    return F.when(watermark_valid, F.lit("WATERMARK")).when(key_confidence >= 0.90, F.lit("HASH_MERGE")).otherwise(F.lit("SNAPSHOT"))


def discover(df: DataFrame, declared_key: list[str] | None = None, watermark: str | None = None) -> Strategy:
    """Watermark, key and strategy of a table in one call."""
    mark = watermark or audit_watermark(df)
    key = discover_key(df, declared_key)
    rows = key.rows or df.count()
    return decide_strategy(mark, bool(mark) and watermark_fits(df, mark), key, rows, volatile_columns(df))
