"""Bronze rows: clean names, technical columns, row hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ntz

# The eight technical columns and the marker that stands for NULL in keys and hashes.
TECHNICAL_COLUMNS = (
    "_ingestion_ts", "_batch_id", "_source_table", "_op", "_watermark_col", "_watermark_value", "_row_hash",
    "_is_deleted",
)
NULL_MARK = "∅"
KEY_SEPARATOR = "␟"


def clean_names(df: DataFrame) -> DataFrame:
    """Drop blanks and turn ``-`` and ``.`` into ``_``; two names that become equal are an error."""
    names = [n.replace(" ", "").replace("-", "_").replace(".", "_") for n in df.columns]
    folded = [n.lower() for n in names]
    clash = sorted({n for n in folded if folded.count(n) > 1})
    if clash:
        raise ValueError(f"Column names collide after cleaning: {', '.join(clash)}")
    return df.toDF(*names)


def text_of(column: str, data_type: T.DataType) -> Column:
    """Stable text of a value: timestamps to the second, NULL as a marker that no value can equal."""
    value = F.col(f"`{column}`")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        value = F.date_trunc("second", value).cast(data_type)
    return escaped(value.cast("string"))


def escaped(text: Column) -> Column:
    """A part of a joined text: its length goes first, so that no separator or marker inside it can be mistaken."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit(NULL_MARK))


def hashed_columns(df: DataFrame, watermark: str | None = None, volatile: list[str] | None = None) -> list[str]:
    skip = {v.upper() for v in (volatile or [])} | ({watermark.upper()} if watermark else set())
    return [c for c in df.columns if not c.startswith("_") and c.upper() not in skip]


def row_hash(df: DataFrame, watermark: str | None = None, volatile: list[str] | None = None) -> Column:
    """md5 over the business columns; technical, volatile and watermark columns do not count."""
    cols = hashed_columns(df, watermark, volatile)
    if not cols:
        return F.lit(None).cast("string")
    return F.md5(F.concat_ws("|", *[text_of(c, df.schema[c].dataType) for c in cols]))


def key_text(columns: list[str]) -> Column:
    """Several key columns as one text value with NULLs kept apart."""
    return F.concat_ws(KEY_SEPARATOR, *[escaped(F.col(c).cast("string")) for c in columns])


def add_technical_columns(
    df: DataFrame, batch_id: str, source_table: str, ingested_at, watermark: str | None = None,
    volatile: list[str] | None = None, op: str = "UPSERT", hashed: bool = True,
) -> DataFrame:
    """The eight bronze columns in one projection."""
    null_text = F.lit(None).cast("string")
    known = bool(watermark) and watermark in df.columns
    return df.withColumns(
        {
            "_ingestion_ts": ntz(ingested_at),
            "_batch_id": F.lit(batch_id),
            "_source_table": F.lit(source_table),
            "_op": F.lit(op),
            "_watermark_col": F.lit(watermark) if watermark else null_text,
            "_watermark_value": F.col(watermark).cast("string") if known else null_text,
            "_row_hash": row_hash(df, watermark, volatile) if hashed else null_text,
            "_is_deleted": F.lit(False),
        }
    )


def add_full_refresh_columns(df: DataFrame, batch_id: str, source_table: str, ingested_at) -> DataFrame:
    """Technical columns of a full load: no watermark, no hash."""
    return add_technical_columns(df, batch_id, source_table, ingested_at, op="FULL_REFRESH", hashed=False)
