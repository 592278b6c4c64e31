"""JDBC tables as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import cutoff_text
from ..operators.layout import read_predicates

# Fetch size and the schemas known from name prefixes.
FETCH_SIZE = 10_000
KNOWN_SCHEMAS = ("public", "auth", "storage", "extensions")


@dataclass(frozen=True)
class JdbcConnection:
    """Where a source is and how to talk to it. Secrets are passed in by the caller and never logged."""

    url: str
    driver: str
    user: str | None = None
    password: str | None = None
    options: dict = field(default_factory=dict, hash=False)

    def reader(self, spark: SparkSession, fetch_size: int = FETCH_SIZE):
        r = spark.read.format("jdbc").option("url", self.url).option("driver", self.driver).option("fetchsize", fetch_size)
        if self.user is not None:
            r = r.option("user", self.user).option("password", self.password or "")
        return r.options(**self.options)


@dataclass(frozen=True)
class Split:
    """Numeric bounds of a parallel read; used only when all four values are known."""

    column: str | None = None
    lower: int | None = None
    upper: int | None = None
    partitions: int | None = None

    @property
    def usable(self) -> bool:
        return bool(self.column) and None not in (self.lower, self.upper, self.partitions) and self.partitions > 1


def qualified_name(name: str, default_owner: str | None = None) -> str:
    """OWNER.TABLE[@LINK] with the default owner where none is given."""
    base, _, link = name.strip().partition("@")
    if "." not in base and default_owner:
        base = f"{default_owner}.{base}"
    return base + (f"@{link}" if link else "")


def prefixed_name(dataset: str) -> str:
    """schema.table from a name that starts with a known schema and an underscore; ``public`` otherwise."""
    schema, found, table = dataset.partition("_")
    return f"{schema}.{table}" if found and schema.lower() in KNOWN_SCHEMAS else f"public.{dataset}"


def as_subquery(table: str, alias: str = "src", where: str | None = None) -> str:
    condition = f" WHERE {where}" if where else ""
    return f"(SELECT * FROM {table}{condition}) {alias}"


def read_table(
    spark: SparkSession, conn: JdbcConnection, table: str, split: Split | None = None, fetch_size: int = FETCH_SIZE,
    subquery: bool = False, where: str | None = None,
) -> DataFrame:
    """A full table scan; parallel when bounds are given, wrapped as a sub-query for linked tables."""
    wrapped = subquery or where is not None or "@" in table
    reader = conn.reader(spark, fetch_size).option("dbtable", as_subquery(table, where=where) if wrapped else table)
    if split and split.usable:
        reader = (
            reader.option("partitionColumn", split.column).option("lowerBound", split.lower)
            .option("upperBound", split.upper).option("numPartitions", split.partitions)
        )
    return reader.load()


def bounds(spark: SparkSession, conn: JdbcConnection, table: str, column: str, partitions: int) -> Split:
    """Bounds for a parallel read, asked from the database in one row."""
    q = f"(SELECT MIN({column}) AS LO, MAX({column}) AS HI FROM {table}) b"
    row = conn.reader(spark).option("dbtable", q).load().collect()[0]
    return Split(column, None if row[0] is None else int(row[0]), None if row[1] is None else int(row[1]), partitions)


def read_balanced(spark: SparkSession, conn: JdbcConnection, table: str, column: str, bounds: list, fetch_size: int = FETCH_SIZE) -> DataFrame:
    """A parallel read cut at quantiles of a column, known from an earlier load of the table (``layout.quantile_bounds``): each
    reader gets about as many rows, however skewed the column is, and every row, NULLs too, comes once."""
    properties = {"driver": conn.driver, "fetchsize": str(fetch_size), **{k: str(v) for k, v in conn.options.items()}}
    if conn.user is not None:
        properties |= {"user": conn.user, "password": conn.password or ""}
    return spark.read.jdbc(conn.url, table, predicates=read_predicates(column, bounds), properties=properties)


def read_since(
    spark: SparkSession, conn: JdbcConnection, table: str, column: str, watermark: str | None, lookback_days: int = 3,
    split: Split | None = None,
) -> DataFrame:
    """Rows from watermark minus lookback on. The comparison is a plain filter, which Spark pushes into the source."""
    df = read_table(spark, conn, table, split)
    if not watermark:
        return df
    return df.filter(F.col(column) >= F.lit(cutoff_text(watermark, lookback_days)).cast(df.schema[column].dataType))


def primary_key_of(spark: SparkSession, conn: JdbcConnection, query: str) -> list[str]:
    """Declared key columns from a catalog query of the source (column name first, in key order); none if it has none."""
    return [r[0] for r in conn.reader(spark).option("dbtable", f"({query}) k").load().collect()]


def reachable(spark: SparkSession, conn: JdbcConnection, tables: list[str], rows: int = 5) -> DataFrame:
    """First rows of each table, to see whether it can be read: table, ok, rows seen, error."""
    out = []
    for t in tables:
        try:
            out.append((t, True, read_table(spark, conn, t).limit(rows).count(), None))
        except Exception as e:  # noqa: BLE001 - any driver error is the finding
            out.append((t, False, 0, str(e)))
    return spark.createDataFrame(out, "table_name string, ok boolean, rows_seen bigint, error string")
