"""Column contracts: description, typed projection, audits, versions and change control."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = {"byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint"}
FRACTIONAL = {"float": "float", "double": "double"}
SPELLINGS = {"tinyint": "byte", "smallint": "short", "integer": "int", "bigint": "long", "timestamp_ntz": "timestamp"}
TYPE_NAMES = (
    "boolean", "byte", "short", "int", "long", "float", "double", "decimal", "string", "date", "timestamp", "binary",
)
TRANSFORMS = {"none": lambda c: c, "trim": F.trim, "upper": F.upper, "lower": F.lower}


class ContractError(ValueError):
    """The contract itself, or data checked against it, is not acceptable."""


def canonical_type(name: str) -> str:
    low = name.strip().lower()
    return SPELLINGS.get(low, low)


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    nullable: bool = True
    precision: int | None = None
    scale: int | None = None
    aliases: tuple[str, ...] = ()
    transform: str = "none"
    comment: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "type", canonical_type(self.type))
        if self.type not in TYPE_NAMES:
            raise ContractError(f"Unsupported type in contract: {self.type} ({self.name})")
        if self.type != "decimal" and (self.precision is not None or self.scale is not None):
            raise ContractError(f"Only decimal columns carry precision and scale ({self.name})")
        if self.precision is not None and not 1 <= self.precision <= 38:
            raise ContractError(f"Decimal precision out of range ({self.name})")
        if self.scale is not None and not 0 <= self.scale <= 38:
            raise ContractError(f"Decimal scale out of range ({self.name})")
        if self.transform not in TRANSFORMS:
            raise ContractError(f"Unknown transform {self.transform} ({self.name})")

    @property
    def ddl(self) -> str:
        """The Spark type as DDL text."""
        if self.type == "decimal":
            return f"decimal({self.precision or 38},{self.scale or 0})"
        return {**INTEGRAL, **FRACTIONAL}.get(self.type, self.type)


@dataclass(frozen=True)
class QualityRule:
    rule: str
    column: str
    params: dict = field(default_factory=dict, hash=False)

    def passes(self) -> Column:
        """True, false or NULL per row; NULL inputs only fail ``not_null``."""
        c = F.col(self.column)
        if self.rule == "not_null":
            return c.isNotNull()
        if self.rule == "in_set":
            return c.isin(list(self.params["values"]))
        if self.rule == "regex":
            return c.cast("string").rlike(self.params["pattern"])
        if self.rule == "min":
            return c >= F.lit(self.params["value"])
        if self.rule == "max":
            return c <= F.lit(self.params["value"])
        raise ContractError(f"Unknown rule {self.rule}")


@dataclass(frozen=True)
class Contract:
    dataset: str
    version: int
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...] = ()
    order_column: str | None = None
    watermark_column: str | None = None
    watermark_type: str | None = None
    quality_rules: tuple[QualityRule, ...] = ()

    def __post_init__(self):
        if not self.columns:
            raise ContractError("A contract needs at least one column")
        if self.primary_key and not self.order_column:
            raise ContractError("PRIMARY_KEY requires order_column")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, T.DataType.fromDDL(c.ddl), c.nullable) for c in self.columns])

    @staticmethod
    def parse(text: str | dict) -> "Contract":
        doc = json.loads(text) if isinstance(text, str) else text
        cols = []
        for item in doc["columns"]:
            dec = item.get("decimal") or {}
            if canonical_type(item["type"]) == "decimal" and not {"precision", "scale"} <= dec.keys():
                raise ContractError(f"decimal needs precision and scale ({item['name']})")
            cols.append(
                ColumnSpec(
                    item["name"], item["type"], bool(item.get("nullable", True)), dec.get("precision"),
                    dec.get("scale"), tuple(item.get("aliases", ())), item.get("transform", "none"),
                    item.get("comment"),
                )
            )
        mark = doc.get("watermark") or {}
        rules = tuple(QualityRule(r["rule"], r["column"], r.get("params") or {}) for r in doc.get("quality_rules", ()))
        return Contract(
            doc.get("dataset", ""), int(doc.get("version", 1)), tuple(cols), tuple(doc.get("primary_key") or ()),
            doc.get("order_column"), mark.get("column"), mark.get("type"), rules,
        )

    def to_json(self) -> str:
        cols = []
        for c in self.columns:
            item: dict = {"name": c.name, "type": c.type, "nullable": c.nullable}
            if c.type == "decimal":
                item["decimal"] = {"precision": c.precision or 38, "scale": c.scale or 0}
            cols.append(item)
        doc = {"dataset": self.dataset, "version": self.version, "columns": cols,
               "primary_key": list(self.primary_key), "order_column": self.order_column}
        if self.watermark_column:
            doc["watermark"] = {"column": self.watermark_column, "type": self.watermark_type or "string"}
        return json.dumps(doc, ensure_ascii=False)


# --- typed projection ---------------------------------------------------------------------------


def resolve_source(df: DataFrame, spec: ColumnSpec) -> str:
    """The first source column that exists among the contract name and its aliases."""
    present = {c.lower(): c for c in df.columns}
    for name in (spec.name, *spec.aliases):
        if name.lower() in present:
            return present[name.lower()]
    raise ContractError(f"MISSING_COLUMN: {spec.name}")


def _needs_text(source: T.DataType, spec: ColumnSpec) -> bool:
    """Whether the value has to pass through text to be cleaned; typed sources are cast directly."""
    if spec.transform != "none" or isinstance(source, T.StringType):
        return True
    if spec.type in INTEGRAL:
        return not isinstance(source, T.IntegralType)
    if spec.type in FRACTIONAL or spec.type == "decimal":
        return not isinstance(source, T.NumericType)
    if spec.type in ("date", "timestamp"):
        return not isinstance(source, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return spec.type == "boolean" and not isinstance(source, T.BooleanType)


def _prepared(df: DataFrame, spec: ColumnSpec) -> tuple[Column, str]:
    """The cleaned value before its cast, and the DDL type to cast to."""
    name = resolve_source(df, spec)
    source, value, target = df.schema[name].dataType, F.col(f"`{name}`"), spec.ddl
    if spec.type == "timestamp" and isinstance(source, T.TimestampNTZType):
        target = "timestamp_ntz"
    if spec.type in ("string", "binary"):
        return (TRANSFORMS[spec.transform](value.cast("string")) if spec.transform != "none" else value), target
    if not _needs_text(source, spec):
        return value, target
    text = TRANSFORMS[spec.transform](value.cast("string"))
    if spec.type == "boolean":
        text = F.lower(F.trim(text))
    elif spec.type in ("date", "timestamp"):
        text = F.trim(text)
    else:
        text = F.regexp_replace(text, r"\s+", "")
    return F.nullif(text, F.lit("")), target


def cast_to_contract(df: DataFrame, contract: Contract, check_nulls: bool = False) -> DataFrame:
    """Contract columns only, cleaned and cast; a value that cannot be cast fails the job.

    With ``check_nulls`` a NULL in a required column fails it too, in the same pass.
    """
    out = []
    for spec in contract.columns:
        value, target = _prepared(df, spec)
        typed = value.cast(target)
        if check_nulls and not spec.nullable:
            typed = F.when(typed.isNull(), F.raise_error(F.lit(f"NULLABILITY_VIOLATION: {spec.name}"))).otherwise(typed)
        out.append(typed.alias(spec.name))
    return df.select(*out)


def audit_casts(df: DataFrame, contract: Contract, keys: list[str]) -> DataFrame:
    """Values the cast would reject, one row each: keys, column, offending text. One narrow pass, no shuffle.

    Columns that already have the contract's type cannot fail and are left out.
    """
    cleaned, probes = [], []
    for i, spec in enumerate(contract.columns):
        value, target = _prepared(df, spec)
        if df.schema[resolve_source(df, spec)].dataType.simpleString() == target:
            continue
        cleaned.append(value.alias(f"_c{i}"))
        c = F.col(f"_c{i}")
        # A failing cast is slow, so each value is tried once: the probe keeps the text of a bad value or NULL.
        text = F.when(c.isNotNull() & c.try_cast(target).isNull(), c.cast("string"))
        probes.append(F.struct(F.lit(spec.name).alias("column_name"), text.alias("bad_value")))
    if not probes:
        empty = F.lit(None).cast("string")
        return df.filter(F.lit(False)).select(*keys, empty.alias("column_name"), empty.alias("bad_value"))
    tried = df.select(*keys, *cleaned).select(*keys, F.explode(F.array(*probes)).alias("_v"))
    return tried.filter(F.col("_v.bad_value").isNotNull()).select(*keys, "_v.column_name", "_v.bad_value")


def _unpivot_counts(one_row: DataFrame, labels: list[str], key: str, value: str) -> DataFrame:
    items = [F.struct(F.lit(n).alias(key), F.col(f"`{n}`").cast("bigint").alias(value)) for n in labels]
    return one_row.select(F.inline(F.array(*items)))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs per column, from one aggregation over only these columns."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    return _unpivot_counts(one, columns, "column_name", "null_count")


def nullability_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Required columns that hold NULLs."""
    required = [c.name for c in contract.columns if not c.nullable]
    return null_counts(df, required).filter("null_count > 0")


def assert_nullability(df: DataFrame, contract: Contract) -> None:
    if all(c.nullable for c in contract.columns):
        return
    bad = nullability_violations(df, contract).collect()
    if bad:
        raise ContractError("NULLABILITY_VIOLATION: " + ", ".join(r.column_name for r in bad))


def rule_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Violations per quality rule; every rule is counted in the same pass."""
    labelled = [(f"{r.rule}:{r.column}:{i}", r) for i, r in enumerate(contract.quality_rules)]
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(r.passes() == F.lit(False)).alias(n) for n, r in labelled]
    )
    items = [
        F.struct(
            F.lit(r.rule).alias("rule"), F.lit(r.column).alias("column_name"), F.col("_rows").alias("checked"),
            F.col(f"`{n}`").alias("violations"),
        )
        for n, r in labelled
    ]
    return one.select(F.inline(F.array(*items)))


def _kind(data_type: T.DataType) -> str:
    return canonical_type(data_type.simpleString().split("(")[0])


def structure_issues(df: DataFrame, contract: Contract) -> list[tuple[str, str]]:
    """MISSING_COLUMN, UNEXPECTED_COLUMN and TYPE_MISMATCH, read from the schema alone."""
    issues, seen = [], set()
    for spec in contract.columns:
        try:
            name = resolve_source(df, spec)
        except ContractError:
            issues.append(("MISSING_COLUMN", spec.name))
            continue
        seen.add(name)
        if _kind(df.schema[name].dataType) != spec.type:
            issues.append(("TYPE_MISMATCH", spec.name))
    extra = [c for c in df.columns if c not in seen and not c.startswith("_")]
    return issues + [("UNEXPECTED_COLUMN", c) for c in extra]


def validate_structure(df: DataFrame, contract: Contract) -> DataFrame:
    """All four validation findings as rows: issue, column, number of rows concerned."""
    known = {c.lower() for c in df.columns}
    required = [c.name for c in contract.columns if not c.nullable and c.name.lower() in known]
    counts = [F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in required]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *counts)
    row = lambda issue, name, n: F.struct(
        F.lit(issue).alias("issue"), F.lit(name).alias("column_name"), n.cast("bigint").alias("rows_affected")
    )
    items = [row(kind, name, F.col("_rows")) for kind, name in structure_issues(df, contract)]
    items += [row("NULLABILITY_VIOLATION", c, F.col(f"`{c}`")) for c in required]
    return one.select(F.inline(F.array(*items))).filter("rows_affected > 0 or issue <> 'NULLABILITY_VIOLATION'")


# --- inference and versions ---------------------------------------------------------------------


def infer_contract(
    df: DataFrame, dataset: str, primary_key: list[str] | None = None, watermark: str | None = None,
    order_column: str | None = None, version: int = 1,
) -> Contract:
    """A first contract from a table's schema, without technical columns."""
    cols = []
    for f in df.schema.fields:
        if f.name.startswith("_"):
            continue
        if isinstance(f.dataType, T.DecimalType):
            cols.append(ColumnSpec(f.name, "decimal", f.nullable, f.dataType.precision, f.dataType.scale))
        else:
            cols.append(ColumnSpec(f.name, _kind(f.dataType), f.nullable))
    types = {c.name: c.type for c in cols}
    mark_type = None
    if watermark:
        mark_type = "timestamp" if types.get(watermark) == "timestamp" else "string"
    order = order_column or (watermark if primary_key else None)
    return Contract(dataset, version, tuple(cols), tuple(primary_key or ()), order, watermark, mark_type)


def observed_contract(df: DataFrame) -> DataFrame:
    """Inferred columns with the nullability the data shows, from one aggregation."""
    fields = [f for f in df.schema.fields if not f.name.startswith("_")]
    one = df.agg(*[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f.name) for f in fields])
    items = [
        F.struct(
            F.lit(f.name).alias("column_name"), F.lit(_kind(f.dataType)).alias("contract_type"),
            (F.col(f"`{f.name}`") > 0).alias("nullable"),
        )
        for f in fields
    ]
    return one.select(F.inline(F.array(*items)))


CONTRACT_JSON = (
    "struct<columns:array<struct<name:string,type:string,nullable:boolean,"
    "decimal:struct<precision:int,scale:int>>>,primary_key:array<string>,order_column:string,"
    "watermark:struct<column:string,type:string>>"
)


def parse_contract_column(text: Column) -> Column:
    """Contract JSON as a typed struct."""
    return F.from_json(text, CONTRACT_JSON)


def fingerprint(text: Column) -> Column:
    """A hash of a contract's JSON that ignores column order and letter case of names, and reacts to
    name, type, nullability and key changes."""
    doc = parse_contract_column(text)
    lines = F.array_sort(
        F.transform(
            doc["columns"],
            lambda c: F.concat_ws(
                ":", F.lower(c["name"]), F.lower(c["type"]), F.coalesce(c["decimal"]["precision"].cast("string"), F.lit("")),
                F.coalesce(c["decimal"]["scale"].cast("string"), F.lit("")), c["nullable"].cast("string"),
            ),
        )
    )
    keys = F.array_sort(F.transform(F.coalesce(doc["primary_key"], F.array().cast("array<string>")), F.lower))
    return F.md5(F.concat(F.concat_ws(";", lines), F.lit("#"), F.concat_ws(";", keys)))


def _exploded(versions: DataFrame, status: str, prefix: str) -> DataFrame:
    """Columns of one version each, with names folded and precision in the type, as in ``fingerprint``."""
    digits = [F.col(f"c.decimal.{p}").cast("string") for p in ("precision", "scale")]
    decimals = F.coalesce(F.concat(F.lit("("), digits[0], F.lit(","), digits[1], F.lit(")")), F.lit(""))
    return (
        versions.filter(F.col("status") == status)
        .select("dataset_id", F.explode(parse_contract_column(F.col("expect_schema_json"))["columns"]).alias("c"))
        .select(
            "dataset_id", F.lower("c.name").alias("column_name"), F.concat(F.lower("c.type"), decimals).alias(f"{prefix}_type"),
            F.coalesce("c.nullable", F.lit(False)).alias(f"{prefix}_nullable"),
        )
    )


def contract_changes(versions: DataFrame) -> DataFrame:
    """Column changes between each dataset's ACTIVE and PENDING version; one column may change twice.

    Only datasets that have both versions are compared.
    """
    both = (
        versions.groupBy("dataset_id")
        .agg(F.count_if(F.col("status") == "ACTIVE").alias("a"), F.count_if(F.col("status") == "PENDING").alias("p"))
        .filter("a > 0 and p > 0").select("dataset_id")
    )
    old, new = _exploded(versions, "ACTIVE", "active"), _exploded(versions, "PENDING", "pending")
    pairs = old.join(new, ["dataset_id", "column_name"], "full").join(both, "dataset_id", "left_semi")
    kinds = F.array(
        F.when(F.col("active_type").isNull(), F.lit("ADD_COLUMN")),
        F.when(F.col("pending_type").isNull(), F.lit("REMOVE_COLUMN")),
        F.when(F.col("active_type") != F.col("pending_type"), F.lit("TYPE_CHANGE")),
        F.when(F.col("active_nullable") != F.col("pending_nullable"), F.lit("NULLABILITY_CHANGE")),
    )
    return pairs.select(
        "dataset_id", "column_name", F.explode(F.array_compact(kinds)).alias("change"),
        "active_type", "pending_type", "active_nullable", "pending_nullable",
    )


def change_summary(versions: DataFrame) -> DataFrame:
    """Changes per dataset and kind."""
    kind = lambda k: F.count_if(F.col("change") == k)
    return contract_changes(versions).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total"), kind("ADD_COLUMN").alias("added"), kind("REMOVE_COLUMN").alias("removed"),
        kind("TYPE_CHANGE").alias("type_changes"), kind("NULLABILITY_CHANGE").alias("nullability_changes"),
    )


def gate_changes(active: DataFrame, observed: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Decide what an observed contract means for each dataset.

    Equal fingerprints pass. A difference becomes a new PENDING version: bronze goes on, silver stops. A dataset
    without an ACTIVE version gets its first PENDING one. Where ``pending`` already holds the observed contract, its
    version is kept and none is proposed again. All inputs carry dataset_id and expect_schema_json; ``active`` and
    ``pending`` also schema_version.
    """
    a = active.select("dataset_id", "schema_version", fingerprint(F.col("expect_schema_json")).alias("active_fp"))
    o = observed.select("dataset_id", fingerprint(F.col("expect_schema_json")).alias("observed_fp"))
    changed = ~F.coalesce(F.col("active_fp") == F.col("observed_fp"), F.lit(False))
    joined, proposed = o.join(a, "dataset_id", "left"), F.coalesce(F.col("schema_version"), F.lit(0)) + 1
    if pending is not None:
        known = pending.select("dataset_id", fingerprint(F.col("expect_schema_json")).alias("observed_fp"), F.col("schema_version").alias("_known"))
        joined = joined.join(known.groupBy("dataset_id", "observed_fp").agg(F.min("_known").alias("_known")), ["dataset_id", "observed_fp"], "left")
        proposed = F.coalesce(F.col("_known"), proposed)
    return joined.select(
        "dataset_id", "active_fp", "observed_fp",
        F.when(changed, proposed).otherwise(F.col("schema_version")).cast("int").alias("schema_version"),
        F.when(changed, F.lit("PENDING")).otherwise(F.lit("ACTIVE")).alias("version_status"),
        F.when(changed, F.lit("BLOCKED_SCHEMA_CHANGE")).otherwise(F.lit("ACTIVE")).alias("execution_state"),
        F.lit(True).alias("bronze_allowed"), (~changed).alias("silver_allowed"),
    )


def assert_gate_open(gate: DataFrame, dataset_id: str) -> None:
    """Refuse a silver write for a dataset whose contract change is not approved yet."""
    closed = gate.filter((F.col("dataset_id") == dataset_id) & ~F.col("silver_allowed")).limit(1).collect()
    if closed:
        raise ContractError(f"SCHEMA_CHANGE_DETECTED: {dataset_id}")


def empty_table(spark: SparkSession, contract: Contract) -> DataFrame:
    """An empty DataFrame with the contract's types, to create a missing target."""
    return spark.createDataFrame([], contract.struct())
