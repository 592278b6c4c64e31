"""Rules over run logs, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status names that mean the same, and state names of the executing engine.
SUCCESS_NAMES = ("SUCCESS", "SUCCEEDED")
RUNNING_NAMES = ("RUNNING", "PENDING", "CLAIMED")
ENGINE_STATES = (
    ("PENDING", "QUEUED"), ("QUEUED", "QUEUED"), ("RUNNING", "RUNNING"), ("TERMINATING", "RUNNING"),
    ("TERMINATED", "SUCCEEDED"), ("SKIPPED", "CANCELLED"), ("INTERNAL_ERROR", "FAILED"),
)
TIER_WEIGHTS = (("T0", 4), ("T1", 3), ("T2", 2), ("T3", 1))


def _first_match(pairs: list[tuple[Column, str]], default: Column) -> Column:
    out = None
    for cond, label in pairs:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(default)


# --- errors -------------------------------------------------------------------------------------


def mask_variables(text: Column) -> Column:
    """Lower-case text with timestamps, long hex runs, numbers and blanks replaced by stable marks."""
    t = F.lower(text)
    t = F.regexp_replace(t, r"\d{4}-\d{2}-\d{2}t\d{2}:\d{2}:\d{2}(?:\.\d+)?z?", "<ts>")
    t = F.regexp_replace(t, r"[a-f0-9]{8,}", "<hex>")
    t = F.regexp_replace(t, r"\d+", "<num>")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def error_signature(code: Column, message: Column, frames: Column | None = None) -> Column:
    """A hash that is equal for errors that differ only in variable parts; ``frames`` is an array of stack frames."""
    blank = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    top = F.lit("") if frames is None else F.coalesce(F.array_join(F.slice(frames, 1, 3), "|"), F.lit(""))
    parts = [blank(code, "unknown_code"), blank(message, "unknown_message"), top]
    return F.concat(F.lit("sig_"), F.md5(F.concat_ws("|", *[mask_variables(p) for p in parts])))


def error_category(message: Column, error_class: Column) -> Column:
    """The first category whose words occur in message or class; NULL without any text."""
    m, c = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(error_class, F.lit("")))
    has = lambda *words: F.greatest(*[m.contains(w) for w in words], F.lit(False))
    return F.when((m == "") & (c == ""), F.lit(None).cast("string")).otherwise(
        _first_match(
            [
                (has("timeout") | c.contains("timeout"), "timeout"),
                (has("connection", "connect") | c.contains("connection"), "connection"),
                (has("schema", "column") | c.contains("schema"), "schema"),
                (has("permission", "access") | c.contains("auth"), "permission"),
                (has("memory", "oom") | c.contains("resource"), "resource"),
                (has("duplicate", "unique", "constraint"), "duplicate"),
            ],
            F.lit("other"),
        )
    )


def human_error(error_class: Column, message: Column) -> Column:
    """A plain class for a user: drift, cast, contract, source, runtime, else the message itself."""
    cls, msg = F.upper(F.coalesce(error_class, F.lit(""))), F.trim(F.coalesce(message, F.lit("")))
    low, schema = F.lower(msg), F.upper(F.coalesce(error_class, F.lit(""))) == "SCHEMA_ERROR"
    return _first_match(
        [
            (schema & (low.contains("drift") | low.contains("schema")), "SCHEMA_CHANGE_BLOCKED"),
            (schema & (low.contains("cast_invalid_input") | low.contains("invalid input")), "CAST_FAILURE"),
            (schema, "CONTRACT_FAILURE"),
            (cls == "SOURCE_ERROR", "SOURCE_READ_FAILURE"),
            (cls == "RUNTIME_ERROR", "EXECUTION_FAILURE"),
        ],
        F.coalesce(F.nullif(msg, F.lit("")), F.lit("UNKNOWN_ERROR")),
    )


def failure_speed(duration_ms: Column) -> Column:
    """immediate below 10 s, fast below 60 s, late above 600 s, else NULL; zero counts as unknown."""
    s = duration_ms / 1000.0
    return F.when(F.coalesce(duration_ms, F.lit(0)) == 0, F.lit(None).cast("string")).otherwise(
        F.when(s < 10, F.lit("immediate")).when(s < 60, F.lit("fast")).when(s > 600, F.lit("late"))
    )


# --- status -------------------------------------------------------------------------------------


def status_group(status: Column) -> Column:
    """succeeded, failed, running or other."""
    s = F.upper(F.coalesce(status, F.lit("")))
    return (
        F.when(s.isin(*SUCCESS_NAMES), F.lit("succeeded")).when(s == "FAILED", F.lit("failed"))
        .when(s.isin(*RUNNING_NAMES), F.lit("running")).otherwise(F.lit("other"))
    )


def point_status(status: Column) -> Column:
    """The status of one point of a sparkline; a claimed run is not yet running here."""
    s = F.upper(F.coalesce(status, F.lit("")))
    return (
        F.when(s.isin(*SUCCESS_NAMES), F.lit("success")).when(s == "FAILED", F.lit("failure"))
        .when(s.isin("RUNNING", "PENDING"), F.lit("running")).otherwise(F.lit("other"))
    )


def engine_status(engine_state: Column) -> Column:
    """The logged status an engine state stands for."""
    return _first_match([(engine_state == a, b) for a, b in ENGINE_STATES], F.lit("INCONSISTENT"))


def reconciled_status(engine_state: Column, logged_status: Column) -> Column:
    """Struct of the status to show, whether the two views disagree, and why."""
    mapped = engine_status(engine_state)
    unknown = mapped == "INCONSISTENT"
    revived = (logged_status == "ORPHANED") & mapped.isin("RUNNING", "QUEUED")
    behind = (logged_status == "RUNNING") & (mapped == "SUCCEEDED")
    differs = (mapped != logged_status) & (logged_status != "SUCCEEDED_WITH_ISSUES")
    return F.struct(
        mapped.alias("run_status"),
        F.when(unknown, F.lit(True)).when(revived, F.lit(False)).when(behind, F.lit(True)).otherwise(differs).alias("inconsistent"),
        F.when(unknown, F.lit("UNKNOWN_ENGINE_STATE")).when(revived, F.lit("RECONCILED_WITH_ACTIVE_ENGINE"))
        .when(behind, F.lit("LOG_BEHIND_ENGINE")).alias("reason"),
    )


def processing_type(operation: Column, load_type: Column) -> Column:
    """What a run did: its silver operation first, else its load type."""
    op, lt = F.upper(F.coalesce(operation, F.lit(""))), F.upper(F.coalesce(load_type, F.lit("")))
    return _first_match(
        [
            (op == "MERGE", "INCREMENTAL_CHANGES"), (op == "REPLACE_WHERE", "INCREMENTAL_WINDOW"), (op == "APPEND", "APPEND_HISTORY"),
            (op == "OVERWRITE", "FULL_REFRESH"), (lt == "INCREMENTAL", "INCREMENTAL_CHANGES"),
            (lt.isin("SNAPSHOT", "FULL"), "FULL_REFRESH"),
        ],
        F.coalesce(F.nullif(lt, F.lit("")), F.lit("UNKNOWN")),
    )


def result_fact(operation: Column, rows: Column, inserted: Column, updated: Column) -> Column:
    """One line about a run's result."""
    op = F.upper(F.coalesce(operation, F.lit("")))
    n = F.coalesce(rows, F.lit(0)).cast("string")
    ins, upd = F.coalesce(inserted, F.lit(0)), F.coalesce(updated, F.lit(0))
    merged = F.concat_ws(
        ", ",
        F.when(ins > 0, F.concat(ins.cast("string"), F.lit(" inserted"))),
        F.when(upd > 0, F.concat(upd.cast("string"), F.lit(" updated"))),
    )
    return (
        F.when(op == "OVERWRITE", F.lit("table replaced"))
        .when((op == "MERGE") & (ins <= 0) & (upd <= 0), F.lit("no changes"))
        .when(op == "MERGE", merged)
        .when(op == "APPEND", F.concat(n, F.lit(" added to history")))
        .when(op == "REPLACE_WHERE", F.lit("window replaced"))
        .otherwise(F.concat(n, F.lit(" rows")))
    )


# --- volume and risk ----------------------------------------------------------------------------


def half_up(value: Column) -> Column:
    """Rounding to a whole number with halves towards plus infinity."""
    return F.floor(value + 0.5).cast("bigint")


def change_percent(previous: Column, current: Column) -> Column:
    """Change in whole percent; NULL without a previous value or when it was zero."""
    return F.when(previous.isNotNull() & (previous != 0), half_up((current - previous) * 100.0 / previous))


def change_label(pct: Column) -> Column:
    text = F.concat(pct.cast("string"), F.lit("%"))
    return (
        F.when(pct.isNull(), F.lit("FIRST_RUN")).when(pct > 0, F.concat(F.lit("+"), text)).otherwise(text)
    )


def change_severity(pct: Column) -> Column:
    a = F.abs(pct)
    return F.when(pct.isNull() | (a <= 5), F.lit("normal")).when(a <= 20, F.lit("warning")).otherwise(F.lit("critical"))


def run_risk(status: Column, rows: Column, pct: Column, seconds: Column, previous_seconds: Column) -> Column:
    """The highest risk level any rule gives: none, low, medium or high."""
    s, n = F.upper(F.coalesce(status, F.lit(""))), F.coalesce(rows, F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    high = (s == "FAILED") | ((s == "SUCCEEDED") & (n == 0)) | yes(pct < -50)
    medium = yes(pct < -20) | yes(pct > 50)
    low = yes((previous_seconds > 0) & (seconds > previous_seconds * 2))
    return F.when(high, F.lit("high")).when(medium, F.lit("medium")).when(low, F.lit("low")).otherwise(F.lit("none"))


def near_miss(duration: Column, p95: Column, sample: Column, buffer_percent: float = 10) -> Column:
    """A run that took clearly longer than the baseline, when the baseline has at least ten runs."""
    return F.coalesce((sample >= 10) & (duration > p95 * (1 + buffer_percent / 100.0)), F.lit(False))


def attention_score(needs_attention: Column, near_miss_percent: Column, tier: Column) -> Column:
    """100 for runs that need attention, plus near-miss percent, plus ten per tier weight."""
    weight = F.lit(0)
    for name, w in reversed(TIER_WEIGHTS):
        weight = F.when(tier == name, F.lit(w)).otherwise(weight)
    return F.when(needs_attention, F.lit(100)).otherwise(F.lit(0)) + near_miss_percent + weight * 10


def guardrail_checks(
    status: Column, written: Column, dq_failures: Column, before: Column, after: Column, watermark_required: Column,
    volume_min: Column, volume_max: Column, dq_required: Column, silent_check: Column,
) -> dict[str, Column]:
    """PASS or FAIL for watermark progress, volume, data quality and silent failure."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    yes = lambda c: F.coalesce(c, F.lit(False))
    volume = F.coalesce(written, F.lit(0))
    moved = (blank(before) != "") & (blank(after) != "") & (blank(before) != blank(after))
    ok = {
        "watermark": ~yes(watermark_required) | moved,
        "volume": (volume >= F.coalesce(volume_min, F.lit(0))) & (volume_max.isNull() | (volume <= volume_max)),
        "dq": ~yes(dq_required) | (F.coalesce(dq_failures, F.lit(0)) == 0),
        "silent_failure": ~(yes(silent_check) & (status == "SUCCEEDED") & (volume == 0)),
    }
    return {k: F.when(F.coalesce(v, F.lit(False)), F.lit("PASS")).otherwise(F.lit("FAIL")) for k, v in ok.items()}


def guarded_status(status: Column, checks: dict[str, Column], mode: str = "monitor", enabled: bool = True) -> tuple[Column, Column]:
    """Final status and attention flag. ``enforce`` turns a success with a failed check into SUCCEEDED_WITH_ISSUES."""
    if not enabled:
        return status, F.lit(False)
    failed = F.greatest(*[c == "FAIL" for c in checks.values()])
    if mode == "monitor":
        return status, failed
    return F.when(failed & (status == "SUCCEEDED"), F.lit("SUCCEEDED_WITH_ISSUES")).otherwise(status), failed


def idempotency_key(*parts: Column) -> Column:
    """One key from workspace, job, run and attempt."""
    return F.concat_ws("|", *[p.cast("string") for p in parts])
