"""Unit cases of the health rules."""

import pytest
from pyspark.sql import functions as F

from lakewarden.functions import health
from lakewarden.operators import incremental, keyed
from lakewarden.plans import runs


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).collect()[0]


def test_signature_is_equal_for_equivalent_errors(spark):
    frames = lambda *f: F.array(*[F.lit(x) for x in f])
    code = F.lit("FIELD_ABSENT")
    r = one(
        spark,
        a=health.error_signature(code, F.lit("Field c_17 absent since 2025-05-05T10:11:12Z"), frames("load.py:7", "main.py:31")),
        b=health.error_signature(code, F.lit("field c_9 absent  since 2025-06-01T00:00:00.5Z"), frames("load.py:12", "main.py:4")),
        c=health.error_signature(code, F.lit("Other"), frames("load.py:12")),
    )
    assert r.a == r.b != r.c


def test_state_reconciliation(spark):
    r = one(
        spark, late=health.reconciled_status(F.lit("TERMINATED"), F.lit("RUNNING")), odd=health.reconciled_status(F.lit("X"), F.lit("RUNNING")),
        back=health.reconciled_status(F.lit("RUNNING"), F.lit("ORPHANED")),
        kept=health.reconciled_status(F.lit("TERMINATED"), F.lit("SUCCEEDED_WITH_ISSUES")),
    )
    assert (r.late.run_status, r.late.inconsistent) == ("SUCCEEDED", True)
    assert (r.odd.run_status, r.odd.inconsistent) == ("INCONSISTENT", True)
    assert (r.back.run_status, r.back.inconsistent) == ("RUNNING", False)
    assert r.kept.inconsistent is False


def guard(spark, mode="enforce", enabled=True, dq_required=True, dq=1, volume_min=1, volume_max=1000):
    lit = F.lit
    none = lit(None).cast("bigint")
    checks = health.guardrail_checks(
        lit("SUCCEEDED"), lit(0), lit(dq), lit("2026-03-01"), lit("2026-03-01"), lit(True), lit(volume_min) if volume_min is not None else none,
        lit(volume_max) if volume_max is not None else none, lit(dq_required), lit(True),
    )
    final, attention = health.guarded_status(lit("SUCCEEDED"), checks, mode, enabled)
    return one(spark, final=final, attention=attention, **checks)


def test_guardrails_promote_a_success_with_failed_checks(spark):
    r = guard(spark)
    assert r.final == "SUCCEEDED_WITH_ISSUES" and r.attention
    assert [r.watermark, r.volume, r.dq, r.silent_failure] == ["FAIL"] * 4


def test_guardrails_monitor_keeps_status(spark):
    r = guard(spark, "monitor", dq_required=False, volume_min=None, volume_max=None)
    assert r.final == "SUCCEEDED" and r.attention and r.volume == "PASS"


def test_guardrails_enforce(spark):
    assert guard(spark, "enforce", dq_required=False, volume_min=None, volume_max=None).final == "SUCCEEDED_WITH_ISSUES"


def test_guardrails_off(spark):
    r = guard(spark, enabled=False)
    assert r.final == "SUCCEEDED" and not r.attention


def test_guardrails_off_reports_no_checks(spark, tables):
    r = tables.runs.withColumns({c: F.lit(None).cast("string") for c in ("watermark_before", "watermark_after")}).withColumns(
        {"records_written": F.lit(0), "dq_fail_count": F.lit(0)}
    )
    cfg = tables.jobs.select(
        "job_id", F.lit(True).alias("watermark_required"), F.lit(0).alias("volume_min"), F.lit(9).alias("volume_max"),
        F.lit(True).alias("dq_required"), F.lit(True).alias("silent_failure_check"),
    )
    assert not [c for c in runs.guardrail_report(r, cfg, "job_id", enabled=False).columns if c.startswith("check_")]


def test_baseline_and_near_miss(spark):
    df = spark.createDataFrame([("a", x) for x in (1000, 2000, 3000, 4000, 5000)], "k string, ms bigint")
    r = keyed.nearest_rank_percentiles(df, ["k"], "ms", {"p50": 50, "p95": 95}).collect()[0]
    assert (r.p50, r.p95, r.sample_size) == (3000, 5000, 5)
    r = one(spark, yes=health.near_miss(F.lit(300), F.lit(200), F.lit(11)), no=health.near_miss(F.lit(180), F.lit(200), F.lit(11)), few=health.near_miss(F.lit(300), F.lit(200), F.lit(9)))
    assert (r.yes, r.no, r.few) == (True, False, False)


def test_idempotency_key_and_overlap(spark):
    start, _ = incremental.collection_window(F.lit("2026-03-01 12:00:00").cast("timestamp_ntz"), F.lit(None), 15)
    r = one(spark, k=health.idempotency_key(F.lit("ws1"), F.lit("j1"), F.lit("r1"), F.lit(2)), s=start)
    assert r.k == "ws1|j1|r1|2"
    assert str(r.s) == "2026-03-01 11:45:00"


@pytest.mark.parametrize(
    "pct,label,severity", [(None, "FIRST_RUN", "normal"), (0, "0%", "normal"), (5, "+5%", "normal"), (-20, "-20%", "warning"), (21, "+21%", "critical")]
)
def test_volume_labels(spark, pct, label, severity):
    c = F.lit(pct).cast("bigint")
    r = one(spark, l=health.change_label(c), s=health.change_severity(c))
    assert (r.l, r.s) == (label, severity)


@pytest.mark.parametrize(
    "args,level",
    [
        (("FAILED", 5, 0, 1, 1), "high"), (("SUCCEEDED", 0, 0, 1, 1), "high"), (("SUCCEEDED", 5, -51, 1, 1), "high"), (("SUCCEEDED", 5, -21, 1, 1), "medium"),
        (("SUCCEEDED", 5, 51, 1, 1), "medium"), (("SUCCEEDED", 5, 0, 3, 1), "low"), (("SUCCEEDED", 5, None, 3, None), "none"),
    ],
)
def test_run_risk_levels(spark, args, level):
    s, n, pct, sec, prev = args
    big = lambda v: F.lit(v).cast("bigint")
    assert one(spark, r=health.run_risk(F.lit(s), big(n), big(pct), big(sec), big(prev))).r == level


@pytest.mark.parametrize("ms,speed", [(None, None), (0, None), (9_999, "immediate"), (59_000, "fast"), (60_000, None), (600_001, "late")])
def test_failure_speed(spark, ms, speed):
    assert one(spark, s=health.failure_speed(F.lit(ms).cast("bigint"))).s == speed
