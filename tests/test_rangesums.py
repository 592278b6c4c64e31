"""Reconciliation by range checksums against the plain comparisons."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import rangesums, reconcile


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(rangesums, "FAN", 8)
    monkeypatch.setattr(rangesums, "LEAF", 5)


def keys_of(kind, n):
    if kind == "text":
        return [f"k{i:05d}é" for i in range(n)]
    return [datetime(2024, 1, 1) + timedelta(minutes=i) for i in range(n)] if kind == "time" else list(range(-n // 2, n // 2))


TYPES = {"number": "bigint", "text": "string", "time": "timestamp_ntz"}


@pytest.mark.parametrize("kind", list(TYPES))
@pytest.mark.parametrize("seed", range(3))
def test_equal_to_the_plain_comparisons(spark, small, kind, seed):
    rng = random.Random(seed)
    keys = keys_of(kind, 300)
    gone, new = set(rng.sample(keys, 4)), set(rng.sample(keys, 3))
    stored = [(k, rng.choice("ab"), rng.choice((True, False, None)) if rng.random() < 0.1 else False) for k in keys if k not in new]
    source = [(k, rng.choice("abc") if rng.random() < 0.02 else h) for k, h, _ in stored if k not in gone] + [(k, "n") for k in new]
    target = spark.createDataFrame(stored, f"k {TYPES[kind]}, _row_hash string, _is_deleted boolean")
    now = spark.createDataFrame(source, f"k {TYPES[kind]}, _row_hash string")
    assert rows(rangesums.missing_at_source(target, now, ["k"])) == rows(reconcile.missing_at_source(target, now, ["k"]))
    assert rows(rangesums.flag_deleted(target, now, ["k"]).select(*target.columns)) == rows(reconcile.flag_deleted(target, now, ["k"]).select(*target.columns))
    changes = rows(reconcile.detect_changes(now, target, ["k"]))
    assert rows(rangesums.detect_changes(now, target, ["k"])) == changes and changes


def test_equal_ranges_are_not_read(spark, small, tmp_path):
    """One change among 20,000 rows: a few rows are compared, and the bounds reach the scan."""
    path = str(tmp_path / "t")
    spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("h")).write.parquet(path)
    left = spark.read.parquet(path)
    right = left.withColumn("h", F.when(F.col("id") == 7_777, F.lit("x")).otherwise(F.col("h")))
    found = rangesums.compare(left, right, ["id"], ["h"])
    assert found.left_rows == found.right_rows == 20_000 and found.levels >= 3
    near = rangesums.within(left, "id", found.ranges)
    assert near.count() < 200 and near.filter("id = 7777").count() == 1
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id" in plan and "LessThan(id" in plan
    assert rangesums.compare(left, left, ["id"], ["h"]).ranges == []


def test_repeated_null_and_missing_rows_differ(spark, small):
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "k bigint")
    base = list(range(40))
    for other in ([*base, 7], [*base, 7, 7], base[:-1], [*base, None], [*base, 99], []):
        assert rangesums.compare(frame(*base), frame(*other), ["k"]).ranges
        assert rangesums.compare(frame(*other), frame(*base), ["k"]).ranges
    assert not rangesums.compare(frame(*base, None), frame(None, *base[::-1]), ["k"]).ranges
    assert not rangesums.compare(frame(), frame(), ["k"]).ranges


def test_one_key_with_most_rows_ends(spark, small):
    left = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 0)], "k int, j int")
    right = spark.createDataFrame([(1, i) for i in range(199)] + [(2, 0)], "k int, j int")
    found = rangesums.compare(left, right, ["k", "j"])
    assert found.ranges and rows(rangesums.missing_at_source(left, right, ["k", "j"])) == [(1, 199)]


def test_many_differing_ranges_are_joined(spark, small, monkeypatch):
    monkeypatch.setattr(rangesums, "MOST", 3)
    left = spark.range(400).select(F.col("id").alias("k"))
    right = left.filter("k % 100 <> 10")
    found = rangesums.compare(left, right, ["k"])
    assert 1 < len(found.ranges) <= 3 and rows(rangesums.missing_at_source(left, right, ["k"])) == sorted([(k,) for k in range(10, 400, 100)], key=repr)


def test_report(spark, small):
    left, right = spark.range(100), spark.range(90)
    got = rangesums.range_report(left, right, ["id"]).first()
    assert (got.source_count, got.target_count, got.difference, got.difference_pct, got.identical) == (100, 90, 10, 10.0, False)
    assert got.ranges >= 1 and 10 <= got.rows_in_ranges < 100
