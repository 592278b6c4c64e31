"""Percentiles from daily sketches against exact ones."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakewarden.operators.keyed import nearest_rank_percentiles
from lakewarden.plans import daily

POINTS = {"p50": 50, "p95": 95, "p99": 99}


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("aaab") if i % 50 else None, datetime(2024, 1, 1) + timedelta(hours=i % 1500), int(rnd.lognormvariate(9, 2)) if i % 9 else 77) for i in range(20_000)]
    rows += [("few", datetime(2024, 1, 5), 5), ("none", datetime(2024, 1, 5), None)]
    return spark.createDataFrame(rows, "k string, at timestamp_ntz, ms bigint")


@pytest.fixture(scope="module")
def stored(spark, log, tmp_path_factory):
    daily.store(daily.sketches(log, ["k"], "at", "ms"), "t_sketches", str(tmp_path_factory.mktemp("sketches")))
    return spark.table("t_sketches")


def rows(df):
    return sorted((tuple(r) for r in df.select("k", *POINTS, "sample_size").collect()), key=repr)


def test_exact_from_stored_days(log, stored):
    window = daily.merged(stored, ["k"])
    want = rows(nearest_rank_percentiles(log, ["k"], "ms", POINTS))
    assert rows(daily.exact_percentiles(log.select("k", "ms"), window, ["k"], "ms", POINTS, 1000)) == want


def test_a_sketch_that_is_wrong_is_noticed(log, stored):
    """Sketches of other values put the ranges elsewhere; the keys are then read in full."""
    off = daily.merged(daily.sketches(log.filter("k = 'a'").withColumn("ms", F.col("ms") * 0 + 3), ["k"], "at", "ms"), ["k"])
    want = rows(nearest_rank_percentiles(log, ["k"], "ms", POINTS))
    assert rows(daily.exact_percentiles(log.select("k", "ms"), off, ["k"], "ms", POINTS, 1000)) == want


def test_windows_of_days(log, stored):
    part = log.filter((F.col("at") >= "2024-01-10") & (F.col("at") < "2024-02-03"))
    guess = {r.k: r for r in daily.percentiles(daily.merged(stored, ["k"], "2024-01-10", "2024-02-02"), ["k"], POINTS).collect()}
    bounds = {f"{n}_{s}": p + d * 100 * daily.RANK_ERROR * 2 for n, p in POINTS.items() for s, d in (("lo", -1), ("hi", 1))}
    for r in nearest_rank_percentiles(part, ["k"], "ms", bounds).collect():
        assert guess[r.k].sample_size == r.sample_size
        assert all(r[f"{n}_lo"] <= guess[r.k][n] <= r[f"{n}_hi"] for n in POINTS)


def test_a_month_is_replaced_and_others_stay(spark, log, stored):
    before = stored.groupBy("month").agg(F.sum("n").alias("n")).collect()
    daily.store(daily.sketches(log.filter("at < '2024-02-01' and ms = 77"), ["k"], "at", "ms"), "t_sketches", "unused")
    after = {r.month: r.n for r in spark.table("t_sketches").groupBy("month").agg(F.sum("n").alias("n")).collect()}
    assert {r.month: r.n for r in before if r.month != "2024-01"} == {m: n for m, n in after.items() if m != "2024-01"}
    assert after["2024-01"] < dict(map(tuple, before))["2024-01"]
