"""Keys by hitting sets against plain searches through all column sets."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import discovery, keysearch


def plain_hitting_set(masks, reach, least):
    for size in range(1, len(reach) + 1):
        for s in itertools.combinations(range(len(reach)), size):
            product = 1.0
            for c in s:
                product *= reach[c]
            if product >= least and all(any(m >> c & 1 for c in s) for m in masks):
                return s
    return None


@pytest.mark.parametrize("seed", range(40))
def test_smallest_hitting_set_equals_all_sets(seed):
    rng = random.Random(seed)
    width = rng.randrange(2, 10)
    masks = keysearch.minimal({sum(1 << c for c in range(width) if rng.random() < rng.choice((0.2, 0.5))) or 1 for _ in range(rng.randrange(0, 25))})
    reach, least = [float(rng.choice((1, 2, 3, 50))) for _ in range(width)], rng.choice((1.0, 5.0, 100.0))
    assert keysearch.smallest_hitting_set(masks, reach, least) == plain_hitting_set(masks, reach, least)


def test_minimal_masks():
    assert keysearch.minimal({0b11, 0b1, 0b110, 0b111, 0b10100}) == [0b1, 0b110, 0b10100]


def plain_key(rows, width):
    for size in range(1, width + 1):
        for s in itertools.combinations(range(width), size):
            if len({tuple(r[c] for c in s) for r in rows}) == len(rows):
                return s
    return None


@pytest.mark.parametrize("seed", range(6))
def test_smallest_key_equals_all_sets(spark, seed):
    """Random tables with NULLs, in which several keys of one size hold; the first in the order of the columns counts."""
    rng = random.Random(seed)
    width, some = rng.randrange(3, 8), rng.choice((2, 3, 5))
    rows = {tuple(rng.choice([None, *range(some)]) for _ in range(width)) for _ in range(rng.choice((20, 60)))}
    rows = list(rows) * (2 if seed == 5 else 1)
    names = [f"c{i}" for i in range(width)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    distinct = [float(len({r[i] for r in rows})) for i in range(width)]
    assert keysearch.smallest_key(df, names, distinct, len(rows))[0] == plain_key(rows, width)


def twelve_of_fourteen(spark):
    """4,096 rows whose key has twelve of fourteen columns of two or three values."""
    bits = [(F.floor(F.col("id") / 2**i) % 2).cast("int").alias(f"b{i}") for i in range(12)]
    return spark.range(4096).select((F.col("id") % 3).cast("int").alias("x0"), *bits, F.hash("id").bitwiseAND(F.lit(1)).alias("x1"))


def test_wide_key_in_tens_of_scans(spark):
    """Level by level this would go through 8,177 column sets."""
    found = discovery.discover_key(twelve_of_fourteen(spark))
    assert len(found.columns) <= 12 and found.tested < 60
    df = twelve_of_fourteen(spark)
    assert df.select(*found.columns).distinct().count() == 4096


def test_sixty_columns_with_a_key_of_five(spark):
    names = [f"n{i}" for i in range(55)]
    digits = [(F.floor(F.col("id") / 7**i) % 7).cast("int").alias(f"k{i}") for i in range(5)]
    df = spark.range(7**5).select(*[(F.floor(F.col("id") / 7 ** (i % 5)) % 7 % (2 + i % 3)).cast("int").alias(n) for i, n in enumerate(names)], *digits)
    found = discovery.discover_key(df)
    assert sorted(found.columns) == ["k0", "k1", "k2", "k3", "k4"] and found.tested < 60


def test_trial_on_a_share_of_the_values_changes_nothing(spark, monkeypatch):
    df = twelve_of_fourteen(spark)
    whole = discovery.discover_key(df)
    monkeypatch.setattr(keysearch, "TRIAL", 500)
    assert discovery.discover_key(df).columns == whole.columns
    assert discovery.discover_key(df.union(df.limit(1))).columns == ()


def test_no_rows_and_no_key(spark):
    assert discovery.discover_key(spark.range(0)).columns == ()
    one = spark.createDataFrame([(1, None), (1, None)], "a int, b int")
    assert discovery.discover_key(one).columns == ()


def test_a_computed_table_is_computed_once(spark):
    """Every pass of the search reads the staged columns; the rows are made once."""
    made = spark.sparkContext.accumulator(0)

    def count(row):
        made.add(1)
        return row

    rows = spark.sparkContext.parallelize([(i % 7, i % 11, i % 13) for i in range(1001)], 4).map(count)
    found = discovery.discover_key(spark.createDataFrame(rows, "a int, b int, c int"))
    assert sorted(found.columns) == ["a", "b", "c"] and made.value == 1001


def test_columns_without_a_type_are_no_key(spark):
    df = spark.range(50).select(F.lit(None).alias("n"), F.col("id"))
    assert discovery.discover_key(df).columns == ("id",)
