"""Space-filling order, pages and balanced reads against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import layout


def test_ranks_follow_the_values(spark):
    rnd = random.Random(1)
    values = [rnd.randrange(-500, 500) for _ in range(3000)] + [None, None]
    df = spark.createDataFrame([(v, f"k{v:+05d}" if v is not None else None) for v in values], "n int, t string")
    for column in ("n", "t"):
        rank = layout.rank_column(df, column)
        got = df.select(column, rank.alias("r")).distinct().collect()
        assert {r.r for r in got if r[0] is None} == {0} and max(r.r for r in got) < 2**layout.BITS
        known = sorted((r[0], r.r) for r in got if r[0] is not None)
        if column == "n":
            assert [r for _, r in known] == sorted(r for _, r in known) and len({r for _, r in known}) > 400


def test_z_values_interleave_bits(spark):
    rnd = random.Random(2)
    rows = [tuple(rnd.randrange(2**layout.BITS) for _ in range(3)) for _ in range(50)]
    got = spark.createDataFrame(rows, "a int, b int, c int").select("a", "b", "c", layout.z_value([F.col("a"), F.col("b"), F.col("c")]).alias("z")).collect()
    for r in got:
        bits = "".join(f"{r.a:010b}"[i] + f"{r.b:010b}"[i] + f"{r.c:010b}"[i] for i in range(layout.BITS))
        assert r.z == int(bits, 2)


@pytest.mark.parametrize("values", [[], [None], [5, 5, 5], list(range(40)) * 3 + [None] * 7])
def test_z_order_keeps_the_rows(spark, values):
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "a int, b int")
    assert sorted(map(str, layout.z_ordered(df, ["a", "b"], 3).collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("hot", [0, 300])
def test_every_page_equals_the_sorted_table(spark, descending, hot):
    """Ties, a value with most rows, and NULLs, over all pages and beyond the last."""
    rnd = random.Random(hot)
    rows = [(rnd.choice([None, *range(60)]), i) for i in range(200)] + [(7, 1000 + i) for i in range(hot)]
    df = spark.createDataFrame(rows, "v int, id int")
    directory = layout.PageDirectory.build(df, "v", ["id"], 8, descending)
    sign = -1 if descending else 1
    want = sorted(rows, key=lambda r: (r[0] is None, sign * (r[0] or 0), r[1]))
    size = 37
    got = [list(map(tuple, directory.page(df, n, size).collect())) for n in range(1, -(-len(rows) // size) + 2)]
    assert got[-1] == [] and [r for page in got for r in page] == want and {len(p) for p in got[:-2]} == {size}
    assert directory.page(df, 0, 5).count() == 0


def test_a_page_reads_its_ranges_only(spark, tmp_path):
    spark.range(10_000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    page = layout.PageDirectory.build(df, "id", [], 64).page(df, 300, 20)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id" in plan and "LessThan(id" in plan
    assert [r.id for r in page.collect()] == list(range(5980, 6000))


@pytest.mark.parametrize("values", [[], [None, None], [1], [3] * 50 + [None], [i**3 for i in range(500)], [f"o'{i % 90}" for i in range(400)]])
def test_each_row_meets_one_condition(spark, values):
    kind = "string" if values and isinstance(values[0], str) else "bigint"
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    conditions = layout.read_predicates("c", layout.quantile_bounds(df, "c", 6))
    parts = [df.filter(c).count() for c in conditions]
    assert sum(parts) == len(values) and len(conditions) <= 6
    if len(values) > 300:
        assert max(parts) * len(parts) <= 2 * len(values)


@pytest.mark.parametrize("first", [1, 9_000_000])
def test_balanced_read_of_large_keys(spark, tmp_path, first):
    """The cubes of keys above 2,097,151 are larger than any bigint; their order is kept."""
    from lakewarden.suite import layouts
    from lakewarden.suite.tables import Tables

    spark.range(first, first + 2000).select(F.col("id").alias("l_orderkey")).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = layouts.balanced_read(Tables(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in got] == [(8, True, 2000, 2000, True)]
