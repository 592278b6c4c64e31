"""Skew-safe operators, name mapping and streams against plain definitions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakewarden.functions import compat, text
from lakewarden.operators import fuzzy, keyed
from lakewarden.plans import queue
from lakewarden.session import shift
from lakewarden.streaming import streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(5)}", f"2024-01-0{rnd.randrange(1, 6)} {rnd.randrange(24):02d}:{rnd.randrange(60):02d}:00", i, rnd.random() < 0.4) for i in range(600)]
    return spark.createDataFrame(data, "k string, t string, id int, ok boolean").withColumn("t", F.col("t").cast("timestamp_ntz"))


def test_carry_previous_is_one_window_per_key(events):
    got = keyed.carry_previous(events, ["k"], ["t", "id"], ["id"], when=F.col("ok"))
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = events.withColumn("prev_id", F.last(F.when(F.col("ok"), F.col("id")), ignorenulls=True).over(w))
    assert rows(got) == rows(want)


def test_number_rows_is_one_global_window(events):
    want = events.withColumn("rownum", F.row_number().over(Window.orderBy("t", "id")))
    for buckets in ([F.date_trunc("day", F.col("t"))], [F.col("t"), F.floor(F.col("id") / 10)]):
        got = keyed.number_rows(events, [F.col("t"), F.col("id")], buckets)
        assert rows(got.select("id", "rownum")) == rows(want.select("id", "rownum"))


def test_group_values_equal_a_window(events):
    got = keyed.attach_group_values(events, ["k"], [F.max("id").alias("m")])
    want = events.withColumn("m", F.max("id").over(Window.partitionBy("k")))
    assert rows(got) == rows(want)


def test_band_join_equals_the_definition(events):
    left = events.filter("ok").select("k", F.col("t").alias("start"), F.col("id").alias("lid"))
    low, high = shift(F.col("start"), "MINUTE", -45), shift(F.col("start"), "MINUTE", 45)
    got = keyed.within_band(left, events, ["k"], "t", low, high, 600).select("lid", "id")
    want = left.alias("l").join(events.alias("e"), (F.col("l.k") == F.col("e.k")) & F.col("e.t").between(low, high)).select("lid", "id")
    assert rows(got) == rows(want)


def test_percentiles_and_medians(spark):
    rnd = random.Random(3)
    data = [(f"g{rnd.randrange(3)}", rnd.randrange(1, 5000)) for _ in range(900)] + [("one", 7)]
    df = spark.createDataFrame(data, "g string, v bigint")
    got = {r.g: (r.p50, r.p95) for r in keyed.nearest_rank_percentiles(df, ["g"], "v", {"p50": 50, "p95": 95}, width=100).collect()}
    med = {r.g: r.median for r in keyed.medians(df, ["g"], "v", 100).collect()}
    for g in {g for g, _ in data}:
        vals = sorted(v for x, v in data if x == g)
        rank = lambda p: vals[max(0, min(len(vals) - 1, -(-p * len(vals) // 100) - 1))]
        assert got[g] == (rank(50), rank(95))
        assert med[g] == (vals[(len(vals) - 1) // 2] + vals[len(vals) // 2]) / 2


def test_latency_sketch_is_close(tables):
    exact, sketch = queue.latency(tables.queue, exact=True).collect()[0], queue.latency(tables.queue).collect()[0]
    for name in exact.asDict():
        assert abs(exact[name] - sketch[name]) <= 1000


# --- names --------------------------------------------------------------------------------------


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ca in a:
        nxt = [0]
        for j, cb in enumerate(b):
            nxt.append(row[j] + 1 if ca == cb else max(row[j + 1], nxt[-1]))
        row = nxt
    return row[-1]


def score(a, b):
    ta, tb = set(a.split("_")), set(b.split("_"))
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return 0.5 * 2 * lcs(a, b) / (len(a) + len(b)) + 0.3 * len(ta & tb) / len(ta | tb) + 0.2 * p / max(len(a), len(b))


def test_indel_ratio(spark):
    r = spark.range(1).select(fuzzy.indel_ratio(F.lit("kitten"), F.lit("sitting")).alias("a"), fuzzy.indel_ratio(F.lit(""), F.lit("")).alias("b"), fuzzy.similarity(F.lit("a_b_c"), F.lit("a_b_d")).alias("c")).collect()[0]
    assert round(r.a, 4) == 0.6154 and r.b == 1.0 and abs(r.c - score("a_b_c", "a_b_d")) < 1e-9


def test_common_subsequence_of_any_length(spark):
    """In 64-bit words up to 62 characters of the shorter text, by rows beyond."""
    rnd = random.Random(4)
    text_of = lambda n: "".join(rnd.choice("abcé_") for _ in range(n))
    pairs = [(text_of(n), text_of(m)) for n in (1, 2, 31, 32, 61, 62, 63, 70) for m in (1, 5, 33, 62, 64, 90)] + [("", "a"), ("a", ""), ("", ""), ("a" * 62, "a" * 62)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    found = dict(map(tuple, got.select("i", fuzzy.common_subsequence(F.col("a"), F.col("b"))).collect()))
    assert found == {i: lcs(a, b) for i, (a, b) in enumerate(pairs)}


def test_candidates_follow_the_names(spark):
    """Names over a product of parts: eight times the names, at most about as many candidates each."""
    def mean(n):
        parts = [f"{a}_{b}_brand_{i}_{k}" for i in range(n) for a in ("large", "small", "new", "hot") for b in ("gear", "bolt", "anvil") for k in ("economy", "promo")]
        frame = lambda suffix: spark.createDataFrame([(p + suffix,) for p in parts], "norm string")
        return fuzzy.candidate_pairs(frame("_x"), frame("")).count() / len(parts)

    few, many = mean(10), mean(80)
    assert 1 <= few and many <= 1.5 * few < 6


def test_name_normalisation(spark):
    names = [" OWNER.CORE_ORDER__ITEMS_ ", "core_x", "a.Site_7_Staff", "T"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(fuzzy.normal_name(F.col("n")), fuzzy.normal_name(F.col("n"), r"core_|site_\d+_"))
    assert [tuple(r) for r in df.collect()] == [("core_order_items", "order_items"), ("core_x", "x"), ("site_7_staff", "staff"), ("t", "t")]


def test_null_keys_and_null_order_values_lose_no_row(spark):
    rows = [(None, 1.0, 1), (None, 3.0, 2), ("a", 5.0, None)]
    df = spark.createDataFrame(rows, "k string, v double, at int")
    assert sorted(r.rownum for r in keyed.number_rows(df, [F.col("at")], [F.col("at")]).collect()) == [1, 2, 3]
    got = {r.k: r.median for r in keyed.medians(df, ["k"], "v", 10.0).collect()}
    assert got == {None: 2.0, "a": 5.0}
    times = df.filter("at is not null").withColumn("ts", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.col("at"), F.lit(0), F.lit(0)))
    assert sorted((r.v, r.prev_v) for r in keyed.carry_previous(times, ["k"], ["ts"], ["v"]).collect()) == [(1.0, None), (3.0, 1.0)]


def test_mapping_equals_all_pairs(spark):
    """Brute force over all pairs, with names of all three length classes and many shared tokens."""
    rnd = random.Random(11)
    words = ["order", "orders", "item", "items", "hist", "tb", "t", "customer", "address", "x1", "x2", "balance", "a", "b"]
    make = lambda: "_".join(rnd.choice(words) for _ in range(rnd.randrange(1, 8)))
    long = "customer_address_balance_hist_order"
    catalog = sorted({make() for _ in range(150)} | {f"{long}_x1", f"{long}_x2"})
    sources = set()
    for c in catalog:
        for _ in range(2):
            s, i = list(c), rnd.randrange(len(c))
            s[i : i + 1] = rnd.choice(["", s[i] * 2, "z"])
            sources.add("".join(s))
    sources |= {make() for _ in range(60)} | {f"{long}_x"}
    sources = sorted(s for s in sources if s.strip("_"))
    got = {r.name: (r.status, r.match) for r in fuzzy.map_names(spark.createDataFrame([(s,) for s in sources], "n string"), "n", spark.createDataFrame([(c,) for c in catalog], "c string"), "c").collect()}
    norm = lambda s: "_".join(p for p in s.lower().split("_") if p)
    kinds = set()
    for s in sources:
        n = norm(s)
        if n in catalog:
            want = ("EXACT", n)
        else:
            cut = 0.95 if len(n) < 10 else 0.90 if len(n) <= 25 else 0.85
            hits = sorted(((round(score(n, c), 9), c) for c in catalog), key=lambda p: (-p[0], p[1]))
            hits = [h for h in hits if h[0] >= cut - 1e-9]
            if not hits:
                want = ("NO_MATCH", None)
            elif len(hits) == 1 or hits[0][0] - hits[1][0] > 0.05 + 1e-9:
                want = ("MATCHED", hits[0][1])
            else:
                want = ("AMBIGUOUS", None)
        kinds.add(want[0])
        assert got[s] == want, s
    assert kinds == {"EXACT", "MATCHED", "AMBIGUOUS", "NO_MATCH"}


def test_text_fixes(spark):
    raw = "a\r\nb<br/>c<i>d</i>_x000D_  e\n\n\n\nf"
    steps = text.clean_steps(F.lit(raw))
    assert spark.range(1).select(steps[-1][1]).collect()[0][0] == "a\nb\ncd e\n\nf"
    r = spark.range(1).select(*[c.alias(n) for n, c in text.delimiter_audit(F.lit("select 'it''s' (\"a\""), "select").items()]).collect()[0]
    assert (r.single_quotes, r.double_quotes, r.parens_balanced, r.has_keyword) == (2, 2, False, True)


def test_function_names():
    assert compat.supported("nvl") and compat.supported("ROUND")
    with pytest.raises(KeyError):
        compat.call("XMLTABLE")


# --- streams ------------------------------------------------------------------------------------


@pytest.mark.parametrize("partition", [None, "y"])
def test_stream_upsert_keeps_the_newest_of_late_files(spark, tmp_path, partition):
    schema = "id int, t string, y int"
    folder, table = tmp_path / "in", f"t_stream_{partition}"
    arrive = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(folder))
    run = lambda: streams.upsert_stream(
        streams.read_files(spark, str(folder), spark.createDataFrame([], schema).schema), table, ["id"], "t",
        str(tmp_path / "tables"), str(tmp_path / "ckpt"), partition,
    ).awaitTermination()
    arrive([(1, "2024-01-02", 2024), (2, "2024-01-02", 2024), (3, "2023-01-01", 2023)])
    run()
    arrive([(1, "2024-01-01", 2024), (2, "2025-01-01", 2025), (4, "2024-05-05", 2024)])
    run()
    assert rows(spark.table(table).select("id", "t")) == [(1, "2024-01-02"), (2, "2025-01-01"), (3, "2023-01-01"), (4, "2024-05-05")]
    run()
    assert spark.table(table).count() == 4


def test_a_span_to_the_year_9999_makes_a_few_rows(spark):
    left = spark.sql("select 1 as lid, 'a' as k, timestamp_ntz'2024-01-01 00:00:00' as lo, timestamp_ntz'9999-01-01 00:00:00' as hi")
    left = left.union(spark.sql("select 2, 'a', timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 00:05:00'"))
    events = spark.sql("select id, 'a' as k, timestamp_ntz'2023-12-31 23:59:00' + make_dt_interval(0, 0, id) as t from range(10)")
    got = keyed.within_band(left, events, ["k"], "t", F.col("lo"), F.col("hi"), 60).select("lid", "id").collect()
    assert sorted((r.lid, r.id) for r in got) == [(1, i) for i in range(1, 10)] + [(2, i) for i in range(1, 7)]
