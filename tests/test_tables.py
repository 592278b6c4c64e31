"""Golden before/after examples, invariants of table states, commits and loads."""

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import bronze, commit, contract, discovery, incremental, keyed, reconcile, writes
from lakewarden.operators.contract import ColumnSpec, Contract, ContractError
from lakewarden.sources import batch, jdbc, tables as sources

PEOPLE = "id bigint, name string, email string, batch int"
BEFORE = [(1, "Ann", "ann@x.org", 100), (2, "Bob", "bob@x.org", 100), (3, "Cy", "cy@x.org", 100)]
NOW = [(1, "Ann Lee", "ann2@x.org", 101), (4, "Dee", "dee@x.org", 101)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def people(spark):
    return spark.createDataFrame(BEFORE, PEOPLE), spark.createDataFrame(NOW, PEOPLE)


def test_snapshot_drops_what_the_source_lacks(people):
    assert rows(writes.snapshot(people[1])) == sorted(NOW)


def test_current_updates_inserts_and_keeps(people):
    assert rows(writes.upsert(*people, ["id"])) == sorted([NOW[0], BEFORE[1], BEFORE[2], NOW[1]])


def test_append_keeps_every_version(people):
    assert rows(writes.append_log(*people)) == sorted(BEFORE + NOW)


def test_upsert_twice_is_upsert_once(people):
    once = writes.upsert(*people, ["id"])
    assert rows(writes.upsert(once, people[1], ["id"])) == rows(once)


def test_null_key_fails(spark, people):
    bad = spark.createDataFrame([(None, "x", "y", 1)], PEOPLE)
    with pytest.raises(Exception, match="NULL_KEY"):
        writes.upsert(people[0], bad, ["id"]).collect()


def hashed(df, batch):
    return bronze.add_technical_columns(df, batch, "S", "2024-01-01", volatile=["BATCH"])


def test_hash_merge_of_unchanged_rows_changes_nothing(people):
    target, again = hashed(people[0], "b1"), hashed(people[0].withColumn("batch", F.lit(7)), "b2")
    assert writes.changed_rows(target, again, ["id"]).count() == 0
    assert {r._batch_id for r in writes.upsert_changed(target, again, ["id"]).collect()} == {"b1"}
    m = writes.merge_metrics(writes.merge_actions(target, again, ["id"], "_row_hash")).collect()[0]
    assert (m.inserted_count, m.updated_count, m.unchanged_count) == (0, 0, 3)


def test_missing_stored_hash_counts_as_changed(people):
    target = hashed(people[0], "b1").withColumn("_row_hash", F.lit(None).cast("string"))
    assert writes.changed_rows(target, hashed(people[0], "b2"), ["id"]).count() == 3


def test_hash_keeps_null_positions_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert df.select(bronze.row_hash(df)).distinct().count() == 2


def test_newest_row_per_key_has_no_duplicates_and_keeps_nulls_last(spark):
    df = spark.createDataFrame([(1, None, "old"), (1, "2024-01-01", "new"), (2, None, "only")], "k int, t string, v string")
    got = keyed.latest_per_key(df, ["k"], "t")
    assert rows(got.select("k", "v")) == [(1, "new"), (2, "only")]


def test_rows_outside_the_window_fail(spark):
    df = spark.createDataFrame([(1, "2024-01-01")], "id int, d string")
    with pytest.raises(Exception, match="OUTSIDE_WINDOW"):
        writes.replace_window(df, df, "d", F.lit("2024-02-01")).collect()


def test_write_sizing_and_compaction():
    assert [writes.write_partitions(n) for n in (None, 0, 1_000_000, 1_000_001, 10**12)] == [None, 1, 1, 2, 10**6]
    assert writes.write_partitions(5, 64) == 64
    assert writes.compaction_due(0, 100, None) and writes.compaction_due(100, None, "x") and not writes.compaction_due(99, 100, "x")


def test_snapshot_commit_switches_and_changes_schema(spark, people, tmp_path):
    root = str(tmp_path)
    commit.commit_snapshot(people[0], "t_people", root)
    state = writes.upsert(spark.table("t_people"), people[1], ["id"])
    commit.commit_snapshot(state, "t_people", root)
    assert spark.table("t_people").count() == 4
    commit.commit_append(people[1], "t_people", root)
    assert spark.table("t_people").count() == 6
    commit.commit_snapshot(people[1].withColumn("extra", F.lit(1)), "t_people", root)
    assert "extra" in spark.table("t_people").columns
    assert commit.compact("t_people", ["id"], root, spark, merges_since=100)
    assert not commit.compact("t_people", ["id"], root, spark, merges_since=1, last_done="x")
    assert spark.table("t_people").count() == 2


def test_partition_commit_rewrites_only_what_is_touched(spark, tmp_path):
    root = str(tmp_path)
    old = spark.createDataFrame([(1, "a", 2020), (2, "b", 2020), (3, "c", 2021), (4, "d", 2022)], "id int, v string, y int")
    commit.commit_partitions(old, "t_parts", root, "y")
    files = {r.y: r.f for r in spark.table("t_parts").groupBy("y").agg(F.min(F.col("_metadata.file_path")).alias("f")).collect()}
    fresh = spark.createDataFrame([(4, "moved", 2021), (2, "new", 2020)], "id int, v string, y int")
    current = spark.table("t_parts")
    touched = [r[0] for r in writes.touched_partitions(current, fresh, ["id"], "y").collect()]
    assert sorted(touched) == [2020, 2021, 2022]
    commit.commit_partitions(writes.upsert_touched(current, fresh, ["id"], "y"), "t_parts", root, "y", touched)
    assert rows(spark.table("t_parts")) == [(1, "a", 2020), (2, "new", 2020), (3, "c", 2021), (4, "moved", 2021)]
    only = spark.createDataFrame([(3, "again", 2021)], "id int, v string, y int")
    commit.commit_partitions(writes.upsert_touched(spark.table("t_parts"), only, ["id"], "y"), "t_parts", root, "y", [2021])
    now = {r.y: r.f for r in spark.table("t_parts").groupBy("y").agg(F.min(F.col("_metadata.file_path")).alias("f")).collect()}
    assert now[2020] != files[2020] and set(now) == {2020, 2021}
    with pytest.raises(ValueError):
        commit.commit_partitions(only.withColumn("y", F.lit("a b")), "t_odd", root, "y")


def test_published_view_survives_a_broken_query(spark, people):
    commit.publish_view(spark, "v_people", people[0])
    with pytest.raises(Exception):
        commit.publish_view(spark, "v_people", people[0].select("nope"))
    assert spark.table("v_people").count() == 3


def test_run_log_rows(spark):
    df = commit.log_rows(spark, commit.RUN_LOG_SCHEMA, [{"run_id": "r1", "status": "FAILED"}])
    assert df.collect()[0].run_id == "r1" and "watermark_end" in df.columns


# --- contract -----------------------------------------------------------------------------------


def test_contract_rules():
    with pytest.raises(ContractError):
        ColumnSpec("a", "money")
    with pytest.raises(ContractError):
        ColumnSpec("a", "int", precision=3)
    with pytest.raises(ContractError):
        Contract("d", 1, (ColumnSpec("a", "int"),), primary_key=("a",))
    with pytest.raises(ContractError):
        Contract.parse({"columns": [{"name": "a", "type": "decimal", "nullable": True}]})
    assert ColumnSpec("a", "bigint").type == "long" and ColumnSpec("a", "decimal").ddl == "decimal(38,0)"


def test_contract_json_round_trip():
    c = Contract("d", 2, (ColumnSpec("a", "long", False), ColumnSpec("b", "decimal", True, 12, 2)), ("a",), "b", "b", "numeric")
    assert Contract.parse(c.to_json()) == c


def test_inferred_contract_casts_its_own_table(spark, tables):
    c = contract.infer_contract(bronze.add_technical_columns(tables.orders, "b", "s", "2024-01-01"), "orders", ["o_orderkey"], "o_orderdate")
    assert c.names == tables.orders.columns and c.order_column == "o_orderdate" and c.watermark_type == "timestamp"
    assert contract.cast_to_contract(tables.orders, c).dtypes == tables.orders.dtypes


def test_bad_value_fails_and_is_found(spark):
    df = spark.createDataFrame([(1, " 1 000 "), (2, ""), (3, "x")], "id int, n string")
    c = Contract("d", 1, (ColumnSpec("id", "int"), ColumnSpec("n", "int")))
    assert rows(contract.cast_to_contract(df.filter("id < 3"), c)) == [(1, 1000), (2, None)]
    assert rows(contract.audit_casts(df, c, ["id"])) == [(3, "n", "x")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        contract.cast_to_contract(df, c).collect()


def test_required_column_with_nulls_is_refused(spark):
    df = spark.createDataFrame([(1,), (None,)], "id int")
    with pytest.raises(ContractError, match="NULLABILITY_VIOLATION: id"):
        contract.assert_nullability(df, Contract("d", 1, (ColumnSpec("id", "int", False),)))


def test_required_column_fails_the_promotion(spark):
    df = spark.createDataFrame([(1,), (None,)], "id int")
    with pytest.raises(Exception, match="NULLABILITY_VIOLATION: id"):
        incremental.promote_to_silver(df, None, Contract("d", 1, (ColumnSpec("id", "int", False),)))[1].collect()


def test_append_and_full_loads(tables):
    plain = incremental.LoadConfig("orders", "S.O", "SNAPSHOT", "SNAPSHOT", enable_incremental=False)
    full = incremental.load_bronze(tables.orders, None, plain, "b1", "2024-01-01")
    assert full.operation == "OVERWRITE" and {r._op for r in full.state.select("_op").distinct().collect()} == {"FULL_REFRESH"}
    snap = incremental.load_bronze(tables.orders, None, incremental.LoadConfig("orders", "S.O", "SNAPSHOT", "SNAPSHOT"), "b1", "2024-01-01")
    assert snap.operation == "OVERWRITE" and snap.state.filter("_row_hash is null").count() == 0
    log = incremental.LoadConfig("orders", "S.O", "APPEND_LOG", "APPEND_LOG")
    first = incremental.load_bronze(tables.orders, None, log, "b1", "2024-01-01")
    assert incremental.load_bronze(tables.orders, first.state, log, "b2", "2024-01-02").state.count() == 2 * tables.orders.count()


def test_closed_gate_stops_silver(spark):
    doc = lambda t: '{"columns":[{"name":"a","type":"%s","nullable":true}],"primary_key":[]}' % t
    active = spark.createDataFrame([("x", 1, doc("int")), ("y", 1, doc("int"))], "dataset_id string, schema_version int, expect_schema_json string")
    seen = spark.createDataFrame([("x", doc("int")), ("y", doc("long"))], "dataset_id string, expect_schema_json string")
    gate = contract.gate_changes(active, seen)
    contract.assert_gate_open(gate, "x")
    with pytest.raises(ContractError, match="SCHEMA_CHANGE_DETECTED"):
        contract.assert_gate_open(gate, "y")


def test_clean_names_collision(spark):
    with pytest.raises(ValueError):
        bronze.clean_names(spark.range(1).select(F.lit(1).alias("a b"), F.lit(2).alias("ab")))


# --- discovery and loads ------------------------------------------------------------------------


def test_strategy_table():
    key = lambda c: discovery.KeyFinding(("ID",), "X", c)
    pick = lambda *a: discovery.decide_strategy(*a).name
    none = discovery.KeyFinding()
    for rows in (5, 5_000_000, 20_000_000, 200_000_000, None):  # size never changes how a table is loaded
        assert pick("U", True, none, rows) == "WATERMARK"
        assert pick(None, False, key(0.95), rows) == "HASH_MERGE"
        assert pick(None, False, key(0.7), rows) == "SNAPSHOT"
        assert pick(None, False, none, rows) == "SNAPSHOT"


def test_watermark_names(spark):
    df = spark.range(1).select(*[F.current_timestamp().alias(c) for c in ("CREATED_AT", "DT_ALTERACAO", "UPDATED_AT", "LAST_UPDATE_DATE")])
    assert discovery.audit_watermark(df) == "LAST_UPDATE_DATE" or discovery.audit_watermark(df) == "UPDATED_AT"
    assert discovery.suggest_watermark(df) == ("UPDATED_AT", "name_pattern")
    assert discovery.suggest_watermark(df, "CREATED_AT") == ("CREATED_AT", "already_configured")
    assert discovery.volatile_columns(df) == ["UPDATED_AT"]


def test_discover_orders(tables):
    s = discovery.discover(tables.orders)
    assert s.metadata["pk"] == ["o_orderkey"] and s.name == "HASH_MERGE"
    s = discovery.discover(tables.orders.withColumnRenamed("o_orderdate", "UPDATED_AT"))
    assert s.name == "WATERMARK" and s.metadata["hash_exclude_cols"] == ["UPDATED_AT"]


def test_estimates_are_close(tables):
    sketch = {r.column_name: r for r in discovery.column_profile(tables.lineitem, ["l_orderkey", "l_shipdate"]).collect()}
    exact = {r.column_name: r for r in discovery.column_profile(tables.lineitem, ["l_orderkey", "l_shipdate"], exact=True).collect()}
    for c in exact:
        assert abs(sketch[c].distinct_values - exact[c].distinct_values) <= 0.1 * exact[c].distinct_values
    total = discovery.sampled_profile(tables.lineitem, ["l_orderkey"]).collect()[0].total_rows
    assert 0.3 * 6000 < total < 2.5 * 6000


CFG = incremental.LoadConfig("orders", "S.O", "CURRENT", "WATERMARK", ("o_orderkey",), "o_orderdate")


def test_write_matrix():
    def op(mode, strategy, pk, wm):
        return incremental.choose_write(incremental.LoadConfig("d", "s", mode, strategy, pk, wm)).operation

    assert op("CURRENT", "WATERMARK", ("a",), "w") == "MERGE"
    assert op("CURRENT", "SNAPSHOT", ("a",), "w") == "MERGE"
    assert op("CURRENT", "HASH_MERGE", ("a",), None) == "HASH_MERGE"
    assert op("CURRENT", "WATERMARK", (), "w") == "REPLACE_WHERE"
    assert op("CURRENT", "SNAPSHOT", (), None) == "OVERWRITE"
    assert op("APPEND_LOG", "APPEND_LOG", (), None) == "APPEND"
    assert op("SNAPSHOT", "SNAPSHOT", (), None) == "OVERWRITE"


def test_metadata_spellings():
    read = lambda m: incremental.LoadConfig.from_metadata("d", "s", "CURRENT", "WATERMARK", m)
    assert read({"watermark_col": "A", "pk": ["x"]}).watermark == read({"watermark_column": "A"}).watermark == "A"
    assert read({}).lookback_days == 3 and read({"lookback_days": 7}).lookback_days == 7


def test_cutoff():
    assert incremental.cutoff_text("2024-03-04 10:00:00.123", 3) == "2024-03-01 10:00:00"
    assert incremental.cutoff_text("12345", 3) == "12345"
    assert incremental.cutoff_text("2024-01-05T00:00:00", 3) == "2024-01-02 00:00:00"
    assert incremental.cutoff_text("2024-01-05T01:00:00+02:00", 3) == "2024-01-01 23:00:00"
    assert incremental.cutoff_text("2024-01-05", 3) == "2024-01-02 00:00:00"
    with pytest.raises(ValueError):
        incremental.cutoff_text("yesterday", 3)


def test_load_is_skipped_when_nothing_is_new(tables):
    orders = tables.orders
    target = bronze.add_technical_columns(orders, "b0", "S.O", "2002-01-01", "o_orderdate")
    skip = incremental.load_bronze(orders, target, CFG, "b1", "2030-01-01", "2029-01-01 00:00:00")
    assert skip.short_circuited and skip.state is None and skip.watermark_end == "2029-01-01 00:00:00"
    late = incremental.load_bronze(orders, target, CFG, "b1", "2030-01-01", "2001-08-02 00:00:00")
    assert late.late_arrivals and late.rows_read > 0 and not late.short_circuited
    m = incremental.merge_metrics(late, target, CFG).collect()[0]
    assert (m.inserted_count, m.updated_count) == (0, 0) and m.unchanged_count == late.rows_read


def test_staged_load_equals_unstaged(tables):
    args = (tables.orders, bronze.add_technical_columns(tables.orders_target, "b0", "S.O", "2001-01-01", "o_orderdate"), CFG, "b1", "2001-01-01", "2001-01-01")
    a, b = incremental.load_bronze(*args), incremental.load_bronze(*args, stage=False)
    assert rows(a.state) == rows(b.state) and a.watermark_end == b.watermark_end


def test_late_row_does_not_replace_a_newer_one(spark):
    old = spark.createDataFrame([(1, "2024-01-02", "new"), (2, "2024-01-01", "x")], "id int, t string, v string")
    new = spark.createDataFrame([(1, "2024-01-01", "late"), (2, "2024-01-01", "tie"), (3, "2024-01-01", "ins")], "id int, t string, v string")
    assert rows(writes.upsert_newest(old, new, ["id"], "t")) == [(1, "2024-01-02", "new"), (2, "2024-01-01", "tie"), (3, "2024-01-01", "ins")]


def test_hash_merge_load(tables):
    cfg = incremental.LoadConfig("orders", "S.O", "CURRENT", "HASH_MERGE", ("o_orderkey",))
    first = incremental.load_bronze(tables.orders, None, cfg, "b1", "2024-01-01", stage=False)
    again = incremental.load_bronze(tables.orders, first.state, cfg, "b2", "2024-01-02", stage=False)
    assert {r._batch_id for r in again.state.select("_batch_id").distinct().collect()} == {"b1"}


def test_stored_watermark_and_override(spark):
    stored = spark.createDataFrame([("a", "2024-01-01")], "dataset_id string, watermark_value string")
    assert incremental.last_watermark(stored, "a") == "2024-01-01"
    assert incremental.last_watermark(stored, "a", "2020-01-01") == "2020-01-01"
    assert incremental.last_watermark(stored, "b") is None


def test_delete_flags_hit_exactly_the_removed_keys(tables):
    target = tables.orders.select("o_orderkey").withColumn("_is_deleted", F.lit(False))
    kept = target.filter("o_orderkey % 5 <> 0").select("o_orderkey")
    flagged = reconcile.flag_deleted(target, kept, ["o_orderkey"])
    assert flagged.filter("_is_deleted <> (o_orderkey % 5 = 0)").count() == 0
    assert reconcile.delete_report(target, kept, ["o_orderkey"]).collect()[0].alert


# --- sources ------------------------------------------------------------------------------------


def test_jdbc_names_and_splits():
    assert jdbc.qualified_name("T@L", "OWN") == "OWN.T@L" and jdbc.qualified_name("A.T", "OWN") == "A.T"
    assert jdbc.prefixed_name("auth_users") == "auth.users" and jdbc.prefixed_name("my_table") == "public.my_table"
    assert jdbc.as_subquery("A.T@L") == "(SELECT * FROM A.T@L) src"
    assert jdbc.Split("id", 0, 9, 4).usable and not jdbc.Split("id", 0, None, 4).usable


class FakeReader:
    """Stands for a JDBC reader: keeps the options it was given."""

    def __init__(self):
        self.seen = {}

    def option(self, k, v):
        self.seen[k] = v
        return self

    def options(self, **kw):
        self.seen |= kw
        return self

    def format(self, f):
        self.seen["format"] = f
        return self

    def load(self):
        return self.seen


class FakeSpark:
    @property
    def read(self):
        return FakeReader()


def test_jdbc_reader_options():
    conn = jdbc.JdbcConnection("jdbc:x", "d.D", "u", "p")
    plain = jdbc.read_table(FakeSpark(), conn, "A.T", jdbc.Split("ID", 1, 100, 8))
    assert plain["dbtable"] == "A.T" and plain["fetchsize"] == 10_000 and plain["numPartitions"] == 8 and plain["partitionColumn"] == "ID"
    linked = jdbc.read_table(FakeSpark(), conn, "A.T@L", jdbc.Split("ID", 1, None, 8))
    assert linked["dbtable"] == "(SELECT * FROM A.T@L) src" and "numPartitions" not in linked


def test_failing_tables_become_result_rows(spark, tmp_path):
    params = spark.createDataFrame(
        [("p1", "d1", "A.T", None, "t_p1", None, None, None, None, None, True), ("p2", "d2", "A.U", None, "t_p2", None, None, None, None, None, False)],
        "process_id string, dataset_id string, source_table string, expected_rows bigint, target_table string, fetch_size int, "
        "num_partitions int, partition_column string, lower_bound bigint, upper_bound bigint, active boolean",
    )
    conn = jdbc.JdbcConnection("jdbc:none:x", "no.such.Driver")
    out = batch.load_all(spark, params, conn, str(tmp_path)).collect()
    assert [(r.process_id, r.status, r.row_count) for r in out] == [("p1", "FAILED", 0)] and out[0].error
    seen = jdbc.reachable(spark, conn, ["A.T"]).collect()
    assert not seen[0].ok and seen[0].error


def test_existing_table_must_exist(spark):
    with pytest.raises(sources.SourceError):
        sources.read_existing(spark, "no_such_table")
    assert sources.existence_report(spark, ["no_such_table"]) == {"no_such_table": False}
    assert sources.estimate_rows(spark.range(7)).collect()[0].row_estimate == 7


def test_append_keeps_new_columns_and_fills_missing_ones(spark, tmp_path):
    table = "append_evolves"
    for data, schema in (([(1, "a")], "id long, v string"), ([(2, "b", 7)], "id long, v string, n int"), ([("c", 3)], "V string, id long")):
        commit.commit_append(spark.createDataFrame(data, schema), table, str(tmp_path))
    assert rows(spark.table(table).select("id", "v", "n")) == [(1, "a", None), (2, "b", 7), (3, "c", None)]
    spark.sql(f"drop table {table}")


def test_compaction_rewrites_partitions(spark, tmp_path):
    table = "compacted_parts"
    df = spark.range(200).select("id", (F.col("id") % 2).cast("int").alias("p")).repartition(8)
    commit.commit_partitions(df, table, str(tmp_path), "p")
    before = set(spark.table(table).inputFiles())
    assert commit.compact(table, ["id"], str(tmp_path), spark, partitions=1)
    after = set(spark.table(table).inputFiles())
    assert not before & after and len(after) == 2 and spark.table(table).count() == 200
    spark.sql(f"drop table {table}")


def test_row_hash_tells_parts_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("∅", "x")], "a string, b string")
    assert df.select(bronze.row_hash(df)).distinct().count() == 4


def test_null_keys_fail_a_first_silver_load(spark):
    spec = Contract("d", 1, (ColumnSpec("id", "long"), ColumnSpec("v", "string")), ("id",), "v")
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c")], "id long, v string")
    with pytest.raises(Exception, match="(?i)key"):
        writes.silver_state(None, nulls, spec)[1].collect()
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    assert writes.silver_state(None, twice, spec)[1].count() == 1


def test_exact_profile_does_not_repeat_rows_per_column(spark):
    df = spark.createDataFrame([(1, "x", None), (1, None, 0.0), (2, "y", -0.0), (None, "y", 1.5)], "a int, b string, c double")
    exact = discovery.column_profile(df, df.columns, exact=True)
    assert "Expand" not in exact._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[:4] for r in exact.collect()] == [("a", 4, 2, 1), ("b", 4, 2, 1), ("c", 4, 2, 1)]
    assert discovery.column_profile(df.limit(0), ["a"], exact=True).collect()[0].distinct_values == 0
