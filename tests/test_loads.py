"""Loads end to end: what a second run leaves in bronze, silver, control tables and the key index."""

import threading
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import commit, incremental, keyindex, ledger, load, merge, writes
from lakewarden.operators.contract import ColumnSpec, Contract

AS_OF, LATER, LAST = "2024-01-10 00:00:00", "2024-01-11 00:00:00", "2024-01-12 00:00:00"
SPEC = Contract("d", 1, (ColumnSpec("id", "long", False), ColumnSpec("v", "string"), ColumnSpec("t", "timestamp")), ("id",), "t", "t", "timestamp")


def place(tmp_path, **more):
    name = f"load_{uuid.uuid4().hex[:8]}"
    return load.Place(f"{name}_bronze", str(tmp_path), f"{name}_", f"{name}_silver", **more)


def table(spark, *rows):
    """Rows (id, v, day of January) partitioned by p, which follows v's first letter."""
    data = [(i, v, datetime(2024, 1, day), v[0]) for i, v, day in rows]
    return spark.createDataFrame(data, "id long, v string, t timestamp_ntz, p string")


def config(mode="CURRENT", strategy="WATERMARK", key=("id",), watermark="t", days=3):
    return incremental.LoadConfig("d", "SRC", mode, strategy, key, watermark, days)


def held(spark, name):
    return sorted((r.id, r.v) for r in spark.table(name).collect())


def logged(spark, at, name, *columns):
    return sorted(tuple(r) for r in spark.table(at.control_table(name)).select(*columns).collect())


def test_snapshot_of_a_partitioned_table_drops_partitions_that_vanish(spark, tmp_path):
    at, cfg = place(tmp_path, partition="p"), config("SNAPSHOT", "SNAPSHOT", (), None)
    load.run_load(table(spark, (1, "a1", 1), (2, "b1", 1)), at, cfg, "r1", AS_OF)
    load.run_load(table(spark, (3, "b2", 2)), at, cfg, "r2", LATER)
    assert held(spark, at.bronze) == [(3, "b2")] and commit.partition_values(spark, at.bronze, "p") == ["b"]
    assert logged(spark, at, "runs", "run_id", "bronze_row_count") == [("r1", 2), ("r2", 1)]


def test_window_that_empties_a_partition(spark, tmp_path):
    at, cfg = place(tmp_path, partition="p"), config(key=())
    load.run_load(table(spark, (1, "a1", 1), (2, "b1", 9), (3, "c1", 9)), at, cfg, "r1", AS_OF)
    load.run_load(table(spark, (1, "a1", 1), (4, "c2", 10)), at, cfg, "r2", LATER)
    assert held(spark, at.bronze) == [(4, "c2")]  # the first run's window held the rows of the ninth only
    assert commit.partition_values(spark, at.bronze, "p") == ["c"]
    assert logged(spark, at, "layers", "run_id", "operation", "inserted_count", "deleted_count") == [("r1", "REPLACE_WHERE", 2, None), ("r2", "REPLACE_WHERE", 1, 2)]


@pytest.mark.parametrize("partition", [None, "p"])
def test_append_reads_above_the_watermark_only(spark, tmp_path, partition):
    at, cfg = place(tmp_path, partition=partition), config("APPEND_LOG", key=())
    first = table(spark, *[(i, f"a{i}", 1 + i % 5) for i in range(10)])
    assert load.run_load(first, at, cfg, "r1", AS_OF) == "SUCCEEDED"
    load.run_load(first, at, cfg, "r2", LATER)
    assert spark.table(at.bronze).count() == 10
    load.run_load(first.union(table(spark, (10, "b", 6), (11, "late", 3))), at, cfg, "r3", LAST)
    assert held(spark, at.bronze)[-1] == (10, "b") and spark.table(at.bronze).count() == 11
    runs = logged(spark, at, "runs", "run_id", "bronze_row_count", "incremental_rows_read", "watermark_start", "watermark_end")
    low, high = "2024-01-05 00:00:00", "2024-01-06 00:00:00"
    assert runs == [("r1", 10, 10, None, low), ("r2", 0, 0, low, low), ("r3", 1, 1, low, high)]


@pytest.mark.parametrize("partition", [None, "p"])
def test_hash_merge_writes_and_counts_what_changed(spark, tmp_path, partition):
    at, cfg = place(tmp_path, partition=partition, silver_partition=partition), config(strategy="HASH_MERGE", watermark=None)
    load.run_load(table(spark, (1, "a", 1), (2, "b", 1), (3, "c", 1)), at, cfg, "r1", AS_OF, SPEC, compact_after=None)
    load.run_load(table(spark, (1, "a", 1), (2, "b2", 2), (4, "d", 2)), at, cfg, "r2", LATER, SPEC, compact_after=None)
    assert held(spark, at.bronze) == [(1, "a"), (2, "b2"), (3, "c"), (4, "d")] == held(spark, at.silver)
    assert {r.id: r._batch_id for r in spark.table(at.bronze).collect()} == {1: "r1", 2: "r2", 3: "r1", 4: "r2"}
    counts = logged(spark, at, "layers", "run_id", "layer", "operation", "inserted_count", "updated_count")
    assert counts == [("r1", "BRONZE", "HASH_MERGE", 3, 0), ("r1", "SILVER", "MERGE", 3, 0), ("r2", "BRONZE", "HASH_MERGE", 1, 1), ("r2", "SILVER", "MERGE", 1, 1)]
    load.run_load(table(spark, (1, "a", 1), (2, "b2", 2), (4, "d", 2)), at, cfg, "r3", LAST, SPEC, compact_after=None)
    assert logged(spark, at, "runs", "run_id", "bronze_row_count", "silver_row_count")[-1] == ("r3", 0, 0)


def test_a_row_that_moves_leaves_its_old_partition(spark, tmp_path):
    at, cfg = place(tmp_path, partition="p"), config()
    load.run_load(table(spark, (1, "a", 1), (2, "b", 1)), at, cfg, "r1", AS_OF)
    load.run_load(table(spark, (1, "c", 5)), at, cfg, "r2", LATER)
    assert held(spark, at.bronze) == [(1, "c"), (2, "b")] and commit.partition_values(spark, at.bronze, "p") == ["b", "c"]


def test_closed_gate_lets_bronze_in_and_silver_wait(spark, tmp_path):
    at, cfg = place(tmp_path), config()
    gate = lambda open_: spark.createDataFrame([("d", open_)], "dataset_id string, silver_allowed boolean")
    load.run_load(table(spark, (1, "a", 1)), at, cfg, "r1", AS_OF, SPEC, gate(True))
    assert load.run_load(table(spark, (2, "b", 8)), at, cfg, "r2", LATER, SPEC, gate(False)) == "SUCCEEDED"
    assert held(spark, at.bronze) == [(1, "a"), (2, "b")] and held(spark, at.silver) == [(1, "a")]
    assert load.dataset_state(spark, at, "d").execution_state == load.BLOCKED
    assert ("r2", "SILVER", "BLOCKED_SCHEMA_CHANGE") in logged(spark, at, "layers", "run_id", "layer", "status")
    load.run_load(table(spark, (3, "c", 9)), at, cfg, "r3", LAST, SPEC, gate(True))
    assert held(spark, at.silver) == [(1, "a"), (2, "b"), (3, "c")] and load.dataset_state(spark, at, "d").execution_state == load.ACTIVE


def test_failed_run_is_recorded(spark, tmp_path):
    at = place(tmp_path)
    with pytest.raises(Exception, match="NULL_KEY"):
        load.run_load(table(spark, (None, "a", 1)), at, config(), "r1", AS_OF, SPEC)
    assert logged(spark, at, "runs", "run_id", "status") == [("r1", "FAILED")]


def test_compaction_after_enough_merges(spark, tmp_path):
    at, cfg = place(tmp_path, partition="p"), config()
    days = iter(range(1, 9))
    run = lambda n: load.run_load(table(spark, (n, "a", next(days))), at, cfg, f"r{n}", f"2024-01-{10 + n} 00:00:00", compact_after=2)
    run(1)  # never done, so due
    assert load.dataset_state(spark, at, "d").merges_since == 0
    run(2)
    assert load.dataset_state(spark, at, "d").merges_since == 1
    run(3)
    assert load.dataset_state(spark, at, "d").merges_since == 0 and len(held(spark, at.bronze)) == 3


def test_delete_flags_are_written_back(spark, tmp_path):
    at, cfg = place(tmp_path, partition="p"), config()
    load.run_load(table(spark, (1, "a", 1), (2, "b", 1), (3, "b", 1)), at, cfg, "r1", AS_OF)
    before = {r.f for r in spark.table(at.bronze).filter("p = 'a'").select(F.col("_metadata.file_path").alias("f")).collect()}
    done = load.mark_deleted(spark.createDataFrame([(1,), (3,)], "id long"), at, cfg)
    assert (done.deleted, sorted((r.id, r._is_deleted) for r in spark.table(at.bronze).collect())) == (1, [(1, False), (2, True), (3, False)])
    assert before == {r.f for r in spark.table(at.bronze).filter("p = 'a'").select(F.col("_metadata.file_path").alias("f")).collect()}


# --- ledger -------------------------------------------------------------------------------------


def test_interleaved_writers_keep_both_watermarks(spark, tmp_path):
    at, kind = place(tmp_path), spark.range(1).select(F.current_date().alias("t")).schema["t"].dataType
    load.save_watermark("2024-01-01", kind, at, config(), "r0", AS_OF, spark)
    seen = load.stored_watermarks(spark, at).collect()  # both runs start from the same state
    others = [incremental.LoadConfig(f"d{i}", "SRC", watermark="t") for i in range(4)]
    failed = []

    def write(cfg):
        try:
            load.save_watermark("2024-01-09", kind, at, cfg, "r1", LATER, spark)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(c,)) for c in others]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and len(seen) == 1
    assert sorted((r.dataset_id, r.watermark_value) for r in load.stored_watermarks(spark, at).collect()) == [("d", "2024-01-01")] + [(f"d{i}", "2024-01-09") for i in range(4)]


def test_fold_keeps_the_newest_of_old_days_and_leaves_the_present_one(spark, tmp_path):
    at, kind = place(tmp_path), spark.range(1).schema["id"].dataType
    name = at.control_table("watermarks")
    for run, as_of in enumerate((AS_OF, AS_OF, LATER, LAST, LAST)):
        load.save_watermark(str(run), kind, at, config(), f"r{run}", as_of, spark)
    load.save_watermark("7", kind, at, incremental.LoadConfig("e", "SRC", watermark="t"), "r", AS_OF, spark)
    today = {r.f for r in spark.table(name).filter(F.col(ledger.ENTRY) >= "2024-01-12").select(F.col("_metadata.file_path").alias("f")).collect()}
    before = sorted(map(tuple, load.stored_watermarks(spark, at).collect()))
    assert load.fold_watermarks(spark, at, LAST) == 2
    assert sorted(map(tuple, load.stored_watermarks(spark, at).collect())) == before and spark.table(name).count() == 4
    assert today <= {r.f for r in spark.table(name).select(F.col("_metadata.file_path").alias("f")).collect()}
    assert load.fold_watermarks(spark, at, LAST) == 0


# --- key index ----------------------------------------------------------------------------------


def keyed(spark, *ranges):
    parts = [spark.range(a, b).select("id", F.concat(F.lit("v"), "id").alias("v"), F.lit(p).alias("p")) for p, a, b in ranges]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def test_index_names_few_partitions_and_never_misses_one(spark, tmp_path):
    name, root = f"idx_{uuid.uuid4().hex[:8]}", str(tmp_path)
    merge.merge(keyed(spark, *[(f"p{i:02d}", i * 1000, (i + 1) * 1000) for i in range(20)]), name, root, ["id"], "p", "v")
    done = merge.merge(spark.createDataFrame([(5, "new", "p00"), (7_500, "new", "p07"), (99_999, "new", "p20")], "id long, v string, p string"), name, root, ["id"], "p")
    assert {"p00", "p07", "p20"} <= set(done.read) and len(done.read) <= 4
    assert done.written == ("p00", "p07", "p20") and (done.inserted, done.updated) == (1, 2)
    assert spark.table(name).count() == 20_001 and spark.table(name).filter("v = 'new'").count() == 3


def test_index_without_ranges_that_help(spark, tmp_path):
    """Keys that are spread over all partitions are told apart by the bits alone."""
    name, root = f"idx_{uuid.uuid4().hex[:8]}", str(tmp_path)
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.lit("old").alias("v"), (F.col("id") % 40).cast("int").alias("p"))
    merge.merge(rows, name, root, ["k"], "p", "v")
    some = rows.filter("p in (3, 17)").limit(8).withColumn("v", F.lit("new"))
    own = {r.p for r in some.collect()}
    done = merge.merge(some, name, root, ["k"], "p", "v")
    assert own == set(done.written) and own <= set(done.read) and len(done.read) <= 8 and done.updated == 8


def test_index_is_built_for_a_table_that_has_none_and_survives_lost_writes(spark, tmp_path):
    name, root = f"idx_{uuid.uuid4().hex[:8]}", str(tmp_path)
    commit.commit_partitions(keyed(spark, ("a", 0, 10), ("b", 10, 20)), name, root, "p")
    ghost = spark.createDataFrame([(3, "x", "b")], "id long, v string, p string")
    done = merge.merge(ghost, name, root, ["id"], "p")  # moves key 3 from a to b
    assert done.read == ("a", "b") and spark.table(name).count() == 20
    keyindex.record(keyed(spark, ("b", 0, 3)), name, root, ["id"], "p")  # entries of a write that then failed
    again = merge.merge(spark.createDataFrame([(1, "y", "a")], "id long, v string, p string"), name, root, ["id"], "p")
    assert again.written == ("a",) and again.updated == 1 and spark.table(name).count() == 20
    keyindex.rebuilt(spark, name, root, ["id"], "p")
    assert merge.merge(spark.createDataFrame([(2, "z", "a")], "id long, v string, p string"), name, root, ["id"], "p").read == ("a",)


@pytest.mark.parametrize("partition", [None, "p"])
def test_merge_equals_the_plain_upsert(spark, tmp_path, partition):
    name, root = f"idx_{uuid.uuid4().hex[:8]}", str(tmp_path)
    state = table(spark, *[(i, "abc"[i % 3] + str(i), 1 + i % 9) for i in range(40)])
    merge.merge(state, name, root, ["id"], partition, "t")
    late = 0
    for run in range(3):
        more = table(spark, *[(i, "abcd"[(i + run) % 4] + str(run), 1 + (i * 7 + run) % 9) for i in range(run * 5, 50, 3)])
        want = writes.upsert_newest(state, more, ["id"], "t")
        done = merge.merge(more, name, root, ["id"], partition, "t", newest=True)
        rows = sorted((r.id, r.v, r.t) for r in want.collect())
        assert sorted((r.id, r.v, r.t) for r in spark.table(name).collect()) == rows
        assert done.inserted + done.updated + done.late == more.count()
        late += done.late
        state = spark.createDataFrame(want.collect(), want.schema)
    assert late > 0 and merge.merge(more, name, root, ["id"], partition, "t", "v", True).changed == 0


def test_partition_written_by_hand_keeps_the_rest(spark, tmp_path):
    name = f"idx_{uuid.uuid4().hex[:8]}"
    commit.commit_partitions(keyed(spark, ("a", 0, 3), ("b", 3, 6)), name, str(tmp_path), "p")
    done = commit.commit_partitions(spark.table(name).filter("p = 'a' and id = 1"), name, str(tmp_path), "p", touched=["a"])
    assert (done.rows, done.partitions, spark.table(name).count()) == (1, ("a",), 4)
    commit.commit_partitions(spark.table(name).filter("id = 4"), name, str(tmp_path), "p", whole=True)
    assert held(spark, name) == [(4, "v4")]
