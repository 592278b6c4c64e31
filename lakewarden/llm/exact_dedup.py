"""Exact dedup with skew-safe combining.

Texts are equal when they are identical after lower-casing A-Z. A group of copies is reduced in three steps,
each of which compares the whole text and not only its digest, as the text itself is part of the key:

1. inside each task (the partial aggregate before the shuffle), which leaves one row per distinct text and task;
2. among the tasks of one salt: ``FAN_IN`` neighbouring tasks share a salt, so that no task of the second step
   receives more than ``FAN_IN`` rows of one text, however many copies there are;
3. among the salt winners of a text.

The number of salts follows the number of input tasks. Rows then find their group by the digest alone if every
digest belongs to one text, which step 3 has established; otherwise by digest and text.

Defined results: a null text counts as empty, so that null and empty texts are copies of each other. Null ids
lose against any id. Rows that repeat an id and a text are all marked as kept by ``groups``; ``survivors``
leaves exactly one row per group (the first in the order of all its columns). An empty table gives no rows.
Extra columns of any name are kept by ``survivors``, which packs rows, and ignored by ``groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, staged, whole_text

FAN_IN = 16


def _keyed(docs: DataFrame, with_text: bool, *columns: Column) -> DataFrame:
    """doc_id, digest and folded text of each row, beside further columns."""
    rows = docs.select(F.col("doc_id").alias("_dedup_id"), lower_ascii(whole_text()).alias("_dedup_text"), *columns)
    rows = rows.withColumn("_dedup_sha", F.unhex(F.sha2("_dedup_text", 256)))
    return rows if with_text else rows.drop("_dedup_text")


def winners(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row per distinct text with the id that stays and the group's size, and the columns that identify it."""
    best, size = F.max("_dedup_keep").alias("_dedup_keep"), F.sum("_dedup_size").alias("_dedup_size")
    rows = _keyed(docs, True).select(
        "_dedup_sha", F.floor(F.spark_partition_id() / FAN_IN).alias("_dedup_salt"), "_dedup_text",
        F.col("_dedup_id").alias("_dedup_keep"), F.lit(1).cast("bigint").alias("_dedup_size"),
    )
    salted = rows.groupBy("_dedup_sha", "_dedup_salt", "_dedup_text").agg(best, size)
    merged = salted.groupBy("_dedup_sha", "_dedup_text").agg(best, size)
    found = staged(merged.drop("_dedup_text"), "exact-dedup")
    if found.groupBy("_dedup_sha").count().filter("count > 1").isEmpty():
        return found, ["_dedup_sha"]
    return staged(merged, "exact-dedup"), ["_dedup_sha", "_dedup_text"]


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found, keys = winners(docs)
    return _keyed(docs, len(keys) > 1).join(found, keys).select(
        F.col("_dedup_id").alias("doc_id"), F.col("_dedup_keep").alias("keep_id"), F.col("_dedup_size").alias("group_size"),
        F.col("_dedup_id").eqNullSafe(F.col("_dedup_keep")).alias("kept"), F.lower(F.hex("_dedup_sha")).alias("text_sha256"),
    )


def survivors(docs: DataFrame) -> DataFrame:
    """One whole row of ``docs`` per distinct text: the one with the largest id."""
    found, keys = winners(docs)
    best = found.drop("_dedup_size")
    rows = _keyed(docs, len(keys) > 1, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    on = rows["_dedup_id"].eqNullSafe(best["_dedup_keep"])
    for k in keys:
        on = on & (rows[k] == best[k])
    first = Window.partitionBy("_dedup_sha", "_dedup_id", *keys[1:]).orderBy("row")
    kept = rows.join(best, on, "left_semi").withColumn("_dedup_rank", F.row_number().over(first))
    return kept.filter("_dedup_rank = 1").select("row.*")
