"""A key index of a partitioned table: which partitions may hold a key, without reading them.

The index is a table of its own, ``<table>__keys``, with one generation of entries per write. Per partition and generation
the keys are spread over ``words`` words by a first hash; a word is a Bloom filter of 64 bits in which each key sets
``BITS`` bits chosen by a second hash, and carries the range of the first key column among the keys of its partition. The number
of words follows the size of the write, about ``KEYS_PER_WORD`` keys a word in the fullest partition.

Entries are only appended, and before the rows they speak of are written. So the index never lacks a key that the table holds: a
write that fails after its entries, a key that moves to another partition, or writers side by side leave entries that cost
a needless read and never a row. ``rebuilt`` folds all of it anew, as part of a compaction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commit

BITS, KEYS_PER_WORD, MOST_WORDS = 6, 2, 1 << 26
FIRST, SECOND = 1, 2  # salts of the two hashes


def index_table(table: str) -> str:
    return f"{table}__keys"


def _word(keys: list[str], words: Column) -> Column:
    """The word of a key; ``words`` is a power of two."""
    return F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.lit(FIRST)).bitwiseAND(words - 1)


def _bits(keys: list[str]) -> Column:
    """The bits that a key sets in its word."""
    second = F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.lit(SECOND))
    out = F.lit(0).cast("bigint")
    for i in range(BITS):
        at = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return out


def entries(rows: DataFrame, keys: list[str], partition: str) -> DataFrame:
    """One generation of index entries for rows that are about to be written: part, words, word, bits, low, high."""
    low, high = F.min(f"`{keys[0]}`").alias("low"), F.max(f"`{keys[0]}`").alias("high")
    sizes = rows.groupBy(F.col(partition).alias("part")).agg(F.count(F.lit(1)).alias("n"), low, high)
    most = sizes.agg(F.max("n")).first()[0] or 1
    words = min(MOST_WORDS, 1 << max(0, math.ceil(math.log2(most / KEYS_PER_WORD))))
    each = rows.select(F.col(partition).alias("part"), _word(keys, F.lit(words).cast("bigint")).alias("word"), _bits(keys).alias("bits"))
    filled = each.groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
    return filled.join(sizes.drop("n"), "part").select("part", F.lit(words).cast("bigint").alias("words"), "word", "bits", "low", "high")


def record(rows: DataFrame, table: str, root: str, keys: list[str], partition: str) -> None:
    """Append the entries of rows that are about to be written to ``table``."""
    commit.commit_append(entries(rows, keys, partition), index_table(table), root)


def candidates(index: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The partitions (part) that may hold a key of the incoming rows.

    Incoming keys meet the index by word, an equi-join whose rows follow the increment and not the table; entries are kept
    where all bits of a key are set and the partition's range holds its first column.
    """
    sizes = [r.words for r in index.select("words").distinct().collect()]  # powers of two, so a few at most
    if not sizes:
        return index.select("part").limit(0)
    probe = incoming.select(*[F.col(f"`{k}`") for k in keys]).distinct()
    probe = probe.select(F.col(f"`{keys[0]}`").alias("key"), _bits(keys).alias("asked"), F.explode(F.array(*[F.struct(F.lit(w).cast("bigint").alias("words"), _word(keys, F.lit(w).cast("bigint")).alias("word")) for w in sizes])).alias("at"))
    probe = probe.select("key", "asked", "at.words", "at.word")
    met = (F.col("bits").bitwiseAND(F.col("asked")) == F.col("asked")) & F.col("key").between(F.col("low"), F.col("high"))
    return index.join(probe, ["words", "word"]).filter(met).select("part").distinct()


def candidate_partitions(spark: SparkSession, table: str, incoming: DataFrame, keys: list[str], partition: str) -> list:
    """Partition values that an upsert of the incoming rows may touch: those that may hold their keys, and their own."""
    own = incoming.select(F.col(partition).alias("part"))
    if not spark.catalog.tableExists(index_table(table)):
        return sorted({*commit.partition_values(spark, table, partition), *[r.part for r in own.distinct().collect()]})
    return sorted(r.part for r in candidates(spark.table(index_table(table)), incoming, keys).union(own).distinct().collect())


def rebuilt(spark: SparkSession, table: str, root: str, keys: list[str], partition: str) -> None:
    """Replace the index by one generation from the table's keys; the caller makes sure that nobody writes meanwhile."""
    commit.commit_snapshot(entries(spark.table(table), keys, partition), index_table(table), root)
