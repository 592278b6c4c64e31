"""SimHash near-dedup by multi-index hashing.

A document's fingerprint has a bit set if more than half of its three-word shingles hash (XXH64, seed 42) to a value
with that bit. Fingerprints at ``RADIUS`` = 3 differing bits or fewer are linked.

Search: the 64 bits are cut into two segments of 32. Of two fingerprints at distance 3 or less, one segment differs
in one bit at most, so the ball of radius 1 around each segment value is enumerated and looked up in the table of
segment values; matches are verified on all 64 bits inside the join. A pair whose segment differs in one bit is found
from the side where the bit is 0, so only zero bits are flipped and each pair is proposed once per segment. Equal
fingerprints are one row before the search: a group of copies, however large, adds a single entry. A 32-bit key
keeps tables thin up to billions of distinct fingerprints; no table is capped, and a crowded value is divided by
adaptive execution, as the join has no operator above it that needs a key's rows together.

Defined results: null and empty texts, and texts of white space, have fingerprint zero, linked like any other. Fewer
than three words make one shingle. Repeated rows are reported as often as they come. Null ids take part in
linking; a component of null ids only has a null component_id. An empty table gives no rows. Extra columns are ignored by
``near_duplicates`` and kept by ``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, staged, whole_text
from .components import components

RADIUS, SEED, WORDS = 3, 42, 3


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a bounded bit matrix for the longest of texts
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype="<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per document; fp is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def links(marks: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` at RADIUS bits or fewer; a pair may come twice."""
    halves = marks.select("fp", F.posexplode(F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))).alias("seg", "val"))
    key = lambda v: F.shiftleft(F.col("seg").cast("bigint"), 32).bitwiseOR(v)
    table = halves.select(key(F.col("val")).alias("key"), F.col("fp").alias("b"))
    masks = F.array(*[F.lit(1 << i).cast("bigint") for i in range(32)])
    zero_bits = F.filter(masks, lambda m: F.col("val").bitwiseAND(m) == 0)
    ball = F.concat(F.array(F.col("val")), F.transform(zero_bits, lambda m: F.col("val").bitwiseOR(m)))
    probes = halves.select("seg", F.col("fp").alias("a"), F.explode(ball).alias("val")).select(key(F.col("val")).alias("key"), "a")
    close = (probes["key"] == table["key"]) & (F.bit_count(probes["a"].bitwiseXOR(table["b"])) <= RADIUS) & (probes["a"] != table["b"])
    return probes.join(table, close).select("a", "b")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    rows = staged(fingerprints(docs), "simhash")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash")
    roots = components(links(distinct.select("fp")))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(staged(placed.join(ids, "root").select("fp", "component_id"), "simhash"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least id reachable)."""
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The whole row of the least id of each component.

    Of rows that repeat an id the first in the order of all columns stays; of null ids, one row per component of null ids.
    """
    best = _grouped(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("best")).distinct()
    rows = packed(docs, F.col("doc_id").alias("id"))
    kept = rows.join(best, rows["id"].eqNullSafe(best["best"]), "left_semi")
    first = Window.partitionBy("id").orderBy("row")
    return kept.withColumn("rank", F.row_number().over(first)).filter("rank = 1").select("row.*")
