"""Fixity audit of WARC replicas by Merkle trees.

Archives are WARC 1.1 files with one gzip member per record and an index of their offset ranges behind the last one. A leaf is the
SHA-256 of a record's stored bytes in the range that the primary's index gives; a node hashes the offset ranges
and hashes of up to ``FANOUT`` children in order, up to one root per file. Roots of two replicas are compared, and only the
children of nodes that differ are compared further, so an audit reads as many tree rows as there is damage, and no
record bytes at all once both trees exist. Ranges that a replica lacks (a short or missing file) have no hash and differ.
The last leaf of a file is its tail, from the end of the last record to the end of the file as it is in that replica, so the index,
bytes cut from the end and bytes appended are covered as well. ``audit`` reports records, and ``file_audit`` tails and
files, those that only the replica has among them.

Defined results: null urls and bodies are written as empty; null keys and repeated rows are records like any other; a body of
any size is one record. An empty table makes no files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import shared_folder, staged, whole_text

FANOUT = 16
LEVEL = 4
_INDEX = struct.Struct("<qB32sqqq")  # key, null flag, body digest, body bytes, offset, length


def record(key: int | None, url: str, body: bytes, digest: bytes) -> bytes:
    """A WARC resource record."""
    head = (
        "WARC/1.1\r\nWARC-Type: resource\r\n"
        f"WARC-Record-ID: <urn:x-page:{'' if key is None else key}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"
        f"WARC-Payload-Digest: sha256:{digest.hex()}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode("utf-8", "replace") + body + b"\r\n\r\n"


def _entry(key: int | None, digest: bytes, size: int, offset: int, length: int) -> bytes:
    return _INDEX.pack(key or 0, key is None, digest, size, offset, length)


def write_archive(rows: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Write records in ascending key order; the manifest (shard, path, n_records). An index of the records ends each file."""

    def task(sink, batches: Iterable[pa.RecordBatch]) -> dict:
        entries = []
        for batch in batches:
            for k, u, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = b.encode("utf-8", "replace")
                digest = hashlib.sha256(raw).digest()
                member = gzip.compress(record(k, u.replace("\r", "").replace("\n", ""), raw, digest), LEVEL, mtime=0)
                entries.append(_entry(k, digest, len(raw), sink.tell(), len(member)))
                sink.write(member)
        index = gzip.compress(b"".join(entries), LEVEL, mtime=0)
        sink.write(index + struct.pack("<q4s", len(index), b"WIDX"))  # the index follows the records; readers of WARC stop before it
        return {"n_records": len(entries)}

    picked = rows.select(F.col(key).cast("bigint").alias("key"), whole_text(url).alias("url"), whole_text(body).alias("body"), F.monotonically_increasing_id().alias("row"))
    return files.write_shards(picked, ["key", "row"], folder, task, ".warc.gz", "n_records bigint")


def _index(source) -> list[tuple]:
    size = source.size()
    source.seek(size - 12)
    length, mark = struct.unpack("<q4s", source.read(12))
    if mark != b"WIDX":
        raise ValueError("No index at the end of the archive")
    source.seek(size - 12 - length)
    return list(_INDEX.iter_unpack(gzip.decompress(source.read(length))))


def _per_file(manifest: DataFrame, row_of, schema: str, names: list[str], types: list, last=None) -> DataFrame:
    """Run ``row_of(manifest row, number of the first record, index entries)`` over the records of every file.

    ``last(manifest row, index entries)`` gives further rows after them.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, at = files.located(row["path"])
                with system.open_input_file(at) as source:
                    entries = _index(source)
                for i in range(0, len(entries), 4096):
                    out = list(row_of(row, i, entries[i : i + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                if last is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*last(row, entries)), types)], names)

    return files.spread(manifest).mapInArrow(task, schema)


def records(manifest: DataFrame) -> DataFrame:
    """The index of every file: shard, seq, key, body_sha256, body_bytes, offset, length."""

    def rows(row: dict, first: int, entries: list[tuple]):
        for n, (key, null, digest, size, offset, length) in enumerate(entries, first):
            yield row["shard"], n, None if null else key, digest.hex(), size, offset, length

    schema = "shard bigint, seq bigint, key bigint, body_sha256 string, body_bytes bigint, offset bigint, length bigint"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string() if n == "body_sha256" else pa.int64() for n in names]
    return _per_file(manifest, rows, schema, names, types)


def leaves(manifest: DataFrame, replica: str | None = None) -> DataFrame:
    """Leaf hashes of the files, or of the files of the same names in the folder ``replica``: shard, pos, start, stop, hash.

    Positions are those of the records; the tail comes after them, and its stop is the file's size in this replica.
    """

    def opened(row: dict):
        path = row["path"] if replica is None else f"{replica}/{row['path'].rsplit('/', 1)[1]}"
        system, at = files.located(path)
        try:
            return system.open_input_file(at)
        except FileNotFoundError:
            return None

    def tail(row: dict, entries: list[tuple]):
        start, source = (entries[-1][-2] + entries[-1][-1] if entries else 0), opened(row)
        if source is None:
            return [(row["shard"], len(entries), start, start, None)]
        with source:
            size, digest = source.size(), hashlib.sha256()
            if size < start:
                return [(row["shard"], len(entries), start, start, None)]
            source.seek(start)
            while data := source.read(1 << 20):
                digest.update(data)
        return [(row["shard"], len(entries), start, size, digest.hexdigest())]

    def rows(row: dict, first: int, entries: list[tuple]):
        source = opened(row)
        for n, (*_, offset, length) in enumerate(entries, first):
            data = b""
            if source is not None and offset + length <= source.size():
                source.seek(offset)
                data = source.read(length)
            yield row["shard"], n, offset, offset + length, hashlib.sha256(data).hexdigest() if len(data) == length else None
        if source is not None:
            source.close()

    schema = "shard bigint, pos bigint, start bigint, stop bigint, hash string"
    return _per_file(manifest, rows, schema, ["shard", "pos", "start", "stop", "hash"], [pa.int64()] * 4 + [pa.string()], tail)


def tree(leaf: DataFrame) -> tuple[DataFrame, int]:
    """All nodes (level, shard, pos, start, stop, hash), staged, and the level of the roots."""
    level = staged(leaf.withColumn("level", F.lit(0)), "merkle")
    top, nodes = 0, level
    widest = level.agg(F.max("pos")).first()[0]
    while (widest or 0) > 0:
        top, widest = top + 1, widest // FANOUT
        child = F.concat_ws(":", F.col("start").cast("string"), F.col("stop").cast("string"), F.coalesce("hash", F.lit("none")))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", child.alias("text")))), lambda x: x["text"])  # FANOUT at most
        level = level.groupBy("shard", F.floor(F.col("pos") / FANOUT).alias("up")).agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.sha2(F.array_join(ordered, "|"), 256).alias("hash")
        )
        level = staged(level.select("shard", F.col("up").alias("pos"), "start", "stop", "hash", F.lit(top).alias("level")), "merkle")
        nodes = nodes.unionByName(level)
    return nodes, top


def damaged(primary: DataFrame, replica: DataFrame, top: int) -> DataFrame:
    """Leaves (shard, pos, start, stop) whose hashes differ, found from the roots down through differing nodes only."""
    suspects = None
    for level in range(top, -1, -1):
        ours = primary.filter(F.col("level") == level).select("shard", "pos", "start", "stop", "hash")
        theirs = replica.filter(F.col("level") == level).select("shard", "pos", F.col("hash").alias("other"))
        if suspects is not None:
            parents = suspects.select("shard", F.col("pos").alias("up"))
            below = lambda n: n.withColumn("up", F.floor(F.col("pos") / FANOUT)).join(parents, ["shard", "up"], "left_semi").drop("up")  # noqa: E731, B023
            ours, theirs = below(ours), below(theirs)
        pairs = ours.join(theirs, ["shard", "pos"], "left")
        suspects = staged(pairs.filter(~F.coalesce(F.col("hash") == F.col("other"), F.lit(False))).select("shard", "pos", "start", "stop"), "merkle")
    return suspects


def replicate(manifest: DataFrame, folder: str, flip: int | None = None) -> DataFrame:
    """Copy the archives to ``folder``; with ``flip``, one stored byte of each record whose key leaves 1 modulo it is inverted.

    The planted damage is for audits of known outcome. Returns what was copied (shard, n_damaged).
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, at = files.located(row["path"])
                target, to = files.located(f"{folder}/{row['path'].rsplit('/', 1)[1]}")
                target.create_dir(to.rsplit("/", 1)[0], recursive=True)
                hurt = 0
                with system.open_input_file(at) as source, target.open_output_stream(to, compression=None) as sink:
                    end = 0
                    for key, null, _, _, offset, length in _index(source):
                        source.seek(offset)
                        data, end = bytearray(source.read(length)), offset + length
                        if flip and not null and key % flip == 1:
                            data[length // 2] ^= 0xFF
                            hurt += 1
                        sink.write(bytes(data))
                    source.seek(end)
                    sink.write(source.read())
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]]), pa.array([hurt], pa.int64())], ["shard", "n_damaged"])

    return staged(files.spread(manifest).mapInArrow(task, "shard bigint, n_damaged bigint"), "replica")


def _damage(manifest: DataFrame, replica: str) -> DataFrame:
    ours, top = tree(leaves(manifest))
    theirs, _ = tree(leaves(manifest, replica))
    return damaged(ours, theirs, top)


def _states(manifest: DataFrame, bad: DataFrame) -> DataFrame:
    bad = bad.select("shard", F.col("pos").alias("seq"), F.lit("damaged").alias("status"))
    found = records(manifest).join(bad, ["shard", "seq"], "left")
    return found.select("key", "body_bytes", "body_sha256", F.coalesce("status", F.lit("intact")).alias("status"), "shard", "offset", "length")


def audit(manifest: DataFrame, replica: str) -> DataFrame:
    """Every record with its state in the replica: key, body_bytes, body_sha256, status, shard, offset, length."""
    return _states(manifest, _damage(manifest, replica))


def _listed(manifest: DataFrame, folder: str) -> DataFrame:
    """Paths below ``folder`` of all its files, listed by one task as they are names only."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            system, at = files.located(folder)
            found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
            names = [f.path[len(at.rstrip("/")) + 1 :] for f in found if f.type == fs.FileType.File]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    return manifest.sparkSession.range(0, 1, 1, 1).mapInArrow(task, "file string")


def _file_states(manifest: DataFrame, replica: str, bad: DataFrame) -> DataFrame:
    shards = manifest.select("shard", F.element_at(F.split("path", "/"), -1).alias("file"), "n_records")
    there = staged(_listed(manifest, replica), "replica-files")
    hurt = bad.join(shards, "shard").groupBy("shard").agg(
        F.count(F.when(F.col("pos") < F.col("n_records"), 1)).alias("n_damaged"), F.max((F.col("pos") == F.col("n_records")).cast("int")).alias("tail")
    )
    known = shards.join(hurt, "shard", "left").join(there.withColumn("there", F.lit(True)), "file", "left")
    status = F.when(F.col("there").isNull(), "missing").when(F.coalesce("n_damaged", F.lit(0)) > 0, "damaged").when(F.col("tail") == 1, "tail").otherwise("intact")
    known = known.select("file", "shard", status.alias("status"), F.coalesce("n_damaged", F.lit(0)).alias("n_damaged"), F.coalesce(F.col("tail") == 1, F.lit(False)).alias("tail_differs"))
    extra = there.join(shards.select("file"), "file", "left_anti")
    return known.union(extra.select("file", F.lit(None).cast("bigint"), F.lit("extra"), F.lit(0).cast("bigint"), F.lit(False)))


def file_audit(manifest: DataFrame, replica: str) -> DataFrame:
    """Every file of the manifest or the replica: file, shard, status, n_damaged (records), tail_differs.

    ``status`` is intact, damaged (records), tail (only what follows the records), missing, or extra (the replica's alone).
    """
    return _file_states(manifest, replica, _damage(manifest, replica))


def audited_copy(pages: DataFrame, flip: int = 101) -> DataFrame:
    """Write ``pages`` as archives, copy them with planted damage, and locate it: page_id, body_bytes, body_sha256, status."""
    spark = pages.sparkSession
    folder, copy = shared_folder(spark, "warc"), shared_folder(spark, "warc-replica")
    manifest = write_archive(pages, folder)
    replicate(manifest, copy, flip)
    return audit(manifest, copy).select(F.col("key").alias("page_id"), "body_bytes", "body_sha256", "status")
