"""Binary shard files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, s3, gs, hdfs) and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def write_shards(rows: DataFrame, order: list, folder: str, write: Callable, suffix: str, columns: str) -> DataFrame:
    """Range-partition ``rows`` by ``order``, sort, and let each task write one file; returns the manifest.

    ``write(sink, batches)`` gets an open output stream and the task's record batches and returns a dict for the manifest
    columns named in the DDL ``columns``. The order needs a last column that tells equal rows apart, so that a
    frequent value is divided among tasks. Every attempt writes a file of its own; the manifest, a table in the shared
    folder, names the file of the attempt that succeeded, so repeated and speculative tasks leave no trace in what
    readers see. Shard numbers ascend with the order; a task without rows writes nothing.
    """
    names = [c.split()[0] for c in columns.split(",")]
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in columns.split(",")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        path = f"{folder}/part-{shard:06d}-{uuid.uuid4().hex}{suffix}"
        system, at = located(path)
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(at, compression=None) as sink:
            facts = write(sink, _chained(first, batches))
        values = [pa.array([shard], pa.int64()), pa.array([path])] + [pa.array([facts[n]], t) for n, t in zip(names, types)]
        yield pa.RecordBatch.from_arrays(values, ["shard", "path", *names])

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(sorted_rows.mapInArrow(task, f"shard bigint, path string, {columns}"), "manifest")


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def spread(manifest: DataFrame) -> DataFrame:
    """The manifest with one file or range per partition, as its few bytes say nothing of the work behind them."""
    return manifest.repartition(max(1, manifest.count()))
