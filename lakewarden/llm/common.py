"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which every executor and the driver can reach.

    Where the setting is absent, a session on one machine gets a temporary folder; a cluster is refused, as
    its executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lakewarden-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where the driver has it, whatever their folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (known, root) if p)
    return spark


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """A text with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """The rows of ``docs`` as one struct ``row`` beside working columns, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain ASCII texts take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """About ``most`` labelled documents (doc_id, text, label) outside the held-out fold; all if there are fewer.

    Rows are picked by a hash of their id, so the choice does not depend on partitions. The bound is on the
    rows a model is fitted on, never on the rows that are scored. Ids with null labels are skipped; of several
    labels of one id the largest counts. The sampled ids are bounded by ``most`` and therefore broadcast.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    usable = usable.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    total = usable.count()
    if total > most:
        part = int(most / total * 2**31)
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < part)
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(usable), "doc_id")


def pieces(items: list, budget: int, size=len) -> Iterator[list]:
    """Consecutive runs of ``items`` whose sizes sum to about ``budget``; a larger item is alone."""
    run, weight = [], 0
    for item in items:
        if run and weight + size(item) > budget:
            yield run
            run, weight = [], 0
        run.append(item)
        weight += size(item)
    if run:
        yield run
