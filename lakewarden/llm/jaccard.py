"""N-gram Jaccard join by vertical partitioning.

A document's set holds its distinct four-word shingles. Two documents are linked when their sets have a Jaccard
similarity of ``LEAST`` hundredths or more. Shingles are 64-bit hashes: a pair's overlap would be off only if two of its
own few thousand shingles collided.

1. Equal sets are one class (128-bit digest of the sorted set), so copies of any number are one entry.
2. A shingle that only one document has is in no overlap, so a document with more than 15% of such shingles has no partner
   but its copies. This is counted on a quarter of the hash space, before any whole set is moved, and then on whole sets of
   the classes that are left. Their documents are picked by a Bloom filter of ids while texts are read once more, so that no
   text is shuffled; where they are too many for its ``BLOOM_BITS``, by a join before it.
3. The global order of shingles, rare ones first, is cut into ``FRAGMENTS`` fragments of about equal weight, and every set
   into one segment per fragment. The first 15% of a set (prefix) meet the prefix of every partner.
4. Pairs are proposed by shingles of the prefixes, within length bounds and as far as the positions leave enough overlap.
   Each fragment counts the overlap of its two segments on its own, and the counts are summed per pair.

A family of thousands of near copies would propose all its pairs, though a few links hold it together. Therefore
proposals come in two turns. First every shingle proposes its members to one of them only, the member whose shingles are
the most frequent (a family's original, which all edited copies share most with). Then all pairs of *different* components of
that graph are proposed, left side without the shingle's largest component. Links inside a component can't change
it, so the components are those of all links: none is lost, no list is capped.

Defined results: null, empty and blank texts have an empty set, are linked with nothing and are their own component.
Fewer than four words make one shingle. Repeated rows are reported as often as they come. A null id takes part in linking;
a component of null ids only has a null component_id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_text
from .components import components

LEAST, WORDS, SEED = 85, 4, 42
FRAGMENTS, BANDS_PER_DOUBLING = 8, 4
BLOOM_BITS = 1 << 26  # at most; sized to 16 bits an id
KNOWN = 1 << 19  # words whose hashes a worker remembers; starts afresh when full
MIX = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63], dtype="<u8")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def shingle_set(text: str, hashes: dict) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype="<i8")
    each = np.fromiter(map(hashes.__getitem__, words), dtype="<u8", count=len(words))
    width = min(WORDS, len(words))
    mixed = np.full(len(words) - width + 1, width, dtype="<u8")
    for i in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX[i] + each[i : len(words) - width + 1 + i]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * MIX[0]
    return np.unique((mixed ^ (mixed >> np.uint64(29))).view("<i8"))


def _sets(part: int, marks: np.ndarray | None) -> Callable:
    """A task that gives (doc_id, n, digest, shingles) per row, with the shingles whose hash is a multiple of ``part``.

    With ``marks``, the bits of a Bloom filter, only for the rows whose marked id may be in it.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            if marks is not None:
                mark = batch.column(2).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(np.logical_and(*(marks[at >> 6] >> (at & 63) & 1 for at in _spots(mark, len(marks) * 64)))))
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                sets = [shingle_set(t.as_py(), hashes) for t in rows.column(1)]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                chosen = [s[s % part == 0] for s in sets] if part > 1 else sets
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in chosen])]).astype("<i4")
                values = pa.array(np.concatenate(chosen), pa.int64())
                columns = [rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "n", "digest", "shingles"])

    return task


def _spots(mark, bits: int) -> tuple:
    """The two bits of a hashed id in a filter of ``bits`` (a power of two) bits."""
    return mark & (bits - 1), (mark >> 32) & (bits - 1)


def _with_sets(docs: DataFrame, part: int, marks: np.ndarray | None = None) -> DataFrame:
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(doc_id.alias("doc_id"), whole_text().alias("text"), F.xxhash64(doc_id).alias("mark"))
    return rows.mapInArrow(_sets(part, marks), "doc_id bigint, n bigint, digest binary, shingles array<bigint>")


def _marks(ids: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of ``count`` ids (doc_id), collected by words; at most BLOOM_BITS."""
    bits = min(BLOOM_BITS, 1 << max(6, (16 * count - 1).bit_length()))
    mark = F.xxhash64("doc_id")
    spots = F.explode(F.array(mark.bitwiseAND(F.lit(bits - 1)), F.shiftright(mark, 32).bitwiseAND(F.lit(bits - 1)))).alias("at")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    words = ids.select(spots).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    marks = np.zeros(bits // 64, dtype="<i8")
    for r in words.toLocalIterator():
        marks[r.word] = r.bits
    return marks


def _sharing(sets: DataFrame) -> DataFrame:
    """The ids of those (id, n, shingles) with at most 15% of n among shingles that no other set has."""
    each = sets.select("id", F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("id"))
    lone = each.filter("df = 1").groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
    return sets.select("id", "n").join(lone, "id", "left").filter(F.coalesce("lone", F.lit(0)) * 100 <= F.col("n") * (100 - LEAST)).select("id")


def _band(df: Column) -> Column:
    """Frequencies in logarithmic bands: the coarse part of the global order, which the hash refines."""
    return F.floor(F.log2(df) * BANDS_PER_DOUBLING).cast("int")


def _cuts(weights: dict[int, int]) -> list[tuple[int, int]]:
    """(band, hash) at which the global order is cut so that fragments hold about the same number of set members."""
    total, seen, cuts = sum(weights.values()), 0, []
    for band, weight in sorted(weights.items()):
        while len(cuts) < FRAGMENTS - 1 and seen + weight > (goal := total * (len(cuts) + 1) / FRAGMENTS):
            cuts.append((band, int((goal - seen) / weight * 2**64) - 2**63))
        seen += weight
    return cuts


def _segments(sets: DataFrame) -> DataFrame:
    """(id, n, weight, frag, head, segment) for sets (id, n, shingles).

    ``segment`` has the set's members in one fragment in the global order, without those of one set only; ``head`` is the
    number of members before it, and ``weight`` the mean band of all.
    """
    each = sets.select("id", "n", F.explode("shingles").alias("h"))
    common = staged(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("h", _band(F.col("df")).alias("band"), "df"), "jaccard-order")
    weights = {r.band: r.weight for r in common.groupBy("band").agg(F.sum("df").alias("weight")).collect()}  # at most 256 bands
    after = [(F.col("band") > b) | ((F.col("band") == b) & (F.col("h") >= h)) for b, h in _cuts(weights)]
    frag = sum([a.cast("int") for a in after], F.lit(0))
    cut = each.join(common.drop("df"), "h").withColumn("frag", frag).groupBy("id", "n", "frag").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("band", "h"))), lambda s: s["h"]).alias("segment"), F.sum("band").alias("bands")
    )
    cut = staged(cut, "jaccard-segments")
    sizes = cut.groupBy("id", "n").agg(
        F.sum(F.size("segment")).alias("common"), (F.sum("bands") / F.col("n")).alias("weight"),
        *[F.sum(F.when(F.col("frag") < f, F.size("segment")).otherwise(0)).alias(f"before{f}") for f in range(FRAGMENTS)],
    )
    head = F.element_at(F.array(*[F.col(f"before{f}") for f in range(FRAGMENTS)]), F.col("frag") + 1)
    kept = sizes.filter((F.col("n") - F.col("common")) * 100 <= F.col("n") * (100 - LEAST)).withColumnRenamed("id", "of").drop("n")
    return cut.join(kept, F.col("id") == F.col("of")).select("id", "n", "weight", "frag", (F.col("n") - F.col("common") + head).alias("head"), "segment")


def _prefixes(segments: DataFrame) -> DataFrame:
    """(h, id, n, weight, at): the members within the first 15% of each set, with their positions."""
    size = F.col("n") - F.ceil(F.col("n") * LEAST / 100) + 1
    begun = segments.filter(F.col("head") < size)
    each = begun.select("id", "n", "weight", "head", size.alias("size"), F.posexplode("segment").alias("pos", "h"))
    return each.select("h", "id", "n", "weight", (F.col("head") + F.col("pos")).alias("at")).filter(F.col("at") < F.col("size"))


def _possible(a: str, b: str) -> Column:
    """Lengths within bounds, and enough members left behind a first common one to reach the similarity."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(na - F.col(f"{a}.at"), nb - F.col(f"{b}.at"))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * LEAST) & (left * (100 + LEAST) >= (na + nb) * LEAST)


def _counted(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Those pairs (a, b) that reach the similarity: each fragment counts its own overlap, and the counts are summed."""
    left = segments.select(F.col("id").alias("a"), F.col("n").alias("na"), "frag", F.col("segment").alias("of_a"))
    right = segments.select(F.col("id").alias("b"), F.col("n").alias("nb"), "frag", F.col("segment").alias("of_b"))
    partial = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("of_a", "of_b")).alias("part"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both")).filter(
        F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * LEAST
    ).select("a", "b")


def links(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) among sets (id, n, shingles) that connect all that is linked: every pair returned has the similarity,
    and any two sets of that similarity are in one component of the pairs."""
    segments = staged(_segments(sets), "jaccard-segments")
    members = staged(_prefixes(segments), "jaccard-prefixes")
    hubs = members.groupBy("h").agg(F.max(F.struct("weight", F.negative("id").alias("key"), "n", "at")).alias("hub"), F.count(F.lit(1)).alias("size"))
    hubs = hubs.filter("size > 1").select("h", F.negative("hub.key").alias("id"), "hub.n", "hub.at")
    first = members.alias("x").join(hubs.alias("y"), "h").filter((F.col("x.id") != F.col("y.id")) & _possible("x", "y"))
    ordered = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]
    found = staged(_counted(first.select(*ordered).distinct(), segments), "jaccard-links")
    placed = members.join(components(found), F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("root", "id"))
    placed = staged(placed.select("h", "id", "n", "at", "part"), "jaccard-parts")
    parts = placed.groupBy("h", "part").agg(F.count(F.lit(1)).alias("size"))
    mixed = parts.groupBy("h").agg(F.max_by("part", F.struct("size", "part")).alias("largest"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    mixed = staged(placed.join(mixed.drop("parts"), "h"), "jaccard-parts")
    left, right = mixed.filter("part <> largest"), mixed
    across = left.alias("x").join(right.alias("y"), "h").filter((F.col("x.part") != F.col("y.part")) & _possible("x", "y"))
    return found.union(_counted(across.select(*ordered).distinct(), segments))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable)."""
    rows = staged(_with_sets(docs, 4).withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")
    classes = rows.filter("n > 0").groupBy("digest", "n").agg(F.min("row").alias("id"), F.min("doc_id").alias("least"))
    classes = staged(classes, "jaccard-classes")
    sharing = _sharing(rows.filter("n > 0").select(F.col("row").alias("id"), "n", "shingles"))
    likely = classes.select("digest", "id").join(sharing, "id").join(rows.select(F.col("row").alias("id"), "doc_id"), "id")
    likely = staged(likely, "jaccard-likely")
    count = likely.count()
    if 16 * count > BLOOM_BITS:
        wanted = likely.select(F.col("doc_id").alias("wanted")).distinct()
        docs = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["wanted"]), "left_semi")
    whole = _with_sets(docs, 1, _marks(likely, count)).dropDuplicates(["digest"]).join(likely.select("digest", "id"), "digest")
    whole = staged(whole.select("id", "n", "shingles"), "jaccard-whole")
    roots = components(links(whole.join(staged(_sharing(whole), "jaccard-sharing"), "id", "left_semi")))
    placed = classes.join(roots, classes["id"] == roots["node"], "left").select("digest", "least", F.coalesce("root", "id").alias("root"))
    placed = staged(placed, "jaccard-classes")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = placed.join(ids, "root").select("digest", "component_id")
    joined = rows.select("doc_id", "n", "digest").join(found, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
