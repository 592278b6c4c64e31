"""Token ids of documents in seekable files: independent zstandard frames with a trailing seek table.

File format, all numbers little-endian:

- frames: each holds up to ``FRAME_IDS`` ids of one document as unsigned 32-bit integers, with zstandard's own content
  checksum. A document without ids would have one empty frame; a long one has several.
- a skippable frame (magic 0x184D2A50) with the documents in file order: 4 bytes "TIDX", the count (u64), then per column
  ids (i64), null flags (u8), frames (u32) and numbers of ids (u64).
- a skippable frame (magic 0x184D2A5E), the seek table of zstandard's seekable format: per frame compressed size,
  decompressed size and the low half of the content's XXH64 (u32 each); then the number of frames (u32), a descriptor
  byte with the checksum flag, and the magic 0x8F92EAB1.

A reader fetches the tables from the end of the file and then only the frames of the documents it wants. Any
zstandard tool can decompress the file as a whole.

Defined results: a null text is empty; every document ends with ``end_id``, so an empty one has one id. Null ids come
first in the order. Rows that repeat an id are written as often as they come. An empty table makes no file. Extra
columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .common import pieces, shared_folder, whole_text

END_ID = 1
FRAME_IDS = 1 << 20
LEVEL = 1
RUN = 1 << 23  # bytes of texts whose chunks are numbered at once
JOINED = 1 << 18  # bytes of words that the library encodes in one call
KNOWN = 300_000  # words and signs whose ids a Python worker remembers per generation, of which it holds two
SIGNS = ".,!#$%&*|"
INDEX_MAGIC, SEEK_MAGIC, TAIL_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


class Encoder:
    """Ids of whole texts by the tokenizers library, with the ids of words and signs remembered.

    The vocabulary turns white space into one blank and never builds a token across it, so a text's ids are those of
    its chunks in turn, and a chunk's are those of its letters and of the signs after them. ``separable`` checks
    this of a vocabulary; any other, and a text that holds a special token in any case, is encoded whole. The library
    itself says which characters are still letters once they are normalised; a chunk with others before its signs is
    not cut. Letters are lower-cased beforehand in plain ASCII texts and words if the vocabulary does so itself.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer, spec = Tokenizer.from_str(vocabulary), json.loads(vocabulary)
        self.by_chunk = self.separable(spec)
        self.special = [t["content"].encode().lower().decode() for t in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix and self.by_chunk:
            size = max(spec["model"]["vocab"].values()) + 1
            self.ends = np.zeros(max(size, self.tokenizer.get_vocab_size()), dtype=bool)
            self.ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.letters: dict[str, bool] = {}

    @staticmethod
    def separable(spec: dict) -> bool:
        """Whether white space is dropped and letters are lower-cased before words are cut."""
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        return steps == ["NFC", "Replace", "Lowercase"] and len(cuts) == 1 and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and "[\\p{L}]+" in cuts[0]["pattern"].get("Regex", "")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letter(self, char: str) -> bool:
        """Whether a character is normalised to letters only, so that signs after it are cut off."""
        if not char.isalpha():
            return False
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(f"a{char}."))
        return len(cut) == 2 and cut[1][0] == "."

    def _are_words(self, texts: list[str]) -> list[bool]:
        """Whether each text consists of letters."""
        chars = set("".join(texts))
        self.letters.update((c, self._letter(c)) for c in chars - self.letters.keys())
        others = {c for c in chars if not self.letters[c]}
        return [t != "" and others.isdisjoint(t) for t in texts]

    def _learn(self, parts: list[bytes]) -> None:
        """Add the ids of parts: many words in one call, as a word ends where a token with the end-of-word mark stands."""
        texts = [p.decode() for p in parts]
        are_words = self._are_words(texts)
        for run in pieces([p for p, word in zip(parts, are_words) if word], JOINED):
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(run).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist() if self.ends is not None else []
            if len(stops) != len(run):
                found = self._whole([s.decode() for s in run])
            else:
                data = ids.tobytes()
                found = [data[a:b] for a, b in zip([0, *stops], stops)]
            self.known.update(zip(run, found))
        signs = [p for p, word in zip(parts, are_words) if not word]
        self.known.update(zip(signs, self._whole([s.decode() for s in signs])))

    def _looked_up(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct parts, encoded where they are new."""
        found = list(map(self.known.get, parts))
        lacking = [p for p, ids in zip(parts, found) if ids is None]
        again = {p: ids for p in lacking if (ids := self.before.get(p)) is not None}
        self.known.update(again)
        self._learn([p for p in lacking if p not in again])
        found = [self.known[p] if ids is None else ids for p, ids in zip(parts, found)]
        if len(self.known) > KNOWN:  # what is seen again moves on to the next generation
            self.before, self.known = self.known, {}
        return found

    def _of_chunks(self, chunks: pa.Array) -> pa.Array:
        """The ids of distinct chunks as lists: each is cut into its letters and the signs after them, or left whole."""
        stems = pc.ascii_rtrim(chunks, SIGNS)
        cut = pc.ascii_is_alpha(stems).to_numpy(zero_copy_only=False).copy()
        foreign = pc.invert(pc.string_is_ascii(stems))
        cut[foreign.to_numpy(zero_copy_only=False)] = self._are_words([s.decode() for s in _byte_strings(stems.filter(foreign))])
        ends = _ends(chunks)
        bounds = np.empty(2 * len(chunks) + 1, dtype="<i8")
        bounds[::2] = ends
        bounds[1::2] = np.where(cut, ends[:-1] + pc.binary_length(stems).to_numpy(), ends[1:])
        parts = pa.LargeStringArray.from_buffers(2 * len(chunks), pa.py_buffer(bounds), chunks.buffers()[2])
        coded = pc.if_else(pc.ascii_is_alpha(parts), pc.ascii_lower(parts), parts).dictionary_encode()
        lists = _lists(self._looked_up(_byte_strings(coded.dictionary))).take(coded.indices)
        return pa.LargeListArray.from_arrays(pa.array(lists.offsets.to_numpy()[::2]), lists.values)

    def _assembled(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of texts by their chunks: cut and numbered as Arrow columns, looked up once per distinct chunk."""
        cut = pc.ascii_split_whitespace(texts)
        coded = cut.flatten().dictionary_encode()
        ids = self._of_chunks(coded.dictionary).take(coded.indices)
        ends = ids.offsets.to_numpy()[cut.offsets.to_numpy()]
        flat = ids.values.to_numpy()
        return (flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:]))

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column without nulls as little-endian unsigned 32-bit integers."""
        sizes = pc.binary_length(texts).to_pylist()
        for run in pieces(range(len(texts)), RUN, sizes.__getitem__):
            part = texts.take(pa.array(run)).cast(pa.large_string())  # a copy, as ascii_lower misreads a slice that was cast
            lower = pc.ascii_lower(part)
            whole = np.full(len(part), not self.by_chunk)
            for token in self.special:
                whole |= pc.match_substring(lower, token).to_numpy(zero_copy_only=False)
            ids = self._assembled(pc.if_else(pc.string_is_ascii(part), lower, part).filter(pa.array(~whole)))
            for i, alone in enumerate(whole.tolist()):
                yield self._whole([part[i].as_py()])[0] if alone else next(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(self.encode_column(pa.array([t.encode("utf-8", "replace") for t in texts], pa.large_string())))


def _ends(texts: pa.Array) -> np.ndarray:
    """The bounds of a string array's values in its buffer."""
    return np.frombuffer(texts.buffers()[1], dtype="<i8")[texts.offset : texts.offset + len(texts) + 1]


def _byte_strings(texts: pa.Array) -> list[bytes]:
    """The values of a string array without nulls, cut from its buffer."""
    ends = _ends(texts).tolist()
    data = texts.buffers()[2].to_pybytes() if texts.buffers()[2] else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def _lists(found: list[bytes]) -> pa.Array:
    """Ids as bytes turned into an array of lists."""
    ends = np.zeros(len(found) + 1, dtype="<i8")
    np.cumsum(np.fromiter(map(len, found), dtype="<i8", count=len(found)) // 4, out=ends[1:])
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype="<u4")))


_encoders: dict[int, Encoder] = {}  # one per Python worker and vocabulary, so that later tasks find its memory filled


def encoder(vocabulary: str) -> Encoder:
    key = zlib.crc32(vocabulary.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def write_file(sink, documents: Iterable[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Write (id, ids as bytes) pairs in the format above; the numbers of documents and of ids."""
    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    seek, ids, nulls, frames, counts = [], [], [], [], []
    for doc_id, data in documents:
        parts = [data[i : i + 4 * FRAME_IDS] for i in range(0, len(data), 4 * FRAME_IDS)] or [b""]
        for part in parts:
            frame = packer.compress(part)
            sink.write(frame)
            seek.append((len(frame), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        ids.append(doc_id or 0)
        nulls.append(doc_id is None)
        frames.append(len(parts))
        counts.append(len(data) // 4)
    index = b"TIDX" + struct.pack("<Q", len(ids)) + b"".join(
        np.array(v, dtype=t).tobytes() for v, t in ((ids, "<i8"), (nulls, "u1"), (frames, "<u4"), (counts, "<u8"))
    )
    table = np.array(seek, dtype="<u4").tobytes() + struct.pack("<IBI", len(seek), CHECKSUMS, TAIL_MAGIC)
    for magic, body in ((INDEX_MAGIC, index), (SEEK_MAGIC, table)):
        sink.write(struct.pack("<II", magic, len(body)) + body)
    return len(ids), sum(counts)


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != TAIL_MAGIC or not flags & CHECKSUMS:
            raise ValueError("No seek table with checksums at the end of the file")
        seek_at = size - 9 - 12 * count - 8
        self.seek = np.frombuffer(self._at(seek_at + 8, 12 * count), dtype="<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.seek[:, 0], dtype=np.int64)])
        index_at = int(self.starts[-1])
        body = self._at(index_at + 8, seek_at - index_at - 8)
        if body[:4] != b"TIDX":
            raise ValueError("No document index before the seek table")
        n, at, columns = struct.unpack("<Q", body[4:12])[0], 12, []
        for kind, width in (("<i8", 8), ("u1", 1), ("<u4", 4), ("<u8", 8)):
            columns.append(np.frombuffer(body, dtype=kind, count=n, offset=at))
            at += width * n
        ids, nulls, self.frames, self.counts = columns
        self.ids = [None if null else int(i) for i, null in zip(ids, nulls)]
        self.first = np.concatenate([[0], np.cumsum(self.frames, dtype=np.int64)])
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def document(self, i: int) -> bytes:
        """The ids of the i-th document as bytes; only its frames are read, and their checksums must hold."""
        out = []
        for f in range(int(self.first[i]), int(self.first[i + 1])):
            part = self.unpacker.decompress(self._at(int(self.starts[f]), int(self.seek[f, 0])), max_output_size=int(self.seek[f, 1]) or 1)
            if len(part) != self.seek[f, 1] or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != self.seek[f, 2]:
                raise ValueError(f"Frame {f} does not match its entry in the seek table")
            out.append(part)
        return b"".join(out)


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode and write ``docs`` in ascending doc_id order; the manifest (shard, path, n_docs, n_tokens)."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one file of fixed size
    end = struct.pack("<I", end_id)

    def task(sink, batches: Iterator[pa.RecordBatch]) -> dict:
        coder = encoder(shipped.value)

        def documents():
            for batch in batches:
                for doc_id, data in zip(batch.column(0).to_pylist(), coder.encode_column(batch.column(1))):
                    yield doc_id, data + end

        n_docs, n_tokens = write_file(sink, documents())
        return {"n_docs": n_docs, "n_tokens": n_tokens}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"), F.monotonically_increasing_id().alias("row"))
    return files.write_shards(rows, ["doc_id", "row"], folder, task, ".tok.zst", "n_docs bigint, n_tokens bigint")


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, shard, position in the shard."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, at = files.located(row["path"])
                with system.open_input_file(at) as source:
                    doc = TokenFile(source)
                    starts = row["base"] + np.concatenate([[0], np.cumsum(doc.counts[:-1], dtype=np.int64)])
                    for run in (range(i, min(i + 4096, len(doc.ids))) for i in range(0, len(doc.ids), 4096)):
                        sums = [zlib.crc32(doc.document(i)) for i in run]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([doc.ids[i] for i in run], pa.int64()), pa.array(starts[run.start : run.stop]),
                            pa.array(doc.counts[run.start : run.stop].astype(np.int64)), pa.array(sums, pa.int64()),
                            pa.array([row["shard"]] * len(run), pa.int64()), pa.array(list(run), pa.int64()),
                        ], ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "position"])

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return files.spread(based).mapInArrow(task, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard bigint, position bigint")


def round_trip(docs: DataFrame, vocabulary_path: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read every document back."""
    with open(vocabulary_path, encoding="utf-8") as f:  # a file of the driver, not an input table
        vocabulary = f.read()
    return read(write(docs, vocabulary, shared_folder(docs.sparkSession, "tokens"), end_id))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
