"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed and its parts are rebuilt: the normaliser (character map, white space rules, the
metaspace marker), the unigram scores or, for a merge model, the merges ranked by the scores of what they make,
and byte fallback. Batches are encoded by several threads; ids are compared with SentencePiece's own.

A piece of most models has the marker at its front only. Such a model never builds a token across a blank, so the ids of
a text are those of the chunks between its single blanks, and so is what they decode to: the ids of a chunk begin with a
marker, so bytes that make up a character never span two. Texts are cut into chunks and these numbered as Arrow columns; each
distinct chunk is encoded, decoded and compared once per Python worker and remembered. Other models, and texts with
runs of blanks, blanks at an end or a literal marker, are encoded, decoded and compared whole. A text or chunk whose ids
differ is marked and takes SentencePiece's ids.

Defined results: null and empty texts have no ids and decode to the empty text. Repeated rows are encoded alike; null
ids of documents are kept; an empty table gives no rows; extra columns are ignored by ``encoded`` and kept by
``with_ids`` unless they are named ``token_ids``, ``n_tokens``, ``parity`` or ``round_trip``, which are replaced. Texts are encoded whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, whole_text

THREADS = 2
RUN = 1 << 20  # bytes of texts whose chunks are numbered at once
BATCH = 1 << 16  # characters that the libraries get in one call
JOINED = 500  # characters of chunks that are encoded as one text
KNOWN = 300_000  # chunks that a Python worker remembers per generation, of which it holds two
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)  # fixed values: kinds of pieces in the protobuf
UNIGRAM, BPE = 1, 2  # fixed values: kinds of models in the protobuf


def parsed(model: bytes):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model)
    return spec


def rebuilt(spec):
    """A tokenizer of the tokenizers library that does what the SentencePiece model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    rules, kinds = spec.normalizer_spec, [p.type for p in spec.pieces]
    if rules.escape_whitespaces is False or spec.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("Models without the metaspace marker in front of words are not supported")
    vocab = {p.piece: i for i, p in enumerate(spec.pieces)}
    unknown, fallback = kinds.index(UNKNOWN), BYTE in kinds
    if spec.trainer_spec.model_type == UNIGRAM:
        low = min(p.score for p in spec.pieces) - 10.0
        scores = [(p.piece, p.score if p.type in (NORMAL, USER_DEFINED) else low) for p in spec.pieces]
        model = models.Unigram(scores, unknown, fallback)
    elif spec.trainer_spec.model_type == BPE:
        score = {p.piece: p.score for p in spec.pieces if p.type in (NORMAL, USER_DEFINED)}
        pairs = [(-score[w], len(w), vocab[w], i, (w[:i], w[i:])) for w in score for i in range(1, len(w)) if w[:i] in score and w[i:] in score]
        merges = [pair for *_, pair in sorted(pairs)]
        model = models.BPE(vocab, merges, unk_token=spec.pieces[unknown].piece, fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError("Only unigram and merge models are supported")
    steps = [normalizers.Precompiled(rules.precompiled_charsmap)] if rules.precompiled_charsmap else []
    if rules.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if rules.add_dummy_prefix else []
    out = Tokenizer(model)
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    strip = [decoders.Strip(" ", 1, 0)] if rules.add_dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


class Codec:
    """Encoding, decoding and the comparison with SentencePiece, with remembered chunks."""

    def __init__(self, model: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        from sentencepiece import SentencePieceProcessor

        spec = parsed(model)
        rules = spec.normalizer_spec
        self.tokenizer, self.reference = rebuilt(spec), SentencePieceProcessor(model_proto=model)
        real = [p.piece for p in spec.pieces if p.type in (NORMAL, USER_DEFINED)]
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces
        self.by_chunk = plain and MARK in real and not any(MARK in p.lstrip(MARK) for p in real)
        self.joins = spec.trainer_spec.model_type == BPE  # sums of unigram scores are rounded, so that ties may hang on the chunks before
        self.opens = np.array([p.piece.startswith(MARK) for p in spec.pieces])
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.wrong: set[str] = set()  # remembered chunks whose ids did not agree
        self.bent: set[str] = set()  # remembered chunks whose ids decode to something else

    def _compared(self, texts: list[str]) -> Iterator[tuple[list[int], bool, bool]]:
        """Per text SentencePiece's ids, whether the tokenizer has the same, and whether decoding them gives the text."""
        for run in pieces(texts, BATCH):
            mine = [e.ids for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]
            theirs = self.reference.encode(run, num_threads=1)
            back = self.tokenizer.decode_batch(theirs, skip_special_tokens=False)
            yield from ((t, m == t, b == text.replace(MARK, " ")) for text, m, t, b in zip(run, mine, theirs, back))

    def _learn(self, chunks: list[str]) -> None:
        """Many chunks in one text: a chunk begins where a token with the marker in front stands."""
        runs = list(pieces(chunks, JOINED)) if self.joins else []
        alone = [] if self.joins else chunks
        for run, (ids, same, back) in zip(runs, self._compared([" ".join(run) for run in runs])):
            row = np.array(ids, dtype="<u4")
            starts = (np.flatnonzero(self.opens[row]) * 4).tolist()
            if same and back and len(starts) == len(run):
                data = row.tobytes()
                self.known.update((c, data[a:b]) for c, a, b in zip(run, starts, [*starts[1:], len(data)]))
            else:
                alone += run
        for chunk, (ids, same, back) in zip(alone, self._compared(alone)):
            self.known[chunk] = np.array(ids, dtype="<u4").tobytes()
            if not same:
                self.wrong.add(chunk)
            if not back:
                self.bent.add(chunk)

    def _looked_up(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks, encoded where they are new."""
        found = list(map(self.known.get, chunks))
        lacking = [c for c, ids in zip(chunks, found) if ids is None]
        again = {c: ids for c in lacking if (ids := self.before.get(c)) is not None}
        self.known.update(again)
        self._learn([c for c in lacking if c not in again])
        return [self.known[c] if ids is None else ids for c, ids in zip(chunks, found)]

    def _assembled(self, texts: pa.Array) -> Iterator[tuple[bytes, bool, bool]]:
        """What ``_compared`` gives, by the chunks of the texts: looked up once per distinct chunk."""
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        found = self._looked_up(chunks)
        ends = np.zeros(len(found) + 1, dtype="<i8")
        np.cumsum(np.fromiter(map(len, found), dtype="<i8", count=len(found)) // 4, out=ends[1:])
        ids = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype="<u4"))).take(coded.indices)
        cuts = cut.offsets.to_numpy()
        bounds, flat = ids.offsets.to_numpy()[cuts].tolist(), ids.values.to_numpy()

        def none_of(marked: set[str]) -> list[bool]:
            if marked.isdisjoint(chunks):
                return [True] * len(texts)
            hits = np.array([c in marked for c in chunks])[coded.indices.to_numpy()]
            return (np.diff(np.cumsum([0, *hits])[cuts]) == 0).tolist()

        same, back = none_of(self.wrong), none_of(self.bent)
        if len(self.known) > KNOWN:  # what is seen again moves on to the next generation
            self.before, self.known = self.known, {}
            self.wrong.intersection_update(self.before)
            self.bent.intersection_update(self.before)
        return ((flat[a:b].tobytes(), s, r) for a, b, s, r in zip(bounds, bounds[1:], same, back))

    def compared(self, texts: pa.Array) -> Iterator[list[tuple[bytes, bool, bool]]]:
        """Runs of a column without nulls. Per text its ids as little-endian unsigned 32-bit integers, whether both libraries
        agree on them, and whether decoding them gives the text (with the marker read as a blank)."""
        sizes = pc.binary_length(texts).to_pylist()
        for run in pieces(range(len(texts)), RUN, sizes.__getitem__):
            part = texts.take(pa.array(run)).cast(pa.large_string())
            whole = np.full(len(part), not self.by_chunk)
            odd = (pc.equal(part, ""), pc.starts_with(part, " "), pc.ends_with(part, " "), pc.match_substring(part, "  "), pc.match_substring(part, MARK))
            for found in odd:
                whole |= found.to_numpy(zero_copy_only=False)
            by_chunks = self._assembled(part.filter(pa.array(~whole)))
            alone = self._compared(part.filter(pa.array(whole)).to_pylist())
            out = []
            for is_alone in whole.tolist():
                if is_alone:
                    ids, same, back = next(alone)
                    out.append((np.array(ids, dtype="<u4").tobytes(), same, back))
                else:
                    out.append(next(by_chunks))
            yield out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Per text its ids as little-endian unsigned 32-bit integers, and whether both libraries agree on them."""
        return [(ids, same) for run in self.compared(pa.array(texts, pa.large_string())) for ids, same, _ in run]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.tokenizer.decode_batch([np.frombuffer(i, dtype="<u4").tolist() for i in ids], skip_special_tokens=False)


_codecs: dict[int, Codec] = {}  # one per Python worker and model, so that later tasks find its memory filled


def codec(model: bytes) -> Codec:
    key = zlib.crc32(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _shipped(docs: DataFrame, path: str):
    with open(path, "rb") as f:  # a file of the driver of fixed size, not an input table
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32 (of the ids as little-endian u32), parity, round_trip.

    ``parity``: both libraries give these ids. ``round_trip``: decoding them gives the text again (with the marker
    character read as a blank, as the model cannot tell them apart).
    """
    model = _shipped(docs, model_path or default_model())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for batch in batches:
            at = 0
            for done in own.compared(batch.column(1)):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(done)), pa.array([len(ids) // 4 for ids, *_ in done], pa.int64()),
                    pa.array([zlib.crc32(ids) for ids, *_ in done], pa.int64()), pa.array([same for _, same, _ in done], pa.bool_()),
                    pa.array([back for *_, back in done], pa.bool_()),
                ], ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"])
                at += len(done)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(task, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, parity boolean, round_trip boolean")


def with_ids(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """The rows of ``docs`` with ``token_ids`` (array of int) in place of the text, ``n_tokens``, and ``parity`` and ``round_trip`` as in ``encoded``."""
    model = _shipped(docs, model_path or default_model())
    kept = [f for f in docs.schema.fields if f.name not in ("text", "token_ids", "n_tokens", "parity", "round_trip")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for batch in batches:
            at = 0
            for done in own.compared(batch.column(0)):
                ids = [ids for ids, *_ in done]
                ends = np.cumsum([0, *[len(i) // 4 for i in ids]], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32())
                part = batch.slice(at, len(done))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.ListArray.from_arrays(pa.array(ends), values), pa.array(np.diff(ends).astype(np.int64)),
                     pa.array([same for _, same, _ in done], pa.bool_()), pa.array([back for *_, back in done], pa.bool_())],
                    [f.name for f in kept] + ["token_ids", "n_tokens", "parity", "round_trip"],
                )
                at += len(done)

    rows = docs.select(whole_text().alias("_piece_text"), *[F.col(f"`{f.name}`") for f in kept])
    schema = rows.drop("_piece_text").schema
    return rows.mapInArrow(task, schema.add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType()).add("parity", T.BooleanType()).add("round_trip", T.BooleanType()))
