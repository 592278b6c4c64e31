"""The operators against plain versions of what they compute, on small tables."""

import gzip
import hashlib
import itertools
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SF_DIR
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare, connect
from lakewarden.llm import components, exact_dedup, files, fixity, licenses, pii, quality, queries, sentencepieces, simhash, templates, token_files, toxicity
from lakewarden.llm.common import importable, lower_ascii, shared_folder


@pytest.fixture(scope="module")
def docs(spark):
    return importable(spark).read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def some_docs(spark, rows):
    return importable(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def as_docs(spark, texts):
    return some_docs(spark, [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)])


# --- queries with SQL -------------------------------------------------------------------------------


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_equals_sql(spark, name):
    problems, rows = compare(spark, connect(SF_DIR), SF_DIR, name, queries.QUERIES[name], queries.ORACLES[name])
    assert not problems and rows > 0


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


# --- 1 token files ----------------------------------------------------------------------------------


def plain_ids(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_files.default_vocabulary())
    return [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


ODD = [
    "", " \t\n", "It's THE don't İstanbul ΣΑΣ naïve été a b c x\x1cy\x1c z \x85q", "<|startoftext|> hi <|endoftext|>", "a'sb 'S 12.5% a_b ²½ x²y.. 中文字 😀!!",
    "A" * 5000, "J̌ ǰ J̌", "word... The.,!|x", "é." * 50,
]


def test_token_files_round_trip(spark, docs, texts):
    got = {r.doc_id: r for r in token_files.round_trip(docs, token_files.default_vocabulary()).collect()}
    start = 0
    for doc_id, ids in zip(sorted(texts), plain_ids([texts[d] for d in sorted(texts)])):
        ids += (1).to_bytes(4, "little")
        row = got[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert len(got) == len(texts)


def test_encoder_by_chunks_equals_whole_texts():
    with open(token_files.default_vocabulary(), encoding="utf-8") as f:
        coder = token_files.Encoder(f.read())
    assert coder.by_chunk and coder.encode(ODD) == plain_ids(ODD)


def test_encoder_keeps_signs_after_letters_that_normalise_to_more():
    odd = ["İ. x", "a İ! i̇.", "क़. क़,", "שּׁ. x", "<|STARTOFTEXT|> hi", "a <|EndOfText|>"]
    with open(token_files.default_vocabulary(), encoding="utf-8") as f:
        coder = token_files.Encoder(f.read())
    assert coder.encode(odd) == plain_ids(odd)
    column = pa.array(["skipped", *ODD, *odd]).slice(1)
    assert list(coder.encode_column(column)) == plain_ids(ODD + odd)


def test_encoder_encodes_words_that_come_again_only_once(monkeypatch):
    monkeypatch.setattr(token_files, "RUN", 2000)
    monkeypatch.setattr(token_files, "KNOWN", 150)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "q" + letters[i // 676 % 26] + letters[i // 26 % 26] + letters[i % 26]
    often = [word(i) for i in range(100)]
    texts = [" ".join([w + sign for w in often] + [word(i) for i in range(1000 + 100 * k, 1100 + 100 * k)]) for k, sign in enumerate(".,!#$%&*|")]

    with open(token_files.default_vocabulary(), encoding="utf-8") as f:
        coder = token_files.Encoder(f.read())
    asked, library = [], coder.tokenizer

    class Listening:
        def encode_batch_fast(self, texts, **settings):
            asked.append([w for t in texts for w in t.split() if w.isalpha()])
            return library.encode_batch_fast(texts, **settings)

        def __getattr__(self, name):
            return getattr(library, name)

    coder.tokenizer = Listening()
    assert coder.encode(texts) == plain_ids(texts)
    words = [w for call in asked for w in call]
    assert len(words) == len(set(words)) == 100 + 9 * 100
    assert sum(map(bool, asked)) == 9  # one call for all new words of a run


def test_encoder_with_other_vocabulary_encodes_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        coder = token_files.Encoder(f.read())
    assert not coder.by_chunk
    plain = Tokenizer.from_file(path)
    assert coder.encode(ODD) == [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in ODD]


class Counting:
    """A source that knows how many bytes were read from it."""

    def __init__(self, data):
        self.data, self.at, self.taken = data, 0, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.taken += n
        return self.data[self.at : self.at + n]


def test_reader_fetches_only_the_frames_it_needs(tmp_path, monkeypatch):
    import io

    import zstandard

    monkeypatch.setattr(token_files, "FRAME_IDS", 1000)
    rng = np.random.default_rng(1)
    documents = [(i if i % 7 else None, rng.integers(0, 50_000, n, dtype="<u4").tobytes()) for i, n in enumerate([3, 0, 5000, 1, 2500, 700])]
    sink = io.BytesIO()
    assert token_files.write_file(sink, documents) == (6, sum(len(d) for _, d in documents) // 4)
    source = Counting(sink.getvalue())
    reader = token_files.TokenFile(source)
    assert reader.ids == [d for d, _ in documents] and [reader.document(i) for i in range(6)] == [d for _, d in documents]
    source.taken = 0
    reader.document(3)
    assert source.taken == reader.seek[reader.first[3], 0]
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(d for _, d in documents)
    hurt = bytearray(sink.getvalue())
    hurt[int(reader.starts[reader.first[2]]) + 20] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.TokenFile(Counting(bytes(hurt))).document(2)


# --- 2 fixity ---------------------------------------------------------------------------------------


def test_archives_are_warc_and_audits_find_short_and_missing_files(spark):
    pages = importable(spark).createDataFrame([(i, f"http://x/{i}", "é" * i) for i in range(60)], "page_id long, url string, html string")
    folder, copy = shared_folder(spark, "warc"), shared_folder(spark, "replica")
    manifest = fixity.write_archive(pages, folder)
    fixity.replicate(manifest, copy)
    assert {r.status for r in fixity.audit(manifest, copy).collect()} == {"intact"}
    paths = [r.path for r in manifest.orderBy("shard").collect()]
    entries = {r.key: r for r in fixity.records(manifest).collect()}
    with open(paths[0].removeprefix("file://"), "rb") as f:
        raw = f.read()
    first = entries[0]
    member = gzip.decompress(raw[first.offset : first.offset + first.length])
    assert member.startswith(b"WARC/1.1\r\n") and b"Content-Length: 0\r\n" in member and first.body_sha256 == hashlib.sha256(b"").hexdigest()
    lost = paths[-1].rsplit("/", 1)[1]
    short = paths[0].rsplit("/", 1)[1]
    partial = shared_folder(spark, "replica")
    system, at = files.located(partial)
    system.create_dir(at, recursive=True)
    for p in paths:
        name = p.rsplit("/", 1)[1]
        if name != lost or len(paths) == 1:
            with open(p.removeprefix("file://"), "rb") as f:
                body = f.read()
            with open(f"{at}/{name}", "wb") as f:
                f.write(body[: first.offset + first.length + 5] if name == short else body)
    state = {r.key: r.status for r in fixity.audit(manifest, partial).collect()}
    whole = {k for k, r in entries.items() if r.shard == entries[0].shard and r.seq > 0} | {k for k, r in entries.items() if paths[-1] != paths[0] and r.shard == max(x.shard for x in entries.values())}
    assert {k for k, s in state.items() if s == "damaged"} == whole


def test_audits_find_tails_and_files_that_only_the_replica_has(spark):
    pages = importable(spark).createDataFrame([(i, f"http://x/{i}", "é" * i) for i in range(60)], "page_id long, url string, html string")
    folder, copy = shared_folder(spark, "warc"), shared_folder(spark, "replica")
    manifest = fixity.write_archive(pages, folder)
    fixity.replicate(manifest, copy)
    assert {r.status for r in fixity.file_audit(manifest, copy).collect()} == {"intact"}
    path = files.located(manifest.orderBy("shard").first().path)[1]
    name = path.rsplit("/", 1)[1]
    with open(path, "rb") as f:
        raw = f.read()
    flipped = bytearray(raw)
    flipped[-20] ^= 0xFF
    at = files.located(copy)[1]
    for changed in (raw[:-5], bytes(flipped), raw + b"more"):
        with open(f"{at}/{name}", "wb") as f:
            f.write(changed)
        got = {r.file: (r.status, r.n_damaged, r.tail_differs) for r in fixity.file_audit(manifest, copy).collect()}
        assert got.pop(name) == ("tail", 0, True) and set(got.values()) <= {("intact", 0, False)}
        assert {r.status for r in fixity.audit(manifest, copy).collect()} == {"intact"}
    with open(f"{at}/stray.warc.gz", "wb") as f:
        f.write(raw)
    assert {r.file for r in fixity.file_audit(manifest, copy).collect() if r.status == "extra"} == {"stray.warc.gz"}


def test_audit_reads_only_branches_that_differ(spark):
    leaf = importable(spark).range(1000).select(F.lit(0).alias("shard"), F.col("id").alias("pos"), F.col("id").alias("start"), (F.col("id") + 1).alias("stop"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    ours, top = fixity.tree(leaf)
    theirs, _ = fixity.tree(leaf.withColumn("hash", F.when(F.col("pos").isin(5, 999), "x").otherwise(F.col("hash"))))
    assert top == 3
    assert sorted(r.pos for r in fixity.damaged(ours, theirs, top).collect()) == [5, 999]


# --- 3 templates ------------------------------------------------------------------------------------


def test_leaks_equal_shared_runs_of_words(spark, docs, texts):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    grams = lambda t: {w[i : i + 10] for w in [tuple(lower(t).split())] for i in range(len(w) - 9)}
    bench = {r.item_id: grams(r.text) for r in items.collect()}
    want = {(d, i) for d, t in texts.items() for own in [grams(t)] for i, b in bench.items() if own & b}
    assert {(r.doc_id, r.item_id) for r in templates.leaks(docs, items).collect()} == want and want


def test_reparameterised_questions_are_found_and_inconsistent_ones_are_not(spark):
    item = "The farmer told that Alice Miller has 12 apples and gives 5 kg of them to Bob while Alice Miller keeps 12 apples for the winter market"
    changed = item.replace("Alice Miller", "Carla Jones").replace("12", "40").replace("5 kg", "9 lbs").replace("Bob", "Dan")
    mixed = "The farmer told that Carla Jones has 40 apples and gives 9 lbs of them to Dan while Erwin Stone keeps 77 apples for the winter market"
    clean = "A quite different text about the winter market where nobody of 12 people keeps any apples at all, be it in June or in May of 1999."
    got = templates.leaks(as_docs(spark, [f"Some words. {changed}. More words.", mixed, clean, item]), spark.createDataFrame([(7, item)], "item_id long, text string"))
    rows = {r.doc_id: r for r in got.collect()}
    assert set(rows) == {0, 3} and rows[0].changed_slots > 0 and rows[3].changed_slots == 0


def test_short_items_are_compared_word_by_word(spark):
    bench = importable(spark).createDataFrame([(1, "Quantum flux!"), (2, None), (3, "")], "item_id long, text string")
    got = templates.leaks(as_docs(spark, ["about quantum flux here", "flux quantum", None, ""]), bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(0, 1)]


def test_questions_dense_in_slots_and_items_in_other_case_are_found(spark):
    dense = "If Sam buys 12 kg for $30 and 8 kg for $20, how much is 1 kg?"
    other = "If Tom buys 15 kg for $45 and 9 kg for $27, how much is 1 kg?"
    odd = "If Tom buys 15 kg for $45 and 15 lb for $45, how much is 15 oz?"
    named = "Where does Alice Miller keep the red book she bought in Paris with Bob Stone last year"
    tail = "They sold boxes of apples at 5 kg 3 lb 7 oz"
    rows = [other, odd, named.lower(), named.upper(), "Now they sold boxes of apples at 6 kg 4 lb 8 oz Bob said.", "1 2 3 4 5 6 7 8 9 10 11 12 of the in and so"]
    bench = importable(spark).createDataFrame([(1, dense), (2, named), (3, tail), (4, "50 61 72 83 94 15 26 37 48 59 of the in " + "which nothing else is said here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.covered for r in templates.leaks(as_docs(spark, rows), bench).collect()}
    assert got == {(0, 1): 17, (2, 2): 17, (3, 2): 17, (4, 3): 12}


# --- 4 and 8 classifiers ----------------------------------------------------------------------------


def test_folding():
    assert toxicity.fold("An IDI0T, а mоrоn and tr@sh in 1999!").split() == ["an", "idiot", "a", "moron", "and", "trash", "in"]


def test_matches_equal_a_search_word_by_word():
    model = toxicity.Model({" trash ": 3.0, " idio": 2.0, " idiot ": 5.0})
    matcher = toxicity.Matcher(model)
    text = "The idiot put idiotic trash in the trash can. Trashy"
    assert sorted(matcher.hits(toxicity.fold(text)).values()) == [2.0, 3.0, 5.0]  # the second trash is part of a trash can


def test_toxicity_and_quality_on_held_out_rows(spark):
    rng, words = np.random.default_rng(2), [a + b for a in ("ba", "ke", "lo", "mu", "ni", "pa") for b in ("ra", "se", "ti", "vo", "wu")]
    some = lambda: " ".join(rng.choice(words, 12))
    rows = [(i, f"{some()} {'stupid' if i % 3 == 0 else 'fine'} {some()} {i}" + ("!!%%" * 20 if i % 4 == 0 else "")) for i in range(400)]
    docs = as_docs(spark, [t for _, t in rows])
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    for operator, right in ((toxicity.scores, lambda i: int(i % 3 == 0)), (quality.scores, lambda i: int(i % 4 != 0))):
        got = operator(docs, labels).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got) and len(got) == 400
        held = [r for r in got if r.held_out]
        assert sum(r.predicted == right(r.doc_id) for r in held) >= 0.95 * len(held) > 50
    kept = {r.doc_id for r in toxicity.accepted(docs, labels).collect()}
    assert kept == {r.doc_id for r in toxicity.scores(docs, labels).collect() if not r.predicted}


def test_network_slices_and_gradient():
    rng = np.random.default_rng(0)
    net = quality.train(["ab " * 300, "!! " * 300], [1.0, 0.0])
    raw = rng.integers(0, 256, quality.SLICE * 2 + 777, dtype=np.uint8)
    best = quality.steps(net, raw)
    resp = quality.responses(net, raw)
    assert np.array_equal(best, np.stack([resp[i : i + quality.STEP].max(0) for i in range(0, len(resp), quality.STEP)]))
    text, y, eps = "some text, " * 90, 1.0, 1e-4
    net = quality.Network(net.tables.astype(np.float64), net.bias + 0.5, net.unit)
    _, bias, _ = quality._gradient(net, quality.as_bytes(text), y)
    loss = lambda n: -np.log(quality.score(n, text))
    for k in range(quality.FILTERS):
        up, down = net.bias.copy(), net.bias.copy()
        up[k], down[k] = up[k] + eps, down[k] - eps
        slope = (loss(quality.Network(net.tables, up, net.unit)) - loss(quality.Network(net.tables, down, net.unit))) / (2 * eps)
        assert abs(slope - bias[k]) < 1e-4


# --- 5 personal data --------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda ds: sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(ds))) % 10 == 0
    tests = (
        ("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", CARD, lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", PHONE, lambda s: 9 <= len(digits(s)) <= 15),
    )
    return [(kind, m.start(), m.end()) for kind, pattern, ok in tests for m in pattern.finditer(text) if ok(m[0])]


def test_base_spans_equal_plain_regular_expressions(spark, texts):
    import random

    rng = random.Random(3)
    odd = ["", None, "a@b.c%d@e.f x@@y.z a.b@c", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1111 1--4111111111111111",
           " +49 (30) 1234-5678. (784) 555-9263", "😀é bob@x.org 😀 10.0.0.1", "1 " * 3000, "a.b@" + "c." * 4000 + "d", "9" * 5000, "+" + "1 " * 20000]
    odd += ["".join(rng.choice("0123456789 -.+()@ab%é") for _ in range(rng.randrange(5, 80))) for _ in range(1500)]
    rows = [*texts.values(), *odd]
    got = {r.doc_id: r for r in pii.find(as_docs(spark, rows)).collect()}
    for i, text in enumerate(rows):
        want = base_spans(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == kind for k, _, _ in want) for kind in pii.KINDS]
        assert set(filter(None, listed.split(","))) <= set(got[i].spans.split(","))


def test_trees_add_other_spellings(spark):
    phones = ["+1 ({a}) 555-{b}", "+1 {a} 555 {b}", "+1{a}555{b}", "+44 20.{a}.{b}1"]
    other = ["token x{a}{b}{a}{b}z", "number {a}{b}{a}{b}{a}", "release 10.{a}.{b}.7.8", "host 10.0.{i}.7 or 999.{a}.1.{i}", "3.{i}"]
    one = lambda p, i: p.format(a=200 + i, b=1000 + i, i=i % 200)
    rows = [f"please call {one(phones[i % 4], i)} today, order {i} of {one(other[i % 5], i)} or mail bob{i}@mail.example.com" for i in range(300)]
    rows += [f"the phone (3{i:02d}) 555-{2000 + i} is new" for i in range(20)]
    got = {r.doc_id: r for r in pii.find(as_docs(spark, rows)).collect()}
    assert sum(got[i].spans.startswith("phone:") for i in range(300, 320)) >= 18
    assert all(got[i].n_phone == 0 for i in range(300, 320)) and sum(got[i].n_added for i in range(300)) == 0


def test_trees_learn_from_every_candidate(spark, monkeypatch):
    """21,000 addresses and 1,000 dotted numbers: more than a fixed number of rows would hold; equal ones are one row with a weight."""
    rows = [" ".join(["mail bob@mail.example.com now"] * 70 + [f"or 3.{i % 5}"] * (4 if i < 250 else 0)) for i in range(300)]
    fitted, plain = [], pii.GBTClassifier.fit
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, df: fitted.append((self.getOrDefault("weightCol"), df)) or plain(self, df))
    found = pii.candidates(as_docs(spark, rows))
    assert pii.fit(found) is not None
    counted = pii._counted(found)
    assert {(r.kind, r.label): r.n for r in counted.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()} == {(0, 1): 21_000, (1, 0): 1000}
    [(weight, df)] = fitted
    assert df.agg(F.sum(weight)).first()[0] == counted.filter("fold = 0").agg(F.sum("n")).first()[0] > 10_000 and df.count() < 50


# --- 6 pieces ---------------------------------------------------------------------------------------


def test_pieces_equal_sentencepiece(spark, docs, texts):
    from sentencepiece import SentencePieceProcessor

    plain = SentencePieceProcessor(model_file=sentencepieces.default_model())
    odd = ["", " ", " a", "a ", "a  b", "\n\n a\tb", "▁▁a▁ b", "<s> </s> <unk> <0x0A>", "中文字😀 é", "x\0y", "a" * 3000, "İ ﬁ ½", None]
    rows = [*texts.values(), *odd]
    for r in sentencepieces.encoded(as_docs(spark, rows)).collect():
        ids = plain.encode(rows[r.doc_id] or "")
        assert r.parity and r.round_trip and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    for r in sentencepieces.with_ids(docs).collect():
        assert r.token_ids == plain.encode(texts[r.doc_id]) and r.n_tokens == len(r.token_ids)


def test_rows_with_ids_carry_parity_and_round_trip(spark):
    rows = as_docs(spark, ["Some plain words", "a" + " " * 64 + "b", None])
    want = {(r.doc_id, r.n_tokens, r.parity, r.round_trip) for r in sentencepieces.encoded(rows).collect()}
    assert {(r.doc_id, r.n_tokens, r.parity, r.round_trip) for r in sentencepieces.with_ids(rows).collect()} == want and len(want) == 3


def test_unigram_models_are_rebuilt():
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    rows = [("<unk>", 0, 2), ("▁", -3, 1), ("a", -2, 1), ("b", -2.5, 1), ("ab", -2.2, 1), ("▁a", -2.1, 1), ("▁ab", -5, 1)] + [(f"<0x{i:02X}>", 0, 6) for i in range(256)]
    for piece, score, kind in rows:
        spec.pieces.add(piece=piece, score=score, type=kind)
    spec.trainer_spec.model_type, spec.trainer_spec.byte_fallback = 1, True
    spec.normalizer_spec.name, spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    codec = sentencepieces.Codec(spec.SerializeToString())
    got = codec.encode(["ab abba b", "", "é ab", "a  b"])
    assert all(same for _, same in got)
    assert codec.decode([ids for ids, _ in got]) == ["ab abba b", "", "é ab", "a  b"]


def test_chunks_that_come_again_are_encoded_and_decoded_only_once(monkeypatch):
    monkeypatch.setattr(sentencepieces, "KNOWN", 150)
    with open(sentencepieces.default_model(), "rb") as f:
        codec = sentencepieces.Codec(f.read())
    often = [f"q{i}" for i in range(100)]
    texts = [" ".join([*often, *(f"z{k}x{i}" for i in range(100))]) for k in range(9)]
    encoded, decoded = [], []

    class Listening:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **settings):
            encoded.extend(c for t in texts for c in t.split(" "))
            return self.library.encode_batch_fast(texts, **settings)

        def decode_batch(self, ids, **settings):
            texts = self.library.decode_batch(ids, **settings)
            decoded.extend(c for t in texts for c in t.split(" "))
            return texts

    plain, codec.tokenizer = codec.tokenizer, Listening(codec.tokenizer)
    for text in texts:
        ids = np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert codec.encode([text]) == [(ids, True)]
    assert sorted(encoded) == sorted(decoded) == sorted({c for t in texts for c in t.split(" ")})


def test_flags_by_chunks_equal_those_of_whole_texts(monkeypatch):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    monkeypatch.setattr(sentencepieces, "KNOWN", 3)
    spec = sentencepiece_model_pb2.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("▁", -3, 1), ("a", -2, 1), ("b", -2.5, 1), ("ab", -2.2, 1), ("▁a", -2.1, 1)]:
        spec.pieces.add(piece=piece, score=score, type=kind)
    spec.trainer_spec.model_type = sentencepieces.BPE
    spec.normalizer_spec.name, spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    codec, plain = sentencepieces.Codec(spec.SerializeToString()), SentencePieceProcessor(model_proto=spec.SerializeToString())
    assert codec.by_chunk
    texts = ["a ab", "a é", "é é", "", "ab  é", "ab <unk>", " a", "b▁a", "ba ab aab", "é", "a b bb bbb abab é", "a ab", "ab éé b"]
    want = []
    for t in texts:
        ids = plain.encode(t)
        back = codec.tokenizer.decode(ids, skip_special_tokens=False)
        want.append((np.array(ids, dtype="<u4").tobytes(), codec.tokenizer.encode(t, add_special_tokens=False).ids == ids, back == t.replace("▁", " ")))
    assert {back for *_, back in want} == {True, False}
    assert [r for run in codec.compared(pa.array(["skipped", *texts]).slice(1)) for r in run] == want
    assert [r for t in texts for run in codec.compared(pa.array([t])) for r in run] == want


# --- 7 licenses -------------------------------------------------------------------------------------


def test_licenses(spark, docs, texts):
    lines = {t: name for name, ts in licenses.TEMPLATES.items() for t in ts}
    want = {(d, m.start(), name) for d, t in texts.items() for line, name in lines.items() for m in re.finditer(rf"(?m)^{re.escape(line)}$", t)}
    got = {(r.doc_id, r.start, r.license) for r in licenses.scan(docs).collect()}
    assert got == want and want
    odd = ["This Work is licensed under the GNU General Public Licence, version 2.", "Licensed under the Apache License, Version 3.0.", "Our licensing department is closed.", None, ""]
    rows = licenses.scan(as_docs(spark, odd)).collect()
    assert [(r.doc_id, r.license, r.exact) for r in rows] == [(0, "GPL-2.0", False)]
    assert rows[0].lacking == ["license"] and rows[0].added == ["licence"]


def test_every_notice_of_a_text_is_found(spark):
    prose = "and the long report goes on about many other matters of the valley " * 8
    texts = [
        "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", "Released under the MIT License. All rights reserved.",
        "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0.",
        f"{prose}released under the MIT License {prose}", "Copyright 2020 A. Person\nReleased under the MIT License.\nCopyright 2021 B. Person",
        "It is licensed under the License, and distributed under the Foo License.", "Licensed under CC BY-NC-ND 4.0.",
    ]
    got = [(r.doc_id, r.license) for r in licenses.scan(as_docs(spark, texts)).orderBy("doc_id", "start").collect()]
    assert got == [(0, "Apache-2.0"), (0, "CC-BY-NC-4.0"), (1, "MIT"), (1, "LicenseRef-all-rights-reserved"), (2, "GPL-3.0"), (2, "Apache-2.0"), (3, "MIT"), (4, "MIT")]


def test_every_template_is_found_wrapped_and_behind_comment_marks(spark):
    each = [(name, t) for name, ts in licenses.TEMPLATES.items() for t in ts]
    wrapped = lambda t, mark: "int a;\n" + "\n".join(mark + line for part in t.split("\n") for line in textwrap.wrap(part, 40, break_on_hyphens=False, break_long_words=False)) + "\nint b;"
    rows = licenses.scan(as_docs(spark, [wrapped(t, mark) for _, t in each for mark in ("", "// ", " * ")])).collect()
    assert sorted((r.doc_id, r.license, r.exact) for r in rows) == [(i, each[i // 3][0], True) for i in range(3 * len(each))]
    assert {"MPL-2.0", "MIT", "BSD-3-Clause", "BSD-2-Clause"} <= {name for name, t in each if len(t) > 150}


# --- 9, 10 dedup ------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def reachable(n, linked):
    root = list(range(n))
    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash_equals_all_pairs(spark, docs, texts):
    ids = sorted(texts)
    marks = [plain_fingerprint(texts[d]) for d in ids]
    root = reachable(len(ids), lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{m:016x}", ids[r]) for d, m, r in zip(ids, marks, root)}


def test_links_equal_all_pairs_at_every_distance(spark):
    rng = np.random.default_rng(5)
    marks = {int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)} | {0, 2**64 - 1}
    for mark in list(marks):
        for flips in (1, 2, 3, 4):
            marks.add(mark ^ sum(1 << int(b) for b in rng.choice(64, flips, replace=False)))
    signed = [m - 2**64 if m >= 2**63 else m for m in marks]
    got = {frozenset((r.a, r.b)) for r in simhash.links(importable(spark).createDataFrame([(m,) for m in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and want


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)] + [(5, 5), (160, 100)]
    got = {r.node: r.root for r in components.components(importable(spark).createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(101, 161)} | {i: 7 for i in range(200, 260)} | {i: 300 for i in range(301, 309)}
    assert got == want


def test_lower_ascii(spark):
    got = importable(spark).createDataFrame([("ÀBCé Z",), ("ABC z",)], "t string").select(lower_ascii(F.col("t"))).collect()
    assert [r[0] for r in got] == ["Àbcé z", "abc z"]


def test_survivors_with_a_digest_that_two_texts_share(spark, monkeypatch):
    """If digests collide, texts decide."""
    keyed = exact_dedup._keyed
    monkeypatch.setattr(exact_dedup, "_keyed", lambda d, t, *c: keyed(d, True, *c).withColumn("_dedup_sha", F.lit(b"x")).drop(*[] if t else ["_dedup_text"]))
    got = exact_dedup.groups(as_docs(spark, ["a", "b", "A"])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(0, 2, 2), (1, 1, 1), (2, 2, 2)]


# --- pipeline ---------------------------------------------------------------------------------------


def test_pipeline_stages_and_result(spark, docs, texts):
    assert len(corpus_pipeline.STAGES) == 5
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.scores(docs, labels).collect() if r.predicted}
    left = {d: t for d, t in texts.items() if d not in toxic}
    last = {}
    for d in sorted(left):
        last[lower(left[d])] = d
    left = {d: left[d] for d in sorted(last.values())}
    ids, marks = list(left), [plain_fingerprint(t) for t in left.values()]
    root = reachable(len(ids), lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 3)
    left = {d: left[d] for i, d in enumerate(ids) if root[i] == i}
    leaked = {r.doc_id for r in templates.leaks(docs, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).collect()}
    want = {d for d in left if d not in leaked}
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == want and len(rows) == len(want)
    assert set(corpus_pipeline.drop_copies(spark, docs, SF_DIR).columns) == set(docs.columns)
