"""The n-gram join, the spelling variants and the ranked search against plain versions of what they compute."""

import itertools
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from lakewarden.llm import jaccard, ranking, spelling
from lakewarden.llm.common import importable


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def some_docs(spark, rows):
    return importable(spark).createDataFrame(rows, "doc_id long, text string")


# --- 11 n-gram Jaccard join -------------------------------------------------------------------------


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def plain_components(ids, linked):
    least = {i: i for i in ids}
    while True:
        before = dict(least)
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return least


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return words


def texts_of(kind):
    """Families of near copies: with their original, without it, as a chain, and with a passage that many texts share."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    if kind == "original":
        base = words(150)
        out = [base] + [edited(rng, base, rng.randrange(1, 4)) for _ in range(60)]
    elif kind == "no original":
        base = words(120)
        out = [edited(rng, base, 2) for _ in range(50)]
    elif kind == "chain":
        out = [words(100)]
        for _ in range(30):
            out.append(edited(rng, out[-1], 2))
    elif kind == "passage":
        passage = words(60)
        out = [words(n) + passage + words(n) for n in (0, 1, 2, 3, 5, 8, 13, 40) for _ in range(6)]
    else:
        short = ["a b c", "a b c d", "A  b\tc D", "a b c d e", "a", "a", "", "  ", "x y z", "d c b a"]
        out = [s.split(" ") for s in short] + [words(n) for n in range(3, 12) for _ in range(3)]
    rng.shuffle(out)
    return [" ".join(w) for w in out] + [None, out[0] and " ".join(out[0]).upper()]


@pytest.mark.parametrize("kind", ["original", "no original", "chain", "passage", "short"])
def test_jaccard_components_equal_all_pairs(spark, kind):
    texts = dict(enumerate(texts_of(kind)))
    sets = {i: plain_set(t) for i, t in texts.items()}
    linked = [(a, b) for a, b in itertools.combinations(texts, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = plain_components(texts, linked)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(some_docs(spark, list(texts.items()))).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in texts}
    assert linked


def test_jaccard_family_is_not_compared_pairwise(spark, monkeypatch):
    """A family of 300 copies with one word changed in each has 45,000 pairs; few more than 300 are counted."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    docs = some_docs(spark, [(0, " ".join(base))] + [(i, " ".join(edited(rng, base, 1))) for i in range(1, 301)])
    counted, plain = [], jaccard._counted
    monkeypatch.setattr(jaccard, "_counted", lambda pairs, segments: counted.append(pairs.count()) or plain(pairs, segments))
    assert {r.component_id for r in jaccard.near_duplicates(docs).collect()} == {0}
    assert sum(counted) < 3000


def test_jaccard_fragments_cut_the_order_evenly():
    assert jaccard._cuts({}) == []
    cuts = jaccard._cuts({4: 800})
    assert len(cuts) == jaccard.FRAGMENTS - 1 and all(b == 4 for b, _ in cuts) and cuts == sorted(cuts)
    assert jaccard._cuts({4: 1, 8: 1})[-1][0] == 8


def test_jaccard_ids_that_are_null_or_repeat(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (None, "other words stand in this text"), (4, text), (4, "a b c d e"), (3, "A B C D E"), (9, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.near_duplicates(some_docs(spark, rows)).collect())
    assert got == [(0, 3, 0), (0, 4, 4), (3, 2, 3), (4, 2, 3), (4, 4, 4), (9, 0, 9)]


# --- 12 spelling variants ---------------------------------------------------------------------------


def plain_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    out = {}
    for w, n in words.items():
        near = sorted((v for v in words if one_edit(w, v)), key=lambda v: (-words[v], v))
        form = near[0] if near and words[near[0]] >= 2 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return {w: (f, root(w), n, near, fn) for w, (f, n, near, fn) in out.items()}


def variants(spark, rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(some_docs(spark, rows)).collect()}


def spelled(rng, n):
    letters = "abcdeABéÿ×"
    return " ".join("".join(rng.choice(letters) for _ in range(rng.choice((4, 5, 5, 6, 7)))) for _ in range(n))


def test_spelling_equals_all_pairs(spark):
    rng = random.Random(5)
    some = [spelled(rng, 1) for _ in range(30)]
    some += ["".join(w[:i]) + rng.choice("abcé") + w[i + rng.randrange(2) :] for w in some for i in rng.sample(range(4), 3)] * 3
    rows = [(i, " ".join(some[min(int(rng.expovariate(0.02)), len(some) - 1)] for _ in range(120)) + rng.choice((".", "İ", " İx", ""))) for i in range(60)]
    rows += [(100 + i, "chainbb chainbb chainab" + " chainaa" * (i < 4)) for i in range(20)]
    rows += [(None, rows[0][1]), (7, None), (8, ""), (9, rows[1][1]), (9, rows[1][1])]
    want = plain_variants(rows)
    assert variants(spark, rows) == want
    assert any(v[0] and v[1] != v[0] for v in want.values()) and max(v[3] for v in want.values()) > 3


def test_spelling_of_small_tiles_equals_one_tile(spark, monkeypatch):
    """Blocks that are dealt to many tiles give the same."""
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("ab") for _ in range(rng.choice((6, 7, 8)))) for _ in range(200))) for i in range(12)]
    want = plain_variants(rows)
    monkeypatch.setattr(spelling, "TILE", 8)
    assert variants(spark, rows) == want and len(want) > 100


def test_spelling_of_very_long_words(spark):
    word = "".join(random.Random(1).choice(string.ascii_lowercase) for _ in range(60_000))
    rows = [(i, f"{word} {word[:30_000]}X{word[30_000:]} {word[:100]}z{word[101:]}") for i in range(1, 9)]
    rows += [(i, word) for i in range(10, 40)]
    assert variants(spark, rows) == plain_variants(rows)


def test_spelling_ties_take_the_first_word(spark):
    rows = [(i, "abcde abcdf abcdf abcdf abcdg abcdg abcdg") for i in range(3)]
    assert variants(spark, rows)["abcde"] == plain_variants(rows)["abcde"]


# --- 13 ranked search -------------------------------------------------------------------------------


def plain_search(docs, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t))
    texts = [(i, split(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, w in texts if w), sum(len(w) for _, w in texts)
    df = Counter(t for _, w in texts for t in set(w))
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, w in texts:
            tf, m = Counter(w), 100 - 25 + (25 * len(w) * n_docs) // max(n_terms, 1)
            weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in split(text) if t in tf}
            score = sum(weight[t] * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in split(text) if t in tf)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(scored)[:20], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items):
    found = ranking.search(some_docs(spark, docs), importable(spark).createDataFrame(items, "item_id long, text string"))
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def search_case(rng, n, width):
    words = [f"t{i}" for i in range(300)] + ["Straße", "ÉTÉ", "9", "x·y"]
    text = lambda k: " ".join(words[min(int(rng.expovariate(0.02)), len(words) - 1)] + rng.choice(("", ",", "!")) for _ in range(k))
    docs = [(i, text(rng.choice((0, 3, 30, 200)))) for i in range(n)]
    return docs + [(None, text(30)), (3, None), (5, docs[7][1]), (6, docs[7][1]), (6, docs[7][1])], [(i, text(width)) for i in range(12)] + [(1, "t1 T1 t1"), (90, None), (91, "absent words"), (92, "straße ÉTÉ")]


@pytest.mark.parametrize("width", [3, 20, 150])
def test_search_equals_plain_ranking(spark, width):
    docs, items = search_case(random.Random(width), 150, width)
    assert searched(spark, docs, items) == plain_search(docs, items)


def test_search_in_many_blocks_and_turns(spark, monkeypatch):
    docs, items = search_case(random.Random(1), 200, 15)
    want = plain_search(docs, items)
    monkeypatch.setattr(ranking, "TERMS", 40)
    monkeypatch.setattr(ranking, "BITS", 200)
    assert searched(spark, docs, items) == want


def test_search_skips_masks_that_cannot_win(monkeypatch):
    """Of 5,000 documents with common terms and 30 with the rare one, only the 30 and few others are scored."""
    ids, n = np.arange(5030), np.full(5030, 50)
    which = np.concatenate([np.zeros(5030), np.ones(30)]).astype(np.int32)
    of = np.concatenate([np.arange(5030), np.arange(30)])
    weights = np.array([10, 5000])
    scored, plain = [], ranking._Best.add
    monkeypatch.setattr(ranking._Best, "add", lambda self, scores, found: scored.append(len(scores)) or plain(self, scores, found))
    import pyarrow as pa

    lists = [pa.array([[w for w, o in zip(which.tolist(), of.tolist()) if o == i] for i in range(5030)], pa.list_(pa.int32()))]
    lists.append(pa.array([[2] * len(x) for x in lists[0].to_pylist()], pa.list_(pa.int64())))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
    out = list(ranking._searched([(0, [(0, 1), (1, 1)])], weights, 5030, 5030 * 50)([batch]))
    assert out[0].column(1).to_pylist() == list(range(20)) and sum(scored) == 30


def test_norms_of_very_long_texts_do_not_overflow():
    assert ranking._norms(np.array([10**9, 3]), 10**11, 10**14).tolist() == [75 + 25 * 10**9 // 1000, 75]
