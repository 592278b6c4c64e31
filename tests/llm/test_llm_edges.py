"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns have defined results."""

import pytest
from pyspark.sql import functions as F

from lakewarden.llm import exact_dedup, fixity, jaccard, licenses, pii, quality, ranking, sentencepieces, simhash, spelling, templates, token_files, toxicity
from lakewarden.llm.common import importable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, fp long, _dedup_sha string, score double, component_id long"
LONG = "Some words of a very long text, mail bob@x.org or +1 (212) 555-1000. " * 4000
ROWS = [
    (1, "The idiot text", None, "s", 3), (1, "The idiot text", None, "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "the idiot text", "en", "s", 1),
    (None, None, None, None, None), (4, LONG, "en", "s", len(LONG)), (5, LONG.upper(), "en", "s", 0), (5, "Another text with the id five", "en", None, 0), (6, " \n\t ", "en", "s", 0),
]


def table(spark, rows):
    return importable(spark).createDataFrame([(*r, 7, 8, "x", 0.5, 9) for r in rows], SCHEMA)


def labels(spark, rows=((1, 1, 1), (4, 1, 0), (2, None, None), (None, 1, 1), (5, 0, 0), (5, 1, 1))):
    return importable(spark).createDataFrame(list(rows), "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def bench(spark, rows=((1, "some words of a very long text mail"), (2, None), (None, ""))):
    return importable(spark).createDataFrame(list(rows), "item_id long, text string").withColumn("doc_id", F.lit(5))


ALL = {
    "tokens": (lambda s, d: token_files.round_trip(d, token_files.default_vocabulary()), len(ROWS)),
    "leaks": (lambda s, d: templates.leaks(d, bench(s)), 2),
    "no leaks": (lambda s, d: templates.clean(d, bench(s)), len(ROWS) - 2),
    "no benchmark": (lambda s, d: templates.clean(d, bench(s, ())), len(ROWS)),
    "toxicity": (lambda s, d: toxicity.scores(d, labels(s)), len(ROWS)),
    "toxicity without labels": (lambda s, d: toxicity.accepted(d, labels(s, ())), len(ROWS)),
    "personal data": (lambda s, d: pii.find(d), len(ROWS)),
    "pieces": (lambda s, d: sentencepieces.encoded(d), len(ROWS)),
    "ids": (lambda s, d: sentencepieces.with_ids(d.withColumn("token_ids", F.lit(1))), len(ROWS)),
    "licenses": (lambda s, d: licenses.scan(d), 0),
    "quality": (lambda s, d: quality.scores(d, labels(s)), len(ROWS)),
    "quality without labels": (lambda s, d: quality.scores(d, labels(s, ())), len(ROWS)),
    "copies": (lambda s, d: exact_dedup.groups(d), len(ROWS)),
    "survivors": (lambda s, d: exact_dedup.survivors(d), 5),
    "near copies": (lambda s, d: simhash.near_duplicates(d), len(ROWS)),
    "representatives": (lambda s, d: simhash.representatives(d), 4),
    "shingle sets": (lambda s, d: jaccard.near_duplicates(d), len(ROWS)),
    "spelling": (lambda s, d: spelling.variants(d), 2),
    "search": (lambda s, d: ranking.search(d, bench(s)), 6),
    "search without items": (lambda s, d: ranking.search(d, bench(s, ())), 0),
}


@pytest.mark.parametrize("name", list(ALL))
def test_edges(spark, name):
    operator, rows = ALL[name]
    assert operator(spark, table(spark, ROWS)).count() == rows


@pytest.mark.parametrize("name", list(ALL))
def test_empty_tables(spark, name):
    assert ALL[name][0](spark, table(spark, [])).count() == 0


def test_copies_of_null_empty_and_repeated_rows(spark):
    got = sorted({(r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(table(spark, ROWS)).collect()})
    assert (2, 3, 3, False) in got and (3, 3, 3, True) in got and (1, 1, 3, True) in got and (0, 1, 3, False) in got
    kept = exact_dedup.survivors(table(spark, ROWS)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 5, 5, 6] and all(r._dedup_sha == "x" for r in kept)


def test_near_copies_of_texts_without_words(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, ROWS)).collect() if r.doc_id in (2, 3, 6)}
    assert got == {d: ("0" * 16, 2) for d in (2, 3, 6)}
    only_null = simhash.near_duplicates(table(spark, [(None, "a b c", None, None, None)])).collect()
    assert only_null[0].component_id is None


def test_filters_return_rows_unchanged(spark):
    docs = table(spark, ROWS)
    for kept in (toxicity.accepted(docs, labels(spark)), templates.clean(docs, bench(spark)), simhash.representatives(docs), exact_dedup.survivors(docs)):
        assert kept.columns == docs.columns and kept.subtract(docs).count() == 0


def test_scores_without_labels(spark):
    assert {r.score for r in toxicity.scores(table(spark, ROWS), labels(spark, ())).collect()} == {0.0}
    assert {r.score for r in quality.scores(table(spark, ROWS), labels(spark, ())).collect()} == {0.5}


def test_pages_with_nulls(spark):
    rows = [(1, None, None, 5), (None, "u", "x", 5), (1, "u", "y" * 300_000, 5), (1, "u", "y" * 300_000, 5)]
    pages = importable(spark).createDataFrame(rows, "page_id long, url string, html string, shard long")
    got = fixity.audited_copy(pages, flip=2).collect()
    assert sorted((r.page_id or 0, r.body_bytes, r.status) for r in got) == [(0, 1, "intact"), (1, 0, "damaged"), (1, 300_000, "damaged"), (1, 300_000, "damaged")]
    assert fixity.audited_copy(pages.limit(0)).count() == 0
