"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fixity, jaccard, licenses, pii, quality, ranking, sentencepieces, simhash, spelling, templates, token_files, toxicity
from .common import importable


def _over(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*[importable(spark).read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": _over(lambda docs: token_files.round_trip(docs, token_files.default_vocabulary()), "documents"),
    "op2_warc_fixity": _over(fixity.audited_copy, "pages"),
    "op3_template_decontamination": _over(templates.leaks, "documents", "benchmark"),
    "op4_toxicity": _over(toxicity.scores, "documents", "labels"),
    "op5_pii": _over(pii.find, "documents"),
    "op6_sentencepieces": _over(sentencepieces.encoded, "documents"),
    "op7_licenses": _over(licenses.scan, "documents"),
    "op8_quality": _over(quality.scores, "documents", "labels"),
    "op9_exact_dedup": _over(exact_dedup.groups, "documents"),
    "op10_simhash": _over(simhash.near_duplicates, "documents"),
    "op11_jaccard_join": _over(jaccard.near_duplicates, "documents"),
    "op12_spelling_variants": _over(spelling.variants, "documents"),
    "op13_ranked_search": _over(ranking.search, "documents", "benchmark"),
}

ORACLES: dict[str, str] = {
    # The damage planted in the replica is known, so the audit's outcome is too.
    "op2_warc_fixity": """
        select page_id, cast(strlen(coalesce(html, '')) as bigint) as body_bytes, sha256(coalesce(html, '')) as body_sha256,
               case when page_id % 101 = 1 then 'damaged' else 'intact' end as status
        from pages""",
    "op9_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id is not distinct from max(doc_id) over same as kept, sha256(norm) as text_sha256
        from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents) d
        window same as (partition by norm)""",
    "op11_jaccard_join": r"""
        with recursive words as materialized (
            select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
            from documents),
        shingles as materialized (
            select distinct r, unnest(list_transform(range(greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i + 1:i + 4], ' '))) as s from words where len(w) > 0),
        sizes as materialized (select r, count(*) as n from shingles group by r),
        near as materialized (
            select x.r as a, y.r as b from shingles x join shingles y on x.s = y.s and x.r < y.r
            join sizes nx on nx.r = x.r join sizes ny on ny.r = y.r
            group by all having 100 * count(*) >= 85 * (max(nx.n) + max(ny.n) - count(*))),
        either as materialized (select a, b from near union all select b, a from near),
        reach as (select r as a, r as b from sizes union select reach.a, either.b from reach join either on either.a = reach.b)
        select doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id
        from words left join sizes using (r)
        left join (select reach.a as r, min(o.doc_id) as component_id from reach join words o on o.r = reach.b group by reach.a) c using (r)""",
    "op12_spelling_variants": r"""
        with recursive bits as (
            select i as byte, 0 as step, i::bigint as v from range(256) t(i)
            union all select byte, step + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from bits where step < 8),
        crc as (select list(v order by byte) as t from bits where step = 8),
        runs as materialized (
            select doc_id, run, count(*) as n from (
                select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents)
            where length(run) >= 5 group by all),
        hashed as (
            select run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
                string_split(concat(doc_id, ':', run), ''),
                lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [195::bigint, ord(c)::bigint - 64] end))),
                lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]))) as h
            from runs, crc),
        words as materialized (
            select word, sum(n)::bigint as n from (
                select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed)
            where length(word) >= 5 group by word having sum(n) >= 3),
        holes as materialized (
            select word, n, i, substr(word, 1, i) || substr(word, i + 2) as less, substr(word, 1, i) || '_' || substr(word, i + 2) as holed
            from (select word, n, unnest(range(length(word))) as i from words)),
        near as materialized (
            select x.word, y.word as other, y.n from holes x join holes y on x.holed = y.holed and x.word <> y.word
            union select x.word, y.word, y.n from holes x join words y on x.less = y.word
            union select y.word, x.word, x.n from holes x join words y on x.less = y.word),
        best as (select word, count(*) as n_near, arg_min(other, (-n, encode(other))) as other, max(n) as other_n from near group by word),
        formed as materialized (
            select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * w.n then other end as form, case when other_n >= 2 * w.n then other_n end as form_n
            from words w left join best using (word)),
        paths as (
            select word, word as at, 0 as step from formed
            union all select p.word, f.form, step + 1 from paths p join formed f on f.word = p.at where f.form is not null)
        select word, form, (select arg_max(p.at, p.step) from paths p where p.word = f.word) as root, n, n_near, form_n from formed f""",
    "op13_ranked_search": r"""
        with found as materialized (
            select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
            from documents),
        total as (select count(*) filter (len(w) > 0)::hugeint as docs, coalesce(sum(len(w)), 0)::hugeint as terms from found),
        items as materialized (
            select q, item_id, t, count(*) as repeats from (
                select row_number() over () as q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark)
            group by all),
        held as materialized (
            select r, doc_id, n, t, count(*) as tf from (select r, doc_id, len(w) as n, unnest(w) as t from found) where t in (select t from items) group by all),
        weights as (select t, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from held, total group by t),
        scores as (
            select q, item_id, r, doc_id, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
            from items join held using (t) join weights using (t), total group by all)
        select item_id, rank, doc_id, score from (
            select item_id, row_number() over (partition by q order by score desc, doc_id nulls last)::int as rank, doc_id, score from scores where score > 0)
        where rank <= 20""",
}
