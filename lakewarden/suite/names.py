"""Checked queries: names and long texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import fuzzy
from ..plans import registry
from . import query
from .tables import Tables

# --- names --------------------------------------------------------------------------------------


@query("like_any_names", "select full_name from catalog_names where full_name like '%ring%' or full_name like '%brand_1%' or full_name like '%promo%'")
def like_any_names(t: Tables):
    return t.catalog_names.filter(text.like_any(F.col("full_name"), "%ring%", "%brand_1%", "%promo%"))


@query(
    "name_formats",
    r"""select dataset_id, case when source_type = 'ORACLE' then case when regexp_full_match(bronze_table, '[A-Za-z0-9_@.$#]+') then 'VALID' else 'ERROR' end
          else case when regexp_full_match(bronze_table, '[A-Za-z0-9_]+') then 'VALID' else 'ERROR' end end as name_status from datasets""",
)
def name_formats(t: Tables):
    return t.datasets.select("dataset_id", registry.name_status(F.col("source_type"), F.col("bronze_table")).alias("name_status"))


@query("link_suffix_stripped", r"select dataset_id, regexp_replace(bronze_table, '@[A-Za-z0-9_]+$', '') as bronze_table from datasets")
def link_suffix_stripped(t: Tables):
    return t.datasets.select("dataset_id", text.strip_link_suffix(F.col("bronze_table")).alias("bronze_table"))


@query(
    "ranked_column_names",
    """select n, case when contains(n, 'UPDATE') then 1 when contains(n, 'ALTERACAO') then 2 else 3 end as name_rank from (
        select distinct upper(replace(p_name, ' ', '_')) || case p_size % 3 when 0 then '_UPDATE_DT' when 1 then '_ALTERACAO' else '' end as n from @part) s""",
)
def ranked_column_names(t: Tables):
    size = F.col("p_size") % 3
    n = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.when(size == 0, "_UPDATE_DT").when(size == 1, "_ALTERACAO").otherwise(""))
    return registry.ranked_names(t.part.select(n.alias("n")).distinct(), "n")


NORM = r"trim(regexp_replace(split_part(lower(trim({0})), '.', -1), '_+', '_', 'g'), '_')"
LCS = """list_reduce(list_transform(range(1, length(n) + 1), lambda i: [cast(unicode(substring(n, i, 1)) as bigint)]),
   lambda prev, x: list_reduce(list_transform(range(1, length(c) + 1), lambda j: [j]),
     lambda done, y: list_append(done, case when unicode(substring(c, y[1], 1)) = x[1] then prev[y[1]] + 1 else greatest(prev[y[1] + 1], done[-1]) end),
     [cast(0 as bigint)]), list_transform(range(0, length(c) + 1), lambda z: cast(0 as bigint)))[-1]"""
MAPPING = f"""
 src as (select distinct name, {NORM.format('name')} as n from source_names),
 cat as (select {NORM.format('full_name')} as c, max(full_name) as f from catalog_names group by 1),
 rest as (select * from src where n not in (select c from cat)),
 pairs as (select n, c, case when length(n) < 10 then 0.95 when length(n) <= 25 then 0.90 else 0.85 end as cut,
     len(list_intersect(nt, ct)) / (len(nt) + len(ct) - len(list_intersect(nt, ct))) as jac,
     list_max(list_transform(range(0, least(length(n), length(c)) + 1), lambda i: case when left(n, i) = left(c, i) then i else 0 end)) / greatest(length(n), length(c)) as pfx
   from (select distinct n, list_distinct(string_split(n, '_')) as nt from rest) a, (select c, list_distinct(string_split(c, '_')) as ct from cat) b
   where left(n, 1) = left(c, 1)),
 close as (select * from pairs where 0.5 * 2.0 * least(length(n), length(c)) / (length(n) + length(c)) + 0.3 * jac + 0.2 * pfx >= cut - 1e-9),
 scored as (select n, c, cut, round(0.5 * 2.0 * {LCS} / (length(n) + length(c)) + 0.3 * jac + 0.2 * pfx, 9) as score from close),
 ranked as (select *, row_number() over (partition by n order by score desc, c) as rn, lead(score) over (partition by n order by score desc, c) as runner_up
   from scored where score >= cut - 1e-9),
 best as (select n, c, score, runner_up, case when runner_up is null or score - runner_up > 0.05 + 1e-9 then 'MATCHED' else 'AMBIGUOUS' end as status from ranked where rn = 1)"""


@query(
    "fuzzy_name_mapping",
    f"""with {MAPPING}
        select src.name, cat.f as match, cast(1.0 as double) as score, cast(null as double) as runner_up, 'EXACT' as status from src join cat on cat.c = src.n
        union all
        select rest.name, case when best.status = 'MATCHED' then cat.f end, best.score, best.runner_up, coalesce(best.status, 'NO_MATCH')
        from rest left join best on best.n = rest.n left join cat on cat.c = best.c""",
)
def fuzzy_name_mapping(t: Tables):
    return fuzzy.map_names(t.source_names, "name", t.catalog_names, "full_name")


@query(
    "fuzzy_mapping_summary",
    f"""with {MAPPING} select status, count(*) as n from (select 'EXACT' as status from src join cat on cat.c = src.n
        union all select coalesce(best.status, 'NO_MATCH') from rest left join best on best.n = rest.n) s group by status""",
)
def fuzzy_mapping_summary(t: Tables):
    return fuzzy.map_names(t.source_names, "name", t.catalog_names, "full_name").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- long texts ---------------------------------------------------------------------------------

C1 = r"regexp_replace({0}, '\r\n?', chr(10), 'g')"
C2 = r"regexp_replace(regexp_replace({0}, '<br\s*/?>', chr(10), 'gi'), '<[^>]+>', '', 'g')"
C3 = r"regexp_replace({0}, '_x[0-9A-Fa-f]{{4}}_', '', 'g')"
C4 = r"regexp_replace(regexp_replace({0}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')"


def cleaned_sql(key: str, body: str, table: str) -> str:
    return f"""select {key}, t4 as cleaned, concat_ws(',', case when t1 <> t0 then 'normalize_line_breaks' end, case when t2 <> t1 then 'remove_html_tags' end,
        case when t3 <> t2 then 'remove_excel_escapes' end, case when t4 <> t3 then 'normalize_whitespace' end) as fixes
      from (select *, {C4.format('t3')} as t4 from (select *, {C3.format('t2')} as t3 from (select *, {C2.format('t1')} as t2 from (
        select {key}, {body} as t0, {C1.format(body)} as t1 from {table}) a) b) c) d"""


def cleaned(df, key: str, column: str):
    """The cleaned text and the fixes that changed it."""
    before, marks, last = F.col(column), [], F.col(column)
    for name, after in text.clean_steps(before):
        marks.append(F.when(after != last, F.lit(name)))
        last = after
    return df.select(key, last.alias("cleaned"), F.concat_ws(",", *marks).alias("fixes"))


@query("page_clean_up", cleaned_sql("page_id", "html", "@pages"))
def page_clean_up(t: Tables):
    return cleaned(t.pages, "page_id", "html")


@query("document_clean_up", cleaned_sql("doc_id", "text", "@documents"))
def document_clean_up(t: Tables):
    return cleaned(t.documents, "doc_id", "text")


@query(
    "delimiter_audit",
    r"""select page_id, dq as double_quotes, sq as single_quotes, o as open_parens, c as close_parens, dq % 2 = 0 and sq % 2 = 0 as quotes_balanced, o = c as parens_balanced,
          regexp_matches(html, '(?i)(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)') as has_keyword
        from (select page_id, html, length(html) - length(replace(html, '"', '')) as dq, length(html) - length(replace(html, '(', '')) as o,
                length(html) - length(replace(html, ')', '')) as c, cast(len(list_filter(regexp_extract_all(html, '''+'), lambda x: length(x) = 1)) as bigint) as sq from @pages) s""",
)
def delimiter_audit(t: Tables):
    marks = text.delimiter_audit(F.col("html"), "the")
    return t.pages.select("page_id", *[c.alias(n) for n, c in marks.items()])


@query("text_preview", "select doc_id, substring(text, 1, 500) as preview from @documents")
def text_preview(t: Tables):
    return t.documents.select("doc_id", text.preview(F.col("text")).alias("preview"))
