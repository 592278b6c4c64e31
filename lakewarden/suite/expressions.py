"""Checked queries: the function surface of migrated views, one query per group."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import compat as x
from ..operators import keyed
from ..session import seconds_between
from . import query
from .tables import Tables


@query(
    "null_functions",
    """select dataset_id, coalesce(incremental_strategy, 'NONE') as nvl, coalesce(updated_at, created_at) as ifnull_, case when updated_at is not null then 'Y' else 'N' end as nvl2,
         nullif(execution_state, 'PAUSED') as nullif_, case when incremental_strategy is not distinct from 'WATERMARK' then 'W' when incremental_strategy is null then 'NULL' else '-' end as decode_,
         incremental_metadata is null as isnull_ from datasets""",
)
def null_functions(t: Tables):
    c = F.col
    return t.datasets.select(
        "dataset_id", x.nvl(c("incremental_strategy"), "NONE").alias("nvl"), x.ifnull(c("updated_at"), c("created_at")).alias("ifnull_"),
        x.nvl2(c("updated_at"), "Y", "N").alias("nvl2"), x.call("NULLIF", c("execution_state"), F.lit("PAUSED")).alias("nullif_"),
        x.decode(c("incremental_strategy"), "WATERMARK", "W", None, "NULL", "-").alias("decode_"), x.isnull(c("incremental_metadata")).alias("isnull_"),
    )


@query(
    "string_functions",
    """select p_partkey, substring(p_name, 2, 4) as substr_, right(p_name, 3) as substr_neg, instr(p_name, 'e') as instr_, cast(instr(substring(p_name, 4), 'e') as bigint) + case when instr(substring(p_name, 4), 'e') > 0 then 3 else 0 end as instr_from,
         length(p_name) as length_, lower(p_brand) as lower_, upper(p_type) as upper_, trim('  ' || p_type || ' ') as trim_, ltrim('  ' || p_type) as ltrim_, rtrim(p_type || '  ') as rtrim_,
         lpad(p_type, 12, '*') as lpad_, rpad(p_type, 12, '*') as rpad_, replace(p_name, ' ', '-') as replace_, translate(p_brand, '#B', '/b') as translate_,
         p_name || '' || p_brand as concat_, chr(cast(65 + p_size % 26 as integer)) as chr_, cast(ascii(p_name) as integer) as ascii_, left(p_name, 2) as left_, right(p_name, 2) as right_,
         reverse(p_name) as reverse_, repeat(' ', cast(p_size % 4 as integer)) || '|' as space_, repeat('ab', cast(p_size % 3 as integer)) as repeat_, concat_ws('/', p_brand, p_type) as concat_ws_,
         string_split(p_name, ' ')[1] as split_first from @part""",
)
def string_functions(t: Tables):
    n, b, ty, s = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size")
    pad = F.lit("  ")
    return t.part.select(
        "p_partkey", x.substr(n, 2, 4).alias("substr_"), x.substr(n, -3).alias("substr_neg"), x.instr(n, "e").cast("bigint").alias("instr_"),
        x.instr(n, "e", 4).cast("bigint").alias("instr_from"), x.call("LENGTH", n).cast("bigint").alias("length_"), x.call("LOWER", b).alias("lower_"),
        x.call("UPPER", ty).alias("upper_"), x.call("TRIM", F.concat(pad, ty, F.lit(" "))).alias("trim_"), x.call("LTRIM", F.concat(pad, ty)).alias("ltrim_"),
        x.call("RTRIM", F.concat(ty, pad)).alias("rtrim_"), x.call("LPAD", ty, 12, "*").alias("lpad_"), x.call("RPAD", ty, 12, "*").alias("rpad_"),
        x.call("REPLACE", n, F.lit(" "), F.lit("-")).alias("replace_"), x.call("TRANSLATE", b, "#B", "/b").alias("translate_"),
        x.concat(n, F.lit(None).cast("string"), b).alias("concat_"), x.chr_(65 + s % 26).alias("chr_"), x.call("ASCII", n).alias("ascii_"),
        x.left(n, 2).alias("left_"), x.right(n, 2).alias("right_"), x.call("REVERSE", n).alias("reverse_"),
        F.concat(x.space(s % 4), F.lit("|")).alias("space_"), x.call("REPEAT", F.lit("ab"), s % 3).alias("repeat_"),
        x.call("CONCAT_WS", "/", b, ty).alias("concat_ws_"), x.call("SPLIT", n, " ")[0].alias("split_first"),
    )


@query(
    "initcap_names",
    """select p_partkey, upper(left(split_part(p_name, ' ', 1), 1)) || lower(substring(split_part(p_name, ' ', 1), 2)) || ' ' ||
         upper(left(split_part(p_name, ' ', 2), 1)) || lower(substring(split_part(p_name, ' ', 2), 2)) as initcap_ from @part""",
)
def initcap_names(t: Tables):
    return t.part.select("p_partkey", x.call("INITCAP", F.upper("p_name")).alias("initcap_"))


@query(
    "regex_functions",
    r"""select page_id, nullif(regexp_extract(url, '[0-9]+'), '') as regexp_substr_, regexp_extract(url, '^(\w+)://([^/]+)/', 2) as host, regexp_replace(url, '[0-9]+', '#', 'g') as replaced,
          regexp_matches(url, 'page=[0-9]+') as has_page from @pages""",
)
def regex_functions(t: Tables):
    u = F.col("url")
    return t.pages.select(
        "page_id", x.regexp_substr(u, "[0-9]+").alias("regexp_substr_"), x.call("REGEXP_EXTRACT", u, r"^(\w+)://([^/]+)/", 2).alias("host"),
        x.call("REGEXP_REPLACE", u, "[0-9]+", "#").alias("replaced"), x.regexp_like(u, "page=[0-9]+").alias("has_page"),
    )


@query(
    "date_functions",
    """select o_orderkey, strftime(o_orderdate, '%d/%m/%Y') as to_char_, cast(o_orderdate as date) as to_date_, cast(cast(o_orderdate as date) as timestamp) as trunc_day,
         cast(date_trunc('month', o_orderdate) as timestamp) as trunc_month, cast(date_trunc('quarter', o_orderdate) as timestamp) as trunc_quarter,
         cast(o_orderdate + interval 2 month as date) as add_months_, cast(last_day(o_orderdate) as date) as last_day_,
         cast(cast(o_orderdate as date) + cast(8 - isodow(o_orderdate) as integer) as date) as next_monday,
         cast(year(o_orderdate) as integer) as year_, cast(month(o_orderdate) as integer) as month_, cast(day(o_orderdate) as integer) as day_,
         cast(extract(quarter from o_orderdate) as integer) as quarter_, cast(date_diff('day', cast(o_orderdate as date), date '2001-12-31') as integer) as datediff_,
         cast(cast(o_orderdate as date) + 10 as date) as date_add_, cast(cast(o_orderdate as date) - 10 as date) as date_sub_, o_orderdate + SECS[90061] as plus_interval from @orders""",
)
def date_functions(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", x.to_char(d, "dd/MM/yyyy").alias("to_char_"), x.to_date(x.to_char(d, "dd/MM/yyyy"), "dd/MM/yyyy").alias("to_date_"),
        x.trunc(d).alias("trunc_day"), x.trunc(d, "MM").alias("trunc_month"), x.trunc(d, "Q").alias("trunc_quarter"),
        x.call("ADD_MONTHS", d, 2).alias("add_months_"), x.call("LAST_DAY", d).alias("last_day_"), x.call("NEXT_DAY", d, "Mon").alias("next_monday"),
        x.call("YEAR", d).alias("year_"), x.call("MONTH", d).alias("month_"), x.call("DAY", d).alias("day_"), x.extract("QUARTER", d).cast("int").alias("quarter_"),
        x.datediff(F.lit("2001-12-31").cast("date"), d).alias("datediff_"), x.call("DATE_ADD", d, 10).alias("date_add_"), x.call("DATE_SUB", d, 10).alias("date_sub_"),
        (d + x.numtodsinterval(1, "DAY") + x.numtodsinterval(1, "HOUR") + x.numtodsinterval(61, "SECOND")).alias("plus_interval"),
    )


@query(
    "text_to_time",
    """select event_id, ts as to_timestamp_, date_sub('second', cast(date_trunc('day', ts) as timestamp), ts) as seconds_of_day from @events""",
)
def text_to_time(t: Tables):
    ts = F.col("ts")
    parsed = x.to_timestamp(x.to_char(ts, "dd/MM/yyyy HH:mm:ss.SSSSSS"), "dd/MM/yyyy HH:mm:ss.SSSSSS")
    return t.events.select("event_id", parsed.alias("to_timestamp_"), seconds_between(x.trunc(ts), ts).alias("seconds_of_day"))


@query(
    "months_between_dates",
    """select o_orderkey, round(cast((2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate) as double) + (1 - day(o_orderdate)) / 31.0, 8) as months from @orders""",
)
def months_between_dates(t: Tables):
    return t.orders.select("o_orderkey", x.months_between(F.lit("2001-08-01").cast("date"), F.col("o_orderdate")).alias("months"))


@query(
    "numeric_functions",
    """select c_custkey, round(b, 1) as round_, cast(ceil(b) as bigint) as ceil_, cast(floor(b) as bigint) as floor_, abs(b) as abs_, c_custkey % 7 as mod_, c_custkey as mod_zero,
         cast(sign(b) as double) as sign_, power(c_nationkey, 2.0) as power_, round(sqrt(abs(c_acctbal)), 6) as sqrt_, greatest(c_custkey, 700) as greatest_, least(c_custkey, 700) as least_,
         round(case when c_nationkey <> 0 then c_acctbal / c_nationkey end, 6) as safe_divide_, cast('12.5' as decimal(10,2)) + b as to_number_, c_custkey & 12 as bitand_, c_custkey | 12 as bitor_, xor(c_custkey, 12) as bitxor_
       from (select *, cast(c_acctbal as decimal(12,2)) as b from @customer) c""",
)
def numeric_functions(t: Tables):
    k, n, a = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    b = a.cast("decimal(12,2)")
    return t.customer.select(
        "c_custkey", x.call("ROUND", b, 1).cast("decimal(12,1)").alias("round_"), x.call("CEIL", b).cast("bigint").alias("ceil_"), x.call("FLOOR", b).cast("bigint").alias("floor_"),
        x.call("ABS", b).alias("abs_"), x.mod(k, 7).alias("mod_"), x.mod(k, 0).alias("mod_zero"), x.call("SIGN", b).alias("sign_"), x.call("POWER", n, 2.0).alias("power_"),
        F.round(x.call("SQRT", F.abs(a)), 6).alias("sqrt_"), x.call("GREATEST", k, F.lit(700)).alias("greatest_"), x.call("LEAST", k, F.lit(700)).alias("least_"),
        F.round(x.safe_divide(a, n), 6).alias("safe_divide_"), (x.to_number(F.lit("12.5"), 10, 2) + b).alias("to_number_"),
        x.bitand(k, 12).alias("bitand_"), x.bitor(k, 12).alias("bitor_"), x.bitxor(k, 12).alias("bitxor_"),
    )


@query(
    "cast_functions",
    """select l_orderkey, l_linenumber, l_partkey, try_cast(trim(qty) as integer) as try_cast_, cast(l_linenumber as varchar) as cast_, cast(l_partkey as double) as convert_,
         case when l_linenumber > 3 then 'late' else 'early' end as iif_ from raw_lines""",
)
def cast_functions(t: Tables):
    return t.raw_lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", x.try_cast(F.trim("qty"), "int").alias("try_cast_"), F.col("l_linenumber").cast("string").alias("cast_"),
        x.call("CONVERT", F.col("l_partkey"), "double").alias("convert_"), x.iif(F.col("l_linenumber") > 3, "late", "early").alias("iif_"),
    )


@query(
    "predicates",
    """select o_orderkey from @orders o where o_orderstatus in ('F', 'O') and not (o_totalprice between 100000 and 200000) and o_orderpriority like '%-%IGH%' or
         (o_orderdate is not null and o_totalprice > 490000 and exists (select 1 from @lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R'))""",
)
def predicates(t: Tables):
    """EXISTS as a semi join with a flag, so that it can stand in an OR."""
    returned = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("has", F.lit(True))
    c = F.col
    simple = c("o_orderstatus").isin("F", "O") & ~c("o_totalprice").between(100000, 200000) & c("o_orderpriority").like("%-%IGH%")
    other = c("o_orderdate").isNotNull() & (c("o_totalprice") > 490000) & F.coalesce(c("has"), F.lit(False))
    return t.orders.join(returned, "o_orderkey", "left").filter(simple | other).select("o_orderkey")


@query("row_numbers", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as rownum from @orders")
def row_numbers(t: Tables):
    """ROWNUM in an explicit order over the whole table; a crowded day is divided by key ranges."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    numbered = keyed.number_rows(t.orders.select("o_orderkey", "o_orderdate"), [day, key], [day, F.floor(key / 100_000)])
    return numbered.select("o_orderkey", "rownum")


@query(
    "array_functions",
    """select l_orderkey, count(distinct l_returnflag) as size_, min(l_returnflag) as first_flag, count(*) as exploded_sum from @lineitem group by l_orderkey""",
)
def array_functions(t: Tables):
    """STRUCT, COLLECT_LIST, SIZE and EXPLODE; lines are counted per flag first, so a list holds at most one entry per flag."""
    counted = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    g = counted.groupBy("l_orderkey").agg(F.array_sort(x.call("COLLECT_LIST", x.call("STRUCT", "l_returnflag", "n"))).alias("flags"))
    flat = g.select("l_orderkey", x.call("SIZE", F.col("flags")).alias("size"), F.col("flags")[0]["l_returnflag"].alias("first"), x.call("EXPLODE", "flags").alias("f"))
    return flat.groupBy("l_orderkey").agg(
        F.max("size").cast("bigint").alias("size_"), F.min("first").alias("first_flag"), F.sum("f.n").alias("exploded_sum")
    )


@query("list_aggregate", "select n_regionkey, string_agg(n_name, ';' order by n_name) as names from @nation group by n_regionkey")
def list_aggregate(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(x.listagg(F.col("n_name"), ";").alias("names"))


@query(
    "customer_order_list",
    "select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as priorities, count(*) as n from @orders group by o_custkey",
)
def customer_order_list(t: Tables):
    """Distinct values are reduced before they are gathered, so the list is bounded by the number of priorities."""
    counted = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("o_custkey").agg(x.wm_concat(F.col("o_orderpriority")).alias("priorities"), F.sum("c").alias("n"))


@query("json_functions", "select event_id, cast(json_extract_string(props, '$.k') as integer) as k, json_extract_string(props, '$.missing') as missing from @events")
def json_functions(t: Tables):
    return t.events.select(
        "event_id", F.from_json("props", "k int").getField("k").alias("k"), F.get_json_object("props", "$.missing").alias("missing")
    )


@query(
    "aggregate_functions",
    """select o_orderstatus, count(*) as count_, count(distinct o_custkey) as count_distinct_, cast(sum(p) as decimal(18,2)) as sum_, round(avg(o_totalprice), 4) as avg_, min(p) as min_, max(p) as max_,
         round(stddev(o_totalprice), 3) as stddev_, round(variance(o_totalprice) / 1e6, 3) as variance_m, round(median(o_totalprice), 4) as median_
       from (select *, cast(o_totalprice as decimal(18,2)) as p from @orders) o group by o_orderstatus""",
)
def aggregate_functions(t: Tables):
    """The median comes from counted ranges of values, not from a group gathered in one buffer."""
    o, p, d = t.orders, F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_totalprice")
    middle = keyed.medians(o, ["o_orderstatus"], "o_totalprice", width=1000.0)
    others = o.groupBy("o_orderstatus").agg(
        x.call("COUNT", F.lit(1)).alias("count_"), F.count_distinct("o_custkey").alias("count_distinct_"), x.call("SUM", p).cast("decimal(18,2)").alias("sum_"),
        F.round(x.call("AVG", d), 4).alias("avg_"), x.call("MIN", p).alias("min_"), x.call("MAX", p).alias("max_"), F.round(x.call("STDDEV", d), 3).alias("stddev_"),
        F.round(x.call("VARIANCE", d) / 1e6, 3).alias("variance_m"),
    )
    return others.join(middle.select("o_orderstatus", F.round("median", 4).alias("median_")), "o_orderstatus", "inner")


@query(
    "analytic_functions",
    """select o_orderkey, row_number() over w as row_number_, rank() over p as rank_, dense_rank() over p as dense_rank_, ntile(3) over w as ntile_, lag(o_orderkey) over w as lag_, lead(o_orderkey) over w as lead_,
         first_value(o_orderkey) over w as first_value_, last_value(o_orderkey) over (w rows between unbounded preceding and unbounded following) as last_value_, round(cume_dist() over p, 9) as cume_dist_,
         round(percent_rank() over p, 9) as percent_rank_, nth_value(o_orderkey, 2) over (w rows between unbounded preceding and unbounded following) as nth_value_
       from @orders window w as (partition by o_custkey order by o_orderpriority, o_orderkey), p as (partition by o_custkey order by o_orderpriority)""",
)
def analytic_functions(t: Tables):
    """Ranking functions per customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")
    p, k = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), F.col("o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    big = lambda c: c.cast("bigint")
    return t.orders.select(
        "o_orderkey", big(x.call("ROW_NUMBER").over(w)).alias("row_number_"), big(x.call("RANK").over(p)).alias("rank_"), big(x.call("DENSE_RANK").over(p)).alias("dense_rank_"),
        big(x.call("NTILE", 3).over(w)).alias("ntile_"), x.call("LAG", k).over(w).alias("lag_"), x.call("LEAD", k).over(w).alias("lead_"),
        x.call("FIRST_VALUE", k).over(w).alias("first_value_"), x.call("LAST_VALUE", k).over(whole).alias("last_value_"),
        F.round(x.call("CUME_DIST").over(p), 9).alias("cume_dist_"), F.round(x.call("PERCENT_RANK").over(p), 9).alias("percent_rank_"),
        x.call("NTH_VALUE", k, 2).over(whole).alias("nth_value_"),
    )


@query(
    "share_of_customer_total",
    "select o_orderkey, round(cast(p as double) / cast(sum(p) over (partition by o_custkey) as double), 9) as share from (select o_orderkey, o_custkey, cast(o_totalprice as decimal(18,2)) as p from @orders) o",
)
def share_of_customer_total(t: Tables):
    """RATIO_TO_REPORT; the total of a hot customer is joined by salt instead of a window."""
    o = t.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    out = keyed.attach_group_values(o, ["o_custkey"], [F.sum("p").alias("total")])
    return out.select("o_orderkey", F.round(x.safe_divide(F.col("p").cast("double"), F.col("total").cast("double")), 9).alias("share"))
