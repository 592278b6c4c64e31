"""Familiar SQL function names as column helpers.

Views that are moved from another database use these names; each helper gives that function's meaning
with built-in expressions. Helpers that would only repeat a Spark function of the same name and meaning
are gathered in ``SAME`` and reachable through ``call``.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- NULL ---------------------------------------------------------------------------------------


def nvl(a, b) -> Column:
    return F.coalesce(_c(a), _c(b))


ifnull = nvl


def nvl2(test, not_null, null) -> Column:
    return F.when(_c(test).isNotNull(), _c(not_null)).otherwise(_c(null))


def isnull(a) -> Column:
    return _c(a).isNull()


def decode(value, *args) -> Column:
    """DECODE(value, search, result, ..., [default]); NULL equals NULL."""
    pairs, default = (args[:-1], _c(args[-1])) if len(args) % 2 else (args, F.lit(None))
    out = None
    for i in range(0, len(pairs), 2):
        cond = _c(value).eqNullSafe(_c(pairs[i]))
        out = F.when(cond, _c(pairs[i + 1])) if out is None else out.when(cond, _c(pairs[i + 1]))
    return out.otherwise(default) if out is not None else default


# --- text ---------------------------------------------------------------------------------------


def substr(s, start, length=None) -> Column:
    """Positions count from 1; a negative start counts from the end; 0 means 1."""
    begin = F.when(_c(start) == 0, F.lit(1)).otherwise(_c(start)) if isinstance(start, Column) else F.lit(start or 1)
    return F.substring(_c(s), begin, _c(length)) if length is not None else F.substr(_c(s), begin)


def instr(s, find, start: int = 1) -> Column:
    """Position of the first occurrence at or after ``start``; 0 when there is none."""
    return F.position(_c(find), _c(s), F.lit(start))


def locate(find, s, start: int = 1) -> Column:
    return instr(s, find, start)


position = locate
charindex = locate


def concat(*parts) -> Column:
    """``||``: a NULL part counts as empty text."""
    return F.concat(*[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])


def chr_(n) -> Column:
    return F.char(_c(n))


def space(n) -> Column:
    return F.repeat(F.lit(" "), _c(n))


def left(s, n) -> Column:
    return F.left(_c(s), _c(n))


def right(s, n) -> Column:
    return F.right(_c(s), _c(n))


def regexp_substr(s, pattern) -> Column:
    """The first match, or NULL."""
    return F.regexp_substr(_c(s), _c(pattern))


def regexp_like(s, pattern: str) -> Column:
    return _c(s).rlike(pattern)


# --- dates --------------------------------------------------------------------------------------


def sysdate() -> Column:
    """Now; reports of this library take an explicit time instead."""
    return F.current_timestamp()


def to_char(value, fmt: str) -> Column:
    """A date or timestamp as text in a Spark date pattern."""
    return F.date_format(_c(value), fmt)


def to_date(value, fmt: str | None = None) -> Column:
    return F.to_date(_c(value), fmt) if fmt else F.to_date(_c(value))


def to_timestamp(value, fmt: str | None = None) -> Column:
    return F.to_timestamp_ntz(_c(value), F.lit(fmt)) if fmt else _c(value).cast("timestamp_ntz")


def trunc(value, unit: str = "DD") -> Column:
    """A timestamp cut to a unit: the day by default."""
    name = {"DD": "day", "DDD": "day", "MM": "month", "MON": "month", "YYYY": "year", "YY": "year", "Q": "quarter",
            "HH": "hour", "HH24": "hour", "MI": "minute", "IW": "week"}.get(unit.upper(), unit)
    return F.date_trunc(name, _c(value)).cast("timestamp_ntz")


def numtodsinterval(n, unit: str) -> Column:
    """A day-to-second interval of n DAY, HOUR, MINUTE or SECOND."""
    part = {"DAY": "days", "HOUR": "hours", "MINUTE": "mins", "SECOND": "secs"}[unit.upper()]
    return F.make_dt_interval(**{part: _c(n)})


def months_between(a, b) -> Column:
    return F.months_between(_c(a), _c(b))


def extract(field: str, value) -> Column:
    return F.extract(F.lit(field), _c(value))


def datediff(end, start) -> Column:
    return F.date_diff(_c(end), _c(start))


# --- numbers ------------------------------------------------------------------------------------


def mod(a, b) -> Column:
    """Remainder with the sign of the dividend; a zero divisor returns the dividend."""
    return F.when(_c(b) == 0, _c(a)).otherwise(F.try_mod(_c(a), _c(b)))


def safe_divide(a, b) -> Column:
    return F.try_divide(_c(a), _c(b))


def to_number(s, precision: int = 38, scale: int = 10) -> Column:
    return _c(s).cast(f"decimal({precision},{scale})")


def bitand(a, b) -> Column:
    return _c(a).bitwiseAND(_c(b))


def bitor(a, b) -> Column:
    return _c(a).bitwiseOR(_c(b))


def bitxor(a, b) -> Column:
    return _c(a).bitwiseXOR(_c(b))


def try_cast(value, type_name: str) -> Column:
    return _c(value).try_cast(type_name)


def iif(cond: Column, yes, no) -> Column:
    return F.when(cond, _c(yes)).otherwise(_c(no))


# --- rows and groups ----------------------------------------------------------------------------


def rownum(order: WindowSpec) -> Column:
    """Row numbers in an explicit order."""
    return F.row_number().over(order)


def ratio_to_report(value, group: WindowSpec) -> Column:
    return F.try_divide(_c(value), F.sum(_c(value)).over(group))


def listagg(value, separator: str = ",") -> Column:
    """The values of a group in ascending order, joined by a separator; NULLs are left out."""
    return F.array_join(F.array_sort(F.collect_list(_c(value).cast("string"))), separator)


wm_concat = group_concat = listagg


def median(value) -> Column:
    return F.median(_c(value))


# The function names below, here and in OWN, are those that users' queries call. These mean the same in Spark.
SAME = {
    "COALESCE": F.coalesce, "NULLIF": F.nullif, "LENGTH": F.length, "LOWER": F.lower, "UPPER": F.upper, "TRIM": F.trim,
    "LTRIM": F.ltrim, "RTRIM": F.rtrim, "LPAD": F.lpad, "RPAD": F.rpad, "REPLACE": F.replace, "TRANSLATE": F.translate,
    "INITCAP": F.initcap, "ASCII": F.ascii, "REVERSE": F.reverse, "REPEAT": F.repeat, "CONCAT_WS": F.concat_ws,
    "SPLIT": F.split, "REGEXP_EXTRACT": F.regexp_extract, "REGEXP_REPLACE": F.regexp_replace,
    "CURRENT_DATE": F.current_date, "CURRENT_TIMESTAMP": F.current_timestamp, "DATE_FORMAT": F.date_format,
    "DATE_TRUNC": F.date_trunc, "ADD_MONTHS": F.add_months, "LAST_DAY": F.last_day, "NEXT_DAY": F.next_day,
    "YEAR": F.year, "MONTH": F.month, "DAY": F.day, "DATE_ADD": F.date_add, "DATE_SUB": F.date_sub,
    "ROUND": F.round, "CEIL": F.ceil, "FLOOR": F.floor, "ABS": F.abs, "SIGN": F.sign, "POWER": F.power, "SQRT": F.sqrt,
    "GREATEST": F.greatest, "LEAST": F.least, "COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max,
    "STDDEV": F.stddev, "VARIANCE": F.variance, "ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank,
    "NTILE": F.ntile, "LAG": F.lag, "LEAD": F.lead, "FIRST_VALUE": F.first_value, "LAST_VALUE": F.last_value,
    "CUME_DIST": F.cume_dist, "PERCENT_RANK": F.percent_rank, "NTH_VALUE": F.nth_value, "COLLECT_LIST": F.collect_list,
    "SIZE": F.size, "ARRAY": F.array, "EXPLODE": F.explode, "STRUCT": F.struct, "NAMED_STRUCT": F.named_struct,
}
OWN = {
    "NVL": nvl, "IFNULL": ifnull, "NVL2": nvl2, "ISNULL": isnull, "DECODE": decode, "SUBSTR": substr, "SUBSTRING": substr,
    "INSTR": instr, "LOCATE": locate, "POSITION": position, "CHARINDEX": charindex, "CONCAT": concat, "CHR": chr_,
    "SPACE": space, "LEFT": left, "RIGHT": right, "REGEXP_SUBSTR": regexp_substr, "REGEXP_LIKE": regexp_like,
    "SYSDATE": sysdate, "TO_CHAR": to_char, "TO_DATE": to_date, "TO_TIMESTAMP": to_timestamp, "TRUNC": trunc,
    "NUMTODSINTERVAL": numtodsinterval, "MONTHS_BETWEEN": months_between, "EXTRACT": extract, "DATEDIFF": datediff,
    "MOD": mod, "SAFE_DIVIDE": safe_divide, "TO_NUMBER": to_number, "BITAND": bitand, "BITOR": bitor, "BITXOR": bitxor,
    "TRY_CAST": try_cast, "CONVERT": try_cast, "IF": iif, "IIF": iif, "ROWNUM": rownum, "RATIO_TO_REPORT": ratio_to_report,
    "LISTAGG": listagg, "WM_CONCAT": wm_concat, "GROUP_CONCAT": group_concat, "MEDIAN": median,
}


def call(name: str, *args, **kwargs) -> Column:
    """The function of that name; unknown names need a manual review."""
    fn = OWN.get(name.upper()) or SAME.get(name.upper())
    if fn is None:
        raise KeyError(f"Function needs manual review: {name}")
    return fn(*args, **kwargs)


def supported(name: str) -> bool:
    return name.upper() in OWN or name.upper() in SAME
