"""Clean-up and audits of long texts. Whole texts are processed; everything is a narrow column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of the fixes and their names.
FIXES = (
    ("normalize_line_breaks", lambda c: F.regexp_replace(c, r"\r\n?", "\n")),
    (
        "remove_html_tags",
        lambda c: F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", ""),
    ),
    ("remove_excel_escapes", lambda c: F.regexp_replace(c, r"_x[0-9A-Fa-f]{4}_", "")),
    (
        "normalize_whitespace",
        lambda c: F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]+", " "),
    ),
)


def clean_steps(text: Column) -> list[tuple[str, Column]]:
    """The text after each fix, in order."""
    out = []
    for name, fix in FIXES:
        text = fix(text)
        out.append((name, text))
    return out


def count_of(text: Column, mark: str) -> Column:
    """How often a character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def lone_single_quotes(text: Column) -> Column:
    """Single quotes that do not stand next to another one."""
    return F.regexp_count(text, F.lit(r"(?<!')'(?!')"))


def delimiter_audit(text: Column, keyword: str | None = None) -> dict[str, Column]:
    """Counts of quotes and parentheses, balance flags, and whether a keyword occurs as a word."""
    dq, sq = count_of(text, '"'), lone_single_quotes(text)
    opens, closes = count_of(text, "("), count_of(text, ")")
    out = {
        "double_quotes": dq.cast("bigint"), "single_quotes": sq.cast("bigint"), "open_parens": opens.cast("bigint"),
        "close_parens": closes.cast("bigint"), "quotes_balanced": (dq % 2 == 0) & (sq % 2 == 0), "parens_balanced": opens == closes,
    }
    if keyword:
        out["has_keyword"] = text.rlike(rf"(?i)(^|[^A-Za-z0-9_]){keyword}([^A-Za-z0-9_]|$)")
    return out


def strip_link_suffix(name: Column) -> Column:
    """A table name without its trailing @LINK."""
    return F.regexp_replace(name, r"@[A-Za-z0-9_]+$", "")


def preview(text: Column, size: int = 500) -> Column:
    """The first characters of a long text, for a report."""
    return F.substring(text, 1, size)


def contains_any_case(term: str, *columns: Column) -> Column:
    """Whether any column contains the term, ignoring case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(term.lower()), F.lit(False))
    return out


def like_any(column: Column, *patterns: str) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | column.like(p)
    return out
