"""Text and markup as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space only.
BLANK = r"[ \t\n\x0B\f\r]"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def compact(x: Column) -> Column:
    """Without ASCII white space, ASCII letters in lower case."""
    return ascii_lower(F.regexp_replace(x, BLANK + "+", ""))


def escape_html(x: Column, quotes: bool = False, line_break: str = "<br/>") -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quotes else ()), ("\n", line_break)):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def base64_plain(x: Column) -> Column:
    """Without the line breaks that Spark's base64 may put in."""
    return F.regexp_replace(F.base64(x), "[\r\n]", "")


ROW = r"(?is)<tr\b[^>]*>.*?</tr>"
#: What is left of a simple table without its rows.
SHELL = r"(?is)^\s*<table\b[^>]*>\s*</table>\s*$"


def table_rows(x: Column) -> Column:
    """Row strings of a text that is one HTML table of rows only, or null; nested tables and text between rows make it null."""
    rows = F.regexp_extract_all(x, F.lit(ROW), F.lit(0))
    simple = F.regexp_replace(x, ROW, "").rlike(SHELL) & (F.regexp_count(x, F.lit(r"(?i)<table\b")) == 1)
    return F.when(F.contains(x, F.lit("<")) & simple & (F.size(rows) > 0), rows)


def is_table(x: Column) -> Column:
    return table_rows(x).isNotNull()


def table_open(x: Column) -> Column:
    return F.regexp_extract(x, r"(?i)^\s*(<table\b[^>]*>)", 1)


def table_close(x: Column) -> Column:
    return F.regexp_extract(x, r"(?i)(</table>)\s*$", 1)


def columns_of(row: Column) -> Column:
    """Number of cells of a table row."""
    return F.regexp_count(row, F.lit(r"(?i)<t[dh]\b"))


def file_extension(path: Column) -> Column:
    return ascii_lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def under_root(path: Column, root: Column) -> Column:
    """path is root or below it, by whole components; neither may climb."""
    parts = lambda p: F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    a, b = parts(path), parts(root)
    climbs = F.array_contains(a, "..") | F.array_contains(b, "..")
    return ~climbs & (F.slice(a, 1, F.greatest(F.lit(1), F.size(b))) == b) | (~climbs & (F.size(b) == 0))
