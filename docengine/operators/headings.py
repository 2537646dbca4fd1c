"""Heading lines of procurement documents, as column expressions over lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions.text import clean_title, strip

# fixed values: patterns of heading lines, with levels where they have one
OUTLINE = "^(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+\\.\\s+.+|[IVX]+\\.\\s+.+|제\\s*\\d+\\s*[장절]\\s+.+|\\d+\\.\\s+.+|\\d+(?:\\.\\d+)+\\s+.+|[가-힣]\\.\\s+.+|\\(\\d+\\)\\s+.+|[□■○●\\-]\\s+.+)"
LEVELS = (
    (1, "^([ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+)\\.?\\s+(.+)$"), (1, "^([IVXLCDM]+)\\.?\\s+(.+)$"), (1, "^(제\\s*\\d+\\s*장)\\s+(.+)$"), (2, "^(제\\s*\\d+\\s*절)\\s+(.+)$"), (3, "^(\\d+(?:\\.\\d+)+)\\.?\\s+(.+)$"),
    (2, "^(\\d+)\\.\\s+(.+)$"), (3, "^([가-힣])\\.\\s+(.+)$"), (4, "^(\\(\\d+\\))\\s+(.+)$"), (4, "^([①-⑮])\\s*(.+)$"), (4, "^([□■○●\\-])\\s+(.+)$"),
)
CONTENTS = "^(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+\\.?\\s+.+|[IVXLCDM]+\\.?\\s+.+|\\d+(?:\\.\\d+)*[.)]?\\s*.+|[가-힣]\\.\\s*.+|\\[?붙임\\s*\\d+\\]?.+|\\[?별지.+\\]?.+|\\[?별첨.+\\]?.+|\\[?별표.+\\]?.+)\\s+\\d{1,4}$"
NOISE_TITLES = ("목차", "목 차", "차례", "제안요청서", "Contents", "CONTENTS")
CLAUSE_LEVELS = ((1, "^제\\s*\\d+\\s*조(?:\\s*\\([^)]*\\)|[^\\n]*)?$"), (2, "^[①-⑳]\\s*|^\\(?\\d{1,2}\\)\\s+"), (3, "^\\d{1,2}[.)]\\s+|^[가-힣][.)]\\s+"))
LONGEST = 120


def is_outline(line: Column) -> Column:
    line = strip(line)
    return (F.length(line) <= LONGEST) & line.rlike(OUTLINE)


def is_contents_line(line: Column) -> Column:
    """A line of a table of contents: a heading that ends in a page number."""
    return strip(line).rlike(CONTENTS)


def parsed(line: Column) -> Column:
    """struct(level, marker, title) of a heading line, null for others; the first pattern that matches counts."""
    line = strip(line)
    found = F.lit(None)
    for level, pattern in reversed(LEVELS):
        heading = F.struct(F.lit(level).alias("level"), F.regexp_extract(line, pattern, 1).alias("marker"), clean_title(F.regexp_extract(line, pattern, 2), drop_page=True).alias("title"))
        found = F.when(line.rlike(pattern), heading).otherwise(found)
    found = F.when((line != "") & (F.length(line) <= LONGEST), found)
    return F.when(found["title"] != "", found)


def is_noise(line: Column, title: Column) -> Column:
    return (title == "") | title.isin(*NOISE_TITLES) | (F.length(title) > 100) | is_contents_line(line)


def clause_level(line: Column) -> Column:
    line = strip(line)
    level = F.lit(None).cast("int")
    for n, pattern in reversed(CLAUSE_LEVELS):
        level = F.when(line.rlike(pattern), n).otherwise(level)
    return level


def lines_of(text: Column) -> Column:
    """Lines after CR and CRLF became LF."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\\r\\n?", "\n"), "\n")


def outline_lines(text: Column) -> Column:
    """array<struct(line_idx, title)> of the heading lines of a text."""
    marked = F.transform(lines_of(text), lambda x, i: F.struct(i.alias("line_idx"), strip(x).alias("title")))
    return F.filter(marked, lambda m: is_outline(m.title))


def level_lines(text: Column) -> Column:
    """array<struct(line_idx, level, marker, title)> of the heading lines that are not noise."""
    marked = F.transform(lines_of(text), lambda x, i: F.struct(i.alias("line_idx"), x.alias("raw"), parsed(x).alias("h")))
    kept = F.filter(marked, lambda m: m.h.isNotNull() & ~is_noise(m.raw, m.h.title))
    return F.transform(kept, lambda m: F.struct(m.line_idx.alias("line_idx"), m.h.level.alias("level"), m.h.marker.alias("marker"), m.h.title.alias("title")))
