"""Text cleaning and normalising as column expressions; Unicode normal forms are the only Python here."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: character classes and replacements of the cleaning rules
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"
SYMBOLS_FROM, SYMBOLS_TO = "–—−‐“”‘’ㆍ･・", "----\"\"''···"
NOISE = ("氠瑢", "漠杳")
ZERO_WIDTH = "[\\u200b-\\u200f\\u202a-\\u202e]"
WIDE_SPACES = "[\\u2000-\\u200A\\u202F\\u205F\\u3000]"
ORNAMENTS = "[★■◆▲▼◀▶●♣♠♦♥➔➢➣❑❒❖❘❙❚]"
EVAL_DROPPED = "[,\\-–—−‐‒·ㆍ･・/\\\\:：;；~～|(){}\\[\\]〈〉<>「」『』《》\"'“”‘’`]"
FILE_NAME_SYMBOLS = (("－", "-"), ("–", "-"), ("—", "-"), ("＿", "_"), ("（", "("), ("）", ")"), ("㈜", "(주)"))
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NULL_LIKE = ("", "nan", "none", "null", "na", "n/a")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def nfkc_groups(s: pd.Series) -> pd.Series:
    return s.map(lambda gs: [[None if x is None else unicodedata.normalize("NFKC", x) for x in g] for g in gs], na_action="ignore")


def _sub(c: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, to in pairs:
        c = F.regexp_replace(c, pattern, to)
    return c


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode white space included. Only the ends are looked at."""
    return F.btrim(c, F.lit(WHITE))


def remove_control(c: Column) -> Column:
    return _sub(c, (CONTROL, ""))


def remove_toc_dots(c: Column) -> Column:
    return _sub(c, ("\\.{3,}", " "))


def normalize_whitespace(c: Column) -> Column:
    # fixed values: the patterns of this clean-up
    return strip(_sub(c, ("\\t", " "), (" {2,}", " "), ("[ \\t]*\\n[ \\t]*", "\n"), ("\\n{3,}", "\n\n")))


def normalize_symbols(c: Column) -> Column:
    return F.translate(c, SYMBOLS_FROM, SYMBOLS_TO)


def remove_noise(c: Column) -> Column:
    for x in NOISE:
        c = F.replace(c, F.lit(x), F.lit(" "))
    return c


def clean_text(c: Column, unicode: bool = True) -> Column:
    """Cleaning of extracted text; null gives the empty string. Without unicode, for text known to be in form KC."""
    c = F.coalesce(c, F.lit(""))
    c = nfkc(c) if unicode else c
    return normalize_whitespace(remove_toc_dots(remove_noise(_normalize_characters(c))))


def _normalize_characters(c: Column) -> Column:
    """Symbols and control characters in one pass over the text."""
    control = "".join(chr(i) for i in [*range(32), 127] if chr(i) not in "\t\n\r")
    return F.translate(c, SYMBOLS_FROM + control, SYMBOLS_TO)


def normalize_for_eval(c: Column, unicode: bool = True) -> Column:
    """For keyword comparison: lower case, without white space, commas, dashes, separators, brackets and quotes."""
    c = F.coalesce(c, F.lit(""))
    return _sub(F.lower(nfkc(c) if unicode else c), ("(?U)\\s+", ""), (EVAL_DROPPED, ""))


def normalize_simple(c: Column) -> Column:
    return _sub(F.lower(F.coalesce(c, F.lit(""))), ("[,\\s]+", ""))


def normalize_file_name(c: Column, unicode: bool = True) -> Column:
    c = F.coalesce(c, F.lit(""))
    c = _sub(F.lower(nfc(c) if unicode else c), ("(?U)\\s+", ""))
    for a, b in FILE_NAME_SYMBOLS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalize_for_chunking(c: Column, zero_width: bool = False) -> Column:
    """Line ends to \\n, ideographic blanks and tabs to one blank, at most one empty line; zero_width also drops marks."""
    c = F.translate(_sub(F.coalesce(c, F.lit("")), ("\\r\\n?", "\n")), "　", " ")
    c = _sub(c, (ZERO_WIDTH, "")) if zero_width else c
    return strip(_sub(c, ("[ \\t]+", " "), ("[ \\t]*\\n[ \\t]*", "\n"), ("\\n{3,}", "\n\n")))


def normalize_page(c: Column) -> Column:
    # fixed values: the patterns of this clean-up
    c = F.coalesce(c, F.lit(""))
    c = strip(_sub(c, ("\\r\\n?", "\n"), ("[ \\t]+\\n", "\n"), ("\\n{3,}", "\n\n")))
    return F.when(F.lower(c) == "nan", "").otherwise(c)


def prepare_for_toc(c: Column) -> Column:
    """Keeps Hangul, Latin letters, digits, some punctuation, roman numerals and circled numbers."""
    # fixed values: the patterns of this clean-up
    c = _sub(F.coalesce(c, F.lit("")), (ZERO_WIDTH, ""), ("(?U)[^가-힣a-zA-Z0-9\\s.,?!()\\[\\]%\\-\\u2160-\\u217F①-⑮·]", " "))
    return strip(_sub(c, (" {3,}", " "), ("\\n{3,}", "\n"), ("\\t", " "), (" {2,}", " ")))


def minimal_clean(c: Column) -> Column:
    """Control characters, odd blanks and ornaments go; lines stay and are trimmed."""
    # fixed values: the patterns of this clean-up
    c = _sub(F.coalesce(c, F.lit("")), (CONTROL, ""), ("\\u00a0", " "), (WIDE_SPACES, " "), (ORNAMENTS, " "), (" {2,}", " "))
    lines = F.transform(F.split(c, "\n"), strip)
    return strip(_sub(F.array_join(lines, "\n"), ("\\n{3,}", "\n\n")))


def single_line_clean(c: Column) -> Column:
    """One line of Hangul, Latin letters, digits and a few signs."""
    # fixed values: the patterns of this clean-up
    c = _sub(strip(F.coalesce(c, F.lit(""))), (CONTROL, ""), ("\\u00a0", " "), ("\\n", " "), ("(?U)[^a-zA-Z0-9가-힣ㄱ-ㅎㅏ-ㅣ\\s%\\-,.\\[\\]():;]", " "))
    return strip(_sub(c, ("(?U)\\s+", " ")))


def _html_table_lines(c: Column) -> Column:
    """Tables of <tr> and <td> as lines of cells, with a rule after the first line of each."""
    c = _sub(c, ("</?table>", "\n"), ("<tr>", ""), ("</tr>", "\n"), ("<td>(.*?)</td>", "| $1 "))
    folded = F.aggregate(
        F.split(c, "\n"),
        F.struct(F.lit(False).alias("inside"), F.expr("cast(array() as array<string>)").alias("lines")),
        lambda a, line: F.when(
            F.contains(line, F.lit("|")),
            F.struct(F.lit(True).alias("inside"), F.concat(a.lines, F.array(F.concat(line, F.lit("|"))), F.when(a.inside, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.concat(F.lit("|"), F.repeat(F.lit("---| "), F.regexp_count(line, F.lit("\\|"))))))).alias("lines")),
        ).otherwise(F.struct(F.lit(False).alias("inside"), F.concat(a.lines, F.array(line)).alias("lines"))),
    )
    return F.array_join(folded.lines, "\n")


def guarded_clean(c: Column) -> Column:
    """Page numbers, running titles, ornaments; HTML tables to lines; spacing of clause numbers."""
    # fixed values: the patterns of this clean-up
    c = F.coalesce(c, F.lit(""))
    c = _sub(
        c, ("(?mU)^\\s*-\\s*\\d+\\s*-\\s*$", ""), ("(?imU)^\\s*\\[?\\s*Page\\s*\\d+\\s*\\]?\\s*$", ""), ("(?mU)^\\s*\\d+\\s*/\\s*\\d+\\s*$", ""),
        ("(?mU)(제안요청서|과업지시서|시방서|사업계획서)\\s*$", ""), ("\\u00a0", " "), (CONTROL, ""), (ORNAMENTS, " "),
    )
    c = F.when(F.contains(c, F.lit("<table>")), _html_table_lines(c)).otherwise(c)
    return strip(_sub(c, ("(?U)제\\s*(\\d+)\\s*조", "제$1조"), ("(?U)([①-⑮])\\s+", "$1 "), ("(?U)(\\d+)\\s*\\.", "$1."), (" {2,}", " "), ("\\n{3,}", "\n\n")))


def strip_reasoning(c: Column) -> Column:
    """Without <think> blocks and an English preface before the first list item or Hangul line."""
    # fixed values: the patterns of this clean-up
    c = strip(_sub(F.coalesce(c, F.lit("")), ("(?is)<think>.*?</think>", ""), ("(?i)</?think>", "")))
    until = "(?=\\n\\s*(?:[-•○●]|\\d+[.)]|[가-힣]))"
    for opening in ("Okay,", "Let'?s", "I need to", "The user is asking", "We need to"):
        c = strip(_sub(c, (f"(?is)^{opening}.*?{until}", "")))
    return c


def words(c: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "(?U)\\s+"), lambda x: x != "")


def search_terms(c: Column) -> Column:
    """Lower-case runs of Hangul, Latin letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[가-힣A-Za-z0-9]+"), F.lit(0))


def is_null_like(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*NULL_LIKE)


def blank_to_null(c: Column) -> Column:
    """Null where the trimmed value is empty or "nan"."""
    t = F.trim(c.cast("string"))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def first_valid(*columns: Column) -> Column:
    return F.coalesce(*(blank_to_null(c) for c in columns))


def stable_hash(c: Column, length: int = 16) -> Column:
    return F.substring(F.md5(F.coalesce(c, F.lit(""))), 1, length)


def content_hash(c: Column) -> Column:
    """md5 of the text without white space."""
    return F.md5(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", ""))


def safe_name(c: Column, longest: int = 120) -> Column:
    """A file-name slug: other characters become one underscore."""
    c = _sub(F.coalesce(c.cast("string"), F.lit("")), ("[^0-9A-Za-z가-힣._-]+", "_"), ("^[_]+|[_]+$", ""))
    return F.substring(c, 1, longest)


def clean_title(c: Column, drop_page: bool = False) -> Column:
    """A heading without leader dots; drop_page also removes a trailing number of up to four digits."""
    c = _sub(strip(F.coalesce(c, F.lit(""))), ("\\.{3,}", " "))
    c = strip(_sub(c, ("[\\s.\\-·…]*\\d{1,4}\\s*$", ""))) if drop_page else c
    return strip(_sub(c, ("(?U)\\s+", " ")))


def section_id(doc_id: Column, path: Column, number: Column) -> Column:
    """doc_sec_0001_slug, the slug from the last three titles, 80 characters at most."""
    slug = _sub(F.array_join(F.slice(path, F.greatest(F.size(path) - 2, F.lit(1)), F.lit(3)), "_"), ("(?U)\\s+", "_"), ("[^0-9A-Za-z가-힣_]+", ""))
    slug = F.substring(F.when(F.size(path) > 0, slug).otherwise("unknown"), 1, 80)
    return F.concat(doc_id.cast("string"), F.lit("_sec_"), F.format_string("%04d", number.cast("int")), F.lit("_"), F.when(slug == "", "section").otherwise(slug))


def page_label(start: Column, end: Column) -> Column:
    a, b = start.cast("string"), end.cast("string")
    return F.when(F.coalesce(a, F.lit("")) == "", "").when((F.coalesce(b, F.lit("")) == "") | (a == b), a).otherwise(F.concat(a, F.lit("-"), b))


def is_table_text(c: Column) -> Column:
    return F.contains(c, F.lit("<table>")) | (F.contains(c, F.lit("|")) & F.contains(c, F.lit("---")))


def is_table_line(c: Column) -> Column:
    return strip(c).startswith("|") & strip(c).endswith("|")


def is_broken_table(c: Column) -> Column:
    """Lines with bars do not all have the same number of them."""
    barred = F.filter(F.split(c, "\n"), lambda x: F.contains(x, F.lit("|")))
    return F.size(F.array_distinct(F.transform(barred, lambda x: F.regexp_count(x, F.lit("\\|"))))) > 1


def cell_to_markdown(c: Column) -> Column:
    return F.replace(F.replace(clean_text(c, unicode=False), F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))


def rows_to_markdown(rows: Column) -> Column:
    """array<array<string>> as a table: blank rows dropped, short ones padded, a rule after the first."""
    kept = F.filter(rows, lambda r: F.exists(r, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))
    wide = F.array_max(F.transform(kept, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    lines = F.transform(kept, lambda r: line(F.concat(F.transform(r, cell_to_markdown), F.array_repeat(F.lit(""), wide - F.size(r)))))
    rule = line(F.array_repeat(F.lit("---"), wide))
    joined = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
    return F.when(F.size(kept) > 0, joined).otherwise("")


# fixed values: Chinese characters of Korean documents and their Hangul spellings
HANJA = {
    "別紙": "별지", "別添": "별첨", "以上": "이상", "以下": "이하", "未滿": "미만", "第": "제", "條": "조", "項": "항", "號": "호", "章": "장", "節": "절", "內": "내", "外": "외", "年": "년", "月": "월", "日": "일",
    "千": "천", "萬": "만", "億": "억", "一": "일", "二": "이", "三": "삼", "四": "사", "五": "오", "六": "육", "七": "칠", "八": "팔", "九": "구", "十": "십", "百": "백",
}
# fixed values: short names of models
MODEL_NAMES = {"text-embedding-3-small": "emb3s", "text-embedding-3-large": "emb3l", "gpt-5-mini": "gpt5mini", "gpt-5-nano": "gpt5nano", "gpt-4o-mini": "gpt4omini", "gpt-4o": "gpt4o"}


def spell_hanja(c: Column) -> Column:
    """Longer words first, then single characters in one pass."""
    for a in sorted((k for k in HANJA if len(k) > 1), key=len, reverse=True):
        c = F.replace(c, F.lit(a), F.lit(HANJA[a]))
    single = [k for k in HANJA if len(k) == 1]
    return F.translate(c, "".join(single), "".join(HANJA[k] for k in single))


def short_model_name(c: Column, longest: int = 24) -> Column:
    """A known alias, else the last part of the name without its instruct suffix, as a slug."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    alias = F.coalesce(*(F.when(F.lower(raw) == k, v) for k, v in MODEL_NAMES.items()))
    last = _sub(F.regexp_extract(F.translate(raw, "\\", "/"), "[^/]*$", 0), ("[-_](?:Instruct|instruction)", ""))
    return F.when(raw == "", "unknown").otherwise(F.coalesce(alias, safe_name(last, longest)))
