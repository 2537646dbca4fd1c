"""SQL (DuckDB) for the chunkers whose next cut depends on the last one: folds over lists of lines or paragraphs.

Each function takes SQL of a relation with the columns key and text and gives SQL of (key, pieces list).
"""

from __future__ import annotations

from docengine.operators.chunking import CLAUSES
from docengine.operators.headings import CONTENTS, LEVELS, LONGEST, NOISE_TITLES

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _each(x: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def tidy(text: str, blanks: bool) -> str:
    """Line ends made one, blanks before them gone, at most one empty line; with blanks also runs of blanks to one."""
    plain = f"replace({_each(text, ('\\r\\n?', '\n'))}, '　', ' ')"
    about = ((r"[ \t]+", " "), (r"[ \t]*\n[ \t]*", "\n")) if blanks else ((r"[ \t]+\n", "\n"),)
    return STRIP.format(_each(plain, *about, (r"\n{3,}", "\n\n")))


def _filled(pieces: str) -> str:
    """The pieces without white space around them, empty ones left out."""
    return f"list_filter(list_transform({pieces}, lambda w: {STRIP.format('w')}), lambda w: w <> '')"


def _strides(x: str, longest: int, overlap: int, to_end: bool) -> str:
    """Pieces of a long line or paragraph; with to_end also those that are overlap alone."""
    step = longest - overlap
    n = f"ceil(length({x}) / {step}.0)" if to_end else f"greatest(1, ceil((length({x}) - {longest}) / {step}.0) + 1)"
    return _filled(f"list_transform(range(CAST({n} AS BIGINT)), lambda p: substr({x}, p * {step} + 1, {longest}))")


def _fold(rows: str, parts: str, step: str, glue: str) -> str:
    """(key, text, pieces) by a fold of step(s, x) over the parts of each text; s and x are structs (part, done, held, size)."""
    empty = "{'part': '', 'done': CAST([] AS VARCHAR[]), 'held': CAST([] AS VARCHAR[]), 'size': CAST(0 AS BIGINT)}"
    state = f"list_reduce(list_prepend({empty}, list_transform({parts}, lambda w: {{'part': w, 'done': CAST([] AS VARCHAR[]), 'held': CAST([] AS VARCHAR[]), 'size': CAST(0 AS BIGINT)}})), lambda s, x: {step})"
    return f"SELECT key, text, list_concat(s.done, CASE WHEN len(s.held) > 0 THEN [{glue.format('s.held')}] ELSE [] END) AS pieces FROM (SELECT key, text, {state} AS s FROM ({rows}))"


def packed_lines(rows: str, longest: int, overlap: int) -> str:
    """Lines joined up to longest characters; a chunk begins with the last lines of the one before that fit overlap."""
    glue = "array_to_string({}, chr(10))"
    own = "length(x.part) + 1"
    tail = f"s.held[len(s.held) - len(list_filter(range(1, len(s.held) + 1), lambda k: list_sum(list_transform(s.held[len(s.held) - k + 1:], lambda y: length(y) + 1)) <= {overlap})) + 1:]"
    closed = f"list_append(s.done, {glue.format('s.held')})"
    long = f"{{'part': '', 'done': list_concat(CASE WHEN len(s.held) > 0 THEN {closed} ELSE s.done END, {_strides('x.part', longest, overlap, False)}), 'held': CAST([] AS VARCHAR[]), 'size': CAST(0 AS BIGINT)}}"
    full = f"{{'part': '', 'done': {closed}, 'held': list_append({tail}, x.part), 'size': CAST(coalesce(list_sum(list_transform({tail}, lambda y: length(y) + 1)), 0) + {own} AS BIGINT)}}"
    more = f"{{'part': '', 'done': s.done, 'held': list_append(s.held, x.part), 'size': s.size + {own}}}"
    step = f"CASE WHEN {own} > {longest} THEN {long} WHEN len(s.held) > 0 AND s.size + {own} > {longest} THEN {full} ELSE {more} END"
    tidied = f"SELECT key, {tidy('text', True)} AS text FROM ({rows})"
    folded = _fold(f"SELECT * FROM ({tidied}) WHERE length(text) > {longest}", _filled("string_split(text, chr(10))"), step, glue)
    return f"SELECT key, pieces FROM ({folded}) UNION ALL SELECT key, [text] FROM ({tidied}) WHERE length(text) <= {longest}"


def packed_paragraphs(rows: str, longest: int, overlap: int) -> str:
    """Paragraphs joined by an empty line; a chunk begins with the end of the one before."""
    glue = STRIP.format("array_to_string({}, chr(10) || chr(10))")
    closed = f"list_append(s.done, {glue.format('s.held')})"
    tail = STRIP.format(f"right({glue.format('s.held')}, {overlap})")
    long = f"{{'part': '', 'done': list_concat(CASE WHEN len(s.held) > 0 THEN {closed} ELSE s.done END, {_strides('x.part', longest, overlap, True)}), 'held': CAST([] AS VARCHAR[]), 'size': CAST(0 AS BIGINT)}}"
    full = f"{{'part': '', 'done': {closed}, 'held': CASE WHEN {tail} <> '' THEN [{tail}, x.part] ELSE [x.part] END, 'size': CAST(length({tail}) + length(x.part) + 2 AS BIGINT)}}"
    more = "{'part': '', 'done': s.done, 'held': list_append(s.held, x.part), 'size': s.size + length(x.part) + 2}"
    step = f"CASE WHEN length(x.part) > {longest} THEN {long} WHEN len(s.held) > 0 AND s.size + length(x.part) + 2 > {longest} THEN {full} ELSE {more} END"
    tidied = f"SELECT key, {tidy('text', False)} AS text FROM ({rows})"
    paragraphs = _filled(r"regexp_split_to_array(text, '\n\s*\n')")
    parts = f"CASE WHEN len({paragraphs}) > 1 THEN {paragraphs} ELSE {_filled('string_split(text, chr(10))')} END"
    folded = _fold(f"SELECT * FROM ({tidied}) WHERE length(text) > {longest}", parts, step, glue)
    return f"SELECT key, pieces FROM ({folded}) UNION ALL SELECT key, [text] FROM ({tidied}) WHERE length(text) BETWEEN 1 AND {longest}"


def numbered(pieces: str) -> str:
    """doc_id, chunk_idx, text of each piece."""
    return f"SELECT key AS doc_id, CAST(unnest(range(len(pieces))) AS INT) AS chunk_idx, unnest(pieces) AS text FROM ({pieces})"


def merged_pages(rows: str, shortest: int, longest: int) -> str:
    """(key, nth, first, last, text): units of the pages (key, page, text); a short unit takes the next page where both fit."""
    unit = "{'a': page, 'b': page, 't': text}"
    last = "s[len(s)]"
    joined = f"{{'a': {last}.a, 'b': x[1].b, 't': {last}.t || chr(10) || chr(10) || x[1].t}}"
    step = f"CASE WHEN length({last}.t) < {shortest} AND length({last}.t) + length(x[1].t) + 2 <= {longest} THEN list_append(s[:len(s) - 1], {joined}) ELSE list_append(s, x[1]) END"
    tidied = f"SELECT key, page, {tidy('text', False)} AS text, text AS raw FROM ({rows})"
    units = f"SELECT key, list_reduce(list([{unit}] ORDER BY page, raw), lambda s, x: {step}) AS units FROM ({tidied}) WHERE text <> '' GROUP BY key"
    return f"SELECT key, nth, u.a AS first, u.b AS last, u.t AS text FROM (SELECT key, unnest(range(len(units))) AS nth, unnest(units) AS u FROM ({units}))"


def page_chunks(rows: str, longest: int, overlap: int, shortest: int) -> str:
    """doc_id, chunk_idx, page_start, page_end, text."""
    units = f"SELECT {{'k': key, 'n': nth, 'a': first, 'b': last}} AS key, text FROM ({merged_pages(rows, shortest, longest)})"
    pieces = f"SELECT key, unnest(pieces) AS text, unnest(range(len(pieces))) AS i FROM ({packed_paragraphs(units, longest, overlap)})"
    return f"SELECT key.k AS doc_id, CAST(row_number() OVER (PARTITION BY key.k ORDER BY key.n, i) - 1 AS INT) AS chunk_idx, CAST(key.a AS INT) AS page_start, CAST(key.b AS INT) AS page_end, text FROM ({pieces})"


def clause_rows(rows: str) -> str:
    """doc_id, clause_idx, article, text: lines from an article's line to the next; those before the first are article 0."""
    lines = f"SELECT key, i, line FROM (SELECT key, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT key, {_filled('string_split(text, chr(10))')} AS l FROM ({rows})))"
    article = r"regexp_matches(line, '^제\s*\d+\s*조\s*\(.*?\)')"
    marked = f"SELECT *, sum(CASE WHEN {article} OR i = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS c, CASE WHEN {article} THEN line ELSE '제0조(미분류 기본문맥)' END AS a FROM ({lines})"
    return f"SELECT key AS doc_id, CAST(c - 1 AS INT) AS clause_idx, min_by(a, i) AS article, string_agg(line, chr(10) ORDER BY i) AS text FROM ({marked}) GROUP BY key, c"


def common_subsequence(a: str, b: str) -> str:
    """Length of the longest common subsequence of two lists, row by row of the table of prefixes."""
    row = "list_transform(range(1, len(s) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k = 1 THEN s[1] ELSE greatest(s[k], s[k - 1] + x[k]) END)))"
    matches = f"list_transform({a}, lambda u: list_prepend(0, list_transform({b}, lambda v: CASE WHEN u = v THEN 1 ELSE 0 END)))"
    start = f"list_prepend(list_transform(range(len({b}) + 1), lambda z: 0), {matches})"
    return f"list_reduce({start}, lambda s, x: {row})[len({b}) + 1]"


def level_lines(rows: str) -> str:
    """(key, i, level, title) of the heading lines that are not noise; rows has (key, lines)."""
    line = STRIP.format("raw")
    level = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN {n}" for n, p in LEVELS) + " END"
    rest = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN regexp_extract(line, '{p}', 2)" for _, p in LEVELS) + " END"
    title = STRIP.format(_each(STRIP.format(_each(_each(STRIP.format("rest"), (r"\.{3,}", " ")), (r"[\s.\-·…]*\d{1,4}\s*$", ""))), (r"\s+", " ")))
    lines = f"SELECT key, i, {line} AS line FROM (SELECT key, unnest(lines) AS raw, unnest(range(len(lines))) AS i FROM ({rows}))"
    found = f"SELECT key, i, line, level, {title} AS title FROM (SELECT *, {level} AS level, {rest} AS rest FROM ({lines}) WHERE line <> '' AND length(line) <= {LONGEST}) WHERE level IS NOT NULL"
    noise = ", ".join(f"'{t}'" for t in NOISE_TITLES)
    return f"SELECT key, i, level, title FROM ({found}) WHERE title <> '' AND title NOT IN ({noise}) AND length(title) <= 100 AND NOT regexp_matches(line, '{CONTENTS}')"


def outline_chunks(docs: str, longest: int, overlap: int, shortest: int, target: int = 2) -> str:
    """doc_id, section_idx, split_idx, title, level, path, start_line, end_line, text; docs has (key, text).

    Lines of `longest` characters or more are cut in strides, not at sentence ends.
    """
    split = f"SELECT key, text, string_split({_each('text', ('\\r\\n?', '\n'))}, chr(10)) AS lines FROM ({docs}) WHERE length(text) > 0"
    return f"""WITH split AS ({split}), heads AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS n FROM ({level_lines("SELECT * FROM split")})),
  wanted AS (SELECT h.key, h.n, h.i, h.level, h.title, coalesce((SELECT min(o.i) FROM heads o WHERE o.key = h.key AND o.n > h.n AND o.level <= h.level), len(s.lines)) AS ends, s.lines,
    array_to_string((SELECT list(a.title ORDER BY a.n) FROM heads a WHERE a.key = h.key AND a.n <= h.n AND NOT EXISTS (SELECT 1 FROM heads b WHERE b.key = h.key AND b.n > a.n AND b.n <= h.n AND b.level <= a.level)), ' > ') AS path
    FROM heads h JOIN split s ON s.key = h.key WHERE h.level <= {target}),
  sections AS (SELECT {{'k': key, 'n': n}} AS key, {STRIP.format("array_to_string(lines[i + 1:ends], chr(10))")} AS text FROM wanted),
  parts AS (SELECT key.k AS key, key.n AS n, unnest(range(len(pieces))) AS part, unnest(pieces) AS text FROM ({packed_lines(f"SELECT * FROM sections WHERE length(text) >= {shortest}", longest, overlap)})),
  kept AS (SELECT p.key, p.n, p.part, {STRIP.format("p.text")} AS text, w.title, w.level, w.path, w.i, w.ends FROM parts p JOIN wanted w ON w.key = p.key AND w.n = p.n WHERE length({STRIP.format("p.text")}) >= {shortest}),
  deepest AS (SELECT key, max(level) AS level FROM kept GROUP BY key),
  rest AS (SELECT key, text, len(lines) AS ends FROM split WHERE key NOT IN (SELECT key FROM deepest)),
  whole AS (SELECT key, unnest(range(len(pieces))) AS part, unnest(pieces) AS text FROM ({packed_lines("SELECT key, text FROM rest", longest, overlap)}))
  SELECT k.key AS doc_id, CAST(n AS INT) AS section_idx, CAST(part AS INT) AS split_idx, title, CAST(k.level AS INT) AS level, path, CAST(i AS INT) AS start_line, CAST(ends AS INT) AS end_line, text FROM kept k JOIN deepest d ON d.key = k.key AND d.level = k.level
  UNION ALL SELECT w.key, -1, CAST(part AS INT), '', 0, '', 0, CAST(ends AS INT), w.text FROM whole w JOIN rest r ON r.key = w.key WHERE length(w.text) >= {shortest}"""


#: Lines that begin a section of a table of contents: roman numerals or chapters, else numbers.
_CHAPTER = r"(?m)^\s*(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|\b[IVXLCDM]+\b|제\s*\d+\s*장)"
_BY_CHAPTER = r"(?m)(^\s*(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+\.?|\b[IVXLCDM]+\b\.?|제\s*\d+\s*장)\s+[^\n]{1,60}$)"
_BY_NUMBER = r"(?m)(^\s*\d+\.?\s+[^\n]{2,60}$)"


def contents_chunks(docs: str, longest: int, overlap: int, shortest: int = 100) -> str:
    """doc_id, chunk_idx, text: sections of the contents lines, the whole text without them, cut at sentence ends by a recursion."""
    cut = f"CASE WHEN regexp_matches(text, '{_CHAPTER}') THEN regexp_replace(text, '{_BY_CHAPTER}', chr(1) || '\\1', 'g') ELSE regexp_replace(text, '{_BY_NUMBER}', chr(1) || '\\1', 'g') END"
    found = f"list_filter(list_transform(string_split({cut}, chr(1))[2:], lambda w: {STRIP.format('w')}), lambda w: length(w) > 100)"
    last = "greatest(" + ", ".join(f"CASE WHEN contains(p, {c}) THEN length(p) - strpos(reverse(p), {c}) ELSE -1 END" for c in ("chr(10)", "'.'", "'함'")) + ")"
    kept = f"CASE WHEN place + {longest} < length(t) AND {last} > {int(longest * 0.6)} THEN place + {last} + 1 ELSE place + {longest} END"
    piece = f"SELECT key, nth, i, t, place, {kept} AS ends FROM (SELECT *, {STRIP.format(f'substr(t, place + 1, {longest})')} AS p FROM {{}})"
    return f"""WITH RECURSIVE sections AS (SELECT key, unnest(range(len(s))) AS nth, unnest(s) AS t FROM (SELECT key, CASE WHEN len(string_split({cut}, chr(1))) > 2 AND len({found}) > 0 THEN {found} ELSE [{STRIP.format('text')}] END AS s FROM ({docs}) WHERE text IS NOT NULL)),
  cuts AS ({piece.format("(SELECT key, nth, 0 AS i, t, 0 AS place FROM sections)")}
    UNION ALL {piece.format(f"(SELECT key, nth, i + 1 AS i, t, CASE WHEN ends - {overlap} > place THEN ends - {overlap} ELSE ends END AS place FROM cuts WHERE ends < length(t))")}),
  pieces AS (SELECT key, nth, i, CASE WHEN length(t) > {longest} THEN {STRIP.format("substr(t, place + 1, ends - place)")} ELSE t END AS text FROM cuts)
  SELECT key AS doc_id, CAST(row_number() OVER (PARTITION BY key ORDER BY nth, i) - 1 AS INT) AS chunk_idx, text FROM pieces WHERE length({STRIP.format("text")}) >= {shortest}"""


def recursive_split(x: str, longest: int, overlap: int, separators: tuple[str, ...] = ("chr(10) || chr(10)", "chr(10)", "' '", "''"), depth: int = 0) -> str:
    """List of pieces of x: parts at the first separator that it has, joined up to longest; longer parts by the next separators.

    A fold over the parts, in whose step the fold of the next separator stands; its variables are named by depth.
    """
    folds = [_recursive_fold(x, longest, overlap, separator, separators[i + 1 :], depth) for i, separator in enumerate(separators)]
    cases = " ".join(f"WHEN contains({x}, {separator}) THEN {fold}" for separator, fold in zip(separators[:-1], folds, strict=False))
    return f"CASE {cases} ELSE {folds[-1]} END" if cases else folds[-1]


def _recursive_fold(x: str, longest: int, overlap: int, separator: str, rest: tuple[str, ...], depth: int) -> str:
    s, p, k, w = (f"{v}{depth}" for v in "spkw")
    joined = lambda held: f"array_to_string({held}, {separator})"
    closed = f"list_filter([{STRIP.format(joined(s + '.held'))}], lambda {w}: {w} <> '')"
    fits = f"{k} = len({s}.held) OR (length({joined(f'{s}.held[{k} + 1:]')}) <= {overlap} AND length({joined(f'list_append({s}.held[{k} + 1:], {p}.part)')}) <= {longest})"
    popped = f"{s}.held[list_filter(range(0, len({s}.held) + 1), lambda {k}: {fits})[1] + 1:]"
    state = lambda part, done, held: f"{{'part': {part}, 'done': {done}, 'held': {held}}}"
    none = "CAST([] AS VARCHAR[])"
    long = f"WHEN length({p}.part) > {longest} THEN {state(repr(''), f'list_concat({s}.done, {closed}, {recursive_split(f'{p}.part', longest, overlap, rest, depth + 1)})', none)} " if rest else ""
    full = f"WHEN len({s}.held) > 0 AND length({joined(f'list_append({s}.held, {p}.part)')}) > {longest} THEN {state(repr(''), f'list_concat({s}.done, {closed})', f'list_append({popped}, {p}.part)')}"
    more = f"ELSE {state(repr(''), f'{s}.done', f'list_append({s}.held, {p}.part)')}"
    parts = f"list_transform(list_filter(string_split({x}, {separator}), lambda {w}: {w} <> ''), lambda {w}: {state(w, none, none)})"
    end = f"list_reduce(list_prepend({state(repr(''), none, none)}, {parts}), lambda {s}, {p}: CASE {long}{full} {more} END)"
    tail = f"list_filter([{STRIP.format(joined(end + '.held'))}], lambda {w}: {w} <> '')"
    return f"list_concat({end}.done, {tail})"


def html_text(html: str) -> str:
    """Text of a page without tables and with one script at most: line ends at blocks, other tags and comments gone."""
    script = f"regexp_extract({html}, '(?s)<script[^>]*>(.*?)</script>', 1)"
    plain = _each(f"regexp_replace({html}, '(?s)<script[^>]*>.*?</script>', chr(1))", ("(?s)<!--.*?-->", ""), (r"<br\s*/?>|</?(?:p|div|li|h1|h2|h3)(?:\s[^>]*)?>", "\n"), (r"</?[a-zA-Z][^>]*>|<![^>]*>", ""))
    for name, sign in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        plain = f"replace({plain}, '&{name};', '{sign}')"
    whole = f"replace(replace({plain}, chr(1), {script}), chr(9), ' ')"
    lines = f"list_transform(string_split({whole}, chr(10)), lambda w: {STRIP.format(_each('w', (' {2,}', ' ')))})"
    return STRIP.format(_each(f"array_to_string({lines}, chr(10))", (r"\n{3,}", "\n\n")))


def markdown_chunks(docs: str, longest: int = 1500, overlap: int = 150, shortest: int = 30, parent_from: int = 2000, child: int = 300, context: int = 1800) -> str:
    """doc_id, section_idx, split_idx, title, level, path, page_start, page_end, child_text, text, is_child, cut of texts without tables."""
    level = "CASE WHEN starts_with(line, '#') OR (starts_with(line, '|') AND ends_with(line, '|')) THEN 0 " + " ".join(f"WHEN regexp_matches(line, '^(?:{p.pattern})') THEN {n}" for n, p in CLAUSES) + " ELSE 0 END"
    marked = "CASE WHEN level > 0 THEN repeat('#', level) || ' ' || line ELSE line END"
    around = "strpos(s.text, substr(p.text, 1, 80)) - 1"
    ends = f"least(length(s.text), greatest(0, {around} - {context // 2}) + {context})"
    cut = f"CASE WHEN {around} < 0 THEN {STRIP.format(f'substr(s.text, 1, {context})')} ELSE (CASE WHEN {ends} > {context} THEN '... ' ELSE '' END) || {STRIP.format(f'substr(s.text, greatest(0, {ends} - {context}) + 1, {ends} - greatest(0, {ends} - {context}))')} || (CASE WHEN {ends} < length(s.text) THEN ' ...' ELSE '' END) END"
    pieces = lambda where, size: packed_paragraphs(f"SELECT {{'k': key, 'n': n}} AS key, text FROM kept WHERE length(text) {where} {parent_from}", size, overlap)
    return f"""WITH lines AS (SELECT key, i, {STRIP.format("raw")} AS line FROM (SELECT key, unnest(range(len(l))) AS i, unnest(l) AS raw FROM (SELECT key, string_split({tidy("text", False)}, chr(10)) AS l FROM ({docs}) WHERE text <> ''))),
  marked AS (SELECT key, i, {marked} AS line FROM (SELECT *, {level} AS level FROM lines)),
  headed AS (SELECT *, CASE WHEN h THEN length(regexp_extract(line, '^(#+)', 1)) END AS level, CASE WHEN h THEN regexp_extract(line, '^#{{1,6}}\\s+(.+?)\\s*$', 1) END AS title FROM (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+.+$') AS h FROM marked)),
  placed AS (SELECT *, count(level) OVER (PARTITION BY key ORDER BY i) AS sec FROM headed),
  heads AS (SELECT key, sec, level, title FROM placed WHERE level IS NOT NULL),
  bodies AS (SELECT key, sec, {tidy("string_agg(line, chr(10) ORDER BY i)", False)} AS text FROM placed GROUP BY key, sec),
  kept AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sec) - 1 AS n FROM bodies WHERE text <> ''),
  titled AS (SELECT k.*, coalesce(h.title, '문서 시작') AS title, coalesce(h.level, 0) AS level,
    coalesce(array_to_string((SELECT list(a.title ORDER BY a.sec) FROM heads a WHERE a.key = k.key AND a.sec <= k.sec AND NOT EXISTS (SELECT 1 FROM heads b WHERE b.key = k.key AND b.sec > a.sec AND b.sec <= k.sec AND b.level <= a.level)), ' > '), '문서 시작') AS path
    FROM kept k LEFT JOIN heads h ON h.key = k.key AND h.sec = k.sec WHERE length(k.text) >= {shortest}),
  parts AS (SELECT key, unnest(range(len(pieces))) AS i, unnest(pieces) AS text FROM ({pieces('<=', longest)} UNION ALL {pieces('>', child)}))
  SELECT s.key AS doc_id, CAST(s.n AS INT) AS section_idx, CAST(p.i AS INT) AS split_idx, title, CAST(level AS INT) AS level, path, CAST(1 AS INT) AS page_start, CAST(1 AS INT) AS page_end, p.text AS child_text,
    CASE WHEN length(s.text) > {parent_from} THEN {cut} ELSE p.text END AS text, length(s.text) > {parent_from} AS is_child, length(s.text) > {parent_from} AS cut
  FROM titled s JOIN parts p ON p.key.k = s.key AND p.key.n = s.n WHERE length(p.text) >= {shortest}"""
