"""Secret scan: fixed patterns, and the guess cost of values that stand where a credential is named.

The guess cost of a value is the least sum, over all ways of cutting it into spans, of the spans' costs
in log10 guesses. A span is a word, a date, a repeat of a shorter span, a walk over neighbouring keys or
a run of consecutive characters, or brute force. Values that cost STRONG or more are secrets.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import slices, small_batches, text_of

# fixed values: the base patterns of the scan's contract
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

#: A credential is named, then a separator, then a value: what the guess cost is applied to.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code|key)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|login)"""
    r"""["']?(?:[ \t]*(?::=|=>|[:=])[ \t]*|[ \t]+is[ \t]+|(?<=earer)[ \t]+)(?:(?:bearer|basic)[ \t]+)?(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"'<>,;]{6,}))""",
    re.I | re.A,
)
#: Cheap tests that every text with a match passes.
MAY_NAME = "(?i)pass|pwd|secret|token|credential|auth|bearer|key|login"
MAY_HEX = "[0-9a-f]{24}"
#: log10 guesses from which a value counts as a secret.
STRONG = 8.0
#: A run of letters that could be a word, but is not listed, costs as much as one of so many words.
UNLISTED = 5.0
#: No span but a whole repeated value has more characters.
WIDEST = 40
#: What it adds to a guess to find where a span within a value begins.
JOINT = 0.3
KINDS = ("assign", "access", "hex", "guess")

# fixed values: common words of passwords, most common first
WORDS = (
    "password qwerty admin welcome letmein monkey dragon master login abc hello secret test user root guest default changeme "
    "love sunshine princess football baseball shadow superman batman iloveyou trustno hunter summer winter spring autumn monday "
    "friday pass access token key server system company the and for you your please example sample demo string none null true "
    "false value enter here insert placeholder redacted hidden unknown undefined required optional public private"
).split()
# fixed values: rows of a keyboard
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("4301$@57!", "aeoisasti")
VOWELS = frozenset("aeiouyàáâãäåæèéêëìíîïðñòóôõöøùúûüýÿ")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")


def _neighbours() -> dict[str, frozenset[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            for dy in (-1, 0, 1):
                if 0 <= y + dy < len(ROWS):
                    near.setdefault(key, set()).update(ROWS[y + dy][max(0, x - 1) : x + 2])
    return {k: frozenset(v - {k}) for k, v in near.items()}


NEAR = _neighbours()
KEY_AT = {key: (x, y) for y, row in enumerate(ROWS) for x, key in enumerate(row)}


@lru_cache(maxsize=4)
def ranks(vocabulary: str | None = None) -> dict[str, int]:
    """Words and their ranks: WORDS, then the whole words of a tokenizer file, in its order, which is by frequency."""
    words = dict.fromkeys(WORDS)
    if vocabulary:
        entries = json.loads(Path(vocabulary).read_text(encoding="utf-8"))["model"]["vocab"]
        words |= dict.fromkeys(w.removesuffix("</w>") for w in sorted(entries, key=entries.get) if w.endswith("</w>") and len(w) > 6 and w[:-4].isascii() and w[:-4].isalpha())
    return {w: i + 1 for i, w in enumerate(words)}


def _words(value: str, rank: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """Spans that are words: listed ones, also with digits and signs for letters, and runs of letters that could be words."""
    low = "".join(c if len(c.lower()) > 1 else c.lower() for c in value)
    plain = low.translate(LEET)
    upper = list(accumulate((a != b for a, b in zip(value, low, strict=True)), initial=0))
    for start in range(len(value)):
        letters, vowel, hard = True, False, 0
        for end in range(start + 1, min(len(value), start + WIDEST) + 1):
            c = low[end - 1]
            letters = letters and c.isalpha()
            vowel = vowel or c in VOWELS
            hard = 0 if c in VOWELS else hard + 1
            letters = letters and hard < 6
            n, size = upper[end] - upper[start], end - start
            case = 0.0 if not n else 0.3 if n == size or (n == 1 and value[start] != low[start]) else 1.0
            cost = math.inf
            if (word := low[start:end]) in rank:
                cost = math.log10(rank[word] + 1) + case
            elif (word := plain[start:end]) in rank:
                cost = math.log10(rank[word] + 1) + case + 0.5
            if letters and vowel and size >= 3 and case < 1:
                cost = min(cost, UNLISTED + case)
            if cost < math.inf:
                yield start, end, cost


def _walks(value: str) -> Iterator[tuple[int, int, float]]:
    """Spans of consecutive characters, and walks over neighbouring keys, which cost more with each turn."""
    low = value.lower() if value.isascii() else "".join(c.lower() if c.isascii() else c for c in value)
    for start in range(len(value) - 1):
        step = ord(low[start + 1]) - ord(low[start])
        runs, turns, last = step in (-1, 1), 0, None
        walks = True
        for at in range(start + 1, min(len(value), start + WIDEST)):
            runs = runs and ord(low[at]) - ord(low[at - 1]) == step
            walks = walks and low[at] in NEAR.get(low[at - 1], ())
            if walks:
                move = tuple(b - a for a, b in zip(KEY_AT[low[at - 1]], KEY_AT[low[at]], strict=True))
                turns, last = turns + (last not in (None, move)), move
            if not runs and not walks:
                break
            size = at - start + 1
            if size >= 3:
                yield start, at + 1, math.log10(size) + min(1.5 if runs else math.inf, 1.6 + 0.65 * turns if walks else math.inf)


def _repeats(value: str, vocabulary: str | None) -> Iterator[tuple[int, int, float]]:
    """Spans of a shorter part two times or more: the part's cost and the number of times."""
    for size in range(1, min(WIDEST, len(value)) // 2 + 1):
        same = 0  # characters from here on that equal the one `size` places later
        for start in range(len(value) - size - 1, -1, -1):
            same = same + 1 if value[start] == value[start + size] else 0
            times = min(same // size + 1, WIDEST // size)
            if times > 1:
                cost = guess_cost(value[start : start + size], vocabulary)
                for n in range(2, times + 1):
                    yield start, start + n * size, cost + math.log10(n)


def _dates(value: str) -> Iterator[tuple[int, int, float]]:
    for start in range(len(value)):
        if value[start] in "0123":
            for size, cost in ((4, 2.1), (8, 4.0), (10, 4.0)):
                if start + size <= len(value) and DATE.fullmatch(value, start, start + size):
                    yield start, start + size, cost


def _brute(value: str) -> float:
    """Brute force guesses over the kinds of characters that the value has."""
    hexlike = all(c in "0123456789abcdef" for c in value)
    size = 0
    for test, n in ((str.isdigit, 10), (str.islower, 6 if hexlike else 26), (str.isupper, 26)):
        size += n if any(map(test, value)) else 0
    size += 33 if any(not c.isalnum() for c in value) else 0
    return len(value) * math.log10(max(size, 10))


def pattern_spans(value: str, vocabulary: str | None = None) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of every span of WIDEST characters or less that is a word, a walk, a repeat or a date."""
    return chain(_words(value, ranks(vocabulary)), _walks(value), _repeats(value, vocabulary), _dates(value))


@lru_cache(maxsize=8192)
def guess_cost(value: str, vocabulary: str | None = None) -> float:
    """Least log10 guesses over all cuts of the whole value into spans of at most WIDEST characters.

    Brute force is counted character by character, so a longer span of it is covered too. A longer value that
    repeats one part throughout costs that part and the count. Time grows with the value's length.
    """
    if len(value) > WIDEST and (period := (value + value).find(value, 1)) < len(value):
        return guess_cost(value[:period], vocabulary) + math.log10(len(value) // period)
    each = _brute(value) / max(len(value), 1)  # over the characters of the whole value
    by_end: dict[int, dict[int, float]] = {}
    for start, end, cost in pattern_spans(value, vocabulary):
        starts = by_end.setdefault(end, {})
        starts[start] = min(cost, starts.get(start, math.inf))
    best = [0.0]
    for end in range(1, len(value) + 1):
        cuts = (best[start] + cost + (JOINT if start else 0.0) for start, cost in by_end.get(end, {}).items())
        best.append(min(best[-1] + each, min(cuts, default=math.inf)))
    return best[-1]


def spans(text: str, name: bool = True, access: bool = True, hexes: bool = True, vocabulary: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind; code points, end exclusive. The flags skip kinds known to be absent."""
    found: list[tuple[int, int, str]] = []
    if name:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if access:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexes:
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    if name:
        base = list(found)
        for m in CONTEXT.finditer(text):
            start, end = m.span(m.lastindex)
            if m.lastindex == 3:
                end = start + len(m[3].rstrip(".,;:!?)"))
                if not re.search("[:=]", text[m.start() : start]) and not re.search("[0-9]", m[3]):
                    continue  # prose after "is" or "bearer"
            if end - start >= 6 and not any(a <= start and end <= b for a, b, _ in base) and guess_cost(text[start:end], vocabulary) >= STRONG:
                found.append((start, end, "guess"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _flags(texts: pa.Array) -> list[np.ndarray]:
    return [m.to_numpy(zero_copy_only=False) for m in (pc.match_substring_regex(texts, MAY_NAME), pc.match_substring(texts, "AKIA"), pc.match_substring_regex(texts, MAY_HEX))]


def _all_spans(texts: pa.Array, vocabulary: str | None) -> list[list[tuple[int, int, str]]]:
    flags = _flags(texts)
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]
    for i in np.flatnonzero(np.logical_or.reduce(flags)).tolist():
        out[i] = spans(texts[i].as_py(), *(bool(f[i]) for f in flags), vocabulary)
    return out


SPANS = "doc_id long, spans array<struct<start: long, end: long, kind: string>>, strongest double"


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """All spans of each document (doc_id, text), and the guess cost of its strongest credential value.

    vocabulary is the path, on every worker, of a tokenizer file whose words are the dictionary. Null and empty
    texts have no spans and a null cost. Repeated rows give a row each. Spans that begin together are ordered
    as in KINDS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in slices(batches):
            texts = text_of(batch)
            found = _all_spans(texts, vocabulary)
            cost = [max((guess_cost(_value(texts[i].as_py()[a:b], k), vocabulary) for a, b, k in f), default=None) if f else None for i, f in enumerate(found)]
            rows = [[{"start": a, "end": b, "kind": k} for a, b, k in f] for f in found]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array(rows, kind), "strongest": pa.array(cost, pa.float64())})

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS)


def _value(found: str, kind: str) -> str:
    return ASSIGN.match(found)[2] if kind == "assign" else found


def digest(scanned: DataFrame) -> DataFrame:
    """The scan's counts, its base spans' checksum and its spans as text."""

    def joined(spans_: object) -> object:
        return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind: str) -> object:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind != "guess")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("guess"), "strongest")


def redact(docs: DataFrame, vocabulary: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each secret span replaced by mark; n_chars follows the new text. Other columns stay.

    Spans that overlap are replaced together. A null text or n_chars stays null, a text without spans stays as
    it is; rows are neither dropped nor merged.
    """
    schema = docs.schema
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _all_spans(text_of(batch), vocabulary)
            hit = [i for i, f in enumerate(found) if f]
            if hit:
                texts = batch.column(place).to_pylist()
                for i in hit:
                    out, at = [], 0
                    for a, b, _ in found[i]:
                        if b > at:
                            out += [texts[i][at:a], mark] if a >= at else []
                            at = b
                    texts[i] = "".join([*out, texts[i][at:]])
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
            yield batch

    out = small_batches(docs).mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        kind = schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text").cast(kind), F.col("n_chars"))))
    return out.select(*docs.columns)
