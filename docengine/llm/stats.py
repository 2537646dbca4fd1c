"""Statistics of whole texts, by array operations over slices of a batch.

Words are what stands between ASCII white space (20, 09-0D).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docengine.llm.common import split_words

#: Long columns of the quality contract, in order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the models see, each from the text alone.
FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "stop_share", "comma_share",
    "bang_share", "bar_share", "distinct_share", "line_words", "other_share", "short_share", "mid_sign_share", "top_share",
)
SYMBOLS = "#*$%&|<>"


def _classes() -> np.ndarray:
    """A class for each byte: 0 other, 1 white, 2 upper, 3 lower, 4 digit, 5 symbol, 6 stop, 7 comma, 8 bang, 9 bar, 10 line end, 11 inside a character."""
    kind = np.zeros(256, np.uint8)
    kind[128:192] = 11
    kind[192:] = 3
    for b in range(256):
        c = chr(b)
        if b in (32, 9, 11, 12, 13):
            kind[b] = 1
        elif b == 10:
            kind[b] = 10
        elif b < 128 and c.isupper():
            kind[b] = 2
        elif b < 128 and c.islower():
            kind[b] = 3
        elif b < 128 and c.isdigit():
            kind[b] = 4
        elif c in ".?":
            kind[b] = 6
        elif c in ",;:":
            kind[b] = 7
        elif c == "!":
            kind[b] = 8
        elif c == "|":
            kind[b] = 9
        elif c in SYMBOLS:
            kind[b] = 5
    return kind


KIND = _classes()
N_KINDS = 12


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds, empty stretches included."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x COUNTS, int64) and (rows x FEATURES, float64) of a large_string array without nulls or offset."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    text_at = np.repeat(np.arange(n), np.diff(bounds))
    kinds = np.bincount(text_at * N_KINDS + KIND[data], minlength=n * N_KINDS).reshape(n, N_KINDS).astype(np.int64)
    del text_at
    points = kinds.sum(1) - kinds[:, 11]
    white = kinds[:, 1] + kinds[:, 10]

    words = split_words(texts)
    w_bounds = words.offsets.to_numpy()
    w_bounds = w_bounds - w_bounds[0]
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    lengths = pc.utf8_length(coded.dictionary).to_numpy()
    real = lengths[code] > 0
    n_words = _per_text(real, w_bounds)
    w_bounds = np.concatenate([[0], np.cumsum(real)])[w_bounds]
    code = code[real].astype(np.int64)
    w_text = np.repeat(np.arange(n), np.diff(w_bounds))
    covered, repeated = np.zeros(len(code), bool), np.zeros(0, np.int64)
    if len(code) > 2:
        width = np.int64(len(lengths))
        if width < 1 << 21:
            key = (code[:-2] * width + code[1:-1]) * width + code[2:]
        else:  # wider dictionaries: pairs are numbered first
            pairs = np.unique(code[:-2] * width + code[1:-1], return_inverse=True)[1]
            key = pairs * width + code[2:]
        inside = np.flatnonzero(w_text[:-2] == w_text[2:])
        order = inside[np.argsort(key[inside], kind="stable")]
        same = (key[order[1:]] == key[order[:-1]]) & (w_text[order[1:]] == w_text[order[:-1]])
        repeated = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        for k in range(3):
            covered[repeated + k] = True
    n_repeat = _per_text(covered, w_bounds)

    lines = pc.split_pattern(texts, "\n")
    l_bounds = lines.offsets.to_numpy()
    l_bounds = l_bounds - l_bounds[0]
    l_coded = lines.flatten().dictionary_encode()
    l_code = l_coded.indices.to_numpy().astype(np.int64)
    filled = pc.match_substring_regex(l_coded.dictionary, "[^\\x20\\x09-\\x0d]").to_numpy(zero_copy_only=False)[l_code]
    l_text = np.repeat(np.arange(n), np.diff(l_bounds))
    key = np.sort((l_text * np.int64(max(1, len(l_coded.dictionary))) + l_code)[filled])
    dup = key[1:][key[1:] == key[:-1]] // np.int64(max(1, len(l_coded.dictionary)))
    n_dup = np.bincount(dup, minlength=n).astype(np.int64)
    n_lines = _per_text(filled, l_bounds)

    counts = np.stack([n_words, points - white, kinds[:, 5] + kinds[:, 9], n_dup, n_repeat], 1)

    w = np.maximum(n_words, 1)
    c = np.maximum(points - white, 1)
    # distinct words and the share of the commonest one
    pair = np.sort(w_text * np.int64(max(1, len(lengths))) + code)
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    run_text = pair[first] // np.int64(max(1, len(lengths))) if len(pair) else first
    distinct = np.bincount(run_text, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, run_text, np.diff(np.concatenate([first, [len(pair)]])))
    short = _per_text(lengths[code] <= 3, w_bounds)
    signs = pc.match_substring_regex(coded.dictionary, "[^A-Za-z0-9\\x{80}-\\x{10ffff}.,;:!?'\"()-]").to_numpy(zero_copy_only=False)[code]
    features = np.stack([
        np.log1p(n_words), (points - white) / w, counts[:, 2] / c, n_dup / np.maximum(n_lines, 1), n_repeat / w, kinds[:, 2] / c, kinds[:, 4] / c, kinds[:, 6] / w, kinds[:, 7] / w,
        kinds[:, 8] / w, kinds[:, 9] / w, distinct / w, n_words / np.maximum(n_lines, 1), kinds[:, 0] / c, short / w, _per_text(signs, w_bounds) / w, top / w,
    ], 1).astype(np.float64)
    return counts, features


def brute_counts(text: str) -> tuple[int, int, int, int, int]:
    """The five counts of one text, plainly."""
    import re

    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search("[^\\x20\\x09-\\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            marked |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(text.count(s) for s in SYMBOLS), dup, len(marked)
