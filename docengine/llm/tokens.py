"""Token ids of whole texts by a public tokenizer file, encoded once per distinct unit.

Both vocabularies split a text into pieces before merging bytes, and no piece crosses a cut that is
made before a run of white space. So a text is cut there, equal units of a slice are encoded once by
the tokenizers library, and the ids are put together by array operations. Texts with unusual white
space go to the library whole. The result equals the library's ids of the whole text.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docengine.llm.common import split_words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space beyond single blanks and line ends, and NUL, which marks the first unit below.
UNUSUAL = (
    "[\\x00\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    "|[ \\n][ \\n]|^[ \\n]|[ \\n]$"
)
#: A stop or comma between a letter and white space is a piece of its own, so it may be a unit of its own.
STOP = "([A-Za-z])([.,])([ \\n]|$)"
UNITS_A_CALL = 2048
WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch


def _byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as U+0100 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_ALPHABET = _byte_alphabet()


class Encoder:
    """mode 'byte': byte-level pieces with their leading blank; 'word': lower-cased words, white space dropped.

    known: at most this many units are remembered between slices (memory stays bounded; others are
    encoded again).
    """

    def __init__(self, path: str, mode: str, known: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.mode, self.known = mode, known
        self.cache: dict[str, bytes] = {"": b"", "\0": b""} if mode == "byte" else {"": b""}
        self.mark = "\n" if mode == "byte" else "~"
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, units: list[str], glue: str) -> list[bytes]:
        """Ids of each unit; glue stands before each unit and gives the id mark_id, which no unit contains."""
        out: list[bytes] = []
        calls = [units[i : i + UNITS_A_CALL] for i in range(0, len(units), UNITS_A_CALL)]
        encoded = self.tokenizer.encode_batch_fast([glue + glue.join(c) for c in calls], add_special_tokens=False)
        for call, e in zip(calls, encoded, strict=True):
            ids = np.array(e.ids, "<u4")
            starts = np.flatnonzero(ids == self.mark_id)
            if len(starts) != len(call):  # a unit holds the mark after normalisation
                out += self.whole([(" " + u if glue == "\n " else u) for u in call])
                continue
            data, ends = ids.tobytes(), [*(starts[1:] * 4).tolist(), 4 * len(ids)]
            out += [data[a:b] for a, b in zip((starts * 4 + 4).tolist(), ends, strict=True)]
        return out

    def _words(self, units: list[str]) -> dict[str, bytes]:
        """Units that are one piece of Latin letters go straight to the library's merges, in its byte alphabet."""
        merge, out = self.tokenizer.model.tokenize, {}
        byte, pack = self.mode == "byte", struct.Struct
        found = list(filter(WORD, units)) if byte else [u for u in units if WORD(u) and (u.isascii() or (u == u.lower() and unicodedata.is_normalized("NFC", u)))]
        for u in found:
            mapped = u if u.isascii() else u.encode().decode("latin-1").translate(BYTE_ALPHABET)
            ids = [t.id for t in merge("\u0120" + mapped if byte else mapped)]
            out[u] = pack(f"<{len(ids)}I").pack(*ids)
        return out

    def _units(self, units: list[str]) -> list[bytes]:
        found = self._words(units)
        rest = [u for u in units if u not in found] if len(found) < len(units) else []
        if self.mode == "word":
            odd = [u for u in rest if self.mark in u]
            even = [u for u in rest if self.mark not in u]
            found |= dict(zip(odd, self.whole(odd), strict=True)) | dict(zip(even, self._joined(even, f" {self.mark} "), strict=True))
        else:
            line = [u for u in rest if u[0] in "\0\n"]
            blank = [u for u in rest if u[0] not in "\0\n"]
            found |= dict(zip(blank, self._joined(blank, "\n "), strict=True))
            end = np.array([self.mark_id], "<u4").tobytes()
            found |= {u: e if u[0] == "\0" else end + e for u, e in zip(line, self._joined([u[1:] for u in line], "\n") if line else [], strict=True)}
        return [found[u] for u in units]

    def _lookup(self, units: list[str]) -> list[bytes]:
        out = list(map(self.cache.get, units))
        new = [i for i, x in enumerate(out) if x is None]
        if new:
            names = [units[i] for i in new]
            fresh = self._units(names)
            for i, x in zip(new, fresh, strict=True):
                out[i] = x
            room = self.known - len(self.cache)
            if room > 0:
                self.cache.update(zip(names[:room], fresh[:room], strict=True))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (uint32) and the offset of each text in them (int64, one more than texts)."""
        n = len(texts)
        if self.mode == "byte":
            odd = pc.match_substring_regex(texts, UNUSUAL).to_numpy(zero_copy_only=False)
            plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
            marked = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("\0", pc.replace_substring(plain, "\n", " \n"), "")))
            lists = pc.split_pattern(pc.replace_substring_regex(marked, STOP, "\\1 \0\\2\\3"), " ")
        else:
            odd = np.zeros(n, bool)
            lists = split_words(pc.replace_substring_regex(pc.ascii_lower(texts), STOP, "\\1 \\2\\3"))
        bounds = lists.offsets.to_numpy()
        bounds = bounds - bounds[0]
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        pieces = self._lookup(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) >> 2
        table = np.frombuffer(b"".join(pieces), "<u4")
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        ids, ends = ragged(table, first, size, code)
        offsets = np.concatenate([[0], ends])[bounds]
        if odd.any():
            whole = {i: np.frombuffer(b, "<u4") for i, b in zip(np.flatnonzero(odd).tolist(), self.whole(texts.filter(pa.array(odd)).to_pylist()), strict=True)}
            parts_ = [whole[i] if i in whole else ids[offsets[i] : offsets[i + 1]] for i in range(n)]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts_])]).astype(np.int64)
            ids = np.concatenate(parts_)
        return ids, offsets


@cache
def encoder(path: str, mode: str) -> Encoder:
    """One for each worker process, so that later tasks find known units."""
    return Encoder(path, mode)


def ragged(table: np.ndarray, first: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """table[first[c] : first[c] + size[c]] for each c of code, joined; and the end of each."""
    count = size[code]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return np.zeros(0, table.dtype), ends
    at = np.repeat(first[code] - (ends - count), count)
    at += np.arange(total)
    return table[at], ends


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id after each text."""
    return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))
