"""Benchmark decontamination by spaced seeds.

A seed reads the words of a window that a fixed mask selects and ignores the others, so it survives
substitutions between them. Seeds of the training documents are joined with those of the benchmark; each
hit names a diagonal of a document and an item, along which the overlap is verified. Hits are expanded and
diagonals verified in bounded portions of arrays, so a seed that is frequent in both costs time, not memory.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import fresh, slices, small_batches, text_of, written

#: Positions that each mask selects: five words of five to eight. Together they hit every overlap that
#: counts as a leak below, wherever its differing words are (a test goes through all of them).
MASKS = ((0, 1, 2, 4, 5), (0, 1, 4, 6, 7), (0, 1, 2, 3, 4))
#: An overlap is a leak if so many consecutive positions (all of a shorter item or text) agree in at least SHARE: the
#: shorter window finds parts of items, the longer one whole items in which differing words stand close together.
WINDOWS = (13, 20)
SHARE = 0.8
#: Items of SHORTEST words or more can match; one of fewer than FUZZY words only as a whole and word by word.
SHORTEST = 5
FUZZY = 8
#: Words of benchmark text that one pass over the documents holds; a larger benchmark takes several passes.
BLOCK_WORDS = 2_000_000
#: Pairs of places, and cells of diagonals, that are held at a time.
PORTION = 4_000_000
FILTER_BITS = 22
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], np.uint64)


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-case runs of letters and digits of all texts, dictionary coded, and each text's bounds in them."""
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), "[^\\pL\\pN]+", " "), " ")
    lists = pc.split_pattern(plain, " ")
    bounds = lists.offsets.to_numpy()
    flat = lists.flatten()
    if pc.any(pc.equal(plain, "")).as_py():
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]]
        flat = flat.filter(pa.array(real))
    return flat.dictionary_encode(), (bounds - bounds[0]).astype(np.int64)


def seeds(ids: np.ndarray, at: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """A hash of the words that the mask selects at each of the positions `at`."""
    total = np.full(len(at), salt + 1, np.uint64) * FACTORS[0]
    for step, factor in zip(mask, FACTORS, strict=True):
        total = (total ^ ((ids[at + step].astype(np.uint64) + np.uint64(1)) * factor)) * FACTORS[1]
        total ^= total >> np.uint64(29)
    return total


@dataclass
class Index:
    """Seeds of a block of items: sorted hashes, the item and position of each, and the items' words."""

    item_ids: list[int | None]
    vocabulary: dict[str, int]
    words: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    position: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int | None, str | None]]) -> Index:
        coded, bounds = words_of(pa.array([t or "" for _, t in rows], pa.large_string()))
        vocabulary = {w: i + 1 for i, w in enumerate(coded.dictionary.to_pylist())}
        code = coded.indices.to_numpy().astype(np.int32) + 1
        hashes, item, position = [], [], []
        for i, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
            if b - a < SHORTEST:
                continue
            for k, mask in enumerate(MASKS):
                at = np.arange(max(0, b - a - mask[-1]))
                hashes.append(seeds(code[a:b], at, mask, k))
                item.append(np.full(len(at), i, np.int32))
                position.append(at.astype(np.int32))
        if not hashes:
            hashes, item, position = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        h, i, p = np.concatenate(hashes), np.concatenate(item), np.concatenate(position)
        order = np.argsort(h, kind="stable")
        bitmap = np.zeros(1 << FILTER_BITS, bool)
        bitmap[h >> np.uint64(64 - FILTER_BITS)] = True
        return cls([r[0] for r in rows], vocabulary, code, bounds, h[order], i[order], p[order], bitmap)

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word in the text, words compared, words equal) of the best verified diagonal of each pair.

        The best has the most equal words; of those with as many it is the first in the text.
        """
        coded, bounds = words_of(texts)
        get = self.vocabulary.get
        own = np.fromiter((get(w, 0) for w in coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
        ids = own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.int32)
        best: np.ndarray | None = None
        for diagonals in _portions(*self._diagonals(ids, bounds), np.diff(self.bounds)):
            found = self._verified(ids, bounds, *diagonals)
            best = _best(found if best is None else np.concatenate([best, found]))
        return [] if best is None else [tuple(r) for r in best.tolist()]

    def _diagonals(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, item, place of the item's first word among all words) that a seed hits."""
        known = ids > 0
        longest = int(np.diff(self.bounds).max(initial=0))
        span = len(ids) + longest + 1  # a diagonal's place lies in (-longest, len(ids)); it is numbered from 0
        keys = [np.zeros(0, np.int64)]
        for k, mask in enumerate(MASKS):
            n = len(ids) - mask[-1]
            if n <= 0:
                continue
            live = known[:n].copy()
            for at in mask[1:]:
                live &= known[at : at + n]
            at = np.flatnonzero(live)
            if not len(at):
                continue
            text = np.searchsorted(bounds, at, side="right") - 1
            inside = at + mask[-1] < bounds[text + 1]
            at, text = at[inside], text[inside]
            total = seeds(ids, at, mask, k)
            maybe = self.bitmap[total >> np.uint64(64 - FILTER_BITS)]
            at, text, total = at[maybe], text[maybe], total[maybe]
            low, high = np.searchsorted(self.hashes, total, side="left"), np.searchsorted(self.hashes, total, side="right")
            hit = high > low
            at, text, low, count = at[hit], text[hit], low[hit], (high - low)[hit]
            for a, b in _cuts(count):
                place = np.repeat(low[a:b] - (np.cumsum(count[a:b]) - count[a:b]), count[a:b]) + np.arange(int(count[a:b].sum()))
                pair = np.repeat(text[a:b], count[a:b]) * len(self.item_ids) + self.item[place]
                keys.append(_distinct(pair * span + (np.repeat(at[a:b], count[a:b]) - self.position[place] + longest)))
                if len(keys) > 16:
                    keys = [np.unique(np.concatenate(keys))]
        key = np.unique(np.concatenate(keys))
        pair, start = key // span, key % span - longest
        return pair // max(1, len(self.item_ids)), pair % max(1, len(self.item_ids)), start

    def _verified(self, ids: np.ndarray, bounds: np.ndarray, text: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Rows (text, item, first word, words compared, words equal) of the diagonals that hold a window of agreeing words."""
        size, length = np.diff(self.bounds)[item], np.diff(bounds)[text]
        first, last = np.maximum(start, bounds[text]), np.minimum(start + size, bounds[text + 1])
        all_of = np.minimum(size, length)
        least = np.minimum(WINDOWS[0], all_of)
        some = np.flatnonzero((last - first >= least) & ((least >= FUZZY) | (least == size)))
        text, item, start, first, all_of, n = text[some], item[some], start[some], first[some], all_of[some], (last - first)[some]
        begin = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(begin, n)
        equal = ids[np.repeat(first, n) + within] == self.words[np.repeat(self.bounds[item] + first - start, n) + within]
        run, place, ok = np.concatenate([[0], np.cumsum(equal)]), np.arange(len(equal)), np.zeros(len(n), bool)
        for window in WINDOWS if len(n) else ():
            width = np.minimum(window, all_of)
            wide = np.repeat(width, n)
            whole = within + wide <= np.repeat(n, n)  # places where a window begins
            agree = np.zeros(len(equal), np.int64)
            agree[whole] = run[(place + wide)[whole]] - run[place[whole]]
            ok |= np.maximum.reduceat(agree, begin) >= np.where(width < FUZZY, width, np.ceil(SHARE * width - 1e-9))
        return np.stack([text, item, first - bounds[text], n, run[begin + n] - run[begin]], 1)[ok]


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of sizes that sum to about PORTION, one at least in each."""
    total = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        before = int(total[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + PORTION, side="right")))
        yield a, b
        a = b


def _portions(text: np.ndarray, item: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for a, b in _cuts(sizes[item]):
        yield text[a:b], item[a:b], start[a:b]


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The keys once each; those of few texts and items lie close together and are marked instead of sorted."""
    low = int(keys.min())
    width = int(keys.max()) - low + 1
    if width > 8 * PORTION:
        return np.unique(keys)
    seen = np.zeros(width, bool)
    seen[keys - low] = True
    return np.flatnonzero(seen) + low


def _best(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort((rows[:, 2], -rows[:, 4], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])] if len(rows) else rows


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[int, Iterator[Index]]:
    """The number of blocks of about block_words words, counted first, and their indexes over the whole benchmark (item_id, text)."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.size(F.split("text", "\\s+")))).first()[0] or 0
    n = max(1, -(-total // block_words))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, (Index.build([tuple(r) for r in rows.where(part == k).collect()]) for k in range(n))


LEAKS = "doc_id long, item_id long, first_word long, n_words long, n_equal long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and item that share a verified overlap, at its best diagonal.

    Null and empty texts share nothing; repeated documents or items give a row for each pair of rows. Of
    diagonals with as many equal words the first in the text is given.
    """
    out: DataFrame | None = None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for index in blocks(benchmark, block_words)[1]:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches):
                found = index.leaks(text_of(batch))
                ids = batch.column("doc_id").to_pylist() if found else []
                columns = [[ids[f[0]] for f in found], [index.item_ids[f[1]] for f in found], *([f[k] for f in found] for k in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in LEAKS.split(", ")])

        part = small_batches(rows).mapInArrow(run, LEAKS)
        out = part if out is None else out.unionAll(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without a leak, all columns unchanged.

    Null and empty texts stay, repeated rows stay or go together, an empty benchmark drops nothing. A benchmark
    of several blocks is searched block by block into a table of the leaking rows' ids and text marks.
    """
    n, indexes = blocks(benchmark, block_words)
    names = [fresh(docs, "mark"), fresh(docs, "other")]
    marks = dict(zip(names, (F.xxhash64("text"), F.hash("text")), strict=True))
    found: DataFrame | None = None
    for index in indexes:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in shared.value.leaks(text_of(batch))]] = False
                yield batch.filter(pa.array(clean))

        if n == 1:
            return small_batches(docs).mapInArrow(run, docs.schema)

        def leaking(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                leaks = sorted({f[0] for f in shared.value.leaks(text_of(batch))})
                yield batch.select(names).take(pa.array(leaks, pa.int64()))

        rows = docs.select("text", *(c.alias(name) for name, c in marks.items()))
        part = written(small_batches(rows).mapInArrow(leaking, f"{names[0]} long, {names[1]} int").distinct(), "leaking")
        found = part if found is None else found.unionAll(part)
    return docs.withColumns(marks).join(found.distinct(), names, "left_anti").select(*docs.columns)
