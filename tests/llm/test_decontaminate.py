import itertools
import math
import time

import numpy as np
import pyarrow as pa
import pytest

from docengine.llm import decontaminate as D
from docengine.llm.decontaminate import Index, find_leaks, keep_clean

VOCABULARY = [f"w{i}" for i in range(300)] + ["the", "of", "été", "İx"]


def brute(texts, items):
    """All (text, item) with a window of agreeing words on some diagonal."""
    import re

    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    found = set()
    for (i, t), (j, s) in itertools.product(enumerate(texts), enumerate(items)):
        a, b = words(t), words(s)
        widths = [min(w, len(b), len(a)) for w in D.WINDOWS]
        if len(b) < D.SHORTEST or (widths[0] < D.FUZZY and widths[0] < len(b)):
            continue
        for start in range(-len(b) + 1, len(a)):
            equal = [a[start + k] == b[k] if 0 <= start + k < len(a) else None for k in range(len(b))]
            equal = [e for e in equal if e is not None]
            for width in widths:
                least = width if width < D.FUZZY else math.ceil(D.SHARE * width)
                if any(sum(equal[k : k + width]) >= least for k in range(len(equal) - width + 1)):
                    found.add((i, j))
    return found


def test_masks_hit_every_allowed_substitution():
    for width in range(D.SHORTEST, D.WINDOWS[1] + 1):
        wrong = width - math.ceil(D.SHARE * width) if width >= D.FUZZY else 0
        fits = [sum(1 << (o + p) for p in m) for m in D.MASKS for o in range(width - m[-1])]
        for places in itertools.combinations(range(width), wrong):
            gone = sum(1 << p for p in places)
            assert any(not f & gone for f in fits), (width, places)


def make(seed=1):
    rng = np.random.default_rng(seed)
    items = [" ".join(rng.choice(VOCABULARY, n)) for n in (3, 5, 7, 8, 12, 20, 33, 50, 50)]
    texts = [" ".join(rng.choice(VOCABULARY, n)) for n in rng.integers(0, 60, 40)]
    for i in range(60):
        words = items[i % len(items)].split()
        cut = words[: rng.integers(1, len(words) + 1)] if i % 3 == 0 else words
        swapped = [w if rng.random() > (i % 5) * 0.07 else "other" for w in cut]
        texts.append(" ".join(["pre", "fix"][: i % 3] + [w.upper() + "," for w in swapped] + ["tail"] * (i % 4)))
    return texts, items


@pytest.mark.parametrize("portion", [D.PORTION, 50])
def test_equal_to_brute_force(monkeypatch, portion):
    monkeypatch.setattr(D, "PORTION", portion)
    texts, items = make()
    found = Index.build(list(enumerate(items))).leaks(pa.array(texts, pa.large_string()))
    assert {(f[0], f[1]) for f in found} == brute(texts, items)
    assert len(found) > 20


def test_query_in_one_and_many_blocks(spark, odd_docs):
    texts, items = make(2)
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, ""), (97, items[-1])], "item_id long, text string")
    want = {(100 + i, j) for i, j in brute(texts, items)}
    want |= {(i, 97) for i, j in want if j == len(items) - 1}
    for words in (10**6, 40):
        got = find_leaks(docs, bench, words).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        clean = keep_clean(docs, bench, words)
        assert clean.columns == docs.columns
        assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in {i for i, _ in want})
    assert find_leaks(docs, bench.limit(0)).count() == 0 and find_leaks(docs.limit(0), bench).count() == 0
    assert keep_clean(docs, bench.limit(0)).count() == docs.count()


def test_parts_and_gaps():
    """Half an item, an item with a word put in, a short text out of an item, and what is not enough."""
    words = [f"v{i}" for i in range(30)]
    texts = [" ".join(x) for x in (["a"] * 9 + words[10:23] + ["b"] * 9, words[:15] + ["new"] + words[15:], words[4:13], words[4:11], ["a"] * 9 + words[10:20] + ["b"] * 9, [*words[:13], *words[17:]])]
    found = Index.build([(1, " ".join(words))]).leaks(pa.array(texts, pa.large_string()))
    assert {f[0] for f in found} == {0, 1, 2, 5} == {i for i, _ in brute(texts, [" ".join(words)])}


def test_repetitive_items_end_soon():
    """Every place of the item hits every place of the text."""
    unit = [f"u{i}" for i in range(4)]
    item, text = " ".join(unit * 500), " ".join([*unit * 2500, "x"] * 2)
    began = time.perf_counter()
    found = Index.build([(1, item), (2, " ".join(["same"] * 400))]).leaks(pa.array([text, "same " * 20_000, "other words"], pa.large_string()))
    assert time.perf_counter() - began < 30
    assert found == [(0, 0, 0, 2000, 2000), (1, 1, 0, 400, 400)]


def test_small_repetitive_items_equal_brute_force():
    rng = np.random.default_rng(5)
    items = [" ".join(rng.choice(["a", "b"], n)) for n in (9, 14, 30)]
    texts = [" ".join(rng.choice(["a", "b", "c"], 40)) for _ in range(10)]
    found = Index.build(list(enumerate(items))).leaks(pa.array(texts, pa.large_string()))
    seeded = {(f[0], f[1]) for f in found}
    assert seeded == brute(texts, items)
