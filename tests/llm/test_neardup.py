from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docengine.llm import neardup
from docengine.llm.components import components
from docengine.llm.neardup import in_order, keep_one, labelled, near_duplicates, similar


def brute_components(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("few", [0, 10**6])
@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)] + [(60, 61), (61, 60), (49, 48)], [(7, 7), (1, 3), (2, 3), (2, 9), (12, 9)]])
def test_components(spark, edges, few):
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long"), few).collect()}
    assert got == {k: v for k, v in brute_components([e for e in edges if e[0] != e[1]]).items()}


def longest(a, b, band):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + (a[i] == b[j] and abs(i - j) <= band))
    return best[-1, -1]


def test_alignment_equals_dynamic_programming():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (rng.permutation(30)[: rng.integers(1, 30)].astype(np.uint32) for _ in range(2))
        if rng.random() < 0.5:
            b = np.delete(a, rng.integers(0, len(a)))
        band = int(rng.integers(0, 30))
        assert in_order(a, b, band) == longest(a, b, band)
        both = longest(a, b, 99)
        assert similar(a, b) == (both >= 0.8 * (len(a) + len(b) - both) - 1e-9)


def test_kmers_do_not_depend_on_neighbours():
    texts = ["", "a b", "a b c d e f", "x x x x x x x x x", "a b c d e f", "A  b\tc d e f"]
    kmers, ends, marks = labelled(pa.array(texts, pa.large_string()))
    assert np.diff(ends).tolist() == [0, 1, 2, 5, 2, 2] and marks[2] == marks[4] == marks[5] and len(set(marks)) == 4
    assert len(set(kmers[ends[3] : ends[4]].tolist())) == 5
    for i, t in enumerate(texts):
        assert (labelled(pa.array([t], pa.large_string()))[0] == kmers[ends[i] : ends[i + 1]]).all()


def brute_classes(rows):
    def kmers(text):
        words, count, out = (text or "").lower().split(), Counter(), []
        for i in range(max(1, len(words) - 4) if words else 0):
            k = tuple(words[i : i + 5])
            out.append((k, count[k]))
            count[k] += 1
        return out

    each = [kmers(t) for _, t in rows]
    edges = [(i, i) for i in range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            n = len(set(each[i]) & set(each[j]))
            if each[i] == each[j] or n >= 0.8 * (len(each[i]) + len(each[j]) - n):
                edges.append((j, i))
    return brute_components(edges)


def make(seed=0):
    """Groups of copies with a few words changed, an exact copy, and texts that share one long passage."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = list(rng.choice(words, 60))
    texts = []
    for g in range(6):
        base = list(rng.choice(words, 120))
        for c in range(8):
            copy = list(base)
            for at in rng.integers(0, 120, c % 4):
                copy[at] = str(rng.choice(words))
            texts.append(" ".join(copy))
    texts += [" ".join([*rng.choice(words, 40), *passage]) for _ in range(40)]
    texts += ["short text", "short text", "Short  TEXT", "", None, " "]
    return [(i, texts[k]) for i, k in enumerate(rng.permutation(len(texts)).tolist())]


@pytest.mark.parametrize("inside", [500, 3])
def test_classes_equal_brute_force(spark, monkeypatch, inside):
    monkeypatch.setattr(neardup, "INSIDE", inside)
    rows = make()
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_keep_one(spark, odd_docs, monkeypatch):
    rows = make(3)
    docs = spark.createDataFrame([(i, t, None, "s", 1, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string")
    want = {i for i, c in brute_classes(rows).items() if i == c}
    for most in (10**6, 0):
        monkeypatch.setattr(neardup, "BROADCAST_ROWS", most)
        kept = keep_one(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)
    odd = keep_one(odd_docs).collect()
    assert sorted(str(r.doc_id) for r in odd) == ["1", "4", "6", "7", "None"]
    assert keep_one(docs.limit(0)).count() == 0 and near_duplicates(docs.limit(0)).count() == 0
    assert near_duplicates(odd_docs).count() == 9


def form_letters(seed, n=48, changed=8, places=88):
    """Texts of one template with changed words: pairs with ten differing places are at 0.8, with twelve at 0.76."""
    rng = np.random.default_rng(seed)
    template = [f"w{i}" for i in range(454)]
    texts = []
    for _ in range(n):
        copy = list(template)
        for at in rng.choice(places, changed, replace=False):
            copy[5 * at + 7] = f"x{at}"
        texts.append(" ".join(copy))
    return list(enumerate(texts))


@pytest.mark.parametrize("inside", [500, 7])
def test_form_letters_equal_brute_force(spark, monkeypatch, inside):
    """Many texts just below the threshold hide none that reaches it, in whole buckets and in blocks of hot ones."""
    monkeypatch.setattr(neardup, "INSIDE", inside)
    monkeypatch.setattr(neardup, "COLUMNS", 100)
    rows = form_letters(1)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert 1 < len(set(want.values())) < len(rows) and got == want


def near_misses(seed=7, families=6, n=62):
    """Families of texts that share most of their runs, all pairs just below the threshold but one in each family."""
    rng = np.random.default_rng(seed)
    texts, links = [], []
    for f in range(families):
        template = [f"f{f}w{i}" for i in range(454)]
        for c in range(n):
            copy = list(template)
            for at in rng.choice(88, 10, replace=False):
                copy[5 * at + 7] = f"x{c}y{at}"
            texts.append(copy)
        a, b = len(texts) - n + 5, len(texts) - 3
        texts[b] = [*texts[a][:-1], "end"]
        links.append((a, b))
    return [(i, " ".join(t)) for i, t in enumerate(texts)], links


@pytest.mark.parametrize("inside,kmers", [(2000, 4_000_000), (20, 4_000_000), (2000, 9000)])
def test_near_misses_hide_no_link(spark, monkeypatch, inside, kmers):
    monkeypatch.setattr(neardup, "INSIDE", inside)
    monkeypatch.setattr(neardup, "INSIDE_KMERS", kmers)
    rows, links = near_misses()
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(c, i) for i, c in got.items() if c != i} == set(links)


def test_overlaps_are_exact(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    left, right = ([rng.permutation(60)[: rng.integers(0, 50)].astype(np.uint32) for _ in range(n)] for n in (5, 8))
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert neardup.overlaps(left, right).tolist() == want
    assert (neardup.overlaps(left, left) - np.diag([len(x) for x in left]) == [[len(set(a) & set(b)) if a is not b else 0 for b in left] for a in left])[~np.eye(5, dtype=bool)].all()
    assert neardup.overlaps([np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]).tolist() == [[0]]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "k", 1), (2, "a b c d e f", 6, "l", 2)], "doc_id long, text string, node long, Node_ string, label long")
    kept = keep_one(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d e f", 5, "k", 1)]
