import numpy as np
import pyarrow as pa
import pytest

from docengine.llm import quality
from docengine.llm.stats import COUNTS, FEATURES, brute_counts, statistics

TEXTS = [
    "", " ", "\n\n", "a a a a", "one two three one two three", "x\nx\n \n \nx", "#*$ %&|<> été ÉTÉ 日本", "tab\tsep\x0bvt\x0cff\rcr", "\x1c\x85\xa0 no break", "a b c d\na b c\na b c d",
    "word " * 3000, "é" * 4000,
]


def test_counts_equal_brute_force():
    rng = np.random.default_rng(5)
    texts = TEXTS + ["".join(rng.choice(list("ab \n\t|é"), n)) for n in rng.integers(0, 60, 800)]
    counts, features = statistics(pa.array(texts, pa.large_string()))
    assert [tuple(r) for r in counts.tolist()] == [brute_counts(t) for t in texts]
    assert features.shape == (len(texts), len(FEATURES)) and np.isfinite(features).all()
    alone = np.concatenate([statistics(pa.array([t], pa.large_string()))[1] for t in texts])
    assert np.allclose(alone, features)


def data(n=3000):
    rng = np.random.default_rng(0)
    x = rng.random((n, len(FEATURES)))
    z = 4 * x[:, 0] - 6 * x[:, 2] + 8 * (x[:, 1] > 0.5) * (x[:, 6] > 0.5) - 2
    return x, (rng.random(n) < quality.sigmoid(z)).astype(float)


def accuracy(model, x, y):
    return ((model.raw(x) > 0) == (y > 0.5)).mean()


def test_trees_learn_and_are_monotone():
    x, y = data()
    model = quality.fit_trees(x[:2000], y[:2000])
    assert accuracy(model, x[2000:], y[2000:]) > 0.8
    for name in quality.FALLING:
        j = FEATURES.index(name)
        low, high = x.copy(), x.copy()
        high[:, j] = np.minimum(1, low[:, j] + np.linspace(0, 1, len(x)))
        assert (model.raw(high) <= model.raw(low) + 1e-9).all()


def test_additive_learns_pairs():
    x, y = data()
    model = quality.fit_additive(x[:2000], y[:2000])
    alone = quality.fit_additive(x[:2000], y[:2000], pair_rounds=0)
    assert accuracy(model, x[2000:], y[2000:]) > max(0.8, accuracy(alone, x[2000:], y[2000:]) + 0.02)
    assert {1, 6} <= {j for a, b, _ in model.pairs[:2] for j in (a, b)}


def test_scores_equal_plain_lookups():
    x, y = data(600)
    additive, trees = quality.fit_additive(x, y, rounds=8, pair_rounds=4), quality.fit_trees(x, y, rounds=8)
    rows = np.concatenate([x[:50], np.zeros((1, x.shape[1])), np.full((1, x.shape[1]), 2.0), [[c[0] if len(c) else 0 for c in additive.cuts]]])

    def plain_additive(row):
        total = additive.start
        for cuts, table, value in zip(additive.cuts, additive.single, row, strict=True):
            total += table[sum(c < value for c in cuts)]
        for a, b, table in additive.pairs:
            total += table[sum(c < row[a] for c in additive.pair_cuts[a])][sum(c < row[b] for c in additive.pair_cuts[b])]
        return total

    def plain_tree(row):
        total = trees.start
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return total

    assert np.allclose(additive.raw(rows), [plain_additive(r) for r in rows]) and np.allclose(trees.raw(rows), [plain_tree(r) for r in rows])


def test_first_cut_equals_brute_force():
    """The first shallow tree of a feature is the best of all pairs of levels of cuts, tried one by one."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(2, 9))
        g, h = rng.normal(size=n), rng.random(n) + 0.1

        def gain(a, b):
            return g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)

        at = max(range(1, n), key=lambda k: gain(0, k) + gain(k, n))
        want = np.zeros(n)
        for a, b in ((0, at), (at, n)):
            cut = max(range(a + 1, b), key=lambda k: gain(a, k) + gain(k, b), default=None)
            parts = [(a, b)] if cut is None or gain(a, cut) + gain(cut, b) <= gain(a, b) else [(a, cut), (cut, b)]
            for i, j in parts:
                want[i:j] = -g[i:j].sum() / (h[i:j].sum() + 1.0)
        assert np.allclose(quality._shallow(g, h, 1.0), want)


@pytest.mark.parametrize("fit", [quality.fit_trees, quality.fit_additive])
def test_no_labels(fit):
    model = fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    assert quality.sigmoid(model.raw(np.ones((3, len(FEATURES))))).tolist() == [0.5] * 3


def test_queries(spark, odd_docs):
    good = " ".join(f"w{i} of" for i in range(40))
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(i, good if i % 2 else "%%% " * 60) for i in range(100, 160)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 160)] + [(100, 0, 0), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.apply_rules(docs, quality.train_rules(docs, labels)).collect()
    assert len(rules) == 9 + 60 and all(r.kept == bool(r.doc_id % 2) for r in rules if r.doc_id and r.doc_id >= 100)
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in rules if r.doc_id in (1, 2, 3))
    kept = quality.keep_good(odd_docs, quality.train_rules(docs, labels))
    assert kept.columns == odd_docs.columns and kept.count() <= 9
    scores = quality.score_quality(docs, quality.train_additive(docs, labels)).collect()
    assert len(scores) == 69 and all(0 <= r.score <= 1 for r in scores)
    none = docs.limit(0)
    assert quality.apply_rules(none, quality.train_rules(none, labels.limit(0))).count() == 0
    assert [c.split()[0] for c in quality.QUALITY.split(", ")][1:6] == list(COUNTS)
