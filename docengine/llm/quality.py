"""Document quality: rules with gradient-boosted trees, and an additive model with pairwise terms.

Both learn from a bounded sample of labelled documents on the driver and score every whole text on the
workers by array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import labelled_sample, slices, small_batches, text_of
from docengine.llm.stats import COUNTS, FEATURES, statistics

#: At most so many labelled documents are fitted on the driver.
FIT_ROWS = 12_000


def feature_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample of labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = statistics(text_of(batch))[1]
            yield pa.RecordBatch.from_pydict({"x": pa.array([r.tobytes() for r in x], pa.binary()), "label": batch.column("label")})

    found = labelled_sample(small_batches(docs), labels, "quality", limit).mapInArrow(run, "x binary, label double").limit(limit).toArrow()
    rows = sorted(zip(found["x"].to_pylist(), found["label"].to_pylist(), strict=True))  # the fit does not depend on the order of arrival
    return np.frombuffer(b"".join(r[0] for r in rows), np.float64).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], np.float64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def cut_points(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def base_rate(y: np.ndarray) -> float:
    p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    return float(np.log(p / (1 - p)))


# ---- trees

#: Quality never rises with these.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "bang_share", "upper_share", "mid_sign_share")


@dataclass
class Trees:
    """Complete binary trees of one depth as node arrays: node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 4.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting on binned features; a split on a FALLING feature must not raise the right side.

    The bounds of a monotone split go down to both children, so the whole tree is monotone.
    """
    n, m = x.shape
    cuts = [cut_points(x[:, j], bins) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) if n else np.zeros((0, m), int)
    sign = np.array([-1 if name in FALLING else 0 for name in FEATURES[:m]] + [0] * max(0, m - len(FEATURES)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    z = np.full(n, base_rate(y))
    out = Trees(np.zeros((rounds if n else 0, inner), np.int64), np.full((rounds if n else 0, inner), np.inf), np.zeros((rounds if n else 0, leaves)), base_rate(y))
    width = bins + 1
    for r in range(len(out.feature)):
        p = sigmoid(z)
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = (1e-6, -1, -1, 0.0)
            for j in range(m):
                if len(cuts[j]) == 0 or len(rows) < 2:
                    continue
                gs = np.bincount(binned[rows, j], g[rows], width).cumsum()
                hs = np.bincount(binned[rows, j], h[rows], width).cumsum()
                gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                vl, vr = np.clip(-gl / (hl + ridge), low[k], high[k]), np.clip(-gr / (hr + ridge), low[k], high[k])
                gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2)
                ok = (hl >= least) & (hr >= least) & ((sign[j] == 0) | (sign[j] * (vr - vl) >= 0))
                gain = np.where(ok, gain, -np.inf)[: len(cuts[j])]
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], j, at, (vl[at] + vr[at]) / 2)
            left, right = 2 * k + 1, 2 * k + 2
            low[[left, right]], high[[left, right]] = low[k], high[k]
            if best[1] < 0:  # no split: all rows go left, and the right side is never reached
                node[rows] = left
                continue
            _, j, at, middle = best
            out.feature[r, k], out.threshold[r, k] = j, cuts[j][at]
            if sign[j] < 0:
                low[left], high[right] = max(low[left], middle), min(high[right], middle)
            node[rows] = np.where(binned[rows, j] > at, right, left)
        gl = np.bincount(node - inner, g, leaves)
        hl = np.bincount(node - inner, h, leaves)
        out.leaf[r] = rate * np.clip(-gl / (hl + ridge), low[inner:], high[inner:])
        z += out.leaf[r][node - inner]
    return out


#: The trees reject a document below this probability of good quality.
KEEP_FROM = 0.3
QUALITY = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"


def _verdicts(texts: pa.Array, model: Trees, keep_from: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    counts, x = statistics(texts)
    failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
    score = sigmoid(model.raw(x))
    return counts, failed, ~failed & (score >= keep_from), score


def apply_rules(docs: DataFrame, model: Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: the counts, whether a base rule fails, and whether the document is kept.

    Null text counts as no words. Repeated rows give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, failed, kept, score = _verdicts(text_of(batch), model, keep_from)
            columns = {"doc_id": batch.column("doc_id")} | {c: counts[:, i] for i, c in enumerate(COUNTS)}
            yield pa.RecordBatch.from_pydict(columns | {"base_failed": failed, "kept": kept, "score": score})

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, QUALITY)


def keep_good(docs: DataFrame, model: Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that the rules keep, all columns unchanged.

    Null, empty and short texts fail the base rules and go; repeated rows stay or go together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(_verdicts(text_of(batch), model, keep_from)[2]))

    return small_batches(docs).mapInArrow(run, docs.schema)


def train_rules(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Trees:
    """Trees of the labelled documents. Null ids and labels teach nothing, repeated labels of an id count once;
    without labels every score is 0.5. Of splits with the same gain the first feature's first cut is taken."""
    return fit_trees(*feature_rows(docs, labels, limit))


# ---- additive model


@dataclass
class Additive:
    """Lookup tables over the bins of single features and of pairs of features."""

    cuts: list[np.ndarray]
    single: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, (c, t) in enumerate(zip(self.cuts, self.single, strict=True)):
            total += t[np.searchsorted(c, x[:, j], side="left")]
        coarse = {j: np.searchsorted(self.pair_cuts[j], x[:, j], side="left") for a, b, _ in self.pairs for j in (a, b)}
        for a, b, t in self.pairs:
            total += t[coarse[a], coarse[b]]
        return total


def _step(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int, float, float]:
    """Best single cut of ordered bins: gain, place, left value, right value."""
    gs, hs = g.cumsum(), h.cumsum()
    gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
    at = int(gain.argmax())
    return float(gain[at]), at, -gl[at] / (hl[at] + ridge), -gr[at] / (hr[at] + ridge)


def _shallow(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of at most four leaves over ordered bins, as a value for each bin."""
    out = np.zeros(len(g))
    if len(g) < 2:
        return out
    _, at, left, right = _step(g, h, ridge)
    for a, b, value in ((0, at + 1, left), (at + 1, len(g), right)):
        out[a:b] = value
        if b - a > 1:
            gain, k, lo, hi = _step(g[a:b], h[a:b], ridge)
            if gain > 0:
                out[a : a + k + 1], out[a + k + 1 : b] = lo, hi
    return out


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.1, bins: int = 32, pair_bins: int = 8, n_pairs: int = 10, pair_rounds: int = 40, ridge: float = 4.0) -> Additive:
    """Cyclic boosting: each round visits every feature with one shallow tree; then pairs, the same way.

    Pairs are those whose best cross of two cuts lowers the loss of the single terms most. A pair's tree
    cuts one feature once and each side by the other feature.
    """
    n, m = x.shape
    cuts = [cut_points(x[:, j], bins) for j in range(m)]
    pair_cuts = [cut_points(x[:, j], pair_bins) for j in range(m)]
    model = Additive(cuts, [np.zeros(len(c) + 1) for c in cuts], pair_cuts, [], base_rate(y))
    if not n:
        return model
    fine = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
    coarse = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(pair_cuts)]
    z = np.full(n, model.start)
    for _ in range(rounds):
        for j in range(m):
            p = sigmoid(z)
            size = len(cuts[j]) + 1
            update = rate * _shallow(np.bincount(fine[j], p - y, size), np.bincount(fine[j], p * (1 - p), size), ridge)
            model.single[j] += update
            z += update[fine[j]]

    def cross(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p, wide = sigmoid(z), len(pair_cuts[b]) + 1
        size = (len(pair_cuts[a]) + 1) * wide
        key = coarse[a] * wide + coarse[b]
        return np.bincount(key, p - y, size).reshape(-1, wide), np.bincount(key, p * (1 - p), size).reshape(-1, wide)

    def tree(a: int, b: int) -> tuple[float, np.ndarray]:
        g, h = cross(a, b)
        best, out = 0.0, np.zeros(g.shape)
        for k in range(1, len(g)):
            gain, values = 0.0, np.zeros(g.shape)
            for part in (slice(0, k), slice(k, len(g))):
                gp, hp = g[part].sum(0), h[part].sum(0)
                values[part] = -gp.sum() / (hp.sum() + ridge)
                gain += gp.sum() ** 2 / (hp.sum() + ridge)
                if len(gp) > 1:
                    more, at, lo, hi = _step(gp, hp, ridge)
                    if more > 0:
                        gain += more
                        values[part, : at + 1], values[part, at + 1 :] = lo, hi
            if gain > best:
                best, out = gain, values
        return best, out

    ranked = sorted(((tree(a, b)[0], a, b) for a in range(m) for b in range(a + 1, m)), reverse=True)[:n_pairs]
    model.pairs = [(a, b, np.zeros((len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1))) for _, a, b in ranked]
    for _ in range(pair_rounds):
        for a, b, t in model.pairs:
            update = rate * tree(a, b)[1]
            t += update
            z += update[coarse[a], coarse[b]]
    return model


def train_additive(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Additive:
    """Lookup tables of the labelled documents. Null ids and labels teach nothing, repeated labels of an id count
    once; without labels every score is 0.5. Of cuts with the same gain the first is taken."""
    return fit_additive(*feature_rows(docs, labels, limit))


SCORED = "doc_id long, score double"


def score_quality(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id and the probability of good quality of each document; null and empty texts have the score of no words.

    Repeated rows give a row each, equal texts equal scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": sigmoid(model.raw(statistics(text_of(batch))[1]))})

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)
