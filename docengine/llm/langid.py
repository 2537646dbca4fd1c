"""Language identification by a bidirectional gated recurrent network over bytes.

The whole text is cut into windows of WINDOW bytes, each read forwards and backwards from a zero state;
every position gets probabilities of the languages, and a document's are the mean of its positions' log
probabilities. Gates use the hard sigmoid. Training is backpropagation through time, in numpy, on a
bounded sample of documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import slices, small_batches, text_of, written

WINDOW = 128
HIDDEN = 10
#: At most so many documents (LEAST of each language, if these are more), and so many windows of them, are fitted on the driver.
FIT_DOCS = 1600
LEAST = 20
#: Times as many documents as are wanted of a language are put in order; that fewer than wanted are among them does not happen.
SPARE = 4
#: Counts of more languages than this are joined by a shuffle.
MOST = 100_000
FIT_WINDOWS = 6000
FIT_EACH = 32
FIT_BYTES = 64
#: Windows that are scored side by side.
SIDE_BY_SIDE = 2048
UNKNOWN = "und"


@dataclass
class Network:
    """Per direction: byte weights 256 x 3H (update, reset, candidate), recurrent weights H x 2H and H x H."""

    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        weights = {}
        for d in "fb":
            weights |= {d + "x": draw(256, 3 * hidden), d + "g": draw(hidden, 2 * hidden), d + "c": draw(hidden, hidden), d + "o": draw(hidden, len(languages))}
        return cls(languages, weights | {"bias": np.zeros(len(languages), np.float32)})

    def direction(self, data: np.ndarray, d: str, keep: bool = False, inside: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """States T x B x H over T x B bytes, zero outside of `inside`; with keep also what backpropagation needs."""
        x, g, c = (self.weights[d + k] for k in "xgc")
        size = c.shape[0]
        steps, width = data.shape
        states = np.empty((steps, width, size), np.float32)
        h = np.zeros((width, size), np.float32)
        tape = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = x[data[t]]
            gates = h @ g
            gates += a[:, : 2 * size]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            u, r = gates[:, :size], gates[:, size:]
            n = (r * h) @ c
            n += a[:, 2 * size :]
            np.tanh(n, out=n)
            new = h - n
            new *= u
            new += n
            if inside is not None:
                new *= inside[t][:, None]
            if keep:
                tape.append((t, h, u, r, n))
            states[t] = h = new
        return states, tape

    def logits(self, data: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """T x B x languages: the label scores of every position."""
        out = self.direction(data, "f")[0] @ self.weights["fo"]
        out += self.direction(data, "b", inside=inside)[0] @ self.weights["bo"]
        out += self.weights["bias"]
        return out

    def gradients(self, data: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the positions of mask (T x B), and its gradients."""
        grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
        both = {d: self.direction(data, d, keep=True, inside=mask) for d in "fb"}
        z = sum(both[d][0] @ self.weights[d + "o"] for d in "fb") + self.weights["bias"]
        z = z - z.max(2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(2, keepdims=True)
        total = max(1, int(mask.sum()))
        columns = np.arange(len(label))
        loss = -float((np.log(p[:, columns, label] + 1e-9) * mask).sum()) / total
        p[:, columns, label] -= 1
        dz = (p * mask[:, :, None] / total).astype(np.float32)
        grads["bias"] = dz.sum((0, 1))
        for d in "fb":
            states, tape = both[d]
            x, g, c, o = (self.weights[d + k] for k in "xgco")
            size = c.shape[0]
            grads[d + "o"] = np.tensordot(states, dz, ((0, 1), (0, 1)))
            dh_next = np.zeros(states.shape[1:], np.float32)
            da_all = np.empty((*data.shape, 3 * size), np.float32)
            for t, h, u, r, n in reversed(tape):
                dh = (dz[t] @ o.T + dh_next) * mask[t][:, None]
                dn = dh * (1 - u) * (1 - n * n)
                du = dh * (h - n) * 0.25 * ((u > 0) & (u < 1))
                drh = dn @ c.T
                dr = drh * h * 0.25 * ((r > 0) & (r < 1))
                dg = np.concatenate([du, dr], 1)
                grads[d + "g"] += h.T @ dg
                grads[d + "c"] += (r * h).T @ dn
                dh_next = dh * u + drh * r + dg @ g.T
                da_all[t] = np.concatenate([dg, dn], 1)
            flat, codes = da_all.reshape(-1, 3 * size), data.reshape(-1)
            order = np.argsort(codes, kind="stable")
            present, first = np.unique(codes[order], return_index=True)
            grads[d + "x"][present] = np.add.reduceat(flat[order], first, 0)
        return loss, grads


def windows(data: np.ndarray, bounds: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes as rows of `size` bytes (0 fills the last), the text of each row, and its length."""
    length = np.diff(bounds)
    rows = -(-length // size)
    text = np.repeat(np.arange(len(length)), rows)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(rows) - rows, rows)
    start = bounds[:-1][text] + nth * size
    filled = np.minimum(size, bounds[1:][text] - start)
    at = start[:, None] + np.arange(size)
    inside = np.arange(size) < filled[:, None]
    out = np.where(inside, data[np.minimum(at, max(0, len(data) - 1))], 0).astype(np.uint8) if len(data) else np.zeros((0, size), np.uint8)
    return out, text, filled


def fit(parts: list[bytes], labels: list[str], epochs: int = 6, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam over windows of FIT_BYTES bytes or less; some are cut short, so that short texts are known too."""
    languages = sorted(set(labels)) or [UNKNOWN]
    net = Network.new(languages, seed=seed)
    rng = np.random.default_rng(seed)
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in parts])]).astype(np.int64)
    rows, text, filled = windows(np.frombuffer(b"".join(parts), np.uint8), bounds, size=FIT_BYTES)
    if not len(rows):
        return net
    label = np.array([languages.index(x) for x in labels])[text]
    if len(rows) > FIT_WINDOWS:  # as many of each language, as far as there are
        pick = rng.permutation(len(rows))
        order = np.argsort(_nth(label[pick]), kind="stable")
        pick = pick[order[:FIT_WINDOWS]]
        rows, filled, label = rows[pick], filled[pick], label[pick]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.weights.items()}
    step, steps = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        short = np.where(rng.random(len(rows)) < 0.3, rng.integers(2, 20, len(rows)), FIT_BYTES)
        for part in np.array_split(rng.permutation(len(rows)), -(-len(rows) // batch)):
            n = np.minimum(filled[part], short[part])
            mask = np.arange(FIT_BYTES)[:, None] < n
            _, grads = net.gradients(np.where(mask, rows[part].T, 0), mask, label[part])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            speed = rate * (1 - step / (steps + 1))
            for k, g in grads.items():
                g = g * min(1, 1 / (norm + 1e-9))
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.weights[k] -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _nth(label: np.ndarray) -> list[int]:
    """How many of the same label stand before each."""
    seen: Counter = Counter()
    out = []
    for x in label.tolist():
        out.append(seen[x])
        seen[x] += 1
    return out


def sample(docs: DataFrame, limit: int = FIT_DOCS, each: int = FIT_EACH) -> tuple[list[bytes], list[str]]:
    """Windows of documents with a language and text, as many of each language, chosen by a hash of the id.

    At most `limit` documents, or LEAST of each language if these are more, so that rare languages are learned
    too. A document gives at most `each` windows, evenly spaced over its whole text. Repeated rows may be chosen
    more than once; ties of the hash go to the smaller id.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    counts = written(known.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    languages = counts.count()
    own = max(LEAST, limit // max(1, languages))
    # of a large language only so many hashes are low enough to be among the first, which keeps what is put in order small
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < F.lit(float(1 << 32)) * SPARE * own / F.col("rows")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)), "doc_id"))
    ids = known.select("doc_id", "lang").join(F.broadcast(counts) if languages <= MOST else counts, "lang").where(low).select("doc_id", "lang", nth.alias("nth"))
    ids = ids.where(F.col("nth") <= own).select("doc_id", "lang").distinct()
    most = max(1, languages) * own * each

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                data = text.encode()
                n = -(-len(data) // FIT_BYTES)
                at = sorted({i * n // each for i in range(each)}) if n > each else range(n)
                parts = [data[i * FIT_BYTES : (i + 1) * FIT_BYTES] for i in at]
                yield pa.RecordBatch.from_pydict({"data": pa.array(parts, pa.binary()), "lang": pa.array([lang] * len(parts), pa.string())})

    rows = small_batches(known).join(F.broadcast(ids), ["doc_id", "lang"]).mapInArrow(cut, "data binary, lang string").limit(most).collect()
    rows = sorted((bytes(r.data), r.lang) for r in rows)
    return [r[0] for r in rows], [r[1] for r in rows]


def train(docs: DataFrame, limit: int = FIT_DOCS) -> Network:
    """A network of all languages of docs (doc_id, lang, text). Rows without an id, a language or text teach nothing;
    without any row the network knows `und` alone. The fit does not depend on the order of rows."""
    return fit(*sample(docs, limit))


def pooled(net: Network, texts: pa.Array) -> np.ndarray:
    """Probabilities of the languages for each text: the mean log probabilities of all of its positions."""
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64, n + 1)
    rows, text, filled = windows(np.frombuffer(texts.buffers()[2] or b"", np.uint8), bounds)
    total = np.zeros((n, len(net.languages)))
    order = np.argsort(-filled, kind="stable")  # windows of like length side by side
    for at in range(0, len(rows), SIDE_BY_SIDE):
        part = order[at : at + SIDE_BY_SIDE]
        longest = int(filled[part].max())
        inside = np.arange(longest)[:, None] < filled[part] if filled[part].min() < longest else None
        z = net.logits(np.ascontiguousarray(rows[part, :longest].T), inside)
        z -= z.max(2, keepdims=True)
        z -= np.log(np.exp(z).sum(2, keepdims=True))
        if inside is not None:
            z *= inside[:, :, None]
        np.add.at(total, text[part], z.sum(0))
    mean = total / np.maximum(np.diff(bounds), 1)[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


PREDICTED = "doc_id long, lang_pred string, score double"


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, the likeliest language and its probability; `und` where text is null or has no letter, with score 0.

    Ties go to the language first in the alphabet. Repeated rows give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            coded = text_of(batch).dictionary_encode()  # copies of a text are read once
            each = coded.dictionary.cast(pa.large_string())
            place = coded.indices.to_numpy()
            p = pooled(net, each)[place]
            letters = pc.match_substring_regex(each, "\\pL").to_numpy(zero_copy_only=False)[place] & (len(net.languages) > 0)
            best = p.argmax(1)
            names = [net.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": np.where(letters, p.max(1), 0.0)})

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PREDICTED)
