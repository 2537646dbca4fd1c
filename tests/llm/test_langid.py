import numpy as np
import pyarrow as pa

from docengine.llm import langid
from docengine.llm.langid import Network, fit, pooled, predict, train


def test_gradients():
    net = Network.new(["a", "b", "c"], 4)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(0)
    data, label = rng.integers(60, 70, (6, 3)).astype(np.uint8), np.array([0, 2, 1])
    mask = np.arange(6)[:, None] < np.array([6, 4, 1])
    _, grads = net.gradients(data, mask, label)
    for k, w in net.weights.items():
        at = tuple(rng.integers(0, s) for s in w.shape) if k[1:] != "x" else (int(data[0, 0]), 3)
        keep, eps = w[at], 1e-2
        w[at] = keep + eps
        up = net.gradients(data, mask, label)[0]
        w[at] = keep - eps
        down = net.gradients(data, mask, label)[0]
        w[at] = keep
        assert abs((up - down) / (2 * eps) - grads[k][at]) < 2e-4 + 0.05 * abs(grads[k][at]), k


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join("".join(rng.choice(list(s), rng.integers(2, 7))) for _ in range(12)) for s in ("abcdeé", "efghiö") for _ in range(n)], ["x"] * n + ["y"] * n


def test_learns_and_pools_every_position():
    a, labels = texts(150, 1)
    net = fit([t.encode() for t in a], labels)
    b, want = texts(100, 2)
    p = pooled(net, pa.array(b, pa.large_string()))
    assert np.mean([net.languages[i] == w for i, w in zip(p.argmax(1), want, strict=True)]) > 0.95
    long = pa.array([b[0] * 30], pa.large_string())
    data = (b[0] * 30).encode()
    total = np.zeros(2)
    for i in range(0, len(data), langid.WINDOW):
        z = net.logits(np.frombuffer(data[i : i + langid.WINDOW], np.uint8)[:, None])[:, 0]
        total += (z - np.log(np.exp(z).sum(1, keepdims=True))).sum(0)
    q = np.exp(total / len(data))
    assert np.allclose(pooled(net, long)[0], q / q.sum(), atol=1e-4)


def test_odd_rows(spark, odd_docs):
    a, labels = texts(40, 3)
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(a, labels, strict=True))], "doc_id long, text string, lang string")
    net = train(docs)
    got = predict(odd_docs, net).collect()
    assert len(got) == 9
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3, 7)) and by_id[4].lang_pred in ("x", "y")
    none = predict(docs, train(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert predict(docs.limit(0), net).count() == 0 and predict(odd_docs, train(odd_docs)).count() == 9


def test_every_position_equals_plain_recurrence():
    """Both directions byte by byte, and the mean log probability of all positions, written out."""
    rng = np.random.default_rng(4)
    net = Network.new(["a", "b", "c"], 5)
    names = ["", "x", "été", "abc " * 80, "日本語のテキスト", "z" * langid.WINDOW, "y" * (langid.WINDOW + 1)] + ["".join(rng.choice(list("abcé \n"), 40)) for _ in range(5)]
    got = pooled(net, pa.array(names, pa.large_string()))

    def states(data, d):
        x, g, c = (net.weights[d + k].astype(float) for k in "xgc")
        h, out = [0.0] * 5, []
        for byte in data:
            gate = [min(1, max(0, 0.25 * (sum(h[i] * g[i][j] for i in range(5)) + x[byte][j]) + 0.5)) for j in range(10)]
            new = [np.tanh(sum(gate[5 + i] * h[i] * c[i][j] for i in range(5)) + x[byte][10 + j]) for j in range(5)]
            h = [gate[j] * h[j] + (1 - gate[j]) * new[j] for j in range(5)]
            out.append(h)
        return out

    for text, p in zip(names, got, strict=True):
        data, total = text.encode(), np.zeros(3)
        for at in range(0, len(data), langid.WINDOW):
            part = data[at : at + langid.WINDOW]
            for f, b in zip(states(part, "f"), states(part[::-1], "b")[::-1], strict=True):
                z = np.array(f) @ net.weights["fo"] + np.array(b) @ net.weights["bo"] + net.weights["bias"]
                total += z - np.log(np.exp(z).sum())
        q = np.exp(total / max(1, len(data)))
        assert np.allclose(p, q / q.sum(), atol=1e-4)


def test_rare_languages_are_learned(spark):
    a, labels = texts(300, 5)
    rows = list(enumerate(zip(a, labels, strict=True))) + [(1000 + i, ("zulu " * 8, "zz")) for i in range(3)]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in rows], "doc_id long, text string, lang string")
    assert set(langid.sample(docs, limit=30)[1]) == {"x", "y", "zz"}
    parts, names = langid.sample(docs, limit=300, each=1)
    assert names.count("x") == names.count("y") == 100 and names.count("zz") == 3 and len(parts) == len(names)


def test_ties_go_to_the_first_language(spark):
    net = Network.new(["a", "b"], 3)
    net.weights = {k: np.zeros_like(v) for k, v in net.weights.items()}
    rows = predict(spark.createDataFrame([(1, "text"), (1, "text")], "doc_id long, text string"), net).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("a", 0.5)] * 2
