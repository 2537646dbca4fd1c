import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docengine.llm import ppm
from docengine.llm.common import held_out
from docengine.llm.ppm import Model, counted, grams, score_texts

TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "", "The  THE the\n\tthé é", "x", "abracadabra " * 50]


def trie(texts, order):
    seen = Counter()
    for t in texts:
        data = b"\0" * order + t.encode().lower() + b"\0"
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen[data[i - k : i + 1]] += 1
    return seen


def brute(seen, history, symbol, order):
    """log10 probability by method C with exclusion, symbol by symbol."""
    gone, total = set(), 0.0
    for k in range(order, -1, -1):
        context = history[len(history) - k :]
        symbols = {s: seen[context + bytes([s])] for s in range(256) if seen.get(context + bytes([s]))}
        if not symbols:
            continue
        left = {s: n for s, n in symbols.items() if s not in gone}
        if not left:
            continue
        both = sum(left.values()) + len(left)
        if symbol in left:
            return total + math.log10(left[symbol] / both)
        total += math.log10(len(left) / both)
        gone |= set(left)
    return total - math.log10(256 - len(gone))


def built(texts, order):
    return Model(*counted(grams(pa.array([t.lower() for t in texts], pa.large_string()), order)[0]), order)


@pytest.mark.parametrize("order", [1, 2, 5])
def test_equal_to_brute_force(order):
    model, seen = built(TEXTS, order), trie(TEXTS, order)
    rng = np.random.default_rng(1)
    keys, want = [], []
    for _ in range(300):
        history = bytes(rng.choice(list(b"the cadog\xc3\xa9\0z"), order).tolist())
        symbol = int(rng.choice(list(b"the cadog\0zQ")))
        keys.append(int.from_bytes(history + bytes([symbol]), "big"))
        want.append(brute(seen, history, symbol, order))
    keys = np.array(keys, np.uint64)
    assert np.allclose(model.spelled(keys), want, atol=1e-5) and np.allclose(model.score(keys), want, atol=1e-5)
    context = np.uint64(int.from_bytes(b"the "[-order:], "big") << 8)
    assert abs((10 ** model.spelled(context + np.arange(256, dtype=np.uint64))).sum() - 1) < 1e-5


def test_grams():
    key, bounds = grams(pa.array(["ab", "", "c"], pa.large_string()), 2)
    assert [int(k).to_bytes(3, "big") for k in key] == [b"\0\0a", b"\0ab", b"ab\0", b"\0\0\0", b"\0\0c", b"\0c\0"] and bounds.tolist() == [0, 3, 4, 6]


def base(rows, training):
    def tokens(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]

    count = Counter(w for i, t in rows if training(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return [(i, len(x := tokens(t)), sum(count[w] > 0 for w in x), n, sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in x)) for i, t in rows]


@pytest.mark.parametrize("bits", [21, 5])
def test_scores(spark, odd_docs, monkeypatch, bits):
    monkeypatch.setattr(ppm, "HEAD_BITS", bits)
    import zlib

    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(TEXTS * 4)], "doc_id long, text string"))
    got = score_texts(docs, ~held_out(F.col("doc_id"), 7, 2)).collect()
    rows = [tuple(r) for r in docs.collect()]
    want = base(rows, lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2)
    key = lambda r: (str(r[0]), r[1], r[4])
    assert len(got) == len(want)
    for a, b in zip(sorted(([r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score] for r in got), key=key), sorted(want, key=key), strict=True):
        assert tuple(a[:4]) == b[:4] and a[4] == pytest.approx(b[4], abs=1e-6)
    model = trie([t or "" for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2], ppm.ORDER) if bits == 21 else None
    for r in got if model else []:
        text = dict(rows)[r.doc_id] or ""
        if len(text) < 100:
            data = b"\0" * ppm.ORDER + text.lower().encode() + b"\0"
            total = sum(brute(model, data[: i], data[i], ppm.ORDER) for i in range(ppm.ORDER, len(data)))
            assert r.score == pytest.approx(total, abs=1e-3), r


def test_empty_and_lower_order(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(none, F.lit(True)).count() == 0
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    unseen = score_texts(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 and math.isfinite(r.base_score) for r in unseen)
    monkeypatch.setattr(ppm, "MOST_LEAVES", 60)
    model = ppm.train(ppm.corpus_counts(docs))
    assert model.order < ppm.ORDER and np.allclose(model.spelled(np.arange(97, 110, dtype=np.uint64)), built(TEXTS, model.order).spelled(np.arange(97, 110, dtype=np.uint64)))


@pytest.mark.parametrize("bits", [22, 4])
def test_scores_do_not_depend_on_the_number_of_strings(spark, odd_docs, monkeypatch, bits):
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate([*TEXTS, "zzyzx unseen", "the catalogue"] * 3)], "doc_id long, text string"))
    fold = ~held_out(F.col("doc_id"), 7, 2)
    key = lambda r: (str(r.doc_id), r.n_tokens, r.base_score, r.score)
    want = sorted(score_texts(docs, fold).collect(), key=key)
    monkeypatch.setattr(ppm, "MOST_LEAVES", 60)
    monkeypatch.setattr(ppm, "NEAR_BITS", bits)
    monkeypatch.setattr(ppm, "HEAD_BITS", bits)
    got = sorted(score_texts(docs, fold).collect(), key=key)
    assert ppm.train(ppm.corpus_counts(docs)).order < ppm.ORDER and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert (a.doc_id, a.n_tokens, a.n_known) == (b.doc_id, b.n_tokens, b.n_known) and a.base_score == pytest.approx(b.base_score, abs=1e-6)
        assert a.score == pytest.approx(b.score, rel=1e-5), a


def test_groups_with_a_lower_model():
    """Levels built from one group after another cost what the whole model costs."""
    keys, counts = counted(grams(pa.array([t.lower() for t in TEXTS], pa.large_string()), ppm.ORDER)[0])
    whole = Model(keys, counts)
    for order in (1, 2, 4):
        low = Model(*counted(keys & ppm._low(order + 1), counts), order)
        group = (keys >> np.uint64(8)) & ppm._low(order + 1)
        for g in np.unique(group):
            part = Model(keys[group == g], counts[group == g], ppm.ORDER, low)
            asked = np.unique(np.concatenate([keys[group == g], keys[group == g] ^ np.uint64(3), keys[group == g] ^ np.uint64(1 << 40)]))
            assert np.allclose(part.spelled(asked), whole.spelled(asked), atol=1e-5)


def shuffled_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("pending", [1_000_000, 700])
def test_counts_cross_the_shuffle_by_bucket(spark, monkeypatch, pending):
    """As rows of their own the counts filled the executors' heaps."""
    monkeypatch.setattr(ppm, "PENDING", pending)
    monkeypatch.setattr(ppm, "BUCKET_BITS", 3, raising=False)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 3000, 400)) for _ in range(12)]
    docs = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string").repartition(3).localCheckpoint()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    before = shuffled_rows(spark)
    rows = ppm.corpus_counts(docs).collect()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    moved = shuffled_rows(spark) - before
    strings, n = counted(grams(pa.array([*texts, "", ""], pa.large_string()))[0])
    words = Counter(ppm.xxhash.xxh3_64_intdigest(w) for t in texts for w in t.split())
    got = {kind: {np.uint64(r.key & (1 << 64) - 1): r.n for r in rows if r.kind == kind} for kind in (ppm.GRAM, ppm.WORD, ppm.TEXTS)}
    assert len(rows) == sum(map(len, got.values())), "a key in two rows"
    assert got == {ppm.GRAM: dict(zip(strings, n, strict=True)), ppm.WORD: words, ppm.TEXTS: {0: 14}}
    if pending > len(strings):
        assert 0 < moved <= 3 * (2 * 8 + 1) < len(rows)


def test_memory_of_a_slice():
    """Two workers hold a slice each, beside an executor's heap."""
    rng = np.random.default_rng(3)
    text = pa.array(["".join(rng.choice(list("etaoin shrdlu"), 5000)) for _ in range(20)] * 40, pa.large_string())
    model = built(text.slice(0, 5).to_pylist(), ppm.ORDER)
    model.score(np.zeros(1, np.uint64))
    tracemalloc.start()
    for batch in ppm.slices(iter([pa.RecordBatch.from_pydict({"text": text})]), size=ppm.SLICE):
        key, _ = grams(ppm._lowered(batch))
        model.score(key)
        counted(key)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
