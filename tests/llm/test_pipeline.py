import numpy as np
import pytest

pytest.importorskip("tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import pyarrow as pa  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_decontaminate import brute as brute_leaks  # noqa: E402
from test_neardup import brute_classes  # noqa: E402

from docengine.llm import quality  # noqa: E402
from docengine.llm.queries import tokenizer  # noqa: E402
from docengine.llm.secrets import spans  # noqa: E402
from docengine.llm.stats import brute_counts, statistics  # noqa: E402


def fixture():
    rng = np.random.default_rng(9)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000)]
    items = [" ".join(rng.choice(words, 30)) for _ in range(4)]
    rows = []
    for i in range(60):
        text = list(rng.choice(words, 120))
        if i % 10 == 3:
            text[20:20] = items[i % 4].split()
        if i % 10 == 5:
            text[7:7] = ["token", "=", "Xk29Fj3lsQ8z"]
        rows.append((i, " ".join(text)))
    for i in range(60, 90):
        text = rows[i - 60][1].split()
        if i % 3:
            text[50] = "other"
        rows.append((i, " ".join(text)))
    rows += [(i, "%%% $$$ " * 80) for i in range(90, 110)] + [(110, "too short"), (111, None), (112, "")]
    labels = [(i, int(i < 90), 0) for i in range(0, 110)]
    return rows, labels, list(enumerate(items))


def test_equal_to_plain_version(spark, tmp_path):
    rows, labels, items = fixture()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # quality, by the plain counts and the fitted trees
    x = statistics(pa.array([t or "" for _, t in rows], pa.large_string()))[1]
    y = {i: q for i, q, _ in labels}
    known = [k for k, (i, _) in enumerate(rows) if i in y]
    model = quality.fit_trees(x[known], np.array([y[rows[k][0]] for k in known], float))
    score = quality.sigmoid(model.raw(x))
    kept = []
    for k, (i, t) in enumerate(rows):
        c = brute_counts(t or "")
        if c[0] >= 50 and 100 * c[4] <= 50 * c[0] and score[k] >= quality.KEEP_FROM:
            kept.append((i, t))
    assert {i for i, _ in kept} == set(range(90))
    # one of each class, by all pairs
    label = brute_classes(kept)
    kept = [r for k, r in enumerate(kept) if label[k] == k]
    # leaks, along all diagonals
    leaks = {i for i, _ in brute_leaks([t for _, t in kept], [t for _, t in items])}
    kept = [r for k, r in enumerate(kept) if k not in leaks]
    assert 40 < len(kept) < 60
    # secrets
    clean = []
    for i, t in kept:
        for a, b, _ in reversed(spans(t, vocabulary=tokenizer("word_bpe_49k.json"))):
            t = t[:a] + "[SECRET]" + t[b:]
        clean.append((i, t))
    assert any("[SECRET]" in t for _, t in clean)
    import tokenizers

    coder = tokenizers.Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean}
    total: dict[int, int] = {}
    for p in got:
        assert p.doc_tokens == want[p.doc_id]
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == want


def test_stages_keep_columns_and_odd_rows(spark, odd_docs, tmp_path):
    rows, labels, items = fixture()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_docs, odd_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert (out.columns == docs.columns) == (name != "packing")
            assert out.agg(F.count("*")).first()[0] <= (9 if name != "packing" else 200)
