"""Each registered query over a small folder of tables: columns of its contract, one row for each document, held-out marks, digests."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from docengine.llm.queries import QUERIES  # noqa: E402

COLUMNS = {
    "op1_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op2_decontamination": "doc_id bigint, item_id bigint",
    "op3_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op5_licenses": "doc_id bigint, n_sentences bigint, sentences string, licenses string",
    "op6_language_model": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op7_near_duplicates": "doc_id bigint, class_id bigint",
    "op8_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
}
FOLDS = {"op3_quality": (5, 0), "op6_language_model": (7, 2), "op10_language": (4, 2)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdeilmnorstu"), n)) for n in rng.integers(2, 8, 400)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(60, 120)))) + ".", "en" if i % 2 else "fr", "s", 1) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "en", "s", 0), (62, "%%% " * 80, "en", "s", 320), (63, rows[3][1], "en", "s", 1), (64, 'token = "Ab3dEf9h" ' + rows[5][1], "fr", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i != 62), 0) for i in range(64)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[7][1].split()[5:40]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


@pytest.fixture(scope="module")
def results(spark, folder):
    return {name: QUERIES[name](spark, folder[0]) for name in QUERIES}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(folder, results, name):
    want = COLUMNS[name].split(", ")
    assert [f"{c} {t}" for c, t in results[name].dtypes][: len(want)] == want
    rows = results[name].collect()
    if name == "op2_decontamination":
        assert {(r.doc_id, r.item_id) for r in rows} == {(7, 1)}
    elif name != "op4_packing":
        assert sorted(r.doc_id for r in rows) == list(range(65))
    if name in FOLDS:
        n, fold = FOLDS[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == fold) for r in rows)


def test_quality(results):
    rows = results["op3_quality"].collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    rules = {r.doc_id: r for r in results["op8_quality_rules"].collect()}
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rules.values())
    assert not any(r.kept and r.base_failed for r in rules.values()) and not rules[62].kept and rules[7].kept


def test_language_model_base(folder, results):
    texts = {i: re.findall("[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t, *_ in folder[1]}
    learned = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in learned for w in texts[i])
    total, distinct = sum(count.values()) + len(learned), len(count) + 1
    for r in results["op6_language_model"].collect():
        each = [count[w] for w in texts[r.doc_id]] + [len(learned)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(each), sum(c > 0 for c in each), total)
        assert r.base_score == pytest.approx(sum(log10((c + 1) / (total + (distinct + 1))) for c in each))


def test_duplicates_and_language(results):
    classes = {r.doc_id: r.class_id for r in results["op7_near_duplicates"].collect()}
    assert classes[63] == 3 and classes[61] == classes[60] == 60 and classes[64] == 5 and len(set(classes.values())) == 62
    langs = {r.doc_id: r for r in results["op10_language"].collect()}
    assert langs[60].lang_pred == langs[61].lang_pred == langs[62].lang_pred == "und" and {r.lang_pred for r in langs.values()} <= {"en", "fr", "und"}
    assert all(0 <= r.score <= 1 for r in langs.values())


def test_tokens(results):
    files = sorted(results["op9_token_files"].collect(), key=lambda r: r.doc_id)
    assert [r.start for r in files] == [sum(x.n_tokens for x in files[:i]) for i in range(len(files))]
    pieces = results["op4_packing"].collect()
    assert {r.doc_id for r in pieces} == set(range(65)) and sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
