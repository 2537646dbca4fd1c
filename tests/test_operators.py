import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.operators import evaluation, joins, quality, search


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "보안 관리 시스템"), (2, "품질 보증 보증"), (3, ""), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "보증"), (2, "보안 관리"), (3, "없는말"), (4, None)], "qid long, text string")
    got = {(r.qid, r.doc_id): r.score for r in search.bm25(docs, asked, 2).collect()}
    idf = math.log(1 + (4 - 1 + 0.5) / 1.5)
    want = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 1.5))
    assert set(got) == {(1, 2), (2, 1)} and got[1, 2] == pytest.approx(want, abs=1e-6)
    assert search.bm25(docs.limit(0), asked).count() == 0 and search.bm25(docs, asked.limit(0)).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], "doc_id long, embedding array<float>").repartition(5)
    asked = rows.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "qid")
    one = {tuple(r) for r in search.dense(rows, asked, 3).collect()}
    monkeypatch.setattr(search.blocks, "__defaults__", (2,))
    assert {tuple(r) for r in search.dense(rows, asked, 3).collect()} == one and len(one) == 18
    for metric in ("cosine", "l2"):
        top = search.dense(rows, asked, 1, metric=metric).collect()
        assert all(r.qid == r.doc_id for r in top)
    assert search.dense(rows.withColumn("embedding", F.lit(None).cast("array<float>")), asked).count() == 0


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 10, 2)], "qid long, doc_id long, rank int")
    got = {r.doc_id: (r.score, r["rank"]) for r in search.rank_fusion([(a, 0.7), (b, 0.3)], 5).collect()}
    assert got[10] == (round(0.7 / 61 + 0.3 / 62, 8), 1) and got[12][0] == round(0.3 / 61, 8) and got[11][1] == 2


def test_summary_and_groups(spark):
    rows = spark.createDataFrame([("q1", ["a", "a", "b"], ["b"], "x"), ("q2", ["c"], ["z"], None), ("q3", ["c"], [], "x")], "qid string, retrieved array<string>, gold array<string>, kind string")
    names = ["mrr@5", "recall@1", "top1"]
    scored = evaluation.retrieval_scores(rows, names)
    total = evaluation.summarize(scored, names).first()
    assert total.mrr_at_5 == 0.25 and total.num_rows == 2
    groups = {(r.group_key, r.group_value): r.num_rows for r in evaluation.summarize(scored, names, ["kind"]).collect()}
    assert groups == {("kind", "x"): 1, ("kind", "unknown"): 1, ("all", "all"): 2}
    assert {r.qid for r in evaluation.retrieval_failures(rows, 2).collect()} == {"q1", "q2", "q3"}
    assert evaluation.summarize(scored.limit(0), names).first().mrr_at_5 == 0
    with pytest.raises(ValueError):
        evaluation.metric("nothing@3", F.col("a"), F.col("b"))


def test_keywords(spark):
    rows = spark.createDataFrame([("계약 금액은 130,000,000원", [["130000000"], ["없음", "계약금액"], ["x"]]), ("a", []), (None, None)], "answer string, groups array<array<string>>")
    got = evaluation.keyword_scores(rows).collect()
    assert [round(r.keyword_recall, 3) for r in got] == [0.667, 0.0, 0.0] and got[0].missed_groups == [["x"]]


def test_efficiency(spark):
    rows = spark.createDataFrame([("1",), ("2",), ("x",), ("4",), ("3",), (None,), ("",)], "v string")
    r = evaluation.efficiency(rows, ["v"]).first()
    assert (r.n, r["mean"], r.total, r.p50, r.p95) == (4, 2.5, 10.0, 3.0, 4.0)


def test_nearest_ranks_equal_sorting(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 997)) for v in rng.choice(rng.normal(size=max(1, n // 3)), n)]
    rows += [(None, 7.0)] * 500
    df = spark.createDataFrame(rows, "kind string, v double")
    for bins in (100, 3):
        monkeypatch.setattr(evaluation, "BINS", bins)
        for r in evaluation.efficiency(df, ["v"], "kind").collect():
            own = sorted(v for k, v in rows if (k or "unknown") == r.kind)
            assert r.n == len(own) and (r.p50, r.p95) == (own[round((len(own) - 1) * 0.5)], own[round((len(own) - 1) * 0.95)])


def test_quotas():
    assert list(quality.quotas(20, "abc").values()) == [5, 7, 8] and list(quality.quotas(30, "abc").values()) == [8, 11, 11] and list(quality.quotas(10, "abc").values()) == [4, 3, 3]


def test_sample_tops_up(spark):
    rows = spark.createDataFrame([(i, "a" if i < 2 else "b") for i in range(30)], "qid long, kind string")
    got = quality.balanced_sample(rows, 10, ["a", "b"]).collect()
    assert len(got) == 10 and sum(r.kind == "a" for r in got) == 2
    assert sorted(r.qid for r in got) == sorted(r.qid for r in quality.balanced_sample(rows.repartition(3), 10, ["a", "b"]).collect())


def test_fingerprint_changes(spark):
    rows = [(1, "a"), (2, "b"), (3, None)]
    make = lambda r: quality.fingerprint(spark.createDataFrame(r, "i long, t string"), "i", "t").first().digest
    assert make(rows) == make(rows[::-1]) != make([(1, "b"), (2, "a"), (3, None)]) and make(rows) != make([(1, "a"), (2, "b"), (3, "")])


def test_duplicates_and_first(spark, monkeypatch):
    docs = spark.createDataFrame([(3, "a b"), (1, "a  b"), (2, "c"), (4, None)], "doc_id long, text string")
    for hot in (1, 10):
        monkeypatch.setattr(quality, "HOT", hot)
        assert {(r.doc_id, r.copies) for r in quality.duplicates(docs).collect()} == {(1, 2), (3, 2)}
    assert {r.doc_id for r in quality.keep_first(docs).collect()} == {1, 2, 4}


def test_enrich_last_wins(spark):
    rows = spark.createDataFrame([("d1", "", "x"), ("d2", "own", None), ("d9", None, None)], "doc_id string, org string, other string")
    meta = spark.createDataFrame([("d1", "old", 1, 5), ("d1", "new", 2, 6), ("d2", "m", 3, 7)], "doc_id string, org string, ord int, budget int")
    got = {r.doc_id: (r.org, r.budget) for r in joins.enrich(rows, meta, "doc_id", ["org", "budget"], last="ord").collect()}
    assert got["d1"] == ("new", 6) and got["d2"] == ("own", 7) and got["d9"][1] is None


def test_names(spark):
    wanted = spark.createDataFrame([("가 나.hwp",), ("문서명긴것.pdf",), ("x.pdf",), (None,)], "name string")
    files = spark.createDataFrame([("/r/가나.HWP",), ("/r/가나.pdf",), ("/r/최종 문서명긴것 v2.docx",), ("/r/y.pdf",)], "path string")
    got = {r.name: (r.path, r.tier) for r in joins.match_names(wanted, files).collect()}
    assert got["가 나.hwp"] == ("/r/가나.HWP", 2) and got["문서명긴것.pdf"] == ("/r/최종 문서명긴것 v2.docx", 4) and got["x.pdf"] == (None, None)


def test_names_of_large_tables(spark):
    """Names and their runs are not broadcast, whatever the tables are estimated at; of many files with one name the best counts."""
    wanted = spark.range(3000).select(F.format_string("customer%09d.pdf", "id").alias("name"))
    files = spark.range(9000).select(F.format_string("/r%d/final customer%09d v2.docx", F.col("id") % 3, (F.col("id") / 3).cast("long")).alias("path"))
    found = joins.match_names(wanted, files, shortest=12, unicode=False)
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(f"customer{i:09}.pdf", f"/r0/final customer{i:09} v2.docx", 4) for i in range(3000)}
