import glob
import os

import pytest
from pyspark.sql import functions as F

from docengine.plans import corpus, prompts, queries, rag, registry, source_queries  # noqa: F401
from docengine.streaming import events

DATA = "/root/testdata/sf0.001"


def test_prompts(spark):
    hits = "array<struct<rank: int, doc_id: long, score: double, text: string>>"
    rows = spark.createDataFrame([([(1, 7, 0.5, "가나다"), (2, 8, 0.25, None)], "질문"), ([], None), (None, "q")], f"hits {hits}, q string")
    got = rows.select(prompts.context(F.col("hits"), ("doc_id",), 2).alias("c"), prompts.messages(F.col("q"), prompts.context(F.col("hits"), ("doc_id",)), "strict").alias("m")).collect()
    assert got[0].c == "[문서 1]\ndoc_id: 7\n\n가나\n\n---\n\n[문서 2]\ndoc_id: 8\n\n" and got[1].c == got[2].c == prompts.NOTHING_FOUND
    assert [m.role for m in got[0].m] == ["system", "user"] and got[0].m[1].content.endswith("[질문]\n질문\n\n[답변]\n")
    with pytest.raises(ValueError):
        prompts.messages(F.col("q"), F.col("q"), "none")
    q = rows.select(prompts.retrieval_query(F.lit("기관"), F.lit(" "), F.lit(None).cast("string"), F.col("q")).alias("x")).first().x
    assert q == "기관명: 기관\n질문: 질문"


def test_corpus(spark):
    docs = spark.createDataFrame([("1", "x" * 50 + " ...... 3"), ("2", ""), ("3", None)], "doc_id string, text string")
    chunks = corpus.build_chunks(docs, "char", longest=40, overlap=10)
    assert [r.chunk_id for r in chunks.orderBy("chunk_id").collect()] == ["1_char_0000", "1_char_0001"]
    assert {r.doc_id: r.status for r in corpus.process_log(docs, chunks).collect()} == {"1": "success", "2": "no_chunks_created", "3": "failed"}
    ids = spark.createDataFrame([(" 20240101 ", 0), ("nan", 1), (None, 2)], "no string, i int").select(corpus.document_id(F.col("no"), F.col("i")).alias("x")).collect()
    assert [r.x for r in ids] == ["20240101", "DOC_0001", "DOC_0002"]


def test_rag_end_to_end(spark):
    chunks = spark.createDataFrame([(1, "보안 관리 기준을 정한다"), (2, "품질 보증 절차를 둔다"), (3, "데이터 백업 주기를 둔다")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "보안 관리", ["1"]), (2, "품질 보증", ["2"]), (3, "전혀 없는 말", ["3"])], "qid long, text string, gold array<string>")
    embed = rag.hashing_embedder(256)
    rows = rag.run(rag.embed_chunks(chunks, embed), asked, rag.extractive_generator(), rag.Settings(top_k=2), embed).collect()
    top = {r.qid: r.retrieved[0] for r in rows if r.retrieved}
    assert top[1] == "1" and top[2] == "2" and all(r.answer is not None and r.tokens_in > 0 and r.cost >= 0 for r in rows)
    only = rag.run(chunks, asked, rag.extractive_generator()).collect()
    assert {r.qid: r.retrieved for r in only}[3] == [] and [r for r in only if r.qid == 3][0].messages[1].content.count(prompts.NOTHING_FOUND) == 1
    flip = rag.retrieve(chunks, asked, rag.Settings(top_k=1, candidate_k=3), reranker=lambda q, t: -F.length(t).cast("double")).collect()
    assert len(flip) == 2
    report = rag.summary(rag.run(chunks, asked, rag.extractive_generator()), 1).collect()
    assert {r.qid: r.retrieval_hit for r in report} == {1: True, 2: True, 3: False}


def test_experiments_and_hits(spark):
    from docengine.functions import text as X
    from docengine.plans import experiments

    chunks = spark.createDataFrame([(1, "보안 관리"), (2, "품질 보증")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "보안", ["1"]), (2, "보증", ["1"])], "qid long, text string, gold array<string>")
    choices = experiments.matrix(top_k=[1, 2], candidate_k=[5])
    got = {r.experiment: r.mrr_at_5 for r in experiments.compare(chunks, asked, choices, rag.extractive_generator()).collect()}
    assert got == {"candidate_k=5,top_k=1": 0.5, "candidate_k=5,top_k=2": 0.5}
    hits = spark.createDataFrame([([("a", "long text"), ("a", ""), (None, None)],)], "hits array<struct<doc_id: string, text: string>>")
    r = hits.select(prompts.compact(F.col("hits"), 4).alias("c"), prompts.ids_of(F.col("hits"), unique=True).alias("i"), prompts.contexts_of(F.col("hits")).alias("t")).first()
    assert r.c[0].text == "long" and r.i == ["a"] and r.t == ["long text"]
    names = spark.createDataFrame([("第三條 別紙",), (None,)], "t string").select(X.spell_hanja(F.col("t")).alias("h"), X.short_model_name(F.lit("org/Model-7B-Instruct")).alias("m"), X.short_model_name(F.lit("GPT-4o")).alias("g")).first()
    assert names.h == "제삼조 별지" and names.m == "Model-7B" and names.g == "gpt4o"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
class TestTables:
    def test_stream_equals_batch(self, spark, tmp_path):
        source = tmp_path / "in"
        batch = spark.read.parquet(f"{DATA}/events.parquet")
        batch.repartition(3).write.parquet(str(source))
        stream = events.windowed(events.read_events(spark, str(source), files_a_batch=1), "1 day", late="3650 days")
        found: dict = {}

        def keep(df, number):
            found.update({(r.window_start, r.event_type): (r.n, r.total) for r in df.collect()})

        events.each_batch(stream, keep, str(tmp_path / "c"), "update")
        want = {(r.window_start, r.event_type): (r.n, r.total) for r in events.windowed(batch.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
        assert found == want and len(want) > 10

    def test_stream_goes_on(self, spark, tmp_path):
        rows = spark.read.parquet(f"{DATA}/events.parquet")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for part in (1, 2):
            stream = events.distinct_events(events.read_events(spark, str(tmp_path / "in")), "3650 days")
            events.run_available(stream, str(tmp_path / "out"), str(tmp_path / "c"))
            assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()
            rows.limit(100).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    @pytest.mark.parametrize("name", sorted(registry.QUERIES))
    def test_query_runs(self, spark, name):
        df = registry.QUERIES[name](spark, DATA)
        rows = df.collect()
        assert len(set(df.columns)) == len(df.columns)
        if name not in registry.SQL:
            assert rows
            return
        duckdb = pytest.importorskip("duckdb")
        db = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        found = db.execute(registry.SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)

        def plain(v):
            return None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) if not isinstance(v, (int, bool)) else f"{float(v):.9g}"

        order = sorted(columns)
        mine = sorted(str([plain(r[c]) for c in order]) for r in rows)
        theirs = sorted(str([plain(r[columns.index(c)]) for c in order]) for r in found.fetchall())
        assert mine == theirs

    def test_entry(self, spark):
        import __spark_entry__ as entry

        assert entry.entry(spark).count() > 0
        assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
