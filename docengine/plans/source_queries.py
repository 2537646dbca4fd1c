"""Queries of the readers, writers, models and row functions: what goes through them must come back as SQL has it."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import money
from docengine.functions import text as X
from docengine.operators import chunking, quality, search
from docengine.plans import clients, corpus, experiments, prompts, rag
from docengine.plans.registry import query, table
from docengine.sources import readers, writers
from docengine.sources.storage import shared_dir

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

# ---- row functions

_UNITS = "CASE o_orderkey % 6 WHEN 0 THEN '억원' WHEN 1 THEN '천만원' WHEN 2 THEN '백만원' WHEN 3 THEN '만원' WHEN 4 THEN '천원' ELSE '원' END"
_SIZES = "CASE o_orderkey % 6 WHEN 0 THEN 100000000 WHEN 1 THEN 10000000 WHEN 2 THEN 1000000 WHEN 3 THEN 10000 WHEN 4 THEN 1000 ELSE 1 END"


@query(f"SELECT o_orderkey, '금액 ' || CAST((o_orderkey % 9000 + 1) * {_SIZES} AS BIGINT) || '원, 끝' AS spelled, CAST(o_orderkey % 9000 + 1 AS BIGINT) AS number, '제' || o_orderkey || '조 삼백만' AS hangul FROM orders")
def korean_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = (k % 9000 + 1).cast("long")
    text = F.concat(F.lit("금액 "), F.format_number(n, 0), F.lit(" "), F.expr(_UNITS), F.lit(", 끝"))
    digit = lambda size: F.floor(n / size).cast("int") % 10
    name = lambda d: F.element_at(F.array(*(F.lit(c) for c in "영일이삼사오육칠팔구")), d + 1)
    numeral = F.concat(*(F.when(digit(size) > 0, F.concat(name(digit(size)), F.lit(unit))).otherwise("") for size, unit in ((1000, "천"), (100, "백"), (10, "십"), (1, ""))))
    hanja = F.concat(F.lit("第"), k.cast("string"), F.lit("條 三百萬"))
    return table(spark, sf_dir, "orders").select(k, money.normalize_amounts(text).alias("spelled"), money.parse_korean_number(numeral).alias("number"), X.spell_hanja(hanja).alias("hangul"))


@query(f"SELECT doc_id, md5({STRIP.format('text')}) AS digest FROM documents")
def stripped_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat(F.lit("<think>a\nb</think>\n"), F.coalesce("text", F.lit("")), F.lit("\n</think> <THINK>c</THINK>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.strip_reasoning(given)).alias("digest"))


@query("""SELECT r_name, '| key | name | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | a\\|' || n_name || '<br>b |  |', chr(10) ORDER BY n_nationkey) AS markdown
  FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    cells = F.array(F.col("n_nationkey").cast("string"), F.concat(F.lit("a|"), F.col("n_name"), F.lit("\nb")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("cells")))), lambda x: x.cells)
    head = F.array(F.array(*(F.lit(x) for x in ("key", "name", "note"))), F.array(F.lit(" "), F.lit(None)))
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.concat(head, listed).alias("rows"))
    return rows.select("r_name", X.rows_to_markdown(F.col("rows")).alias("markdown"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lists of hits: the turn is the rank, the role the document, system turns have no id."""
    hit = F.struct(F.col("turn").alias("rank"), F.when(F.col("role") != "system", F.col("role")).otherwise(" ").alias("doc_id"), F.nullif(F.col("text"), F.lit("")).alias("text"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))


_HITS = "SELECT conv_id, turn, trim(CASE WHEN role <> 'system' THEN role ELSE ' ' END) AS id, nullif(text, '') AS text FROM conversations"


@query(f"""SELECT conv_id, coalesce(string_agg(id, ',' ORDER BY turn, id, text) FILTER (id <> ''), '') AS ids, CAST(count(DISTINCT id) FILTER (id <> '') AS INT) AS n_ids, CAST(count(text) AS INT) AS n_contexts,
  md5(coalesce(string_agg(substr(text, 1, 20), ' > ' ORDER BY turn, id, text), '')) AS compact FROM ({_HITS}) GROUP BY conv_id""")
def hit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("hits")
    short = F.array_join(F.transform(prompts.compact(h, 20), lambda x: x["text"]), " > ")
    return hits(spark, sf_dir).select(
        "conv_id", F.array_join(prompts.ids_of(h), ",").alias("ids"), F.size(prompts.ids_of(h, unique=True)).alias("n_ids"), F.size(prompts.contexts_of(h)).alias("n_contexts"), F.md5(short).alias("compact"),
    )


@query("SELECT s_suppkey, concat_ws(chr(10), '기관명: ' || n_name, '사업명: ' || s_name, CASE WHEN s_suppkey % 3 > 0 THEN '문서ID: D' || s_suppkey END, '질문: what') AS asked FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, k = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), F.col("s_suppkey")
    doc = F.when(k % 3 > 0, F.concat(F.lit("D"), k.cast("string"))).otherwise(" ")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(k, prompts.retrieval_query(F.col("n_name"), F.concat(F.lit(" "), F.col("s_name")), doc, F.lit("what")).alias("asked"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 2 THEN 'N' || s_suppkey WHEN 3 THEN 'N' || s_suppkey ELSE 'DOC_' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(4, length(CAST(s_suppkey AS VARCHAR))) AS INT), '0') END AS doc_id FROM supplier")
def notice_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    number = F.when(k % 4 == 1, " ").when(k % 4 > 1, F.concat(F.lit(" N"), k.cast("string"), F.lit(" ")))
    return table(spark, sf_dir, "supplier").select(k, corpus.document_id(number, k).alias("doc_id"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'own' WHEN item_id % 3 = 1 THEN 'g' || item_id END AS doc_id FROM benchmark")
def backfilled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    gold = F.when(i % 3 == 2, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.concat(F.lit("g"), i.cast("string")), F.lit("h")))
    return quality.backfill_doc_id(table(spark, sf_dir, "benchmark").select("item_id", F.when(i % 3 == 0, " own ").otherwise(" ").alias("doc_id"), gold.alias("gold_ids")))


_NEAR = """SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS r FROM (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)"""


@query(f"SELECT qid, doc_id, CAST(rank AS INT) AS rank, round(-(doc_id % 7) / 2.0, 6)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY doc_id % 7, doc_id) AS rank FROM ({_NEAR}) WHERE r <= 10) WHERE rank <= 3")
def reranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    found = search.dense(e.select(F.col("vec_id").alias("doc_id"), "embedding"), e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), "embedding"), 10)
    best = search.rerank(found, -(F.col("doc_id") % 7) / 2, 3)
    return best.select("qid", "doc_id", "rank", F.round(search.result_score(F.col("rerank_score"), F.lit(None).cast("double"), F.col("score"), F.col("rank")), 6).alias("score"))


_AT = "strpos(text, substr(text, 151, 80)) - 1"
_ENDS = f"least(length(text), greatest(0, {_AT} - 100) + 200)"


@query(f"""SELECT doc_id, CASE WHEN n > 200 THEN (CASE WHEN e > 200 THEN '... ' ELSE '' END) || {STRIP.format('substr(text, greatest(0, e - 200) + 1, e - greatest(0, e - 200))')} || (CASE WHEN e < n THEN ' ...' ELSE '' END) ELSE text END AS context, n > 200 AS cut
  FROM (SELECT doc_id, text, length(text) AS n, {_ENDS} AS e FROM documents WHERE length(text) > 150)""")
def parent_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = F.pandas_udf(lambda parent, child: pd.DataFrame([chunking.parent_context(p, c, 200) for p, c in zip(parent, child, strict=True)], columns=["context", "cut"]), "context string, cut boolean")
    rows = table(spark, sf_dir, "documents").where(F.length("text") > 150)
    return rows.select("doc_id", around(F.col("text"), F.substring("text", 151, 120)).alias("p")).select("doc_id", "p.context", "p.cut")


@query("SELECT event_id, CAST(event_id % 5 AS BIGINT) + 1 AS merged, array_to_string(list_filter([event_id % 3, event_id % 4, event_id % 7], lambda x: x > 1)[1:2], ',') AS firsts, list_contains([event_id % 3, event_id % 4], 0) AS any_zero, CAST(event_id % 6 + 1 AS INT) AS n_pages, CAST(2 + event_id % 2 AS INT) AS n_lines FROM events")
def collection_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    merged = F.map_zip_with(F.create_map(F.lit("k"), i % 5), F.create_map(F.lit("k"), i % 5 + 1), lambda k, a, b: F.coalesce(b, a))
    firsts = F.slice(F.filter(F.array(i % 3, i % 4, i % 7), lambda x: x > 1), 1, 2)
    pages = F.array_distinct(F.sequence(F.lit(10), 10 + i % 6))
    lines = F.split(F.concat(F.lit("a\nb"), F.when(i % 2 == 1, "\nc").otherwise("")), "\n")
    return table(spark, sf_dir, "events").select(
        i, merged["k"].alias("merged"), F.array_join(firsts.cast("array<string>"), ",").alias("firsts"), F.exists(F.array(i % 3, i % 4), lambda x: x == 0).alias("any_zero"), F.size(pages).alias("n_pages"), F.size(lines).alias("n_lines"),
    )


# ---- readers and writers


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "supplier"), shared_dir(spark, "jsonl")
    writers.write_jsonl(rows, path)
    return readers.read_jsonl(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("SELECT n_nationkey, n_name FROM nation")
def json_array_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "json")
    table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")).write.text(path)
    return readers.read_json(spark, path, "n_nationkey int, n_name string")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS digest, lang || '|' || source AS tags FROM documents WHERE text <> ''")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line ends, quotes and lists go through a CSV and back."""
    rows, path = table(spark, sf_dir, "documents").where("text <> ''"), shared_dir(spark, "csv")
    writers.write_csv(rows.select("doc_id", "text", F.array("lang", "source").alias("tags")), path)
    back = readers.read_metadata(spark, path, {"doc_id": "id", "tags": "listed"})
    return back.select(F.col("id").alias("doc_id"), F.md5("text").alias("digest"), F.array_join(F.from_json("listed", "array<string>"), "|").alias("tags"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CAST(count(*) AS BIGINT) AS n FROM (SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 10) GROUP BY ALL")
def appended_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey"), shared_dir(spark, "sheet")
    writers.write_csv(rows, path)
    writers.append_sheet(rows.where("s_nationkey < 10"), path)
    return readers.read_metadata(spark, path).groupBy("id", "name").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('llm.top_k', '5', false), ('llm.name', 'm', true), ('store', 'faiss', true), ('missing', 'none', false)) t(path, value, changed)")
def settings_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "settings")
    writers.write_settings(spark, {"llm": {"top_k": 5, "name": "m"}, "store": "faiss"}, path)
    saved, paths = writers.read_settings(spark, path), ["llm.top_k", "llm.name", "store", "missing"]
    changed = readers.changed_settings(saved, {"llm": {"top_k": 5, "name": "n"}}, paths)
    return spark.createDataFrame([(p, str(readers.setting(saved, p, "none")), p in changed) for p in paths], "path string, value string, changed boolean")


@query("SELECT s_suppkey, 'name=' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN ';path=a > ' || s_nationkey ELSE '' END AS metadata FROM supplier")
def flat_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k, F.col("s_name").alias("name"), F.when(k % 2 == 0, F.array(F.lit("a"), F.col("s_nationkey").cast("string"))).alias("path"), F.lit("").alias("empty"))
    entries = F.array_sort(F.map_entries(writers.flat_metadata(rows, ["name", "path", "empty"])))
    return rows.select("s_suppkey", F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.lit("="), e.value)), ";").alias("metadata"))


_MOVED = "SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS e, label FROM embeddings"


@query(f"""SELECT qid, doc_id, CAST(rank AS INT) AS rank, label FROM (SELECT qid, doc_id, label, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS doc_id, b.label,
  round(list_inner_product(a.embedding::DOUBLE[], b.e) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.e, b.e)), 6) AS s FROM embeddings a, ({_MOVED}) b WHERE a.vec_id % 100 = 0)) WHERE rank <= 5""")
def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A built, updated and searched vector table."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    store = writers.VectorTable(spark, shared_dir(spark, "vectors"), "cosine")
    store.build(rows, {"model": "m"})
    store.upsert(rows.where("doc_id % 10 = 3").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    return store.search(rows.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "embedding"), 5).select("qid", "doc_id", "rank", "label")


@query("SELECT s_suppkey AS doc_id, s_name || chr(10) || chr(10) || s_nationkey AS text FROM supplier WHERE s_suppkey % 5 > 0")
def text_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file for each supplier whose text is known."""
    k, path = F.col("s_suppkey"), shared_dir(spark, "texts")
    text = F.when(k % 5 > 0, F.concat_ws("\n\n", "s_name", F.col("s_nationkey").cast("string")))
    writers.write_texts(table(spark, sf_dir, "supplier").select(k.alias("doc_id"), text.alias("text")), path)
    return writers.read_texts(spark, path).withColumn("doc_id", F.col("doc_id").cast("long"))


def _zipped(name: str, body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, body)
    return out.getvalue()


def sample_file(kind: str, lines: list[str]) -> bytes:
    """A small file of the type with one paragraph for each line."""
    if kind == "docx":
        body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
        return _zipped("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    if kind == "hwpx":
        return _zipped("Contents/section0.xml", '<s xmlns:hp="x">' + "".join(f"<hp:p><hp:t>{escape(x)}</hp:t></hp:p>" for x in lines) + "</s>")
    if kind == "html":
        return "".join(f"<p>{escape(x)}</p>" for x in lines).encode()
    if kind == "pdf":
        shown = b"BT /F 10 Tf 12 TL 20 800 Td " + b" T* ".join(b"<" + x.encode("cp1252").hex().encode() + b"> Tj" for x in lines) + b" ET"
        packed = zlib.compress(shown)
        stream = b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(packed), packed)
        objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [3 0 R] >>", b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F 5 0 R >> >> >>", stream, b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>"]
        return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>"
    return "\n".join(lines).encode()


KINDS = ("docx", "hwpx", "html", "pdf", "txt", "md", "xyz")
_KIND = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"


@query(f"""SELECT path, file_type, CAST(CASE WHEN file_type = 'xyz' THEN 0 ELSE 1 END AS INT) AS num_pages, CASE WHEN file_type <> 'xyz' THEN p_name || CASE WHEN file_type = 'html' THEN chr(10) || chr(10) ELSE chr(10) END || p_brand || ' & ' || p_type END AS text, file_type = 'xyz' AS failed
  FROM (SELECT *, '/files/' || p_partkey || '.' || file_type AS path FROM (SELECT *, {_KIND} AS file_type FROM part)) WHERE p_partkey % 11 <> 5""")
def extracted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each type made from parts, those done before left out, read and extracted."""
    make = F.pandas_udf(lambda kind, a, b: pd.Series([sample_file(k, [x, y]) for k, x, y in zip(kind, a, b, strict=True)]), "binary")
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").withColumn("file_type", F.expr(_KIND)).withColumn("file_name", F.concat_ws(".", k.cast("string"), F.col("file_type")))
    files = files.select(k, F.concat(F.lit("/files/"), F.col("file_name")).alias("path"), "file_name", "file_type", make(F.col("file_type"), F.col("p_name"), F.concat_ws(" & ", "p_brand", "p_type")).alias("content"))
    found = readers.extract(readers.only_new(files, files.where(k % 11 == 5)))
    return found.select("path", "file_type", "num_pages", "text", F.col("error").isNotNull().alias("failed"))


@query("SELECT * FROM (VALUES ('gpt', 'chroma'), ('gpt', 'faiss'), ('qwen', 'chroma'), ('qwen', 'faiss')) t(llm, store)")
def experiment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c["llm"], c["store"]) for c in experiments.matrix(llm=("gpt", "qwen"), store=("faiss", "chroma"))], "llm string, store string")


# ---- models


def _sizes() -> object:
    return lambda texts: np.array([[len(t), t.count(" ")] for t in texts], np.float64)


@query("SELECT doc_id, round(a / sqrt(a * a + b * b), 4) AS x, round(b / sqrt(a * a + b * b), 4) AS y FROM (SELECT doc_id, length(t)::DOUBLE AS a, (length(t) - length(replace(t, ' ', '')))::DOUBLE AS b FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || ' ' || lang ELSE text END AS t FROM documents WHERE text <> ''))")
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the search text, or of the text where there is none, by an embedder of lengths and blanks."""
    given = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", "source", "lang")).otherwise(" ")
    rows = rag.embed_chunks(table(spark, sf_dir, "documents").where("text <> ''").withColumn("embedding_text", given), rag.batch_embedder(_sizes))
    return rows.select("doc_id", *(F.round(F.col("embedding")[i].cast("double"), 4).alias(n) for i, n in enumerate("xy")))


class Counting:
    """A client for tests: model `busy` never answers, the others tell the length of the last message and refuse a temperature."""

    def complete(self, model: str, messages: list[dict], **options: object) -> dict:
        if model == "busy":
            raise RuntimeError("busy")
        if "temperature" in options:
            raise ValueError("unsupported: temperature")
        return {"text": f"<think>so</think>{len(messages[-1]['content'])}", "tokens_in": 1, "tokens_out": 2}


@query("SELECT item_id AS qid, CAST(length('[검색 문서]' || chr(10) || '검색된 문서가 없습니다.' || chr(10) || chr(10) || '[질문]' || chr(10) || text || chr(10) || chr(10) || '[답변]' || chr(10)) AS VARCHAR) AS answer, 'plain' AS model, CAST(3 AS BIGINT) AS tokens FROM benchmark")
def client_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by the second model, without the option that it refuses."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    ask = clients.calling_generator(Counting, clients.Calls(("busy", "plain"), attempts=2, pause=0))
    empty = F.expr("cast(null as array<struct<rank: int, doc_id: string, text: string>>)")
    rows = q.withColumn("g", ask(F.col("text"), prompts.messages(F.col("text"), prompts.context(empty, ("doc_id",)))))
    return rows.select("qid", F.col("g.response").alias("answer"), "g.model", (F.col("g.tokens_in") + F.col("g.tokens_out")).alias("tokens"))


@query("SELECT 'llm_' || i || '_' || doc_id AS qid, doc_id, 'q' || i || ' of ' || doc_id AS question, 'a' || i AS reference FROM documents, (VALUES (1), (2)) t(i) WHERE trim(text) <> '' AND doc_id % 5 > 0")
def made_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions for each document by a model that writes JSON in a fence, and prose for every fifth document."""

    def generator(question: Column, messages: Column) -> Column:
        doc = F.regexp_extract(messages[0]["content"], "\\[요약\\] id(\\d+)", 1)
        pair = lambda i: F.concat(F.lit(f'{{"question": "q{i} of '), doc, F.lit(f'", "answer": "a{i}"}}'))
        pairs = F.concat(F.lit("```json\n["), F.concat_ws(", ", *(pair(i) for i in (1, 2, 3))), F.lit("]\n```"))
        return F.struct(F.when(doc.cast("long") % 5 > 0, pairs).otherwise("no questions").alias("response"))

    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("p").alias("project_name"), F.concat(F.lit("id"), F.col("doc_id").cast("string")).alias("summary"), "text")
    return clients.made_questions(docs, generator)
