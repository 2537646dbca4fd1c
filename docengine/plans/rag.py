"""Question answering end to end: retrieve, prompt, generate, evaluate. Models come in as functions over columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.metrics import llm_cost
from docengine.operators import search
from docengine.plans import prompts

#: text -> array<float>; question, messages -> struct(response, tokens_in, tokens_out).
Embedder = Callable[[Column], Column]
Generator = Callable[[Column, Column], Column]
#: question, text -> score.
Reranker = Callable[[Column, Column], Column]


def batch_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]], normalize: bool = True) -> Embedder:
    """An embedder from a function that loads a model, once for each worker's task, and returns its batch encoder."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            m = np.asarray(encode(texts.fillna("").tolist()), np.float32)
            if normalize and len(m):
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(m))

    return lambda text: embed(text)


def hashing_embedder(size: int = 64) -> Embedder:
    """A model-free embedder for tests: signed counts of hashed words."""

    def load() -> Callable[[list[str]], np.ndarray]:
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size), np.float32)
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % size] += 1 if h & 65536 else -1
            return out

        return encode

    return batch_embedder(load)


def extractive_generator(longest: int = 200) -> Generator:
    """A model-free generator for tests: the start of the first context text."""

    def generate(question: Column, messages: Column) -> Column:
        answer = F.substring(F.regexp_extract(F.element_at(messages, 2)["content"], "(?s)\\n\\n(.*?)\\n\\n(?:---|\\[질문\\])", 1), 1, longest)
        count = lambda c: F.size(F.split(c, "\\s+")).cast("long")
        return F.struct(answer.alias("response"), count(F.element_at(messages, 2)["content"]).alias("tokens_in"), count(answer).alias("tokens_out"), F.lit(None).cast("string").alias("error"))

    return generate


@dataclass
class Settings:
    top_k: int = 5
    candidate_k: int = 30
    dense_weight: float = 0.7
    keyword_weight: float = 0.3
    rrf_k: int = 60
    longest_context: int | None = 1500
    prompt: str = "default"
    price_in: float = 0.15
    price_out: float = 0.60
    extra: dict[str, str] = field(default_factory=dict)


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Chunks with a vector of their search text, or of their text where that is empty."""
    text = F.coalesce(F.nullif(F.trim("embedding_text"), F.lit("")), F.col("text")) if "embedding_text" in chunks.columns else F.col("text")
    return chunks.withColumn("embedding", embedder(text))


def retrieve(chunks: DataFrame, questions: DataFrame, settings: Settings | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None) -> DataFrame:
    """Hits (qid, doc_id = the chunk's number, rank, score) by dense search, keywords, or both fused.

    chunks: doc_id, text, and embedding for dense search; questions: qid, text, and embedding unless an embedder is given.
    """
    s = settings or Settings()
    lists: list[tuple[DataFrame, float]] = []
    if "embedding" in chunks.columns:
        asked = questions.withColumn("embedding", embedder(F.col("text"))) if embedder else questions
        lists.append((search.dense(chunks, asked, s.candidate_k), s.dense_weight))
    if "embedding" not in chunks.columns or s.keyword_weight > 0:
        lists.append((search.bm25(chunks, questions, s.candidate_k), s.keyword_weight))
    hits = lists[0][0] if len(lists) == 1 else search.rank_fusion(lists, s.candidate_k, s.rrf_k)
    if reranker:
        texts = chunks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__t"))
        with_text = hits.join(texts, "doc_id").join(questions.select("qid", F.col("text").alias("__q")), "qid")
        return search.rerank(with_text, reranker(F.col("__q"), F.col("__t")), s.top_k).drop("__q", "__t")
    return hits.where(F.col("rank") <= s.top_k)


def answer(chunks: DataFrame, questions: DataFrame, hits: DataFrame, generator: Generator, settings: Settings | None = None) -> DataFrame:
    """One row per question: retrieved ids and contexts, messages, response, tokens and cost. Questions without hits stay."""
    s = settings or Settings()
    texts = chunks.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = search.collect_hits(hits.join(texts, "doc_id"), "text")
    rows = questions.join(joined, "qid", "left")
    fields = ("score", "doc_id")
    found = prompts.context(F.col("hits"), fields, s.longest_context)
    rows = rows.withColumn("messages", prompts.messages(F.col("question") if "question" in rows.columns else F.col("text"), found, s.prompt))
    rows = rows.withColumn("g", generator(F.col("text"), F.col("messages")))
    ids = F.coalesce(F.transform("hits", lambda h: h.doc_id.cast("string")), F.expr("cast(array() as array<string>)"))
    cost = llm_cost(F.col("g.tokens_in"), F.col("g.tokens_out"), F.lit(s.price_in), F.lit(s.price_out))
    return rows.select(*questions.columns, ids.alias("retrieved"), F.transform("hits", lambda h: h.text).alias("contexts"), "messages", F.col("g.response").alias("answer"), "g.tokens_in", "g.tokens_out", "g.error", cost.alias("cost"))


def run(chunks: DataFrame, questions: DataFrame, generator: Generator, settings: Settings | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None) -> DataFrame:
    return answer(chunks, questions, retrieve(chunks, questions, settings, embedder, reranker), generator, settings)


def summary(rows: DataFrame, k: int = 5, columns: Sequence[str] = ()) -> DataFrame:
    """One line per answered question for a report, with whether a gold id is among the first k."""
    hit = F.coalesce(F.arrays_overlap(F.slice("retrieved", 1, k), F.col("gold")), F.lit(False))
    return rows.select("qid", *columns, F.array_join(F.slice("retrieved", 1, k), ",").alias("retrieved_ids"), hit.alias("retrieval_hit"), *(c for c in ("answer", "cost") if c in rows.columns))
