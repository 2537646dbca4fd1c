"""Top-k retrieval: keyword (BM25), dense (inner product), and rank fusion.

A search holds a block of queries against all rows. Every task keeps the best k of its rows for each query,
so what is shuffled is k rows for each query and task, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.text import search_terms
from docengine.sources.storage import written

K1, B = 1.5, 0.75
#: Queries that one pass over the rows holds.
BLOCK = 500
#: Documents, and terms that they have, whose scores are one matrix product.
DOCS_AT_ONCE = 256
TERMS_AT_ONCE = 4096
#: Distinct terms of all queries by which documents are cut down; with more, documents keep all of theirs.
ASKED = 1_000_000
#: Vectors that are one matrix product with a block's queries.
ROWS_AT_ONCE = 1024
PLACES = 6


def top_k(rows: DataFrame, k: int, group: str = "qid", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each group with their rank; ties go to the smaller id."""
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocks(queries: DataFrame, columns: list[str], size: int = BLOCK) -> Iterator[list]:
    """The queries in blocks of about `size` rows, each collected on its own; their number is counted first."""
    n = max(1, -(-queries.count() // size))
    for i in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64(columns[0]), F.lit(n)) == i)
        if rows := part.select(*columns).collect():
            yield rows


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = empty
    for i, part in enumerate(parts):
        out = part if i == 0 else out.unionAll(part)
    return out


# ---- BM25


def term_stats(docs: DataFrame, terms: DataFrame, n: int | None = None) -> DataFrame:
    """term, df, idf of the given distinct terms (term) over n documents; terms are matched before counting."""
    n = docs.count() if n is None else n
    each = docs.select(F.explode(F.array_distinct(search_terms(F.col("text")))).alias("term"))
    found = each.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return found.withColumn("idf", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select(F.explode(F.array_distinct(search_terms(F.col("text")))).alias("term")).distinct()


HITS = "qid long, doc_id long, score double"
POSTINGS = "doc_id long, length int, terms array<long>, counts array<int>"


def _hashed(c: Column) -> Column:
    """Terms as 64-bit hashes, the same for documents and queries."""
    return F.transform(search_terms(c), lambda t: F.xxhash64(t))  # noqa: PLW0108


def postings(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): its number of terms, and those of the asked terms (term) that it has, with
    their counts. The one pass over the texts; written, so that every block of queries reads numbers only.

    asked holds distinct hashes; with more than ASKED of them all terms are kept.
    """
    few = asked.limit(ASKED + 1).collect()
    wanted = np.sort(np.array([r[0] for r in few], np.int64)) if len(few) <= ASKED else None
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            lists = batch.column("terms")
            bounds = lists.offsets.to_numpy().astype(np.int64)
            length = np.diff(bounds)
            term, doc = lists.flatten().to_numpy(), np.repeat(np.arange(len(length)), length)
            if wanted is not None:
                known = _place(wanted, term) >= 0
                term, doc = term[known], doc[known]
            order = np.lexsort((term, doc))
            term, doc = term[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])[: len(term)])
            count = np.diff(np.concatenate([first, [len(term)]]))
            ends = np.searchsorted(doc[first], np.arange(len(length) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "length": length.astype(np.int32), "terms": pa.ListArray.from_arrays(ends, term[first]), "counts": pa.ListArray.from_arrays(ends, count.astype(np.int32)),
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _hashed(F.col("text")).alias("terms"))
    return written(rows.mapInArrow(run, POSTINGS), "postings")


def _place(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value is in a sorted table, -1 where it is not."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = K1, b: float = B) -> DataFrame:
    """qid, doc_id, score, rank of the k best documents (doc_id, text) for each query (qid, text), scores over 0 only.

    Scores are rounded to PLACES before ranking, so that ties do not hang on the order of a sum. A term that
    a query repeats counts as often as it stands there. Documents without an id count in the statistics only.
    """
    spark = docs.sparkSession
    asked = queries.select("qid", _hashed(F.col("text")).alias("terms"))
    rows = postings(docs, asked.select(F.explode("terms").alias("term")).distinct())
    n, mean = rows.agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(0.0))).first()
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    parts = []
    for block in blocks(asked, ["qid", "terms"]):
        names = np.array([r.qid for r in block], np.int64)
        query = np.repeat(np.arange(len(block)), [len(r.terms) for r in block])
        terms, code = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(r.terms, np.int64) for r in block)]), return_inverse=True)
        own = spark.createDataFrame(pa.table({"term": terms}))
        found = {r.term: r.df for r in df.join(F.broadcast(own), "term").collect()}
        number = np.array([found.get(t, 0) for t in terms.tolist()], np.float64)
        idf = np.where(number > 0, np.log(1 + (n - number + 0.5) / (number + 0.5)), 0.0)
        # the block's queries by term: for each term its queries and their weights, one after another
        pair, times = np.unique(code * len(names) + query, return_counts=True) if len(code) else (code, code)
        starts = np.searchsorted(pair // max(1, len(names)), np.arange(len(terms) + 1))
        weight = idf[pair // max(1, len(names))] * times
        shared = spark.sparkContext.broadcast((names, terms, starts, pair % max(1, len(names)), weight))

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            names, terms, starts, query, weight = shared.value
            best = _Best(len(names), k)
            for batch in batches:
                doc_ids, length = batch.column("doc_id").to_numpy(), batch.column("length").to_numpy()
                bounds = batch.column("terms").offsets.to_numpy().astype(np.int64)
                bounds = bounds - bounds[0]
                place, tf = _place(terms, batch.column("terms").flatten().to_numpy()), batch.column("counts").flatten().to_numpy()
                norm = k1 * (1 - b + b * length / mean) if mean else np.full(len(length), k1)
                for at in range(0, len(doc_ids), DOCS_AT_ONCE):
                    end = min(at + DOCS_AT_ONCE, len(doc_ids))
                    here = place[bounds[at] : bounds[end]]
                    doc = np.repeat(np.arange(end - at), np.diff(bounds[at : end + 1]))[here >= 0]
                    count, here = tf[bounds[at] : bounds[end]][here >= 0], here[here >= 0]
                    gain = count * (k1 + 1) / (count + norm[at + doc])
                    present, column = np.unique(here, return_inverse=True)
                    score = np.zeros((end - at, len(names)))
                    for low in range(0, len(present), TERMS_AT_ONCE):
                        part = present[low : low + TERMS_AT_ONCE]
                        size = starts[part + 1] - starts[part]
                        cell = np.repeat(starts[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                        weights = np.zeros((len(part), len(names)))
                        weights[np.repeat(np.arange(len(part)), size), query[cell]] = weight[cell]
                        gains, inside = np.zeros((end - at, len(part))), (column >= low) & (column < low + len(part))
                        gains[doc[inside], column[inside] - low] = gain[inside]
                        score += gains @ weights
                    best.add(doc_ids[at:end], np.round(score, PLACES).T, least=10.0**-PLACES / 2)
            yield from best.rows(names)

        parts.append(rows.where(F.col("doc_id").isNotNull()).mapInArrow(run, HITS))
    return top_k(_union(parts, spark.createDataFrame([], HITS)), k)


class _Best:
    """The k best rows of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.floor = np.full(n, -np.inf)  # the kth best score, from where there are k
        self.held = pd.DataFrame({"q": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    def add(self, ids: np.ndarray, scores: np.ndarray, least: float = -np.inf) -> None:
        """scores: queries x ids; those below `least` do not count."""
        q, d = np.nonzero((scores >= self.floor[:, None]) & (scores >= least))
        if not len(q):
            return
        rows = pd.concat([self.held, pd.DataFrame({"q": q, "doc_id": ids[d], "score": scores[q, d]})], ignore_index=True)
        rows = rows.sort_values(["q", "score", "doc_id"], ascending=[True, False, True], kind="stable")
        nth = rows.groupby("q").cumcount()
        self.held = rows[nth < self.k]
        full = rows[nth == self.k - 1]
        self.floor[full["q"].to_numpy()] = full["score"].to_numpy()

    def rows(self, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(self.held):
            yield pa.RecordBatch.from_pydict({"qid": names[self.held["q"].to_numpy()], "doc_id": self.held["doc_id"].to_numpy(), "score": self.held["score"].to_numpy()})


# ---- dense


def dense(rows: DataFrame, queries: DataFrame, k: int = 5, normalize: bool = False, metric: str = "ip", ids: tuple[str, str] = ("qid", "doc_id")) -> DataFrame:
    """qid, doc_id, score, rank of the k best rows (id, embedding) for each query (id, embedding).

    metric: inner product ("ip"), cosine ("cosine"), or squared distance ("l2", smaller is better, its score
    negative). Vectors are read as float32 and summed in double. Null vectors and those of other lengths are left out.
    """
    if metric not in ("ip", "cosine", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    parts = []
    source = rows.where(F.col("embedding").isNotNull() & F.col(ids[1]).isNotNull()).select(F.col(ids[1]).cast("long").alias("doc_id"), "embedding")
    for block in blocks(queries.where(F.col("embedding").isNotNull()), [ids[0], "embedding"]):
        names = np.array([r[0] for r in block])
        matrix = np.array([r[1] for r in block], np.float64)

        def run(batches: Iterator[pa.RecordBatch], names: np.ndarray = names, matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            asked = unit(matrix) if normalize or metric == "cosine" else matrix
            best = _Best(len(names), k)
            for batch in batches:
                vectors = batch.column("embedding")
                right = np.diff(vectors.offsets.to_numpy()) == asked.shape[1]
                if not right.any():
                    continue
                batch = batch.filter(pa.array(right))
                m = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32).astype(np.float64).reshape(-1, asked.shape[1])
                m = unit(m) if normalize or metric == "cosine" else m
                ids_ = batch.column("doc_id").to_numpy()
                for at in range(0, len(m), ROWS_AT_ONCE):
                    part = m[at : at + ROWS_AT_ONCE]
                    score = asked @ part.T
                    if metric == "l2":
                        score = 2 * score - (asked**2).sum(1)[:, None] - (part**2).sum(1)[None, :]
                    best.add(ids_[at : at + ROWS_AT_ONCE], np.round(score, PLACES))
            yield from best.rows(names)

        parts.append(source.mapInArrow(run, HITS))
    return top_k(_union(parts, rows.sparkSession.createDataFrame([], HITS)), k)


# ---- fusion


def rank_fusion(lists: list[tuple[DataFrame, float]], k: int, rrf_k: int = 60) -> DataFrame:
    """qid, doc_id, rank, and a rank column of each list, by the sum of weight / (rrf_k + rank) over the lists.

    Lists are (qid, doc_id, rank) with a weight; a document that a list lacks gets nothing from it. Equal
    sums are ordered by the first list's rank, then the next's, then the id.
    """
    names = [f"rank_{i}" for i in range(len(lists))]
    parts = [rows.select("qid", "doc_id", *(F.col("rank").alias(n) if n == own else F.lit(None).cast("int").alias(n) for n in names), F.lit(w).cast("double").alias("w")) for (rows, w), own in zip(lists, names, strict=True)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionAll(part)
    gain = F.sum(F.col("w") / (F.lit(rrf_k) + F.coalesce(*names)))
    fused = both.groupBy("qid", "doc_id").agg(F.round(gain, PLACES + 2).alias("score"), *(F.min(n).alias(n) for n in names))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *(F.asc_nulls_last(n) for n in names), "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def result_score(rerank: Column, fusion: Column, score: Column, rank: Column) -> Column:
    """The first score there is; the reciprocal rank without any."""
    return F.coalesce(rerank, fusion, score, 1.0 / rank)


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """Hits (qid, doc_id, ...) by a new score, the k best of each query."""
    return top_k(hits.drop("rank").withColumn("rerank_score", score), k, score="rerank_score")


def collect_hits(hits: DataFrame, *columns: str) -> DataFrame:
    """One row per query with its hits in order of rank."""
    fields = [c for c in ("rank", "doc_id", "score", *columns) if c in hits.columns]
    return hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("hits"))
