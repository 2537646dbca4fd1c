"""From files or extracted documents to chunk rows ready for search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import clean_text, first_valid, page_label
from docengine.operators.chunking import chunk

# fixed values: labels of the search text's header
LABELS = (("organization", "기관명"), ("project_name", "사업명"), ("file_name", "파일명"), ("file_type", "파일형식"), ("section_id", "섹션ID"), ("section_title", "섹션제목"), ("section_path", "섹션경로"), ("page", "페이지"))


def document_id(number: Column, index: Column) -> Column:
    """The notice number, or DOC_0001 by the row's index where it is empty."""
    return F.coalesce(first_valid(number), F.format_string("DOC_%04d", index))


def column(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that has a value, as string; null where df has none of them."""
    return first_valid(*(F.col(n) for n in names if n in df.columns), F.lit(None).cast("string"))


def standardize_chunks(rows: DataFrame) -> DataFrame:
    """chunk_id, doc_id, text from any of their usual names; rows without text or document go."""
    out = rows.select(
        column(rows, "chunk_id", "id").alias("chunk_id"), column(rows, "doc_id", "document_id", "source").alias("doc_id"), column(rows, "text", "page_content", "content", "chunk_text").alias("text"),
        *(c for c in rows.columns if c not in ("chunk_id", "id", "doc_id", "document_id", "source", "text", "page_content", "content", "chunk_text")),
    )
    out = out.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return out.withColumn("chunk_id", F.coalesce("chunk_id", F.concat(F.lit("chunk_"), F.substring(F.md5(F.concat_ws("\u001f", "doc_id", "text")), 1, 12))))


def embedding_text(rows: DataFrame, labels: Sequence[tuple[str, str]] = LABELS) -> Column:
    """The text behind a header of its known metadata; pages come from page_start and page_end."""
    have = set(rows.columns)
    values = {c: F.col(c).cast("string") for c, _ in labels if c in have and c != "section_path"}
    if "section_path" in have:
        is_list = rows.schema["section_path"].dataType.typeName() == "array"
        values["section_path"] = F.array_join("section_path", " > ") if is_list else F.col("section_path").cast("string")
    if "page_start" in have:
        values["page"] = page_label(F.col("page_start"), F.col("page_end") if "page_end" in have else F.col("page_start"))
    header = [F.when(F.trim(values[c]) != "", F.concat(F.lit(f"{name}: "), values[c])) for c, name in labels if c in values]
    body = F.concat(F.lit("본문:\n"), F.trim("text"))
    return F.concat_ws("\n\n", F.nullif(F.concat_ws("\n", *header), F.lit("")), body) if header else body


def build_chunks(docs: DataFrame, strategy: str = "char", clean: bool = True, **options: object) -> DataFrame:
    """Chunks of documents (doc_id, text) with ids, lengths and an ordinal in the document."""
    if clean:
        docs = docs.withColumn("text", clean_text(F.col("text")))
    rows = chunk(docs, strategy, **options)
    parts = [F.lpad(F.col(c).cast("string"), 4, "0") for c in ("section_idx", "chunk_idx", "clause_idx", "split_idx") if c in rows.columns]
    return rows.withColumn("chunk_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.lit(strategy), *parts)).withColumn("chunk_len", F.length("text"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, and the least, greatest, mean and median length."""
    n = F.length("text")
    return chunks.groupBy("doc_id").agg(F.count("*").alias("num_chunks"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.round(F.avg(n), 6).alias("mean_len"), F.median(n).alias("median_len"))


def process_log(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document whether it gave chunks: success, no_chunks_created, or failed where there is no text at all."""
    made = chunks.groupBy("doc_id").agg(F.count("*").alias("num_chunks"))
    status = F.when(F.col("text").isNull(), "failed").when(F.col("num_chunks").isNull(), "no_chunks_created").otherwise("success")
    return docs.select("doc_id", "text").join(made, "doc_id", "left").select("doc_id", F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"), status.alias("status"))
