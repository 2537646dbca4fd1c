"""The registered queries over the corpus operators, thin projections of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import held_out, table
from docengine.llm.licenses import oracle as licenses_oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op5_licenses": licenses_oracle()}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docengine.llm.secrets import digest, scan

    return digest(scan(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docengine.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docengine.llm.quality import score_quality, train_additive

    docs = table(spark, sf_dir, "documents")
    model = train_additive(docs.where(~held_out(F.col("doc_id"), 5, 0)), table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docengine.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docengine.llm.licenses import recognise

    return recognise(table(spark, sf_dir, "documents"))


@query
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docengine.llm.ppm import score_texts

    docs = table(spark, sf_dir, "documents")
    fold = held_out(F.col("doc_id"), 7, 2)
    return score_texts(docs, ~fold).select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docengine.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docengine.llm.quality import apply_rules, train_rules

    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, train_rules(docs, table(spark, sf_dir, "labels")))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docengine.llm.rans import read_files, write_files

    return read_files(write_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docengine.llm.langid import predict, train

    docs = table(spark, sf_dir, "documents")
    fold = held_out(F.col("doc_id"), 4, 2)
    return predict(docs, train(docs.where(~fold))).select("doc_id", fold.alias("held_out"), "lang_pred", "score")
