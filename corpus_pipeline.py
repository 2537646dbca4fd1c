"""A training corpus from raw documents: quality rules, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared
folder and read again as the next stage's documents. All but the last return the columns of documents,
others that docs has included. Empty tables pass through; null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docengine.llm.common import table, written
from docengine.llm.decontaminate import keep_clean
from docengine.llm.neardup import keep_one
from docengine.llm.packing import pack
from docengine.llm.quality import keep_good, train_rules
from docengine.llm.queries import tokenizer
from docengine.llm.secrets import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the trees reject go: null, empty and short texts among them. Repeated rows stay or go together."""
    return keep_good(docs, train_rules(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that with the smallest id; ids come before nulls, of repeated rows one stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null texts and items hold none."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span is replaced by a mark; n_chars follows, null stays null. No document goes."""
    return redact(docs, tokenizer("word_bpe_49k.json"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4,096 tokens; an empty text is its end token alone, repeated rows are apart."""
    return pack(docs, tokenizer("word_bpe_49k.json"), remember=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]
#: No stage but the leak search could be put in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
