"""Several settings of retrieval and answering side by side."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.operators import evaluation
from docengine.plans import rag


def matrix(**choices: Iterable) -> list[dict]:
    """All combinations of the named choices."""
    return [dict(zip(choices, values, strict=True)) for values in product(*choices.values())]


def key(choice: dict) -> str:
    return ",".join(f"{k}={v}" for k, v in sorted(choice.items()))


def compare(chunks: DataFrame, questions: DataFrame, choices: list[dict], generator: rag.Generator, embedder: rag.Embedder | None = None, names: tuple[str, ...] = ("hit_rate@5", "mrr@5", "recall@5")) -> DataFrame:
    """One row of mean metrics for each choice of settings; questions need gold ids."""
    out: DataFrame | None = None
    for choice in choices:
        rows = rag.run(chunks, questions, generator, replace(rag.Settings(), **choice), embedder)
        part = evaluation.summarize(evaluation.retrieval_scores(rows, names), names).withColumn("experiment", F.lit(key(choice)))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no choices")
    return out
