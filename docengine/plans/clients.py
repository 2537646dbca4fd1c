"""Models behind a client: retries, a fallback model, parameters that a model refuses, token counts; questions made by a model.

A client is made on the worker, once for each task, by a function that travels there. It has
`complete(model, messages, **options) -> {"text", "tokens_in", "tokens_out"}` and `embed(model, texts) -> vectors`.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import strip_reasoning
from docengine.plans.rag import Embedder, Generator, batch_embedder

ANSWER = "response string, tokens_in long, tokens_out long, seconds double, model string, error string"


@dataclass(frozen=True)
class Calls:
    """How a model is called: `models` are tried in order, each `attempts` times with growing pauses."""

    models: tuple[str, ...]
    options: dict = field(default_factory=lambda: {"temperature": 0.0, "max_output_tokens": 512})
    attempts: int = 3
    pause: float = 1.0

    def ask(self, client: object, messages: list[dict]) -> dict:
        """The answer of the first model that gives one. An option that the error names is left out and the call repeated at once."""
        error = "no model"
        for model in self.models:
            options, left = dict(self.options), self.attempts
            while left:
                began = time.perf_counter()
                try:
                    out = client.complete(model, messages, **options)
                    text = out.get("text") or ""
                    if not text.strip():
                        raise ValueError("empty answer")
                    count = lambda s: len(s.split())  # noqa: E731  where the service does not count
                    used = out.get("tokens_in"), out.get("tokens_out")
                    asked = sum(count(m["content"]) for m in messages)
                    return {"response": text, "tokens_in": asked if used[0] is None else used[0], "tokens_out": count(text) if used[1] is None else used[1], "seconds": time.perf_counter() - began, "model": model, "error": None}
                except Exception as e:  # whatever the service raises must stay in the row
                    error = f"{type(e).__name__}: {e}"
                    refused = [o for o in options if o in str(e)]
                    for o in refused:
                        del options[o]
                    if not refused:
                        left -= 1
                        time.sleep(self.pause * 2 ** (self.attempts - left - 1) if left else 0)
        return {"response": None, "tokens_in": None, "tokens_out": None, "seconds": None, "model": None, "error": error}


def calling_generator(connect: Callable[[], object], calls: Calls) -> Generator:
    """A generator for rag.answer that calls a client; reasoning that a model writes before its answer is taken off."""

    @F.pandas_udf(ANSWER)
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = connect()
        for batch in batches:
            rows = [calls.ask(client, [dict(m) for m in json.loads(x)]) for x in batch]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])

    def answer(question: Column, messages: Column) -> Column:
        found = generate(F.to_json(messages))
        return found.withField("response", F.when(found["response"].isNotNull(), strip_reasoning(found["response"])))

    return answer


def calling_embedder(connect: Callable[[], object], model: str, batch: int = 32, attempts: int = 3, pause: float = 1.0, normalize: bool = True) -> Embedder:
    """An embedder that calls a client with `batch` texts at a time; a call that fails `attempts` times is an error."""

    def load() -> Callable[[list[str]], np.ndarray]:
        client = connect()

        def encode(texts: list[str]) -> np.ndarray:
            out: list[Sequence[float]] = []
            for at in range(0, len(texts), batch):
                for attempt in range(attempts):
                    try:
                        out += client.embed(model, texts[at : at + batch])
                        break
                    except Exception:
                        if attempt + 1 == attempts:
                            raise
                        time.sleep(pause * 2**attempt)
            return np.array(out, np.float32)

        return encode

    return batch_embedder(load, normalize)


# fixed values: the request for questions about one document
ASK = "다음 문서를 읽고 질문과 답을 {n}개 만드세요. JSON 배열 [{{\"question\": ..., \"answer\": ...}}] 만 출력하세요.\n\n[사업명] {name}\n[요약] {summary}\n\n[본문]\n{text}"
PAIRS = "array<struct<question: string, answer: string>>"


def parsed_pairs(text: str | None) -> list[tuple[str, str]]:
    """Questions and answers of a model's text: the first JSON array in it, in a fence or not; incomplete entries are left out."""
    found = re.search(r"\[.*\]", text or "", re.S)
    try:
        entries = json.loads(found[0]) if found else []
    except ValueError:
        return []
    return [(x["question"].strip(), x["answer"].strip()) for x in entries if isinstance(x, dict) and all(isinstance(x.get(k), str) and x[k].strip() for k in ("question", "answer"))]


def made_questions(docs: DataFrame, generator: Generator, n: int = 2) -> DataFrame:
    """qid, doc_id, question, reference: at most n questions that a model makes of each document (doc_id, project_name, summary, text).

    Documents without text, and answers that are no JSON, give none; the qid is llm_<number>_<doc_id>.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    head, *rest = re.split(r"\{(?:name|summary|text)\}", ASK.replace("{n}", str(n)).replace("{{", "{").replace("}}", "}"))
    asked = F.concat(F.lit(head), text("project_name"), F.lit(rest[0]), text("summary"), F.lit(rest[1]), text("text"), F.lit(rest[2]))
    messages = F.array(F.struct(F.lit("user").alias("role"), asked.alias("content")))
    pairs = F.pandas_udf(lambda s: s.map(lambda t: [{"question": q, "answer": a} for q, a in parsed_pairs(t)[:n]]), PAIRS)
    rows = docs.where(F.trim(text("text")) != "").select("doc_id", F.posexplode(pairs(generator(F.lit(""), messages)["response"])).alias("i", "p"))
    return rows.select(F.concat(F.lit("llm_"), (F.col("i") + 1).cast("string"), F.lit("_"), F.col("doc_id").cast("string")).alias("qid"), "doc_id", F.col("p.question").alias("question"), F.col("p.answer").alias("reference"))
