import json
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docengine.plans import clients, rag
from docengine.plans.clients import Calls


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Fake:
    """Model a refuses a temperature, b is always down, c answers at the second call."""

    def __init__(self):
        self.calls = 0

    def complete(self, model, messages, **options):
        self.calls += 1
        if model == "a" and "temperature" in options:
            raise ValueError("unsupported parameter: temperature")
        if model == "b" or (model == "c" and self.calls % 2):
            raise RuntimeError("busy")
        text = messages[-1]["content"]
        return {"text": f"<think>hm</think>{model}:{len(text)}", "tokens_in": 7 if model == "a" else None}

    def embed(self, model, texts):
        self.calls += 1
        if self.calls == 1:
            raise RuntimeError("busy")
        return [[len(t), 1.0] for t in texts]


def test_options_retries_and_fallback():
    message = [{"role": "user", "content": "x y z"}]
    a = Calls(("a",), pause=0).ask(Fake(), message)
    assert (a["model"], a["tokens_in"], a["tokens_out"], a["error"]) == ("a", 7, 1, None)
    c = Calls(("b", "c"), attempts=2, pause=0).ask(Fake(), message)
    assert (c["model"], c["tokens_in"]) == ("c", 3)
    b = Calls(("b",), attempts=2, pause=0).ask(Fake(), message)
    assert b["response"] is None and b["error"] == "RuntimeError: busy"
    assert Calls((), pause=0).ask(Fake(), message)["error"] == "no model"


def test_answers(spark):
    chunks = spark.createDataFrame([(1, "red apple"), (2, "blue sky")], "doc_id long, text string")
    asked = spark.createDataFrame([(10, "apple"), (11, "nothing like it")], "qid long, text string")
    got = {r.qid: r for r in rag.run(chunks, asked, clients.calling_generator(Fake, Calls(("b", "a"), attempts=1, pause=0)), rag.Settings(top_k=1)).collect()}
    assert got[10].retrieved == ["1"] and got[10].answer.startswith("a:") and got[10].tokens_in == 7 and got[11].error is None
    down = rag.run(chunks, asked, clients.calling_generator(Fake, Calls(("b",), attempts=1, pause=0))).collect()
    assert {r.error for r in down} == {"RuntimeError: busy"} and {r.answer for r in down} == {None}


def test_embedder(spark):
    rows = spark.createDataFrame([("abc",), (None,)], "t string").coalesce(1)
    got = rows.select(clients.calling_embedder(Fake, "m", batch=1, pause=0)(F.col("t")).alias("e")).collect()
    assert np.allclose(got[0].e, np.array([3, 1]) / 10**0.5) and np.allclose(got[1].e, [0, 1])


def test_made_questions(spark):
    docs = spark.createDataFrame([(1, "p", None, "body {x}"), (2, None, "s", " "), (3, "q", "s", "bad")], "doc_id long, project_name string, summary string, text string")

    def generator(question, messages):
        asked = messages[0]["content"]
        pairs = json.dumps([{"question": "q1 ", "answer": "a1"}, {"question": ""}, {"question": "q2", "answer": "a2"}, {"question": "q3", "answer": "a3"}])
        return F.struct(F.when(asked.contains("bad"), "no json").otherwise(F.concat(F.lit("```json\n"), F.lit(pairs), F.lit("\n```"))).alias("response"))

    got = sorted(tuple(r) for r in clients.made_questions(docs, generator).collect())
    assert got == [("llm_1_1", 1, "q1", "a1"), ("llm_2_1", 1, "q2", "a2")]
