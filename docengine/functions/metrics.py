"""Retrieval and answer metrics of one row, as column expressions; BLEU and ROUGE-L as Pandas UDFs."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions.text import words


def gold_ids(ids: Column, doc_id: Column) -> Column:
    """Trimmed gold ids; the document id where there are none."""
    given = F.filter(F.transform(F.coalesce(ids, F.expr("cast(array() as array<string>)")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    own = F.trim(doc_id.cast("string"))
    return F.when(F.size(given) > 0, given).when(own != "", F.array(own)).otherwise(F.expr("cast(array() as array<string>)"))


def hits(retrieved: Column, gold: Column, k: int) -> Column:
    return F.size(F.filter(F.slice(retrieved, 1, k), lambda x: F.array_contains(gold, x)))


def hit_at(retrieved: Column, gold: Column, k: int) -> Column:
    return F.arrays_overlap(F.slice(retrieved, 1, k), gold).cast("int")


def precision_at(retrieved: Column, gold: Column, k: int) -> Column:
    return hits(retrieved, gold, k) / F.lit(float(k))


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    found = F.size(F.array_intersect(F.slice(retrieved, 1, k), gold))
    return F.when(F.size(gold) > 0, found / F.size(F.array_distinct(gold))).otherwise(0.0)


def f1_at(retrieved: Column, gold: Column, k: int) -> Column:
    p, r = precision_at(retrieved, gold, k), recall_at(retrieved, gold, k)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def first_rank(retrieved: Column, gold: Column, k: int) -> Column:
    """The first relevant rank within k, null if none."""
    at = F.array_position(F.transform(F.slice(retrieved, 1, k), lambda x: F.array_contains(gold, x)), True)
    return F.when(at > 0, at)


def reciprocal_rank(retrieved: Column, gold: Column, k: int) -> Column:
    return F.coalesce(1.0 / first_rank(retrieved, gold, k), F.lit(0.0))


def top1(retrieved: Column, gold: Column) -> Column:
    return hit_at(retrieved, gold, 1)


def _gains(retrieved: Column, gold: Column, k: int) -> Column:
    return F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(gold, x), F.lit(math.log(2)) / F.log(i + 2.0)).otherwise(0.0))


def ndcg_at(retrieved: Column, gold: Column, k: int) -> Column:
    dcg = F.aggregate(_gains(retrieved, gold, k), F.lit(0.0), lambda a, x: a + x)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.size(F.array_distinct(gold)), F.lit(k))), F.lit(0.0), lambda a, i: a + F.lit(math.log(2)) / F.log(i + 1.0))
    return F.when(F.size(gold) > 0, dcg / ideal).otherwise(0.0)


def average_precision_at(retrieved: Column, gold: Column, k: int) -> Column:
    relevant = F.transform(F.slice(retrieved, 1, k), lambda x: F.array_contains(gold, x).cast("int"))
    summed = F.aggregate(
        relevant, F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0.0).alias("s")),
        lambda a, x: F.struct((a.i + 1).alias("i"), (a.n + x).alias("n"), (a.s + F.when(x == 1, (a.n + 1) / (a.i + 1)).otherwise(0.0)).alias("s")),
    )
    return F.when(F.size(gold) > 0, summed.s / F.size(F.array_distinct(gold))).otherwise(0.0)


def matched_groups(answer: Column, groups: Column) -> Column:
    """Groups of which a keyword is in the answer, both already normalised."""
    return F.filter(groups, lambda g: F.exists(g, lambda k: (k != "") & F.contains(answer, k)))


def _occurrences(words: Column) -> Column:
    """The words in order, each with the number of the same word before it: multisets as sets."""
    return F.transform(F.array(F.sort_array(words)), lambda s: F.transform(s, lambda x, i: F.concat(x, F.lit("\u0000"), (i - F.array_position(s, x)).cast("string"))))[0]


def token_f1(gold: Column, answer: Column) -> Column:
    """Multiset F1 of white-space tokens; with an empty side 1 only if the texts are equal."""
    same = (F.coalesce(gold, F.lit("")) == F.coalesce(answer, F.lit(""))).cast("double")

    def counted(x: Column) -> Column:
        common = F.size(F.array_intersect(_occurrences(x["a"]), _occurrences(x["b"])))
        return F.struct(F.size(x["a"]).alias("a"), F.size(x["b"]).alias("b"), common.alias("common"), x["same"].alias("same"))

    def score(x: Column) -> Column:
        p, r = x["common"] / x["b"], x["common"] / x["a"]
        return F.when((x["a"] == 0) | (x["b"] == 0), x["same"]).when(x["common"] == 0, 0.0).otherwise(2 * p * r / (p + r))

    # lists of one, so that the words are split and counted once and not wherever they are named
    pair = F.array(F.struct(words(gold).alias("a"), words(answer).alias("b"), same.alias("same")))
    return F.transform(F.transform(pair, counted), score)[0]


def bleu_score(gold: str | None, answer: str | None, weights: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25)) -> float:
    """Clipped n-gram precisions with a brevity penalty; a zero count above unigrams counts as 0.1."""
    a, b = (gold or "").split(), (answer or "").split()
    if not a or not b:
        return 0.0
    total = 0.0
    for n, weight in enumerate(weights, 1):
        mine, theirs = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (b, a))
        found = sum((mine & theirs).values())
        if n == 1 and not found:
            return 0.0
        if weight:
            total += weight * math.log((found or 0.1) / max(1, sum(mine.values())))
    return math.exp(total) * (1.0 if len(b) > len(a) else math.exp(1 - len(a) / len(b)))


def rouge_l_score(gold: str | None, answer: str | None, any_script: bool = False) -> float:
    """F of the longest common subsequence of lower-case tokens, [a-z0-9]+ or, with any_script, letters and digits."""
    pattern = r"[^\W_]+" if any_script else r"[a-z0-9]+"
    a, b = (re.findall(pattern, (t or "").lower()) for t in (gold, answer))
    if not a or not b:
        return 0.0
    place: dict[str, int] = {}
    for j, x in enumerate(b):
        place[x] = place.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    unmatched = full  # a zero bit for each step of the longest common subsequence along b
    for x in a:
        met = unmatched & place.get(x, 0)
        unmatched = ((unmatched + met) | (unmatched - met)) & full
    common = len(b) - unmatched.bit_count()
    return 2 * common / (len(a) + len(b)) if common else 0.0


@F.pandas_udf(T.DoubleType())
def bleu(gold: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([bleu_score(a, b) for a, b in zip(gold, answer, strict=True)])


@F.pandas_udf(T.DoubleType())
def rouge_l(gold: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([rouge_l_score(a, b) for a, b in zip(gold, answer, strict=True)])


def llm_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are for a million tokens."""
    return F.coalesce(tokens_in, F.lit(0)) / 1e6 * price_in + F.coalesce(tokens_out, F.lit(0)) / 1e6 * price_out


def nearest_rank(values: Column, p: float) -> Column:
    """Of a sorted array, the value at the rounded (half to even) place (n - 1) * p."""
    return F.coalesce(F.element_at(values, (F.rint((F.size(values) - 1) * F.lit(p)) + 1).cast("int")), F.lit(0.0))
