"""Data quality of documents and question sets: duplicates, empty pages, rejection reasons, samples, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.text import content_hash, is_null_like, is_table_text


#: A hash with more documents than this is hot; of n documents at most n / HOT hashes are.
HOT = 1_000_000


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, hash, copies of documents whose text without white space occurs more than once.

    Hashes of more than HOT documents (the empty text, for one) are so few that they are broadcast; documents of
    the other hashes are joined by a shuffle in which no key has more than HOT rows.
    """
    hashed = docs.select("doc_id", content_hash(F.col("text")).alias("hash"))
    counted = hashed.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1")
    hot = F.broadcast(counted.where(F.col("copies") > HOT))
    rest = hashed.join(hot, "hash", "left_anti").join(counted.where(F.col("copies") <= HOT), "hash")
    return rest.unionByName(hashed.join(hot, "hash")).select("doc_id", "hash", "copies")


def keep_first(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """The first document of each hash, with flags: needs_ocr (no text to speak of), has_table.

    The first is found by a grouped minimum, which combines before the shuffle, so copies never meet in one task.
    """
    marked = docs.withColumn("hash", content_hash(F.col("text")))
    first = marked.groupBy("hash").agg(F.min(order).alias(order))
    return marked.join(first, ["hash", order], "left_semi").withColumns({"needs_ocr": F.length("text") < 50, "has_table": is_table_text(F.col("text"))})


def page_report(docs: DataFrame, shortest: int = 50, longest: int = 2000) -> DataFrame:
    """Counts of short, long and table texts and of distinct hashes."""
    n = F.count("*")
    return docs.agg(
        n.alias("num_docs"), F.count_if(F.length("text") < shortest).alias("ghosts"), F.count_if(F.length("text") > longest).alias("oversize"),
        F.count_if(is_table_text(F.col("text"))).alias("tables"), F.countDistinct(content_hash(F.col("text"))).alias("distinct_texts"),
    )


def rejection_reasons(items: DataFrame) -> DataFrame:
    """Items (qid, question, reference, gold_ids, groups, ord) with the reasons to reject them, empty if none.

    Of items with the same qid those after the first by ord are rejected; items without a valid qid are spread over
    tasks by their ord, since nothing is compared among them.
    """
    own = F.when(is_null_like(F.col("qid")), F.concat(F.lit("\u0000"), F.col("ord").cast("string"))).otherwise(F.col("qid").cast("string"))
    repeated = F.row_number().over(Window.partitionBy(own).orderBy("ord")) > 1
    no_gold = F.coalesce(F.size("gold_ids") <= 0, F.lit(True)) | F.coalesce(F.exists("gold_ids", is_null_like), F.lit(True))
    groups_ok = F.coalesce((F.size("groups") > 0) & F.forall("groups", lambda g: F.exists(g, lambda k: ~is_null_like(k))), F.lit(False))
    reasons = F.array(
        F.when(is_null_like(F.col("qid")), "invalid_qid").when(F.contains(F.lower(F.col("qid").cast("string")), F.lit("nan")), "qid_contains_nan"),
        F.when(is_null_like(F.col("question")), "empty_question"), F.when(is_null_like(F.col("reference")), "empty_reference"), F.when(no_gold, "invalid_or_nan_gold_ids"),
        F.when(~groups_ok, "invalid_required_keyword_groups"), F.when(~is_null_like(F.col("qid")) & repeated, "duplicated_qid"),
    )
    return items.withColumn("reasons", F.array_compact(reasons))


def backfill_doc_id(items: DataFrame) -> DataFrame:
    """The items without gold_ids, whose first fills an empty doc_id."""
    own = F.nullif(F.trim(F.col("doc_id").cast("string")), F.lit(""))
    return items.withColumn("doc_id", F.coalesce(own, F.get("gold_ids", F.lit(0)))).drop("gold_ids")


def reason_counts(items: DataFrame) -> DataFrame:
    return items.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def question_type(qid: Column) -> Column:
    low = F.lower(qid)
    return F.when(F.contains(low, F.lit("fact_budget")), "fact_budget").when(F.contains(low, F.lit("llm_1")), "llm_1").when(F.contains(low, F.lit("llm_2")), "llm_2").otherwise("unknown")


def source_type(kind: Column) -> Column:
    return F.when(kind == "fact_budget", "metadata").otherwise("document")


def answer_format(kind: Column, question: Column) -> Column:
    has = lambda *words: F.coalesce(question.rlike("|".join(words)), F.lit(False))
    return F.when(kind == "fact_budget", "money").when(has("연락처", "전화", "담당자"), "contact").when(has("기간", "기한", "일정"), "period").when(kind == "llm_2", "list").otherwise("summary")


def quotas(size: int, types: Sequence[str]) -> dict[str, int]:
    """How many of each type: two known sizes, else even shares with the rest to the first types."""
    known = {20: (5, 7, 8), 30: (8, 11, 11)}  # fixed values
    if len(types) == 3 and size in known:
        return dict(zip(types, known[size], strict=True))
    return {t: size // len(types) + (i < size % len(types)) for i, t in enumerate(types)}


def balanced_sample(items: DataFrame, size: int, types: Sequence[str], kind: str = "kind", key: str = "qid", seed: int = 42) -> DataFrame:
    """A sample by type quotas in an order that the seed and the key fix; short types are topped up from the others."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    wanted = quotas(size, types)
    quota = F.coalesce(*(F.when(F.col(kind) == t, n) for t, n in wanted.items()), F.lit(0))
    ranked = items.withColumn("place", order).withColumn("nth", F.row_number().over(Window.partitionBy(kind).orderBy("place", key)))
    # no more than `size` of each type can be taken, so what is ordered as a whole is bounded
    pool = ranked.where(F.col("nth") <= size).withColumn("extra", (F.col("nth") > quota).cast("int"))
    return pool.orderBy("extra", "place", key).limit(size).drop("place", "nth", "extra")


def fingerprint(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """One digest of all rows that changes with their content or order, without bringing them together.

    Each row's digest is bound to its place by `order` and added up in 128 bits of two halves.
    """
    each = F.sha2(F.concat_ws("\u001f", F.col(order).cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns)), 256)
    half = lambda at: F.sum(F.conv(F.substring(each, at, 15), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.count("*").alias("num_rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), half(1).cast("string"), half(16).cast("string")), 256).alias("digest"))
