"""Evaluation of retrieval and answers: row scores, summaries, groups and failures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import metrics as M
from docengine.functions import text as X

#: Metrics by name: (retrieved, gold, k) -> column.
METRICS: dict[str, Callable[[Column, Column, int], Column]] = {
    "hits": lambda r, g, k: M.hits(r, g, k).cast("double"), "hit_rate": lambda r, g, k: M.hit_at(r, g, k).cast("double"), "precision": M.precision_at, "recall": M.recall_at,
    "f1": M.f1_at, "mrr": M.reciprocal_rank, "ndcg": M.ndcg_at, "map": M.average_precision_at, "top1": lambda r, g, k: M.top1(r, g).cast("double"),
}


def metric(name: str, retrieved: Column, gold: Column) -> Column:
    """A metric named like "recall@5"; without a number k is 5."""
    kind, _, k = name.partition("@")
    if kind not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[kind](retrieved, gold, int(k or 5))


def retrieval_scores(rows: DataFrame, names: Sequence[str], compact: bool = True) -> DataFrame:
    """The rows (retrieved, gold) that have gold ids, with a column for each metric.

    compact: a document retrieved twice counts at its first place and later ones move up.
    """
    retrieved = F.array_distinct("retrieved") if compact else F.col("retrieved")
    rows = rows.where(F.size("gold") > 0)
    return rows.withColumns({n: metric(n, retrieved, F.col("gold")) for n in names})


def summarize(scored: DataFrame, names: Sequence[str], groups: Sequence[str] = (), places: int = 6) -> DataFrame:
    """Means of the metrics and the number of rows; with groups by each of them alone and in all.

    Groups are one pass of grouping sets; a null value is the group "unknown".
    """
    means = [F.round(F.coalesce(F.avg(n), F.lit(0.0)), places).alias(n.replace("@", "_at_")) for n in names]
    if not groups:
        return scored.agg(*means, F.count("*").alias("num_rows"))
    named = scored.withColumns({g: F.coalesce(F.col(g).cast("string"), F.lit("unknown")) for g in groups})
    key = F.coalesce(*(F.when(F.grouping(g) == 0, F.lit(g)) for g in groups), F.lit("all")).alias("group_key")
    value = F.coalesce(*(F.when(F.grouping(g) == 0, F.col(g)) for g in groups), F.lit("all")).alias("group_value")
    sets = [[F.col(g)] for g in groups] + [[]]
    return named.groupingSets(sets, *(F.col(g) for g in groups)).agg(key, value, *means, F.count("*").alias("num_rows")).select("group_key", "group_value", *(n.replace("@", "_at_") for n in names), "num_rows")


def retrieval_failures(rows: DataFrame, k: int = 5) -> DataFrame:
    """Rows without a gold id among the first k; rows without gold ids too."""
    return rows.where(~F.coalesce(F.arrays_overlap(F.slice("retrieved", 1, k), F.col("gold")), F.lit(False)))


def keyword_scores(rows: DataFrame, unicode: bool = True) -> DataFrame:
    """Rows (answer, groups) with matched and missed keyword groups and their recall, 0 without groups.

    Both sides are normalised for comparison; without unicode, for texts known to be in form KC.
    """
    empty = F.expr("cast(array() as array<array<string>>)")
    rows = rows.withColumn("groups", F.coalesce("groups", empty)).withColumn("__a", X.normalize_for_eval(F.col("answer"), unicode))
    rows = rows.withColumn("__g", X.nfkc_groups("groups") if unicode else F.col("groups"))
    normal = lambda k: X.normalize_for_eval(k, unicode=False)
    hit = F.transform("__g", lambda g: F.exists(g, lambda k: (normal(k) != "") & F.contains("__a", normal(k))))
    pick = lambda want: F.filter("groups", lambda g, i: F.get("__h", i) == F.lit(want))
    n = F.size("groups")
    out = rows.withColumn("__h", hit).withColumns({"matched_groups": pick(True), "missed_groups": pick(False)})
    out = out.withColumns({"n_matched": F.size("matched_groups"), "n_groups": n}).drop("__a", "__g", "__h")
    return out.withColumn("keyword_recall", F.when(n > 0, F.col("n_matched") / n).otherwise(0.0))


def keyword_summary(scored: DataFrame, places: int = 6) -> DataFrame:
    return scored.agg(
        F.round(F.avg("keyword_recall"), places).alias("keyword_recall"), F.round(F.avg((F.col("keyword_recall") >= 1.0).cast("double")), places).alias("exact_rate"),
        F.round(F.avg("n_matched"), places).alias("avg_matched"), F.round(F.avg("n_groups"), places).alias("avg_groups"), F.count("*").alias("num_rows"),
    )


#: Values are placed in so many bins of about as many distinct ones; only the bins that hold a percentile are put in order.
BINS = 100


def nearest_ranks(counted: DataFrame, by: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """For each group, the value at the rounded (half to even) place (n - 1) * p of each p, as p50 for 0.5.

    counted: by (no nulls), value, c (how often). Bounds of the bins come from a sketch, counts are exact; what one
    task orders is one bin's distinct values, whatever the size of a group.
    """
    edges = counted.groupBy(*by).agg(F.percentile_approx("value", [i / BINS for i in range(1, BINS)], F.lit(100 * BINS)).alias("edges"), F.sum("c").alias("n"))
    binned = counted.join(edges, list(by)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("value")))).drop("edges")
    sums = binned.groupBy(*by, "bin").agg(F.sum("c").alias("in_bin"), F.first("n").alias("n"))
    sums = sums.withColumn("before", F.sum("in_bin").over(Window.partitionBy(*by).orderBy("bin")) - F.col("in_bin"))  # BINS rows a group
    asked = sums.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in ps)))).withColumn("place", F.rint((F.col("n") - 1) * F.col("p")) - F.col("before"))
    asked = asked.where((F.col("place") >= 0) & (F.col("place") < F.col("in_bin"))).select(*by, "bin", "p", "place")
    near = binned.join(asked, [*by, "bin"])
    near = near.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "bin", "p").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda p: F.min(F.when((F.col("p") == F.lit(float(p))) & (F.col("upto") > F.col("place")), F.col("value"))).alias(f"p{round(100 * p)}")
    return near.groupBy(*by).agg(*(at(p) for p in ps))


def efficiency(rows: DataFrame, values: Sequence[str], group: str | None = None, places: int = 6) -> DataFrame:
    """Count, mean, sum, and nearest-rank p50 and p95 of numeric columns; what cannot be read as a number is skipped.

    A null group is "unknown".
    """
    by = [group] if group else []
    named = rows.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("unknown"))) if group else rows
    stack = F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("string").try_cast("double").alias("value")) for v in values)))
    long = named.select(*by, stack.alias("m")).select(*by, "m.metric", "m.value").where("value is not null")
    sums = long.groupBy(*by, "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), places).alias("mean"), F.round(F.sum("value"), places).alias("total"))
    counted = long.groupBy(*by, "metric", "value").agg(F.count("*").alias("c"))
    return sums.join(nearest_ranks(counted, [*by, "metric"], (0.5, 0.95)), [*by, "metric"])


#: Price tables of more rows are joined by a shuffle.
PRICES = 100_000


def costs(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows (model, tokens_in, tokens_out, error) with a cost by the price table (model, price_in, price_out), whose rows are counted.

    Models without a price cost nothing, rows with an error are not counted in sums of `cost`.
    """
    joined = rows.join(F.broadcast(prices) if prices.count() <= PRICES else prices, "model", "left")
    cost = M.llm_cost(F.col("tokens_in"), F.col("tokens_out"), F.coalesce("price_in", F.lit(0.0)), F.coalesce("price_out", F.lit(0.0)))
    return joined.withColumn("cost", cost).withColumn("total_tokens", F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0)))


# ---- relevance by keywords, where no gold ids are known


def is_relevant(text: Column, groups: Column) -> Column:
    """Every group has a keyword in the text, both in simple form; no groups: true."""
    low = X.normalize_simple(text)
    return F.forall(groups, lambda g: F.exists(g, lambda k: F.contains(low, X.normalize_simple(k))))


def keyword_retrieval(rows: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Rows (contexts, groups) with hit, mrr, top1 and first rank at each k of the contexts that are relevant."""
    flags = F.transform(F.coalesce("contexts", F.expr("cast(array() as array<string>)")), lambda t: is_relevant(t, F.col("groups")))
    out = rows.withColumn("__f", flags)
    place = lambda k: F.array_position(F.slice("__f", 1, k), True)
    columns: dict[str, Column] = {}
    for k in ks:
        at = F.when(place(k) > 0, place(k))
        columns |= {f"hit_{k}": at.isNotNull().cast("double"), f"mrr_{k}": F.coalesce(1.0 / at, F.lit(0.0)), f"top1_{k}": F.coalesce((at == 1).cast("double"), F.lit(0.0)), f"first_{k}": at.cast("int")}
    return out.withColumns(columns).drop("__f")


def keyword_coverage(rows: DataFrame) -> DataFrame:
    """Rows (answer, groups) with the share of groups that the answer covers, 1 without groups, and whether it is all."""
    low = X.normalize_simple(F.col("answer"))
    n = F.size(F.coalesce("groups", F.expr("cast(array() as array<array<string>>)")))
    found = F.size(F.filter("groups", lambda g: F.exists(g, lambda k: F.contains(low, X.normalize_simple(k)))))
    out = rows.withColumns({"n_groups": n, "n_hit": F.when(n > 0, found).otherwise(0)})
    return out.withColumns({"coverage": F.when(F.col("n_groups") > 0, F.col("n_hit") / F.col("n_groups")).otherwise(1.0), "all_pass": F.col("n_hit") == F.col("n_groups")})


def qrels(rows: DataFrame) -> DataFrame:
    """qid, doc_id, gain: gold ids in long form, gain 1."""
    return rows.select("qid", F.explode(F.array_distinct("gold")).alias("doc_id"), F.lit(1).alias("gain"))


def run_table(rows: DataFrame, scores: str | None = None) -> DataFrame:
    """qid, doc_id, score of the first place of each retrieved id; without scores that of the reciprocal rank."""
    given = F.get(F.col(scores), F.col("pos")) if scores else F.lit(None).cast("double")
    cells = rows.select("qid", *([scores] if scores else []), F.posexplode("retrieved").alias("pos", "doc_id"))
    cells = cells.withColumn("score", F.coalesce(given, 1.0 / (F.col("pos") + 1)))
    return cells.groupBy("qid", "doc_id").agg(F.min_by("score", "pos").alias("score"))


def page_count(chunks: DataFrame) -> DataFrame:
    """Distinct pages and sections of each document's chunks (page_start, page_end, section)."""
    pages = chunks.select("doc_id", F.explode_outer(F.sequence("page_start", "page_end")).alias("page"), "section")
    return pages.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), F.countDistinct("section").alias("sections"))
