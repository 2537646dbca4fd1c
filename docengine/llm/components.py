"""Connected components of an edge table by alternating large and small stars.

Every step is a grouped minimum, which combines before it shuffles, and a join of the edges with one row per
node: a broadcast where the edges, which are counted, are few, so that edges stay where they are; else a
shuffle by node, whose large partitions Spark splits (a sort-merge join under adaptive execution), so that a
node with very many edges does not stay in one task. A step is one job, written to the shared folder; its
count and checksum are observed as it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docengine.llm.common import written


def _smallest(edges: DataFrame, few: bool) -> DataFrame:
    """Each node u with the smallest of u and its neighbours, over edges (u, v)."""
    near = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return F.broadcast(near) if few else near


def _large(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both, few), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, few: bool) -> DataFrame:
    """Edges go from the larger node to the smaller one."""
    near = _smallest(edges, few)
    out = edges.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionAll(near.select("u", F.col("m").alias("v")))


def _observed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges, larger node first and without loops, written; and their number and checksum."""
    seen = Observation()
    rows = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    out = written(rows.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
    return out, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """(node, label): the smallest node of its component, for each node of an edge with two ends.

    Edges are (u, v) of any ordered type without nulls; repeated edges, both directions and loops are allowed,
    and no edges give no rows. Up to `few` edges, the smallest neighbours are broadcast.
    """
    now, mark = _observed(edges)
    while mark[0]:
        last = mark
        now, mark = _observed(_small(_large(now, 2 * mark[0] <= few), 2 * mark[0] <= few))
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
