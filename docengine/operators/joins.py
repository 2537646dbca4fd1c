"""Joins by priority, with the value that is there kept, and updates by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.text import normalize_file_name

SUFFIX_ORDER = ("pdf", "hwp", "docx")


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, "\\.[^.]+$", "")


def match_names(wanted: DataFrame, files: DataFrame, shortest: int = 4, unicode: bool = True) -> DataFrame:
    """Each wanted name with the file it means and the tier of the match: the same name, the same normalised name,
    the same normalised stem, one stem inside the other.

    The last tier joins by runs of `shortest` characters, of the shorter stem the one that occurs least, not all with
    all; stems shorter than that only match in the tiers before. Ties go to the better suffix, then the smaller path.
    Files of one key count as their best one. Joins are merged: Spark would broadcast by the size of the compressed files,
    which tells little of names and nothing of runs.
    """
    a = wanted.select("name").distinct().withColumn("norm", normalize_file_name(F.col("name"), unicode)).withColumn("stem", _stem(F.col("norm")))
    b = files.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("file")).withColumn("norm", normalize_file_name(F.col("file"), unicode)).withColumn("stem", _stem(F.col("norm")))
    b = b.withColumn("suffix", F.coalesce(F.array_position(F.array(*map(F.lit, SUFFIX_ORDER)), F.regexp_extract("norm", "\\.([^.]+)$", 1)), F.lit(0)))
    b = b.withColumn("suffix", F.when(F.col("suffix") > 0, F.col("suffix")).otherwise(99))
    file = F.min(F.struct("suffix", "path")).alias("file")

    def same(key: str, other: str, tier: int) -> DataFrame:
        c = b.where(F.col(other) != "") if tier == 3 else b
        c = c.groupBy(F.col(other).alias("key")).agg(file)
        return a.join(c.hint("merge"), F.col(key) == F.col("key")).select("name", "file.*", F.lit(tier).alias("tier"))

    def windows(c: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - shortest + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(shortest))))

    def inside(short: DataFrame, long: DataFrame) -> DataFrame:
        t = long.select(F.col("stem").alias("long"), F.explode(windows(F.col("stem"))).alias("gram"))
        seen = t.groupBy("gram").agg(F.count("*").alias("n"))
        grams = short.where(F.length("stem") >= shortest).select(F.col("stem").alias("short"), F.explode(windows(F.col("stem"))).alias("gram"))
        rarest = grams.join(seen.hint("merge"), "gram", "left").groupBy("short").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
        return rarest.join(t.hint("merge"), "gram").where(F.contains(F.col("long"), F.col("short"))).select("short", "long")

    ours, theirs = a.select("stem").distinct(), b.groupBy("stem").agg(file)
    links = inside(ours, theirs).toDF("ours", "theirs").unionByName(inside(theirs, ours).toDF("theirs", "ours"))
    part = links.join(theirs.hint("merge"), F.col("theirs") == F.col("stem")).groupBy("ours").agg(F.min("file").alias("file"))
    part = a.join(part.hint("merge"), F.col("stem") == F.col("ours")).select("name", "file.*", F.lit(4).alias("tier"))
    found = same("name", "file", 1).unionByName(same("norm", "norm", 2)).unionByName(same("stem", "stem", 3)).unionByName(part)
    best = found.groupBy("name").agg(F.min(F.struct("tier", "suffix", "path")).alias("best"))
    return wanted.join(best, "name", "left").select(*wanted.columns, F.col("best.path").alias("path"), F.col("best.tier").alias("tier"))


def enrich(rows: DataFrame, meta: DataFrame, key: str, columns: Sequence[str], last: str | None = None) -> DataFrame:
    """The rows with empty columns filled from meta by key; of repeated keys in meta the last by `last` counts."""
    side = meta.groupBy(key).agg(*((F.max_by(c, last) if last else F.max(c)).alias(f"__{c}") for c in columns))
    present = [c for c in columns if c in rows.columns]
    joined = rows.join(side, key, "left")
    own = {c: F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.col(f"__{c}")) if c in present else F.col(f"__{c}") for c in columns}
    return joined.withColumns(own).drop(*(f"__{c}" for c in columns))


def merge_update(rows: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], condition: Column | None = None) -> DataFrame:
    """The rows with columns replaced where changes (one row per key) has the key and the condition holds on it."""
    side = changes.select(key, *(F.col(c).alias(f"__{c}") for c in columns), (F.lit(True) if condition is None else condition).alias("__on"))
    joined = rows.join(side, key, "left")
    return joined.withColumns({c: F.when(F.coalesce("__on", F.lit(False)), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop("__on", *(f"__{c}" for c in columns))


def merge_fields(base: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer join in which the base's values win unless they are null or empty."""
    side = other.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    filled = {c: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"__{c}")) for c in columns}
    return base.select(*keys, *columns).join(side, list(keys), "full").withColumns(filled).select(*keys, *columns)


def chunk_identity(chunk_id: Column, doc_id: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(chunk_id), F.lit("")), F.concat(doc_id.cast("string"), F.lit(":"), F.substring(text, 1, 80)))


def first_by(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The first row of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", nth).where("__n = 1").drop("__n")
