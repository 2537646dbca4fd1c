"""Writers: rows as JSON lines or CSV with complex cells as JSON, appended sheets, and a vector table with its settings."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators.search import dense, top_k


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON strings."""
    complex_ = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return df.withColumns({c: F.to_json(c) for c in complex_}) if complex_ else df


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat(df).write.mode(mode).csv(path, header=True, escape='"', encoding="UTF-8")


def append_sheet(df: DataFrame, path: str) -> None:
    """Rows added to a sheet of the same columns."""
    write_csv(df, path, "append")


def write_texts(docs: DataFrame, path: str, column: str = "text") -> None:
    """One folder doc_id=<id> for each document (ids are distinct) with its text and a line end as a file; none without text."""
    docs.where(F.col(column).isNotNull()).select("doc_id", F.col(column).alias("value")).repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of what write_texts has written."""
    return spark.read.text(path, wholetext=True).select("doc_id", F.regexp_replace("value", "\\n\\z", "").alias("text"))


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """A small JSON side-file, by Spark's committed write."""
    text = json.dumps(settings, ensure_ascii=False, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    """The settings that were written, empty where there are none."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        return {}
    return json.loads(row[0]) if row else {}


def flat_metadata(df: DataFrame, columns: Sequence[str]):
    """map<string,string> of the columns that have a value; lists are joined."""
    value = lambda c: F.array_join(c, " > ") if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
    return F.map_filter(F.create_map(*(x for c in columns for x in (F.lit(c), value(c)))), lambda k, v: v.isNotNull() & (v != ""))


class VectorTable:
    """A vector index as a Parquet table: all of the stores the engine replaces differ only in their metric.

    Rows are (doc_id, embedding, ...); upserts replace rows of the same id.
    """

    def __init__(self, spark: SparkSession, path: str, metric: str = "ip", normalize: bool = True):
        self.spark, self.path, self.metric, self.normalize = spark, path, metric, normalize

    def exists(self) -> bool:
        return bool(read_settings(self.spark, f"{self.path}/settings"))

    def build(self, rows: DataFrame, settings: dict | None = None) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/rows-0")
        write_settings(self.spark, {"metric": self.metric, "version": 0} | (settings or {}), f"{self.path}/settings")

    def load(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows-{self.settings()['version']}")

    def settings(self) -> dict:
        return read_settings(self.spark, f"{self.path}/settings")

    def upsert(self, rows: DataFrame) -> None:
        """Writes a new version beside the old one, then points to it."""
        known = self.settings()
        kept = self.load().join(rows.select("doc_id"), "doc_id", "left_anti")
        version = known["version"] + 1
        kept.unionByName(rows, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.path}/rows-{version}")
        write_settings(self.spark, known | {"version": version}, f"{self.path}/settings")

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """Hits with the rows' other columns."""
        rows = self.load()
        hits = dense(rows, queries, k, self.normalize, self.metric)
        return top_k(hits.drop("rank"), k).join(rows.drop("embedding"), "doc_id")
