"""Vectors in a database that Spark reaches by JDBC, such as PostgreSQL with its vector type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.operators.search import dense


def literal(embedding: Column) -> Column:
    """An array of numbers as the text [x,y,...] that a vector column takes."""
    return F.concat(F.lit("["), F.array_join(F.transform(embedding, lambda x: x.cast("string")), ","), F.lit("]"))


class JdbcVectors:
    """Rows (doc_id, embedding as text, content, metadata as JSON, version) of one table; no content is the empty text.

    JDBC writes append, so an upsert adds rows of a higher version and reading takes the newest row of each id;
    the database may drop older ones at any time. Searches either read the rows, in parts by doc_id, and hold the
    queries against them here, or let the database order them (`match`).
    """

    COLUMNS = ("doc_id", "embedding", "content", "metadata", "version")

    def __init__(self, spark: SparkSession, url: str, table: str, batch: int = 100, **options: str):
        self.spark, self.url, self.table, self.batch, self.options = spark, url, table, batch, options

    def _read(self, source: str, **more: object) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=source, **self.options, **more).load().toDF(*self.COLUMNS)

    def _newest(self) -> int:
        found = self.spark.read.format("jdbc").options(url=self.url, query=f'SELECT MAX("version") AS "v" FROM {self.table}', **self.options).load().first()
        return -1 if found is None or found[0] is None else int(found[0])

    def _write(self, rows: DataFrame, version: int, mode: str) -> None:
        given = [F.coalesce(F.col(c).cast("string") if c in rows.columns else F.lit(None), F.lit("")).alias(c) for c in ("content", "metadata")]
        out = rows.select(F.col("doc_id").cast("long"), literal(F.col("embedding")).alias("embedding"), *given, F.lit(version).alias("version"))
        out.write.format("jdbc").options(url=self.url, dbtable=self.table, batchsize=self.batch, **self.options).mode(mode).save()

    def build(self, rows: DataFrame) -> None:
        """Replaces the table by the rows (doc_id, embedding, and content and metadata where there are any)."""
        self._write(rows, 0, "overwrite")

    def upsert(self, rows: DataFrame) -> None:
        self._write(rows, self._newest() + 1, "append")

    def load(self, parts: int = 1, low: int = 0, high: int = 0) -> DataFrame:
        """The newest row of each id; read in `parts` queries over the ids from low to high."""
        more = {"partitionColumn": "doc_id", "lowerBound": low, "upperBound": high, "numPartitions": parts} if parts > 1 else {}
        newest = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("version")))
        rows = self._read(self.table, **more).withColumn("nth", newest).where("nth = 1").drop("nth", "version")
        return rows.withColumn("embedding", F.from_json("embedding", "array<float>"))

    def search(self, queries: DataFrame, k: int = 5, parts: int = 1, low: int = 0, high: int = 0) -> DataFrame:
        """Hits (qid, doc_id, score, rank, content, metadata) by inner product of unit vectors."""
        rows = self.load(parts, low, high)
        return dense(rows, queries, k, normalize=True).join(rows.drop("embedding"), "doc_id")

    def match_query(self, vector: list[float], k: int = 5) -> str:
        """SQL of the database's own nearest rows by cosine distance, of the newest version of each id."""
        numbers = ",".join(repr(float(x)) for x in vector)
        newest = f"SELECT t.* FROM {self.table} t WHERE t.version = (SELECT MAX(o.version) FROM {self.table} o WHERE o.doc_id = t.doc_id)"
        return f"SELECT doc_id, content, metadata, 1 - (CAST(embedding AS vector) <=> '[{numbers}]') AS score FROM ({newest}) n ORDER BY CAST(embedding AS vector) <=> '[{numbers}]', doc_id LIMIT {int(k)}"

    def match(self, vector: list[float], k: int = 5) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, query=self.match_query(vector, k), **self.options).load()
