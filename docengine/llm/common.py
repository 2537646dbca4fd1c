"""Shared plumbing of the corpus operators: inputs, shared folders, samples, batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.sources.storage import written  # noqa: F401  tables in between

#: Python works on slices of about this many bytes of text, whatever the batch size.
SLICE_BYTES = 3 << 20
BATCH, DEFAULT_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20), 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; what goes to Python from now on goes in batches of BATCH_BYTES, unless the session says otherwise.

    The default of 64 MB is held several times over, by the JVM's buffers and by each worker.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH, DEFAULT_BATCH).removesuffix("b") == DEFAULT_BATCH:
        conf.set(BATCH, str(BATCH_BYTES))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the rows do not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the documented hold-out rule."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def held_out(doc_id: Column, n: int, fold: int) -> Column:
    """Whether the id is in the held-out fold; false for a null id."""
    return bucket_of(doc_id, n).eqNullSafe(F.lit(fold))


def labelled_sample(docs: DataFrame, labels: DataFrame, value: str, limit: int) -> DataFrame:
    """Documents of at most `limit` labelled ids (text, label), chosen by a hash of the id.

    The bound holds before the join, so the broadcast side never has more than `limit` rows.
    Repeated label rows of one id give the larger label; repeated documents of one id stay,
    so `limit` bounds ids, and whoever collects rows cuts them to `limit` again.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull())
        .groupBy("doc_id").agg(F.max(value).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return text.join(F.broadcast(ids), "doc_id").select("text", "label")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut at rows so that each piece holds about `size` bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
        at = 0
        while at < n:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(sizes.searchsorted(before + size, side="right")))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: worker processes live on between tasks and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column with null as the empty string, copied: some kernels misread an array with an offset."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    return texts.take(pa.array(np.arange(len(texts))))


def split_words(texts: pa.Array) -> pa.Array:
    """Lists of what stands between ASCII white space (20, 09-0D); runs of it leave empty strings."""
    for space in "\n\t\r\x0b\x0c":
        if space == "\n" or pc.any(pc.match_substring(texts, space)).as_py():
            texts = pc.replace_substring(texts, space, " ")
    return pc.split_pattern(texts, " ")
