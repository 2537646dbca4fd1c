"""Token files: ids coded by a static range asymmetric numeral system.

A file holds whole documents, about FILE_IDS ids. It has one frequency table, counted over all of its
ids and shared by its blocks; each block is a stream of LANES interleaved 64-bit states that is decoded
on its own. Every CHECKPOINT steps a block keeps its states and the place in its words, so that reading
can begin there. Blocks have checksums of their words and of their ids.

Layout, little-endian: magic "RNS1", then six unsigned 32-bit numbers (documents, ids, bits, blocks,
bytes of the directory, bytes of the table), the directory (zlib: null flags, ids of documents, lengths),
the table (zlib: symbols, frequencies), and for each block a 32-bit size and its bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import slices, small_batches, text_of, written
from docengine.llm.tokens import encoder, with_end

MAGIC = b"RNS1"
BITS = 20
LOW = np.uint64(1 << 31)
LANES = 4096
BLOCK_IDS = 1 << 20
FILE_IDS = 1 << 22
CHECKPOINT = 128
#: Bytes of text that are encoded at a time.
SLICE = 4 << 20
#: Characters of a text that order rows of one id.
HEAD_CHARS = 32
HEAD = struct.Struct("<4s6I")
BLOCK = struct.Struct("<6I")


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their frequencies, at least 1 each, which sum to 2**BITS."""
    symbols, counts = np.unique(ids, return_counts=True)
    if not len(symbols):
        return symbols.astype("<u4"), counts.astype("<u4")
    if len(symbols) > 1 << BITS:
        raise ValueError(f"{len(symbols)} symbols do not fit {BITS} bits")
    spare = (1 << BITS) - len(symbols)
    exact = counts * (spare / counts.sum())
    freq = np.floor(exact).astype(np.int64)
    rest = spare - int(freq.sum())
    freq[np.argsort(freq - exact, kind="stable")[:rest]] += 1
    return symbols.astype("<u4"), (freq + 1).astype("<u4")


def _lanes(n: int) -> int:
    return max(1, min(LANES, n // 64))


def encode_block(ids: np.ndarray, symbols: np.ndarray, freq: np.ndarray) -> bytes:
    rank = np.zeros(int(symbols[-1]) + 1, np.uint32)
    rank[symbols] = np.arange(len(symbols))
    n, lanes = len(ids), _lanes(len(ids))
    low = np.concatenate([[0], np.cumsum(freq, dtype=np.uint64)])[:-1].astype(np.uint64)
    code = rank[ids]
    f_all, c_all = freq.astype(np.uint64)[code], low[code]
    x = np.full(lanes, LOW, np.uint64)
    steps = -(-n // lanes)
    words: list[np.ndarray] = []
    marks: list[tuple[int, bytes]] = []
    shift, bits = np.uint64(32), np.uint64(BITS)
    top = np.uint64(31 - BITS + 32)
    done = 0
    for t in range(steps - 1, -1, -1):
        f, c = f_all[t * lanes : (t + 1) * lanes], c_all[t * lanes : (t + 1) * lanes]
        y = x[: len(f)]
        full = y >= (f << top)
        out = y[full].astype(np.uint32)
        words.append(out)
        done += len(out)
        y = np.where(full, y >> shift, y)
        q = y // f
        x[: len(f)] = (q << bits) + (y - q * f) + c
        if t and t % CHECKPOINT == 0:
            marks.append((done, x.astype("<u8").tobytes()))
    stream = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    body = x.astype("<u8").tobytes() + b"".join(struct.pack("<I", done - at) + state for at, state in marks[::-1]) + stream
    return BLOCK.pack(n, lanes, len(marks), done, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


class Table:
    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq.astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.low = np.concatenate([[0], np.cumsum(freq, dtype=np.uint64)])[:-1].astype(np.uint64)


def decode_block(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids [first, last) of a block, begun at the checkpoint before first; all by default, with checksums."""
    n, lanes, marks, n_words, crc, body_crc = BLOCK.unpack_from(block)
    if zlib.crc32(memoryview(block)[BLOCK.size :]) != body_crc:
        raise ValueError("a block's bytes do not match their checksum")
    last = n if last is None else min(last, n)
    state = 8 * lanes
    body = BLOCK.size
    words = np.frombuffer(block, "<u4", n_words, body + state + marks * (4 + state)).astype(np.uint64)
    k = min(first // lanes // CHECKPOINT, marks)
    at, word = body, 0
    if k:
        at = body + state + (k - 1) * (4 + state)
        (word,) = struct.unpack_from("<I", block, at)
        at += 4
    x = np.frombuffer(block, "<u8", lanes, at).astype(np.uint64)
    mask, bits, shift = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    begin = k * CHECKPOINT
    stop = -(-last // lanes)
    out = np.empty(max(0, min(n, stop * lanes) - begin * lanes), np.uint32)
    for t in range(begin, stop):
        y = x[: min(lanes, n - t * lanes)]
        low = y & mask
        s = table.slot[low]
        out[(t - begin) * lanes : (t - begin) * lanes + len(y)] = s
        y = table.freq[s] * (y >> bits) + low - table.low[s]
        need = y < LOW
        m = int(np.count_nonzero(need))
        if m:
            y[need] = (y[need] << shift) | words[word : word + m]
            word += m
        x[: len(y)] = y
    ids = table.symbols[out]
    if first == 0 and last == n:
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's ids do not match their checksum")
        return ids
    return ids[first - begin * lanes : last - begin * lanes]


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    symbols, freq = frequencies(ids)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    directory = zlib.compress(nulls.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lengths.astype("<u8").tobytes(), 1)
    table = zlib.compress(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    blocks = [encode_block(ids[i : i + BLOCK_IDS], symbols, freq) for i in range(0, len(ids), BLOCK_IDS)]
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), BITS, len(blocks), len(directory), len(table))
    return b"".join([head, directory, table, *(x for b in blocks for x in (struct.pack("<I", len(b)), b))])


def open_file(data: bytes) -> tuple[list[int | None], np.ndarray, Table, list[bytes]]:
    """Ids of documents, their lengths, the table and the blocks."""
    magic, n_docs, _, bits, n_blocks, n_directory, n_table = HEAD.unpack_from(data)
    if magic != MAGIC or bits != BITS:
        raise ValueError("not a token file of this version")
    at = HEAD.size
    directory = zlib.decompress(data[at : at + n_directory])
    nulls = np.frombuffer(directory, np.uint8, n_docs)
    doc_ids = [None if z else d for z, d in zip(nulls, np.frombuffer(directory, "<i8", n_docs, n_docs).tolist(), strict=True)]
    lengths = np.frombuffer(directory, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    at += n_directory
    pair = np.frombuffer(zlib.decompress(data[at : at + n_table]), "<u4")
    at += n_table
    blocks = []
    for _ in range(n_blocks):
        (size,) = struct.unpack_from("<I", data, at)
        blocks.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return doc_ids, lengths, Table(pair[: len(pair) // 2], pair[len(pair) // 2 :]), blocks


def ids_between(data: bytes, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, ids) of each block's part of a file's ids [first, last)."""
    _, _, table, blocks = open_file(data)
    for k, block in enumerate(blocks):
        begin, size = k * BLOCK_IDS, BLOCK.unpack_from(block)[0]
        a, b = max(first - begin, 0), min(last - begin, size)
        if a < b:
            yield begin + a, decode_block(block, table, a, b)


FILES = "shard int, file int, first long, n_ids long, data binary"
READ = "doc_id long, shard int, in_shard long, n_tokens long, ids_crc32 long"


def write_files(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """The documents (doc_id, text) in ascending id order as token files, one row each, in the shared folder.

    The rows go through Spark's own writer, so a lost executor's files are written again. Null ids come first;
    rows of one id are ordered by the first characters of their texts, then by a hash, and may lie in several
    shards; null text counts as empty.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(tokenizer, "byte").encode
        shard = TaskContext.get().partitionId()
        file, first, held, doc_ids, sizes, parts = 0, 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            data = encode_file(doc_ids, np.concatenate(sizes), np.concatenate(parts))
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": pa.array([file], pa.int32()), "first": [first], "n_ids": [held], "data": pa.array([data], pa.binary())})

        for batch in slices(batches, size=SLICE):
            ids, offsets = with_end(*encode_texts(text_of(batch)), end)
            doc_ids += batch.column("doc_id").to_pylist()
            sizes.append(np.diff(offsets))
            parts.append(ids.astype("<u4"))
            held += len(ids)
            if held >= FILE_IDS:
                yield flush()
                file, first, held, doc_ids, sizes, parts = file + 1, first + held, 0, [], [], []
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ("doc_id", F.substring("text", 1, HEAD_CHARS), F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return written(small_batches(rows).mapInArrow(encode, FILES), "tokens", compression="uncompressed")


def read_files(files: DataFrame) -> DataFrame:
    """One row per document from token files: its place, its number of ids and their checksum.

    Blocks that do not match their checksums are an error. Documents without an id, with empty text or with the
    id of another are rows like any other; no files give no rows.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, lengths, table, blocks = open_file(row["data"])
                ids = np.concatenate([decode_block(b, table) for b in blocks]).astype("<u4")
                view, ends = memoryview(ids.tobytes()), np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, pa.int64()), "shard": pa.array([row["shard"]] * len(doc_ids), pa.int32()), "in_shard": starts + row["first"],
                    "n_tokens": lengths, "ids_crc32": pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                })

    rows = small_batches(files).select("shard", "first", "data").mapInArrow(decode, READ)
    return rows.join(F.broadcast(_starts(files)), "shard").select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def _starts(files: DataFrame) -> DataFrame:
    """(shard, before): ids of all shards before. A shard per task of the writer, so the running sum and a broadcast are small."""
    return files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))


RANGE = "start long, ids array<int>"


def read_range(files: DataFrame, first: int, last: int) -> DataFrame:
    """(start, ids): the ids at places [first, last) of all files, in rows of at most one block each.

    Only files that hold some of them are opened, of these only the blocks that do, and of a block only what
    follows the checkpoint before the range. Checksums cover a block's bytes; its ids are checked where all are read.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for start, ids in ids_between(row["data"], first - row["begin"], last - row["begin"]):
                    yield pa.RecordBatch.from_pydict({"start": [row["begin"] + start], "ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))})

    placed = small_batches(files).join(F.broadcast(_starts(files)), "shard").withColumn("begin", F.col("before") + F.col("first"))
    return placed.where((F.col("begin") < last) & (F.col("begin") + F.col("n_ids") > first)).select("begin", "data").mapInArrow(decode, RANGE)
