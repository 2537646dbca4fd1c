"""Near-duplicates by order MinHash.

The occurrence-labelled k-mers of a document are its runs of five words, each with the number of the same
run before it. A sketch takes the KEPT smallest of them under one hash function and keeps their order in
the text; documents that agree in a sketch are candidates. A candidate pair is verified by aligning its
labelled k-mers in order within a band: the k-mers in order in both, over all k-mers of either, must reach
SIMILARITY. Classes are the connected components of verified pairs; documents with the same words are one
node from the start.

Candidates are stars first: in each bucket every node is compared with one of its nodes, another in each
bucket, which already joins most classes. Buckets that still hold several classes are then searched whole,
each in one task that has the nodes' k-mers: how many of them any two nodes share is counted exactly, and pairs
of different classes that share enough are aligned until they are in one class. So a link is lost only where
two nodes meet in no bucket, and only links that join classes leave a task, never pairs. Larger buckets are
cut into blocks, and every block is compared with every other one.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.llm.common import fresh, slices, small_batches, split_words, text_of, written
from docengine.llm.components import components

WORDS = 5
SIMILARITY = 0.8
#: Two documents of similarity 0.8 miss all sketches with a probability of about (1 - 0.8 ** KEPT) ** SKETCHES = 5e-8.
SKETCHES = 32
KEPT = 4
#: Buckets with more rows or more k-mers are cut into blocks of about so many.
INSIDE = 1000
INSIDE_KMERS = 4_000_000
#: Columns of k-mers that are counted at a time.
COLUMNS = 4096
#: A side of a join is broadcast up to so many rows of a few dozen bytes, and shuffled beyond.
BROADCAST_ROWS = 400_000

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, WORDS + 1, dtype=np.uint64) * _STEP


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


MULTIPLIERS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def labelled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the labelled k-mers of all texts, the bounds of each text in them, and a 64-bit mark of its words.

    Words are lower-case and stand between ASCII white space. A text of one to four words is one k-mer.
    """
    lists = split_words(pc.utf8_lower(texts))
    bounds = lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    names = coded.dictionary.to_pylist()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    if "" in names:
        real = code != names.index("")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        code = code[real]
    words = own[code] if len(own) else np.zeros(0, np.uint64)
    view = memoryview(words.astype("<u8").tobytes())
    marks = np.fromiter((xxhash.xxh3_64_intdigest(view[8 * a : 8 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), np.uint64, len(bounds) - 1).view(np.int64)

    n_words = np.diff(bounds)
    n = np.where(n_words == 0, 0, np.maximum(1, n_words - WORDS + 1))
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(bounds[:-1] - ends[:-1], n) + np.arange(ends[-1])
    last = np.repeat(bounds[1:], n)
    hashes = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        inside = at + k < last
        word = np.where(inside, words[np.minimum(at + k, max(0, len(words) - 1))], np.uint64(k)) if len(words) else hashes
        hashes = _mix(hashes + word + _STEPS[k])
    text = np.repeat(np.arange(len(n)), n).astype(np.uint64)
    both = hashes + text * _STEP  # the same k-mer in two texts is not an occurrence of one
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    start = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    if not start.all():
        place = np.arange(len(ranked))
        occurrence = np.empty(len(ranked), np.uint64)
        occurrence[order] = place - np.maximum.accumulate(np.where(start, place, 0))
        hashes = np.where(occurrence > 0, _mix(hashes + occurrence * _MIX), hashes)
    return hashes, ends, marks


def sketches(kmers: np.ndarray) -> np.ndarray:
    """SKETCHES values of one document's labelled k-mers."""
    kept = min(KEPT, len(kmers))
    out = np.empty(SKETCHES, np.uint64)
    width = max(1, 500_000 // max(1, len(kmers)))  # very long documents take fewer hash functions at a time
    for a in range(0, SKETCHES, width):
        values = kmers[None, :] * MULTIPLIERS[a : a + width, None]
        values ^= values >> np.uint64(32)
        if kept < len(kmers):
            place = np.argpartition(values, kept - 1, axis=1)[:, :kept]
        else:
            place = np.broadcast_to(np.arange(kept), (len(values), kept)).copy()
        place.sort(axis=1)
        total = MULTIPLIERS[a : a + width].copy()
        for k in range(kept):
            total = _mix(total + kmers[place[:, k]])
        out[a : a + width] = total
    return out


def in_order(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The most labelled k-mers that stand in the same order in both, with places at most `band` apart.

    Labelled k-mers are distinct within a document, so the alignment is a longest rising run of places.
    """
    _, i, j = np.intersect1d(a, b, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if len(j) < 2 or (j[1:] > j[:-1]).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
    return len(tails)


def similar(a: np.ndarray, b: np.ndarray, share: float = SIMILARITY) -> bool:
    """Whether the aligned k-mers are at least `share` of all k-mers of either."""
    both = len(a) + len(b)
    least = share / (1 + share) * both
    if min(len(a), len(b)) < least - 1e-9:
        return False
    return in_order(a, b, int(both - 2 * least + 1e-9)) >= least - 1e-9


SKETCHED = "doc_id long, node long, n_kmers long, keys array<long>"


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, the mark of its words, and its sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kmers, ends, marks = labelled(text_of(batch))
            keys = [sketches(kmers[a:b]).view(np.int64) if b > a else np.zeros(0, np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            sizes = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "node": marks, "n_kmers": np.diff(ends).astype(np.int64),
                "keys": pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(keys), pa.int64())),
            })

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCHED)


def _bodies(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, kmers) of the given nodes (node, doc_id), from one document of each; kmers are 32-bit hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kmers, ends, marks = labelled(text_of(batch))
            short = (kmers >> np.uint64(32)).astype("<u4")
            same = np.flatnonzero(marks == batch.column("node").to_numpy())  # a repeated id may have other texts too
            yield pa.RecordBatch.from_pydict({"node": marks[same], "kmers": pa.array([short[ends[i] : ends[i + 1]].tobytes() for i in same.tolist()], pa.binary())})

    side = _side(nodes)
    rows = docs.select("doc_id", "text").join(side, docs["doc_id"].eqNullSafe(side["doc_id"])).select("text", "node")
    return written(rows.mapInArrow(run, "node long, kmers binary").dropDuplicates(["node"]), "bodies")


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The written pairs (u, v) whose alignment reaches SIMILARITY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c) for c in ("a", "b"))
            ok = [similar(np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4")) for p, q in zip(left.to_pylist(), right.to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    a = bodies.select(F.col("node").alias("u"), F.col("kmers").alias("a"))
    b = bodies.select(F.col("node").alias("v"), F.col("kmers").alias("b"))
    return written(_side(pairs).join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "verified")


def _side(df: DataFrame) -> DataFrame:
    """A written table as the side of a join: broadcast if it has few rows, so that the other side stays where it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _labels(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    found = labels.select(F.col("node").alias(column), F.col("label").alias(f"{column}_label"))
    return rows.join(found, column, "left").withColumn(f"{column}_label", F.coalesce(f"{column}_label", column))


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) after the edges (u, v) between nodes join classes: the graph of classes is all that is searched anew."""
    between = _labels(_labels(edges, labels, "u"), labels, "v").select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))
    new = components(between, BROADCAST_ROWS)
    moved = new.select(F.col("node").alias("label"), F.col("label").alias("new"))
    old = labels.join(_side(moved), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return _side(written(old.unionAll(new).distinct(), "labels"))


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, node, n_kmers, ...) of buckets with several classes, with the class and the bucket's rows and k-mers.

    Of buckets with the same nodes one is enough.
    """
    named = _labels(rows.select("key", "node", "n_kmers"), labels, "node").withColumnRenamed("node_label", "label")
    several = named.groupBy("key").agg(
        F.count("*").alias("size"), F.sum("n_kmers").alias("kmers"), F.min("label").alias("a"), F.max("label").alias("b"), F.bit_xor(F.xxhash64("node")).alias("nodes")
    )
    several = several.where("a < b").groupBy("size", "kmers", "nodes").agg(F.min("key").alias("key")).select("key", "size", "kmers")
    return written(named.join(_side(written(several, "several")), "key"), "mixed")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of left shares with each of right; the values of one are distinct."""
    sides = [left, right] if right is not left else [left]
    values = np.concatenate([x for side in sides for x in side])
    row = np.repeat(np.arange(sum(map(len, sides))), [len(x) for side in sides for x in side])
    order = np.argsort(values, kind="stable")
    first = np.concatenate([[True], np.diff(values[order]) != 0])[: len(values)]
    code, row = np.cumsum(first) - 1, row[order]
    twice = np.bincount(code)[code] > 1  # what one row alone has is shared with none
    code, row = np.unique(code[twice], return_inverse=True)[1], row[twice]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [low, low + COLUMNS])
        cells = np.zeros((sum(map(len, sides)), int(code[b - 1]) - low + 1), np.float32)
        cells[row[a:b], code[a:b] - low] = 1
        out += cells[: len(left)] @ cells[-len(right) :].T
    return out


def _links(key: np.ndarray, label: np.ndarray, bodies: list[np.ndarray], side: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of nodes (key) that join all classes of one bucket, or of two sides of it (1 and 2), that have a link."""
    left, right = (np.flatnonzero(side == k) for k in ((0, 0) if side[0] == 0 else (1, 2)))
    if not len(left) or not len(right):
        return
    size = np.array([len(b) for b in bodies])
    of_left = [bodies[i] for i in left]
    shared = overlaps(of_left, of_left if side[0] == 0 else [bodies[j] for j in right])
    enough = shared >= SIMILARITY / (1 + SIMILARITY) * (size[left][:, None] + size[right][None, :]) - 1e-3
    enough &= label[left][:, None] != label[right][None, :]
    i, j = np.nonzero(np.triu(enough, 1) if side[0] == 0 else enough)
    order = np.argsort(-(shared[i, j] / (size[left[i]] + size[right[j]])), kind="stable")
    i, j = left[i[order]], right[j[order]]
    root = {x: x for x in label.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b, p, q in zip(i.tolist(), j.tolist(), label[i].tolist(), label[j].tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q and similar(bodies[a], bodies[b]):
            root[max(p, q)] = min(p, q)
            yield int(key[a]), int(key[b])


def _blocks(large: DataFrame) -> DataFrame:
    """The rows of large buckets, once for each pair of blocks to compare (key) and with their side of it.

    A class that is large itself has its own blocks, which need not be compared with one another.
    """
    sizes = written(large.groupBy("key", "label").agg(F.count("*").alias("own"), F.sum("n_kmers").alias("own_kmers")), "sizes")
    n_own, n_all = (F.greatest(F.ceil(F.col(n) / INSIDE), F.ceil(F.col(k) / INSIDE_KMERS)) for n, k in (("own", "own_kmers"), ("size", "kmers")))
    big = n_own > 1
    block = F.when(big, F.xxhash64("label", F.pmod(F.xxhash64("node"), n_own))).otherwise(F.pmod(F.xxhash64("label"), n_all))
    rows = written(large.join(_side(sizes), ["key", "label"]).withColumn("block", block).withColumn("of", F.when(big, F.col("label"))).drop("own", "own_kmers"), "blocks")
    each = written(rows.select("key", "block", "of").distinct(), "each")
    other = each.select("key", F.col("block").alias("b"), F.col("of").alias("b_of"))
    pairs = each.join(other, "key").where("block <= b and not coalesce(of = b_of, false)").select("key", F.col("block").alias("a"), "b", F.xxhash64("key", "block", "b").alias("pair"))
    sides = pairs.select("key", F.col("a").alias("block"), "pair", F.when(F.col("a") == F.col("b"), 0).otherwise(1).alias("side"))
    sides = sides.unionAll(pairs.where("a != b").select("key", F.col("b").alias("block"), "pair", F.lit(2).alias("side")))
    return rows.join(_side(written(sides, "sides")), ["key", "block"]).drop("key").withColumnRenamed("pair", "key")


def _searched(mixed: DataFrame, bodies: DataFrame) -> DataFrame:
    """The written links (u, v) that join all classes that are linked within a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last bucket of a batch may go on in the next
        last = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                key = batch.column("key").to_numpy()
                if key[0] == key[-1] == last:
                    held.append(batch)
                    continue
                held.append(batch)
                last = key[-1]
            if not held:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            done = len(key) if batch is None else int(np.searchsorted(key, last))
            held = [] if batch is None else table.slice(done).to_batches()
            found = []
            cuts = np.concatenate([[0], np.flatnonzero(key[1:done] != key[: done - 1]) + 1, [done]]) if done else [0]
            for a, b in itertools.pairwise(cuts):
                part = table.slice(int(a), int(b - a))
                node, label, side = (part.column(c).to_numpy() for c in ("node", "label", "side"))
                found += _links(node, label, [np.frombuffer(x, "<u4") for x in part.column("kmers").to_pylist()], side)
            yield pa.RecordBatch.from_pydict({c: pa.array([x[k] for x in found], pa.int64()) for k, c in enumerate(("u", "v"))})

    chosen = ("key", "side", "node", "label")
    whole = (F.col("size") <= INSIDE) & (F.col("kmers") <= INSIDE_KMERS)
    rows = mixed.where(whole).withColumn("side", F.lit(0)).select(*chosen)
    large = mixed.where(~whole)
    if large.take(1):
        rows = rows.unionAll(_blocks(large).select(*chosen))
    rows = _side(written(rows, "asked")).join(bodies, "node").select(*chosen, "kmers")
    return written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long"), "links")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) for each document, and (node, doc_id, n_copies, label) for each node: its smallest id and its class.

    A node is a 64-bit hash of a document's words, a class the smallest node in it.
    """
    members = written(sketch(docs), "sketches")
    nodes = written(members.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.first("n_kmers").alias("n_kmers"), F.first("keys").alias("keys")), "nodes")
    rows = nodes.select("node", "doc_id", "n_kmers", F.explode("keys").alias("key"))
    # the order of nodes by node ^ key differs from bucket to bucket, and its minimum gives the node back
    least = F.min(F.struct(F.col("node").bitwiseXOR(F.col("key")).alias("mark"), F.col("n_kmers").alias("p_kmers"))).alias("least")
    buckets = rows.groupBy("key").agg(least, F.count("*").alias("size")).where("size > 1")
    buckets = written(buckets.select("key", F.col("least.mark").bitwiseXOR(F.col("key")).alias("pivot"), "least.p_kmers"), "pivots")
    rows = written(rows.join(_side(buckets), "key"), "buckets")
    bodies = _bodies(docs, written(rows.select("node", "doc_id").distinct(), "candidates"))

    # a pair or two of each node join most classes
    near = rows.where("node != pivot").where(F.least("n_kmers", "p_kmers") >= SIMILARITY * F.greatest("n_kmers", "p_kmers"))
    two = near.groupBy("node").agg(F.array(F.min("pivot"), F.max("pivot")).alias("pivots")).select("node", F.explode("pivots").alias("pivot"))
    first = written(two.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct(), "pairs")
    labels = _side(written(components(_verified(first, bodies), BROADCAST_ROWS), "labels"))
    mixed = _mixed(rows, labels)
    if mixed.take(1):
        labels = _joined(labels, _searched(mixed, bodies))
    named = nodes.select("node", "doc_id", "n_copies").join(labels, "node", "left")
    return members.select("doc_id", "node"), written(named.withColumn("label", F.coalesce("label", "node")), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: its class, named by the class's smallest doc_id, and the class's documents.

    Null and empty texts have no words and are one class, with texts of white space. Repeated rows give a
    row each. A class whose ids are all null has the id null.
    """
    members, nodes = classes(docs)
    named = nodes.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("n_copies").alias("n_class"))
    found = written(nodes.select("node", "label").join(named, "label").select("node", "class_id", "n_class"), "named")
    return members.join(found, "node").select("doc_id", "class_id", "n_class")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id (then the smallest mark), all columns unchanged.

    Ids come first where some are null. Of repeated rows of the kept id with the same words one stays.
    """
    members, nodes = classes(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    best = nodes.groupBy("label").agg(F.min(order).alias("best")).select("best.node", "best.doc_id")
    best = written(best.withColumn("stays", F.lit(True)), "best")
    counted = members.groupBy("doc_id", "node").count()
    status = counted.join(best, (counted["node"] == best["node"]) & counted["doc_id"].eqNullSafe(best["doc_id"]), "left").select(counted["doc_id"].alias("d"), counted["node"].alias("m"), "count", F.coalesce("stays", F.lit(False)).alias("stays"))
    goes = written(status.where("not stays or count > 1"), "goes")

    name = fresh(docs, "node")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.append_column(name, pa.array(labelled(text_of(batch))[2]))

    marked = small_batches(docs).mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
    few = goes.count() <= BROADCAST_ROWS
    side = F.broadcast(goes) if few else goes
    on = (marked[name] == side["m"]) & marked["doc_id"].cast("long").eqNullSafe(side["d"])
    stay = marked.join(side, on, "left_anti").select(*docs.columns)
    twice = goes.where("stays")
    if not twice.take(1):
        return stay
    again = marked.join(F.broadcast(twice) if few else twice, (marked[name] == twice["m"]) & marked["doc_id"].cast("long").eqNullSafe(twice["d"]), "left_semi")
    return stay.unionAll(again.dropDuplicates(["doc_id", name]).select(*docs.columns))
