"""Language-model scores: prediction by partial matching over bytes, beside a unigram baseline of words.

The model is a trie of byte contexts up to ORDER bytes with the counts of all training texts, lower-cased
(A-Z), each ended by a zero byte and begun after zero bytes. A symbol that a context has not seen costs an
escape (method C: as many escapes as distinct symbols) to the context one byte shorter, where the symbols
of the longer context are excluded. What a symbol costs depends on its last ORDER + 1 bytes alone, so the
costs of all seen ones are in one table; a text's score is the sum of its positions.

With more than MOST_LEAVES strings only the shorter contexts are sent to the workers. The longer ones stay
in the table of counts, dealt out by the context one byte longer than those, so that each of its groups holds
all that its costs depend on. The costs of the commonest strings are sent, the others are joined. The scores
are the same either way.

Counts meet in buckets of a key's hash. A worker sends the counts of a bucket in one row, and those of a bucket
are summed by one worker: as rows of their own they fill the heaps of the executors.

Words and rows are told apart by 64-bit hashes: of n of them, about n * n / 2 ** 65 pairs share one and would be
counted together in the baseline.

The baseline needs the count of every word. Words that are more than one in 2 ** HEAD_BITS of all tokens
are at most 2 ** HEAD_BITS and are sent to the workers; the others are joined with their counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import give_back, slices, small_batches, split_words, text_of, written

ORDER = 5
#: With more contexts and symbols than this the longer contexts stay in a table; UTF-8 in lower case has fewer of three bytes.
MOST_LEAVES = 6_000_000
HEAD_BITS = 21
TABLE_BITS = 22
#: Costs of strings at more than one in 2 ** NEAR_BITS of all positions, at most 2 ** NEAR_BITS, are sent where the model is not.
NEAR_BITS = 22
#: Counts of a worker's slices are summed before they are sent on, up to so many distinct ones.
PENDING = 1_000_000
#: Counts are dealt out in 2 ** BUCKET_BITS buckets, and leave a worker in so many buckets at a time.
BUCKET_BITS = 10
SENT = 128
#: Bytes of text at a time: each takes a hundred bytes of arrays here, which two workers hold beside an executor's heap.
SLICE = 1 << 19
GRAM, WORD, TEXTS = 0, 1, 2


def _low(k: int) -> np.uint64:
    return np.uint64((1 << (8 * k)) - 1)


def grams(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The last order + 1 bytes at each position of all texts, each with its end; and the texts' bounds in them."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    length = np.diff(offsets)
    bounds = np.concatenate([[0], np.cumsum(length + 1)])
    ends = bounds[1:] - 1
    symbol = np.zeros(int(bounds[-1]), np.uint8)
    inside = np.ones(len(symbol), bool)
    inside[ends] = False
    symbol[inside] = data[offsets[0] : offsets[-1]]
    key = symbol.astype(np.uint64)
    for k in range(1, order + 1):
        before = np.zeros_like(symbol)
        before[k:] = symbol[:-k] if k < len(symbol) else 0
        for j in range(k):  # nothing reaches over the start of a text
            at = bounds[:-1] + j
            before[at[at < bounds[1:]]] = 0
        wide = before.astype(np.uint64)
        wide <<= np.uint64(8 * k)
        key |= wide
    return key, bounds


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs or the sum of its weights. Sorts keys without weights in place."""
    if weights is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.diff(np.concatenate([first, [len(keys)]])) if weights is None else np.add.reduceat(weights, first)
    return keys[first], total.astype(np.int64)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, -1 where it is not."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def slots(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


def hashed(keys: np.ndarray, costs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash table's keys and costs; the commoner of two keys in one slot stays."""
    slot = slots(keys)
    order = np.argsort(counts, kind="stable")
    slot_key = np.full(1 << TABLE_BITS, ~np.uint64(0))
    slot_cost = np.zeros(1 << TABLE_BITS, np.float32)
    slot_key[slot[order]] = keys[order]
    slot_cost[slot[order]] = costs[order]
    return slot_key, slot_cost


class Model:
    """Static costs (log10) of PPM with exclusion from the counts of (order + 1)-byte strings."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER, below: Model | None = None):
        """With `below`, a lower model of all strings, keys may be those of some of the contexts one byte longer than below's."""
        self.order = order
        start = 0 if below is None else below.order + 1
        self.leaf: list[np.ndarray] = list(below.leaf) if below else []
        self.count: list[np.ndarray] = list(below.count) if below else []
        self.context: list[np.ndarray] = list(below.context) if below else []
        self.plain: list[tuple[np.ndarray, np.ndarray]] = list(below.plain) if below else []
        total, distinct, owner = ([None] * start for _ in range(3))
        if below:
            total[-1], distinct[-1], owner[-1] = below.top
        for k in range(start, order + 1):
            leaf, count = counted(keys & _low(k + 1), counts)
            above = leaf >> np.uint64(8)
            context, size = counted(above)
            place = np.repeat(np.arange(len(context)), size)
            self.leaf.append(leaf)
            self.count.append(np.log10(count).astype(np.float32))
            self.context.append(context)
            t = np.bincount(place, count, len(context))
            total.append(t)
            distinct.append(size)
            owner.append((place, count))
            self.plain.append(self._costs(t, size))
        #: fallen[k]: for each context of k + 1 bytes, the costs in its shorter context without its own symbols
        self.fallen: list[tuple[np.ndarray, np.ndarray]] = list(below.fallen) if below else []
        for k in range(len(self.fallen), order):
            lower = _find(self.leaf[k], self.leaf[k + 1] & _low(k + 1))
            place = owner[k + 1][0]
            seen = np.bincount(place, owner[k][1][lower], len(self.context[k + 1]))
            short = _find(self.context[k], self.context[k + 1] & _low(k))
            self.fallen.append(self._costs(total[k][short] - seen, distinct[k][short] - distinct[k + 1]))
        self.top = (total[-1], distinct[-1], (None, owner[-1][1])) if order < ORDER else None
        self.last = -np.log10(256 - len(self.leaf[0])) if len(self.leaf[0]) < 256 else 0.0
        self.slot_key: np.ndarray | None = None  # made where it is used, not sent

    @staticmethod
    def _costs(total: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the denominator, and of the escape (certain where nothing is left)."""
        both = np.maximum(total + distinct, 1)
        return np.log10(both).astype(np.float32), np.where(distinct > 0, np.log10(np.maximum(distinct, 1) / both), 0.0).astype(np.float32)

    def _table(self) -> None:
        """A hash table of the costs of the longest strings; the commoner of two in one slot stays."""
        keys = self.leaf[-1]
        costs = np.concatenate([self.spelled(keys[i : i + 100_000]).astype(np.float32) for i in range(0, len(keys), 100_000)] or [np.zeros(0, np.float32)])
        self.slot_key, self.slot_cost = hashed(keys, costs, self.count[-1])

    def spelled(self, keys: np.ndarray) -> np.ndarray:
        """log10 probabilities, level by level."""
        total = np.zeros(len(keys))
        todo = np.ones(len(keys), bool)
        longer = np.full(len(keys), -1)
        for k in range(self.order, -1, -1):
            context = _find(self.context[k], (keys >> np.uint64(8)) & _low(k))
            leaf = _find(self.leaf[k], keys & _low(k + 1))
            if len(self.context[k]):
                den, escape = self.plain[k][0][context], self.plain[k][1][context]
                if k < self.order:
                    fell = longer >= 0
                    den = np.where(fell, self.fallen[k][0][longer], den)
                    escape = np.where(fell, self.fallen[k][1][longer], escape)
                hit = todo & (leaf >= 0)
                total[hit] += self.count[k][leaf[hit]] - den[hit]
                todo &= ~hit
                away = todo & (context >= 0)
                total[away] += escape[away]
            longer = context
        total[todo] += self.last
        return total

    def score(self, keys: np.ndarray) -> np.ndarray:
        """The same, by the table where it has the key."""
        if self.slot_key is None:
            self._table()
        slot = slots(keys)
        out = self.slot_cost[slot].astype(np.float64)
        rest = np.flatnonzero(self.slot_key[slot] != keys)
        if len(rest):
            names, place = np.unique(keys[rest], return_inverse=True)
            out[rest] = self.spelled(names)[place]
        return out


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct words of all texts, the word of each place, and the texts' bounds in them."""
    lists = split_words(texts)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coded = lists.flatten().dictionary_encode()
    code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    if "" in names:
        real = code != names.index("")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        code = code[real]
    return hashes, code, bounds


def _lowered(batch: pa.RecordBatch) -> pa.Array:
    return pc.ascii_lower(text_of(batch))


COUNTED = "kind int, key long, n long"
PACKED = "bucket int, kind int, keys binary, counts binary"


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all 64-bit values, then the second ones, ...: the upper ones are much alike and compress well."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def packed(kind: int, keys: np.ndarray, n: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Counts as rows of PACKED, one for each bucket that has any."""
    bucket = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    keys, n, bucket = keys[order], n[order].astype(np.int64), bucket[order]
    names, first = np.unique(bucket, return_index=True)
    bounds = np.append(first, len(keys))
    for i in range(0, len(names), SENT):
        parts = [slice(*x) for x in itertools.pairwise(bounds[i : i + SENT + 1])]
        yield pa.RecordBatch.from_pydict({
            "bucket": names[i : i + SENT].astype(np.int32), "kind": pa.array(np.full(len(parts), kind, np.int32)),
            "keys": pa.array([_planes(keys[x]) for x in parts], pa.binary()), "counts": pa.array([_planes(n[x]) for x in parts], pa.binary()),
        })


class _Held:
    """Counts of one kind, summed whenever more than PENDING keys have come in since."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.new = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.new += len(keys)

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        self.parts, self.new = [counted(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))], 0
        return self.parts[0]


def corpus_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, n): counts of byte strings, of words by hash, and of texts, over all of docs."""
    bits = BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {GRAM: _Held(), WORD: _Held()}
        texts_seen = 0
        for batch in slices(batches, size=SLICE):
            texts = _lowered(batch)
            texts_seen += len(texts)
            held[GRAM].add(*counted(grams(texts, order)[0]))
            hashes, code, _ = _words(texts)
            n = np.bincount(code, minlength=len(hashes)).astype(np.int64)
            held[WORD].add(hashes[n > 0], n[n > 0])
            for kind in held:
                if held[kind].new > PENDING:
                    keys, n = held[kind].summed()
                    if len(keys) > PENDING // 2:
                        yield from packed(kind, keys, n, bits)
                        held[kind] = _Held()
        for kind, x in held.items():
            if x.parts:
                yield from packed(kind, *x.summed(), bits)
        yield from packed(TEXTS, np.zeros(1, np.uint64), np.array([texts_seen]), bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each bucket and kind, whose rows come one after another."""
        at, held = None, _Held()
        for batch in itertools.chain(batches, [None]):
            for *name, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch is not None else [(None, None, None, None)]:
                if at not in (None, name):
                    key, sums = held.summed()
                    yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(key), at[1], np.int32)), "key": key.view(np.int64), "n": sums})
                    held = _Held()
                if keys is not None:
                    at = name
                    held.add(_from_planes(keys, np.uint64), _from_planes(n, np.int64))
                    if held.new > PENDING:
                        held.summed()
        give_back()

    parts = small_batches(docs).select("text").mapInArrow(run, PACKED)
    return written(parts.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(merge, COUNTED), "counts")


def train(counted_: DataFrame, order: int = ORDER) -> Model:
    """The model of the highest order, ORDER at most, that has no more than MOST_LEAVES strings.

    Where it is lower than ORDER, `longer_costs` adds the longer contexts.
    """
    rows = counted_.where(F.col("kind") == GRAM)
    while order > 1 and rows.count() > MOST_LEAVES:
        order -= 1
        rows = written(rows.groupBy(F.col("key").bitwiseAND(F.lit(int(_low(order + 1)))).alias("key")).agg(F.sum("n").alias("n")), "grams")
    found = rows.select("key", "n").toArrow()
    keys, counts = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    del found
    return Model(keys, counts, order)


def longer_costs(counted_: DataFrame, wanted: DataFrame, lowered: Model) -> DataFrame:
    """(key, cost) of the wanted strings (key) by the model of ORDER, of which `lowered` has the shorter contexts.

    A group is a context one byte longer than lowered's, with all longer ones that end in it: few of all strings.
    """
    shared = counted_.sparkSession.sparkContext.broadcast(lowered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                new += batch.num_rows
                if new < PENDING // 2:
                    continue
            if not held:
                continue
            table = pa.Table.from_batches(held)
            group, key, n = (table.column(c).to_numpy() for c in ("group", "key", "n"))
            # the last group may go on in the next batch
            done = len(group) if batch is None else int(np.searchsorted(group, group[-1]))
            held, new = table.slice(done).to_batches(), 0
            key, n = key[:done].view(np.uint64), n[:done]
            seen = n > 0
            model = Model(key[seen], n[seen], ORDER, shared.value) if seen.any() else shared.value
            asked = key[~seen]
            yield pa.RecordBatch.from_pydict({"key": asked.view(np.int64), "cost": model.spelled(asked)})

    group = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(int(_low(lowered.order + 1)))).alias("group")
    rows = counted_.where(F.col("kind") == GRAM).select(group, "key", "n").unionAll(wanted.select(group, "key", F.lit(0).cast("long").alias("n")))
    return written(rows.repartition("group").sortWithinPartitions("group", "key").mapInArrow(run, "key long, cost double"), "costs")


SCORED = "doc_id long, row long, n_tokens long, n_head long, head_score double, n_far long, score double"
TAIL = "kind int, key long, row long, n long"


def score_texts(docs: DataFrame, training: Column) -> DataFrame:
    """Scores of all documents by the model and the baseline of those for which `training` holds.

    Null text counts as empty, one token (the end). A text scores the log10 probability of its lower-cased
    bytes and its end. Repeated rows give a row each, equal texts equal scores; rows without an id are scored
    too. Without training rows every byte costs the same.
    """
    spark = docs.sparkSession
    counts = corpus_counts(docs.where(training))
    model = train(counts)
    words = counts.where(F.col("kind") == WORD)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts = counts.where(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_all, n_distinct = total + texts, distinct + (texts > 0)
    norm = float(np.log10(n_all + (n_distinct + 1)))
    end_score, end_known = float(np.log10(texts + 1)) - norm, int(texts > 0)

    least = max(1, (n_all >> HEAD_BITS) + 1)
    head = words.where(F.col("n") >= least).select("key", "n").toArrow()
    keys = head["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    head_words = (keys[order], np.log10(head["n"].to_numpy()[order] + 1.0) - norm)
    whole = model.order == ORDER
    strings = counts.where(F.col("kind") == GRAM)
    common: tuple | None = None
    if not whole:
        often = (strings.agg(F.sum("n")).first()[0] >> NEAR_BITS) + 1
        found = strings.where(F.col("n") >= often).select("key", "n").toArrow()
        common = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
        del found
        common_keys = hashed(common[0], np.zeros(len(common[0]), np.float32), common[1])[0]
    tail_shared = spark.sparkContext.broadcast((head_words[0], None if whole else common_keys))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head_keys, head_cost = shared.value
        for batch in slices(batches, size=SLICE):
            texts = _lowered(batch)
            key, bounds = grams(texts)
            n_near = np.diff(bounds)
            if whole:
                cost = model.score(key)
            else:
                slot = slots(key)
                near = model[0][slot] == key
                cost = np.where(near, model[1][slot], 0.0).astype(np.float64)
                n_near = np.add.reduceat(near.astype(np.int64), bounds[:-1]) if len(key) else np.zeros(0, np.int64)
            score = np.add.reduceat(cost, bounds[:-1]) if len(key) else np.zeros(0)
            hashes, code, w_bounds = _words(texts)
            place = _find(head_keys, hashes)
            cost = np.where(place >= 0, head_cost[place], 0.0) if len(head_cost) else np.zeros(len(hashes))
            sums = np.concatenate([[0.0], np.cumsum(cost[code])])
            known = np.concatenate([[0], np.cumsum(place[code] >= 0)])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "row": batch.column("row"), "n_tokens": np.diff(w_bounds) + 1, "n_head": known[w_bounds[1:]] - known[w_bounds[:-1]],
                "head_score": sums[w_bounds[1:]] - sums[w_bounds[:-1]], "n_far": np.diff(bounds) - n_near, "score": score,
            })

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_keys, near_keys = tail_shared.value
        for batch in slices(batches, size=SLICE):
            texts = _lowered(batch)
            hashes, code, bounds = _words(texts)
            rare = (_find(head_keys, hashes) < 0)[code]
            yield tail_rows(WORD, batch, hashes, code[rare], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[rare])
            if near_keys is not None:
                key, bounds = grams(texts)
                far = near_keys[slots(key)] != key
                names, place = np.unique(key[far], return_inverse=True)
                yield tail_rows(GRAM, batch, names, place, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[far])

    def tail_rows(kind: int, batch: pa.RecordBatch, names: np.ndarray, code: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
        pair, n = counted(text.astype(np.uint64) << np.uint64(32) | code.astype(np.uint64))
        row = batch.column("row").to_numpy()[(pair >> np.uint64(32)).astype(np.int64)]
        return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(n), kind, np.int32)), "key": names[pair & _low(4)].view(np.int64), "row": row, "n": n})

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    tails = named.select("text", "row").mapInArrow(tail, TAIL)
    if not whole:
        tails = written(tails, "tails")
        far = tails.where(F.col("kind") == GRAM)
        asked = far.select("key").unionAll(strings.where(F.col("n") >= often).select("key")).distinct()
        costs = longer_costs(counts, asked, model)
        best = strings.where(F.col("n") >= often).select("key", "n").join(costs, "key").toArrow()
        model = hashed(best["key"].to_numpy().view(np.uint64), best["cost"].to_numpy(), best["n"].to_numpy())
        del best
    shared = spark.sparkContext.broadcast((model, *head_words))
    scored = named.mapInArrow(rows, SCORED)
    rare = tails.where(F.col("kind") == WORD)
    known = words.where(F.col("n") < least).select("key", F.col("n").alias("c"))
    found = rare.join(known, "key", "left").groupBy("row").agg(
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) - norm)).alias("tail_score"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_tail"), F.sum("n").alias("n_rare")
    )
    # equal rows share `row`: what was summed over them is divided by how many there were
    times = F.col("n_rare") / (F.col("n_tokens") - 1 - F.col("n_head"))
    joined = scored.join(found, "row", "left")
    if not whole:
        sums = far.join(costs, "key").groupBy("row").agg(F.sum(F.col("n") * F.col("cost")).alias("far_score"), F.sum("n").alias("n_all_far"))
        joined = joined.join(sums, "row", "left")
        joined = joined.withColumn("score", F.col("score") + F.coalesce(F.col("far_score") * F.col("n_far") / F.col("n_all_far"), F.lit(0.0)))
    return joined.select(
        "doc_id", "n_tokens", (F.col("n_head") + F.coalesce((F.col("n_tail") / times).cast("long"), F.lit(0)) + end_known).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce(F.col("tail_score") / times, F.lit(0.0)) + end_score).alias("base_score"), "score",
    )
