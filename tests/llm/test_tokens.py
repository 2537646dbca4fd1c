import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
from docengine.llm import rans  # noqa: E402
from docengine.llm.packing import CAPACITY, Packer, pack  # noqa: E402
from docengine.llm.queries import tokenizer  # noqa: E402
from docengine.llm.tokens import Encoder  # noqa: E402


def library(path, texts, end):
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_block_round_trip_and_checkpoints():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 1000, 300_000):
        ids = (rng.zipf(1.3, n) % 50_000).astype(np.uint32)
        symbols, freq = rans.frequencies(ids)
        assert freq.sum() == 1 << rans.BITS
        block, table = rans.encode_block(ids, symbols, freq), rans.Table(symbols, freq)
        assert (rans.decode_block(block, table) == ids).all()
        a, b = n // 2, n // 2 + n // 7
        assert (rans.decode_block(block, table, a, b) == ids[a:b]).all()
    assert len(block) < 2 * n
    broken = bytearray(block)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(broken), table)


def test_checkpoint_is_used():
    ids = np.arange(600_000, dtype=np.uint32) % 1000
    symbols, freq = rans.frequencies(ids)
    assert rans._lanes(len(ids)) * rans.CHECKPOINT < len(ids)
    assert (rans.decode_block(rans.encode_block(ids, symbols, freq), rans.Table(symbols, freq), 580_000, 590_000) == ids[580_000:590_000]).all()


def test_files(spark, odd_docs):
    path = tokenizer("byte_bpe_50k.json")
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    ids = library(path, [r.text for r in rows], 0)
    want, at = [], 0
    for r, x in zip(rows, ids, strict=True):
        want.append((r.doc_id, at, len(x), crc(x)))
        at += len(x)
    got = rans.read_files(rans.write_files(odd_docs, path)).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    assert rans.read_files(rans.write_files(odd_docs.limit(0), path)).count() == 0


def test_ranges_begin_at_checkpoints(spark, monkeypatch):
    """Any range of places gives the ids that whole files have there, over blocks and files."""
    monkeypatch.setattr(rans, "FILE_IDS", 500)
    monkeypatch.setattr(rans, "SLICE", 1000)
    path = tokenizer("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(30)], "doc_id long, text string").repartition(3)
    ids = [x for t in library(path, [f"text {i} " * 40 for i in range(30)], 0) for x in t]
    files = rans.write_files(docs, path)
    assert files.count() > 3
    for a, b in ((0, len(ids)), (0, 1), (700, 2200), (len(ids) - 1, len(ids) + 9), (5, 5)):
        rows = sorted(rans.read_range(files, a, b).collect(), key=lambda r: r.start)
        assert [x for r in rows for x in r.ids] == ids[a:b] and (not rows or rows[0].start == a)


def test_rows_of_one_id_are_dealt_out(spark):
    docs = spark.createDataFrame([(None, f"{i % 50} word") for i in range(400)], "doc_id long, text string").repartition(4)
    with_parts = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in with_parts.items():
        spark.conf.set(k, v)
    files = rans.write_files(docs, tokenizer("byte_bpe_50k.json"))
    for k in with_parts:
        spark.conf.unset(k)
    assert files.select("shard").distinct().count() > 1 and rans.read_files(files).count() == 400


@pytest.mark.parametrize("parts", [1, 3])
def test_pack(spark, odd_docs, parts):
    path = tokenizer("word_bpe_49k.json")
    docs = odd_docs.dropDuplicates(["doc_id"]).repartition(parts)  # those of one id: below
    rows = docs.collect()
    want = {r.doc_id: x for r, x in zip(rows, library(path, [r.text for r in rows], 2), strict=True)}
    got = pack(docs, path, with_ids=True).collect()
    for doc, ids in want.items():
        pieces = sorted((p for p in got if p.doc_id == doc), key=lambda p: p.start)
        assert [i for p in pieces for i in np.frombuffer(p.ids, "<u4").tolist()] == ids
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert all(p.ids_crc32 == zlib.crc32(p.ids) and p.doc_tokens == len(ids) for p in pieces)
    for s in {p.sequence_id for p in got}:
        pieces = sorted((p for p in got if p.sequence_id == s), key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        total = sum(p.length for p in pieces)
        assert total <= CAPACITY and total & (total - 1) == 0
    assert pack(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_ids_stay_apart(spark, parts):
    """Rows of one id, or of none, with texts of one length are documents of their own."""
    rows = [(None if i % 3 else 7, text) for i in range(400) for text in ("a b c d", None, "")]
    path = tokenizer("word_bpe_49k.json")
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), path).collect()
    assert sum(p.length for p in got) == sum(len(x) for x in library(path, [t for _, t in rows], 2))
    assert sum(p.start == 0 for p in got) == len(rows) and all(p.start + p.length <= p.doc_tokens for p in got)


def whole(packer, lengths):
    """Each id of each document in one piece, sequences full or of a power of two; the share of documents in bins of their class."""
    seen = [np.zeros(n, int) for n in lengths]
    binned = 0
    for sequence in packer.done:
        size = sum(len(p.ids) for p in sequence)
        assert size == packer.capacity or (size < packer.capacity and size & (size - 1) == 0)
        for p in sequence:
            seen[p.doc][p.start : p.start + len(p.ids)] += 1
            assert p.total == lengths[p.doc] and (p.ids == np.arange(p.start, p.start + len(p.ids))).all()
        for k in {p.bin_class for p in sequence if p.bin_class}:
            own = [p for p in sequence if p.bin_class == k]
            binned += sum(p.start + len(p.ids) == p.total for p in own)
            assert len(own) == k and all(packer.capacity / (k + 1) < len(p.ids) <= packer.capacity / k for p in own)
    assert all((x == 1).all() for x in seen)
    return binned / max(1, len(lengths))


@pytest.mark.parametrize("capacity,classes", [(4096, 32), (64, 5), (16, 16)])
def test_bins_hold_the_count_of_their_class(capacity, classes):
    rng = np.random.default_rng(capacity)
    for draw in (lambda n: rng.integers(1, 3 * capacity, n), lambda n: np.full(n, capacity // 2 + 1), lambda n: rng.geometric(6 / capacity, n), lambda n: np.full(n, capacity // 8 - 1), lambda n: np.ones(n, int)):
        lengths = draw(int(rng.integers(0, 700)))
        packer = Packer(capacity, classes)
        for i, n in enumerate(lengths.tolist()):
            packer.add(i, np.arange(n, dtype=np.uint32))
            assert len(packer.gaps) <= max(1, 8 * capacity / 64 + 1)
        packer.finish()
        whole(packer, lengths)


def test_most_documents_lie_in_bins():
    lengths = np.clip(np.random.default_rng(2).lognormal(5.9, 0.9, 20_000), 1, 20_000).astype(int)
    packer, most = Packer(), 0
    for i, n in enumerate(lengths.tolist()):
        packer.add(i, np.arange(n, dtype=np.uint32))
        most = max(most, len(packer.gaps))
    packer.finish()
    assert whole(packer, lengths) > 0.8 and most < 512


ODD = [
    "", "a", "A b", "  x", "x ", "a\n\nb", "the\tcat", "naïve café, İI ΑΣ ſ.", "a  b", "x~y ~ z", "it's don't", "\x00", "é é́", "a" * 5000, " ", "\n", "Ab.\nCd, ef", "日本 語",
    "a\x1cb !\x1c c\x85 d", "   b", "end. ", "one,two, three.\nFour", "<|endoftext|> q", "ÀÉ ÿ ǅ ɏ", "tab\tx.\ty", "...", "x..\n", "Ⅷ ² ½ ١",
]


@pytest.mark.parametrize("name,mode", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_units_equal_whole_texts(name, mode):
    rng = np.random.default_rng(3)
    alphabet = list("ab ééÉ ., \n\n'’~x9 \t") + ["the ", "Ö", " ", "日"]
    texts = ODD + ["".join(rng.choice(alphabet, n)) for n in rng.integers(1, 40, 3000)]
    encoder = Encoder(tokenizer(name), mode, known=50)
    ids, offsets = encoder.encode(pa.array(texts, pa.large_string()))
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [w.ids for w in want]
