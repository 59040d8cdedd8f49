import zlib

import numpy as np
import pytest

from quarrymill.llm.common import fresh_path, tokenizer_path
from quarrymill.llm.packing import capacities, pack, pack_documents, sequences
from quarrymill.llm.token_files import FileReader, read_token_digests, write_token_files
from quarrymill.llm.wordbpe import ChunkEncoder

TEXTS = [
    "Hello, World! it's don't\nnew line\tTab  two   spaces",
    "",
    None,
    "   ",
    "Ünïcode naïve café İstanbul ﬁ 漢字 \U0001f600 é a b \x1c\x85 x y",
    "<|endoftext|> a<|startoftext|>b <|endof text",
    "word " * 5000,
    "12 345 a1b2 !!! </w> foo</w>bar _x_",
    "Hello, World! it's don't\nnew line\tTab  two   spaces",
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return lambda s: np.array(t.encode(s or "", add_special_tokens=False).ids, "<u4")


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i if i != 4 else None, t, "other", 1.5) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, length double")


def test_memo_equals_library(plain):
    for capacity in (4, 500_000):
        e = ChunkEncoder(tokenizer_path("word_bpe_49k.json"), capacity=capacity, joined=3)
        for text, got in zip(TEXTS, e.encode(TEXTS)):
            assert got == plain(text).tobytes(), text


def test_pack_fills_every_sequence():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 9000, 300).tolist()
    out, left = pack(lengths, 2048, 1.0, 1 / 2048)
    assert not left
    ids = {}
    for i, at, n, k in out:
        ids.setdefault(i, []).append((at, n))
    for i, n in enumerate(lengths):
        at = 0
        for a, m in sorted(ids[i]):
            assert a == at
            at += m
        assert at == n
    used = {}
    for *_, n, k in out:
        used[k] = used.get(k, 0) + n
    assert all(v == 2048 or v & (v - 1) == 0 for v in used.values())
    assert capacities(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1] and capacities(0, 2048) == []


def test_what_is_left_goes_to_the_next_window():
    lengths = np.random.default_rng(2).integers(1, 3000, 100).tolist()
    out, left = pack(lengths, 2048, 1.0, 1 / 2048, last=False)
    used = {}
    for *_, n, k in out:
        used[k] = used.get(k, 0) + n
    assert set(used.values()) == {2048}
    rest = sum(lengths[i] - at for i, at in left)
    assert left and rest == sum(lengths) % 2048 and sum(used.values()) + rest == sum(lengths)
    assert pack([5, 7], 2048, 1.0, 1 / 2048, last=False) == ([], [(1, 0), (0, 0)])


def test_cost_is_balanced():
    out, _ = pack([1000, 900, 800, 100, 100, 100, 48 + 1000, 48], 2048, 1.0, 1 / 2048)
    cost = {}
    for *_, n, k in out:
        cost[k] = cost.get(k, 0) + n + n * n / 2048
    assert max(cost.values()) < 1.3 * min(cost.values())


def test_pieces(table, plain):
    rows = pack_documents(table, window_tokens=3000).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    for i, text in enumerate(TEXTS):
        ids = np.r_[plain(text), np.array([1], "<u4")].astype("<u4")
        own = [r for r in rows if r.doc_id == (i if i != 4 else None)]
        assert sum(r.length for r in own) == len(ids) * (2 if i == 0 else 1)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in own)
    assert sequences(pack_documents(table)).where("padding > 0").count() == 0


def test_files(spark, table, plain):
    folder = fresh_path(spark, "t")
    manifest = write_token_files(table, folder, docs_per_file=3)
    rows = sorted(read_token_digests(manifest, folder).collect(), key=lambda r: r.start)
    order = [None, 0, 0, *[i for i in range(1, len(TEXTS)) if i != 4]]
    assert [r.doc_id for r in rows] == order
    at = 0
    for r in rows:
        ids = np.r_[plain(TEXTS[4 if r.doc_id is None else r.doc_id]), 1].astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    name = manifest.orderBy("name").first().name
    with pytest.raises(ValueError):
        FileReader(f"{folder}/{name}", b"another")


def test_dictionary_is_used(spark):
    docs = spark.createDataFrame([(i, f"some words that all of these documents share and number {i} of many " * 2) for i in range(300)], "doc_id long, text string")
    folder = fresh_path(spark, "t")
    manifest = write_token_files(docs, folder)
    assert read_token_digests(manifest, folder).count() == 300
    assert len(spark.read.format("binaryFile").load(f"{folder}/dictionary.zdict").first().content) > 100


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = fresh_path(spark, "t")
    assert pack_documents(docs).collect() == []
    assert read_token_digests(write_token_files(docs, folder), folder).collect() == []
