import hashlib
import random
from collections import Counter, defaultdict

import pytest

from quarrymill.llm.alignment import Aligner, TokenizerA, _segments, align_documents, align_tokenizers, alignment_statistics, pair_counts, piece_count
from quarrymill.llm.common import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    "Hello, World! it's don't\nnew line\tTab  two   spaces ",
    "",
    None,
    "   ",
    " \t \n x\x1c y\x85 z  w",
    "Ünïcode naïve café İstanbul ﬁ 漢字 \U0001f600 é",
    "<|endoftext|> </s> <s>a<unk> <0x41>",
    "a mark ▁ of a space",
    "x" * 300 + " " + "abc" * 50,
    "the cat the cat the dog. " * 40,
    "Hello, World! it's don't\nnew line\tTab  two   spaces ",
]


def plain(texts, a, b, pieces):
    """Every pair of tokens compared byte by byte, as the definition says."""
    out, docs = [], defaultdict(int)
    for text in texts:
        raw = (" " + text).encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a, bytes_b = [pieces[0][i] for i in ids_a], [pieces[1][i] for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            ids_a = ids_b = bytes_a = bytes_b = []
        spans = []
        for parts in (bytes_a, bytes_b):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        links = [(ids_a[i], ids_b[j]) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
        both = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups, own = [], ([], [])
        cuts = sorted(both)
        for lo, hi in zip([0, *cuts], cuts):
            own = [",".join(str(i) for i, (s, e) in zip(ids, sp) if lo < e <= hi) for ids, sp in zip((ids_a, ids_b), spans)]
            groups.append("|".join(own))
        out.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
        for p in set(links):
            docs[p] += 1
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    return [
        (na, nb, ng, len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if na else "")
        for na, nb, ng, links, g in out
    ]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    pieces_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in range(b.get_piece_size()) for p in [b.id_to_piece(i)]]
    return a, b, (TokenizerA(A).bytes, pieces_b)


def made(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "naïve", "don't", "x9", "漢字", "\U0001f600", "antidisestablish", "...", "a", "\t", "\n", "\r\n", "\x1c", "\x85", "", " ", "  ", "-", "▂", "　"]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_library_ids(tools):
    a, b, _ = tools
    texts = [t for t in [*TEXTS, *made(1, 400)] if t]
    tool = Aligner(A, B, entries=50, longest=5, joined=7)
    for part in (texts[:100], texts[100:], texts):
        got = tool.align(part)
        for k, text in enumerate(part):
            if got["sound"][k]:
                assert got["n_a"][k] == len(a.encode(" " + text, add_special_tokens=False).ids), text
                assert got["n_b"][k] == len(b.encode(text)), text


def test_equals_definition(spark, tools):
    texts = [*TEXTS, *made(2, 60)]
    rows = [(i if i != 3 else None, t, "p", 1.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a double")
    wanted = Counter((r[0], *w) for r, w in zip(rows, plain(texts, *tools)))
    for options in ({}, {"chars": 40}, {"broadcast_pairs": 0}):
        got = Counter(tuple(r) for r in align_tokenizers(df, **options).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
        assert got == wanted, options


def test_long_texts_in_segments(tools):
    text = " ".join(made(3, 200))
    assert len(list(_segments(text, 500))) > 5
    assert " ".join(_segments(text, 500)) == text


def test_empty_table_and_pairs(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align_tokenizers(none).count() == 0
    aligned = align_documents(spark.createDataFrame([(1, "same text"), (1, "same text")], "doc_id long, text string"))
    counts = pair_counts(aligned)
    assert {r["count"] for r in counts.collect()} == {2}
    rows = alignment_statistics(aligned, counts, piece_count()).collect()
    assert len(rows) == 2 and all(r["n_best"] == r["n_links"] and r["count_sum"] == 2 * r["n_links"] for r in rows)
