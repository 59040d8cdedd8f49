import random
import re

import numpy as np
import pytest

from quarrymill.llm import rtree_join
from quarrymill.llm.rtree_join import JaccardJoin, RTree, near_duplicates
from quarrymill.llm.shingles import Routing, count_vector, shingle_sets, word_hashes


def plain_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def plain_components(rows, width, num, den):
    sets = [plain_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    lowest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            lowest[root(i)] = min(lowest.get(root(i), doc), doc)
    return sorted(((d, len(sets[i]), lowest.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            own = rng.choice(texts[-40:]).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                k = rng.randrange(len(own))
                own[k : k + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 2)
                own = own or ["x"]
        else:
            own = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 7, 12, 40, 90, 300]))]
        texts.append(" ".join(own))
    return [(k * 3, t) for k, t in enumerate(texts)]


def test_sets_equal_plain():
    texts = ["a b c d e a b c d", "A B c", "", " \t\n", "one", "a b c d", "x\x0by\x0cz w é\x85é"]
    for width in (2, 4):
        got = shingle_sets([t.encode() for t in texts], width)
        assert [len(s) for s in got] == [len(plain_set(t, width)) for t in texts]
    a, b = shingle_sets([b"a b c d e f", b"b C d E g"], 4)
    assert len(np.intersect1d(a, b)) == 1


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (50, 100)])
def test_linked_sets_share_a_key(num, den):
    rng, routing = np.random.default_rng(7), Routing(num, den)
    for n in [1, 2, 5, 6, 7, 8, 15, 16, 31, 63, 64, 100, 127, 250, 1000]:
        for _ in range(40):
            s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop, add = rng.integers(0, routing.apart(n) + 1), rng.integers(0, routing.apart(n) + 1)
            t = np.unique(np.r_[s[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)])
            common = len(np.intersect1d(s, t))
            if len(t) and den * common >= num * (len(s) + len(t) - common):
                assert len(np.intersect1d(routing.keys(s), routing.keys(t))), (n, drop, add)


def test_tree_loses_no_link():
    rng, routing = np.random.default_rng(8), Routing(85, 100)
    base = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in rng.integers(1, 200, 60)]
    sets = base + [np.unique(np.r_[s[rng.integers(0, 3) :], rng.integers(0, 1 << 63, 2).astype(np.uint64)]) for s in base for _ in range(6)]
    sets = [s for s in sets if len(s)]
    counts = np.array([count_vector(s, rtree_join.GROUPS) for s in sets])
    found = set()
    tree = RTree(np.array([len(s) for s in sets]), counts, fan=5)
    for i, j in tree.pairs(routing):
        found |= {frozenset(p) for p in zip(tree.order[i].tolist(), tree.order[j].tolist())}
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                assert frozenset((i, j)) in found
    assert len(found) < len(sets) ** 2 / 8  # and it prunes


@pytest.mark.parametrize(("seed", "width", "num"), [(1, 4, 85), (2, 5, 80), (3, 2, 70)])
def test_components_equal_brute_force(spark, seed, width, num):
    rows = corpus(seed) + [(1, None), (4, ""), (None, "a b c d e f"), (7, "a b c d e f"), (10, "A b c d e f"), (13, " "), (None, "only null"), (13, " ")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, n string")
    for hot, cell_rows, shared in ((64, 512, 24), (2, 4, 1)):
        got = JaccardJoin(docs, width, num, 100, hot=hot, cell_rows=cell_rows, shared=shared, broadcast_rows=0 if hot == 2 else 1000).documents().collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_components(rows, width, num, 100)


@pytest.mark.parametrize("cell_rows", [512, 6])
def test_links_are_counted(spark, cell_rows):
    rows = corpus(4) + [(2, "a b c d e f"), (5, "a b c d e f"), (8, None)]
    sets = [plain_set(t, 3) for _, t in rows]
    plain = []
    for i, (d, _) in enumerate(rows):
        common = [len(sets[i] & t) for t in sets]
        plain.append((d, sum(j != i and bool(sets[i]) and bool(t) and 100 * c >= 70 * (len(sets[i]) + len(t) - c) for j, (t, c) in enumerate(zip(sets, common)))))
    got = JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), 3, 70, 100, cell_rows=cell_rows).link_counts().collect()
    assert sorted(tuple(r) for r in got) == sorted(plain)
    assert sum(n for _, n in plain) > 100


def near_copies(count, changed, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for k in range(count):
        own = list(base)
        for at in rng.sample(range(60), changed):
            own[at] = f"v{k}x{at}"
        rows.append((k, " ".join(own)))
    return rows


@pytest.mark.parametrize(("num", "shared"), [(94, 24), (94, 0), (97, 2)])
def test_large_family_in_blocks(spark, num, shared):
    """Near copies of which few link, or none, in blocks of 8."""
    rows = near_copies(70, 2)
    got = JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), 1, num, 100, cell_rows=8, shared=shared).documents().collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_components(rows, 1, num, 100)


def test_words_longer_than_a_piece(monkeypatch):
    texts = [b"a" * 50 + b" bc " + b"d" * 7, b"", b"bc " * 40, b" bc"]
    plain = word_hashes(texts)
    monkeypatch.setattr("quarrymill.llm.shingles.PIECE", 8)
    cut = word_hashes(texts)
    assert (plain[0] == cut[0]).all() and (plain[1] == cut[1]).all()


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
