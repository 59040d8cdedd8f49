import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from quarrymill.llm.mixing import mix_documents, queue, source_weights


def targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), passes=2):
    """The contract's rounds, in fractions."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, closed, left = {}, set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in closed]
        for s in rest:
            out[s] = left * weight[s] / sum(weight[t] for t in rest)
        over = [s for s in rest if out[s] > passes * sizes[s]]
        if not over:
            return out
        for s in over:
            out[s] = Fraction(passes * sizes[s])
            left -= out[s]
            closed.add(s)


def made(seed, n, sources):
    rng = random.Random(seed)
    return [(rng.choice([i, i, i, None]), " ".join(["w"] * rng.choice([0, 1, 5, 40, 900])) if rng.random() > 0.05 else None, rng.choice(sources)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 0.5) for r in rows], "doc_id long, text string, source string, size string, copies long, target double")


HOT = ["big"] * 9 + ["b", "é", "\U0001f600", "ﬁ", None, ""]


@pytest.mark.parametrize("seed, n, sources", [(1, 300, HOT), (2, 40, ["one"]), (3, 60, ["a", "b"]), (4, 500, [f"s{i}" for i in range(90)])])
def test_targets_and_words(spark, seed, n, sources):
    rows = made(seed, n, sources) + [(7, "same same same", sources[0])] * 25
    taken, documents = mix_documents(frame(spark, rows))
    got = [tuple(r) for r in documents.collect()]
    assert Counter((r[0], len((r[1] or "").split()), r[2]) for r in rows) == Counter((d, k, s) for d, s, k, *_ in got)
    sizes = defaultdict(int)
    for _, text, s in rows:
        sizes[s] += len((text or "").split())
    wanted, had = targets(sizes), defaultdict(int)
    for _, s, size, source_size, target, words in got:
        assert source_size == sizes[s] and target == pytest.approx(float(wanted[s]), rel=1e-12) and 0 <= words <= 2 * size
        had[s] += words
    for s in sizes:
        assert abs(had[s] - wanted[s]) <= len(sizes)
    assert sum(had.values()) == int(sum(wanted.values()))
    # the mix in order: no gap, and every source near its share all along
    at, so_far = 0, defaultdict(int)
    for r in taken.orderBy("place").collect():
        assert r["place"] == at
        at += r["words"]
        so_far[r["source"]] += r["words"]
        for s in sizes:
            assert abs(so_far[s] - float(wanted[s]) * min(r["virtual_time"], 1)) <= 900 * 25 + len(sizes)


def test_reruns_agree_however_the_rows_lie(spark):
    rows = made(9, 200, HOT) + [(None, "no id here", "big")] * 60
    once, again = (Counter(map(tuple, mix_documents(frame(spark, x).repartition(k))[1].collect())) for x, k in ((rows, 1), (rows[::-1], 7)))
    assert once == again
    other = Counter(map(tuple, mix_documents(frame(spark, rows), seed=12)[1].collect()))
    assert other != once


def test_weights_go_by_code_point(spark):
    names = ["b", "ﬁ", "\U0001f600", "a", None, "é"]
    got = {r["source"]: r["weight"] for r in source_weights(spark.createDataFrame([(s, 1) for s in names], "source string, source_size long"), (3, 1, 2)).collect()}
    assert got == {"a": 3, "b": 1, "é": 2, "ﬁ": 3, "\U0001f600": 1, None: 2}


def test_nothing_to_mix(spark):
    for rows in ([], [(1, None, "a"), (2, "", None), (None, " \t", None)]):
        taken, documents = mix_documents(frame(spark, rows))
        assert taken.count() == 0
        assert sorted((r["size"], r["target"], r["taken"]) for r in documents.collect()) == [(0, 0.0, 0)] * len(rows)


def test_equal_rows_are_one_of_the_queue(spark):
    queued = queue(frame(spark, [(1, "a b", "s")] * 50 + [(1, "a b c", "s")]))
    assert sorted((r["size"], r["copies"]) for r in queued.collect()) == [(2, 50), (3, 1)]
