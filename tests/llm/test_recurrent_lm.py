import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill import storage
from quarrymill.llm.recurrent_lm import END, Gru, _average, by_bytes, flat_words, frequent_words, in_lanes, score_documents, symbols_of, train_in_rounds, with_ends, word_counts, words_of


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words():
    for text in ["Ab  ÉC\x0bd\x85e\x1cf g\xa0h", "", None, " \n"]:
        assert [w.decode() for w in words_of(text)] == plain_words(text)


def small_model(n=11, hidden=4):
    model = Gru(np.arange(1.0, n + 1), hidden)
    rng = np.random.default_rng(1)
    for k, v in model.p.items():
        model.p[k] = (v + rng.normal(0, 0.2, v.shape)).astype(np.float64)
    return model


def test_distribution_sums_to_one():
    model, h = small_model(), np.random.default_rng(2).normal(0, 0.5, (1, 4))
    total = sum(math.exp(model.output(h, np.array([k]))[0][0]) for k in range(model.classes * model.width))
    assert abs(total - 1) < 1e-6


def test_gradient_equals_differences():
    model, rng = small_model(), np.random.default_rng(3)
    y = rng.integers(0, 11, (5, 3))
    mask = np.ones((5, 3), bool)
    mask[3:, 1] = mask[1:, 2] = False
    h = rng.normal(0, 0.3, (3, 4))
    _, grad, _ = model.loss_and_gradient(y, y, mask, h)
    for name, value in model.p.items():
        for at in map(tuple, np.argwhere(np.abs(grad[name]) > 1e-3)[:: max(1, value.size // 12)][:12]):
            old, eps = value[at], 1e-5
            value[at] = old + eps
            up = model.loss_and_gradient(y, y, mask, h)[0]
            value[at] = old - eps
            down = model.loss_and_gradient(y, y, mask, h)[0]
            value[at] = old
            assert abs((up - down) / (2 * eps) - grad[name][at]) < 1e-4, (name, at)


def test_state_is_carried():
    model, rng = small_model(), np.random.default_rng(4)
    docs = [np.r_[rng.integers(2, 11, n), END] for n in (0, 1, 7, 33, 90, 5, 64, 63)]
    want = []
    for d in docs:
        h, total = np.zeros((1, 4)), 0.0
        for x in d:
            total += model.output(h, np.array([x]))[0][0]
            h = model.step(np.array([x]), h)[0]
        want.append(total)
    for lanes, window in ((3, 8), (100, 64)):
        assert np.allclose(model.score(docs, lanes, window), want, atol=1e-3)


#: Bits a token by which the model must beat the base on held-out documents of sf0.01, where 0.4 million tokens train it.
MARGIN = 0.3


def test_gradient_where_documents_start():
    rng = np.random.default_rng(12)
    model = Gru(np.ones(9), 3)
    for v in model.p.values():
        v[...] = rng.normal(0, 0.5, v.shape)
    model.p = {n: v.astype(np.float64) for n, v in model.p.items()}
    y, start = rng.integers(0, 9, (6, 4)), rng.random((6, 4)) < 0.3
    mask = np.ones((6, 4), bool)
    mask[4:, 2] = False
    h = rng.normal(0, 0.5, (4, 3))
    _, grad, last = model.loss_and_gradient(y, y, mask, h, start)
    for name in ("u", "b", "x"):
        flat, own = model.p[name].reshape(-1), grad[name].reshape(-1)
        for i in rng.choice(len(flat), 6, replace=False):
            old, both = flat[i], []
            for d in (1e-5, -1e-5):
                flat[i] = old + d
                both.append(model.loss_and_gradient(y, y, mask, h, start)[0])
            flat[i] = old
            assert math.isclose((both[0] - both[1]) / 2e-5, own[i], rel_tol=1e-3, abs_tol=1e-6)
    # a document that starts knows nothing of the lane before it
    start[3, 1] = True
    ends = [model.loss_and_gradient(y, y, mask, h + k, start)[2][1] for k in (0, 3)]
    assert np.allclose(*ends)


def test_training_learns():
    rng = np.random.default_rng(5)
    docs = [np.r_[np.tile([2, 3, 4, 5], rng.integers(3, 8)), END] for _ in range(64)]
    model = Gru(np.bincount(np.concatenate(docs), minlength=6).astype(float), 8)
    before = model.score(docs).sum()
    model.train(docs, epochs=20)
    assert model.score(docs).sum() > 0.5 * before


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{min(int(x), 200)}" for x in rng.zipf(1.3, rng.integers(0, 60))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(60, None), (61, ""), (None, "w1 unseen"), (3, texts[3])]
    return rows, spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string").repartition(3)


@pytest.mark.parametrize(("vocabulary", "shared"), [(20, 30), (20, 10_000), (500, 10_000)])
def test_scores(docs, vocabulary, shared):
    rows, df = docs
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = score_documents(df, training, vocabulary=vocabulary, shared_words=shared).collect()
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in plain_words(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    for i, t in rows:
        words = plain_words(t)
        for r in by[i]:
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(w in c for w in words) + 1, n)
            want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(train) + 1) / (n + v + 1))
            assert math.isclose(r.base_score, want, rel_tol=1e-9)
            assert r.score < 0


def test_word_counts(spark):
    df = spark.createDataFrame([(1, "a A b"), (2, None), (3, "c b a")], "doc_id long, text string")
    counts = word_counts(df)
    assert {bytes(r.word): r.c for r in counts.collect()} == {b"a": 3, b"b": 2, b"c": 1}
    assert frequent_words(counts, 2) == [(b"a", 3), (b"b", 2)]
    ties = word_counts(spark.createDataFrame([(1, 'c b a')], 'doc_id long, text string'))
    assert frequent_words(ties, 2) == [(b"a", 1), (b"b", 1)]


def test_no_training(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in score_documents(df, F.lit(False)).collect()}
    assert (got[1].n_known, got[1].train_tokens, got[1].base_score) == (0, 0, 0.0) and got[1].score < 0
    assert score_documents(df.limit(0), F.lit(True)).collect() == []


def test_model_beats_base_on_held_out(spark):
    from quarrymill.llm.recurrent_lm import op7_recurrent_lm

    row = op7_recurrent_lm(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score)", "sum(base_score)", "sum(n_tokens)").first()
    print("bits a token:", *[-row[k] / row[2] * math.log2(10) for k in (0, 1)])
    assert (row[0] - row[1]) / row[2] * math.log2(10) > MARGIN


def test_parameters_are_averaged_by_tokens(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(["a", "b", "c", "d"] * int(rng.integers(30, 50))) for _ in range(96)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    place = {w: k for k, w in enumerate([b"a", b"b", b"c", b"d"])}
    model = Gru(np.ones(6), 8)
    docs = [symbols_of(words_of(t), place, 4) for t in texts]
    assert train_in_rounds(model, df.limit(0), place, 4, 0, 2, 1000) is model
    got = train_in_rounds(model, df, place, 4, sum(map(len, docs)), 4, 800, most=2)
    assert got.score(docs).sum() > 0.9 * model.score(docs).sum()
    # the same model, however the rows lie
    again = train_in_rounds(model, df.repartition(7), place, 4, sum(map(len, docs)), 4, 800, most=2)
    assert (again.vector() == got.vector()).all()
    parts = [model.with_vector(model.vector() + k).vector() for k in (0, 1, 2, 5)]
    schema = "part long, at long, tokens long, parameters binary"
    rows = spark.createDataFrame([(g, 0, n, p.tobytes()) for g, n, p in zip((1, 1, 1, 2), (1, 3, 4, 9), parts)], schema).coalesce(1)
    mean = {r.part: r for r in rows.mapInArrow(_average, schema).collect()}
    assert mean[1].tokens == 8 and np.allclose(np.frombuffer(mean[1].parameters, np.float32), model.vector() + 11 / 8, atol=1e-5)
    assert mean[2].tokens == 9 and np.allclose(np.frombuffer(mean[2].parameters, np.float32), model.vector() + 5, atol=1e-5)


def test_lanes_hold_every_document_once():
    rng = np.random.default_rng(8)
    docs = [np.r_[rng.integers(2, 9, int(n)), END] for n in rng.integers(0, 40, 50)]
    rows = in_lanes(docs, 7)
    assert len(rows) == 7 and [len(r) for r, _ in rows] == sorted((len(r) for r, _ in rows), reverse=True)
    cut = [tuple(d) for r, s in rows for d in np.split(r, np.flatnonzero(s)[1:])]
    assert sorted(cut) == sorted(map(tuple, docs)) and in_lanes([], 3) == []


def test_every_training_document_trains(spark, monkeypatch):
    """Groups and rounds cover all documents, each once."""
    texts = [f"a b c d{i}" for i in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    place = {w: k for k, w in enumerate([b"a", b"b", b"c"])}
    before = set(storage._written)
    train_in_rounds(Gru(np.ones(5), 4), df, place, 3, 450, 3, 50)
    found = [spark.read.parquet(p) for p in storage._written if p not in before and "/trained-" in p]
    assert sum(r.tokens for f in found for r in f.collect()) == 5 * 90


def test_classes_together_or_one_by_one():
    rng = np.random.default_rng(9)
    model = Gru(np.arange(1.0, 300), 5)
    model.p = {n: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for n, v in model.p.items()}
    h, y = rng.normal(0, 0.5, (400, 5)), np.minimum(rng.zipf(1.4, 400) - 1, 298)
    found = []
    for few in (0, 4, 32, 400):
        grad = {}
        found.append((*model.output(h, y, grad, 0.5, few=few), grad["c"], grad["w"]))
    for other in found[1:]:
        assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(found[0], other))
    want = [math.log(softmax[k]) for softmax, k in ((np.exp(row) / np.exp(row).sum(), k) for row, k in zip(h @ model.p["c"][:5] + model.p["c"][5], y // model.width))]
    inner = [h[i] @ model.p["w"][k, :5] + model.p["w"][k, 5] for i, k in enumerate(y // model.width)]
    assert np.allclose(found[0][0], [a + row[k % model.width] - math.log(np.exp(row).sum()) for a, row, k in zip(want, inner, y)])


def test_only_what_a_window_touches_changes():
    model = Gru(np.ones(100), 4)
    before = {n: v.copy() for n, v in model.p.items()}
    for _ in range(3):
        model.train([np.array([2, 3, 2, 35, END])])
    moved = np.flatnonzero((model.p["x"] != before["x"]).any(1))
    assert set(moved.tolist()) <= {1, 2, 3, 35} and 2 in moved
    assert np.flatnonzero((model.p["w"] != before["w"]).any((1, 2))).tolist() == [0, 3]


def test_work_goes_by_windows_not_by_classes():
    """CPU of training: calls of a window of 24 steps don't go with the 75 classes that it touches, nor with its 128 lanes."""
    import cProfile
    import pstats

    rng = np.random.default_rng(10)
    docs = [np.r_[np.minimum(rng.zipf(1.2, 240) + 1, 5599), END] for _ in range(128)]
    model, profile = Gru(np.ones(5600), 16), cProfile.Profile()
    profile.runcall(model.train, docs)
    assert pstats.Stats(profile).total_calls / 11 < 900


def test_one_long_document_beside_others():
    """As many lanes as the longest document leaves work for, so that steps aren't spent on it alone."""
    model, rng = small_model(), np.random.default_rng(11)
    docs = [np.r_[rng.integers(2, 11, n), END] for n in (3000, *[15] * 300)]
    seen, forward = [], model.forward
    model.forward = lambda *a: (seen.append(a[0].shape), forward(*a))[1]
    both = model.score(docs)
    assert sum(s for s, _ in seen) < 3100 and max(w for _, w in seen) == 64
    assert np.allclose(both, [model.score([d])[0] for d in docs[:3]] + both[3:].tolist(), atol=1e-3) and len(model.score([])) == 0


def test_words_of_a_batch():
    texts = ["Ab  ÉC\x0bd\x85e\x1cf g\xa0h", "", None, " \n", " a ", "b\t", "\r\nc  D", "\x00 \x1f x"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for most in (1, 9, 10**6):
        cut = list(by_bytes(iter([batch, batch.slice(3, 3)]), 0, most))
        assert [t for b in cut for t in b.column(0).to_pylist()] == texts + texts[3:6] and all(b.num_rows for b in cut)
        for b in cut:
            words, count = flat_words(b.column(0))
            assert [w.decode() for w in words.to_pylist()] == [w for t in b.column(0).to_pylist() for w in plain_words(t)]
            assert count.tolist() == [len(plain_words(t)) for t in b.column(0).to_pylist()]
    place = {b"a": 0, b"d": 1, b"x": 2}
    words, count = flat_words(batch.column(0))
    got = with_ends(np.array([place.get(w, 9) + 2 if place.get(w, 9) < 2 else 0 for w in words.to_pylist()]), count)
    assert [g.tolist() for g in got] == [symbols_of(words_of(t), place, 2).tolist() for t in texts]
