"""Document log-likelihood by a gated recurrent language model (operator 7).

The model is a GRU over the most frequent words, trained in numpy by truncated backpropagation; its output softmax is
factored into a class and a word of the class. All other words are one symbol of the model, and share its probability by
their counts in all training documents. Documents are scored whole: the state is carried from window to window.

All training documents train the model, each in one of some rounds: they are dealt to groups by hash, of about as many tokens each at every size of
the input; in a round every group trains a copy of the model, and the copies' parameters are averaged by tokens before the next. So neither the
cluster nor the order of the input changes the model. Its vocabulary grows with the root (the third) of the number of tokens.

Counts grow with the corpus, so only those of the most frequent words go to every worker (a bounded number); the
others are joined by word.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from copy import copy
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import documents, map_arrow, stored, table

#: Model symbols: any word outside the model's vocabulary, and the end of a document.
OTHER, END = 0, 1


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8: bytes.lower and bytes.split know ASCII letters and white space alone."""
    return (text or "").encode().lower().split()


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``most`` bytes of text, or one longer text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(size, most + (size[lo - 1] if lo else 0), "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, see words_of(), one after the other, and how many each text has."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    count, flat = pc.list_value_length(words).to_numpy(zero_copy_only=False), words.flatten()
    empty = pc.binary_length(flat).to_numpy(zero_copy_only=False) == 0  # beside white space at the ends of a text
    if empty.any():
        count = count - np.bincount(np.repeat(np.arange(len(count)), count)[empty], minlength=len(count))
        flat = flat.filter(pa.array(~empty))
    return flat.cast(pa.binary()), count


def places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word is in ``among``; -1 if it isn't there."""
    return pc.fill_null(pc.index_in(words, among), -1).to_numpy(zero_copy_only=False)


def with_ends(symbols: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """The symbols of each document, whose words' symbols follow each other, with its end."""
    out = np.full(len(symbols) + len(count), END, np.int32)
    out[np.arange(len(symbols)) + np.repeat(np.arange(len(count)), count)] = symbols
    return np.split(out, np.cumsum(count + 1)[:-1])


def dealt_to_lanes(sizes: list[int], lanes: int) -> list[list[int]]:
    """The documents of each lane, the longest lane first: by descending size, each goes to the lane that has the fewest symbols."""
    heap = [(0, k) for k in range(min(lanes, len(sizes)))]
    own: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, k = heapq.heappop(heap)
        own[k].append(i)
        heapq.heappush(heap, (size + sizes[i], k))
    return sorted(own, key=lambda row: -sum(sizes[i] for i in row))


def in_lanes(docs: list[np.ndarray], lanes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(symbols, does a document start here) of each lane; see dealt_to_lanes()."""
    out = []
    for row in dealt_to_lanes([len(d) for d in docs], lanes):
        start = np.zeros(sum(len(docs[i]) for i in row), bool)
        start[np.cumsum([0, *(len(docs[i]) for i in row)])[:-1]] = True
        out.append((np.concatenate([docs[i] for i in row]), start))
    return out


def windows(rows: list[tuple[np.ndarray, np.ndarray]], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """symbols, mask, start and place (in all lanes, one after the other) of each window of ``window`` steps, as steps x lanes. Lanes that have ended leave."""
    if not rows:
        return
    sizes = np.array([len(x) for x, _ in rows])
    symbols, starts, first = np.concatenate([x for x, _ in rows]), np.concatenate([s for _, s in rows]), np.cumsum(sizes) - sizes
    for at in range(0, int(sizes[0]), window):
        live = int(np.searchsorted(-sizes, -at, "left"))  # lanes that go on, the longest first
        step = np.arange(at, min(at + window, int(sizes[0])))[:, None]
        mask = step < sizes[:live]
        place = first[:live] + np.where(mask, step, 0)
        yield np.where(mask, symbols[place], 0), mask, starts[place] & mask, place


class Gru:
    """A GRU with a class-factored softmax; symbols 0 .. size - 1, class = symbol // width."""

    def __init__(self, counts: np.ndarray, hidden: int = 16, seed: int = 5):
        rng, n = np.random.default_rng(seed), len(counts)
        self.size, self.hidden = n, hidden
        self.width = int(np.ceil(np.sqrt(n)))
        self.classes = -(-n // self.width)
        full = np.full(self.classes * self.width, -30.0, np.float32)
        full[:n] = np.log((counts + 1) / (counts + 1).sum())  # untrained, it's the unigram model
        words = full.reshape(self.classes, self.width)
        mass = np.log(np.exp(words).sum(1))
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.p = {
            "x": small(n, 3 * hidden), "u": small(hidden, 3 * hidden) + np.tile(np.eye(hidden, dtype=np.float32) * 0.3, 3), "b": np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(hidden)].astype(np.float32),
            "c": np.zeros((hidden + 1, self.classes), np.float32), "w": np.zeros((self.classes, hidden + 1, self.width), np.float32),
        }
        self.p["c"][hidden], self.p["w"][:, hidden] = mass, words - mass[:, None]  # the last weights, of a unit that is always 1, are biases
        self.tame = False
        self.moments: tuple[dict, dict, int] | None = None

    def vector(self) -> np.ndarray:
        """All parameters, one after the other."""
        return np.concatenate([v.ravel() for v in self.p.values()])

    def with_vector(self, vector: np.ndarray) -> Gru:
        """A model with these parameters, that has not trained yet."""
        out, at = copy(self), 0
        out.p = {}
        for n, v in self.p.items():
            out.p[n], at = vector[at : at + v.size].reshape(v.shape).astype(v.dtype), at + v.size
        out.moments, out.tame = None, out.tamed()
        return out

    def tamed(self) -> bool:
        """Can no logit leave the range of float32's exp? (States lie between -1 and 1.)"""
        p = self.p
        most = max(np.abs(p["c"]).sum(0).max(), np.abs(p["w"]).sum(1).max())
        return bool(most < 80)

    def advance(self, g: np.ndarray, h: np.ndarray, v: np.ndarray, rz: np.ndarray, n: np.ndarray, new: np.ndarray) -> None:
        """One symbol for each lane, all arrays rows x lanes: from what the symbols give to the gates (``g``) and the states ``h``, to the states ``new`` and
        what the backward pass needs."""
        k = self.hidden
        np.matmul(self.p["u"].T, h, out=v)
        np.add(g[: 2 * k], v[: 2 * k], out=rz)
        np.negative(rz, out=rz)
        np.exp(rz, out=rz)
        rz += 1
        np.reciprocal(rz, out=rz)
        np.multiply(rz[:k], v[2 * k :], out=n)
        n += g[2 * k :]
        np.tanh(n, out=n)
        np.subtract(h, n, out=new)
        new *= rz[k:]
        new += n

    def forward(self, x: np.ndarray, mask: np.ndarray, start: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """States (before each step, and after the last) of a window's symbols (steps x lanes), and v, rz and n of advance(), each as steps x rows x lanes."""
        (steps, lanes), k = x.shape, self.hidden
        g = self.p["x"].take(x, 0)
        g += self.p["b"]
        g = np.ascontiguousarray(g.transpose(0, 2, 1))
        states, v, rz, n = (np.empty((steps + more, rows, lanes), g.dtype) for more, rows in ((1, k), (0, 3 * k), (0, 2 * k), (0, k)))
        states[0] = h
        whole, begins = mask.all(1).tolist(), start.any(1).tolist()
        for t in range(steps):
            if begins[t]:
                states[t] *= ~start[t]
            self.advance(g[t], states[t], v[t], rz[t], n[t], states[t + 1])
            if not whole[t]:
                np.copyto(states[t + 1], states[t], where=~mask[t])
        return states, v, rz, n

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One symbol for each lane: the new state (lanes x units), then what the backward pass needs."""
        on = np.ones((1, len(x)), bool)
        states, v, rz, n = self.forward(x[None], on, ~on, h.T)
        return tuple(a.T for a in (states[1], rz[0], n[0], v[0]))

    def output(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None, scale: float = 1.0, few: int = 32) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of ``y`` after states ``h``; with ``grad``, also the gradient of h, and in ``grad`` those of the output. Classes
        with at most ``few`` rows are multiplied together, the others one by one."""
        p, k, kind = self.p, self.hidden, np.result_type(h, self.p["c"])
        order = np.argsort((y // self.width).astype(np.uint16 if self.classes < 1 << 16 else np.int64), kind="stable")
        own = y[order]
        cls = own // self.width
        one = np.ones((len(own), k + 1), kind)
        one[:, :k] = h.take(order, 0)
        rows, to_2 = np.arange(len(own)), kind.type(1 / np.log(2))

        def soft(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Binary log probabilities of ``at`` from binary logits; with ``grad``, these become the gradient of natural ones."""
            if not self.tame:
                logits -= logits.max(1, keepdims=True)
            flat, at = logits.reshape(-1), at + rows * logits.shape[1]
            out = flat.take(at)
            np.exp2(logits, out=logits)
            total = logits @ np.ones(logits.shape[1], kind)
            if grad is not None:
                logits *= (scale / total)[:, None]
                flat[at] -= scale
            return out - np.log2(total)

        error = one @ (p["c"] * to_2)
        log = soft(error, cls)
        if grad is not None:
            grad["c"], dh = one.T @ error, error @ p["c"][:k].T
        ends = np.searchsorted(cls, np.arange(self.classes + 1))
        count, first = np.diff(ends), ends[:-1]
        small, spans = np.flatnonzero((count > 0) & (count <= few)), [(c, slice(ends[c], ends[c + 1])) for c in np.flatnonzero(count > few).tolist()]
        inside = np.arange(few) < count[small][:, None]
        slots, held = np.flatnonzero(inside), (first[small][:, None] + np.arange(few))[inside]  # where rows of small classes are, and which rows
        padded = np.zeros((len(small) * few, k + 1), kind)
        padded[slots] = one[held]
        padded = padded.reshape(len(small), few, k + 1)
        words, error = p["w"] * to_2, np.empty((len(own), self.width), kind)
        for c, span in spans:
            np.matmul(one[span], words[c], out=error[span])
        error[held] = (padded @ words[small]).reshape(len(small) * few, self.width)[slots]
        log += soft(error, own - cls * self.width)
        out = np.empty_like(log)
        out[order] = log / to_2
        if grad is None:
            return out, None
        more, grad["w"] = np.empty_like(dh), np.zeros(words.shape, kind)
        for c, span in spans:
            np.matmul(one[span].T, error[span], out=grad["w"][c])
            np.matmul(error[span], p["w"][c, :k].T, out=more[span])
        wide = np.zeros((len(small) * few, self.width), kind)
        wide[slots] = error[held]
        wide = wide.reshape(len(small), few, self.width)
        grad["w"][small] = padded.transpose(0, 2, 1) @ wide
        more[held] = (wide @ p["w"][small, :k].transpose(0, 2, 1)).reshape(len(small) * few, k)[slots]
        dh += more
        place = np.empty_like(order)
        place[order] = rows
        return out, dh.take(place, 0)

    def window_gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, start: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """As loss_and_gradient(), with states as units x lanes; the gradient of x is of the ``symbols`` that occur."""
        (steps, lanes), k = x.shape, self.hidden
        states, v, rz, n = self.forward(x, mask, start, h)
        before, whole, begins = states[:-1], mask.all(1).tolist(), start.any(1).tolist()
        on, full, grad = mask.ravel(), bool(mask.all()), {}
        scale = 1 / max(1, int(on.sum()))
        flat = before.transpose(0, 2, 1).reshape(-1, k)
        if full:
            log, outer = self.output(flat, y.ravel(), grad, scale)
        else:
            outer = np.zeros_like(flat)
            log, outer[on] = self.output(flat[on], y.ravel()[on], grad, scale)
        outer = np.ascontiguousarray(outer.reshape(steps, lanes, k).transpose(0, 2, 1))
        # what a change of the state after a step does to its gates, for all steps at once
        r, z, factor = rz[:, :k], rz[:, k:], np.empty((steps, 3, k, lanes), states.dtype)
        stay = 1 - z
        new = stay * (1 - n * n)
        np.multiply(new * v[:, 2 * k :], r * (1 - r), out=factor[:, 0])
        np.multiply((before - n) * z, stay, out=factor[:, 1])
        np.multiply(new, r, out=factor[:, 2])
        changes, dv, carry = np.empty_like(outer), np.empty_like(factor), np.zeros_like(states[0])
        for t in range(steps - 1, -1, -1):
            d = changes[t]
            np.multiply(carry, mask[t], out=d)
            np.multiply(d, factor[t], out=dv[t])
            own = self.p["u"] @ dv[t].reshape(3 * k, lanes)
            own += outer[t]
            if not whole[t]:
                own += carry * ~mask[t]
            d = d * z[t]
            own += d
            if begins[t]:
                own *= ~start[t]
            carry = own
        dv = dv.reshape(steps, 3 * k, lanes)
        grad["u"] = np.matmul(before, dv.transpose(0, 2, 1)).sum(0)
        np.multiply(changes, new, out=dv[:, 2 * k :])
        moved, symbols = dv.transpose(0, 2, 1).reshape(-1, 3 * k), x.ravel()
        if not full:
            moved, symbols = moved[on], symbols[on]
        order = np.argsort(symbols.astype(np.uint16) if self.size < 1 << 16 else symbols, kind="stable")
        symbols = symbols[order]
        first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        grad["symbols"], grad["x"] = symbols[first], np.add.reduceat(moved.take(order, 0), first, axis=0)
        grad["b"] = grad["x"].sum(0)
        return -float(log.sum()) * scale, grad, states[-1]

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, h: np.ndarray, start: np.ndarray | None = None) -> tuple[float, dict, np.ndarray]:
        """Mean loss over a window (steps x lanes), its gradient, and the last state (lanes x units); x[t] is read after y[t] is
        foretold, and the state before the window is taken as given (truncation). Where ``start`` holds, a document begins, with the state zero."""
        loss, found, h = self.window_gradient(x, y, mask, np.zeros_like(mask) if start is None else start, h.T)
        grad = {n: np.zeros_like(v) for n, v in self.p.items()}
        for n, v in grad.items():
            v[found["symbols"] if n == "x" else slice(None)] = found[n]
        return loss, grad, h.T

    def train(self, docs: list[np.ndarray], window: int = 24, lanes: int = 128, epochs: int = 1, rate: float = 0.015) -> list[float]:
        """Adam over windows of lanes, in which documents follow each other; the mean loss of each epoch. Further calls go on from the moments
        of the last. What stays in memory is a window, besides the documents."""
        losses = []
        zeros = lambda: {n: np.zeros_like(v) for n, v in self.p.items()}
        m, s, count = self.moments or (zeros(), zeros(), 0)
        rows = in_lanes(docs, lanes)
        for _ in range(epochs):
            total = tokens = 0
            h = np.zeros((self.hidden, len(rows)), np.float32)
            for y, on, start, _ in windows(rows, window):
                loss, grad, h = self.window_gradient(y, y, on, start, h[:, : y.shape[1]])
                own_tokens = int(on.sum())
                total, tokens, count = total + loss * own_tokens, tokens + own_tokens, count + 1
                # only what the window has touched changes
                seen = grad.pop("symbols")
                others = np.flatnonzero(np.bincount(seen // self.width, minlength=self.classes) == 0)
                kept = [a["w"][others] for a in (m, s, self.p)]
                norm, spread = math.sqrt(sum(float(np.vdot(v, v)) for v in grad.values())), math.sqrt(1 - 0.99**count)
                for n, v in grad.items():
                    own = seen if n == "x" else slice(None)
                    v *= 0.1 * min(1.0, 1.0 / (norm + 1e-9))  # a tenth of the clipped gradient, whose square is a hundredth
                    first, second = m[n][own], s[n][own]
                    first *= 0.9
                    first += v
                    v *= v
                    second *= 0.99
                    second += v
                    if n == "x":
                        m[n][own], s[n][own] = first, second
                    np.sqrt(second, out=v)
                    v += 1e-6 * spread
                    np.divide(first, v, out=v)
                    v *= rate * spread / (1 - 0.9**count)
                    self.p[n][own] -= v
                for a, rows_kept in zip((m, s, self.p), kept):
                    a["w"][others] = rows_kept
            losses.append(float(total / max(1, tokens)))
        self.moments, self.tame = (m, s, count), self.tamed()
        return losses

    def score(self, docs: list[np.ndarray], lanes: int = 512, window: int = 8) -> np.ndarray:
        """Natural log probability of each document (of one symbol or more); documents follow each other in lanes, a window of which is worked on at a time.
        Where one document would outlast the others, lanes are fewer and windows longer."""
        total, longest = sum(map(len, docs)), max(map(len, docs), default=1)
        fewer = min(lanes, max(64, total // longest))
        lanes, window = fewer, window * lanes // fewer
        own = dealt_to_lanes([len(d) for d in docs], lanes)
        order = [i for row in own for i in row]
        rows = in_lanes(docs, lanes)
        logs = np.zeros(total)
        h = np.zeros((self.hidden, len(rows)), np.float32)
        for y, on, start, place in windows(rows, window):
            states = self.forward(y, on, start, h[:, : y.shape[1]])[0]
            h = states[-1]
            logs[place[on]] = self.output(states[:-1].transpose(0, 2, 1)[on], y[on])[0]
        out = np.zeros(len(docs))
        if order:
            out[order] = np.add.reduceat(logs, np.cumsum([0, *(len(docs[i]) for i in order)])[:-1])
        return out


# --- counts


def _count(batches: Iterator[pa.RecordBatch], limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """(word, count) of a task's texts, given out whenever ``limit`` words have gathered."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        found = pc.value_counts(pa.chunked_array(held, pa.binary()))
        return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "c"])

    for batch in by_bytes(batches, 1):
        held.append(flat_words(batch.column(1))[0])
        size += len(held[-1])
        if size >= limit:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (as bytes) and its count in all of ``docs`` (doc_id, text). Stored."""
    parts = map_arrow(docs, _count, "word binary, c long")
    return stored(parts.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def frequent_words(counts: DataFrame, most: int) -> list:
    """The words with the highest counts, no more than ``most``, all words of a count or none: by descending count. If even
    the highest count has more words, the first of them by letter."""
    sizes = counts.groupBy("c").count().orderBy(F.desc("c")).limit(most).collect()
    total, least = 0, None
    for c, n in sizes:
        if total + n > most:
            break
        total, least = total + n, c
    if least is None:
        top = counts.where(F.col("c") == sizes[0][0]).orderBy("word").limit(most).collect() if sizes else []
        return [(bytes(r.word), r.c) for r in top]
    found = counts.where(F.col("c") >= least).select("word", "c").toArrow()
    return sorted(zip(found["word"].to_pylist(), found["c"].to_pylist()), key=lambda r: (-r[1], r[0]))


# --- training


def symbols_of(words: list[bytes], place: dict, vocabulary: int) -> np.ndarray:
    """The model's symbols of a document."""
    at = np.fromiter(map(place.get, words, repeat(vocabulary)), np.int64, len(words))
    return np.r_[np.where(at >= vocabulary, OTHER, at + 2), END]


def _symbols(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """turn, group and key of documents as they are, and their symbols."""
    among, numbers = pa.array(shared.value["place"].keys(), pa.binary()), np.array([*shared.value["place"].values(), shared.value["vocabulary"]])
    numbers = np.where(numbers < shared.value["vocabulary"], numbers + 2, OTHER)  # the last is that of words without a place
    for batch in by_bytes(batches, 3):
        words, count = flat_words(batch.column(3))
        own = [x.astype("<i4").tobytes() for x in with_ends(numbers[places(words, among)], count)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.binary())], ["turn", "group", "key", "symbols"])


def _train(batches: Iterator[pa.RecordBatch], shared, chunk: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Tokens, and the parameters of the shared model after it was trained on a group's documents, all together (some millions of tokens at a time, should
    a group have more). Groups come one after the other."""
    group, model, docs, size, total = None, None, [], 0, 0

    def learnt() -> pa.RecordBatch:
        model.train(docs)
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([0], pa.int64()), pa.array([total + size], pa.int64()), pa.array([model.vector().tobytes()], pa.binary())], ["part", "at", "tokens", "parameters"])

    for batch in batches:
        for g, symbols in zip(batch.column(0).to_pylist(), batch.column(1)):
            if g != group:
                if group is not None:
                    yield learnt()
                group, model, docs, size, total = g, shared.value["model"].with_vector(shared.value["model"].vector()), [], 0, 0
            if size >= chunk:
                model.train(docs)
                docs, size, total = [], 0, total + size
            docs.append(np.frombuffer(symbols.as_py(), "<i4"))
            size += len(docs[-1])
    if group is not None:
        yield learnt()


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part, whose rows come one after the other."""
    part, tokens, total = None, 0, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([0], pa.int64()), pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], ["part", "at", "tokens", "parameters"])

    for batch in batches:
        for p, n, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if p != part:
                if tokens:
                    yield out()
                part, tokens, total = p, 0, 0.0
            tokens, total = tokens + n, total + np.frombuffer(v.as_py(), np.float32).astype(np.float64) * n
    if tokens:
        yield out()


def train_in_rounds(model: Gru, train: DataFrame, place: dict, vocabulary: int, tokens: int, rounds: int, group_tokens: int, most: int = 8) -> Gru:
    """Each document trains in one of ``rounds`` rounds, in a group of about ``group_tokens``, by hash of id and text. The driver gets the averages of
    at most ``most`` parts of the groups."""
    spark, schema = train.sparkSession, "part long, at long, tokens long, parameters binary"
    groups = max(1, -(-tokens // (rounds * group_tokens)))
    words = spark.sparkContext.broadcast({"place": place, "vocabulary": vocabulary})
    key = F.xxhash64("doc_id", "text")
    dealt = train.select(F.pmod(key, F.lit(rounds)).alias("turn"), F.pmod(F.shiftright(key, 8), F.lit(groups)).alias("group"), key.alias("key"), "text")
    dealt = stored(map_arrow(dealt, _symbols, "turn long, group long, key long, symbols binary", shared=words), "symbols")
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast({"model": model})
        own = dealt.where(F.col("turn") == turn).repartition(groups, "group").sortWithinPartitions("group", "key").select("group", "symbols")
        found = stored(map_arrow(own, _train, schema, shared=shared), "trained")
        while found.count() > most:
            found = found.select(F.floor(F.col("part") / most).alias("part"), F.col("part").alias("at"), "tokens", "parameters")
            found = stored(map_arrow(found.repartition(-(-groups // most), "part").sortWithinPartitions("part", "at"), _average, schema), "averages")
        rows = [(r.tokens, np.frombuffer(r.parameters, np.float32).astype(np.float64)) for r in found.orderBy("part").collect()]
        shared.unpersist()
        if rows:
            model = model.with_vector((sum(n * p for n, p in rows) / sum(n for n, _ in rows)).astype(np.float32))
    words.unpersist()
    return model


# --- scoring


def _score(batches: Iterator[pa.RecordBatch], shared, parts: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """For each document its tokens, what the model says, and the words that are outside the frequent ones. Some ``parts`` tokens are scored together."""
    model, log_counts, vocabulary = shared.value["model"], shared.value["log_counts"], shared.value["vocabulary"]
    row, among = TaskContext.get().partitionId() << 36, pa.array(shared.value["top"], pa.binary())
    names = [c.split()[0] for c in SCORED.split(", ")]
    held, symbols, size = [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal row
        log, at = model.score(symbols) / np.log(10), 0
        for cols in held:
            n = len(cols[0])
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + n), pa.int64()), *cols, pa.array(log[at : at + n])], names)
            row, at = row + n, at + n

    for batch in by_bytes(batches, 1):
        words, count = flat_words(batch.column(1))
        at = places(words, among)
        rare, outside = at < 0, at >= vocabulary
        logs, owner = np.where(rare, 0.0, log_counts[at]) if len(log_counts) else np.zeros(len(at)), np.repeat(np.arange(len(count)), count)
        sums = lambda x: np.bincount(owner, x, len(count)).astype(np.float64)  # noqa: E731 (of no words, they are whole numbers)
        n_rare = sums(rare).astype(np.int64)
        held.append([
            batch.column(0), pa.array(count + 1, pa.int64()), pa.array(count - n_rare, pa.int64()), pa.array(sums(logs)), pa.array(sums(np.where(outside, logs, 0.0))),
            pa.array(sums(outside).astype(np.int64) + n_rare), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n_rare]), pa.int32()), words.filter(pa.array(rare))),
        ])
        symbols += with_ends(np.where(rare | outside, OTHER, at + 2), count)
        size += len(at)
        if size >= parts:
            yield from out()
            held, symbols, size = [], [], 0
    if held:
        yield from out()


SCORED = "row long, doc_id long, n_tokens long, n_frequent long, log_frequent double, log_outside double, n_outside long, rare array<binary>, model_log double"


def score_documents(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: int | None = None,
    hidden: int = 16,
    rounds: int = 3,
    group_tokens: int = 2_500_000,
    shared_words: int = 400_000,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``training``: a condition on doc_id; rows for which it is null don't train. All of them are counted, and
    each trains the GRU in one of the ``rounds``; see train_in_rounds(). At most ``shared_words`` words and counts go to the workers, and as many words
    are symbols of the model as twelve times the cube root of the number of training tokens (or ``vocabulary``, if given).

    A null text counts as empty: the end token alone. Repeated rows are all scored. Without training documents every
    token has the base probability 1 and the model's is uniform over its symbols. An empty table gives no rows.
    """
    spark, own = docs.sparkSession, documents(docs, id_col, text_col)
    train = own.where(training)
    counts = word_counts(train)
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    n, v = sums[0] + ends, sums[1] + bool(ends)
    top = frequent_words(counts, shared_words)
    symbols = min(int(12 * n ** (1 / 3)) if vocabulary is None else vocabulary, len(top))
    inside = sum(c for _, c in top[:symbols])
    model = Gru(np.array([sums[0] - inside, ends, *[c for _, c in top[:symbols]]], np.float64), hidden)
    if n:
        model = train_in_rounds(model, train, {w: k for k, (w, _) in enumerate(top[:symbols])}, symbols, n, rounds, group_tokens)
    shared = spark.sparkContext.broadcast({"model": model, "top": [w for w, _ in top], "log_counts": np.log10(np.array([c for _, c in top], np.float64) + 1), "vocabulary": symbols})
    scored = stored(map_arrow(own, _score, SCORED, shared=shared), "scored")
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts, "word")
    rare = rare.groupBy("row").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("c") + 1)).alias("log_rare"))
    out = scored.drop("rare").join(rare, "row", "left").fillna(0, ["n_rare", "log_rare"])
    known_end = int(ends > 0)
    rest = sums[0] - inside + (v - bool(ends) - symbols) + 1  # what words outside the model's vocabulary share
    return out.select(
        "doc_id", "n_tokens", (F.col("n_frequent") + F.col("n_rare") + known_end).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_frequent") + F.col("log_rare") + float(np.log10(ends + 1)) - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("model_log") + F.col("log_outside") + F.col("log_rare") - F.col("n_outside") * float(np.log10(rest))).alias("score"),
    )


def op7_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = score_documents(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op7_recurrent_lm": op7_recurrent_lm}
SQL: dict[str, str] = {}
