"""String similarities as Column expressions. Words are compared in the JVM, which settles most pairs by bounds from lengths and letters; the
longest common subsequences of the others are computed for a whole Arrow batch at once, each pair a lane of 64-bit words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.text import let

#: Lanes that are computed together.
LANES = 4096
#: White space between words, as Unicode has it, and the separators of ASCII.
BLANK = r"(?U)[\s\x1c-\x1f]+"


def lcs_lanes(a: np.ndarray, lengths: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of rows of codes: ``a`` filled up with -1 beyond ``lengths``, ``b`` with -2. Bit k of a row's words says
    that letter k of ``a`` adds nothing yet; a step for each letter of ``b`` adds the hits as if the words were one long number."""
    n, width = a.shape[0], -(-max(a.shape[1], 1) // 64)
    wide = np.full((n, 64 * width), -1, a.dtype)
    wide[:, : a.shape[1]] = a
    row = np.full((n, width), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(b.shape[1]):
        hit = np.packbits(wide == b[:, j : j + 1], axis=1, bitorder="little").view("<u8") & row
        total = row + hit
        over = total < row
        for w in range(1, width):  # what runs over goes to the next word
            total[:, w] += over[:, w - 1]
            over[:, w] |= over[:, w - 1] & (total[:, w] == 0)
        row = total | (row & ~hit)
    open_ = np.unpackbits(row.view(np.uint8), axis=1, bitorder="little")
    open_[np.arange(64 * width) >= lengths[:, None]] = 0
    return lengths - open_.sum(1, dtype=np.int64)


class Texts:
    """Strings as one array of code points with offsets."""

    def __init__(self, values: list[str]):
        self.size = np.fromiter(map(len, values), np.int64, len(values))
        self.first = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), "<i4")

    def rows(self, which: np.ndarray, start: np.ndarray, width: np.ndarray, fill: int) -> np.ndarray:
        """Codes from ``start`` (which may lie before the text) on, ``width`` of them, filled up where there are none."""
        j = np.arange(int(width.max(initial=0)))
        at = start[:, None] + j
        there = (at >= 0) & (at < self.size[which][:, None]) & (j < width[:, None])
        at = np.where(there, at + self.first[which][:, None], 0)
        return np.where(there, self.codes[at] if len(self.codes) else 0, fill)


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The longest common subsequence of each pair."""
    x, y = Texts(a), Texts(b)
    out = np.zeros(len(a), np.int64)
    order = np.lexsort((np.minimum(x.size, y.size), np.maximum(x.size, y.size) // 64))  # pairs of like lengths side by side
    for lo in range(0, len(order), LANES):
        k = order[lo : lo + LANES]
        long, short = np.maximum(x.size[k], y.size[k]), np.minimum(x.size[k], y.size[k])
        turned = (x.size[k] < y.size[k])[:, None]
        zero = np.zeros(len(k), np.int64)
        pick = lambda p, q, width, fill: np.where(turned, p.rows(k, zero, width, fill), q.rows(k, zero, width, fill))
        out[k] = lcs_lanes(pick(y, x, long, -1), long, pick(x, y, short, -2))
    return out


def partial_scores(a: list[str], b: list[str]) -> np.ndarray:
    """The best similarity of each pair's shorter text with a window of the longer one, windows cut off at its ends included. Windows are lanes."""
    sides = [(s, t, k) if len(s) <= len(t) else (t, s, k) for k, (s, t) in enumerate(zip(a, b))]
    sides += [(t, s, k) for s, t, k in sides if len(s) == len(t)]
    sides = sorted((p for p in sides if p[0]), key=lambda p: len(p[0]))
    out = np.array([100.0 if not s and not t else 0.0 for s, t in zip(a, b)])
    if not sides:
        return out
    short, long, pair = Texts([p[0] for p in sides]), Texts([p[1] for p in sides]), np.array([p[2] for p in sides])
    counts = short.size + long.size - 1
    ends = np.cumsum(counts)
    for lo in range(0, int(ends[-1]), LANES):
        lane = np.arange(lo, min(lo + LANES, int(ends[-1])))
        k = np.searchsorted(ends, lane, "right")
        n, m = short.size[k], long.size[k]
        start = lane - (ends[k] - counts[k]) + 1 - n
        size = np.minimum(start + n, m) - np.maximum(start, 0)
        edge = long.codes[long.first[k] + np.where(start <= m - n, start + n - 1, start).clip(0, m - 1)]
        mine = short.rows(k, np.zeros(len(k), np.int64), n, -1)
        use = (mine == edge[:, None]).any(1)  # a window that ends in a letter that the short text lacks is beaten by a shorter or shifted one
        if use.any():
            common = lcs_lanes(mine[use], n[use], long.rows(k[use], start[use], n[use], -2))
            np.maximum.at(out, pair[k[use]], 200.0 * common / (n[use] + size[use]))
    return out


def _batched(parts: Iterator[tuple[pd.Series, pd.Series]], of, kind: str) -> Iterator[pd.Series]:
    for a, b in parts:
        out = pd.Series([None] * len(a), dtype=kind)
        own = (a.notna() & b.notna()).to_numpy()
        if own.any():
            out[own] = of(a[own].tolist(), b[own].tolist())
        yield out


@F.pandas_udf(T.LongType())
def _lcs(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    yield from _batched(parts, lcs_lengths, "Int64")


def _word_sets(a: Column, b: Column) -> Column:
    """Of the words of both sides: left and right (the words of one side alone, sorted), known (the best score that needs no subsequence), most (what a
    subsequence could give) and total (its denominator)."""
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, BLANK), lambda w: w != "")))
    ratio = lambda distance, total: F.lit(100.0) * (1.0 - distance / F.nullif(total, F.lit(0)))
    within = lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))  # noqa: E731  letters of x that y has

    def scores(p: Column) -> Column:
        i, l, r = p["shared"], F.length(p["left"]), F.length(p["right"])
        gap = F.when(i > 0, 1).otherwise(0)
        total = 2 * (i + gap) + l + r
        known = F.when(~p["there"], 0.0).when((i > 0) & ((l == 0) | (r == 0)), 100.0).when(i > 0, F.greatest(ratio(gap + l, 2 * i + gap + l), ratio(gap + r, 2 * i + gap + r))).otherwise(0.0)
        most = F.when(p["there"] & (known < 100), ratio(l + r - 2 * F.least(within(p["left"], p["right"]), within(p["right"], p["left"])), total)).otherwise(0.0)
        return F.struct(p["left"].alias("left"), p["right"].alias("right"), known.alias("known"), most.alias("most"), total.alias("total"))

    def sets(w: Column) -> Column:
        shared = F.array_join(F.array_intersect(w["x"], w["y"]), " ")
        rest = lambda x, y: F.array_join(F.array_except(w[x], w[y]), " ")
        there = (F.size(w["x"]) > 0) & (F.size(w["y"]) > 0)
        return let(F.struct(there.alias("there"), F.length(shared).alias("shared"), rest("x", "y").alias("left"), rest("y", "x").alias("right")), scores)

    return let(F.struct(words(a).alias("x"), words(b).alias("y")), sets)


def word_sets(a: Column, b: Column) -> Column:
    """What set_ratio() needs of two texts; a null one has no words."""
    return _word_sets(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def set_ratio(p: Column, at_least: Column | float = 0.0) -> Column:
    """The token_set_ratio() of word_sets(): it names them a dozen times, so that over many rows they are best a stored column."""
    open_ = (p["most"] > p["known"]) & (p["most"] >= at_least)
    common = _lcs(F.when(open_, p["left"]), F.when(open_, p["right"]))
    computed = 100.0 * (1.0 - (F.length(p["left"]) + F.length(p["right"]) - 2 * common) / F.nullif(p["total"], F.lit(0)))
    return F.when(open_, F.greatest(p["known"], computed)).otherwise(p["known"])


def token_set_ratio(a: Column, b: Column, at_least: Column | float = 0.0) -> Column:
    """The best similarity of the common words and of either side's words, 0 to 100; 0 where a side has no words or is null. Scores below ``at_least`` need
    not be exact: what can't reach it gets a score below it."""
    return set_ratio(word_sets(a, b), at_least)


@F.pandas_udf(T.DoubleType())
def _partial(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    yield from _batched(parts, partial_scores, "float64")


def partial_ratio(a: Column, b: Column) -> Column:
    """0 to 100. Containment is decided without Python; only other pairs reach it."""
    inside = (a != "") & (b != "") & (b.contains(a) | a.contains(b))
    return F.when(inside, F.lit(100.0)).otherwise(_partial(F.when(~inside, a), F.when(~inside, b)))
