"""Word-shingle sets of texts in numpy: hashes, count vectors, and digests of groups."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x + U((salt * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (1 << 64))
    x = (x ^ x >> U(32)) * U(0xD6E8FEB86659FD93)
    x = (x ^ x >> U(29)) * U(0xA0761D6478BD642F)
    return x ^ x >> U(32)


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number for each byte (A-Z as a-z), and which bytes are white space."""
    low = np.arange(256)
    low[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    return mix(low.astype(U), 1), blank


#: Bytes that are hashed at a time: the tables of powers stay this small, but for longer words.
PIECE = 1 << 18


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, pow(_P, -1, 1 << 64)):
        x = np.full(n, base, U)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _short_powers() -> tuple[np.ndarray, np.ndarray]:
    return _power_tables(2 * PIECE)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of anything but ASCII white space, A-Z lower-cased) of all texts, and how many
    each text has."""
    number, blank = _bytes()
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = blank[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, stops = edge[::2], edge[1::2]
    hashes = np.empty(len(starts), U)
    cuts = [0, *(np.flatnonzero(np.diff(starts // PIECE)) + 1).tolist(), len(starts)] if len(starts) else []
    for a, b in zip(cuts, cuts[1:]):
        low, high = int(starts[a]), int(stops[b - 1])
        power, inverse = _short_powers() if high - low <= 2 * PIECE else _power_tables(high - low)
        total = np.zeros(high - low + 1, U)
        np.cumsum(number[raw[low:high]] * power[: high - low], out=total[1:])
        s, e = starts[a:b] - low, stops[a:b] - low
        hashes[a:b] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U))
    ends = np.cumsum([len(t) + 1 for t in texts]) + 1 if texts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    return hashes, counts


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``width``-word shingles. A text with fewer words has its whole
    sequence as one, and a text without words has none."""
    hashes, counts = word_hashes(texts)
    stops = np.cumsum(counts)
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        rolled = np.zeros(n, U)
        for k in range(width):
            rolled = mix(rolled + hashes[k : k + n], 2)
    out = []
    for stop, count in zip(stops.tolist(), counts.tolist()):
        if count >= width:
            out.append(np.unique(rolled[stop - count : stop - width + 1]))
        elif count:
            h = np.zeros(1, U)
            for k in range(stop - count, stop):
                h = mix(h + hashes[k], 2)
            out.append(mix(h, 100 + count))
        else:
            out.append(np.zeros(0, U))
    return out


def set_digest(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a set and its size: sets with equal digests are taken as equal."""
    with np.errstate(over="ignore"):
        h = mix(np.array([mix(shingles, 3).sum(dtype=U) + U(len(shingles))]), 4)
    return int(h.view(np.int64)[0])


def count_vector(shingles: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((mix(shingles, 5) % U(groups)).astype(np.int64), minlength=groups).astype(np.int32)


class Routing:
    """Keys that any two sets with a Jaccard similarity of at least num / den have one of in common.

    Sets of similar sizes (a band: sizes that double) are dealt by hash into the same number of groups. Linked sets
    differ in at most ``apart(n)`` shingles, so in as many groups, and agree in all others. Of a set's
    groups, ordered by size and digest, all but the lowest are keys, so many that the highest of the groups in which two
    linked sets agree is a key of both.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def apart(self, n: int) -> int:
        """The most shingles in which a linked set can differ from one of ``n``."""
        return (self.den - self.num) * (n + n * self.den // self.num) // (self.den + self.num)

    def needed(self, total):
        """The least overlap of linked sets whose sizes add up to ``total`` (an int or an array)."""
        return -(-self.num * total // (self.num + self.den))

    def key_count(self, n):
        """About how many keys sets of ``n`` shingles have (a number or a Column)."""
        return 2 * ((self.den - self.num) * (n + n * self.den / self.num) / (self.den + self.num) + 1)

    def groups(self, band: int) -> int:
        return -(-14 * (self.apart((2 << band) - 1) + 1) // 10)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        band = n.bit_length() - 1
        out = [self._keys(shingles, band)]
        if n * self.den // self.num >= 2 << band:  # a linked set may be in the next band
            out.append(self._keys(shingles, band + 1))
        return np.concatenate(out)

    def _keys(self, shingles: np.ndarray, band: int) -> np.ndarray:
        count, take = self.groups(band), self.apart(len(shingles)) + 1
        own = mix(shingles, 6)
        group = (own % U(count)).astype(np.uint16 if count < 1 << 16 else np.int64)
        order = np.argsort(group, kind="stable")
        sizes = np.bincount(group, minlength=count)
        digests = np.zeros(count, U)
        there = np.flatnonzero(sizes)
        digests[there] = np.add.reduceat(mix(own, 7)[order], (np.cumsum(sizes) - sizes)[there])
        rank = (sizes.astype(U) << U(40)) | (digests >> U(24))
        best = np.argpartition(rank, count - take)[count - take :] if take < count else np.arange(count)
        return mix(digests[best] + (sizes[best] + (best << 20)).astype(U), 8 + band)
