"""SentencePiece BPE encoding and decoding (operator 9) by a merge-type prefix table.

For each prefix of a chunk the table stores the one token that ends the prefix's encoding. An automaton
over the vocabulary gives the tokens that end at a position; the one of them that may stand after the last token of
the shorter prefix (their pair is what the merges make of its joint text) is the prefix's last token. The ids come
from walking the table backwards.

Text is cut where no piece of the vocabulary crosses: before the mark of a space that follows another
character, and around line ends. Chunks met before come from a bounded memo.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm.common import documents, map_arrow, table, tokenizer_path

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def _each_byte(error: UnicodeError):
    return "�" * (error.end - error.start), error.end


codecs.register_error("quarrymill_each_byte", _each_byte)


class PieceModel:
    """The vocabulary of a SentencePiece BPE model with byte fallback and its coder."""

    def __init__(self, path: str, capacity: int = 400_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.eos, self.capacity = sp.eos_id(), capacity
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.text = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.text[i] = i, bytes([value])
            elif sp.is_unknown(i):
                self.text[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.rank[piece], self.ids[piece], self.text[i] = -sp.get_score(i), i, piece.replace(SPACE, " ").encode()
                if "\n" in piece or SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"the piece {piece!r} crosses a boundary that this coder relies on")
        self.tokens = list(self.ids)
        #: Pieces of more than one space share a rank; the pair test needs ranks that differ.
        often = Counter(self.rank.values())
        self.tied = {p for p in self.tokens if often[self.rank[p]] > 1}
        if any(p.strip(SPACE) for p in self.tied):
            raise ValueError("pieces other than runs of spaces share a score")
        self.find = ahocorasick.Automaton()
        for piece in self.tokens:
            if len(piece) == 1 or self.merged(piece) == [piece]:  # else the merges never make it
                self.find.add_word(piece, piece)
        self.find.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.spaced: dict[str, tuple[bytes, str]] = {}  # chunks after a space
        self.bare: dict[str, tuple[bytes, str]] = {}

    def merged(self, text: str) -> list[str]:
        """What the merges make of ``text``: always the pair of best rank, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = float("inf"), -1
            for k in range(len(parts) - 1):
                rank = self.rank.get(parts[k] + parts[k + 1], float("inf"))
                if rank < best:
                    best, at = rank, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def merged_long(self, text: str) -> list[str]:
        """As merged(), with the pairs in a heap and the parts linked to their neighbours: n log n steps."""
        n = len(text)
        parts: list[str | None] = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.rank.get
        heap = [(r, k, 2) for k in range(n - 1) if (r := rank(text[k : k + 2])) is not None]
        heapify(heap)
        while heap:
            _, k, size = heappop(heap)
            j = after[k]
            if parts[k] is None or j >= n or len(parts[k]) + len(parts[j]) != size:
                continue  # one of the two has been merged since
            parts[k], parts[j] = parts[k] + parts[j], None
            after[k] = i = after[j]
            if i < n:
                before[i] = k
                if (r := rank(parts[k] + parts[i])) is not None:
                    heappush(heap, (r, k, len(parts[k]) + len(parts[i])))
            if (i := before[k]) >= 0 and (r := rank(parts[i] + parts[k])) is not None:
                heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
        return [p for p in parts if p is not None]

    def compatible(self, left: str, right: str) -> bool:
        """Would the merges of the joint text end in just these two?"""
        if len(self.pairs) >= self.capacity:
            self.pairs.clear()
        out = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return out

    def tokenize(self, chunk: str) -> list[str]:
        """Tokens of a chunk by the prefix table. Characters that aren't in the vocabulary stand alone: no merge
        crosses them. Runs of spaces, whose pieces share a rank, are merged pair by pair."""
        if SPACE + SPACE in chunk and self.tied:
            return self.merged(chunk) if len(chunk) < 32 else self.merged_long(chunk)
        last: list[str | None] = [None] * (len(chunk) + 1)
        pairs = self.pairs
        for end, token in self.find.iter(chunk):  # at each end, the longest first
            if last[end + 1] is None:
                before = end + 1 - len(token)
                left = last[before]
                if left is None:  # the start, or a character that no piece holds
                    if before == 0 or chunk[before - 1] not in self.ids:
                        last[end + 1] = token
                    continue
                fits = pairs.get((left, token))
                if fits if fits is not None else self.compatible(left, token):
                    last[end + 1] = token
        out, at = [], len(chunk)
        while at:
            token = last[at] or chunk[at - 1]
            out.append(token)
            at -= len(token)
        return out[::-1]

    def _learn(self, chunk: str) -> tuple[bytes, str]:
        ids: list[int] = []
        for token in self.tokenize(chunk):
            i = self.ids.get(token)
            if i is None:
                ids += [self.byte_ids[b] for b in token.encode()]
            else:
                ids.append(i)
        return array("I", ids).tobytes(), " ".join(map(str, ids))

    def _memo(self, memo: dict, words: list[str], mark: str) -> list[tuple[bytes, str]]:
        if missing := set(words).difference(memo):
            if len(memo) + len(missing) > self.capacity:
                memo.clear()
                missing = set(words)
            for word in missing:
                memo[word] = self._learn(mark + word)
        return [memo[w] for w in words]

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """ids of the whole text with the end id, and the same ids as decimals joined by spaces."""
        if not text:
            coded = []
        elif SPACE in text or "  " in text or "\n " in text or text[0] == " ":
            coded = [self._memo(self.bare, [c], "")[0] for c in _CHUNK.findall((SPACE + text.replace(" ", SPACE)))]
        else:
            words, firsts = [], []
            for k, line in enumerate(text.split("\n")):
                first, *rest = line.split(" ")
                words.append(rest)
                firsts.append(first)
            start = self._memo(self.spaced, firsts[:1], SPACE)
            bare = self._memo(self.bare, ["\n", *firsts[1:]], "")
            rest = self._memo(self.spaced, [w for own in words for w in own], SPACE)
            coded, at = start, 0
            for k, own in enumerate(words):
                if k:
                    coded.append(bare[0])
                    if firsts[k]:
                        coded.append(bare[k])
                coded += rest[at : at + len(own)]
                at += len(own)
        ids = np.frombuffer(b"".join([c[0] for c in coded]) + np.array([self.eos], "<u4").tobytes(), "<u4")
        return ids, " ".join([*[c[1] for c in coded], str(self.eos)])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, bytes read as UTF-8 (each byte that is none gives U+FFFD), control ids
        dropped, and the space before the first piece taken away."""
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "quarrymill_each_byte")


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coder = model(path)
        got = [coder.encode(t.as_py() or "") for t in batch.column(1)]
        cols = [batch.column(0), pa.array([x.tolist() for x, _ in got], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids"])


def encode_pieces(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (with the end id) of every whole text, as the sentencepiece library gives them.

    A null or empty text gives the end id alone; null ids stay null; repeated rows give repeated rows; an
    empty table gives none; a run of n spaces takes n log n steps. Other columns are not read.
    """
    return map_arrow(documents(docs, id_col, text_col), _encode, "doc_id long, ids array<int>", path=model_path or tokenizer_path("piece_bpe_32k.model"))


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coder = model(path)
        texts = [None if x is None else coder.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode_pieces(coded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of ids; null ids give a null text."""
    own = coded.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{ids_col}` as array<int>) as ids")
    return map_arrow(own, _decode, "doc_id long, text string", path=model_path or tokenizer_path("piece_bpe_32k.model"))


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coder, rows = model(path), []
        for text in batch.column(1):
            ids, decimals = coder.encode(text.as_py() or "")
            back = coder.decode(ids)
            rows.append((len(ids), hashlib.sha256(decimals.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding in one pass, so that ids don't travel between processes."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(documents(table(spark, sf_dir, "documents")), _digests, schema, path=tokenizer_path("piece_bpe_32k.model"))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
SQL: dict[str, str] = {}
