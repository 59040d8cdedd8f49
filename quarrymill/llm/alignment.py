"""Alignment of two tokenizers' tokens over the same bytes (operator 13).

Tokenizer A is a byte-level BPE of the ``tokenizers`` library, B a SentencePiece BPE with byte fallback. In batches of whole documents the
tokens of both sides become tables of (doc, start, end, id); ``pandas.merge_asof``, keyed by document, gives each token's start the token
of the other side that covers it. Both directions together are all overlaps, and offsets at which tokens of both sides end cut
the tokens into groups.

Text is cut into chunks before a space that follows a character that is no white space: no token of either side spans such a place. A worker
encodes the chunks that it has not met before and keeps short ones in a bounded memo.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import documents, map_arrow, stored, table, tokenizer_path

SPACE = "▁"
#: Fixed value: how byte-level BPE cuts a text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The most pairs of ids that are broadcast, at some 80 bytes each; with more they are joined by shuffle.
BROADCAST_PAIRS = 2_000_000
_CUT = re.compile(r"(?<=\S) ")
_UNSAFE = re.compile(r"\s ")


def _byte_alphabet() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte: printable bytes stand for themselves, the others, in
    order, for the characters from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TokenizerA:
    """The byte-level BPE of a ``tokenizers`` file. Its vocabulary is run by tiktoken, which gives the same ids in a quarter of the time: the
    ids of merges lie in the order of the merges."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, special = _byte_alphabet(), {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.size = max(spec["model"]["vocab"].values()) + 1
        self.bytes = [b""] * self.size
        for b, i in ranks.items():
            self.bytes[i] = b
        self.core = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, chunk: str) -> list[int]:
        return self.core.encode_ordinary(chunk)


class TokenizerB:
    """A SentencePiece model; it puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.core = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.bytes, self.space = sp.get_piece_size(), [], [sp.piece_to_id(SPACE)]
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace(SPACE, " ").encode())

    def encode(self, chunk: str) -> list[int]:
        return self.core.encode(chunk[1:]) if len(chunk) > 1 else self.space


class Side:
    """Ids of chunks, one after the other, with their byte lengths."""

    def __init__(self, tokenizer):
        self.tokenizer, self.size = tokenizer, tokenizer.size
        self.lengths = np.array([len(b) for b in tokenizer.bytes], np.int32)
        self.clear()

    def clear(self) -> None:
        self.parts, self.counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]

    def frozen(self) -> None:
        """Arrays of what has been learnt."""
        self.parts, self.counts = [np.concatenate(self.parts)], [np.concatenate(self.counts)]
        self.flat, self.count = self.parts[0], self.counts[0]
        self.first = np.cumsum(self.count) - self.count

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks ``codes`` and how many each has."""
        counts = self.count[codes]
        ends = np.cumsum(counts)
        at = np.repeat(self.first[codes] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at], counts


class Aligner:
    """Both tokenizers over batches of texts. ``entries`` and ``most_chars`` bound the memo; chunks of more than ``longest`` characters are not kept."""

    def __init__(self, path_a: str, path_b: str, entries: int = 600_000, most_chars: int = 8_000_000, longest: int = 64, joined: int = 2000):
        self.a, self.b = Side(TokenizerA(path_a)), Side(TokenizerB(path_b))
        self.entries, self.most_chars, self.longest, self.joined = entries, most_chars, longest, joined
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.sound: list[bool] = []
        self.long: list[str] = []
        self.chars = self.dropped = 0
        self.a.clear()
        self.b.clear()

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks of a space and ``text``."""
        if _UNSAFE.search(text) is None and text[:1] != " ":
            return [" " + p for p in text.split(" ")]
        whole = " " + text
        cuts = [0, *[m.start() for m in _CUT.finditer(whole)], len(whole)]
        return [whole[i:j] for i, j in zip(cuts, cuts[1:])]

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks that aren't known yet: many as one text where that is cut at the same places again, the rest one by one."""
        closed = [c for c in chunks if not c[-1].isspace()]
        apart = [c for c in chunks if c[-1].isspace()]
        for i in range(0, len(closed), self.joined):
            part = closed[i : i + self.joined]
            if not self._learn_joined(part):
                apart += part
        for chunk in apart:
            ids = [np.array(side.tokenizer.encode(chunk), np.int32) for side in (self.a, self.b)]
            self._keep([chunk], ids, [[len(x)] for x in ids], [self._bytes(ids) == [chunk.encode()] * 2])

    def _bytes(self, ids: list[np.ndarray]) -> list[bytes]:
        return [b"".join(map(side.tokenizer.bytes.__getitem__, x.tolist())) for side, x in zip((self.a, self.b), ids)]

    def _learn_joined(self, part: list[str]) -> bool:
        text = "".join(part)
        ids = [np.array(side.tokenizer.encode(text), np.int32) for side in (self.a, self.b)]
        if self._bytes(ids) != [text.encode()] * 2:
            return False
        cuts, counts = np.cumsum([len(c.encode()) for c in part]), []
        for side, x in zip((self.a, self.b), ids):
            ends = np.cumsum(side.lengths[x])
            at = np.searchsorted(ends, cuts)
            if (ends[at] != cuts).any():
                return False
            counts.append(np.diff(at, prepend=-1))
        self._keep(part, ids, counts, [True] * len(part))
        return True

    def _keep(self, chunks: list[str], ids: list[np.ndarray], counts: list, sound: list[bool]) -> None:
        for side, x, c in zip((self.a, self.b), ids, counts):
            side.parts.append(x)
            side.counts.append(np.asarray(c, np.int64))
        for chunk in chunks:
            self.codes[chunk] = len(self.codes) + self.dropped
            self.chars += len(chunk)
            if len(chunk) > self.longest:
                self.long.append(chunk)
        self.sound += sound

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all chunks of the texts, and the number of the text of each."""
        if len(self.sound) > self.entries or self.chars > self.most_chars:
            self.clear()
        own = [self.chunks(t) for t in texts]
        flat = [c for x in own for c in x]
        known = self.codes
        self.learn(list(set(flat).difference(known)))
        codes = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        for c in self.long:
            del known[c]  # its ids stay until the memo is cleared
        self.dropped += len(self.long)
        self.long.clear()
        self.a.frozen()
        self.b.frozen()
        return codes, np.repeat(np.arange(len(own)), [len(x) for x in own])

    def align(self, texts: list[str]) -> dict:
        """For texts that are not empty: sound (both sides give back the bytes), n_a, n_b, n_groups, n_links of each, the groups as one string
        of each, and doc, a, b (ids) of all links."""
        n = len(texts)
        codes, of = self.coded(texts)
        sound = np.ones(n, bool)
        sound[of[~np.array(self.sound, bool)[codes]]] = False
        codes, of = codes[sound[of]], of[sound[of]]
        sides = []
        for side in (self.a, self.b):
            ids, counts = side.gather(codes)
            end = np.cumsum(side.lengths[ids], dtype=np.int64)
            sides.append(pd.DataFrame({"doc": np.repeat(of, counts), "start": end - side.lengths[ids], "end": end, "id": ids}))
        a, b = sides
        a_of = pd.merge_asof(b[["start", "doc"]], a[["start", "doc"]].assign(token=np.arange(len(a))), on="start", by="doc")["token"].to_numpy()
        b_of = pd.merge_asof(a[["start", "doc"]], b[["start", "doc"]].assign(token=np.arange(len(b))), on="start", by="doc")["token"].to_numpy()
        inner = a["start"].to_numpy()[a_of] != b["start"].to_numpy()  # else the other direction has found the pair already
        link_a, link_b = np.concatenate([np.arange(len(a)), a_of[inner]]), np.concatenate([b_of, np.flatnonzero(inner)])
        a_end, b_end = a["end"].to_numpy(), b["end"].to_numpy()
        cut_b = np.searchsorted(b_end, a_end)
        cut_a = np.flatnonzero(b_end[cut_b] == a_end)  # the last ends are equal, as the sides have the same bytes
        cut_b = cut_b[cut_a]
        group_doc = a["doc"].to_numpy()[cut_a]
        per = lambda docs: np.bincount(docs, minlength=n).astype(np.int64)
        doc = a["doc"].to_numpy()[link_a]
        groups = self._groups(a["id"].to_numpy(), b["id"].to_numpy(), cut_a, cut_b, per(group_doc))
        return {
            "sound": sound, "n_a": per(a["doc"].to_numpy()), "n_b": per(b["doc"].to_numpy()), "n_groups": per(group_doc), "n_links": per(doc),
            "groups": groups, "doc": doc, "a": a["id"].to_numpy()[link_a], "b": b["id"].to_numpy()[link_b],
        }

    @staticmethod
    def _groups(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, per_doc: np.ndarray) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` of each document."""

        def joined(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
            offsets = pa.array(np.concatenate([[0], cuts + 1]), pa.int64())
            return pc.binary_join(pa.LargeListArray.from_arrays(offsets, pc.cast(pa.array(ids), pa.string())), ",")

        both = pc.binary_join_element_wise(joined(a, cut_a), joined(b, cut_b), "|")
        offsets = pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int64())
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, both), ";")


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>, of_batch boolean"
_KINDS = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


class _Document:
    """What the segments of one long document give."""

    def __init__(self):
        self.sound, self.sums, self.hash, self.first, self.pairs = True, np.zeros(4, np.int64), hashlib.sha256(), True, []

    def add(self, got: dict, code: int) -> None:
        self.sound &= bool(got["sound"][0])
        self.sums += [int(got[k][0]) for k in ("n_a", "n_b", "n_groups", "n_links")]
        if self.sound:
            self.hash.update(b"" if self.first else b";")
            self.hash.update(got["groups"][0].as_py().encode())
        self.first = False
        self.pairs.append(np.unique(got["a"].astype(np.int64) * code + got["b"], return_counts=True))


def _segments(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters of a long text, cut before spaces where chunks are cut; the space itself is left out, as encoding
    puts one before each part. A text without such a space is one part."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def _align_batches(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, chars: int) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        tool = aligner(path_a, path_b)
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        part, size = [], 0
        for k, doc_id in enumerate(ids):
            text = texts[k].as_py()
            if part and size + len(text or "") > chars:
                yield _aligned(tool, part, row)
                row, part, size = row + len(part), [], 0
            if text and len(text) > chars:
                yield _aligned_long(tool, doc_id, text, row, chars)
                row += 1
                continue
            part.append((doc_id, text))
            size += len(text or "")
        if part:
            yield _aligned(tool, part, row)
            row += len(part)


def _with_batch_row(cols: list[pa.Array], codes: np.ndarray) -> pa.RecordBatch:
    """The rows of documents, and one with each pair of the batch and the number of its documents."""
    pairs, docs = np.unique(codes, return_counts=True)
    none = pa.nulls(1, pa.int64())
    extra = [none] * 6 + [pa.nulls(1, pa.string()), _lists(pairs, np.array([len(pairs)]), pa.int64()), _lists(docs, np.array([len(docs)]), pa.int32()), pa.array([True])]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([c.cast(t), e.cast(t)]) for c, e, t in zip(cols, extra, _KINDS)], _NAMES)


def _aligned(tool: Aligner, part: list[tuple], row: int) -> pa.RecordBatch:
    texts = [t for _, t in part if t]
    where = np.array([k for k, (_, t) in enumerate(part) if t], np.int64)
    n, pair = len(part), tool.b.size
    sums, counts = np.zeros((4, n), np.int64), np.zeros(n, np.int64)
    digests = np.full(n, "", object)
    codes = times = np.empty(0, np.int64)
    if texts:
        got = tool.align(texts)
        for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links")):
            sums[k, where] = got[name]
        digests[where] = [hashlib.sha256(g.as_py().encode()).hexdigest() if ok else "" for g, ok in zip(got["groups"], got["sound"])]
        span = tool.a.size * pair
        keys, times = np.unique(got["doc"] * span + got["a"].astype(np.int64) * pair + got["b"], return_counts=True)
        codes = keys % span
        counts[where] = np.bincount(keys // span, minlength=len(texts))
    cols = [pa.array(range(row, row + n), pa.int64()), pa.array([i for i, _ in part], pa.int64()), *[pa.array(s) for s in sums], pa.array(digests, pa.string())]
    cols += [_lists(codes, counts, pa.int64()), _lists(times, counts, pa.int32()), pa.array([False] * n)]
    return _with_batch_row(cols, codes)


def _aligned_long(tool: Aligner, doc_id: int | None, text: str, row: int, chars: int) -> pa.RecordBatch:
    own, pair = _Document(), tool.b.size
    for segment in _segments(text, chars):
        own.add(tool.align([segment]), pair)
        if not own.sound:
            break
    if own.sound:
        every, counts = np.concatenate([p for p, _ in own.pairs]), np.concatenate([c for _, c in own.pairs])
        codes, at = np.unique(every, return_inverse=True)
        times, sums, digest = np.bincount(at, counts, len(codes)).astype(np.int64), own.sums, own.hash.hexdigest()
    else:
        codes = times = np.empty(0, np.int64)
        sums, digest = np.zeros(4, np.int64), ""
    cols = [pa.array([row]), pa.array([doc_id], pa.int64()), *[pa.array([int(s)]) for s in sums], pa.array([digest])]
    cols += [_lists(codes, np.array([len(codes)]), pa.int64()), _lists(times, np.array([len(codes)]), pa.int32()), pa.array([False])]
    return _with_batch_row(cols, codes)


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chars: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored rows of documents (and one of each batch, with ``of_batch``): counts of tokens, groups and links, the SHA-256 of the groups, and the
    distinct pairs of linked ids as a * size of vocabulary B + b, with how many links have them.

    Null and empty texts, and texts whose tokens don't join to their bytes (such with U+2581), have no tokens. A task holds ``chars`` characters of text at a
    time; a longer text is taken in segments. Null ids stay null; repeated rows are documents each; an empty table gives no rows; other
    columns are not read.
    """
    args = dict(path_a=path_a or tokenizer_path("byte_bpe_50k.json"), path_b=path_b or tokenizer_path("piece_bpe_32k.model"), chars=chars)
    return stored(map_arrow(documents(docs, id_col, text_col), _align_batches, SCHEMA, **args), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best (no other pair of its A id has more). Batches have counted their own documents before the
    shuffle. Stored: its size is bounded by what two vocabularies can pair."""
    own = aligned.where("of_batch").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    return stored(own.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count")), "pair-counts")


def with_best(counts: DataFrame, size_b: int) -> DataFrame:
    a = (F.col("pair") / size_b).cast("long")
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("highest"))
    return counts.withColumn("a", a).join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def alignment_statistics(aligned: DataFrame, counts: DataFrame, size_b: int, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its A id), count_sum (of all links) and groups_sha256.

    Pairs that one document alone holds are told from others by their absence: they count 1. The rest is broadcast up to a stated number of rows.
    """
    own = aligned.where("not of_batch")
    rated = stored(with_best(counts, size_b).where("count > 1 or best"), "rated-pairs")
    rated = F.broadcast(rated) if rated.count() <= broadcast_pairs else rated
    each = own.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    met = each.join(rated, "pair", "left")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.coalesce("count", F.lit(1))).alias("count_sum"))
    out = own.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def piece_count(path_b: str | None = None) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b or tokenizer_path("piece_bpe_32k.model")).get_piece_size()


def align_tokenizers(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, **options) -> DataFrame:
    """align_documents() with the statistics of its pairs over all documents; see alignment_statistics()."""
    broadcast_pairs = options.pop("broadcast_pairs", BROADCAST_PAIRS)
    aligned = align_documents(docs, path_a, path_b, **options)
    return alignment_statistics(aligned, pair_counts(aligned), piece_count(path_b), broadcast_pairs)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))


QUERIES = {"op13_tokenizer_alignment": op13_tokenizer_alignment}
SQL: dict[str, str] = {}
