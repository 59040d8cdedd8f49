"""Token-id files with a shared zstandard dictionary (operator 4).

A data set is a folder: ``dictionary.zdict`` and files of documents in ascending id order. A file holds

    magic "QMT1" | id width (1 byte) | SHA-256 of the dictionary (32 bytes)
    one zstandard frame per document
    index: frame offsets (n + 1 x u64), ids (n x i64), id is null (n x u8), token counts (n x u32)
    footer: place of the index (u64), n (u64)

so that one document is read by its index entry and one small frame.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import documents, fresh_path, table, tokenizer_path
from quarrymill.llm.wordbpe import encoder

MAGIC, FOOTER = b"QMT1", struct.Struct("<QQ")


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


def serialize(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(samples: list[bytes], size: int = 32_768) -> bytes:
    """A dictionary of ``size`` bytes; with too few samples to train one, an empty (raw) one."""
    usable = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, usable).as_bytes() if len(usable) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _zdict(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


class FileWriter:
    """Builds one file; add() documents in order, then close()."""

    def __init__(self, uri: str, dictionary: bytes, width: int, level: int = 3):
        system, path = _open(uri)
        self.out, self.width = system.open_output_stream(path), width
        self.at = self.out.write(MAGIC + bytes([width]) + hashlib.sha256(dictionary).digest())
        shared = _zdict(dictionary)
        if shared is not None:
            shared.precompute_compress(level=level)
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True)
        self.offsets, self.ids, self.counts = [self.at], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.at += self.out.write(self.pack.compress(serialize(ids, self.width)))
        self.offsets.append(self.at)
        self.ids.append(doc_id)
        self.counts.append(len(ids))

    def close(self) -> int:
        index = np.array(self.offsets, "<u8").tobytes() + np.array([i or 0 for i in self.ids], "<i8").tobytes()
        index += np.array([i is None for i in self.ids], "u1").tobytes() + np.array(self.counts, "<u4").tobytes()
        self.out.write(index + FOOTER.pack(self.at, len(self.ids)))
        self.out.close()
        return self.at + len(index) + FOOTER.size


class FileReader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str, dictionary: bytes):
        system, path = _open(uri)
        self.file = system.open_input_file(path)
        head = self.file.read_at(37, 0)
        if head[:4] != MAGIC or head[5:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not such a file, or written with another dictionary")
        size = self.file.size()
        at, n = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        raw = io.BytesIO(self.file.read_at(size - FOOTER.size - at, at))
        self.offsets = np.frombuffer(raw.read(8 * (n + 1)), "<u8").tolist()
        ids, null = np.frombuffer(raw.read(8 * n), "<i8").tolist(), raw.read(n)
        self.ids = [None if x else i for i, x in zip(ids, null)]
        self.counts = np.frombuffer(raw.read(4 * n), "<u4").tolist()
        self.width = head[4]
        self.unpack = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document: one read of its frame alone."""
        a, b = self.offsets[k], self.offsets[k + 1]
        ids = np.frombuffer(self.unpack.decompress(self.file.read_at(b - a, a)), f"<u{self.width}")
        if len(ids) != self.counts[k]:
            raise ValueError("a frame doesn't hold as many ids as the index says")
        return ids

    def close(self) -> None:
        self.file.close()


def _read_bytes(uri: str) -> bytes:
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        return f.read()


def _write_partition(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, dictionary: bytes, width: int, end_id: int, docs_per_file: int) -> Iterator[pa.RecordBatch]:
    part, seq, out, rows, end = TaskContext.get().partitionId(), 0, None, [], np.array([end_id], "<u4").tobytes()

    def done():
        out.close()
        rows.append((part, seq, name, len(out.ids), sum(out.counts)))

    for batch in batches:
        encode = encoder(tokenizer).encode
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if out is None:  # a name of its own for each attempt: the manifest lists those of the one that succeeded
                name = f"{part:07d}-{seq:05d}-{uuid.uuid4().hex}.qmt"
                out = FileWriter(f"{folder}/{name}", dictionary, width)
            out.add(doc_id, np.frombuffer(encode([text.as_py()])[0] + end, "<u4"))
            if len(out.ids) >= docs_per_file:
                done()
                out, seq = None, seq + 1
    if out is not None:
        done()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["part", "seq", "name", "n_docs", "n_tokens"])


def _sample(docs: DataFrame, tokenizer: str, width: int, end_id: int, rows: int) -> list[bytes]:
    """Serialized ids of ``rows`` distinct documents with the smallest hashes of id and text."""
    h = F.xxhash64("doc_id", "text")
    chosen = [r[0] for r in docs.select(h.alias("h")).distinct().orderBy("h").limit(rows).collect()]
    texts = [r[0] for r in docs.where(h.isin(chosen)).select("text").distinct().orderBy("text").collect()] if chosen else []
    end = np.array([end_id], "<u4").tobytes()
    return [serialize(np.frombuffer(x + end, "<u4"), width) for x in encoder(tokenizer).encode(texts)]


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    end_id: int = 1,
    docs_per_file: int = 16_384,
    dictionary_rows: int = 400,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all documents' ids to ``folder`` and return the manifest (name, n_docs, n_tokens, base):
    base counts the ids of all files before.

    The dictionary is trained on ``dictionary_rows`` documents; every document is written. Documents
    are dealt out by ranges of their id; equal ids are ordered by text, null ids come first. A null text counts as
    empty. An empty table gives an empty manifest. Columns besides id and text are not read.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    own = documents(docs, id_col, text_col)
    width = 2 if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(_sample(own, tokenizer, width, end_id, dictionary_rows))
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/dictionary.zdict") as f:
        f.write(dictionary)
    run = partial(_write_partition, folder=folder, tokenizer=tokenizer, dictionary=dictionary, width=width, end_id=end_id, docs_per_file=docs_per_file)
    schema = "part long, seq long, name string, n_docs long, n_tokens long"
    own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = spark.read.schema(schema).parquet(f"{folder}/manifest")
    return files.select("name", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))


def _read_files(batches: Iterator[pa.RecordBatch], folder: str, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        dictionary = _read_bytes(f"{folder}/dictionary.zdict")
        for row in batch.to_pylist():
            file, start, out = FileReader(f"{folder}/{row['name']}", dictionary), row["base"], []
            for k in range(len(file)):
                ids = file.document(k).astype("<u4")
                out.append((file.ids[k], start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
                if len(out) == rows or k + 1 == len(file):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
                    out = []
            file.close()


def read_token_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files, a task for each
    few of them."""
    spread = manifest.repartition(max(1, min(manifest.count(), 20_000)))
    return spread.mapInArrow(partial(_read_files, folder=folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    return read_token_digests(write_token_files(table(spark, sf_dir, "documents"), folder), folder)


QUERIES = {"op4_token_files": op4_token_files}
SQL: dict[str, str] = {}
