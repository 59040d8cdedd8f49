"""Cost-balanced packing of documents into training sequences (operator 2).

A sequence costs ``linear * length + quadratic * length ** 2`` summed over its pieces, as attention
doesn't cross pieces. Documents go, in descending order of cost, to the lowest-cost sequence that has
token capacity left for them; what fits nowhere whole is cut. A task packs window after window into full sequences and
carries the shortest documents, for which there is no full one, to the next window. The sequences of its last window have
exactly the window's tokens as their joint capacity (full ones, and for the rest powers of two), so that none needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import documents, map_arrow, table, tokenizer_path
from quarrymill.llm.wordbpe import encoder

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, sequence_cost double"
)


def capacities(tokens: int, limit: int) -> list[int]:
    """Full sequences, then one for each binary digit of what is left."""
    rest = tokens % limit
    return [limit] * (tokens // limit) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], limit: int, linear: float, quadratic: float, last: bool = True) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """(document, start, length, sequence) of each piece, in the order in which a sequence takes them; then (document, start) of
    what is left for the next window: the shortest documents, less than a sequence of them. The last window leaves none."""
    whole, rest = [], []
    for i, n in enumerate(lengths):
        whole += [(i, at, limit) for at in range(0, n - limit + 1, limit)]
        if n % limit:
            rest.append((i, n - n % limit, n % limit))
    out, left = [(i, at, n, k) for k, (i, at, n) in enumerate(whole)], []
    total = sum(n for *_, n in rest)
    room = np.array(capacities(total, limit) if last else [limit] * (total // limit), np.int64)
    cost = np.zeros(len(room))
    for i, at, n in sorted(rest, key=lambda x: -x[2]):
        while n:
            if not room.any():
                left.append((i, at))
                break
            fits = room >= n
            k = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            take = min(n, int(room[k]))
            out.append((i, at, take, len(whole) + k))
            room[k] -= take
            cost[k] += linear * take + quadratic * take * take
            at, n = at + take, n - take
    return out, left


def _window(docs: list[tuple], first: int, limit: int, linear: float, quadratic: float, last: bool) -> tuple[pa.RecordBatch, int, list[tuple]]:
    """The pieces of (id, ids of its tokens, start of what isn't packed yet), how many sequences they fill, and what is left."""
    pieces, left = pack([len(x) - at for _, x, at in docs], limit, linear, quadratic, last)
    count = max((k for *_, k in pieces), default=-1) + 1
    used, cost, rows = [0] * count, [0.0] * count, []
    for i, at, n, k in pieces:
        doc_id, x, before = docs[i]
        at += before
        rows.append((doc_id, at, n, zlib.crc32(x[at : at + n].tobytes()), len(x), first + k, used[k]))
        used[k] += n
        cost[k] += linear * n + quadratic * n * n
    cols = list(zip(*rows)) or [()] * 7
    arrays = [pa.array(c, pa.int64()) for c in cols]
    arrays += [pa.array([used[k] for *_, k in pieces], pa.int64()), pa.array([cost[k] for *_, k in pieces], pa.float64())]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCHEMA.split(", ")]), count, [(docs[i][0], docs[i][1], docs[i][2] + at) for i, at in left]


def _pack_partition(batches: Iterator[pa.RecordBatch], path: str, limit: int, window: int, end_id: int, linear: float, quadratic: float) -> Iterator[pa.RecordBatch]:
    docs, tokens = [], 0
    first = TaskContext.get().partitionId() << 40
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        encode = encoder(path).encode
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            docs.append((doc_id, np.frombuffer(encode([text.as_py()])[0] + end, "<u4"), 0))
            tokens += len(docs[-1][1])
            if tokens >= window:
                out, used, docs = _window(docs, first, limit, linear, quadratic, False)
                yield out
                tokens, first = sum(len(x) - at for _, x, at in docs), first + used
    if docs:
        yield _window(docs, first, limit, linear, quadratic, True)[0]


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    limit: int = 2048,
    end_id: int = 1,
    window_tokens: int = 2_000_000,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents with their place in a sequence of at most ``limit`` tokens.

    Each task packs its input, ``window_tokens`` at a time (the bound of its memory besides one
    document), without a shuffle. A null text counts as an empty one and gives the end id alone; a null id
    stays null; repeated rows are packed as often as they occur; an empty table gives no rows. Columns
    besides id and text are not read. ``sequence_id`` is unique over all tasks.
    """
    args = dict(path=tokenizer or tokenizer_path("word_bpe_49k.json"), limit=limit, window=window_tokens, end_id=end_id, linear=linear, quadratic=quadratic)
    return map_arrow(documents(docs, id_col, text_col), _pack_partition, SCHEMA, **args)


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: its pieces in order, its tokens, padding and cost."""
    power = F.col("tokens") == F.expr("shiftleft(1L, cast(floor(log2(tokens)) as int))")
    return (
        pieces.groupBy("sequence_id")
        .agg(
            F.sum("length").alias("tokens"),
            F.max("sequence_cost").alias("cost"),
            F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length"))).alias("pieces"),
        )
        .withColumn("padding", F.when(power, F.lit(0)).otherwise(2048 - F.col("tokens")).cast("long"))
    )


QUERIES = {"op2_cost_balanced_packing": op2_cost_balanced_packing}
SQL: dict[str, str] = {}
