"""Telephony audio columns (operator 8): WAV files of G.711 mu-law and A-law and of IMA ADPCM.

Companded samples are expanded by look-up tables of 256 entries; ADPCM blocks are decoded step by step with
numpy across all blocks of a batch of files. Decoded PCM is resampled by a polyphase filter in integers and stored: as 16-bit
WAV, or packed without loss, with the phases that the filter adds as differences from what it makes of the first.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import documents, fresh_path, map_arrow, table

#: WAV format tags.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
#: The step sizes of IMA ADPCM.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
#: How a 4-bit code moves the step index.
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


#: Samples that are filtered or summed up at a time, and bytes of media (or texts) that a task decodes (or makes) at a time.
BLOCK_SAMPLES, BATCH_BYTES = 1 << 20, 2_000_000


def mu_law_table() -> np.ndarray:
    code = 255 - np.arange(256)
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    code = np.arange(256) ^ 85
    level, mantissa = code >> 4 & 7, code & 15
    size = np.where(level == 0, (mantissa << 4) + 8, (mantissa << 4) + 264 << np.maximum(level, 1) - 1)
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def decode_ima_blocks(blocks: np.ndarray) -> np.ndarray:
    """int16 samples (blocks x samples) of mono IMA ADPCM blocks (blocks x bytes, uint8).

    A block starts with its first sample (16 bits), the step index and a zero byte; codes follow, the low half
    of a byte first. All blocks take each step together.
    """
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.empty((blocks.shape[0], 2 * (blocks.shape[1] - 4)), np.uint8)
    codes[:, ::2], codes[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    out = np.empty((blocks.shape[0], codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    if not len(blocks):
        return out
    for k in range(codes.shape[1]):
        code, step = codes[:, k].astype(np.int32), IMA_STEPS[index]
        move = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        value = np.minimum(np.maximum(value + np.where(code & 8, -move, move), -32768), 32767)
        index = np.minimum(np.maximum(index + IMA_MOVES[code], 0), 88)
        out[:, k + 1] = value
    return out


def wav(data: bytes, tag: int, rate: int = 8000, block: int = 1, bits: int = 8, samples: int | None = None) -> bytes:
    """A mono WAV file around ``data``; ``samples`` goes to the fact chunk of formats other than PCM."""
    extra = struct.pack("<H", 0) if tag in TABLES else struct.pack("<HH", 2, 2 * (block - 4) + 1) if tag == IMA_ADPCM else b""
    per_s = rate * block if tag != IMA_ADPCM else rate * block // (2 * (block - 4) + 1)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_s, block, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if tag != PCM:
        chunks += b"fact" + struct.pack("<II", 4, len(data) if samples is None else samples)
    chunks += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def parse_wav(media: bytes) -> dict:
    """tag, rate, block, samples (or None) and data of a mono WAV file; ValueError for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, out = 12, {"samples": None}
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        body = media[at + 8 : at + 8 + n]
        if len(body) < n:
            raise ValueError("a chunk is cut off")
        if kind == b"fmt " and n >= 16:
            out["tag"], channels, out["rate"], _, out["block"], _ = struct.unpack("<HHIIHH", body[:16])
            if channels != 1:
                raise ValueError("more than one channel")
        elif kind == b"fact" and n >= 4:
            out["samples"] = int.from_bytes(body[:4], "little")
        elif kind == b"data":
            out["data"] = body
        at += 8 + n + n % 2
    if "tag" not in out or "data" not in out:
        raise ValueError("a chunk is missing")
    return out


def to_pcm(files: list[dict]) -> list[np.ndarray]:
    """int16 samples of parsed WAV files; ADPCM blocks of one size are decoded together over all files."""
    out: list = [None] * len(files)
    adpcm: dict[int, list[int]] = {}
    for k, f in enumerate(files):
        raw = np.frombuffer(f["data"], np.uint8)
        if f["tag"] in TABLES:
            out[k] = TABLES[f["tag"]][raw]
        elif f["tag"] == PCM:
            out[k] = raw[: len(raw) // 2 * 2].view("<i2").astype(np.int16)
        elif f["tag"] == IMA_ADPCM and f["block"] > 4:
            adpcm.setdefault(f["block"], []).append(k)
        else:
            raise ValueError(f"format {f['tag']} isn't read")
    for block, own in adpcm.items():
        parts = [np.frombuffer(files[k]["data"], np.uint8) for k in own]
        parts = [p[: len(p) // block * block].reshape(-1, block) for p in parts]
        pcm = decode_ima_blocks(np.concatenate(parts))
        for k, x in zip(own, np.split(pcm, np.cumsum([len(p) for p in parts])[:-1])):
            out[k] = x.reshape(-1)[: files[k]["samples"]]
    return out


@lru_cache(maxsize=8)
def _filter(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed sinc in units of 2 ** -14."""
    n = np.arange(-taps * max(up, down), taps * max(up, down) + 1)
    cut = 1 / max(up, down)
    return np.rint(np.sinc(n * cut) * cut * np.hanning(len(n) + 2)[1:-1] * up * (1 << 14)).astype(np.int32)


def resample(pcm: np.ndarray, rate: int, to: int, taps: int = 8) -> np.ndarray:
    """``pcm`` (int16) at another rate: ceil(samples * to / rate) of them, by a windowed-sinc polyphase filter in 32-bit
    integers, which gives the same on every machine."""
    g = int(np.gcd(rate, to))
    up, down = to // g, rate // g
    if up == down or not len(pcm):
        return pcm
    h = _filter(up, down, taps)
    middle, n = len(h) // 2, -(-len(pcm) * up // down)
    full = np.zeros(len(pcm) * up, np.int16)
    for phase in range(up):  # outputs at phase, phase + up, ...: one short filter each
        first = (middle + phase) % up
        own, skip = h[first::up], (middle + phase - first) // up
        pad = len(own)
        for lo in range(0, len(pcm), BLOCK_SAMPLES):
            size = min(BLOCK_SAMPLES, len(pcm) - lo)
            x = np.zeros(size + 2 * pad, np.int32)
            a, b = max(lo - pad, 0), min(lo + size + pad, len(pcm))
            x[a - lo + pad : b - lo + pad] = pcm[a:b]
            total = np.full(size, 1 << 13, np.int32)
            for k in np.flatnonzero(own).tolist():
                at = pad + skip - k
                total += own[k] * x[at : at + size]
            full[phase + lo * up : phase + (lo + size) * up : up] = np.clip(total >> 14, -32768, 32767)
    return full[::down][:n]


def to_planes(pcm: np.ndarray) -> bytes:
    """Samples (int16) as the low bytes of all, then the high bytes of all."""
    return pcm.astype("<i2").view(np.uint8).reshape(-1, 2).T.tobytes()


def from_planes(stored: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(stored, np.uint8).reshape(2, -1).T).view("<i2").reshape(-1)


def describe(pcm: np.ndarray) -> str:
    """Loudness, peak, zero crossings and roughness, as whole numbers; block by block, each with the sample before it."""
    n = len(pcm)
    power = crossings = rough = peak = 0
    for lo in range(0, n, BLOCK_SAMPLES):
        x = pcm[max(lo - 1, 0) : lo + BLOCK_SAMPLES].astype(np.int64)
        own = x[1:] if lo else x
        power += int((own * own).sum())
        peak = max(peak, int(np.abs(own).max()))
        crossings += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        rough += int(np.abs(np.diff(x)).sum())
    return f"n={n};rms={math.isqrt(power // max(1, n))};peak={peak};zc={crossings};rough={rough // max(1, n - 1)}"


#: Payload bytes of an ADPCM block of text_media(): half of the unit by which texts are filled up.
_BLOCK = 288


def as_media(payload: bytes) -> bytes:
    """A WAV file whose samples are the payload's bytes, in one of the three formats by turns of the payload's CRC: mu-law codes, A-law codes, or
    the codes of ADPCM blocks that start from 0."""
    tag = (MU_LAW, A_LAW, IMA_ADPCM)[zlib.crc32(payload) % 3]
    if tag == IMA_ADPCM:
        blocks = np.zeros((len(payload) // _BLOCK, 4 + _BLOCK), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, _BLOCK)
        return wav(blocks.tobytes(), IMA_ADPCM, block=4 + _BLOCK, bits=4, samples=len(blocks) * (2 * _BLOCK + 1))
    return wav(payload, tag)


def payload_of(parsed: dict) -> bytes:
    """The codes of a parsed file: of ADPCM those of the blocks without their heads."""
    if parsed["tag"] != IMA_ADPCM:
        return parsed["data"]
    raw, block = np.frombuffer(parsed["data"], np.uint8), parsed["block"]
    return raw[: len(raw) // block * block].reshape(-1, block)[:, 4:].tobytes()


def _encode(batches: Iterator[pa.RecordBatch], unit: int) -> Iterator[pa.RecordBatch]:
    def made(rows: list[tuple]) -> pa.RecordBatch:
        ids, sizes, media = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    for batch in batches:
        rows, size = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = (text.as_py() or "").encode()
            rows.append((doc_id, len(raw), as_media(raw.ljust(max(1, -(-len(raw) // unit)) * unit, b"\xff"))))
            size += len(rows[-1][2])
            if size >= BATCH_BYTES:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)


def text_media(docs: DataFrame, unit: int = 576, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes as the codes of a WAV file in one of the three formats.

    Bytes 255 fill up to a positive multiple of ``unit`` (a multiple of 288). A null text counts as empty (one unit of
    filling); a null id stays; repeated rows give repeated rows, equal texts equal files; an empty table none. Other
    columns are not read.
    """
    return map_arrow(documents(docs, id_col, text_col), _encode, "doc_id long, n_bytes long, media binary", unit=unit)


def _parsed(media: bytes | None) -> tuple[dict | None, str | None]:
    """A parsed file, or the reason why there is none."""
    if media is None:
        return None, "no media"
    try:
        out = parse_wav(media)
        to_pcm([out | {"data": b""}])  # is the format one that is read?
        return out, None
    except ValueError as e:
        return None, str(e)


def _spans(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of BATCH_BYTES together, or of one row that is larger."""
    first = total = 0
    for k, n in enumerate(sizes):
        if k > first and total + n > BATCH_BYTES:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def _decode(batches: Iterator[pa.RecordBatch], rate: int, planes: bool) -> Iterator[pa.RecordBatch]:
    """Columns of DECODED for the last column (media), after the others of a batch as they are."""
    names = [x.split()[0] for x in DECODED.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        for lo, hi in _spans([len(x.as_buffer()) if x.is_valid else 0 for x in column]):
            part = batch.slice(lo, hi - lo)
            media = part.column(part.num_columns - 1).to_pylist()
            parsed, errors = zip(*map(_parsed, media))
            good = [k for k, p in enumerate(parsed) if p]
            pcm = dict(zip(good, to_pcm([parsed[k] for k in good])))
            rows = []
            for k, (p, m) in enumerate(zip(parsed, media)):
                if p is None:
                    rows.append((None,) * 6 + (None if m is None else len(m), None, None, errors[k]))
                    continue
                n, x, data = len(pcm[k]), resample(pcm.pop(k), p["rate"], rate), payload_of(p)
                out = to_planes(x) if planes else wav(x.astype("<i2").tobytes(), PCM, rate, 2, 16)
                feature = None if planes else describe(x)  # planes are read back for it
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), n, out, feature, len(m), hashlib.sha256(m).hexdigest(), rate, None))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            rest = part.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *cols], [*rest, *names])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The feature of stored planes (the first column), with the others as they are."""
    for batch in batches:
        features = [None if x is None else describe(from_planes(x)) for x in (v.as_py() for v in batch.column(0))]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(features, pa.string())], [*batch.schema.names[1:], "feature"])


DECODED = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, n_samples long, pcm binary, feature string, "
    "media_bytes long, media_sha256 string, rate long, error string"
)


def decode_media(media: DataFrame, rate: int = 16_000, id_col: str = "doc_id", media_col: str = "media", planes: bool = False) -> DataFrame:
    """PCM at ``rate`` (as 16-bit WAV with its feature, or by to_planes() without), digests and a feature string of each WAV file in ``media_col``.

    mu-law, A-law, IMA ADPCM and 16-bit PCM files with one channel are read. Null or unreadable media give null
    results and the reason in ``error``; null ids stay; repeated rows give repeated rows; an empty table none; a task decodes some
    2 MB of media at a time, or one longer file.
    """
    own = media.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{media_col}` as binary) as media")
    return map_arrow(own, _decode, f"doc_id long, {DECODED}", rate=rate, planes=planes)


def write_dense(df: DataFrame, label: str) -> DataFrame:
    """As stored(), with a higher compression level and longer pages: audio is large."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "12").option("parquet.page.size", str(8 << 20)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_text_audio(docs: DataFrame, rate: int = 16_000, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media of texts are stored and read back, their PCM at ``rate`` is stored (to_planes()) with all digests and read back in turn for its
    feature: the columns doc_id, n_bytes and those of DECODED (of ``keep`` alone, if given). Nulls and repeated rows as in text_media()."""
    media = write_dense(text_media(docs, id_col=id_col, text_col=text_col), "media")
    audio = map_arrow(media, _decode, f"doc_id long, n_bytes long, {DECODED}", rate=rate, planes=True)
    digests = ["payload_sha256", "media_sha256"]
    audio = write_dense(audio.drop("feature").withColumns({c: F.unhex(c) for c in digests}), "audio")
    audio = audio.withColumns({c: F.lower(F.hex(c)) for c in digests})
    rest = audio.select(*[c for c in audio.columns if keep is None or c in keep])
    own = audio.select(F.col("pcm").alias("planes"), *rest.columns)
    return map_arrow(own, _described, rest.schema.add("feature", "string"))


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return store_text_audio(table(spark, sf_dir, "documents"), keep=keep).select(*keep, "feature")


QUERIES = {"op8_telephony_audio": op8_telephony_audio}
SQL: dict[str, str] = {}
