"""Binary media columns: PNG images made and read without an image library, and perceptual hashes of their low frequencies."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sheafwork.llm.common import prepare, rows_of, texts_of

SIGNATURE = b"\x89PNG\r\n\x1a\n"
ROW_SAMPLES = 64
#: Side of the image that is transformed, and of the corner of low frequencies that is kept.
HASH_SIDE, HASH_CORNER = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: np.ndarray) -> bytes:
    """An 8-bit greyscale PNG of a two-dimensional array; one filter for all rows, that with the least sum of signed residuals."""
    height, width = samples.shape
    above = np.vstack([np.zeros((1, width), np.uint8), samples[:-1]])
    before = np.hstack([np.zeros((height, 1), np.uint8), samples[:, :-1]])
    tried = [samples, samples - before, samples - above]
    kind = int(np.argmin([np.minimum(x, 0 - x).sum(dtype=np.int64) for x in tried]))
    rows = np.hstack([np.full((height, 1), kind, np.uint8), tried[kind]])
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes the row filters; runs of rows with the same filter at once where rows do not need one another sample by sample."""
    kinds, data = rows[:, 0], rows[:, 1:]
    out = np.empty(data.shape, np.uint8)
    height, width = data.shape
    starts = np.concatenate([[0], np.nonzero(np.diff(kinds))[0] + 1, [height]]) if height else np.array([0])
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        above = out[a - 1] if a else np.zeros(width, np.uint8)
        match int(kinds[a]):
            case 0:
                out[a:b] = data[a:b]
            case 1:
                pixels = data[a:b].reshape(b - a, width // step, step)
                out[a:b] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(b - a, width)
            case 2:
                out[a:b] = np.cumsum(np.vstack([above[None], data[a:b]]), axis=0, dtype=np.uint8)[1:]
            case 3 | 4 as kind:
                for y in range(a, b):
                    up = (out[y - 1] if y else np.zeros(width, np.uint8)).astype(int)
                    line = np.zeros(width + step, int)
                    for x in range(width):
                        left, top, corner = line[x], up[x], up[x - step] if x >= step else 0
                        if kind == 3:
                            guess = (left + top) // 2
                        else:
                            p = left + top - corner
                            guess = min((abs(p - left), 0, left), (abs(p - top), 1, top), (abs(p - corner), 2, corner))[2]
                        line[x + step] = (data[y, x] + guess) & 255
                    out[y] = line[step:]
            case other:
                raise ValueError(f"PNG: unknown filter {other}")
    return out


def decode_png(png: bytes) -> np.ndarray:
    """The samples of a non-interlaced 8-bit PNG, (height, width) or (height, width, channels). Every chunk's checksum is tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("PNG: no signature")
    at, header, data, ended = 8, None, [], False
    while at < len(png) and not ended:
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body, check = png[at + 8 : at + 8 + size], png[at + 8 + size : at + 12 + size]
        if len(check) < 4 or struct.unpack(">I", check)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"PNG: checksum of {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended:
        raise ValueError("PNG: cut short")
    width, height, depth, colour, _, _, interlaced = header
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("PNG: only plain 8-bit samples are read")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if rows.size != height * (width * channels + 1):
        raise ValueError("PNG: wrong number of samples")
    out = _unfilter(rows.reshape(height, width * channels + 1), channels)
    return out if channels == 1 else out.reshape(height, width, channels)


def _cosines(n: int) -> np.ndarray:
    k, x = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_LOW = _cosines(HASH_SIDE)[:HASH_CORNER]


def _to_side(x: np.ndarray, axis: int) -> np.ndarray:
    """Means over HASH_SIDE equal parts of an axis; a shorter axis is repeated instead."""
    n = x.shape[axis]
    cuts = np.arange(HASH_SIDE) * n // HASH_SIDE
    if n < HASH_SIDE:
        return x.take(cuts, axis=axis)
    sums = np.add.reduceat(x, cuts, axis=axis)
    sizes = np.diff(np.append(cuts, n))
    return sums / (sizes[:, None] if axis == 0 else sizes[None, :])


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the lowest 8 x 8 cosine coefficients of a 32 x 32 reduction are over their median."""
    small = _to_side(_to_side(samples.astype(np.float64), 0), 1)
    low = (_LOW @ small @ _LOW.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def to_payload(raw: bytes | None) -> bytes:
    """The bytes and then zeros, up to a positive multiple of a row."""
    raw = raw or b""
    return raw + b"\0" * (-len(raw) % ROW_SAMPLES if raw else ROW_SAMPLES)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a PNG of 64 samples a row. A null text counts as empty and fills one row of zeros."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in rows_of(batches):
            media = [encode_png(np.frombuffer(to_payload(raw), np.uint8).reshape(-1, ROW_SAMPLES)) for raw in raws]
            columns = [pa.array(ids, pa.int64()), pa.array([len(raw or b"") for raw in raws], pa.int64()), pa.array(media, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored PNG of each row of (doc_id, n_bytes, media) back.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes, media_sha256, phash
    (binary) and feature (its hex digits).
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, png in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                samples = decode_png(png)
                payload, bits = samples.tobytes(), cosine_hash(samples)
                tail = zlib.crc32(payload[-ROW_SAMPLES:])
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), tail, len(png), hashlib.sha256(png).hexdigest(), bits, bits.hex()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def media_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as media and reads it back: one row per document, without the binary columns.

    Null and empty texts give one row of 64 zeros. Repeated rows give repeated results, an empty table an empty one, other columns
    are ignored. Equal texts give equal values.
    """
    return media_features(to_media(docs, id_col, text_col)).drop("phash")
