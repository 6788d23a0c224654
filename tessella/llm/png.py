"""Media columns: PNG images in binary columns, written and read chunk by chunk, with perceptual hashes.

`encode_png` stores bytes as 8-bit grey samples, `decode_png` walks the chunks, tests every checksum, inflates and undoes
the line filters with numpy, and `cosine_hash` takes the signs of low-frequency cosine coefficients of the image.

Defined results: a null text counts as empty; the payload is the text's UTF-8 padded with zero bytes to a positive
multiple of 64; equal texts give equal values; repeated rows give repeated rows; an empty table gives an empty result.
Damaged images, whatever the damage, raise ValueError in `decode_png`; `media_features` gives null payloads, digests and
features for them, and for null images all but the size beside them is null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import table, text_or_empty, unused

#: The PNG signature, and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
WIDTH = 64


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, level: int = 2) -> bytes:
    """An 8-bit grey PNG of a (rows, width) array. The filter of all lines is the one with the least sum of absolute differences."""
    rows, width = samples.shape
    sub = samples.copy()
    sub[:, 1:] -= samples[:, :-1]
    up = samples.copy()
    up[1:] -= samples[:-1]
    cost = [int(np.abs(x.view(np.int8)).astype(np.int64).sum()) for x in (samples, sub, up)]
    best = int(np.argmin(cost))
    lines = np.empty((rows, width + 1), dtype=np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = (samples, sub, up)[best]
    head = struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    """Undoes the filters; runs of lines with one filter go together where the filter allows it."""
    out = np.zeros_like(lines)
    rows, stride = lines.shape
    edges = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])).tolist() + [rows]
    for a, b in zip(edges, edges[1:], strict=False):
        kind, part = int(kinds[a]), lines[a:b]
        above = out[a - 1] if a else np.zeros(stride, np.uint8)
        if kind == 0:
            out[a:b] = part
        elif kind == 1:
            for c in range(bpp):
                np.add.accumulate(part[:, c::bpp], axis=1, dtype=np.uint8, out=out[a:b, c::bpp])
        elif kind == 2:
            np.add.accumulate(np.vstack([above[None], part]), axis=0, dtype=np.uint8, out=(whole := np.empty((b - a + 1, stride), np.uint8)))
            out[a:b] = whole[1:]
        elif kind in (3, 4):
            for r in range(a, b):
                line, row, up = lines[r], out[r], (out[r - 1] if r else np.zeros(stride, np.uint8)).astype(np.int32)
                left, corner = np.zeros(bpp, np.int32), np.zeros(bpp, np.int32)
                for x in range(0, stride, bpp):
                    over = up[x : x + bpp]
                    if kind == 3:
                        guess = (left + over) >> 1
                    else:
                        p = left + over - corner
                        pa_, pb, pc = np.abs(p - left), np.abs(p - over), np.abs(p - corner)
                        guess = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, over, corner))
                    left = (line[x : x + bpp] + guess) & 255
                    row[x : x + bpp], corner = left, over
        else:
            raise ValueError(f"unknown line filter {kind}")
    return out


def decode_png(data: bytes) -> tuple[np.ndarray, dict]:
    """Samples (rows, width x channels) of an 8-bit, not interlaced PNG, and what its header says. Raises ValueError for anything else."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut short")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("a header of the wrong size")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not head or not ended:
        raise ValueError("no header or no end")
    width, rows, depth, colour, method, filters, interlaced = head
    if depth != 8 or interlaced or method or filters or colour not in CHANNELS or not width or not rows:
        raise ValueError("only 8-bit images without interlacing are read")
    bpp = CHANNELS[colour]
    want = rows * (width * bpp + 1)
    inflate = zlib.decompressobj()
    try:
        raw = np.frombuffer(inflate.decompress(b"".join(packed), want + 1), dtype=np.uint8)  # never more than the header says
    except zlib.error as e:
        raise ValueError(f"the samples can't be inflated: {e}") from None
    if raw.size != want or not inflate.eof:
        raise ValueError("the samples don't fit the header")
    lines = raw.reshape(rows, width * bpp + 1)
    return _unfilter(lines[:, 1:], lines[:, 0], bpp), {"width": width, "rows": rows, "channels": bpp}


@lru_cache(maxsize=4)
def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(low)[:, None] / (2 * n))


def cosine_hash(samples: np.ndarray, side: int = 32, low: int = 8) -> str:
    """64 bits as 16 hex digits: of the low x low cosine coefficients of the image shrunk to side x side, those above their median."""
    small = _shrink(_shrink(samples, side).T, side).T
    c = _cosines(side, low)
    f = np.round(c @ small @ c.T, 6).ravel()
    bits = f > np.median(f[1:])
    return np.packbits(bits).tobytes().hex()


def _shrink(a: np.ndarray, side: int) -> np.ndarray:
    """Mean of equal shares of the rows (of single rows where there are fewer than side)."""
    n = a.shape[0]
    edges = np.arange(side) * n // side
    if n >= side:
        return np.add.reduceat(a, edges, axis=0, dtype=np.float64) / np.diff(np.append(edges, n))[:, None]
    return a[edges].astype(np.float64)


def text_samples(text: str) -> tuple[np.ndarray, int]:
    raw = text.encode()
    size = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    return np.frombuffer(raw.ljust(size, b"\0"), dtype=np.uint8).reshape(-1, WIDTH), len(raw)


def text_media(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_bytes and the binary column `media`: each text as a PNG."""
    source = df.select(*keep, text_or_empty(text).alias(unused(df, "text")))
    schema = df.select(*keep).schema.add("n_bytes", "long").add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made = [(n, encode_png(s)) for s, n in map(text_samples, part.column(part.num_columns - 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def media_features(df: DataFrame, media: str = "media", size: str = "n_bytes", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Reads each image of a binary column back: its payload's size and digests, and its cosine hash."""
    source = df.select(*keep, size, media)
    schema = source.drop(media).schema
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        try:
            samples, _ = decode_png(data)
        except ValueError:
            return None, None, None, len(data), hashlib.sha256(data).hexdigest(), None
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

    return source.mapInArrow(run, schema)


def op7_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(text_media(table(spark, sf_dir, "documents")))
