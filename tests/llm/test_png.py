import hashlib
import struct
import zlib

import numpy as np
import pytest

from tessella.llm import png


def test_query(spark, small, docs):
    got = {r.doc_id: r for r in png.op7_png(spark, small).collect()}
    for i, t in docs:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(r.feature) == 16


def made(filters, rows, channels=1, colour=0):
    """A PNG with a given filter for each line, filtered byte by byte."""
    bpp, height, stride = channels, len(rows), len(rows[0])
    lines, before = b"", [0] * stride
    for kind, row in zip(filters, rows, strict=True):
        line = bytearray([kind])
        for x in range(stride):
            left, up, corner = (row[x - bpp] if x >= bpp else 0), before[x], (before[x - bpp] if x >= bpp else 0)
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            line.append((row[x] - [0, left, up, (left + up) // 2, paeth][kind]) % 256)
        lines, before = lines + bytes(line), row
    head = struct.pack(">IIBBBBB", stride // channels, height, 8, colour, 0, 0, 0)
    return png.SIGNATURE + png._chunk(b"IHDR", head) + png._chunk(b"tEXt", b"k\0v") + png._chunk(b"IDAT", (z := zlib.compress(lines))[:5]) + png._chunk(b"IDAT", z[5:]) + png._chunk(b"IEND", b"")


@pytest.mark.parametrize(("channels", "colour"), [(1, 0), (3, 2), (4, 6)])
def test_all_filters(channels, colour):
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 256, (12, 6 * channels)).tolist()
    samples, head = png.decode_png(made([0, 1, 2, 3, 4, 4, 3, 2, 2, 1, 1, 0], rows, channels, colour))
    assert samples.tolist() == rows and head["channels"] == channels


def test_round_trip():
    rng = np.random.default_rng(6)
    for a in (rng.integers(0, 256, (9, 64)), np.zeros((1, 64)), np.arange(640).reshape(10, 64) % 256, np.repeat(rng.integers(0, 256, (1, 64)), 5, 0)):
        a = a.astype(np.uint8)
        assert np.array_equal(png.decode_png(png.encode_png(a))[0], a)


def test_damage_is_seen():
    data = bytearray(png.encode_png(np.zeros((2, 64), np.uint8)))
    for at in (0, 20, 45, len(data) - 5):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            png.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        png.decode_png(bytes(data[:-12]))


def test_all_damage_is_one_error():
    """Short headers, bad compressed data, cut files, changed bytes: ValueError or, where the change is harmless, the image."""
    good, rng = png.encode_png(np.arange(128, dtype=np.uint8).reshape(2, 64)), np.random.default_rng(8)
    chunk = lambda *x: png.SIGNATURE + b"".join(png._chunk(k, d) for k, d in x)
    head = struct.pack(">IIBBBBB", 64, 2, 8, 0, 0, 0, 0)
    bad = [b"", b"x", png.SIGNATURE, good[:20], chunk((b"IHDR", b"short"), (b"IEND", b"")), chunk((b"IHDR", head), (b"IEND", b""))]
    bad += [chunk((b"IHDR", head), (b"IDAT", d), (b"IEND", b"")) for d in (b"", b"not zlib", zlib.compress(b"few"), zlib.compress(b"x" * 10_000), zlib.compress(bytes([9]) * 130), zlib.compress(b"0" * 130)[:-4])]
    bad += [good[:k] for k in range(len(good))] + [rng.integers(0, 256, 200, dtype=np.uint8).tobytes()]
    for data in bad:
        with pytest.raises(ValueError):
            png.decode_png(data)


def test_null_and_damaged_images_in_a_column(spark):
    good = png.encode_png(np.zeros((1, 64), np.uint8))
    rows = [(1, 0, good), (2, 5, None), (3, 5, b"junk"), (4, 5, good[:30])]
    got = {r.doc_id: r for r in png.media_features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1].payload_bytes == 64 and len(got[1].feature) == 16
    assert [(got[i].media_bytes, got[i].payload_bytes, got[i].feature) for i in (2, 3, 4)] == [(None, None, None), (4, None, None), (30, None, None)]
    assert got[2].media_sha256 is None and got[3].media_sha256 == hashlib.sha256(b"junk").hexdigest()


def test_hash_by_definition():
    """The cosine sums written out, and means of equal shares of rows and columns."""
    a = np.random.default_rng(2).integers(0, 256, (70, 64)).astype(np.uint8)
    cut = lambda n: [(k * n // 32, (k + 1) * n // 32) for k in range(32)]
    small = np.array([[a[y0:y1, x0:x1].mean() for x0, x1 in cut(64)] for y0, y1 in cut(70)])
    wave = lambda u, x: np.cos(np.pi * (2 * x + 1) * u / 64)
    f = np.array([sum(small[y, x] * wave(u, y) * wave(v, x) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)])
    bits = "".join("1" if x > np.median(f[1:]) else "0" for x in f)
    assert png.cosine_hash(a) == f"{int(bits, 2):016x}"


def test_hash_follows_low_frequencies():
    y, x = np.mgrid[0:64, 0:64]
    a = (127 + 100 * np.cos(x / 9) * np.sin(y / 14)).astype(np.uint8)
    noisy = np.clip(a.astype(int) + np.random.default_rng(1).integers(-6, 7, a.shape), 0, 255).astype(np.uint8)
    far = (127 + 100 * np.sin(x / 5) * np.cos(y / 4)).astype(np.uint8)
    bits = lambda p, q: (int(png.cosine_hash(p), 16) ^ int(png.cosine_hash(q), 16)).bit_count()
    assert bits(a, noisy) <= 8 < bits(a, far)


def test_odd_rows(odd, nothing):
    got = {r.doc_id: r for r in png.media_features(png.text_media(odd)).collect()}
    assert got[3].n_bytes == got[4].n_bytes == 0 and got[3].payload_bytes == 64 and got[3].feature == got[4].feature
    assert got[6].payload_bytes == 100_032
    assert png.media_features(png.text_media(nothing)).count() == 0
