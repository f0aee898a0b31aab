"""PNG columns: exact round trips, all row filters, broken files."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from hearthline.llm import media as M

from . import helpers as H


def filtered(picture: np.ndarray, kinds: list[int]) -> bytes:
    """A PNG whose rows use the given filters, sample by sample."""
    height, width = picture.shape
    raw = bytearray()
    for y, kind in enumerate(kinds):
        raw.append(kind)
        for x in range(width):
            left = int(picture[y, x - 1]) if x else 0
            up = int(picture[y - 1, x]) if y else 0
            corner = int(picture[y - 1, x - 1]) if x and y else 0
            guess = left + up - corner
            paeth = min(((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner)))[2]
            raw.append((int(picture[y, x]) - (0, left, up, (left + up) // 2, paeth)[kind]) & 255)
    body = zlib.compress(bytes(raw))
    head = M._chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
    return M.SIGNATURE + head + M._chunk(b"tEXt", b"note") + M._chunk(b"IDAT", body[:7]) + M._chunk(b"IDAT", body[7:]) + M._chunk(b"IEND", b"")


def test_all_filters():
    rng = np.random.default_rng(3)
    for width in (1, 5, 64):
        picture = rng.integers(0, 256, (25, width)).astype(np.uint8)
        assert (M.read_png(filtered(picture, [y % 5 for y in range(25)])) == picture).all()


def test_writer_filters_rows():
    """Rows that repeat the one above or run on are stored filtered, and come back."""
    line = bytes(range(32, 96))
    payload = line * 5 + b"\0" * 64 + b"prose, as it is usually met in documents of all kinds, 64 signs." + b"abcdefghijklmnop" * 4
    rows = M._filtered(np.frombuffer(payload, np.uint8).reshape(-1, 64))
    assert set(rows[:, 0].tolist()) == {0, 1, 2} and rows[1:5, 0].tolist() != [0, 0, 0, 0]
    assert M.read_png(M.write_png(payload)).tobytes() == payload
    rng = np.random.default_rng(2)
    for _ in range(50):
        samples = np.cumsum(rng.integers(0, 3, (int(rng.integers(1, 40)), 64)), axis=int(rng.integers(2))).astype(np.uint8)
        assert M.read_png(M.write_png(samples.tobytes())).tobytes() == samples.tobytes()


def picture(header: bytes, raw: bytes, more: bytes = b"") -> bytes:
    return M.SIGNATURE + M._chunk(b"IHDR", header) + M._chunk(b"IDAT", zlib.compress(raw) + more) + M._chunk(b"IEND", b"")


def broken_headers() -> list[bytes]:
    size = lambda w, h: struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return [
        picture(size(1, 1)[:12], b"\0a"),
        picture(size(1, 1) + b"x", b"\0a"),
        picture(size(0, 0), b""),
        picture(size(0, 3), b"\0\0\0"),
        picture(size(3, 0), b""),
        picture(size(1, 1), b"\0a" * 1000),
        picture(size(1 << 31, 1 << 31), b"\0a"),
        picture(size(1, 1), b"\0a", b"tail"),
        picture(size(1, 1), b"\5a"),
        M.SIGNATURE + M._chunk(b"IDAT", zlib.compress(b"\0a")) + M._chunk(b"IEND", b""),
        M.SIGNATURE + M._chunk(b"IHDR", size(1, 1)) * 2 + M._chunk(b"IDAT", zlib.compress(b"\0a")) + M._chunk(b"IEND", b""),
    ]


def test_broken_headers(spark):
    assert M.read_png(picture(struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0), b"\0a")).tobytes() == b"a"
    for media in broken_headers():
        with pytest.raises(ValueError):
            M.read_png(media)
    rows = spark.createDataFrame([(i, 1, m) for i, m in enumerate(broken_headers())], "doc_id long, n_bytes long, media binary")
    assert all(r["payload"] is None and r["error"] for r in M.read_media(rows).collect())


def test_broken_files():
    good = M.write_png(b"x" * 128)
    rng = random.Random(1)
    for _ in range(200):
        at = rng.randrange(len(good))
        bad = good[:at] + bytes([good[at] ^ (1 << rng.randrange(8))]) + good[at + 1 :]
        with pytest.raises(ValueError):
            M.read_png(bad)
    for cut in range(len(good)):
        with pytest.raises(ValueError):
            M.read_png(good[:cut])


def test_hash_is_about_low_frequencies():
    rng = np.random.default_rng(1)
    picture = np.cumsum(rng.integers(-3, 4, (200, 64)), axis=0).clip(-100, 100).astype(np.int64) + 128
    noisy = (picture + rng.integers(-1, 2, picture.shape)).clip(0, 255).astype(np.uint8)
    apart = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    h = M.cosine_hash(picture.astype(np.uint8))
    assert len(h) == 16 and apart(h, M.cosine_hash(noisy)) <= 8


def test_tables(spark):
    rows = {}
    for r in H.AWKWARD:
        raw = (r[1] or "").encode()
        rows[r[0]] = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    got = M.media_digests(H.awkward(spark)).collect()
    assert len(got) == len(H.AWKWARD)
    for r in got:
        full = rows[r["doc_id"]]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r["n_bytes"] <= r["payload_bytes"] and r["media_bytes"] > 0 and len(r["feature"]) == 16
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (6, 7)}) == 1
    assert M.media_digests(H.empty(spark)).count() == 0
    broken = spark.createDataFrame([(1, 1, None), (2, 1, b"no picture")], "doc_id long, n_bytes long, media binary")
    assert [(r["payload"], r["error"]) for r in M.read_media(broken).collect()] == [(None, "null"), (None, "not a PNG")]
