"""Media columns: payloads stored as PNG in binary columns, read back with all
checksums tested, and low-frequency cosine-transform hashes of the pictures.

A payload is a text's UTF-8, then bytes 0 up to a positive multiple of the
width; it becomes a grey 8-bit picture of that width. The writer gives each row
the filter that leaves the fewest distinct samples (none, left, above; the first
of equals): mostly none for prose, others for padding and repeated lines. The reader undoes all
five row filters in numpy, Average and Paeth along diagonals, whose samples don't
depend on each other.

Null texts count as empty (a picture of one row of zeros). Media that are null
or broken (wrong checksums, lengths, headers or sizes, an empty picture, more data
than the header tells) give a null payload and the reason in `error`; they never end
a job, and no more is inflated than the header tells or MOST_SAMPLES allow.
Equal payloads give equal media and features. Repeated rows stay repeated; an
empty table gives an empty table; columns other than those named are not read.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_rows

WIDTH = 64
#: Fixed value: the eight bytes that start a PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 20
#: Pictures of more samples are not inflated.
MOST_SAMPLES = 1 << 30
#: Side of the shrunk picture, and of the corner of its transform that the hash keeps.
SIDE, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _filtered(samples: np.ndarray) -> np.ndarray:
    """Rows with their filter before them."""
    height, width = samples.shape
    left, above = np.zeros_like(samples), np.zeros_like(samples)
    left[:, 1:], above[1:] = samples[:, :-1], samples[:-1]
    kinds = np.stack([samples, samples - left, samples - above])
    ordered = np.sort(kinds, axis=2)
    best = (ordered[:, :, 1:] != ordered[:, :, :-1]).sum(2).argmin(0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = best, kinds[best, np.arange(height)]
    return rows


def write_png(payload: bytes, width: int = WIDTH, level: int = 4) -> bytes:
    """A grey 8-bit PNG whose samples are the payload's bytes, row by row."""
    height, rest = divmod(len(payload), width)
    if rest or not height:
        raise ValueError("a payload fills whole rows, one at least")
    rows = _filtered(np.frombuffer(payload, np.uint8).reshape(height, width))
    body = zlib.compress(rows.tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", body[at : at + IDAT_BYTES]) for at in range(0, len(body), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes the row filters of samples of one byte each."""
    if not kinds.any():
        return rows
    if kinds.max() > 4:
        raise ValueError("unknown row filter")
    if kinds.max() > 2:
        return _unfilter_diagonals(kinds, rows)
    out = np.where((kinds == 1)[:, None], np.cumsum(rows, axis=1, dtype=np.uint8), rows)
    up = kinds == 2
    starts = np.flatnonzero(up & ~np.append(False, up[:-1]))
    stops = np.flatnonzero(up & ~np.append(up[1:], False)) + 1
    for start, stop in zip(starts.tolist(), stops.tolist()):  # runs of rows that add to the one above
        out[max(0, start - 1) : stop] = np.cumsum(out[max(0, start - 1) : stop], axis=0, dtype=np.uint8)
    return out


def _unfilter_diagonals(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All filters at once: samples of one diagonal need only those of the two before it."""
    height, width = rows.shape
    out = np.zeros((height + 1, width + 1), np.int64)  # a row and a column of zeros before the picture
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x, kind = d - y, kinds[y]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        near, far = abs(guess - left), abs(guess - up)
        paeth = np.where((near <= far) & (near <= abs(guess - corner)), left, np.where(far <= abs(guess - corner), up, corner))
        out[y + 1, x + 1] = (rows[y, x] + np.choose(kind, [0, left, up, (left + up) >> 1, paeth])) & 255
    return out[1:, 1:].astype(np.uint8)


def read_png(media: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG, rows by columns. Raises ValueError where
    a checksum, a length or the format is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, wanted, inflate, data, ended = 8, None, 0, zlib.decompressobj(), [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("cut off")
        (length,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body, at = media[at + 8 : at + 8 + length], at + 12 + length
        if at > len(media) or struct.unpack_from(">I", media, at - 4)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if size is None and kind != b"IHDR":
            raise ValueError("no header")
        if kind == b"IHDR":
            if size is not None or len(body) != 13:
                raise ValueError("header")
            size = struct.unpack(">IIBBBBB", body)
            if size[2:] != (8, 0, 0, 0, 0):
                raise ValueError("not a plain grey picture of 8 bits")
            if not 0 < size[0] * size[1] <= MOST_SAMPLES:
                raise ValueError("size")
            wanted = size[1] * (size[0] + 1)
        elif kind == b"IDAT":
            try:
                data.append(inflate.decompress(body, wanted + 1))
            except zlib.error as e:
                raise ValueError(str(e)) from None
            wanted -= len(data[-1])
            if wanted < 0 or inflate.unconsumed_tail or inflate.unused_data:
                raise ValueError("more data than the header tells")
        ended = kind == b"IEND"
    raw = b"".join(data)
    if not (ended and size and inflate.eof) or wanted:
        raise ValueError("incomplete")
    rows = np.frombuffer(raw, np.uint8).reshape(size[1], size[0] + 1)
    return _unfilter(rows[:, 0], rows[:, 1:])


@functools.cache
def _cosines(n: int) -> np.ndarray:
    """The first LOW rows of the orthonormal cosine transform of n points."""
    k, x = np.arange(LOW)[:, None], np.arange(n)[None, :]
    c = np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.sqrt(2 / n)
    c[0] /= np.sqrt(2)
    return c


def _shrink(a: np.ndarray) -> np.ndarray:
    """SIDE means over the first axis; what is shorter is repeated."""
    n = len(a)
    edge = np.arange(SIDE) * n // SIDE
    if n < SIDE:
        return a[edge].astype(np.float64)
    return np.add.reduceat(a, edge, axis=0, dtype=np.float64) / np.diff(np.append(edge, n))[:, None]


def cosine_hash(picture: np.ndarray) -> str:
    """64 bits in hex: which low frequencies exceed their median."""
    small = _shrink(_shrink(picture).T).T
    low = np.round(_cosines(SIDE) @ small @ _cosines(SIDE).T, 6).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def store_media(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes and media (PNG) of every text."""

    def make():
        def step(rows):
            raw = [t.encode() for t in rows["text"]]
            full = [b.ljust(max(1, -(-len(b) // width)) * width, b"\0") for b in raw]
            return {"doc_id": rows["doc_id"], "n_bytes": [len(b) for b in raw], "media": [write_png(b, width) for b in full]}

        return step

    return map_rows(id_and_text(docs), "doc_id long, n_bytes long, media binary", make)


def read_media(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload, feature and error of stored media."""

    def make():
        def one(media):
            if media is None:
                return None, None, "null"
            try:
                picture = read_png(media)
            except ValueError as e:
                return None, None, str(e)
            return picture.tobytes(), cosine_hash(picture), None

        def step(rows):
            payload, feature, error = zip(*map(one, rows["media"])) if rows["media"] else ((), (), ())
            return rows | {"payload": payload, "feature": feature, "error": error}

        return step

    return map_rows(stored.select("doc_id", "n_bytes", "media"), "doc_id long, n_bytes long, media binary, payload binary, feature string, error string", make)


def media_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Stores every text, reads the stored bytes back, and describes both."""
    last = F.substring("payload", -width, width)
    return read_media(store_media(docs, width)).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(last).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
