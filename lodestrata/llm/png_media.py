"""Bytes as PNG images in binary columns, and perceptual hashes of what is read back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: 64 pixels of red, green and blue.
ROW_BYTES = 192
WIDTH, CHANNELS = 64, 3
#: A chunk of image data holds at most this many bytes.
IDAT_BYTES = 1 << 20
SIDE, LOW = 32, 8
#: Bytes of images that are encoded or undone together.
TOGETHER = 1 << 20


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def filtered(rows: np.ndarray, heads: np.ndarray, bpp: int, kind: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filter of each row and the filtered rows, for rows of many images at once; heads marks images' first rows.

    All five filters are tried on all rows, and a row takes the one that leaves the fewest different bytes: the
    sum of absolute differences, made for pictures, nearly doubles the size of rows of text.
    """
    x = rows.astype(np.int16)
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, bpp:] = x[:, :-bpp]
    up[1:] = x[:-1]
    up[heads] = 0
    corner[:, bpp:] = up[:, :-bpp]
    tried = [(x - p).astype(np.uint8) for p in (0, left, up, (left + up) >> 1, _paeth(left, up, corner))]
    if kind is not None:
        return np.full(len(rows), kind, np.uint8), tried[kind]
    cost = []
    for t in tried:
        ordered = np.sort(t, axis=1, kind="stable")
        cost.append((ordered[:, 1:] != ordered[:, :-1]).sum(axis=1))
    best = np.stack(cost).argmin(axis=0).astype(np.uint8)
    return best, np.stack(tried)[best, np.arange(len(rows))]


def unfiltered(kinds: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    """Undoes the filters of images of one size at once: kinds is images x rows, rows images x rows x bytes.

    Rows of filters 0 to 2 are undone whole, a row of all images at a time. Where there are others, a pixel needs
    those to its left and above, so all pixels of one diagonal, of all images, are undone together.
    """
    most = kinds.max(initial=0)
    if most > 4:
        raise ValueError(f"filter {int(most)}")
    images, height, size = rows.shape
    if most <= 2:
        out = rows.copy()
        for y in range(height):
            line = out[:, y]
            if (sub := kinds[:, y] == 1).any():
                line[sub] = np.cumsum(line[sub].reshape(-1, size // bpp, bpp), axis=1, dtype=np.uint8).reshape(-1, size)
            if y and (above := kinds[:, y] == 2).any():
                line[above] += out[above, y - 1]
        return out
    width = size // bpp
    # The diagonals lie side by side: pixel (y, x) is at [y + x, y], so its neighbours are on the two diagonals before.
    skew = np.zeros((height + width - 1, images, height, bpp), np.int16)
    y, x = np.arange(height)[:, None], np.arange(width)[None, :]
    skew[(y + x).ravel(), :, np.broadcast_to(y, (height, width)).ravel()] = rows.reshape(images, height * width, bpp).transpose(1, 0, 2)
    # Beyond its left edge and above its first row an image is 0; done holds those too (row 0).
    done = np.zeros((height + width + 1, images, height + 1, bpp), np.int16)
    kind = kinds[:, :, None]
    of = [kind == k for k in range(5)]
    for d in range(height + width - 1):
        lo, hi = max(0, d - width + 1), min(d, height - 1) + 1
        a, b, c = done[d + 1, :, lo + 1 : hi + 1].copy(), done[d + 1, :, lo:hi], done[d, :, lo:hi]
        if d < height:
            a[:, d - lo] = 0  # the first pixel of row d
        guess = np.where(of[1][:, lo:hi], a, 0) + np.where(of[2][:, lo:hi], b, 0) + np.where(of[3][:, lo:hi], (a + b) >> 1, 0)
        if of[4][:, lo:hi].any():
            guess += np.where(of[4][:, lo:hi], _paeth(a, b, np.where(d - np.arange(lo, hi)[None, :, None] > 0, c, 0)), 0)
        done[d + 2, :, lo + 1 : hi + 1] = (skew[d, :, lo:hi] + guess) & 255
    out = done[(y + x + 2).ravel(), :, np.broadcast_to(y + 1, (height, width)).ravel()]
    return out.transpose(1, 0, 2).reshape(images, height, size).astype(np.uint8)


def encode_all(payloads: list[bytes], width: int = WIDTH, channels: int = CHANNELS, kind: int | None = None, level: int = 1) -> list[bytes]:
    """8-bit grey (channels 1) or RGB (3) PNGs whose samples are the payloads, a whole number of rows each.

    The filter of each row is chosen unless kind names one for all.
    """
    size = width * channels
    if any(not p or len(p) % size for p in payloads):
        raise ValueError("a payload is a positive number of whole rows")
    if not payloads:
        return []
    heights = np.array([len(p) // size for p in payloads])
    ends = np.cumsum(heights)
    kinds, rows = filtered(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, size), ends - heights, channels, kind)
    lines = np.concatenate([kinds[:, None], rows], axis=1)
    out = []
    for height, end in zip(heights.tolist(), ends.tolist(), strict=True):
        data = zlib.compress(lines[end - height : end].tobytes(), level)
        head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
        body = b"".join(_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES))
        out.append(SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b""))
    return out


def encode(payload: bytes, width: int = WIDTH, channels: int = CHANNELS, kind: int | None = None, level: int = 1) -> bytes:
    return encode_all([payload], width, channels, kind, level)[0]


def parsed(png: bytes) -> tuple[np.ndarray, int]:
    """Filtered lines (height x (1 + bytes)) and channels; any damage to a chunk, its checksum or the zlib stream raises ValueError."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, head, data, ended = 8, None, [], False
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut short")
        (size,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", png[at + 8 + size : at + 12 + size].ljust(4, b"\0"))[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + size
    if head is None or not ended:
        raise ValueError("a chunk is missing")
    width, height, depth, colour, *rest = head
    if depth != 8 or colour not in (0, 2) or any(rest):
        raise ValueError("only 8-bit grey or RGB without interlacing")
    channels = 1 if colour == 0 else 3
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise ValueError("zlib stream") from e
    if len(raw) != height * (width * channels + 1):
        raise ValueError("image size")
    return raw.reshape(height, -1), channels


def decode_all(pngs: list[bytes]) -> list[np.ndarray]:
    """Samples of each image as height x width x channels. Images of like size are undone together."""
    lines = [parsed(p) for p in pngs]
    out: list[np.ndarray] = [np.zeros(0)] * len(pngs)
    groups: dict[tuple, list[int]] = {}
    for i, (x, channels) in enumerate(lines):
        # Heights are filled up to a few sizes: rows below an image have no part in it.
        step = max(1, 1 << max(0, (len(x) - 1).bit_length() - 3))
        groups.setdefault((channels, x.shape[1], -(-len(x) // step) * step, x[:, 0].max() > 2), []).append(i)
    for (channels, size, height, _), members in groups.items():
        each = max(1, TOGETHER // (size * height))
        for at in range(0, len(members), each):
            part = members[at : at + each]
            block = np.zeros((len(part), height, size), np.uint8)
            for k, i in enumerate(part):
                block[k, : len(lines[i][0])] = lines[i][0]
            undone = unfiltered(block[:, :, 0], block[:, :, 1:], channels)
            for k, i in enumerate(part):
                out[i] = undone[k, : len(lines[i][0])].reshape(len(lines[i][0]), -1, channels)
    return out


def decode(png: bytes) -> np.ndarray:
    return decode_all([png])[0]


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


_COS = _cosines()


def cosine_hash(image: np.ndarray) -> bytes:
    """8 bytes: signs, against their median, of the 64 lowest terms of the cosine transform.

    The image becomes grey and 32 x 32 by averaging equal shares of rows and columns; one smaller than that
    repeats rows.
    """
    grey = image.mean(axis=2)

    def share(a: np.ndarray) -> np.ndarray:
        n = a.shape[0]
        edges = (np.arange(SIDE + 1) * n) // SIDE
        low, high = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
        total = np.vstack([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0)])
        return (total[high] - total[low]) / (high - low)[:, None]

    low = _COS @ share(share(grey).T).T @ _COS.T
    low = np.round(low, 6)
    return np.packbits((low > np.median(low)).ravel()).tobytes()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of a text (null: empty) and its bytes padded with spaces to a positive multiple of 192."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(ROW_BYTES, -(-len(raw) // ROW_BYTES) * ROW_BYTES), b" ")


def _runs(sizes: list[int]) -> Iterator[slice]:
    """Runs of rows of about TOGETHER bytes, at least one row each."""
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > TOGETHER:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a PNG (binary). One row a row, nulls and repeats included; no rows, none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["text"].tolist()
            for at in _runs([4 * len(t or "") for t in texts]):
                made = [payload_of(t) for t in texts[at]]
                yield pd.DataFrame({"doc_id": part["doc_id"].iloc[at].tolist(), "n_bytes": [n for n, _ in made], "media": encode_all([p for _, p in made])})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id string, n_bytes long, media binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def features(media: DataFrame) -> DataFrame:
    """Reads stored images (doc_id, n_bytes, media) back: payload digests, media digests and the cosine hash (binary), by row; no rows, none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for at in _runs(part["media"].map(len).tolist()):
                some = part.iloc[at]
                for doc_id, n, png, image in zip(some["doc_id"], some["n_bytes"], some["media"], decode_all(some["media"].tolist()), strict=True):
                    payload = image.tobytes()
                    rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(image)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash"])

    out = media.select(F.col("doc_id").cast("string").alias("doc_id"), "n_bytes", "media").mapInPandas(
        run, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
