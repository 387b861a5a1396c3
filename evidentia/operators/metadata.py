"""Image metadata from file bytes: digest, size, dimensions, EXIF, and hashes of decoded pixels.

Headers and EXIF are read byte by byte; no image library is needed. Pixels
come from the image source.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of EXIF tags, bytes per value by type.
TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0131: "Software", 0x0132: "DateTime",
    0x013B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized",
    0x920A: "FocalLength", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA420: "ImageUniqueID",
}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
SUBTABLE = 0x8769


def dimensions(data: bytes) -> tuple[int, int]:
    """Width and height from a PNG, GIF, JPEG or WebP header; 0, 0 where there is none."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:4] == b"GIF8":
            return struct.unpack("<HH", data[6:10])
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
            if data[12:16] == b"VP8 ":
                w, h = struct.unpack("<HH", data[26:30])
                return w & 0x3FFF, h & 0x3FFF
        for marker, body in _segments(data):
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", body[1:5])
                return w, h
    except struct.error:
        pass
    return 0, 0


def _segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield data[at + 1], data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xDA or size < 2:
            return
        at += 2 + size


def exif(data: bytes) -> dict[str, str]:
    """EXIF tags of a JPEG as text: rationals as a/b (0 for a zero denominator), bytes as UTF-8 or hex; {} if broken."""
    block = next((b[6:] for m, b in _segments(data) if m == 0xE1 and b[:6] == b"Exif\0\0"), b"")
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    out: dict[str, str] = {}
    if not order:
        return out

    def read(at: int, depth: int) -> None:
        (n,) = struct.unpack_from(order + "H", block, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", block, at + 2 + 12 * i)
            size = SIZES.get(kind, 0) * count
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", block, at + 10 + 12 * i)[0]
            if tag == SUBTABLE and depth == 0:
                read(struct.unpack_from(order + "I", block, where)[0], 1)
            elif tag in TAGS and size and where + size <= len(block):
                out[TAGS[tag]] = _shown(block[where : where + size], kind, count, order)

    try:
        read(struct.unpack_from(order + "I", block, 4)[0], 0)
    except struct.error:
        pass
    return out


def _shown(raw: bytes, kind: int, count: int, order: str) -> str:
    if kind in (1, 2, 7):
        raw = raw.rstrip(b"\0") if kind == 2 else raw
        try:
            return raw.decode("utf-8").strip("\0 ")
        except UnicodeDecodeError:
            return raw.hex()
    if kind in (5, 10):
        pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
        shown = [f"{a}/{b}" if b else "0" for a, b in zip(pairs[::2], pairs[1::2])]
    else:
        shown = [str(x) for x in struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind] * count, raw)]
    return shown[0] if count == 1 else "(" + ", ".join(shown) + ")"


def _shrink(gray: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean of each cell of an h x w grid laid over the picture."""
    y, x = np.linspace(0, gray.shape[0], h + 1), np.linspace(0, gray.shape[1], w + 1)
    cut = lambda e, n: [(int(a), max(int(a) + 1, int(np.ceil(b)))) for a, b in zip(e, e[1:])]
    return np.array([[gray[a:b, c:d].mean() for c, d in cut(x, w)] for a, b in cut(y, h)])


def _hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel()).tobytes().hex()


def average_hash(gray: np.ndarray) -> str:
    s = _shrink(gray, 8, 8)
    return _hex(s > s.mean())


def difference_hash(gray: np.ndarray) -> str:
    s = _shrink(gray, 8, 9)
    return _hex(s[:, 1:] > s[:, :-1])


def perceptual_hash(gray: np.ndarray) -> str:
    """Low frequencies of the cosine transform against their median."""
    s, k = _shrink(gray, 32, 32), np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:8, None] / 64)
    low = basis @ s @ basis.T
    return _hex(low > np.median(low))


METADATA = "path string, sha256_hash string, file_size_bytes long, width int, height int, exif map<string,string>"


def metadata(files: DataFrame) -> DataFrame:
    """files (path, content) -> METADATA; null and unreadable contents have zero sizes and no EXIF."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                data = data or b""
                w, h = dimensions(data)
                rows.append((path, hashlib.sha256(data).hexdigest() if data else "", len(data), w, h, exif(data)))
            f = pd.DataFrame(rows, columns=["path", "sha256_hash", "file_size_bytes", "width", "height", "exif"], dtype=object)
            yield f.astype({"file_size_bytes": "int64", "width": "int32", "height": "int32"})

    return files.select("path", "content").mapInPandas(run, METADATA)


def pixel_hashes(images: DataFrame) -> DataFrame:
    """images (id, height, width, nChannels, data) -> (id, phash, dhash, ahash), 16 hex digits each; empty where there are no pixels."""
    from evidentia.operators.images import to_gray

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, h, w, c, data in zip(b["id"], b["height"], b["width"], b["nChannels"], b["data"]):
                if data is None or not h or not w or len(data) < h * w * c:
                    rows.append((i, "", "", ""))
                    continue
                px = np.frombuffer(data, np.uint8)[: int(h * w * c)].reshape(int(h), int(w), int(c))
                gray = (px[:, :, 0] if c < 3 else to_gray(px)).astype(float)
                rows.append((i, perceptual_hash(gray), difference_hash(gray), average_hash(gray)))
            yield pd.DataFrame(rows, columns=["id", "phash", "dhash", "ahash"], dtype=object)

    return images.select(F.col("id").cast("string").alias("id"), "height", "width", "nChannels", "data").mapInPandas(run, "id string, phash string, dhash string, ahash string")
