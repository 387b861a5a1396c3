"""Keypoints of a picture, and parts of it that were copied elsewhere in it.

Corners are found on a pyramid, turned to the direction of their patch's
centre of mass, and described by 256 comparisons of smoothed pixels. A copied
part gives distant keypoints whose descriptors differ in few bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keypoints of a picture at most (the strongest), levels of the pyramid, their ratio, and the radius of a patch.
MOST, LEVELS, RATIO, RADIUS = 1000, 4, 1.41, 15
#: Longest side of a picture that is looked at; neighbours looked at, a keypoint itself among them; bits and pixels of a copy; descriptors needed.
SIDE, NEIGHBOURS, BITS, APART, FEWEST = 800, 4, 30, 50, 50
_rng = np.random.default_rng(20)
#: Pairs of places that a descriptor compares, drawn evenly from the patch's disc.
_polar = _rng.uniform(0, 1, (2, 256, 2))
PAIRS = np.stack([RADIUS * np.sqrt(_polar[0]) * f(2 * np.pi * _polar[1]) for f in (np.cos, np.sin)], axis=-1)
_y, _x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
DISC = _x**2 + _y**2 <= RADIUS**2


def resized(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """img at another size, pixels between four others in proportion."""
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((h, img.shape[0]), (w, img.shape[1])))
    y0, x0 = (np.minimum(a.astype(int), m - 2).clip(0) for a, m in ((y, img.shape[0]), (x, img.shape[1])))
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    rows = img[y0] * (1 - fy) + img[y1] * fy
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def blurred(img: np.ndarray, sigma: float, radius: int) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(img, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = img.shape[axis]
        img = sum(w * (p[:, i : i + n] if axis else p[i : i + n]) for i, w in enumerate(k))
    return img


def corners(img: np.ndarray) -> np.ndarray:
    """(y, x, strength) of places whose gradients vary in both directions, the greatest among their neighbours."""
    gy, gx = np.gradient(img)
    a, b, c = (blurred(g, 1.5, 3) for g in (gx * gx, gy * gy, gx * gy))
    r = a * b - c * c - 0.04 * (a + b) ** 2
    p = np.pad(r, 1, constant_values=-np.inf)
    h, w = r.shape
    top = np.max([p[1 + i : 1 + i + h, 1 + j : 1 + j + w] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
    edge = RADIUS + 1
    inside = np.zeros(r.shape, bool)
    inside[edge : h - edge, edge : w - edge] = True
    y, x = np.nonzero(inside & (r == top) & (r > 1.0))
    return np.column_stack([y, x, r[y, x]])


def describe(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (y, x) in gray and descriptors, four words of 64 bits, of its strongest keypoints."""
    found = []
    for level in range(LEVELS):
        scale = RATIO**level
        h, w = (int(round(n / scale)) for n in gray.shape)
        if min(h, w) < 2 * RADIUS + 4:
            break
        img = gray.astype(float) if level == 0 else resized(gray.astype(float), h, w)
        found.append((img, scale, corners(img)))
    if not found or not sum(len(c) for _, _, c in found):
        return np.zeros((0, 2)), np.zeros((0, 4), np.uint64)
    strength = np.concatenate([c[:, 2] for _, _, c in found])
    least = np.sort(strength)[-min(MOST, len(strength))]
    places, words = [], []
    for img, scale, c in found:
        y, x = c[c[:, 2] >= least, :2].astype(int).T
        if not len(y):
            continue
        patch = img[y[:, None, None] + _y, x[:, None, None] + _x] * DISC
        angle = np.arctan2((patch * _y).sum((1, 2)), (patch * _x).sum((1, 2)))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px, py = PAIRS[None, :, :, 0], PAIRS[None, :, :, 1]
        smooth = blurred(img, 1.2, 3)
        at = smooth[y[:, None, None] + np.rint(sin * px + cos * py).astype(int), x[:, None, None] + np.rint(cos * px - sin * py).astype(int)]
        bits = at[:, :, 0] < at[:, :, 1]
        places.append(np.column_stack([y, x]) * scale)
        words.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
    return np.concatenate(places)[:MOST], np.concatenate(words)[:MOST]


def neighbours(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each descriptor the k nearest, itself among them, and how many bits they differ in; ties to the lower number. In blocks of rows."""
    near, bits = [], []
    for i in range(0, len(words), 128):
        d = sum(np.bitwise_count(words[i : i + 128, None, c] ^ words[None, :, c]).astype(np.int64) for c in range(words.shape[1]))
        key = d * len(words) + np.arange(len(words))  # distance, then number: no two are equal
        first = np.sort(key if k >= len(words) else np.partition(key, k, axis=1)[:, :k], axis=1)[:, :k]
        near.append(first % len(words))
        bits.append(first // len(words))
    return np.concatenate(near), np.concatenate(bits)


def copies(gray: np.ndarray) -> tuple[int, int]:
    """How many keypoints a picture has, and how many near descriptors stand apart in it."""
    if max(gray.shape) > SIDE:
        scale = SIDE / max(gray.shape)
        gray = resized(gray.astype(float), *(max(1, int(n * scale)) for n in gray.shape))
    places, words = describe(gray)
    if len(words) < FEWEST:
        return len(words), 0
    near, bits = neighbours(words, NEIGHBOURS)
    apart = np.hypot(*(places[near] - places[:, None]).transpose(2, 0, 1)) > APART
    other = near != np.arange(len(words))[:, None]
    return len(words), int((apart & other & (bits < BITS)).sum())


def copy_move_score(gray: np.ndarray) -> float:
    """0 up to 5 copied keypoints, 1 from 25 on; 0 for pictures of few keypoints."""
    return float(np.clip((copies(gray)[1] - 5) / 20, 0, 1))


def copy_moves(images: DataFrame) -> DataFrame:
    """images (id, height, width, data: grey pixels) -> id, n_keypoints, n_copies, copy_move.

    Pictures without pixels, or with too few bytes, have no keypoints and score 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, w, data in zip(b["height"], b["width"], b["data"]):
                known = data is not None and h > 0 and w > 0 and len(data) >= int(h) * int(w)
                out.append(copies(np.frombuffer(data, np.uint8, int(h) * int(w)).reshape(int(h), int(w))) if known else (0, 0))
            n, c = (np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
            yield pd.DataFrame({"id": b["id"], "n_keypoints": n, "n_copies": c, "copy_move": np.clip((c - 5) / 20, 0, 1)})

    return images.select(F.col("id").cast("string").alias("id"), "height", "width", "data").mapInPandas(run, "id string, n_keypoints long, n_copies long, copy_move double")
