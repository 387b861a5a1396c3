"""Variants of a picture for text recognition: contrast by tiles, smoothing that keeps edges, sharpening, local threshold, deskewing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.images import to_gray
from evidentia.operators.keypoints import blurred, resized

#: Contrast: tiles each way, and times the even share that a grey level may count. Smoothing: width, and spreads over greys and pixels. Threshold: width, and greys below the local mean. Sides from which pictures aren't enlarged.
TILES, CLIP, WIDE, SPREAD, LOCAL, BELOW, LARGE = 8, 2.5, 7, 75.0, 11, 2, 1200
#: Degrees of skew that are corrected, and dark pixels needed.
SKEW, DARK = (1.0, 45.0), 100


def contrast(plane: np.ndarray) -> np.ndarray:
    """Each tile's greys evened out, with their counts clipped and the excess shared; a pixel's new grey lies between those of the four tiles around it."""
    h, w = plane.shape
    size = [-(-n // TILES) for n in (h, w)]
    padded = np.pad(plane, [(0, s * TILES - n) for s, n in zip(size, (h, w))], mode="symmetric" if min(h, w) >= TILES else "edge")
    area = size[0] * size[1]
    tiles = padded.reshape(TILES, size[0], TILES, size[1]).swapaxes(1, 2).reshape(TILES * TILES, area)
    counts = np.bincount((np.arange(len(tiles))[:, None] * 256 + tiles).ravel(), minlength=len(tiles) * 256).reshape(-1, 256)
    limit = max(1, int(CLIP * area / 256))
    excess = np.maximum(counts - limit, 0).sum(1, keepdims=True)
    table = (np.cumsum(np.minimum(counts, limit) + excess / 256, axis=1) * 255 / area).reshape(TILES, TILES, 256)
    near = []
    for n, s in zip((h, w), size):
        at = (np.arange(n) + 0.5) / s - 0.5
        low = np.floor(at).astype(int)
        near.append((low.clip(0, TILES - 1), (low + 1).clip(0, TILES - 1), at - low))
    (y0, y1, fy), (x0, x1, fx) = near
    look = lambda y, x: table[y[:, None], x[None, :], plane]
    fy, fx = fy[:, None], fx[None, :]
    return np.rint((look(y0, x0) * (1 - fx) + look(y0, x1) * fx) * (1 - fy) + (look(y1, x0) * (1 - fx) + look(y1, x1) * fx) * fy).clip(0, 255).astype(np.uint8)


# sRGB to XYZ under D65, rows for X, Y and Z divided by the white point.
XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]) / np.array([[0.950456], [1.0], [1.088754]])


def to_lab(bgr: np.ndarray) -> np.ndarray:
    c = bgr[..., ::-1] / 255.0
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92) @ XYZ.T
    f = np.where(c > 0.008856, np.cbrt(c), 7.787 * c + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], axis=-1)
    c = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) @ np.linalg.inv(XYZ).T
    c = np.where(c > 0.0031308, 1.055 * np.maximum(c, 0) ** (1 / 2.4) - 0.055, 12.92 * c)
    return np.rint(c[..., ::-1] * 255).clip(0, 255).astype(np.uint8)


def bilateral(gray: np.ndarray) -> np.ndarray:
    """Mean of the pixels around, weighted by nearness in place and in grey."""
    r, g = WIDE // 2, gray.astype(float)
    p = np.pad(g, r, mode="reflect" if min(gray.shape) > r else "edge")
    total, weights = np.zeros(g.shape), np.zeros(g.shape)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= r * r:
                q = p[r + dy : r + dy + g.shape[0], r + dx : r + dx + g.shape[1]]
                k = np.exp(-0.5 * ((q - g) ** 2 + dy * dy + dx * dx) / SPREAD**2)
                total, weights = total + k * q, weights + k
    return np.rint(total / weights).astype(np.uint8)


def sharpened(bgr: np.ndarray) -> np.ndarray:
    p = np.pad(bgr.astype(int), ((1, 1), (1, 1), (0, 0)), mode="reflect" if min(bgr.shape[:2]) > 1 else "edge")
    return np.clip(5 * p[1:-1, 1:-1] - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:], 0, 255).astype(np.uint8)


def local_threshold(gray: np.ndarray) -> np.ndarray:
    """White where a pixel of the picture at twice its size is above the mean around it, less BELOW."""
    large = np.rint(resized(gray.astype(float), 2 * gray.shape[0], 2 * gray.shape[1]))
    return np.where(large > np.rint(blurred(large, 0.3 * ((LOCAL - 1) / 2 - 1) + 0.8, LOCAL // 2)) - BELOW, 255, 0).astype(np.uint8)


def parting(gray: np.ndarray) -> int:
    """The grey that parts dark and light with most variance between them."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.argmax(np.nan_to_num(between)))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in order, of points sorted by x and y. Of each row the outermost points are enough."""
    order = np.lexsort((points[:, 0], points[:, 1]))
    points = points[order]
    first = np.concatenate([[True], points[1:, 1] != points[:-1, 1]])
    outer = points[first | np.append(first[1:], True)].tolist()
    outer.sort()

    def side(rows: list) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(side(outer) + side(outer[::-1]), float)


def skew(gray: np.ndarray) -> float:
    """Degrees, over -45 to 45, by which the smallest rectangle around all dark pixels is turned clockwise; 0 for few."""
    y, x = np.nonzero(gray <= parting(gray))
    if len(y) < DARK:
        return 0.0
    corner = hull(np.column_stack([x, y]))
    if len(corner) < 3:
        return 0.0
    edge = np.roll(corner, -1, 0) - corner
    angle = np.arctan2(edge[:, 1], edge[:, 0])  # one side of the smallest rectangle lies on an edge of the hull
    cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
    u, v = cos * corner[:, 0] + sin * corner[:, 1], cos * corner[:, 1] - sin * corner[:, 0]
    best = int(np.argmin(np.ptp(u, axis=1) * np.ptp(v, axis=1)))
    turned = np.degrees(angle[best]) % 90
    return float(turned - 90 if turned > 45 else turned)


def rotated(img: np.ndarray, degrees: float) -> np.ndarray:
    """img turned clockwise about its middle, edges repeated outwards; a pixel comes from 4 x 4 by cubic weights."""
    h, w = img.shape[:2]
    t = np.radians(degrees)
    y, x = np.mgrid[:h, :w] - np.array([h / 2, w / 2])[:, None, None]
    sx, sy = np.cos(t) * x + np.sin(t) * y + w / 2, np.cos(t) * y - np.sin(t) * x + h / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)

    def weights(f: np.ndarray) -> list[np.ndarray]:
        near = lambda d: (1.25 * d - 2.25) * d * d + 1
        far = lambda d: ((-0.75 * d + 3.75) * d - 6) * d + 3
        return [far(f + 1), near(f), near(1 - f), far(2 - f)]

    out = np.zeros(img.shape)
    for i, wy in enumerate(weights(sy - y0), -1):
        for j, wx in enumerate(weights(sx - x0), -1):
            k = wy * wx
            out += img[(y0 + i).clip(0, h - 1), (x0 + j).clip(0, w - 1)] * (k[..., None] if img.ndim == 3 else k)
    return np.rint(out).clip(0, 255).astype(np.uint8)


def all_variants(bgr: np.ndarray) -> dict[str, np.ndarray]:
    """By name: original, clahe_contrast, grayscale_bilateral, sharpened, for small pictures adaptive_thresh, for slanted ones deskewed."""
    gray, lab = to_gray(bgr), to_lab(bgr)
    light = contrast(np.rint(lab[..., 0] * 2.55).clip(0, 255).astype(np.uint8))
    out = {"original": bgr, "clahe_contrast": from_lab(np.dstack([light / 2.55, lab[..., 1:]])), "grayscale_bilateral": bilateral(gray), "sharpened": sharpened(bgr)}
    if min(gray.shape) < LARGE:
        out["adaptive_thresh"] = local_threshold(gray)
    degrees = skew(gray)
    if SKEW[0] < abs(degrees) < SKEW[1]:
        out["deskewed"] = rotated(bgr, -degrees)
    return out


VARIANTS = "id string, variant string, height int, width int, nChannels int, data binary"


def variants(images: DataFrame) -> DataFrame:
    """images (id, height, width, nChannels, data) -> VARIANTS, a row for each variant; pictures without pixels have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, h, w, c, data in zip(b["id"], b["height"], b["width"], b["nChannels"], b["data"]):
                if data is None or not h > 0 or not w > 0 or not c > 0 or len(data) < h * w * c:
                    continue
                px = np.frombuffer(data, np.uint8, int(h * w * c)).reshape(int(h), int(w), int(c))
                px = np.repeat(px[:, :, :1], 3, axis=2) if c < 3 else px[:, :, :3]
                rows = [(i, name, *v.shape[:2], 1 if v.ndim == 2 else 3, v.tobytes()) for name, v in all_variants(px).items()]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in VARIANTS.split(", ")])

    return images.select(F.col("id").cast("string").alias("id"), "height", "width", "nChannels", "data").mapInPandas(run, VARIANTS)


def recognised(images: DataFrame, engines: dict[str, Callable[[np.ndarray], list[tuple[str, float, float, float]]]]) -> DataFrame:
    """Regions of all variants by every engine: image_id, engine, variant, text, confidence, center_x, center_y, as ocr.regions takes them.

    An engine gets a picture of a variant's pixels and returns (text, confidence, x, y) of what it reads; one that fails reads nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, name, h, w, c, data in zip(b["id"], b["variant"], b["height"], b["width"], b["nChannels"], b["data"]):
                px = np.frombuffer(data, np.uint8).reshape((h, w) if c == 1 else (h, w, c))
                for engine, read in engines.items():
                    try:
                        rows += [(i, engine, name, *found) for found in read(px)]
                    except Exception:  # noqa: BLE001 - an engine of others
                        continue
            yield pd.DataFrame(rows, columns=["image_id", "engine", "variant", "text", "confidence", "center_x", "center_y"])

    return variants(images).mapInPandas(run, "image_id string, engine string, variant string, text string, confidence double, center_x double, center_y double")
