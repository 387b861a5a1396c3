"""What saving a picture as JPEG changes: blocks of 8 x 8 cosine coefficients, rounded to multiples.

Only the lossy steps are here, since entropy coding loses nothing.
"""

from __future__ import annotations

import numpy as np

# The standard's quantisation tables for brightness and colour, by rows.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
# Brightness and the two colour differences of red, green and blue.
YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])

_n = np.arange(8)
#: Row k holds the cosines of frequency k; its transpose is its inverse.
COSINES = np.where(_n[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _n[None, :] + 1) * _n[:, None] * np.pi / 16)


def steps(table: list[int], quality: int) -> np.ndarray:
    """The table at a quality of 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table).reshape(8, 8) * scale + 50) // 100, 1, 255)


def blocks(plane: np.ndarray) -> np.ndarray:
    """Blocks of 8 x 8 in rows, the last ones filled with the edge's pixels."""
    h, w = (-(-n // 8) for n in plane.shape)
    p = np.pad(plane, ((0, 8 * h - plane.shape[0]), (0, 8 * w - plane.shape[1])), mode="edge")
    return p.reshape(h, 8, w, 8).swapaxes(1, 2)


def coefficients(plane: np.ndarray) -> np.ndarray:
    return COSINES @ blocks(plane - 128.0) @ COSINES.T


def _saved(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    c = np.rint(coefficients(plane) / table) * table
    p = (COSINES.T @ c @ COSINES).swapaxes(1, 2)
    return np.clip(np.rint(p.reshape(p.shape[0] * 8, -1)[: plane.shape[0], : plane.shape[1]] + 128), 0, 255)


def saved(bgr: np.ndarray, quality: int = 90) -> np.ndarray:
    """bgr (height, width, 3, bytes) after saving: colours at half size both ways, all planes in blocks."""
    h, w = bgr.shape[:2]
    planes = np.einsum("kc,hwc->khw", YCC, bgr[..., ::-1].astype(float)) + np.array([0, 128, 128])[:, None, None]
    y = _saved(np.rint(planes[0]), steps(LUMA, quality))
    half = np.pad(planes[1:], ((0, 0), (0, h % 2), (0, w % 2)), mode="edge")
    half = np.rint(half.reshape(2, half.shape[1] // 2, 2, half.shape[2] // 2, 2).mean((2, 4)))
    cb, cr = (_saved(p, steps(CHROMA, quality)).repeat(2, 0).repeat(2, 1)[:h, :w] for p in half)
    rgb = np.einsum("kc,khw->hwc", np.linalg.inv(YCC).T, np.stack([y, cb - 128, cr - 128]))
    return np.clip(np.rint(rgb[..., ::-1]), 0, 255).astype(np.uint8)
