"""Page images before they are read: grey levels as numpy arrays (height, width) of bytes.

These steps have no built-in form; ``operators.ocr.prepared`` runs them over Arrow batches.
"""

from __future__ import annotations

import numpy as np


def grey(pixels: np.ndarray) -> np.ndarray:
    """Grey levels of an RGB image by the usual luma weights; a grey one stays."""
    if pixels.ndim == 2:
        return pixels
    return ((pixels[..., :3].astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16).astype(np.uint8)


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


def _shifted(x: np.ndarray) -> np.ndarray:
    """The nine neighbours of each pixel, edges repeated."""
    padded = np.pad(x, 1, mode="edge")
    h, w = x.shape
    return np.stack([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def contrasted(x: np.ndarray, factor: float = 2.0) -> np.ndarray:
    """Levels drawn away from the mean level."""
    mean = int(x.mean() + 0.5)
    return _clipped(mean + factor * (x.astype(np.float64) - mean))


def sharpened(x: np.ndarray, factor: float = 2.0) -> np.ndarray:
    """Levels drawn away from a smoothed image, which is the image itself at its edges."""
    smooth = x.astype(np.float64)
    around = _shifted(x).astype(np.float64)
    inner = (around.sum(0) + 4 * around[4]) / 13
    smooth[1:-1, 1:-1] = np.floor(inner[1:-1, 1:-1] + 0.5)
    return _clipped(smooth + factor * (x - smooth))


def enhanced(pixels: np.ndarray) -> np.ndarray:
    """Grey, twice the contrast, twice the sharpness, and the median of each 3 by 3."""
    x = sharpened(contrasted(grey(pixels)))
    return np.median(_shifted(x), axis=0).astype(np.uint8)


def turned(x: np.ndarray, clockwise: int) -> np.ndarray:
    """The image after quarter turns, in degrees clockwise."""
    return np.rot90(x, -(clockwise // 90) % 4)


def ink_level(x: np.ndarray) -> int:
    """The level up to which a pixel is ink: the split with the largest variance between its sides."""
    counts = np.bincount(x.reshape(-1), minlength=256).astype(np.float64)
    below = np.cumsum(counts)
    sums = np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(invalid="ignore", divide="ignore"):
        between = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
    return int(np.argmax(np.nan_to_num(between)))


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of integer points (y, x), in order."""
    rows = np.unique(points[:, 0])
    order = np.lexsort((points[:, 1], points[:, 0]))
    y, x = points[order, 0], points[order, 1]
    first = np.searchsorted(y, rows)
    last = np.searchsorted(y, rows, side="right") - 1
    ends = list(zip(rows.tolist(), x[first].tolist())), list(zip(rows.tolist(), x[last].tolist()))
    out = []
    for side, sign in zip(ends, (1, -1)):
        chain: list[tuple[int, int]] = []
        for p in side:
            while len(chain) > 1 and sign * ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) <= 0:
                chain.pop()
            chain.append(p)
        out.append(chain)
    return np.array(out[0] + out[1][::-1], np.float64)


def tilt(x: np.ndarray, least_pixels: int = 100) -> tuple[int, float]:
    """Ink pixels, and the angle in degrees of the least rectangle around them, between -45 and 45; positive if lines fall to the right."""
    ink = np.argwhere(x <= ink_level(x))
    if len(ink) < least_pixels:
        return len(ink), 0.0
    corners = _hull(ink)
    edges = np.roll(corners, -1, axis=0) - corners
    edges = edges[(edges != 0).any(1)]
    angles = np.unique(np.round((np.degrees(np.arctan2(edges[:, 0], edges[:, 1])) + 45) % 90 - 45, 9))
    turn = np.radians(angles)[:, None]
    along = corners[:, 1] * np.cos(turn) + corners[:, 0] * np.sin(turn)
    across = corners[:, 0] * np.cos(turn) - corners[:, 1] * np.sin(turn)
    return len(ink), float(angles[np.argmin(np.ptp(along, axis=1) * np.ptp(across, axis=1))])


def rotated(x: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned about its middle by a small angle (clockwise is positive); edges repeated."""
    h, w = x.shape
    t = np.radians(degrees)
    yy, xx = np.mgrid[:h, :w].astype(np.float64)
    yy, xx = yy - h // 2, xx - w // 2
    y = np.clip(yy * np.cos(t) - xx * np.sin(t) + h // 2, 0, h - 1)
    x0 = np.clip(xx * np.cos(t) + yy * np.sin(t) + w // 2, 0, w - 1)
    i, j = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x0.astype(int), max(w - 2, 0))
    fy, fx = y - i, x0 - j
    i1, j1 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    return _clipped(np.floor(x[i, j] * (1 - fy) * (1 - fx) + x[i1, j] * fy * (1 - fx) + x[i, j1] * (1 - fy) * fx + x[i1, j1] * fy * fx + 0.5))


def deskewed(x: np.ndarray, least: float = 0.3, most: float = 15.0) -> tuple[np.ndarray, float]:
    """The image with its tilt taken out, and the turn that did it; tiny and implausible tilts stay."""
    _, angle = tilt(x)
    return (rotated(x, -angle), -angle) if least <= abs(angle) <= most else (x, 0.0)
