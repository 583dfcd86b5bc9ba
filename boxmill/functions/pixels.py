"""Small numpy helpers on a stack of equally sized tiles, shape (n, height, width[, 3]), BGR bytes."""

from __future__ import annotations

import numpy as np

# Hue, saturation and value bounds (inclusive) of the colour masks, hue in 0..180.
RED_BOUNDS = (((0, 100, 100), (10, 255, 255)), ((170, 100, 100), (180, 255, 255)))
GREEN_BOUNDS = (((35, 80, 80), (90, 255, 255)),)
YELLOW_BOUNDS = (((15, 80, 80), (35, 255, 255)),)

# Grey level above which a pixel is bright, and edge thresholds.
BRIGHT_LEVEL = 220
EDGE_LOW, EDGE_HIGH = 100, 200

GRID = 4


def to_gray(bgr: np.ndarray) -> np.ndarray:
    """8-bit luma with 15-bit fixed-point weights."""
    b, g, r = (bgr[..., i].astype(np.int32) for i in range(3))
    return (b * 3735 + g * 19235 + r * 9798 + (1 << 14)) >> 15


def to_hsv(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit hue (0..180), saturation and value, with 12-bit fixed-point division."""
    b, g, r = (bgr[..., i].astype(np.int32) for i in range(3))
    v = np.maximum(np.maximum(b, g), r)
    diff = v - np.minimum(np.minimum(b, g), r)
    levels = np.maximum(np.arange(256), 1)
    sat_scale = np.rint((255 << 12) / levels).astype(np.int32)
    hue_scale = np.rint((180 << 12) / (6.0 * levels)).astype(np.int32)
    s = (diff * np.where(v > 0, sat_scale[v], 0) + (1 << 11)) >> 12
    sector = np.where(v == r, g - b, np.where(v == g, b - r + 2 * diff, r - g + 4 * diff))
    h = (sector * np.where(diff > 0, hue_scale[diff], 0) + (1 << 11)) >> 12
    return np.where(h < 0, h + 180, h), s, v


def colour_mask(hsv: tuple[np.ndarray, ...], bounds) -> np.ndarray:
    """Union of the given hue-saturation-value boxes."""
    mask = np.zeros(hsv[0].shape, bool)
    for low, high in bounds:
        inside = np.ones_like(mask)
        for channel, lo, hi in zip(hsv, low, high):
            inside &= (channel >= lo) & (channel <= hi)
        mask |= inside
    return mask


def components(mask: np.ndarray) -> np.ndarray:
    """Label of the 8-connected component of every set pixel (smallest flat index in it); -1 elsewhere.

    Works on runs of set pixels in a row: runs of neighbouring rows that touch are joined, so the effort follows the number
    of runs and not the length of a component.
    """
    n, h, w = mask.shape
    label = np.full(mask.size, -1, np.int64)
    # One blank column ends every run, one blank row every tile.
    steps = np.diff(np.pad(mask, ((0, 0), (0, 1), (1, 1))).reshape(-1, w + 2).astype(np.int8), axis=1)
    row, start = np.nonzero(steps == 1)
    end = np.nonzero(steps == -1)[1]
    if not len(row):
        return label.reshape(mask.shape)
    line = row * (w + 2)
    first = np.searchsorted(line + end, line + (w + 2) + start, "left")
    many = np.maximum(np.searchsorted(line + start, line + (w + 2) + end, "right") - first, 0)
    upper = np.repeat(np.arange(len(row)), many)
    lower = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    root = _joined(len(row), upper, lower)
    flat = (row - row // (h + 1)) * w + start
    label[mask.ravel()] = np.repeat(flat[root], end - start)
    return label.reshape(mask.shape)


def _joined(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of the group of each of ``count`` items, with items a[k] and b[k] in one group."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == root[b]).all():
            return root
        for ends in (root[a], root[b]):
            np.minimum.at(root, ends, low)
        while not np.array_equal(root, root[root]):
            root = root[root]


def edge_map(gray: np.ndarray, low: int = EDGE_LOW, high: int = EDGE_HIGH) -> np.ndarray:
    """Canny edges: 3x3 Sobel with replicated border, L1 magnitude, non-maximum suppression, hysteresis."""
    p = np.pad(gray.astype(np.int32), ((0, 0), (1, 1), (1, 1)), mode="edge")
    h, w = gray.shape[1:]

    def at(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
        return a[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]

    gx = sum(k * (at(p, dy, 1) - at(p, dy, -1)) for dy, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (at(p, 1, dx) - at(p, -1, dx)) for dx, k in ((-1, 1), (0, 2), (1, 1)))
    strength = np.abs(gx) + np.abs(gy)
    m = np.pad(strength, ((0, 0), (1, 1), (1, 1)))
    ax, ay = np.abs(gx), np.abs(gy)
    flat = ay < ax * np.tan(np.pi / 8)
    steep = ay > ax * np.tan(3 * np.pi / 8)
    rising = (gx < 0) ^ (gy < 0)
    along_x = (strength > at(m, 0, -1)) & (strength >= at(m, 0, 1))
    along_y = (strength > at(m, -1, 0)) & (strength >= at(m, 1, 0))
    falling_diag = (strength > at(m, -1, -1)) & (strength > at(m, 1, 1))
    rising_diag = (strength > at(m, -1, 1)) & (strength > at(m, 1, -1))
    peak = np.where(flat, along_x, np.where(steep, along_y, np.where(rising, rising_diag, falling_diag)))
    candidate = peak & (strength > low)
    label = components(candidate)
    strong = np.zeros(candidate.size + 1, bool)
    strong[label[candidate & (strength > high)]] = True
    return candidate & strong[label]


def patch_means(values: np.ndarray) -> np.ndarray:
    """Means of a 4x4 grid of patches, shape (n, 16); pixels past the last whole patch are left out."""
    n, h, w = values.shape
    ph, pw = h // GRID, w // GRID
    part = values[:, : GRID * ph, : GRID * pw].astype(np.float64)
    return part.reshape(n, GRID, ph, GRID, pw).mean((2, 4)).reshape(n, GRID * GRID)


def blob_counts(mask: np.ndarray) -> np.ndarray:
    """Per tile: components of 2..20 pixels, components of 21..80 pixels, largest area; shape (n, 3)."""
    n, h, w = mask.shape
    found, areas = np.unique(components(mask)[mask], return_counts=True)
    owner = found // (h * w)
    largest = np.zeros(n, np.int64)
    np.maximum.at(largest, owner, areas)
    small = np.bincount(owner[(areas >= 2) & (areas <= 20)], minlength=n)
    medium = np.bincount(owner[(areas > 20) & (areas <= 80)], minlength=n)
    return np.stack([small, medium, largest], 1)


# The features in their order.
FEATURES = (
    "edge_density",
    "max_red",
    "max_green",
    "max_yellow",
    "max_bright",
    "max_edge",
    "top3_red",
    "top3_green",
    "bright_ratio",
    "small_blobs",
    "medium_blobs",
    "max_blob_area",
    "max_patch_brightness",
    "std_patch_brightness",
    "max_patch_edges",
    "upper_bright_ratio",
)


def tile_features(bgr: np.ndarray) -> np.ndarray:
    """The feature matrix of a stack of tiles, columns as in ``FEATURES``."""
    gray, hsv = to_gray(bgr), to_hsv(bgr)
    edges, bright = edge_map(gray), gray > BRIGHT_LEVEL
    red, green, yellow = (patch_means(colour_mask(hsv, b)) for b in (RED_BOUNDS, GREEN_BOUNDS, YELLOW_BOUNDS))
    bright_patches, edge_patches, gray_patches = patch_means(bright), patch_means(edges), patch_means(gray)

    def top3(scores: np.ndarray) -> np.ndarray:
        return np.sort(scores, 1)[:, -3:].mean(1)

    columns = [
        edges.mean((1, 2)),
        red.max(1), green.max(1), yellow.max(1), bright_patches.max(1), edge_patches.max(1), top3(red), top3(green),
        bright.mean((1, 2)),
        *blob_counts(bright).T,
        gray_patches.max(1), gray_patches.std(1), edge_patches.max(1),
        bright[:, : bgr.shape[1] // 2].mean((1, 2)),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)
