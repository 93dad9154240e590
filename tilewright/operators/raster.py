"""Pixel kernels in numpy, for Arrow batches of images."""

from __future__ import annotations

import numpy as np


def otsu(values: np.ndarray) -> int:
    """The level v that best parts v or less from more; the smallest on ties."""
    n = np.bincount(values.ravel(), minlength=256).astype(float)
    n0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    n1 = n0[-1] - n0
    ok = (n0 > 0) & (n1 > 0)
    if not ok.any():
        return 0
    d = np.zeros(256)
    d[ok] = n0[ok] * n1[ok] * (s0[ok] / n0[ok] - (s0[-1] - s0[ok]) / n1[ok]) ** 2
    return int(np.argmax(d))


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue 0..179, saturation and value 0..255 of h x w x 3 uint8."""
    c = rgb.astype(float)
    v, low = c.max(2), c.min(2)
    d = v - low
    safe = np.where(d == 0, 1, d)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    hue = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    return np.stack([np.where(d == 0, 0, hue % 180), np.where(v == 0, 0, d / np.where(v == 0, 1, v) * 255), v], 2).round()


def _slide_max(mask: np.ndarray, size: int, axis: int) -> np.ndarray:
    pad = [(0, 0)] * mask.ndim
    pad[axis] = (size // 2, size - 1 - size // 2)
    return np.lib.stride_tricks.sliding_window_view(np.pad(mask, pad), size, axis).max(-1)


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    return _slide_max(_slide_max(mask.astype(bool), size, 0), size, 1)


def close(mask: np.ndarray, size: int) -> np.ndarray:
    """Dilation, then erosion, by a square."""
    grown = dilate(np.pad(mask.astype(bool), size), size)
    return ~dilate(~grown, size)[size:-size, size:-size]


def components(mask: np.ndarray) -> np.ndarray:
    """Numbers of 4-connected regions from 1; 0 elsewhere. Label propagation by rows and columns until nothing changes."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = label.copy()
        for a, b in ((np.s_[1:], np.s_[:-1]), (np.s_[:-1], np.s_[1:]), (np.s_[:, 1:], np.s_[:, :-1]), (np.s_[:, :-1], np.s_[:, 1:])):
            both = (new[a] > 0) & (new[b] > 0)
            new[a] = np.where(both, np.minimum(new[a], new[b]), new[a])
        if (new == label).all():
            return np.unique(label, return_inverse=True)[1].reshape(mask.shape) if not mask.all() else np.ones(mask.shape, int)
        label = new


def drop_small(mask: np.ndarray, least: float) -> np.ndarray:
    label = components(mask)
    sizes = np.bincount(label.ravel())
    return mask & (sizes[label] >= least)


def is_tissue(rgb: np.ndarray, threshold: float = 0.4, saturation: float = 20, small: float = 0.2) -> bool:
    """Whether more than a share of the pixels are stained and the mean saturation is high enough."""
    c = hsv(rgb[..., :3])
    product = c.prod(2)
    if product.max() == 0:
        return False
    product = (product / product.max() * 255).astype(np.uint8)
    mask = drop_small(close(product > otsu(product), 20), rgb.shape[0] * small)
    return bool(mask.mean() > threshold and c[..., 1].mean() >= saturation)


def fill_polygon(points: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """uint8 mask of the pixels whose centres lie in the polygon or that a side crosses; points are clipped to the shape."""
    h, w = shape
    p = np.clip(np.asarray(points, int), 0, [w - 1, h - 1])
    out = np.zeros(shape, np.uint8)
    a, b = p, np.roll(p, -1, 0)
    for y in range(h):
        up = (a[:, 1] <= y) != (b[:, 1] <= y)
        if up.any():
            x = np.sort(a[up, 0] + (y - a[up, 1]) * (b[up, 0] - a[up, 0]) / (b[up, 1] - a[up, 1]))
            for x0, x1 in zip(x[::2], x[1::2], strict=True):
                out[y, int(np.ceil(x0)) : int(np.floor(x1)) + 1] = 1
    for (x0, y0), (x1, y1) in zip(a, b, strict=True):
        n = max(abs(x1 - x0), abs(y1 - y0)) + 1
        out[np.linspace(y0, y1, n).round().astype(int), np.linspace(x0, x1, n).round().astype(int)] = 1
    return out


def threshold_by_value(mask: np.ndarray, hierarchy: list, value: int) -> np.ndarray:
    """1 where the mask holds the value or one above it. hierarchy: from lowest to highest, tuples for equals."""
    levels = [set(v) if isinstance(v, tuple | list) else {v} for v in hierarchy]
    at = next(i for i, s in enumerate(levels) if value in s)
    above = set().union(*levels[at + 1 :], levels[at])
    return np.isin(mask, list(above)).astype(np.uint8)
