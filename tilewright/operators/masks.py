"""Masks and contours: borders of regions as paths, paths painted into masks, nested instances, smoothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import components, dilate, fill_polygon

#: Steps to the eight neighbours, clockwise in picture coordinates (y grows downwards), from the right.
AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def border(region: np.ndarray) -> np.ndarray:
    """The outer border of one 8-connected region as pixels (x, y) in order, from its first pixel by row and column. Moore's neighbour walk, until it is back where it was, in the same direction."""
    padded = np.pad(region.astype(bool), 1)
    ys, xs = np.nonzero(padded)
    start = at = (int(xs[0]), int(ys[0]))
    path, back, first = [at], 4, None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            nxt = (at[0] + AROUND[d][0], at[1] + AROUND[d][1])
            if padded[nxt[1], nxt[0]]:
                break
        else:
            break  # a single pixel
        if (at, nxt) == first:
            path.pop()
            break
        first = first or (at, nxt)
        at, back = nxt, (d + 4) % 8
        # the walk looks on from the pixel before the one it came from
        path.append(at)
    path = path[:-1] if len(path) > 1 and path[-1] == start else path
    return np.array(path) - 1


def straight_runs(points: np.ndarray) -> np.ndarray:
    """Without the points in the middle of straight runs."""
    if len(points) < 3:
        return points
    into, out = points - np.roll(points, 1, 0), np.roll(points, -1, 0) - points
    return points[(np.sign(into) != np.sign(out)).any(1)]


def regions8(mask: np.ndarray) -> np.ndarray:
    """Numbers of 8-connected regions from 1; 0 elsewhere."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        wide = np.pad(label, 1)
        best = np.max([wide[1 + dy : wide.shape[0] - 1 + dy, 1 + dx : wide.shape[1] - 1 + dx] for dx, dy in (*AROUND, (0, 0))], 0)
        new = np.where(mask, best, 0)
        if (new == label).all():
            return np.unique(np.append(label, 0), return_inverse=True)[1][:-1].reshape(mask.shape)
        label = new


def contours(mask: np.ndarray, values: dict[int, str], offset: tuple[float, float] = (0, 0), scale: float = 1.0, least: int = 3) -> list[dict]:
    """class, points and box of the outer border of every region of each value, in slide pixels: (pixel + offset) * scale. Borders of fewer than `least` points go."""
    out = []
    for value, name in values.items():
        label = regions8(mask == value)
        for n in range(1, int(label.max()) + 1):
            p = straight_runs(border(label == n))
            if len(p) < least:
                continue
            q = (p + np.asarray(offset)) * scale
            (x, y), (x1, y1) = q.min(0), q.max(0)
            out.append({"class": name, "points": [{"x": float(a), "y": float(b)} for a, b in q], "x": float(x), "y": float(y), "w": float(x1 - x), "h": float(y1 - y)})
    return out


CONTOUR = "class string, points array<struct<x:double,y:double>>, x double, y double, w double, h double"


def mask_contours(masks: DataFrame, values: dict[int, str], scale: float = 1.0, least: int = 3) -> DataFrame:
    """slide, id and CONTOUR for each region of each mask (slide, id, x, y, w, h, data with a byte for each pixel). A mask is one task's row; its offset is x, y."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [{"slide": m.slide, "id": m.id, **c} for m in frame.itertuples() for c in contours(np.frombuffer(m.data, np.uint8).reshape(m.h, m.w), values, (m.x, m.y), scale, least)]
            yield pd.DataFrame(rows, columns=["slide", "id", "class", "points", "x", "y", "w", "h"])

    return masks.select("slide", "id", "x", "y", "w", "h", "data").mapInPandas(run, f"slide {masks.schema['slide'].dataType.simpleString()}, id {masks.schema['id'].dataType.simpleString()}, {CONTOUR}")


def painted(shape: tuple[int, int], layers: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """A mask with each path (n x 2) filled with its value, later ones on top; parts outside are clipped, paths wholly outside leave nothing."""
    out = np.zeros(shape, np.uint8)
    for points, value in layers:
        p = np.asarray(points, int)
        if len(p) and (p.max(0) >= 0).all() and (p.min(0) < (shape[1], shape[0])).all():
            out[fill_polygon(p, shape) > 0] = value
    return out


def mark_point(mask: np.ndarray, x: int, y: int, value: int) -> np.ndarray:
    """A copy with a filled circle of radius sqrt(w * h) / 10, at least 1."""
    h, w = mask.shape
    r = max(1, int(np.sqrt(w * h) / 10))
    ys, xs = np.mgrid[:h, :w]
    return np.where((xs - x) ** 2 + (ys - y) ** 2 <= r * r, value, mask).astype(mask.dtype)


def instance_masks(items: DataFrame, children: DataFrame, values: dict[str, int]) -> DataFrame:
    """slide, id, x, y, w, h, data: a mask as large as each item's box, with the item and then those of its children that have a value and a smaller box painted, largest first.

    items: slide, id, class, points; children: slide, parent, child (overlaps of boxes). Items whose class has no value and paths of fewer than two points give none.
    """
    known = F.create_map(*[v for k, n in values.items() for v in (F.lit(k), F.lit(n))])
    shape = items.where(F.size("points") >= 2).select("slide", "id", known[F.col("class")].alias("value"), "points").where("value IS NOT NULL")
    inner = children.join(shape.select("slide", F.col("id").alias("child"), F.struct("points", "value", "id").alias("c")), ["slide", "child"])
    grouped = inner.groupBy("slide", F.col("parent").alias("id")).agg(F.collect_list("c").alias("inner"))
    rows = shape.join(grouped, ["slide", "id"], "left")

    def run(frames):
        import pandas as pd

        def of(ps):
            return np.array([(p["x"], p["y"]) for p in ps], float).astype(int)

        for frame in frames:
            out = []
            for r in frame.itertuples():
                own = of(r.points)
                low, size = own.min(0), own.max(0) - own.min(0) + 1
                area = lambda p: int(np.prod(p.max(0) - p.min(0) + 1))
                parts = [(of(c["points"]), int(c["value"]), c["id"]) for c in (r.inner if r.inner is not None else [])]
                parts = sorted((p for p in parts if area(p[0]) < int(np.prod(size))), key=lambda p: (-area(p[0]), p[2]))
                mask = painted((int(size[1]), int(size[0])), [(own - low, int(r.value)), *[(p - low, v) for p, v, _ in parts]])
                out.append({"slide": r.slide, "id": r.id, "x": int(low[0]), "y": int(low[1]), "w": mask.shape[1], "h": mask.shape[0], "data": mask.tobytes()})
            yield pd.DataFrame(out, columns=["slide", "id", "x", "y", "w", "h", "data"])

    return rows.mapInPandas(run, f"slide {items.schema['slide'].dataType.simpleString()}, id {items.schema['id'].dataType.simpleString()}, x int, y int, w int, h int, data binary")


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable gaussian of four sigmas each way; edges are mirrored."""
    n = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(image, [(n, n) if a == axis else (0, 0) for a in (0, 1)], "symmetric")
        image = np.tensordot(np.lib.stride_tricks.sliding_window_view(padded, 2 * n + 1, axis), k, 1)
    return image


def smoothed(mask: np.ndarray, hierarchy: list[int], sigma: float) -> np.ndarray:
    """Each value's area blurred and cut at a half, put together again from the lowest to the highest of the hierarchy."""
    out = np.zeros_like(mask)
    for value in hierarchy:
        out[gaussian((mask == value).astype(float), sigma) > 0.5] = value
    return out


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """With the parts of the background that don't reach the border."""
    outside = components(np.pad(~mask.astype(bool), 1, constant_values=True))
    return ~(outside == outside[0, 0])[1:-1, 1:-1]


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    """Erosion, then dilation, by a square."""
    return dilate(~dilate(~mask.astype(bool), size), size)
