"""Merging of paths that tile borders cut apart.

Candidates come from the proximity join, each pair is stitched by itself, and pairs are chosen as a loop over items in their order would: a pair counts if no pair before it has one of its two
items. That choice needs no loop over items: in every round each pair that comes first for both of its items is chosen, and the pairs of those items go.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .spatial import proximity

ITEM = ("slide", "layer", "pos", "class", "points", "x", "y", "w", "h")


def close_points(near: np.ndarray, far: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of near and far points that belong together: each near point, in order, takes the nearest far one that is still free, if that is closer than within."""
    free = np.ones(len(far), bool)
    mine, theirs = [], []
    for i, p in enumerate(np.asarray(near, float)):
        d = np.where(free, np.hypot(*(np.asarray(far, float) - p).T), np.inf)
        k = int(d.argmin())
        if d[k] < within:
            free[k] = False
            mine.append(i)
            theirs.append(k)
    return np.array(mine, int), np.array(theirs, int)


def _end(points: np.ndarray, lowest: bool, leftmost: bool) -> tuple:
    """Of the points with the least (or largest) y the one with the least (or largest) x."""
    y = points[:, 1]
    row = points[y == (y.min() if lowest else y.max())]
    return tuple(row[row[:, 0].argmin() if leftmost else row[:, 0].argmax()])


def facing_ends(near: np.ndarray, far: np.ndarray, position: str, within: float) -> tuple | None:
    """Where the near path is left, where it is taken up again, and the same of the far path; None without close points. near is the left or upper one."""
    i, j = close_points(near, far, within)
    if not len(i):
        return None
    a, b = near[i], far[j]
    if position == "horizontal":
        return _end(a, True, False), _end(a, False, False), _end(b, False, True), _end(b, True, True)
    if position == "vertical":
        return _end(a, False, False), _end(a, False, True), _end(b, True, True), _end(b, True, False)
    raise ValueError(f"paths that are {position or 'apart'} have no facing sides")


def _walk(points: np.ndarray, start: tuple, end: tuple) -> np.ndarray:
    """From start round to before end; nothing if both are the same point."""
    at = lambda p: int(np.flatnonzero((points == p).all(1))[0])
    a, b = at(start), at(end)
    return points[a:b] if a <= b else np.concatenate([points[a:], points[:b]])


def stitched(near: np.ndarray, far: np.ndarray, position: str, within: float) -> np.ndarray | None:
    """The path round both, or None if they have no close points."""
    ends = facing_ends(near, far, position, within)
    return None if ends is None else np.concatenate([_walk(near, *ends[:2]), _walk(far, *ends[2:])])


def without_covered(far: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The points of far that don't lie in or on the polygon near."""
    a, b = near, np.roll(near, -1, 0)
    x, y = far[:, :1], far[:, 1:]
    side = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
    inbox = lambda v, k: (v >= np.minimum(a[:, k], b[:, k])) & (v <= np.maximum(a[:, k], b[:, k]))
    on = ((side == 0) & inbox(x, 0) & inbox(y, 1)).any(1)
    crosses = ((a[:, 1] <= y) != (b[:, 1] <= y)) & ((side > 0) == (b[:, 1] > a[:, 1]))
    return far[~(on | (crosses.sum(1) % 2 == 1))]


def lie(near: np.ndarray, far: np.ndarray, eps: float) -> tuple[str, bool]:
    """How the boxes of two point sets lie, within eps: horizontal (side by side), vertical (one above the other) or ''; and whether far is the left or upper one."""
    (ax, ay), (bx, by) = near.min(0), far.min(0)
    (aw, ah), (bw, bh) = near.max(0), far.max(0)
    held = lambda l, h, m, n: (l - eps <= m and n <= h + eps) or (m - eps <= l and h <= n + eps)
    meet = lambda l, h, m, n: m <= h + eps and l <= n + eps
    if not held(ax, aw, bx, bw) and meet(ay, ah, by, bh) and (aw <= bx + eps or bw <= ax + eps):
        return "horizontal", bool(aw > bx + eps)
    if not held(ay, ah, by, bh) and meet(ax, aw, bx, bw) and (ah <= by + eps or bh <= ay + eps):
        return "vertical", bool(ah > by + eps)
    return "", False


def pair_path(near: np.ndarray, far: np.ndarray, relation: str, within: float, eps: float = 10) -> np.ndarray | None:
    """The path round both. Of paths of overlapping tiles what the near one covers of the far one goes first, and the boxes of what is left say how the two lie."""
    if relation == "overlap":
        far = without_covered(far, near)
        if not len(far):
            return None
        relation, turned = lie(near, far, eps)
        near, far = (far, near) if turned else (near, far)
    return stitched(near, far, relation, within) if relation else None


def stitch_pairs(items: DataFrame, centroids_within: float, points_within: float) -> DataFrame:
    """slide, layer, a, b, points for every ordered pair of items that can be stitched; a and b are positions, a's is the item that is looked at first."""
    shapes = items.select("slide", "layer", "pos", "points", F.struct("x", "y", "w", "h").alias("tile"))
    group = F.struct("slide", "layer")
    middle = g.centroid(F.col("points"))
    area = g.polygon_area(F.col("points"))
    circles = shapes.where(F.size("points") > 0).select(group.alias("slide"), F.col("pos").alias("id"), F.coalesce(middle["x"], F.lit(0.0)).alias("x"), F.coalesce(middle["y"], F.lit(0.0)).alias("y"), F.sqrt(area / np.pi).alias("r"))
    pairs = proximity(circles, centroids_within).select("slide.*", "a", "b")
    both = pairs.unionByName(pairs.select("slide", "layer", F.col("b").alias("a"), F.col("a").alias("b")))
    side = lambda k: shapes.select("slide", "layer", F.col("pos").alias(k), F.col("points").alias(f"p{k}"), F.col("tile").alias(f"t{k}"))
    both = both.join(side("a"), ["slide", "layer", "a"]).join(side("b"), ["slide", "layer", "b"])
    relation, origin = g.rect_relation(tuple(F.col(f"ta.{k}") for k in "xywh"), tuple(F.col(f"tb.{k}") for k in "xywh"))
    both = both.withColumns({"relation": relation, "origin": origin}).where("relation <> '' AND relation <> 'contained'")
    both = both.select("slide", "layer", "a", "b", "relation", *[F.when(F.col("origin") == k, F.col("pa")).otherwise(F.col("pb")).alias(n) for k, n in ((0, "near"), (1, "far"))])

    def run(frames):
        import pandas as pd

        points = lambda ps: np.array([(p["x"], p["y"]) for p in ps], float)
        for frame in frames:
            made = [pair_path(points(n), points(f), r, points_within) for n, f, r in zip(frame["near"], frame["far"], frame["relation"], strict=True)]
            out = frame[["slide", "layer", "a", "b"]].assign(points=[None if m is None else [{"x": x, "y": y} for x, y in m.tolist()] for m in made])
            yield pd.DataFrame(out[[m is not None for m in made]])

    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    return both.mapInPandas(run, f"slide {kinds['slide']}, layer {kinds['layer']}, a {kinds['a']}, b {kinds['b']}, points array<struct<x:double,y:double>>")


def first_pairs(pairs: DataFrame, by: tuple[str, ...] = ("slide", "layer"), rounds: int = 1000) -> DataFrame:
    """The pairs (a, b) that a loop in the order of a, then b, would take if each item may be taken once."""
    left, chosen = pairs.select(*by, "a", "b").checkpoint(), None
    for _ in range(rounds):
        ends = left.select(*by, F.explode(F.array("a", "b")).alias("item"), F.struct("a", "b").alias("pair"))
        first = ends.groupBy(*by, "item").agg(F.min("pair").alias("pair"))
        taken = first.groupBy(*by, "pair").agg(F.count("*").alias("n")).where("n = 2").select(*by, "pair.*").checkpoint()
        if not taken.head(1):
            break
        chosen = taken if chosen is None else chosen.unionByName(taken)
        gone = taken.select(*by, F.explode(F.array("a", "b")).alias("item"))
        for end in ("a", "b"):
            left = left.join(gone.withColumnRenamed("item", end), [*by, end], "left_anti")
        left = left.checkpoint()
    else:
        raise RuntimeError("pairs did not settle")
    return left.limit(0) if chosen is None else chosen


def merge_paths(items: DataFrame, centroids_within: float = 300.0, points_within: float = 500.0, max_iter: int = 1) -> DataFrame:
    """items with stitched pairs in place of their parts, until nothing changes or max_iter times. items: ITEM; x, y, w, h is the tile that the path comes from.

    Each item is merged once in an iteration. Merged items come behind all others of their layer, in the order of their first part, whose class they have; their tile is the box round both tiles.
    Items of a radius of 1 or less, tiles apart or one inside the other are left alone. The session needs a checkpoint folder.
    """
    for _ in range(max_iter):
        pairs = stitch_pairs(items, centroids_within, points_within).checkpoint()
        taken = first_pairs(pairs)
        if not taken.head(1):
            break
        part = lambda k: items.select("slide", "layer", F.col("pos").alias(k), F.col("class").alias(f"class_{k}"), F.struct("x", "y", "w", "h").alias(f"t{k}"))
        made = taken.join(pairs, ["slide", "layer", "a", "b"]).join(part("a"), ["slide", "layer", "a"]).join(part("b"), ["slide", "layer", "b"])
        low = lambda k: F.least(f"ta.{k}", f"tb.{k}")
        far = lambda k, n: F.greatest(F.col(f"ta.{k}") + F.col(f"ta.{n}"), F.col(f"tb.{k}") + F.col(f"tb.{n}"))
        made = made.select("slide", "layer", F.col("a").alias("pos"), F.col("class_a").alias("class"), "points", low("x").alias("x"), low("y").alias("y"), (far("x", "w") - low("x")).alias("w"), (far("y", "h") - low("y")).alias("h"))
        gone = taken.select("slide", "layer", F.explode(F.array("a", "b")).alias("pos"))
        rest = items.select(*ITEM).join(gone, ["slide", "layer", "pos"], "left_anti")
        order = Window.partitionBy("slide", "layer").orderBy("new", "pos")
        both = rest.withColumn("new", F.lit(0)).unionByName(made.withColumn("new", F.lit(1)))
        items = both.withColumn("pos", (F.row_number().over(order) - 1).cast(items.schema["pos"].dataType)).select(*ITEM).checkpoint()
    return items
