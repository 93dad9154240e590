"""Spatial joins by grid buckets: an equi-join on cells, then the exact predicate. No cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

CELL = 64


def _cells(v: Column, length: Column, cell: int, eps: float = 0) -> Column:
    return F.sequence(F.floor((v - eps) / cell).cast("long"), F.floor((v + length + eps) / cell).cast("long"))


def with_cells(df: DataFrame, cell: int = CELL, eps: float = 0) -> DataFrame:
    """A row of df for each grid cell that its rectangle x, y, w, h touches: columns cx, cy."""
    return df.withColumn("cx", F.explode(_cells(F.col("x"), F.col("w"), cell, eps))).withColumn("cy", F.explode(_cells(F.col("y"), F.col("h"), cell, eps)))


def _level(size: Column, cell: float) -> Column:
    """0 for sizes up to cell, 1 up to twice that, and so on."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1e-9)) / cell))).cast("int")


def _levels(*frames: DataFrame) -> list[int]:
    """The different levels there are: a few dozen at most, as each stands for twice the size."""
    both = frames[0].select("level")
    for f in frames[1:]:
        both = both.unionByName(f.select("level"))
    return sorted(r["level"] for r in both.distinct().collect() if r["level"] is not None)


def rect_pairs(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("slide",), cell: int = CELL, eps: float = 0) -> DataFrame:
    """Pairs of rectangles whose boxes meet, each once: l.* and r.* as structs.

    A rectangle's level says how large cells it needs to touch few of them. It goes to the cells of its own level and of every coarser one that occurs, and two meet at the coarser of their
    levels, in the cell of their larger left and top edges. So a giant rectangle is a few rows too.
    """

    level = _level(F.greatest("w", "h"), cell)
    known = F.array(*[F.lit(n) for n in _levels(left.select(level.alias("level")), right.select(level.alias("level"))) or [0]])

    def spread(df: DataFrame, name: str) -> DataFrame:
        rows = df.withColumn("_level", level).withColumn("_at", F.explode(F.filter(known, lambda n: n >= level))).withColumn("_size", F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_at")))
        for c, v, n in (("_cx", "x", "w"), ("_cy", "y", "h")):
            rows = rows.withColumn(c, F.explode(F.sequence(F.floor((F.col(v) - eps) / F.col("_size")), F.floor((F.col(v) + F.col(n) + eps) / F.col("_size")))))
        return rows.select(*by, F.col("_at").alias("at"), F.col("_cx").alias("cx"), F.col("_cy").alias("cy"), F.struct(*df.columns).alias(name), F.col("_level").alias(f"{name}_level"))

    met = spread(left, "l").join(spread(right, "r"), [*by, "at", "cx", "cy"]).where(F.col("at") == F.greatest("l_level", "r_level"))
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("at"))
    edge = lambda axis: F.floor((F.greatest(F.col(f"l.{axis}"), F.col(f"r.{axis}")) - eps) / size)
    meet = F.lit(True)
    for v, n in (("x", "w"), ("y", "h")):
        for one, other in (("l", "r"), ("r", "l")):
            meet = meet & (F.col(f"{one}.{v}") - eps <= F.col(f"{other}.{v}") + F.col(f"{other}.{n}") + eps)
    return met.where((F.col("cx") == edge("x")) & (F.col("cy") == edge("y")) & meet).select("l", "r")


def sides(name: str) -> tuple:
    return tuple(F.col(f"{name}.{k}") for k in "xywh")


def overlaps(rects: DataFrame, different_labels: bool = True, cell: int = CELL) -> DataFrame:
    """slide, parent, child: child's box is held by parent's or overlaps it. Equal boxes, and with different_labels equal labels, don't count."""
    pairs = rect_pairs(rects, rects, cell=cell)
    relation, origin = g.rect_relation(sides("l"), sides("r"))
    same = F.lit(True)
    for k in "xywh":
        same = same & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    keep = ~same & (((relation == "contained") & (origin == 0)) | (relation == "overlap"))
    if different_labels:
        keep = keep & (F.col("l.layer") != F.col("r.layer"))
    return pairs.where(keep).select(F.col("l.slide").alias("slide"), F.col("l.id").alias("parent"), F.col("r.id").alias("child"))


def tile_contours(tiles: DataFrame, rects: DataFrame, cell: int = CELL) -> DataFrame:
    """slide, tile id, rect id wherever the boxes overlap or one holds the other."""
    relation, _ = g.rect_relation(sides("l"), sides("r"))
    return rect_pairs(tiles, rects, cell=cell).where(relation.isin("overlap", "contained")).select(F.col("l.slide").alias("slide"), F.col("l.id").alias("tile"), F.col("r.id").alias("rect"))


def origins_in_boxes(tiles: DataFrame, boxes: DataFrame, cell: int = 256) -> DataFrame:
    """Rows of tiles whose origin lies in or on a box of the same slide; each once."""
    spread = with_cells(boxes, cell).select("slide", "cx", "cy", *[F.col(k).alias(f"b{k}") for k in "xywh"])
    at = tiles.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    hit = F.col("x").between(F.col("bx"), F.col("bx") + F.col("bw")) & F.col("y").between(F.col("by"), F.col("by") + F.col("bh"))
    return at.alias("t").join(spread.alias("b"), (F.col("t.slide") == F.col("b.slide")) & (F.col("t.cx") == F.col("b.cx")) & (F.col("t.cy") == F.col("b.cy")) & hit, "left_semi").select(*tiles.columns).distinct()


def origins_in_contours(tiles: DataFrame, contours: DataFrame, patch: int, tolerance: float = 0.1, cell: int = 256) -> DataFrame:
    """Rows of tiles of which one of 5 x 5 origins, moved by up to tolerance * patch each way, lies in or on a contour (slide, points)."""
    boxed = contours.withColumn("_b", g.bounding_rect(F.col("points"))).select("slide", "points", *[F.col(f"_b.{k}").alias(k) for k in "xywh"])
    spread = with_cells(boxed, cell).select("slide", "cx", "cy", "points")
    steps = F.array(*[F.lit(int(tolerance * patch * k / 2)) for k in range(-2, 3)])
    moved = tiles.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumns({"px": F.col("x") + F.col("_dx"), "py": F.col("y") + F.col("_dy")})
    moved = moved.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    inside = g.point_in_polygon(F.col("px"), F.col("py"), F.col("points")) >= 0
    return moved.join(spread, ["slide", "cx", "cy"]).where(inside).select(*tiles.columns).distinct()


def strip_of(items: DataFrame, strips: DataFrame) -> DataFrame:
    """items with part: the first strip (slide, part, x, y, w, h) that overlaps or holds the item; items without one are left out."""
    relation, origin = g.rect_relation(sides("l"), sides("r"))
    pairs = strips.select("slide", F.struct(*strips.columns).alias("l")).join(items.select("slide", F.struct(*items.columns).alias("r")), "slide")
    hit = (relation == "overlap") | ((relation == "contained") & (origin == 0))
    return pairs.where(hit).groupBy("r").agg(F.min("l.part").alias("part")).select("r.*", "part")


def proximity(circles: DataFrame, within: float) -> DataFrame:
    """slide, a, b (a < b): distance of centroids less the radii, plus the mean sum of radii over all pairs, below within. circles: slide, id, x, y, r; those of r <= 1 count in the mean only.

    The mean over all pairs of a slide is twice its mean radius. Two circles meet at the level of the larger one, where a cell is as wide as two of that level can be apart, so three
    by three cells hold every partner, and a few large circles don't widen the cells of all others.
    """
    means = circles.groupBy("slide").agg((2 * F.avg("r")).alias("m"))
    c = circles.where("r > 1").select("slide", "id", "x", "y", "r", _level(F.col("r"), 1.0).alias("level"))
    known = F.array(*[F.lit(n) for n in _levels(c) or [0]])
    c = c.join(means, "slide").withColumn("at", F.explode(F.filter(known, lambda n: n >= F.col("level"))))
    c = c.withColumn("reach", F.greatest(F.lit(1.0), F.lit(within) + 2 * F.pow(F.lit(2.0), F.col("at")) - F.col("m")))
    c = c.withColumns({"cx": F.floor(F.col("x") / F.col("reach")), "cy": F.floor(F.col("y") / F.col("reach"))})
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    spread = c.withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
    spread = spread.select("slide", "at", (F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy"), F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("r").alias("br"), F.col("level").alias("b_level"))
    near = c.join(spread, ["slide", "at", "cx", "cy"]).where((F.col("id") < F.col("b")) & (F.col("at") == F.greatest("level", "b_level")))
    gap = g.distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")) - (F.col("r") + F.col("br") - F.col("m"))
    return near.where(gap < within).select("slide", F.col("id").alias("a"), "b")


def nearest_far(near: DataFrame, far: DataFrame, within: float) -> DataFrame:
    """For each near point (slide, id, x, y) the nearest far one of its slide closer than within: slide, id, far, d; ties to the smaller id. Cells as wide as within, three by three of them."""
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    cell = lambda k: F.floor(F.col(k) / within)
    n = near.withColumns({"cx": cell("x"), "cy": cell("y")})
    f = far.withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around)).select("slide", (cell("x") + F.col("_i")).alias("cx"), (cell("y") + F.col("_j")).alias("cy"), F.col("id").alias("far"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    pairs = n.join(f, ["slide", "cx", "cy"]).withColumn("d", g.distance(F.col("x"), F.col("y"), F.col("fx"), F.col("fy"))).where(F.col("d") < within)
    return pairs.groupBy("slide", "id").agg(F.min(F.struct("d", "far")).alias("m")).select("slide", "id", "m.far", "m.d")


def interval_label(values: DataFrame, intervals: DataFrame, strict: bool = False, most: int = 100_000) -> DataFrame:
    """values with label: the interval (lo, hi, label; half open) that holds v. strict: closed at both ends, and a value in none or two raises; equal values don't matter.

    The label table is counted before it is broadcast; one of more than `most` rows is refused.
    """
    if intervals.count() > most:
        raise ValueError(f"a label table has at most {most} rows")
    if not strict:
        return values.join(F.broadcast(intervals), (F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi")), "left").drop("lo", "hi")
    each = values.select(F.col("v").alias("own")).distinct()
    found = each.join(F.broadcast(intervals), F.col("own").between(F.col("lo"), F.col("hi")), "left").groupBy("own").agg(F.count("label").alias("n"), F.min("label").alias("label"))
    label = F.when(F.col("n") == 1, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("no single label for "), F.coalesce(F.col("own").cast("string"), F.lit("null")))))
    return values.join(found.select("own", label.alias("label")), F.col("v").eqNullSafe(F.col("own"))).drop("own")
