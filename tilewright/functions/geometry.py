"""Geometry as Column expressions: rectangles, polygons (array<struct<x,y>>), pyramid coordinates. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


# -- rectangles: four columns x, y, w, h --------------------------------------------------------------------------------------


def rect_relation(a: tuple, b: tuple, eps: float = 0) -> tuple[Column, Column]:
    """Relation of two rectangles (contained, horizontal, vertical, overlap or '') and which is the origin (0, 1 or null). Not symmetric: see rect_intersects."""
    (x0, y0, w0, h0), (x1, y1, w1, h1) = a, b
    r0, b0, r1, b1 = x0 + w0, y0 + h0, x1 + w1, y1 + h1
    x_over = x1.between(x0 - eps, r0 + eps) | r1.between(x0 - eps, r0 + eps)
    y_over = y1.between(y0 - eps, b0 + eps) | b1.between(y0 - eps, b0 + eps)
    x_in = (x1.between(x0 - eps, r0 + eps) & r1.between(x0 - eps, r0 + eps)) | (x0.between(x1 - eps, r1 + eps) & r0.between(x1 - eps, r1 + eps))
    y_in = (y1.between(y0, b0) & b1.between(y0, b0)) | ((y0 >= y1) & (y0 <= b1 + eps) & (b0 >= y1 - eps) & (b0 <= b1))
    side = ~x_in & y_over & ((r0 <= x1 + eps) | (r1 <= x0 + eps))
    stacked = ~y_in & x_over & ((b0 <= y1 + eps) | (b1 <= y0 + eps))
    pick = lambda first: F.when(first, 0).otherwise(1)
    relation = F.when(x_in & y_in, "contained").when(side, "horizontal").when(stacked, "vertical").when(x_over & y_over, "overlap").otherwise("")
    origin = F.when(x_in & y_in, pick(w0 * h0 >= w1 * h1)).when(side, pick(r0 <= x1 + eps)).when(stacked, pick(b0 <= y1 + eps)).when(x_over & y_over, pick(y0 <= y1))
    return relation, origin


def rect_intersects(a: tuple, b: tuple) -> Column:
    """Symmetric test of closed rectangles."""
    (x0, y0, w0, h0), (x1, y1, w1, h1) = a, b
    return (x0 <= x1 + w1) & (x1 <= x0 + w0) & (y0 <= y1 + h1) & (y1 <= y0 + h0)


def rect_contains(outer: tuple, inner: tuple) -> Column:
    """All four corners of inner lie in or on outer."""
    (x0, y0, w0, h0), (x1, y1, w1, h1) = outer, inner
    return (x1 >= x0) & (y1 >= y0) & (x1 + w1 <= x0 + w0) & (y1 + h1 <= y0 + h0)


def rect_points(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The corners: top left, bottom left, bottom right, top right."""
    p = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(p(x, y), p(x, y + h), p(x + w, y + h), p(x + w, y))


# -- polygons -----------------------------------------------------------------------------------------------------------------


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def unique_points(points: Column) -> Column:
    """First occurrences, in order, over the whole path."""
    return F.array_distinct(points)


def contour(points: Column) -> Column:
    """Points made different and only then cut to integers, toward zero."""
    return F.transform(F.array_distinct(points), lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y")))


def by_angle(points: Column) -> Column:
    """Points with both coordinates, sorted by angle around the origin from -pi to pi, the nearer first. Within a half plane the
    quotient of integer coordinates gives the order, so that equal angles are equal exactly."""

    def turned(p: Column) -> Column:
        x, y = p["x"].cast("double"), p["y"].cast("double")
        half = F.when(y < 0, 0).when((y == 0) & (x >= 0), 1).when(y > 0, 2).otherwise(3)
        return F.struct(half.alias("half"), F.when(y == 0, 0.0).otherwise(-x / y).alias("place"), (x * x + y * y).alias("reach"), p.alias("p"))

    whole = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.transform(F.array_sort(F.transform(whole, turned)), lambda t: t["p"])


def edges(points: Column) -> Column:
    """Array of (a, b) for each side, the closing one last."""
    return F.transform(points, lambda p, i: F.struct(p.alias("a"), F.get(points, (i + 1) % F.size(points)).alias("b")))


def pairwise(points: Column) -> Column:
    """Neighbours (a, b) along an open path."""
    return F.slice(F.transform(points, lambda p, i: F.struct(p.alias("a"), F.get(points, i + 1).alias("b"))), F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))


def _sum(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + term(e))


def _cross(e: Column) -> Column:
    d = lambda c: c.cast("double")
    return d(e["a"]["x"]) * d(e["b"]["y"]) - d(e["b"]["x"]) * d(e["a"]["y"])


def signed_area(points: Column) -> Column:
    return F.when(F.size(points) == 0, F.lit(0.0)).otherwise(_sum(edges(points), _cross) / 2)


def polygon_area(points: Column) -> Column:
    return F.abs(signed_area(points))


def centroid(points: Column) -> Column:
    """struct(x, y) by Green's formula; (0, 0) without points or area."""
    es = edges(points)
    mx, my = _sum(es, lambda e: (e["a"]["x"] + e["b"]["x"]) * _cross(e)), _sum(es, lambda e: (e["a"]["y"] + e["b"]["y"]) * _cross(e))
    return let(signed_area(points), lambda a: F.struct(F.when(a == 0, 0.0).otherwise(mx / (6 * a)).alias("x"), F.when(a == 0, 0.0).otherwise(my / (6 * a)).alias("y")))


def second_moments(points: Column) -> Column:
    """struct(m20, m02), raw, of the area taken as positive; both are 0 without area."""
    d = lambda c: c.cast("double")
    square = lambda e, axis: d(e["a"][axis]) * d(e["a"][axis]) + d(e["a"][axis]) * d(e["b"][axis]) + d(e["b"][axis]) * d(e["b"][axis])

    def moments(es: Column) -> Column:
        sign = F.signum(_sum(es, _cross))
        return F.struct(*[(_sum(es, lambda e: square(e, axis) * _cross(e)) / 12 * sign).alias(name) for axis, name in (("x", "m20"), ("y", "m02"))])

    # bound once: else points would be made again for every side
    return let(points, lambda p: let(edges(p), moments))


def ratio_below(points: Column, most: float) -> Column:
    """Both the moments' ratio and its inverse stay below most."""
    return let(second_moments(points), lambda m: F.coalesce((m["m20"] / F.nullif(m["m02"], F.lit(0.0)) < most) & (m["m02"] / F.nullif(m["m20"], F.lit(0.0)) < most), F.lit(False)))


def radius(points: Column) -> Column:
    return F.sqrt(polygon_area(points) / F.pi())


def bounding_rect(points: Column) -> Column:
    """struct(x, y, w, h) of integer points; w and h count pixels (max - min + 1)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs) + 1).alias("w"), (F.array_max(ys) - F.array_min(ys) + 1).alias("h"))


def point_in_polygon(px: Column, py: Column, points: Column) -> Column:
    """1 inside, 0 on a side, -1 outside. Exact for integers up to 2**26."""
    es = edges(points)
    wide = lambda c: c.cast("double")
    turn = lambda e: (wide(e["b"]["x"]) - e["a"]["x"]) * (wide(py) - e["a"]["y"]) - (wide(e["b"]["y"]) - e["a"]["y"]) * (wide(px) - e["a"]["x"])
    on = F.exists(es, lambda e: (turn(e) == 0) & px.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & py.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"])))
    up = lambda e: (e["a"]["y"] <= py) & (e["b"]["y"] > py) & (turn(e) > 0)
    down = lambda e: (e["a"]["y"] > py) & (e["b"]["y"] <= py) & (turn(e) < 0)
    winding = F.aggregate(es, F.lit(0), lambda n, e: n + F.when(up(e), 1).when(down(e), -1).otherwise(0))
    return F.when(on, 0).when(winding != 0, 1).otherwise(-1)


def shifted(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


# -- pyramid coordinates ------------------------------------------------------------------------------------------------------


def map_level(v: Column, src: Column, target: Column) -> Column:
    """A coordinate of one level on another; cut toward zero."""
    return (v * F.pow(F.lit(2.0), src - target)).cast("int")


def tile_origin(i: Column, tile: int, overlap: int) -> Column:
    return i * tile - overlap * (i > 0).cast("int")


def run_length(start: Column, end: Column, last: Column, last_length: Column, tile: int, overlap: int) -> Column:
    """Length of the tiles start..end joined, of last + 1 in all."""
    at_end, at_start = (end == last).cast("int"), (start == 0).cast("int")
    length = at_end * (last_length - 2 * overlap) + F.when(start == 0, tile + overlap).otherwise(2 * overlap) + (end - start + 1 - at_end - at_start) * tile
    short = (last_length < 2 * overlap) & (end == last - 1)
    return F.when(last == 0, last_length).otherwise(length - F.when(short, 2 * overlap - last_length).otherwise(0))


def point_tiles(x: Column, y: Column, tile: int, overlap: int, last_col: Column, last_row: Column) -> Column:
    """Array of (col, row, tx, ty): every tile whose overlapped extent holds the point, ends included. Candidates by arithmetic, no join."""

    def along(v: Column, last: Column) -> Column:
        near = F.sequence(F.greatest(F.lit(0), F.floor(v / tile).cast("int") - 1), F.least(last, F.floor(v / tile).cast("int") + 1))
        return F.filter(near, lambda i: (i * tile - overlap <= v) & (v <= (i + 1) * tile + overlap))

    cols, rows = along(x, last_col), along(y, last_row)
    return F.flatten(F.transform(cols, lambda c: F.transform(rows, lambda r: F.struct(c.alias("col"), r.alias("row"), (x - tile_origin(c, tile, overlap)).alias("tx"), (y - tile_origin(r, tile, overlap)).alias("ty")))))


def rotated_extent(w: Column, h: Column, angle: Column) -> tuple[Column, Column]:
    """Half width and half height that hold a w x h rectangle turned by angle degrees."""
    phi, turn, d = F.atan(h / w), F.radians(angle), F.sqrt(w * w + h * h) / 2
    widest = d * F.greatest(F.abs(F.cos(turn + phi)), F.abs(F.cos(turn - phi)))
    highest = d * F.greatest(F.abs(F.sin(turn + phi)), F.abs(F.sin(turn - phi)))
    return F.greatest(w / 2, widest), F.greatest(h / 2, highest)
