"""Regions of tiled pyramids: reading across tiles, writing back, cropping, rotating. Tiles are rows of `sources.pyramids.TILE`; overlap is the width that a tile shares with each neighbour.

A tile (col, row) covers size pixels from col * size on, and overlap more on every side that has a neighbour. Regions meet tiles by tile numbers in an equi-join, and each region is pasted
together by itself, so that no task holds more than one region and its tiles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.pyramids import TILE

REGION = "id bigint, slide string, level int, x int, y int, w int, h int, nch int, data binary"


def check_levels(tiles: DataFrame) -> DataFrame:
    """slide, levels: how many there are. Raises where they don't run from 0 to levels - 1 without a gap."""
    found = tiles.groupBy("slide").agg(F.count_distinct("level").alias("levels"), F.min("level").alias("lo"), F.max("level").alias("hi"))
    whole = (F.col("lo") == 0) & (F.col("hi") == F.col("levels") - 1)
    return found.select("slide", F.when(whole, F.col("levels")).otherwise(F.raise_error(F.concat(F.lit("levels with gaps: "), F.col("slide")))).cast("int").alias("levels"))


def level_sizes(tiles: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """slide, level, width, height, from the last tiles: what they hold behind their overlap is added to the columns and rows before them."""
    end = lambda k, n: F.max(F.struct(k, F.col(k) * size + F.col(n) - F.when(F.col(k) > 0, overlap).otherwise(0)))["col2"].cast("int")
    return tiles.groupBy("slide", "level").agg(end("col", "w").alias("width"), end("row", "h").alias("height"))


def region_bounds(regions: DataFrame, top: dict[str, int], centre: bool = False, at_level: bool = False) -> DataFrame:
    """regions (id, slide, level, x, y, w, h) with x, y as the upper left corner in pixels of their own level.

    Locations are in pixels of each slide's largest level (top, by slide) unless at_level; with centre they are the regions' middles. Halves go to the lower even number.
    """
    scale = F.lit(1.0)
    if not at_level:
        largest = F.create_map(*[v for s, n in top.items() for v in (F.lit(s), F.lit(n))])[F.col("slide")]
        scale = F.pow(F.lit(2.0), F.col("level") - largest)
    corner = lambda v, n: (F.bround(F.col(v) * scale) - (F.bround(F.col(n) / 2) if centre else F.lit(0))).cast("int")
    return regions.select("id", "slide", "level", corner("x", "w").alias("x"), corner("y", "h").alias("y"), "w", "h")


def _span(v: str, n: str, size: int, overlap: int):
    return F.sequence(F.greatest(F.lit(0), F.floor((F.col(v) - overlap) / size)).cast("int"), F.greatest(F.lit(0), F.floor((F.col(v) + F.col(n) - 1 + overlap) / size)).cast("int"))


def _image(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.h, row.w, row.nch)


def _row(out: np.ndarray, **names) -> dict:
    return {**names, "w": out.shape[1], "h": out.shape[0], "nch": out.shape[2], "data": np.ascontiguousarray(out).tobytes()}


def read_regions(tiles: DataFrame, regions: DataFrame, size: int, overlap: int = 0, border: int | str | None = None, first: DataFrame | None = None) -> DataFrame:
    """REGION rows for regions (id, slide, level, x, y, w, h) in pixels of their level.

    border says what lies where no tile is: a grey level, "min" or "max" of the region's pixels; None raises there. first: tiles that are taken in place of those of the same number
    (a target that is written in part). A region without any tile is all border, of three channels.
    """
    if first is not None:
        here = ["slide", "level", "col", "row"]
        tiles = first.unionByName(tiles.join(first.select(*here), here, "left_anti"))
    asked = regions.select("id", "slide", "level", *[F.col(k).cast("int").alias(k) for k in "xywh"])
    keyed = asked.withColumn("col", F.explode(_span("x", "w", size, overlap))).withColumn("row", F.explode(_span("y", "h", size, overlap)))
    there = tiles.select("slide", "level", "col", "row", F.struct("col", "row", "w", "h", "nch", "data").alias("tile"))
    pairs = keyed.join(there, ["slide", "level", "col", "row"], "left")

    def paste(key, frame):
        import pandas as pd

        a = frame.iloc[0]
        got = [t for t in frame["tile"] if t is not None]
        nch = int(got[0]["nch"]) if got else 3
        out, known = np.zeros((int(a.h), int(a.w), nch), np.uint8), np.zeros((int(a.h), int(a.w)), bool)
        for t in sorted(got, key=lambda t: (t["row"], t["col"])):
            p = np.frombuffer(t["data"], np.uint8).reshape(t["h"], t["w"], t["nch"])
            x, y = t["col"] * size - (overlap if t["col"] else 0) - a.x, t["row"] * size - (overlap if t["row"] else 0) - a.y
            x0, y0, x1, y1 = max(0, x), max(0, y), min(a.w, x + t["w"]), min(a.h, y + t["h"])
            if x1 > x0 and y1 > y0:
                out[y0:y1, x0:x1], known[y0:y1, x0:x1] = p[y0 - y : y1 - y, x0 - x : x1 - x], True
        if not known.all():
            if border is None:
                raise ValueError(f"region {a.id} of {a.slide} leaves its slide or lacks tiles")
            out[~known] = border if isinstance(border, int) else (out[known].min() if border == "min" else out[known].max()) if known.any() else 0
        return pd.DataFrame([_row(out, id=a.id, slide=a.slide, level=a.level, x=a.x, y=a.y)])

    return pairs.groupBy("id").applyInPandas(paste, REGION)


def retile(regions: DataFrame, size: int, overlap: int = 0, origin: tuple[int, int] = (0, 0)) -> DataFrame:
    """Pieces of REGION rows by the tile that they belong to: slide, level, col, row, and the piece's own x, y (from the origin), w, h, nch, data, id."""
    keyed = regions.withColumns({"x": F.col("x") - origin[0], "y": F.col("y") - origin[1]}).withColumn("col", F.explode(_span("x", "w", size, overlap))).withColumn("row", F.explode(_span("y", "h", size, overlap)))

    def cut(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples():
                p, x, y = _image(r), r.col * size - (overlap if r.col else 0), r.row * size - (overlap if r.row else 0)
                x0, y0, x1, y1 = max(x, r.x), max(y, r.y), min(r.x + r.w, (r.col + 1) * size + overlap), min(r.y + r.h, (r.row + 1) * size + overlap)
                if x1 > x0 and y1 > y0:
                    out.append(_row(p[y0 - r.y : y1 - r.y, x0 - r.x : x1 - r.x], id=r.id, slide=r.slide, level=r.level, col=r.col, row=r.row, x=x0 - x, y=y0 - y))
            yield pd.DataFrame(out, columns=["id", "slide", "level", "col", "row", "x", "y", "w", "h", "nch", "data"])

    return keyed.mapInPandas(cut, "id bigint, slide string, level int, col int, row int, x int, y int, w int, h int, nch int, data binary")


def write_regions(tiles: DataFrame, regions: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """tiles with the pixels of REGION rows in place of their own, in the order of ids (the largest on top). A region's part outside of all tiles is lost."""
    pieces = retile(regions, size, overlap).groupBy("slide", "level", "col", "row").agg(F.collect_list(F.struct("id", "x", "y", "w", "h", "nch", "data")).alias("pieces"))
    both = tiles.join(pieces, ["slide", "level", "col", "row"], "left")

    def overlay(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for t in frame.itertuples():
                p = _image(t).copy()
                for q in sorted(t.pieces if t.pieces is not None else [], key=lambda q: q["id"]):
                    part = np.frombuffer(q["data"], np.uint8).reshape(q["h"], q["w"], q["nch"])
                    h, w = min(q["h"], t.h - q["y"]), min(q["w"], t.w - q["x"])
                    if h > 0 and w > 0:
                        p[q["y"] : q["y"] + h, q["x"] : q["x"] + w] = part[:h, :w]
                out.append(_row(p, slide=t.slide, level=t.level, col=t.col, row=t.row))
            yield pd.DataFrame(out, columns=["slide", "level", "col", "row", "w", "h", "nch", "data"])

    return both.select("slide", "level", "col", "row", "w", "h", "nch", "data", "pieces").mapInPandas(overlay, TILE)


def process_regions(tiles: DataFrame, regions: DataFrame, fn, size: int, overlap: int = 0, border: int | str | None = None, first: DataFrame | None = None) -> DataFrame:
    """tiles after fn (h x w x nch uint8 to the same shape) has been over each region; see read_regions and write_regions. fn sees tiles as they were before."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            done = []
            for r in frame.itertuples():
                out = np.asarray(fn(_image(r)), np.uint8)
                if out.shape != (r.h, r.w, r.nch):
                    raise ValueError(f"region {r.id}: a shape of {out.shape} came back for {(r.h, r.w, r.nch)}")
                done.append(_row(out, id=r.id, slide=r.slide, level=r.level, x=r.x, y=r.y))
            yield pd.DataFrame(done, columns=["id", "slide", "level", "x", "y", "w", "h", "nch", "data"])

    read = read_regions(tiles, regions, size, overlap, border, first).mapInPandas(run, REGION)
    return write_regions(tiles if first is None else first.unionByName(tiles.join(first.select("slide", "level", "col", "row"), ["slide", "level", "col", "row"], "left_anti")), read, size, overlap)


def tiled(regions: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Tiles of images that REGION rows make together: x and y count from the image's corner; what no region covers is 0."""
    pieces = retile(regions, size, overlap)

    def join(key, frame):
        import pandas as pd

        w, h = int((frame["x"] + frame["w"]).max()), int((frame["y"] + frame["h"]).max())
        out = np.zeros((h, w, int(frame["nch"].iloc[0])), np.uint8)
        for q in sorted(frame.itertuples(), key=lambda q: q.id):
            out[q.y : q.y + q.h, q.x : q.x + q.w] = _image(q)
        return pd.DataFrame([_row(out, slide=key[0], level=key[1], col=key[2], row=key[3])])

    return pieces.groupBy("slide", "level", "col", "row").applyInPandas(join, TILE)


def _grid(boxes: DataFrame, size: int) -> DataFrame:
    """id, slide, level, x, y, w, h: boxes (slide, level, x, y, w, h) in pieces of about size x size, so that no task holds a whole level."""
    rows = boxes.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("w") - 1) / size).cast("int")))).withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.col("h") - 1) / size).cast("int"))))
    return rows.select(F.xxhash64("slide", "level", "i", "j").alias("id"), "slide", "level", (F.col("x") + F.col("i") * size).cast("int").alias("x"), (F.col("y") + F.col("j") * size).cast("int").alias("y"), F.least(F.lit(size), F.col("w") - F.col("i") * size).cast("int").alias("w"), F.least(F.lit(size), F.col("h") - F.col("j") * size).cast("int").alias("h"))


def crop(tiles: DataFrame, slide: str, level: int, corner: tuple[int, int], opposite: tuple[int, int], size: int, overlap: int = 0, new_size: int | None = None, new_overlap: int | None = None) -> DataFrame:
    """One level's tiles between two corners, both included, tiled anew. Both lie on the slide."""
    (x1, y1), (x2, y2) = corner, opposite
    new_size, new_overlap = new_size or size, overlap if new_overlap is None else new_overlap
    box = tiles.sparkSession.createDataFrame([(slide, level, x1, y1, x2 - x1 + 1, y2 - y1 + 1)], "slide string, level int, x int, y int, w int, h int")
    read = read_regions(tiles.where((F.col("slide") == slide) & (F.col("level") == level)), _grid(box, 4 * new_size), size, overlap)
    return tiled(read.withColumns({"x": F.col("x") - x1, "y": F.col("y") - y1}), new_size, new_overlap)


def rotated_patch(image: np.ndarray, at: tuple[float, float], centre: tuple[float, float], angle: float, corner: tuple[int, int], shape: tuple[int, int], border: int = 0) -> np.ndarray:
    """The patch of `shape` (h, w) whose corner is at `corner` after a clockwise turn by angle degrees about centre. image is the part of the source that begins at `at`; nearest pixels."""
    t = np.deg2rad(angle)
    y, x = np.mgrid[: shape[0], : shape[1]].astype(float)
    dx, dy = x + corner[0] - centre[0], y + corner[1] - centre[1]
    sx = np.rint(dx * np.cos(t) + dy * np.sin(t) + centre[0]).astype(int) - int(at[0])
    sy = np.rint(-dx * np.sin(t) + dy * np.cos(t) + centre[1]).astype(int) - int(at[1])
    ok = (sx >= 0) & (sy >= 0) & (sx < image.shape[1]) & (sy < image.shape[0])
    out = np.full((*shape, image.shape[2]), border, np.uint8)
    out[ok] = image[sy[ok], sx[ok]]
    return out


def rotate(tiles: DataFrame, slide: str, level: int, width: int, height: int, angle: float, size: int, overlap: int = 0, border: int = 0) -> DataFrame:
    """One level's tiles turned clockwise by angle degrees about the level's middle, in an image of the same size. Each output piece reads the box round what it takes from the source."""
    spark = tiles.sparkSession
    box = spark.createDataFrame([(slide, level, 0, 0, width, height)], "slide string, level int, x int, y int, w int, h int")
    pieces = _grid(box, 4 * size)
    t, cx, cy = np.deg2rad(angle), (width - 1) / 2, (height - 1) / 2
    corner = lambda i, j: (F.col("x") + (F.col("w") - 1) * i - cx, F.col("y") + (F.col("h") - 1) * j - cy)
    xs = [dx * float(np.cos(t)) + dy * float(np.sin(t)) + cx for dx, dy in (corner(i, j) for i in (0, 1) for j in (0, 1))]
    ys = [dx * float(-np.sin(t)) + dy * float(np.cos(t)) + cy for dx, dy in (corner(i, j) for i in (0, 1) for j in (0, 1))]
    low, high = (lambda v: F.floor(F.least(*v)).cast("int") - 1), (lambda v: F.ceil(F.greatest(*v)).cast("int") + 2)
    asked = pieces.select("id", "slide", "level", low(xs).alias("x"), low(ys).alias("y"), (high(xs) - low(xs)).alias("w"), (high(ys) - low(ys)).alias("h"))
    read = read_regions(tiles.where((F.col("slide") == slide) & (F.col("level") == level)), asked, size, overlap, border)
    both = read.join(pieces.select("id", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("w").alias("ow"), F.col("h").alias("oh")), "id")

    def turn(frames):
        import pandas as pd

        for frame in frames:
            done = [_row(rotated_patch(_image(r), (r.x, r.y), (cx, cy), angle, (r.ox, r.oy), (r.oh, r.ow), border), id=r.id, slide=r.slide, level=r.level, x=r.ox, y=r.oy) for r in frame.itertuples()]
            yield pd.DataFrame(done, columns=["id", "slide", "level", "x", "y", "w", "h", "nch", "data"])

    return tiled(both.mapInPandas(turn, REGION), size, overlap)


def rotcrop(tiles: DataFrame, slide: str, level: int, centre: tuple[int, int], shape: tuple[int, int], angle: float, size: int, overlap: int = 0, border: int = 0) -> DataFrame:
    """Tiles of a box of shape (w, h) about centre, after a clockwise turn by angle degrees about it: a crop that holds the turned box, the turn, and a crop of its middle."""
    w, h = shape
    t = np.deg2rad(angle)
    half = int(np.ceil((abs(w * np.cos(t)) + abs(h * np.sin(t)) + abs(w * np.sin(t)) + abs(h * np.cos(t))) / 2)) + 2
    side = 2 * half + 1
    box = tiles.sparkSession.createDataFrame([(slide, level, centre[0] - half, centre[1] - half, side, side)], "slide string, level int, x int, y int, w int, h int")
    read = read_regions(tiles.where((F.col("slide") == slide) & (F.col("level") == level)), _grid(box, 4 * size), size, overlap, border)
    outer = tiled(read.withColumns({"x": F.col("x") - (centre[0] - half), "y": F.col("y") - (centre[1] - half)}), size, 0)
    turned = rotate(outer, slide, level, side, side, angle, size, 0, border)
    x, y = half - w // 2, half - h // 2
    return crop(turned, slide, level, (x, y), (x + w - 1, y + h - 1), size, 0, size, overlap)


def thumbnail_level(width: int, height: int, most: int) -> tuple[int, tuple[int, int]]:
    """How many levels below the largest to read from, and the size that fits into most x most."""
    scale = max(width, height) / most
    return max(0, int(np.floor(np.log2(scale)))) if scale > 0 else 0, (max(1, int(width / scale)), max(1, int(height / scale)))


def resampled(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Nearest pixels."""
    ys, xs = (np.arange(h) * image.shape[0] // h), (np.arange(w) * image.shape[1] // w)
    return image[ys][:, xs]


def thumbnails(tiles: DataFrame, sizes: DataFrame, most: int, size: int, overlap: int = 0) -> DataFrame:
    """A REGION row for each slide: its picture within most x most. sizes: level_sizes of the tiles."""
    top = sizes.groupBy("slide").agg(F.max_by(F.struct("level", "width", "height"), "level").alias("t"))
    scale = F.greatest("t.width", "t.height") / most
    below = F.greatest(F.lit(0), F.floor(F.log2(scale)).cast("int"))
    asked = top.select("slide", (F.col("t.level") - below).alias("level"), F.greatest(F.lit(1), F.floor(F.col("t.width") / scale)).cast("int").alias("tw"), F.greatest(F.lit(1), F.floor(F.col("t.height") / scale)).cast("int").alias("th")).join(sizes, ["slide", "level"])
    asked = asked.select(F.xxhash64("slide").alias("id"), "slide", "level", F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").alias("w"), F.col("height").alias("h"), "tw", "th")
    read = read_regions(tiles, asked, size, overlap, 0).join(asked.select("id", "tw", "th"), "id")

    def shrink(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame([_row(resampled(_image(r), r.tw, r.th), id=r.id, slide=r.slide, level=r.level, x=0, y=0) for r in frame.itertuples()], columns=["id", "slide", "level", "x", "y", "w", "h", "nch", "data"])

    return read.mapInPandas(shrink, REGION)


def blank_tiles(grid: DataFrame, seed: int = 0, nch: int = 3) -> DataFrame:
    """TILE rows of one grey each for a grid (slide, level, col, row, w, h); a tile's grey depends on its place and the seed only."""
    grey = F.pmod(F.xxhash64(F.lit(seed), "slide", "level", "col", "row"), F.lit(256)).cast("int")
    data = F.unhex(F.repeat(F.lpad(F.hex(grey), 2, "0"), F.col("w") * F.col("h") * nch))
    return grid.select("slide", "level", "col", "row", "w", "h", F.lit(nch).alias("nch"), data.alias("data"))
