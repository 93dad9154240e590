"""Deep Zoom pyramids: metadata, tiles as rows, joining and halving of tiles, and PNG bytes without an image library."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = "slide string, level int, col int, row int, w int, h int, nch int, data binary"


def read_descriptor(spark: SparkSession, path: str) -> DataFrame:
    """slide, format, overlap, tile_size, width, height of .dzi files."""
    files = spark.read.text(path, wholetext=True).withColumn("slide", F.regexp_extract(F.input_file_name(), r"([^/]+)\.dzi$", 1))
    of = lambda k: F.regexp_extract("value", rf'\b{k}="([^"]*)"', 1)
    return files.select("slide", of("Format").alias("format"), *[of(k).cast("int").alias(n) for k, n in (("Overlap", "overlap"), ("TileSize", "tile_size"), ("Width", "width"), ("Height", "height"))])


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Rows of TILE from <slide>_files/<level>/<col>_<row>.<format> by Spark's image source; level is the folder's number, rows of pixels are blue-green-red."""
    at = lambda i: F.regexp_extract("image.origin", r"([^/]+)_files/(\d+)/(\d+)_(\d+)\.", i)
    rows = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    return rows.select(at(1).alias("slide"), at(2).cast("int").alias("level"), at(3).cast("int").alias("col"), at(4).cast("int").alias("row"), F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.nChannels").alias("nch"), F.col("image.data").alias("data"))


def png(pixels: np.ndarray) -> bytes:
    """h x w or h x w x 3 uint8 (red-green-blue) as a PNG file."""
    h, w = pixels.shape[:2]
    raw = np.ascontiguousarray(pixels).reshape(h, -1)
    lines = np.concatenate([np.zeros((h, 1), np.uint8), raw], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def halve(tiles: DataFrame) -> DataFrame:
    """The next smaller level of tiles without overlap: four tiles each become one of half their joined size, by means of two by two pixels."""
    keyed = tiles.withColumns({"_c": F.floor(F.col("col") / 2).cast("int"), "_r": F.floor(F.col("row") / 2).cast("int")})

    def join(key, frame):
        import pandas as pd

        slide, level, c, r = key
        parts = {(int(t.col) - 2 * c, int(t.row) - 2 * r): np.frombuffer(t.data, np.uint8).reshape(t.h, t.w, t.nch) for t in frame.itertuples()}
        left, top = parts[0, 0].shape[1], parts[0, 0].shape[0]
        w = left + (parts[1, 0].shape[1] if (1, 0) in parts else 0)
        h = top + (parts[0, 1].shape[0] if (0, 1) in parts else 0)
        whole = np.zeros((h + h % 2, w + w % 2, parts[0, 0].shape[2]), np.uint16)
        for (i, j), p in parts.items():
            whole[j * top : j * top + p.shape[0], i * left : i * left + p.shape[1]] = p
        if h % 2:
            whole[h] = whole[h - 1]
        if w % 2:
            whole[:, w] = whole[:, w - 1]
        half = ((whole[::2, ::2] + whole[1::2, ::2] + whole[::2, 1::2] + whole[1::2, 1::2] + 2) // 4).astype(np.uint8)
        return pd.DataFrame([{"slide": slide, "level": int(level) - 1, "col": int(c), "row": int(r), "w": half.shape[1], "h": half.shape[0], "nch": half.shape[2], "data": half.tobytes()}])

    return keyed.groupBy("slide", "level", "_c", "_r").applyInPandas(join, TILE)


def read_regions(tiles: DataFrame, regions: DataFrame, tile_size: int) -> DataFrame:
    """id, slide, w, h, nch, data of regions (id, slide, level, x, y, w, h) cut from tiles without overlap; what lies outside is 0. A region's tiles meet by their numbers."""
    span = lambda v, n: F.sequence(F.floor(F.col(v) / tile_size).cast("int"), F.floor((F.col(v) + F.col(n) - 1) / tile_size).cast("int"))
    asked = regions.select("id", "slide", "level", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("w").alias("rw"), F.col("h").alias("rh"), "x", "y", "w", "h")
    asked = asked.withColumn("col", F.explode(span("x", "w"))).withColumn("row", F.explode(span("y", "h"))).drop("x", "y", "w", "h")
    pairs = asked.join(tiles, ["slide", "level", "col", "row"])

    def paste(key, frame):
        import pandas as pd

        first = frame.iloc[0]
        out = np.zeros((int(first.rh), int(first.rw), int(first.nch)), np.uint8)
        for t in frame.itertuples():
            p = np.frombuffer(t.data, np.uint8).reshape(t.h, t.w, t.nch)
            x, y = t.col * tile_size - t.rx, t.row * tile_size - t.ry
            x0, y0 = max(0, x), max(0, y)
            x1, y1 = min(out.shape[1], x + t.w), min(out.shape[0], y + t.h)
            if x1 > x0 and y1 > y0:
                out[y0:y1, x0:x1] = p[y0 - y : y1 - y, x0 - x : x1 - x]
        return pd.DataFrame([{"id": key[0], "slide": first.slide, "w": out.shape[1], "h": out.shape[0], "nch": out.shape[2], "data": out.tobytes()}])

    return pairs.groupBy("id").applyInPandas(paste, "id bigint, slide string, w int, h int, nch int, data binary")
