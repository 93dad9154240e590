"""Tile grids and pyramid levels as generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qc_grid(slides: DataFrame, stride: int, drop_last: bool = True) -> DataFrame:
    """slide, x, y of every stride of slides (slide, width, height); drop_last leaves the last column and row out, as quality control does."""
    n = lambda size: F.ceil(F.col(size) / stride).cast("int") - (1 if drop_last else 0)
    ok = slides.where((n("width") > 0) & (n("height") > 0))
    rows = ok.withColumn("i", F.explode(F.sequence(F.lit(0), n("width") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), n("height") - 1)))
    return rows.select("slide", (F.col("i") * stride).alias("x"), (F.col("j") * stride).alias("y"))


def tile_grid(slides: DataFrame, tile: int, overlap: int = 0, seed: int | None = None) -> DataFrame:
    """slide, x, y, pos: tiles column by column, floor(size / step) + 1 each way; with a seed columns and rows are shuffled."""
    step = tile - overlap
    n = lambda size: F.floor(F.col(size) / step).cast("int")
    rows = slides.withColumn("i", F.explode(F.sequence(F.lit(0), n("width")))).withColumn("j", F.explode(F.sequence(F.lit(0), n("height"))))
    key = (lambda k: F.xxhash64(F.lit(seed), F.col(k))) if seed is not None else F.col
    pos = F.row_number().over(Window.partitionBy("slide").orderBy(key("i"), "i", key("j"), "j")) - 1
    return rows.select("slide", (F.col("i") * step).alias("x"), (F.col("j") * step).alias("y"), pos.alias("pos"))


def pyramid_tiles(slides: DataFrame, tile: int) -> DataFrame:
    """slide, level (0 is the smallest), col, row of every tile of a Deep Zoom pyramid: each level half the next, rounded up."""
    top = F.ceil(F.log2(F.greatest("width", "height").cast("double"))).cast("int")
    levels = slides.withColumn("top", top).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top"))))
    size = lambda k: F.ceil(F.col(k) / F.pow(F.lit(2.0), F.col("top") - F.col("level"))).cast("int")
    last = lambda k: F.ceil(size(k) / tile).cast("int") - 1
    return levels.withColumn("row", F.explode(F.sequence(F.lit(0), last("height")))).withColumn("col", F.explode(F.sequence(F.lit(0), last("width")))).select("slide", "level", "col", "row")


def fit_windows(images: DataFrame, tile: int, multiple: float = 2) -> DataFrame:
    """id, kind (pad, split, crop, whole), x, y of each window of images (id, w, h): short sides pad, very long ones split (the last window moves back inside), others crop at the centre."""
    w, h = F.col("w"), F.col("h")
    kind = F.when((w < tile) | (h < tile), "pad").when((h > tile * multiple) | (w > tile * multiple), "split").when((h > tile) | (w > tile), "crop").otherwise("whole")
    starts = lambda size: F.transform(F.sequence(F.lit(0), size - 1, F.lit(tile)), lambda i: F.when(i + tile < size, i).otherwise(size - tile))
    at = lambda size: F.when(F.col("kind") == "split", starts(size)).when(F.col("kind") == "crop", F.array(center_start(size, tile))).otherwise(F.array(F.lit(0)))
    rows = images.withColumn("kind", kind)
    return rows.withColumn("y", F.explode(at(h))).withColumn("x", F.explode(at(w))).select("id", "kind", "x", "y")


def center_start(size: Column, tile: int) -> Column:
    """Half of what is over, rounded half to even."""
    return F.bround((size - tile) / 2).cast("int")


def stack(points: DataFrame, levels: tuple[int, ...], tile: int) -> DataFrame:
    """slide, id, level, x, y: the corner of a tile around each point (of level 0) on every level."""
    rows = points.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels])))
    corner = lambda k: (F.col(k) * F.pow(F.lit(2.0), -F.col("level"))).cast("int") - tile // 2
    return rows.select("slide", "id", "level", corner("x").alias("x"), corner("y").alias("y"))


def nearest_level(wanted: DataFrame, levels: DataFrame) -> DataFrame:
    """slide, level whose resolution (mpp) is nearest to the wanted one; the first on ties."""
    # as many rows as there are slides: merged, which spills, and never broadcast, though their Parquet files look small
    rows = levels.join(wanted.hint("merge"), "slide")
    return rows.groupBy("slide").agg(F.min(F.struct(F.abs(F.col("mpp") - F.col("want")), F.col("level"))).alias("m")).select("slide", F.col("m.level").alias("level"))


def grid_extent(names: DataFrame) -> DataFrame:
    """slide, level, last_col, last_row from tile names col_row.format of any number of digits."""
    part = lambda i: F.regexp_extract("name", r"(\d+)_(\d+)\.", i).cast("int")
    return names.groupBy("slide", "level").agg(F.max(part(1)).alias("last_col"), F.max(part(2)).alias("last_row"))
