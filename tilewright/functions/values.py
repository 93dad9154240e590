"""Small values as Column expressions: options, flags, coordinates of masks and thumbnails, intensities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_int(s: Column) -> Column:
    """Whether a string reads as a whole number, with a sign and white space around it if need be."""
    return F.coalesce(F.trim(s).rlike(r"^[+-]?[0-9]+(?:_[0-9]+)*$"), F.lit(False))


def flag(s: Column) -> Column:
    """true or false of yes, true, t, y, 1 and no, false, f, n, 0 in any case; anything else raises."""
    low = F.lower(s)
    known = F.when(low.isin("yes", "true", "t", "y", "1"), True).when(low.isin("no", "false", "f", "n", "0"), False)
    return known.otherwise(F.raise_error(F.concat(F.lit("not a flag: "), F.coalesce(s, F.lit("null")))).cast("boolean"))


def options(s: Column, splitter: str = ",") -> Column:
    """array<struct<text, number>> of a list of options: number where the option is a whole number, else text."""
    number = lambda o: F.when(is_int(o), F.trim(o).cast("long"))
    return F.transform(F.split(s, F.lit("\\Q" + splitter + "\\E")), lambda o: F.struct(F.when(~is_int(o), o).alias("text"), number(o).alias("number")))


def mask_to_slide(v: Column, up_ratio: float | Column, level: int | Column = 0) -> Column:
    """A mask's coordinate in pixels of a pyramid level, 0 being the full image."""
    up, n = (x if isinstance(x, Column) else F.lit(x) for x in (up_ratio, level))
    return F.floor(up * v * F.pow(F.lit(0.5), n)).cast("long")


def slide_to_mask(v: Column, down_ratio: float | Column) -> Column:
    """A full image's coordinate in pixels of the mask."""
    return F.floor((down_ratio if isinstance(down_ratio, Column) else F.lit(down_ratio)) * v).cast("long")


def thumbnail(width: Column, height: Column, size: int) -> Column:
    """struct(w, h, below) of a thumbnail whose longer side is size: its sides, and how many levels below the full image to read it from (negative where the image is smaller)."""
    most = F.greatest(width, height)
    side = lambda v: F.when(v == most, F.lit(size)).otherwise(F.floor(v / most * size)).cast("int")
    return F.struct(side(width).alias("w"), side(height).alias("h"), F.floor(F.log2(most / size)).cast("int").alias("below"))


def intensities(rows: DataFrame, channels: str, by: str | None = None, high: float = 0.99) -> DataFrame:
    """rows with intensity: the sum of the channels' sizes, from the least (0) to the percentile `high` (1) over all rows, or those of the same `by`; what is beyond is cut off."""
    total = F.aggregate(channels, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    summed = rows.withColumn("_sum", total)
    keys = [by] if by else []
    ends = summed.groupBy(*keys).agg(F.min("_sum").alias("_low"), F.percentile("_sum", F.lit(high)).alias("_high"))
    joined = summed.join(ends, by) if by else summed.join(F.broadcast(ends))  # one row of two numbers
    span = F.col("_high") - F.col("_low")
    cut = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_sum") - F.col("_low")) / F.when(span != 0, span)))
    return joined.withColumn("intensity", F.coalesce(cut, F.lit(0.0))).drop("_sum", "_low", "_high")


def contained_by_sample(child: Column, parent: Column, n: int, seed: Column) -> Column:
    """Whether n points of child, chosen by a hash with the seed (all, if it has fewer), lie in or on the polygon parent. No point: true."""
    from .geometry import point_in_polygon

    chosen = F.slice(F.array_sort(F.transform(child, lambda p: F.struct(F.xxhash64(seed, p["x"], p["y"]).alias("k"), p.alias("p")))), 1, n)
    return F.forall(chosen, lambda c: point_in_polygon(c["p"]["x"], c["p"]["y"], parent) >= 0)
