"""Group-by summaries and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def layer_summary(contours: DataFrame, value: str) -> DataFrame:
    """layer, n, mean and population deviation of a value."""
    return contours.groupBy("layer").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """bin, n: equal bins of which the last is closed."""
    b = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def coverage(labels: DataFrame) -> DataFrame:
    """slide, coverage: the share of tissue tiles, 0 without tiles."""
    return labels.groupBy("slide").agg(F.avg((F.col("label") == "tissue").cast("double")).alias("coverage"))


def mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, mode: the most frequent value, the smallest on ties."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("mode"))


def otsu(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, threshold: the value v that best parts v or less from more, by the variance between the two; the smallest on ties. Windows run over a histogram."""
    h = df.groupBy(key, F.col(value).alias("v")).agg(F.count("*").cast("double").alias("n"))
    w, run = Window.partitionBy(key), Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({"n0": F.sum("n").over(run), "s0": F.sum(F.col("n") * F.col("v")).over(run), "all": F.sum("n").over(w), "sum": F.sum(F.col("n") * F.col("v")).over(w)}).where("n0 < all")
    d = F.col("s0") / F.col("n0") - (F.col("sum") - F.col("s0")) / (F.col("all") - F.col("n0"))
    between = F.round(F.col("n0") * (F.col("all") - F.col("n0")) / F.col("all") / F.col("all") * d * d, 6)
    return h.withColumn("b", between).groupBy(key).agg(F.max_by("v", F.struct("b", -F.col("v"))).alias("threshold"))


def class_counts(splits: DataFrame) -> DataFrame:
    """fold, role, value, n, with zeros for values that a part lacks."""
    parts = splits.groupBy(F.lit(1).alias("_k")).agg(F.collect_set(F.struct("fold", "role")).alias("ps"), F.collect_set("value").alias("vs"))  # folds and classes are few
    domain = parts.select(F.explode("ps").alias("p"), "vs").select("p.fold", "p.role", F.explode("vs").alias("value"))
    counts = splits.groupBy("fold", "role", "value").agg(F.count("*").alias("n"))
    return domain.join(counts, ["fold", "role", "value"], "left").select("fold", "role", "value", F.coalesce("n", F.lit(0)).alias("n"))
