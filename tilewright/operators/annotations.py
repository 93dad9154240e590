"""Annotation sets as rows slide, layer, pos (order within the layer) and item columns: layers, concatenation, splits, merging, shrinking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rename_layer(items: DataFrame, old: str, new: str) -> DataFrame:
    return items.withColumn("layer", F.when(F.col("layer") == old, new).otherwise(F.col("layer")))


def remove_items(items: DataFrame, gone: DataFrame) -> DataFrame:
    """Items without those of gone (slide, layer, pos); positions close up."""
    left = items.join(gone, ["slide", "layer", "pos"], "left_anti")
    return left.withColumn("pos", F.row_number().over(Window.partitionBy("slide", "layer").orderBy("pos")) - 1)


def filter_items(items: DataFrame, *predicates: Column) -> DataFrame:
    """Items for which all predicates hold."""
    return items.where(reduce(lambda a, b: a & b, predicates))


def concatenate(first: DataFrame, second: DataFrame, join_layers: bool = True, project: str | None = None) -> DataFrame:
    """Slides of both sets: layers of the same name append the second's items after the first's; else the second's layers are renamed layer_project."""
    common = first.select("slide").distinct().intersect(second.select("slide").distinct())
    a, b = (df.join(common, "slide", "left_semi") for df in (first, second))
    if not join_layers:
        b = b.withColumn("layer", F.concat_ws("_", "layer", F.lit(project)))
    both = a.withColumn("_s", F.lit(0)).unionByName(b.withColumn("_s", F.lit(1)))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("slide", "layer").orderBy("_s", "pos")) - 1).drop("_s")


def merge_parts(parts: DataFrame) -> DataFrame:
    """Parts named slide_N.json joined again per exact slide in numeric order: columns name, layer, pos, ..."""
    rows = parts.withColumn("slide", F.regexp_replace("name", r"_\d+\.json$", "")).withColumn("_n", F.regexp_extract("name", r"_(\d+)\.json$", 1).cast("int"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("slide", "layer").orderBy("_n", "pos")) - 1).drop("_n", "name")


def split_parts(items: DataFrame, n: int, least: int = 0) -> DataFrame:
    """items with part 0..n-1: contiguous, the first of them one longer; a layer of fewer than least items is repeated in every part."""
    w = Window.partitionBy("slide", "layer")
    rows = items.withColumn("_n", F.count("*").over(w)).withColumn("part", F.ntile(n).over(w.orderBy("pos")) - 1)
    parts = F.when(F.col("_n") < least, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array("part"))
    return rows.withColumn("part", F.explode(parts)).drop("_n")


def split_size(items: DataFrame, size: int) -> DataFrame:
    """items with part: at most size items each."""
    rn = F.row_number().over(Window.partitionBy("slide", "layer").orderBy("pos"))
    return items.withColumn("part", F.floor((rn - 1) / size).cast("int"))


def strips(regions: DataFrame, n: int) -> DataFrame:
    """slide, part, x, y, w, h: n strips of int(length / n) along the longer side of each region (slide, x, y, w, h)."""
    wide = F.col("w") >= F.col("h")
    rows = regions.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_l", F.floor(F.greatest("w", "h") / n).cast("long"))
    return rows.select("slide", "part", F.when(wide, F.col("x") + F.col("part") * F.col("_l")).otherwise(F.col("x")).alias("x"), F.when(wide, F.col("y")).otherwise(F.col("y") + F.col("part") * F.col("_l")).alias("y"), F.when(wide, F.col("_l")).otherwise(F.col("w")).alias("w"), F.when(wide, F.col("h")).otherwise(F.col("_l")).alias("h"))


def gaps(points: DataFrame, key: str = "id") -> DataFrame:
    """points (key, idx, x, y) with gap: the distance to the next point; null for the last."""
    w = Window.partitionBy(key).orderBy("idx")
    return points.withColumn("gap", F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")))


def shrink_paths(points: DataFrame, factor: float = 0.5, min_density: float = 0.1, min_points: int = 10, key: str = "id") -> DataFrame:
    """Without the n - round(n * (1 - factor)) points that begin the shortest gaps (ties: the earlier), for paths longer than min_points and dense enough. Paths of one point go."""
    w = Window.partitionBy(key)
    span = lambda k: F.max(F.col(k).cast("int")).over(w) - F.min(F.col(k).cast("int")).over(w) + 1
    rows = gaps(points, key).withColumns({"n": F.count("*").over(w), "area": span("x") * span("y")}).where("n > 1")
    shrunk = (F.col("n") / 4 / F.sqrt("area") >= min_density) & (F.col("n") > min_points)
    rank = F.row_number().over(w.orderBy(F.col("gap").asc_nulls_last(), "idx"))
    gone = F.col("n") - F.bround(F.col("n") * (1 - factor)).cast("int")
    return rows.withColumn("rank", rank).where(~shrunk | (F.col("rank") > gone) | F.col("gap").isNull()).select(*points.columns)


def paint_order(items: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """items with paint: outer classes first, so that the innermost is painted last."""
    rank = reduce(lambda c, kv: c.when(F.col("layer") == kv[0], kv[1]), ranks.items(), F.when(F.lit(False), -1)).otherwise(len(ranks))
    return items.withColumn("paint", F.row_number().over(Window.partitionBy("slide").orderBy(rank, "pos", "id")))


def places(ids: DataFrame, order: str) -> DataFrame:
    """ids with place (from 0, by order) and total. Sorted by range; each range counts its rows, and only those counts meet in one task."""
    rows = ids.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    ahead = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return rows.withColumn("_at", within).join(ahead, "_p").withColumn("place", F.col("_at") + F.col("_before")).drop("_p", "_at", "_before")


def kfold(ids: DataFrame, k: int, by: str | None = None, order: str = "id") -> DataFrame:
    """fold, id, role: contiguous folds in the order of ids, with by in each stratum; every id is test in one fold and train in the others. The first folds are one longer where k doesn't divide."""
    if by:
        own = ids.withColumn("_own", F.ntile(k).over(Window.partitionBy(by).orderBy(order)) - 1)
    else:
        longer, size = F.col("total") % k, F.floor(F.col("total") / k)
        head = longer * (size + 1)
        fold = F.when(F.col("place") < head, F.floor(F.col("place") / (size + 1))).otherwise(longer + F.floor((F.col("place") - head) / F.greatest(size, F.lit(1))))
        own = places(ids, order).withColumn("_own", fold.cast("int")).drop("place", "total")
    return own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("role", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train")).drop("_own")


def add_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """items with those of new (slide, layer and item columns but pos) behind the last of their layer; a layer that isn't there yet begins at 0. A null class is the layer's name."""
    last = items.groupBy("slide", "layer").agg((F.max("pos") + 1).alias("_next"))
    order = F.row_number().over(Window.partitionBy("slide", "layer").orderBy(*[c for c in ("rank", "class") if c in new.columns] or ["layer"])) - 1
    added = new.withColumn("_k", order).join(last, ["slide", "layer"], "left").withColumn("pos", (F.coalesce("_next", F.lit(0)) + F.col("_k")).cast(items.schema["pos"].dataType))
    added = added.withColumn("class", F.coalesce("class", "layer")) if "class" in added.columns else added
    return items.unionByName(added.drop("_k", "_next", "rank"), allowMissingColumns=True)


def replace_last(items: DataFrame, points: DataFrame) -> DataFrame:
    """items whose last one of each layer has the points of points (slide, layer, points)."""
    last = Window.partitionBy("slide", "layer")
    rows = items.withColumn("_last", F.col("pos") == F.max("pos").over(last)).join(points.withColumnRenamed("points", "_points"), ["slide", "layer"], "left")
    return rows.withColumn("points", F.when(F.col("_last") & F.col("_points").isNotNull(), F.col("_points")).otherwise(F.col("points"))).select(*items.columns)


def layer_index(layers: DataFrame, name: str) -> DataFrame:
    """slide, layer_idx of the first layer of that name; slides without one raise. layers: slide, layer_idx, layer."""
    found = layers.groupBy("slide").agg(F.min(F.when(F.col("layer") == name, F.col("layer_idx"))).alias("layer_idx"))
    return found.select("slide", F.when(F.col("layer_idx").isNotNull(), F.col("layer_idx")).otherwise(F.raise_error(F.concat(F.lit(f"no layer {name} in "), F.col("slide")))).cast("int").alias("layer_idx"))


def contents(layers: DataFrame, items: DataFrame) -> DataFrame:
    """slide, layers, items, empty: how many layers and items a slide has, and whether it has none of the latter."""
    n = items.groupBy("slide").agg(F.count("*").alias("items"))
    return layers.groupBy("slide").agg(F.count("*").alias("layers")).join(n, "slide", "left").fillna(0, ["items"]).withColumn("empty", F.col("items") == 0)


def whole_reviews(parts: DataFrame, num_splits: int) -> DataFrame:
    """parts (name, ...) of slides with exactly num_splits part files; another number raises."""
    stem = F.regexp_replace("name", r"_\d+\.json$", "")
    counts = parts.where(F.col("name").rlike(r"_\d+\.json$")).groupBy(stem.alias("_stem")).agg(F.count_distinct("name").alias("_n"))
    ok = F.when(F.col("_n") == num_splits, True).otherwise(F.raise_error(F.concat(F.lit("wrong number of parts of "), F.col("_stem"))))
    return parts.withColumn("_stem", stem).join(counts, "_stem").where(ok).drop("_stem", "_n")


def with_layer_order(items: DataFrame) -> DataFrame:
    """items with layer_idx: layers numbered by name within each slide."""
    layers = items.select("slide", "layer").distinct().withColumn("layer_idx", F.row_number().over(Window.partitionBy("slide").orderBy("layer")) - 1)
    return items.join(layers, ["slide", "layer"])
