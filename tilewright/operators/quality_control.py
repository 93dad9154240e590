"""Quality control of slides: which tiles hold tissue, how the result is stored and checked, and the export of tiles with their masks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.pyramids import png
from .masks import painted
from .raster import is_tissue

LABELS = ("background", "tissue")


@dataclass(frozen=True)
class Options:
    """Microns per pixel of the check and of reading, the tile's size in pixels of reading, the share of tissue asked for and the least mean saturation."""

    qc_mpp: float = 2.0
    mpp: float = 0.4
    patch: int = 1024
    tissue: float = 0.4
    saturation: float = 25

    @property
    def qc_patch(self) -> int:
        return max(1, round(self.patch * self.mpp / self.qc_mpp))


def label_tiles(patches: DataFrame, options: Options = Options(), blurred=None, folded=None) -> DataFrame:  # noqa: B008
    """patches (id, slide, x, y, w, h, nch, data; pixels of the check) with label: tissue where enough of it is, else background; blurred and folded (of the pixels) come first if given."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples():
                p = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.nch)
                tissue = is_tissue(p, options.tissue, options.saturation)
                label = "background" if not tissue else "blur" if blurred and blurred(p) else "folded" if folded and folded(p) else "tissue"
                out.append({"id": r.id, "slide": r.slide, "x": r.x, "y": r.y, "label": label})
            yield pd.DataFrame(out, columns=["id", "slide", "x", "y", "label"])

    kind = patches.schema["slide"].dataType.simpleString()
    return patches.select("id", "slide", "x", "y", "w", "h", "nch", "data").mapInPandas(run, f"id bigint, slide {kind}, x int, y int, label string")


def coverage(labels: DataFrame) -> DataFrame:
    """slide, tiles, tissue, coverage."""
    return labels.groupBy("slide").agg(F.count("*").alias("tiles"), F.count_if(F.col("label") == "tissue").alias("tissue")).withColumn("coverage", F.col("tissue") / F.col("tiles"))


def documents(labels: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """slide, value: a JSON document for each slide, with the options and the label of every tile by the key "x,y"."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat_ws(",", "x", "y").alias("key"), "label"))))
    chosen = F.struct(*[F.lit(v).alias(k) for k, v in asdict(options).items()])
    return labels.groupBy("slide").agg(entries.alias("locations")).select("slide", F.to_json(F.struct(chosen.alias("options"), "locations")).alias("value"))


def write_documents(labels: DataFrame, path: str, options: Options = Options()) -> None:  # noqa: B008
    """The documents as text below path/slide=<slide>/; each slide's are replaced whole."""
    documents(labels, options).write.mode("overwrite").partitionBy("slide").text(path)


def read_documents(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:  # noqa: B008
    """slide, x, y, label of stored documents. Empty files count as missing. Raises where a document was made with another mpp; other options may differ (see `differing`)."""
    schema = "options STRUCT<qc_mpp DOUBLE, mpp DOUBLE, patch INT, tissue DOUBLE, saturation DOUBLE>, locations MAP<STRING, STRING>"
    rows = spark.read.option("wholetext", True).schema("value string, slide string").text(path).where(F.length(F.trim("value")) > 0)
    rows = rows.select("slide", F.from_json("value", schema).alias("d"))
    same = (F.col("d.options.qc_mpp") == options.qc_mpp) & (F.col("d.options.mpp") == options.mpp)
    checked = F.when(same, F.col("d.locations")).otherwise(F.raise_error(F.concat(F.lit("another mpp in the document of "), F.col("slide"))))
    at = lambda i: F.split_part("key", F.lit(","), F.lit(i)).cast("int")
    return rows.select("slide", F.explode(checked).alias("key", "label")).select("slide", at(1).alias("x"), at(2).alias("y"), "label")


def differing(stored: Options, session: Options) -> dict[str, tuple]:
    """The options in which a stored result and a session differ."""
    a, b = asdict(stored), asdict(session)
    return {k: (a[k], b[k]) for k in a if a[k] != b[k]}


def nth_tissue_tile(labels: DataFrame, slide, n: int) -> tuple[int, int] | None:
    """x, y of a slide's n-th tissue tile, by x and then y."""
    rows = labels.where((F.col("slide") == slide) & (F.col("label") == "tissue")).orderBy("x", "y").offset(n).limit(1).collect()
    return (rows[0].x, rows[0].y) if rows else None


def tile_files(patches: DataFrame, folder: str = "", extension: str = "png") -> DataFrame:
    """path, content: patches (slide, x, y, w, h, nch, data; blue-green-red as Spark's image source has them) as PNG files <folder>/<slide>/<x>_<y>.png. A table of files: any sink can write it."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples():
                p = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.nch)
                out.append({"path": "/".join(x for x in (folder.rstrip("/"), str(r.slide), f"{r.x}_{r.y}.{extension}") if x), "content": png(p[..., 0] if r.nch == 1 else np.ascontiguousarray(p[..., 2::-1]))})
            yield pd.DataFrame(out, columns=["path", "content"])

    return patches.select("slide", "x", "y", "w", "h", "nch", "data").mapInPandas(run, "path string, content binary")


def tile_masks(tiles: DataFrame, items: DataFrame, values: dict[str, int], least: float = 0.0) -> DataFrame:
    """slide, x, y, w, h, nch, data: for each tile (slide, id, x, y, w, h) the mask of the items (slide, id, class, points, x, y, w, h) whose boxes meet it, painted in the order of values, the last on top.

    Tiles of which less than `least` is painted are left out. Items of a class without a value are not painted.
    """
    from .spatial import rect_pairs

    pairs = rect_pairs(tiles.select("slide", "id", "x", "y", "w", "h"), items.where(F.col("class").isin(*values)).select("slide", "id", "class", "points", "x", "y", "w", "h"))
    rows = pairs.groupBy("l").agg(F.collect_list(F.struct("r.id", "r.class", "r.points")).alias("items")).select("l.slide", "l.x", "l.y", "l.w", "l.h", "items")
    order = list(values)

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples():
                mine = sorted(r.items, key=lambda i: (order.index(i["class"]), i["id"]))
                mask = painted((int(r.h), int(r.w)), [(np.array([(p["x"] - r.x, p["y"] - r.y) for p in i["points"]]), values[i["class"]]) for i in mine])
                if (mask > 0).mean() >= least:
                    out.append({"slide": r.slide, "x": int(r.x), "y": int(r.y), "w": int(r.w), "h": int(r.h), "nch": 1, "data": mask.tobytes()})
            yield pd.DataFrame(out, columns=["slide", "x", "y", "w", "h", "nch", "data"])

    return rows.mapInPandas(run, f"slide {tiles.schema['slide'].dataType.simpleString()}, x int, y int, w int, h int, nch int, data binary")


def sampled(items: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """About `most` items, each by the same chance, from a hash of its slide and id: reruns agree."""
    n = items.count()
    return items if n <= most else items.where(F.pmod(F.xxhash64(F.lit(seed), "slide", "id"), F.lit(1 << 30)) < int((1 << 30) * most / n))


def resolution(options: Options = Options()) -> str:  # noqa: B008
    """The document that goes with exported tiles."""
    return json.dumps({"mpp": options.mpp, "patch": options.patch})
