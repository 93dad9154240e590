"""Annotation documents as JSON files, read to and written from rows of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM = (
    "STRUCT<class STRING, type STRING, closed BOOLEAN, color STRING, segments ARRAY<STRING>, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, "
    "`from` STRUCT<x DOUBLE, y DOUBLE>, `to` STRUCT<x DOUBLE, y DOUBLE>, center STRUCT<x DOUBLE, y DOUBLE>, radius DOUBLE>"
)
DOCUMENT = f"STRUCT<slide_id STRING, project_name STRING, name STRING, layer_names ARRAY<STRING>, data MAP<STRING, STRING>, layers ARRAY<STRUCT<name STRING, opacity DOUBLE, items ARRAY<{ITEM}>>>>"
WRAPPED = f"STRUCT<annotation {DOCUMENT}>"


def read_documents(spark: SparkSession, path: str, slide_ids: list[str] | None = None) -> DataFrame:
    """One row per file: file, slide_id and project_name (the file's stem where missing), name, data, layers, layer_names. The envelope {"annotation": ...} is opened.

    slide_ids keeps files whose name holds one of them.
    """
    files = spark.read.text(path, wholetext=True).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    if slide_ids is not None:
        hit = F.lit(False)
        for s in slide_ids:
            hit = hit | F.col("file").contains(s)
        files = files.where(hit)
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    doc = F.coalesce(F.from_json("value", WRAPPED)["annotation"], F.from_json("value", DOCUMENT))
    rows = files.select("file", stem.alias("stem"), doc.alias("d"))
    names = F.coalesce("d.layer_names", F.transform("d.layers", lambda x: x["name"]))
    return rows.select("file", F.coalesce("d.slide_id", "stem").alias("slide_id"), F.coalesce("d.project_name", "stem").alias("project_name"), "d.name", "d.data", "d.layers", names.alias("layer_names"))


def normalised_point(raw):
    """x and y of one segment: {"point": {"x", "y"}}, [[x, y], handles...] or [x, y]."""
    named = F.from_json(raw, "STRUCT<point STRUCT<x DOUBLE, y DOUBLE>>")["point"]
    nested, flat = F.from_json(raw, "ARRAY<ARRAY<DOUBLE>>"), F.from_json(raw, "ARRAY<DOUBLE>")
    first = F.get(nested, 0)
    pick = lambda k, i: F.coalesce(named[k], F.get(first, i), F.get(flat, i))
    return F.struct(pick("x", 0).alias("x"), pick("y", 1).alias("y"))


def items(documents: DataFrame) -> DataFrame:
    """slide, layer_idx, layer, pos, class, type, closed, color, points, x, y, w, h, cx, cy, r. Both rectangle forms give x, y, w, h; a class defaults to the layer's name."""
    layers = documents.select(F.col("slide_id").alias("slide"), F.posexplode("layers").alias("layer_idx", "l"))
    rows = layers.select("slide", "layer_idx", F.col("l.name").alias("layer"), F.posexplode("l.items").alias("pos", "i"))
    points = F.transform(F.coalesce("i.segments", F.array().cast("array<string>")), normalised_point)
    old = F.col("i.from").isNotNull()
    return rows.select(
        "slide", "layer_idx", "layer", "pos", F.coalesce("i.class", "layer").alias("class"), "i.type", "i.closed", "i.color", points.alias("points"),
        F.when(old, F.col("i.from.x")).otherwise(F.col("i.x")).alias("x"), F.when(old, F.col("i.from.y")).otherwise(F.col("i.y")).alias("y"),
        F.when(old, F.col("i.to.x") - F.col("i.from.x")).otherwise(F.col("i.width")).alias("w"), F.when(old, F.col("i.to.y") - F.col("i.from.y")).otherwise(F.col("i.height")).alias("h"),
        F.col("i.center.x").alias("cx"), F.col("i.center.y").alias("cy"), F.col("i.radius").alias("r"),
    )


def to_documents(rows: DataFrame, project: str) -> DataFrame:
    """slide, json: one document per slide. Two layers of the same name in one slide raise."""
    twice = F.count("*").over(Window.partitionBy("slide", "layer"))
    # null fields are left out of the JSON, so that circles have centre and radius, rectangles their sides, and paths their points only
    centre = F.when(F.col("cx").isNotNull(), F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"))).alias("center") if "cx" in rows.columns else F.lit(None).cast("string").alias("center")
    colour, radius = (F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("color", "r"))
    item = F.struct("class", "type", "closed", colour.alias("color"), centre, radius.alias("radius"), F.transform("points", lambda p: F.struct(p.alias("point"))).alias("segments"), "x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    layers = rows.groupBy("slide", "layer_idx", "layer").agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("i")))).alias("is"))
    layers = layers.withColumn("layer", F.when(twice == 1, F.col("layer")).otherwise(F.raise_error(F.concat(F.lit("layer named twice: "), "layer"))))
    layer = F.struct("layer_idx", F.struct(F.col("layer").alias("name"), F.lit(1.0).alias("opacity"), F.transform("is", lambda x: x["i"]).alias("items")).alias("l"))
    docs = layers.groupBy("slide").agg(F.transform(F.sort_array(F.collect_list(layer)), lambda x: x["l"]).alias("layers"))
    names = F.transform("layers", lambda x: x["name"])
    return docs.select("slide", F.to_json(F.struct(F.col("slide").alias("slide_id"), F.lit(project).alias("project_name"), names.alias("layer_names"), "layers")).alias("json"))


def file_name(slide: str, name: str = "", suffix_to_remove: tuple[str, ...] = (), rewrite: bool = False) -> str:
    """The file of a slide's document: suffixes go, then name is put behind it with an underscore, or in its place."""
    for suffix in suffix_to_remove:
        slide = slide.removesuffix(suffix)
    return f"{name if name and rewrite else '_'.join(x for x in (slide, name) if x)}.json"


def write_documents(rows: DataFrame, path: str, project: str, name: str = "", suffix_to_remove: tuple[str, ...] = (), rewrite: bool = False) -> list[str]:
    """Writes a JSON file for each slide into path, through the file system that path belongs to, and returns their names. Two slides of the same file name raise, as do two layers of the same name."""
    spark = rows.sparkSession
    docs = to_documents(rows, project).checkpoint()
    names = [file_name(r["slide"], name, suffix_to_remove, rewrite) for r in docs.select("slide").orderBy("slide").toLocalIterator()]
    if len(set(names)) < len(names):
        raise ValueError("two slides would be written to the same file")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path)
    for r in docs.toLocalIterator():  # one document in the driver at a time
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(fs_path, file_name(r["slide"], name, suffix_to_remove, rewrite)), True)
        try:
            out.write(r["json"].encode())
        finally:
            out.close()
    return names


def missing_metadata(documents: DataFrame, needed: tuple[str, ...] = ("tile_rect",)) -> DataFrame:
    """slide, missing: which of the needed keys a document's data lacks; slides that lack none are left out."""
    lacks = F.array_compact(F.array(*[F.when(F.col("data").isNull() | ~F.coalesce(F.map_contains_key("data", k), F.lit(False)), F.lit(k)) for k in needed]))
    return documents.select(F.col("slide_id").alias("slide"), lacks.alias("missing")).where(F.size("missing") > 0)
