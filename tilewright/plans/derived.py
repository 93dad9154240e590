"""Annotation-like tables from the driver's, and their DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import by_angle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide, id, layer, pos, x, y, w, h from orders; a slide has 2,000 order keys, so slides grow in number and not in size."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        F.floor(k / 2000).cast("long").alias("slide"), k.alias("id"), F.col("o_orderstatus").alias("layer"), k.alias("pos"), (F.col("o_custkey") % 1500).alias("x"),
        F.floor(F.col("o_totalprice") / 100).cast("long").alias("y"), (5 + k % 40).alias("w"), (5 + (k * 7) % 40).alias("h"),
    )


RECTS = """rects AS (SELECT o_orderkey // 2000 AS slide, o_orderkey AS id, o_orderstatus AS layer, o_orderkey AS pos, o_custkey % 1500 AS x,
  CAST(floor(o_totalprice / 100) AS BIGINT) AS y, 5 + o_orderkey % 40 AS w, 5 + (o_orderkey * 7) % 40 AS h FROM orders)"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide, id, layer, points from embeddings: 32 integer points in the order of the vector, so that sides may cross; `rings` has them sorted."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: (F.get("embedding", i).cast("double") * 1000).cast("int")
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")))
    return e.select((F.col("vec_id") % 8).alias("slide"), F.col("vec_id").alias("id"), F.col("label").cast("int").alias("layer"), points.alias("points"))


POINTS = """pts AS (SELECT vec_id % 8 AS slide, vec_id AS id, CAST(label AS INT) AS layer, i AS idx,
  CAST(trunc(CAST(embedding[2 * i + 1] AS DOUBLE) * 1000) AS INT) AS x, CAST(trunc(CAST(embedding[2 * i + 2] AS DOUBLE) * 1000) AS INT) AS y FROM embeddings, range(0, 32) r(i)),
 sides AS (SELECT *, lead(x, 1) OVER w AS nx0, lead(y, 1) OVER w AS ny0, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM pts WINDOW w AS (PARTITION BY id ORDER BY idx)),
 edges AS (SELECT slide, id, layer, idx, x, y, coalesce(nx0, fx) AS nx, coalesce(ny0, fy) AS ny, CAST(x AS DOUBLE) * coalesce(ny0, fy) - CAST(coalesce(nx0, fx) AS DOUBLE) * y AS c FROM sides)"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """polygons with points sorted by angle around the origin so that sides don't cross, without those that lack a coordinate."""
    return polygons(spark, sf_dir).withColumn("points", by_angle(F.col("points")))


#: POINTS for rings: idx is the place by angle.
RING_POINTS = POINTS.replace(
    "\n sides AS (SELECT *,",
    """
 turned AS (SELECT slide, id, layer, x, y, CASE WHEN y < 0 THEN 0 WHEN y = 0 AND x >= 0 THEN 1 WHEN y > 0 THEN 2 ELSE 3 END AS half, CASE WHEN y = 0 THEN 0 ELSE -CAST(x AS DOUBLE) / y END AS place, CAST(x AS DOUBLE) * x + CAST(y AS DOUBLE) * y AS reach FROM pts WHERE x IS NOT NULL AND y IS NOT NULL),
 ring AS (SELECT slide, id, layer, x, y, row_number() OVER (PARTITION BY id ORDER BY half, place, reach) AS idx FROM turned),
 sides AS (SELECT *,""",
).replace("FROM pts WINDOW", "FROM ring WINDOW")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, idx, x, y from conversations: a point for each turn."""
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    return c.select(F.col("conv_id").alias("id"), F.col("turn").alias("idx"), (n % 97).cast("int").alias("x"), (n % 89).cast("int").alias("y"))


PATHS = "paths AS (SELECT conv_id AS id, turn AS idx, CAST(length(text) % 97 AS INT) AS x, CAST(length(text) % 89 AS INT) AS y FROM conversations)"


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide, width, height from customers: images of a few hundred to some thousand pixels."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("slide"), (300 + k % 700).alias("width"), (200 + (k * 3) % 900).alias("height"))


SLIDES = "slides AS (SELECT c_custkey AS slide, 300 + c_custkey % 700 AS width, 200 + (c_custkey * 3) % 900 AS height FROM customer)"


def tile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide, id, x, y, label of quality control from events."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("slide"), F.col("event_id").alias("id"), (F.col("user_id") * 64).alias("x"), ((F.col("event_id") % 50) * 64).alias("y"), F.when(v < 5, "empty").when(v < 10, "blur").when(v < 15, "folded").otherwise("tissue").alias("label"))


LABELS = "tile_labels AS (SELECT user_id % 16 AS slide, event_id AS id, user_id * 64 AS x, (event_id % 50) * 64 AS y, CASE WHEN value < 5 THEN 'empty' WHEN value < 10 THEN 'blur' WHEN value < 15 THEN 'folded' ELSE 'tissue' END AS label FROM events)"
