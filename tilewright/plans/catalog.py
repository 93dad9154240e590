"""One query for each operator over the driver's tables, and the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import values as v
from ..operators import annotations as an
from ..operators import grids as gr
from ..operators import spatial as sp
from ..operators import summaries as su
from .derived import LABELS, PATHS, POINTS, RECTS, RING_POINTS, SLIDES, paths, polygons, rects, rings, slides, table, tile_labels

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def relation_sql(a: str, b: str) -> tuple[str, str]:
    """The rectangle relation and origin of a and b in SQL, written out from their definition."""
    x0, y0, r0, b0 = f"{a}.x", f"{a}.y", f"({a}.x+{a}.w)", f"({a}.y+{a}.h)"
    x1, y1, r1, b1 = f"{b}.x", f"{b}.y", f"({b}.x+{b}.w)", f"({b}.y+{b}.h)"
    xo, yo = f"({x1} BETWEEN {x0} AND {r0} OR {r1} BETWEEN {x0} AND {r0})", f"({y1} BETWEEN {y0} AND {b0} OR {b1} BETWEEN {y0} AND {b0})"
    xc = f"(({x1} BETWEEN {x0} AND {r0} AND {r1} BETWEEN {x0} AND {r0}) OR ({x0} BETWEEN {x1} AND {r1} AND {r0} BETWEEN {x1} AND {r1}))"
    yc = f"(({y1} BETWEEN {y0} AND {b0} AND {b1} BETWEEN {y0} AND {b0}) OR ({y0} BETWEEN {y1} AND {b1} AND {b0} BETWEEN {y1} AND {b1}))"
    ho, ve = f"(NOT {xc} AND {yo} AND ({r0} <= {x1} OR {r1} <= {x0}))", f"(NOT {yc} AND {xo} AND ({b0} <= {y1} OR {b1} <= {y0}))"
    rel = f"CASE WHEN {xc} AND {yc} THEN 'contained' WHEN {ho} THEN 'horizontal' WHEN {ve} THEN 'vertical' WHEN {xo} AND {yo} THEN 'overlap' ELSE '' END"
    org = f"CASE WHEN {xc} AND {yc} THEN CASE WHEN {a}.w*{a}.h >= {b}.w*{b}.h THEN 0 ELSE 1 END WHEN {ho} THEN CASE WHEN {r0} <= {x1} THEN 0 ELSE 1 END WHEN {ve} THEN CASE WHEN {b0} <= {y1} THEN 0 ELSE 1 END WHEN {xo} AND {yo} THEN CASE WHEN {y0} <= {y1} THEN 0 ELSE 1 END END"
    return rel, org


REL, ORG = relation_sql("a", "b")
MEET = "a.slide = b.slide AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h"


# -- joins --------------------------------------------------------------------------------------------------------------------


@query("j2_rect_relation", f"WITH {RECTS} SELECT relation, coalesce(origin, -1) AS origin, count(*) AS n FROM (SELECT {REL} AS relation, {ORG} AS origin FROM rects a JOIN rects b ON {MEET}) GROUP BY ALL")
def j2(spark, d):
    r = rects(spark, d)
    relation, origin = g.rect_relation(sp.sides("l"), sp.sides("r"))
    pairs = sp.rect_pairs(r, r).where(g.rect_intersects(sp.sides("l"), sp.sides("r")))
    return pairs.groupBy(relation.alias("relation"), F.coalesce(origin, F.lit(-1)).alias("origin")).agg(F.count("*").alias("n"))


J3 = f"SELECT a.slide, a.id AS parent, b.id AS child FROM rects a JOIN rects b ON {MEET} WHERE a.layer <> b.layer AND NOT (a.x = b.x AND a.y = b.y AND a.w = b.w AND a.h = b.h) AND (({REL}) = 'contained' AND ({ORG}) = 0 OR ({REL}) = 'overlap')"


@query("j3_overlap_join", f"WITH {RECTS} {J3}")
def j3(spark, d):
    return sp.overlaps(rects(spark, d))


@query("j4_overlap_counts", f"WITH {RECTS}, o AS ({J3}) SELECT r.slide, r.id, count(o.child) AS n FROM rects r LEFT JOIN o ON o.parent = r.id GROUP BY ALL")
def j4(spark, d):
    r = rects(spark, d)
    n = sp.overlaps(r).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    return r.select("slide", "id").join(n, "id", "left").select("slide", "id", F.coalesce("n", F.lit(0)).alias("n"))


def _tiles(r, size=256):
    boxes = r.select("slide", F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j")).distinct()
    return boxes.select("slide", (F.col("i") * 100000 + F.col("j")).alias("id"), (F.col("i") * size).alias("x"), (F.col("j") * size).alias("y"), F.lit(size).cast("long").alias("w"), F.lit(size).cast("long").alias("h"))


TILES = "tiles AS (SELECT slide, i * 100000 + j AS id, i * 256 AS x, j * 256 AS y, CAST(256 AS BIGINT) AS w, CAST(256 AS BIGINT) AS h FROM (SELECT DISTINCT slide, x // 256 AS i, y // 256 AS j FROM rects))"


@query("j5_tile_contours", f"WITH {RECTS}, {TILES} SELECT a.slide, a.id AS tile, b.id AS rect FROM tiles a JOIN rects b ON {MEET} WHERE ({REL}) IN ('overlap', 'contained')")
def j5(spark, d):
    r = rects(spark, d)
    return sp.tile_contours(_tiles(r), r)


STRIPS = "regions AS (SELECT slide, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM rects GROUP BY slide), strips AS (SELECT slide, CAST(p AS INT) AS part, CASE WHEN w >= h THEN x + p * (greatest(w, h) // 5) ELSE x END AS x, CASE WHEN w >= h THEN y ELSE y + p * (greatest(w, h) // 5) END AS y, CASE WHEN w >= h THEN greatest(w, h) // 5 ELSE w END AS w, CASE WHEN w >= h THEN h ELSE greatest(w, h) // 5 END AS h FROM regions, range(0, 5) r(p))"


@query("a17_split_spatial", f"WITH {RECTS}, {STRIPS} SELECT b.slide, b.id, min(a.part) AS part FROM strips a JOIN rects b ON a.slide = b.slide WHERE ({REL}) = 'overlap' OR (({REL}) = 'contained' AND ({ORG}) = 0) GROUP BY b.slide, b.id")
def a17(spark, d):
    r = rects(spark, d)
    regions = r.groupBy("slide").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))
    return sp.strip_of(r.select("slide", "id", "x", "y", "w", "h"), an.strips(regions, 5)).select("slide", "id", "part")


@query("f5_origins_in_boxes", f"WITH {RECTS}, {TILES}, small AS (SELECT *, id AS rid FROM rects WHERE layer = 'O') SELECT DISTINCT t.slide, t.id, t.x, t.y FROM rects t JOIN small s ON t.slide = s.slide AND t.x BETWEEN s.x AND s.x + s.w AND t.y BETWEEN s.y AND s.y + s.h")
def f5(spark, d):
    r = rects(spark, d)
    return sp.origins_in_boxes(r.select("slide", "id", "x", "y"), r.where("layer = 'O'"))


@query("j1_common_slides", f"WITH {RECTS} SELECT a.slide, a.n AS n_f, b.n AS n_o FROM (SELECT slide, count(*) AS n FROM rects WHERE layer = 'F' GROUP BY 1) a JOIN (SELECT slide, count(*) AS n FROM rects WHERE layer = 'O' GROUP BY 1) b ON a.slide = b.slide")
def j1(spark, d):
    r = rects(spark, d)
    n = lambda layer: r.where(F.col("layer") == layer).groupBy("slide").agg(F.count("*").alias(f"n_{layer.lower()}"))
    return n("F").join(n("O"), "slide")


CIRCLES = "circles AS (SELECT id, slide, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, sqrt(w * h / pi()) AS r FROM rects)"


@query("j7_proximity", f"WITH {RECTS}, {CIRCLES}, m AS (SELECT slide, 2 * avg(r) AS m FROM circles GROUP BY 1) SELECT a.slide, a.id AS a, b.id AS b FROM circles a JOIN circles b ON a.slide = b.slide AND a.id < b.id JOIN m ON m.slide = a.slide WHERE a.r > 1 AND b.r > 1 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) - (a.r + b.r - m.m) < 8")
def j7(spark, d):
    c = rects(spark, d).select("slide", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.sqrt(F.col("w") * F.col("h") / F.pi()).alias("r"))
    return sp.proximity(c, 8)


@query("j8_nearest_far", f"WITH {RECTS}, p AS (SELECT a.slide, a.id, b.id AS far, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM rects a JOIN rects b ON a.slide = b.slide AND a.layer = 'F' AND b.layer = 'O') SELECT slide, id, min(struct_pack(d2 := d2, far := far)).far AS far FROM p WHERE d2 < 10000 GROUP BY 1, 2")
def j8(spark, d):
    r = rects(spark, d)
    return sp.nearest_far(r.where("layer = 'F'"), r.where("layer = 'O'"), 100).select("slide", "id", "far")


@query("j10_point_tiles", f"WITH {RECTS}, g AS (SELECT CAST(i AS INT) AS i FROM range(0, 80) t(i)) SELECT r.id, c.i AS col, q.i AS row, r.x - (c.i * 256 - CASE WHEN c.i > 0 THEN 4 ELSE 0 END) AS tx, r.y - (q.i * 256 - CASE WHEN q.i > 0 THEN 4 ELSE 0 END) AS ty FROM rects r JOIN g c ON c.i * 256 - 4 <= r.x AND r.x <= (c.i + 1) * 256 + 4 JOIN g q ON q.i * 256 - 4 <= r.y AND r.y <= (q.i + 1) * 256 + 4")
def j10(spark, d):
    tiles = g.point_tiles(F.col("x"), F.col("y"), 256, 4, F.lit(79), F.lit(79))
    return rects(spark, d).select("id", F.explode(tiles).alias("t")).select("id", "t.*")


@query("j12_interval_labels", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS label FROM lineitem) GROUP BY 1")
def j12(spark, d):
    bands = spark.createDataFrame([(0.0, 10.0, "low"), (10.0, 30.0, "mid"), (30.0, 1e9, "high")], "lo double, hi double, label string")
    return sp.interval_label(table(spark, d, "lineitem").select(F.col("l_quantity").alias("v")), bands).groupBy("label").agg(F.count("*").alias("n"))


@query("j13_rect_containment", f"WITH {RECTS} SELECT a.slide, a.id AS outer_id, b.id AS inner_id FROM rects a JOIN rects b ON {MEET} AND a.id <> b.id AND b.x >= a.x AND b.y >= a.y AND b.x + b.w <= a.x + a.w AND b.y + b.h <= a.y + a.h")
def j13(spark, d):
    r = rects(spark, d)
    return sp.rect_pairs(r, r).where((F.col("l.id") != F.col("r.id")) & g.rect_contains(sp.sides("l"), sp.sides("r"))).select(F.col("l.slide").alias("slide"), F.col("l.id").alias("outer_id"), F.col("r.id").alias("inner_id"))


# -- polygons -----------------------------------------------------------------------------------------------------------------


@query("e2_polygon_measures", f"WITH {POINTS} SELECT id, round(abs(sum(c) / 2), 3) AS area, min(x) AS bx, min(y) AS bypos, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh, round(sqrt(abs(sum(c) / 2) / pi()), 6) AS radius FROM edges GROUP BY id")
def e2(spark, d):
    p = F.col("points")
    return polygons(spark, d).select("id", F.round(g.polygon_area(p), 3).alias("area"), g.bounding_rect(p).alias("b"), F.round(g.radius(p), 6).alias("radius")).select("id", "area", F.col("b.x").alias("bx"), F.col("b.y").alias("bypos"), F.col("b.w").alias("bw"), F.col("b.h").alias("bh"), "radius")


@query("g15_centroids", f"WITH {POINTS} SELECT id, round(CASE WHEN sum(c) = 0 THEN 0 ELSE sum((CAST(x AS DOUBLE) + nx) * c) / (3 * sum(c)) END, 4) AS cx, round(CASE WHEN sum(c) = 0 THEN 0 ELSE sum((CAST(y AS DOUBLE) + ny) * c) / (3 * sum(c)) END, 4) AS cy FROM edges GROUP BY id")
def g15(spark, d):
    return polygons(spark, d).select("id", g.centroid(F.col("points")).alias("c")).select("id", F.round("c.x", 4).alias("cx"), F.round("c.y", 4).alias("cy"))


@query("e3_point_in_polygon", f"""WITH {POINTS}, q AS (SELECT id, CAST(id % 300 AS INT) - 150 AS px, CAST((id * 7) % 300 AS INT) - 150 AS py FROM pts WHERE idx = 0),
 t AS (SELECT e.id, px, py, e.x, e.y, nx, ny, CAST(nx - e.x AS BIGINT) * (py - e.y) - CAST(ny - e.y AS BIGINT) * (px - e.x) AS turn FROM edges e JOIN q ON q.id = e.id)
 SELECT id, CASE WHEN bool_or(turn = 0 AND px BETWEEN least(x, nx) AND greatest(x, nx) AND py BETWEEN least(y, ny) AND greatest(y, ny)) THEN 0
  WHEN sum(CASE WHEN y <= py AND ny > py AND turn > 0 THEN 1 WHEN y > py AND ny <= py AND turn < 0 THEN -1 ELSE 0 END) <> 0 THEN 1 ELSE -1 END AS inside FROM t GROUP BY id""")
def e3(spark, d):
    px, py = (F.col("id") % 300).cast("int") - 150, ((F.col("id") * 7) % 300).cast("int") - 150
    return polygons(spark, d).select("id", g.point_in_polygon(px, py, F.col("points")).alias("inside"))


@query("f2_area_filter", f"WITH {POINTS} SELECT id FROM edges GROUP BY id HAVING abs(sum(c) / 2) > 20000")
def f2(spark, d):
    return an.filter_items(polygons(spark, d), g.polygon_area(F.col("points")) > 20000).select("id")


MOMENTS = f"WITH {RING_POINTS}, m AS (SELECT id, sum((CAST(x AS DOUBLE) * x + CAST(x AS DOUBLE) * nx + CAST(nx AS DOUBLE) * nx) * c) / 12 * sign(sum(c)) AS m20, sum((CAST(y AS DOUBLE) * y + CAST(y AS DOUBLE) * ny + CAST(ny AS DOUBLE) * ny) * c) / 12 * sign(sum(c)) AS m02 FROM edges GROUP BY id)"


@query("f3_moment_ratio", f"{MOMENTS} SELECT id FROM m WHERE m20 / nullif(m02, 0) < 2 AND m02 / nullif(m20, 0) < 2")
def f3(spark, d):
    return rings(spark, d).where(g.ratio_below(F.col("points"), 2)).select("id")


@query("a8_unique_points", f"WITH {POINTS}, u AS (SELECT id, x, y, min(idx) AS idx FROM pts GROUP BY id, x, y) SELECT id, row_number() OVER (PARTITION BY id ORDER BY idx) - 1 AS pos, x, y FROM u")
def a8(spark, d):
    return polygons(spark, d).select("id", F.posexplode(g.unique_points(F.col("points"))).alias("pos", "p")).select("id", "pos", "p.x", "p.y")


@query("a8_rect_points", f"WITH {RECTS} SELECT id, CAST(k AS INT) AS pos, CAST(CASE WHEN k IN (0, 1) THEN x ELSE x + w END AS DOUBLE) AS x, CAST(CASE WHEN k IN (0, 3) THEN y ELSE y + h END AS DOUBLE) AS y FROM rects, range(0, 4) r(k)")
def a8_rect(spark, d):
    corners = g.rect_points(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return rects(spark, d).select("id", F.posexplode(corners).alias("pos", "p")).select("id", "pos", "p.x", "p.y")


@query("a9_contours", "WITH p AS (SELECT vec_id AS id, i, embedding[2 * i + 1] * 10 AS x, embedding[2 * i + 2] * 10 AS y FROM embeddings, range(0, 32) r(i)), u AS (SELECT id, x, y, min(i) AS i FROM p GROUP BY 1, 2, 3) SELECT id, CAST(sum(abs(CAST(trunc(x) AS INT))) AS BIGINT) AS sx, CAST(sum(abs(CAST(trunc(y) AS INT))) AS BIGINT) AS sy, count(*) AS n FROM u GROUP BY id")
def a9(spark, d):
    e = table(spark, d, "embeddings")
    at = lambda i: F.get("embedding", i) * F.lit(10).cast("float")
    p = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")))
    rows = e.select(F.col("vec_id").alias("id"), F.explode(g.contour(p)).alias("p"))
    return rows.groupBy("id").agg(F.sum(F.abs("p.x")).alias("sx"), F.sum(F.abs("p.y")).alias("sy"), F.count("*").alias("n"))


@query("a13_pairwise", f"WITH {POINTS}, n AS (SELECT id, idx, x, y, lead(x) OVER (PARTITION BY id ORDER BY idx) AS nx, lead(y) OVER (PARTITION BY id ORDER BY idx) AS ny FROM pts) SELECT id, CAST(idx AS INT) AS pos, x AS ax, y AS ay, nx AS bx, ny AS b_y FROM n WHERE nx IS NOT NULL")
def a13(spark, d):
    rows = polygons(spark, d).select("id", F.posexplode(g.pairwise(F.col("points"))).alias("pos", "e"))
    return rows.select("id", "pos", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("b_y"))


# -- ordered operations -------------------------------------------------------------------------------------------------------

GAPS = f"{PATHS}, g AS (SELECT *, sqrt(power(lead(x) OVER w - x, 2) + power(lead(y) OVER w - y, 2)) AS gap, count(*) OVER (PARTITION BY id) AS n FROM paths WINDOW w AS (PARTITION BY id ORDER BY idx))"


@query("w1_gaps", f"WITH {GAPS} SELECT id, idx, round(gap, 9) AS gap FROM g WHERE gap IS NOT NULL")
def w1(spark, d):
    return an.gaps(paths(spark, d)).where("gap IS NOT NULL").select("id", "idx", F.round("gap", 9).alias("gap"))


@query("w2_smallest_gaps", f"WITH {GAPS} SELECT id, idx, k FROM (SELECT id, idx, row_number() OVER (PARTITION BY id ORDER BY round(gap, 9), idx) AS k FROM g WHERE gap IS NOT NULL) WHERE k <= 2")
def w2(spark, d):
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("gap", 9), "idx"))
    return an.gaps(paths(spark, d)).where("gap IS NOT NULL").select("id", "idx", rank.alias("k")).where("k <= 2")


@query("e10_shrink_paths", f"WITH {GAPS}, b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap NULLS LAST, idx) AS k, (max(x) OVER (PARTITION BY id) - min(x) OVER (PARTITION BY id) + 1) * (max(y) OVER (PARTITION BY id) - min(y) OVER (PARTITION BY id) + 1) AS area FROM g) SELECT id, idx, x, y FROM b WHERE n > 1 AND (NOT (n / 4.0 / sqrt(area) >= 0.01 AND n > 3) OR k > n - CAST(round_even(n * 0.5, 0) AS INT) OR gap IS NULL)")
def e10(spark, d):
    return an.shrink_paths(paths(spark, d), 0.5, 0.01, 3)


@query("a15_split_parts", f"WITH {RECTS}, n AS (SELECT *, count(*) OVER (PARTITION BY slide, layer) AS n, ntile(4) OVER (PARTITION BY slide, layer ORDER BY pos) - 1 AS part FROM rects) SELECT slide, layer, pos, part FROM n WHERE n >= 60 UNION ALL SELECT slide, layer, pos, p AS part FROM n, range(0, 4) r(p) WHERE n < 60")
def a15(spark, d):
    return an.split_parts(rects(spark, d), 4, 60).select("slide", "layer", "pos", "part")


@query("a16_split_size", f"WITH {RECTS} SELECT slide, layer, pos, CAST((row_number() OVER (PARTITION BY slide, layer ORDER BY pos) - 1) // 50 AS INT) AS part FROM rects")
def a16(spark, d):
    return an.split_size(rects(spark, d), 50).select("slide", "layer", "pos", "part")


@query("a4_concatenate", f"WITH {RECTS}, a AS (SELECT slide, layer, pos FROM rects WHERE layer <> 'O'), b AS (SELECT slide, layer, pos FROM rects WHERE layer <> 'F'), c AS (SELECT slide FROM a INTERSECT SELECT slide FROM b), u AS (SELECT 0 AS s, * FROM a UNION ALL SELECT 1, * FROM b) SELECT slide, layer, pos AS old, row_number() OVER (PARTITION BY slide, layer ORDER BY s, pos) - 1 AS pos FROM u WHERE slide IN (SELECT slide FROM c)")
def a4(spark, d):
    r = rects(spark, d).select("slide", "layer", "pos", F.col("pos").alias("old"))
    return an.concatenate(r.where("layer <> 'O'"), r.where("layer <> 'F'")).select("slide", "layer", "old", "pos")


@query("a4_concatenate_renamed", f"WITH {RECTS}, a AS (SELECT slide, layer, pos FROM rects WHERE layer <> 'O'), b AS (SELECT slide, layer || '_second' AS layer, pos FROM rects WHERE layer <> 'F'), u AS (SELECT 0 AS s, * FROM a WHERE slide IN (SELECT slide FROM b) UNION ALL SELECT 1, * FROM b WHERE slide IN (SELECT slide FROM a)) SELECT slide, layer, count(*) AS n FROM u GROUP BY 1, 2")
def a4_renamed(spark, d):
    r = rects(spark, d).select("slide", "layer", "pos")
    return an.concatenate(r.where("layer <> 'O'"), r.where("layer <> 'F'"), False, "second").groupBy("slide", "layer").agg(F.count("*").alias("n"))


@query("a5_rename_layer", f"WITH {RECTS} SELECT CASE WHEN layer = 'F' THEN 'tumour' ELSE layer END AS layer, count(*) AS n FROM rects GROUP BY 1")
def a5(spark, d):
    return an.rename_layer(rects(spark, d), "F", "tumour").groupBy("layer").agg(F.count("*").alias("n"))


@query("a6_remove_items", f"WITH {RECTS} SELECT slide, layer, id, row_number() OVER (PARTITION BY slide, layer ORDER BY pos) - 1 AS pos FROM rects WHERE id % 7 <> 0")
def a6(spark, d):
    r = rects(spark, d)
    return an.remove_items(r, r.where("id % 7 = 0").select("slide", "layer", "pos")).select("slide", "layer", "id", "pos")


@query("a18_merge_parts", f"WITH {RECTS} SELECT CAST(slide AS VARCHAR) AS slide, layer, id, row_number() OVER (PARTITION BY slide, layer ORDER BY id % 12, pos) - 1 AS pos FROM rects")
def a18(spark, d):
    r = rects(spark, d).withColumn("name", F.concat_ws("", F.col("slide").cast("string"), F.lit("_"), (F.col("id") % 12).cast("string"), F.lit(".json"))).select("name", "layer", "id", "pos")
    return an.merge_parts(r).select("slide", "layer", "id", "pos")


@query("w7_paint_order", f"WITH {RECTS} SELECT slide, id, row_number() OVER (PARTITION BY slide ORDER BY CASE layer WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, pos, id) AS paint FROM rects")
def w7(spark, d):
    return an.paint_order(rects(spark, d), {"P": 0, "F": 1}).select("slide", "id", "paint")


FOLDS = "SELECT f AS fold, doc_id AS id, CASE WHEN f = own THEN 'test' ELSE 'train' END AS role"


@query("k1_kfold", f"{FOLDS} FROM (SELECT doc_id, ntile(5) OVER (ORDER BY doc_id) - 1 AS own FROM labels), range(0, 5) r(f)")
def k1(spark, d):
    return an.kfold(table(spark, d, "labels").select(F.col("doc_id").alias("id")), 5).select("fold", "id", "role")


@query("k2_stratified", f"{FOLDS}, quality FROM (SELECT doc_id, quality, ntile(5) OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS own FROM labels), range(0, 5) r(f)")
def k2(spark, d):
    return an.kfold(table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"), 5, "quality").select("fold", "id", "role", "quality")


@query("g14_class_counts", "WITH s AS (SELECT f AS fold, CASE WHEN f = own THEN 'test' ELSE 'train' END AS role, toxic AS value FROM (SELECT toxic, ntile(5) OVER (ORDER BY doc_id) - 1 AS own FROM labels), range(0, 5) r(f)) SELECT p.fold, p.role, v.value, count(s.value) AS n FROM (SELECT DISTINCT fold, role FROM s) p CROSS JOIN (SELECT DISTINCT value FROM s) v LEFT JOIN s ON s.fold = p.fold AND s.role = p.role AND s.value = v.value GROUP BY ALL")
def g14(spark, d):
    ids = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("value"))
    return su.class_counts(an.kfold(ids, 5))


# -- grids --------------------------------------------------------------------------------------------------------------------


@query("g1_qc_grid", f"WITH {SLIDES} SELECT slide, i * 128 AS x, j * 128 AS y FROM slides, range(0, 20) a(i), range(0, 20) b(j) WHERE i < ceil(width / 128.0) - 1 AND j < ceil(height / 128.0) - 1")
def g1(spark, d):
    return gr.qc_grid(slides(spark, d), 128)


@query("g2_tile_grid", f"WITH {SLIDES} SELECT slide, i * 240 AS x, j * 240 AS y, row_number() OVER (PARTITION BY slide ORDER BY i, j) - 1 AS pos FROM slides, range(0, 20) a(i), range(0, 20) b(j) WHERE i <= width // 240 AND j <= height // 240")
def g2(spark, d):
    return gr.tile_grid(slides(spark, d), 256, 16)


@query("g3_pyramid_tiles", f"WITH {SLIDES}, l AS (SELECT *, CAST(ceil(log2(greatest(width, height))) AS INT) AS top FROM slides), s AS (SELECT slide, k AS level, ceil(width / power(2, top - k)) AS lw, ceil(height / power(2, top - k)) AS lh FROM l, range(0, 12) r(k) WHERE k <= top) SELECT slide, level, i AS col, j AS row FROM s, range(0, 20) a(i), range(0, 20) b(j) WHERE i < ceil(lw / 254.0) AND j < ceil(lh / 254.0)")
def g3(spark, d):
    return gr.pyramid_tiles(slides(spark, d), 254)


@query("g4_fit_windows", f"""WITH {SLIDES}, k AS (SELECT slide AS id, width AS w, height AS h, CASE WHEN width < 320 OR height < 320 THEN 'pad' WHEN width > 640 OR height > 640 THEN 'split' WHEN width > 320 OR height > 320 THEN 'crop' ELSE 'whole' END AS kind FROM slides)
 SELECT id, kind, CASE WHEN kind = 'crop' THEN CAST(round_even((w - 320) / 2.0, 0) AS INT) WHEN kind = 'split' THEN CASE WHEN i * 320 + 320 < w THEN i * 320 ELSE w - 320 END ELSE 0 END AS x, CASE WHEN kind = 'crop' THEN CAST(round_even((h - 320) / 2.0, 0) AS INT) WHEN kind = 'split' THEN CASE WHEN j * 320 + 320 < h THEN j * 320 ELSE h - 320 END ELSE 0 END AS y
 FROM k, range(0, 10) a(i), range(0, 10) b(j) WHERE (kind <> 'split' AND i = 0 AND j = 0) OR (kind = 'split' AND i * 320 < w AND j * 320 < h)""")
def g4(spark, d):
    images = slides(spark, d).select(F.col("slide").alias("id"), F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h"))
    return gr.fit_windows(images, 320)


@query("g6_stack", f"WITH {RECTS} SELECT slide, id, l AS level, CAST(trunc(x * power(0.5, l)) AS INT) - 64 AS x, CAST(trunc(y * power(0.5, l)) AS INT) - 64 AS y FROM rects, (VALUES (0), (1), (3)) v(l)")
def g6(spark, d):
    return gr.stack(rects(spark, d), (0, 1, 3), 128)


@query("t2_nearest_level", f"WITH {SLIDES}, l AS (SELECT slide, k AS level, 0.25 * power(2, k) AS mpp FROM slides, range(0, 6) r(k)) SELECT slide, arg_min(level, struct_pack(a := abs(mpp - (0.2 + (slide % 40) / 10.0)), b := level)) AS level FROM l GROUP BY slide")
def t2(spark, d):
    s = slides(spark, d)
    levels = s.select("slide", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("level")).withColumn("mpp", 0.25 * F.pow(F.lit(2.0), F.col("level")))
    return gr.nearest_level(s.select("slide", (0.2 + (F.col("slide") % 40) / 10.0).alias("want")), levels)


@query("g18_grid_extent", "SELECT user_id AS slide, CAST(event_id % 5 AS INT) AS level, max(CAST(event_id % 1300 AS INT)) AS last_col, max(CAST(event_id % 77 AS INT)) AS last_row FROM events GROUP BY 1, 2")
def g18(spark, d):
    k = F.col("event_id")
    names = table(spark, d, "events").select(F.col("user_id").alias("slide"), (k % 5).cast("int").alias("level"), F.concat_ws("", (k % 1300).cast("string"), F.lit("_"), (k % 77).cast("string"), F.lit(".png")).alias("name"))
    return gr.grid_extent(names)


@query("e4_map_levels", f"WITH {POINTS} SELECT id, CAST(idx AS INT) AS idx, CAST(trunc(x * power(2.0, 1 - 3)) AS INT) AS x, CAST(trunc(y * power(2.0, 1 - 3)) AS INT) AS y FROM pts")
def e4(spark, d):
    rows = polygons(spark, d).select("id", F.posexplode("points").alias("idx", "p"))
    return rows.select("id", "idx", g.map_level(F.col("p.x"), F.lit(1), F.lit(3)).alias("x"), g.map_level(F.col("p.y"), F.lit(1), F.lit(3)).alias("y"))


@query("e6_run_lengths", "SELECT c_custkey AS id, CAST(CASE WHEN l = 0 THEN z ELSE (CASE WHEN e = l THEN z - 8 ELSE 0 END) + (CASE WHEN s = 0 THEN 258 ELSE 8 END) + (e - s + 1 - CASE WHEN e = l THEN 1 ELSE 0 END - CASE WHEN s = 0 THEN 1 ELSE 0 END) * 254 - (CASE WHEN z < 8 AND e = l - 1 THEN 8 - z ELSE 0 END) END AS BIGINT) AS length FROM (SELECT c_custkey, c_custkey % 9 AS l, (c_custkey % 9) // 2 AS s, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 9 ELSE greatest((c_custkey % 9) // 2, c_custkey % 9 - 1) END AS e, 1 + c_custkey % 254 AS z FROM customer)")
def e6(spark, d):
    k = F.col("c_custkey")
    last, start = k % 9, F.floor((k % 9) / 2).cast("long")
    end = F.when(k % 2 == 0, last).otherwise(F.greatest(start, last - 1))
    return table(spark, d, "customer").select(k.alias("id"), g.run_length(start, end, last, 1 + k % 254, 254, 4).cast("long").alias("length"))


@query("e9_rotated_extent", f"WITH {RECTS} SELECT id, round(greatest(w / 2.0, sqrt(w * w + h * h) / 2 * greatest(abs(cos(radians(id % 360) + atan(h / w::DOUBLE))), abs(cos(radians(id % 360) - atan(h / w::DOUBLE))))), 6) AS half_w, round(greatest(h / 2.0, sqrt(w * w + h * h) / 2 * greatest(abs(sin(radians(id % 360) + atan(h / w::DOUBLE))), abs(sin(radians(id % 360) - atan(h / w::DOUBLE))))), 6) AS half_h FROM rects")
def e9(spark, d):
    w, h = g.rotated_extent(F.col("w"), F.col("h"), F.col("id") % 360)
    return rects(spark, d).select("id", F.round(w, 6).alias("half_w"), F.round(h, 6).alias("half_h"))


# -- summaries ----------------------------------------------------------------------------------------------------------------


@query("g9_layer_summary", f"WITH {RECTS} SELECT layer, count(*) AS n, round(avg(w * h), 6) AS mean, round(stddev_pop(w * h), 6) AS std FROM rects GROUP BY layer")
def g9(spark, d):
    return su.layer_summary(rects(spark, d).withColumn("a", F.col("w") * F.col("h")), "a").select("layer", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("g9_histogram", f"WITH {RECTS} SELECT CAST(least(floor((w - 5) / 3.9), 9) AS INT) AS bin, count(*) AS n FROM rects WHERE w BETWEEN 5 AND 44 GROUP BY 1")
def g9_histogram(spark, d):
    return su.histogram(rects(spark, d), "w", 5, 44, 10)


@query("g10_contour_counts", f"WITH {RECTS} SELECT slide, layer, count(*) AS n FROM rects GROUP BY 1, 2")
def g10(spark, d):
    return rects(spark, d).groupBy("slide", "layer").agg(F.count("*").alias("n"))


@query("g12_coverage", f"WITH {LABELS} SELECT slide, round(avg(CASE WHEN label = 'tissue' THEN 1.0 ELSE 0.0 END), 9) AS coverage FROM tile_labels GROUP BY 1")
def g12(spark, d):
    return su.coverage(tile_labels(spark, d)).select("slide", F.round("coverage", 9).alias("coverage"))


@query("r2_tile_labels", f"WITH {LABELS} SELECT slide, label, count(*) AS n, min(x) AS first_x FROM tile_labels GROUP BY 1, 2")
def r2(spark, d):
    return tile_labels(spark, d).groupBy("slide", "label").agg(F.count("*").alias("n"), F.min("x").alias("first_x"))


@query("g17_bounding_union", f"WITH {RECTS} SELECT slide, layer, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM rects GROUP BY 1, 2")
def g17(spark, d):
    far = lambda a, b: F.max(F.col(a) + F.col(b)) - F.min(a)
    return rects(spark, d).groupBy("slide", "layer").agg(F.min("x").alias("x"), F.min("y").alias("y"), far("x", "w").alias("w"), far("y", "h").alias("h"))


@query("g19_weighted_mean", "SELECT l_returnflag AS k, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS m FROM lineitem GROUP BY 1")
def g19(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 9).alias("m"))


@query("g20_running_mean", "SELECT event_id, floor(avg(CAST(value AS DECIMAL(20, 4))) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) * 1000 + 0.0001) / 1000 AS m FROM events")
def g20(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", (F.floor(F.avg(F.col("value").cast("decimal(20,4)")).over(w).cast("double") * 1000 + 0.0001) / 1000).alias("m"))


@query("g21_mode", "SELECT k, v AS mode FROM (SELECT l_suppkey AS k, CAST(l_quantity AS INT) AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, CAST(l_quantity AS INT)) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1")
def g21(spark, d):
    return su.mode(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("int").alias("v")), "k", "v")


@query("g22_otsu", """WITH h AS (SELECT l_returnflag AS k, CAST(l_quantity AS INT) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
 c AS (SELECT k, v, CAST(sum(n) OVER w AS DOUBLE) AS n0, CAST(sum(n * v) OVER w AS DOUBLE) AS s0, CAST(sum(n) OVER (PARTITION BY k) AS DOUBLE) AS a, CAST(sum(n * v) OVER (PARTITION BY k) AS DOUBLE) AS s FROM h WINDOW w AS (PARTITION BY k ORDER BY v)),
 b AS (SELECT k, v, round(n0 * (a - n0) / a / a * power(s0 / n0 - (s - s0) / (a - n0), 2), 6) AS b FROM c WHERE n0 < a)
 SELECT k, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b DESC, v) AS r FROM b) WHERE r = 1""")
def g22(spark, d):
    return su.otsu(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").cast("int").alias("v")), "k", "v")


@query("t1_largest_region", f"WITH {RECTS} SELECT slide, arg_max(id, struct_pack(a := w * h, b := -id)) AS id FROM rects GROUP BY 1")
def t1(spark, d):
    return rects(spark, d).groupBy("slide").agg(F.max_by("id", F.struct(F.col("w") * F.col("h"), -F.col("id"))).alias("id"))


@query("t6_extreme_points", f"WITH {POINTS} SELECT id, min(struct_pack(a := y, b := x)).b AS top_left, max(struct_pack(a := -y, b := x)).b AS top_right, min(struct_pack(a := -y, b := x)).b AS bottom_left, max(struct_pack(a := y, b := x)).b AS bottom_right FROM pts GROUP BY 1")
def t6(spark, d):
    p = polygons(spark, d).select("id", F.explode("points").alias("p")).select("id", "p.x", "p.y")
    key = lambda sign: F.struct((sign * F.col("y")).alias("a"), F.col("x").alias("b"))
    return p.groupBy("id").agg(F.min(key(1))["b"].alias("top_left"), F.max(key(-1))["b"].alias("top_right"), F.min(key(-1))["b"].alias("bottom_left"), F.max(key(1))["b"].alias("bottom_right"))


@query("u1_label_sets", f"WITH {RECTS} SELECT slide, list_sort(list(DISTINCT layer))::VARCHAR AS have, NOT bool_or(layer = 'P') AS lacks_p FROM rects GROUP BY 1")
def u1(spark, d):
    sets = rects(spark, d).groupBy("slide").agg(F.sort_array(F.collect_set("layer")).alias("s"))
    return sets.select("slide", F.concat(F.lit("["), F.array_join("s", ", "), F.lit("]")).alias("have"), (F.size(F.array_except(F.array(F.lit("P")), "s")) == 1).alias("lacks_p"))


@query("f11_part_names", "SELECT n FROM (SELECT p_name || '_' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '.json' ELSE '.txt' END AS n FROM part) WHERE regexp_matches(n, '_\\d+\\.json$')")
def f11(spark, d):
    n = F.concat_ws("", "p_name", F.lit("_"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".json").otherwise(".txt"))
    return table(spark, d, "part").select(n.alias("n")).where(F.col("n").rlike(r"_\d+\.json$"))


@query("c2_human_bytes", "SELECT o_orderkey AS id, CASE WHEN v >= 1048576 THEN (v // 1048576) || 'M' WHEN v >= 1024 THEN (v // 1024) || 'K' ELSE v || 'B' END AS s FROM (SELECT o_orderkey, o_orderkey * o_custkey AS v FROM orders)")
def c2(spark, d):
    v = F.col("o_orderkey") * F.col("o_custkey")
    s = F.when(v >= 1048576, F.format_string("%dM", F.shiftright(v, 20))).when(v >= 1024, F.format_string("%dK", F.shiftright(v, 10))).otherwise(F.format_string("%dB", v))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), s.alias("s"))


@query("c6_location_keys", f"WITH {LABELS} SELECT id, x || ',' || y AS k, x AS kx, y AS ky FROM tile_labels")
def c6(spark, d):
    rows = tile_labels(spark, d).select("id", F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string")).alias("k"))
    part = F.split("k", ",")
    return rows.select("id", "k", F.get(part, 0).cast("long").alias("kx"), F.get(part, 1).cast("long").alias("ky"))


@query("c8_flags", "SELECT o_orderpriority LIKE '1%' AS urgent, count(*) AS n FROM orders GROUP BY 1")
def c8(spark, d):
    text = F.when(F.col("o_orderpriority").startswith("1"), "TRUE").otherwise("FALSE")
    return table(spark, d, "orders").groupBy((F.lower(text) == "true").alias("urgent")).agg(F.count("*").alias("n"))


@query("r13_argmax", "SELECT vec_id AS id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS channel FROM embeddings")
def r13(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("channel"))


@query("r4_threshold", "SELECT v, CASE WHEN v IN (20, 30, 40) THEN 1 ELSE 0 END AS m, count(*) AS n FROM (SELECT CAST(l_quantity AS INT) AS v FROM lineitem) GROUP BY 1, 2")
def r4(spark, d):
    above = [40, 30, 20]  # the value asked for and all above it
    v = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").groupBy(v.alias("v"), F.when(v.isin(above), 1).otherwise(0).alias("m")).agg(F.count("*").alias("n"))


# -- values and contents ------------------------------------------------------------------------------------------------------


@query("e7_mask_coordinates", f"WITH {SLIDES} SELECT slide, CAST(floor(8.5 * width * 0.25) AS BIGINT) AS up, CAST(floor(0.125 * height) AS BIGINT) AS down FROM slides")
def e7(spark, d):
    return slides(spark, d).select("slide", v.mask_to_slide(F.col("width"), 8.5, 2).alias("up"), v.slide_to_mask(F.col("height"), 0.125).alias("down"))


@query("e8_thumbnails", f"WITH {SLIDES}, m AS (SELECT *, greatest(width, height) AS most FROM slides) SELECT slide, CAST(CASE WHEN width = most THEN 128 ELSE floor(width / most * 128) END AS INT) AS w, CAST(CASE WHEN height = most THEN 128 ELSE floor(height / most * 128) END AS INT) AS h, CAST(floor(log2(most / 128)) AS INT) AS below FROM m")
def e8(spark, d):
    return slides(spark, d).select("slide", v.thumbnail(F.col("width"), F.col("height"), 128).alias("t")).select("slide", "t.*")


@query("e12_intensities", "WITH s AS (SELECT vec_id AS id, label, list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS s FROM embeddings), e AS (SELECT label, min(s) AS lo, quantile_cont(s, 0.99) AS hi FROM s GROUP BY 1) SELECT id, round(coalesce(greatest(0.0, least(1.0, (s - lo) / nullif(hi - lo, 0))), 0.0), 6) AS intensity FROM s JOIN e USING (label)")
def e12(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return v.intensities(rows, "embedding", "label").select("id", F.round("intensity", 6).alias("intensity"))


@query("f4_contents", f"WITH {RECTS} SELECT slide, count(DISTINCT layer) AS layers, count(*) AS items, count(*) = 0 AS empty FROM rects GROUP BY 1")
def f4(spark, d):
    r = rects(spark, d)
    return an.contents(r.select("slide", "layer").distinct(), r)


@query("f13_whole_numbers", "SELECT p_partkey AS id, regexp_matches(trim(s), '^[+-]?[0-9]+$') AS whole FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN ' -7 ' WHEN 2 THEN '1.5' ELSE p_name END AS s FROM part)")
def f13(spark, d):
    k = F.col("p_partkey")
    s = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, " -7 ").when(k % 4 == 2, "1.5").otherwise(F.col("p_name"))
    return table(spark, d, "part").select(k.alias("id"), v.is_int(s).alias("whole"))


@query("a2_add_items", f"WITH {RECTS}, new AS (SELECT slide, 'F' AS layer, count(*) AS k FROM rects WHERE layer = 'O' GROUP BY 1), old AS (SELECT slide, max(pos) + 1 AS nxt, count(*) AS n FROM rects WHERE layer = 'F' GROUP BY 1) SELECT slide, coalesce(n, 0) + k AS n, coalesce(nxt, 0) + k - 1 AS last FROM new LEFT JOIN old USING (slide)")
def a2(spark, d):
    r = rects(spark, d).select("slide", "layer", "pos", F.col("id").alias("rank"), F.col("layer").alias("class"))
    added = an.add_items(r.drop("rank"), r.where("layer = 'O'").drop("pos").withColumn("layer", F.lit("F")))
    slides_of = r.where("layer = 'O'").select("slide").distinct()
    return added.where("layer = 'F'").join(slides_of, "slide").groupBy("slide").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


@query("a7_first_layer", f"WITH {RECTS}, l AS (SELECT slide, layer, row_number() OVER (PARTITION BY slide ORDER BY layer) - 1 AS layer_idx FROM (SELECT DISTINCT slide, layer FROM rects)) SELECT slide, CAST(min(layer_idx) AS INT) AS layer_idx FROM l WHERE layer = 'O' GROUP BY 1")
def a7(spark, d):
    layers = an.with_layer_order(rects(spark, d).select("slide", "layer").distinct())
    having = layers.where("layer = 'O'").select("slide")
    return an.layer_index(layers.join(having, "slide", "left_semi"), "O")


@query("k1_places", "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS place, count(*) OVER () AS total FROM customer")
def places(spark, d):
    return an.places(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id").select("id", "place", "total")
