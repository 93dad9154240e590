import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as g
from tilewright.operators import grids, raster
from tilewright.plans.catalog import ORACLES, QUERIES
from tilewright.sources import annotations, pyramids

RELATIONS = [
    ((4, 0, 2, 10), (0, 5, 10, 10), "", None), ((0, 5, 10, 10), (4, 0, 2, 10), "overlap", 1), ((4, 0, 2, 10), (0, 4, 10, 2), "contained", 0),
    ((0, 0, 10, 10), (10, 0, 10, 10), "horizontal", 0), ((0, 0, 10, 10), (2, 2, 3, 3), "contained", 0), ((0, 0, 4, 4), (20, 20, 4, 4), "", None),
]


@pytest.mark.parametrize("a,b,relation,origin", RELATIONS)
def test_relation(spark, a, b, relation, origin):
    r, o = g.rect_relation(tuple(map(F.lit, a)), tuple(map(F.lit, b)))
    assert tuple(spark.range(1).select(r, o).first()) == (relation, origin)


def test_measures(spark):
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    area, c, inside, on, out = spark.range(1).select(g.polygon_area(square), g.centroid(square), *[g.point_in_polygon(F.lit(x), F.lit(y), square) for x, y in ((1, 1), (4, 2), (5, 1))]).first()
    assert (area, tuple(c), inside, on, out) == (12.0, (2.0, 1.5), 1, 0, -1)


def test_by_angle(spark):
    places = np.random.default_rng(3).integers(-4, 5, (60, 2)).tolist() + [[3, 3], [1, 1], [-2, 0], [0, 0], [5, 0], [0, -7], [None, 1], [2, None]]
    frame = spark.createDataFrame([(places,), ([],)], "at array<array<int>>").select(F.transform("at", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("points"))
    got, none = [[tuple(p) for p in r.points] for r in frame.select(g.by_angle(F.col("points")).alias("points")).collect()]
    assert got == sorted((tuple(p) for p in places if None not in p), key=lambda p: (round(float(np.arctan2(p[1], p[0])), 9), p[0] ** 2 + p[1] ** 2)) and none == []


def test_moment_ratio_of_rings(spark, tmp_path):
    """The corners of a square count the same in any order; some coordinates may be missing."""
    corners, rows = [(0.1, 0.1), (-0.1, 0.1), (-0.1, -0.1), (0.1, -0.1)], []
    for i, order in enumerate(((0, 1, 2, 3), (0, 2, 1, 3), (3, 0, 2, 1), (2, 0, 1, 3))):
        rows.append((i, [v for k in order for v in corners[k]] * 8, 0))
    rows += [(4, rows[1][1][:8], 0), (5, [0.1, None, *rows[1][1][:8]], 0), (6, [0.3, 0.01, -0.3, 0.01, 0.3, -0.01, -0.3, -0.01], 0), (7, [], 0), (8, None, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(r.id for r in QUERIES["f3_moment_ratio"](spark, str(tmp_path)).collect())
    assert got == sorted(r[0] for r in duck.sql(ORACLES["f3_moment_ratio"]).fetchall()) == [0, 1, 2, 3, 4, 5]


def test_nearest_level_is_merged(spark):
    """Both sides grow with the slides, so neither is broadcast, however small it looks; nor are all levels sorted before they are dealt."""
    slides = spark.range(50).withColumnRenamed("id", "slide")
    levels = slides.select("slide", F.explode(F.array(*map(F.lit, range(4)))).alias("level")).withColumn("mpp", F.pow(F.lit(2.0), "level"))
    out = grids.nearest_level(slides.select("slide", F.when(F.col("slide") % 2 == 0, 3.0).otherwise(7.0).alias("want")), levels)
    assert {(r.slide, r.level) for r in out.collect()} == {(i, 1 if i % 2 == 0 else 3) for i in range(50)}  # 3 is as far from 2 as from 4: the first
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_no_moments_without_area(spark):
    bow = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10, 10), (12, 12), (12, 10), (10, 12))])
    moments, below = spark.range(1).select(g.second_moments(bow), g.ratio_below(bow, 2)).first()
    assert tuple(moments) == (0, 0) and below is False


def test_documents(spark, tmp_path):
    (tmp_path / "s1.json").write_text('{"annotation": {"layers": [{"name": "a", "items": [{"type": "path", "segments": [{"point": {"x": 1, "y": 2}}, [[3, 4], [0, 0], [0, 0]], [5, 6]]}, {"type": "rectangle", "from": {"x": 1, "y": 1}, "to": {"x": 4, "y": 6}}]}]}}')
    (tmp_path / "s2.json").write_text('{"slide_id": "other", "layers": [{"name": "b", "items": []}]}')
    docs = annotations.read_documents(spark, str(tmp_path))
    assert {(r.file, r.slide_id, tuple(r.layer_names)) for r in docs.collect()} == {("s1.json", "s1", ("a",)), ("s2.json", "other", ("b",))}
    first, second = annotations.items(docs).orderBy("pos").collect()
    assert [(p.x, p.y) for p in first.points] == [(1, 2), (3, 4), (5, 6)] and first["class"] == "a"
    assert (second.x, second.y, second.w, second.h) == (1, 1, 3, 5)
    assert '"slide_id":"s1"' in annotations.to_documents(annotations.items(docs), "p").first().json


def test_tiles(spark, tmp_path):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 255, (50, 70, 3), np.uint8)
    base = tmp_path / "s_files" / "1"
    base.mkdir(parents=True)
    for c in range(3):
        for r in range(2):
            (base / f"{c}_{r}.png").write_bytes(pyramids.png(image[r * 32 : (r + 1) * 32, c * 32 : (c + 1) * 32]))
    tiles = pyramids.read_tiles(spark, str(tmp_path))
    region = spark.createDataFrame([(1, "s", 1, 20, 10, 45, 35)], "id bigint, slide string, level int, x int, y int, w int, h int")
    got = pyramids.read_regions(tiles, region, 32).first()
    assert (np.frombuffer(got.data, np.uint8).reshape(35, 45, 3)[..., ::-1] == image[10:45, 20:65]).all()
    small = {(t.col, t.row): (t.w, t.h) for t in pyramids.halve(tiles).collect()}
    assert small == {(0, 0): (32, 25), (1, 0): (3, 25)}


def test_kernels():
    assert raster.fill_polygon(np.array([[1, 1], [4, 1], [4, 3], [1, 3]]), (6, 6)).sum() == 12
    assert raster.components(np.array([[1, 1, 0], [0, 0, 0], [0, 1, 1]], bool)).max() == 2
    assert raster.threshold_by_value(np.array([0, 200, 250]), [0, 200, 250], 200).tolist() == [0, 1, 1]
    white = np.full((64, 64, 3), 255, np.uint8)
    stained = white.copy()
    stained[8:60, 8:60] = (150, 40, 120)
    assert not raster.is_tissue(white) and raster.is_tissue(stained)
