"""Tiled images against the same image in one array."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import pixels
from tilewright.sources.pyramids import TILE

SIZE, OVER = 16, 2
RNG = np.random.default_rng(8)
IMAGE = RNG.integers(0, 256, (70, 53, 3), np.uint8)


def cut(image, size=SIZE, over=OVER, slide="s", level=3):
    rows, (h, w, n) = [], image.shape
    for r in range(-(-h // size)):
        for c in range(-(-w // size)):
            p = image[max(0, r * size - over) : (r + 1) * size + over, max(0, c * size - over) : (c + 1) * size + over]
            rows.append((slide, level, c, r, p.shape[1], p.shape[0], n, bytearray(p.tobytes())))
    return rows


def whole(rows, size=SIZE, over=OVER):
    out = {}
    for t in rows:
        p = np.frombuffer(t.data, np.uint8).reshape(t.h, t.w, t.nch)
        x, y = t.col * size - (over if t.col else 0), t.row * size - (over if t.row else 0)
        for (j, i), v in np.ndenumerate(p[..., 0]):
            assert out.setdefault((y + j, x + i), v) == v  # shared pixels agree
    h, w = max(k[0] for k in out) + 1, max(k[1] for k in out) + 1
    return np.array([[out[j, i] for i in range(w)] for j in range(h)])


@pytest.fixture(scope="module")
def tiles(spark):
    return spark.createDataFrame(cut(IMAGE), TILE)


def regions(spark, rows):
    return spark.createDataFrame([(i, "s", 3, *r) for i, r in enumerate(rows)], "id bigint, slide string, level int, x int, y int, w int, h int")


def test_read_regions(spark, tiles):
    boxes = [(0, 0, 53, 70), (5, 9, 20, 30), (15, 16, 1, 1), (40, 60, 13, 10)]
    for r in pixels.read_regions(tiles, regions(spark, boxes), SIZE, OVER).collect():
        x, y, w, h = boxes[r.id]
        assert (np.frombuffer(r.data, np.uint8).reshape(h, w, 3) == IMAGE[y : y + h, x : x + w]).all()
    out = pixels.read_regions(tiles, regions(spark, [(-3, -2, 8, 8), (500, 500, 4, 4)]), SIZE, OVER, border=7).orderBy("id").collect()
    got = np.frombuffer(out[0].data, np.uint8).reshape(8, 8, 3)
    assert (got[:2] == 7).all() and (got[:, :3] == 7).all() and (got[2:, 3:] == IMAGE[:6, :5]).all() and set(out[1].data) == {7}
    low = pixels.read_regions(tiles, regions(spark, [(-3, -2, 8, 8)]), SIZE, OVER, border="min").first()
    assert np.frombuffer(low.data, np.uint8)[0] == IMAGE[:6, :5].min()
    with pytest.raises(Exception, match="leaves its slide"):
        pixels.read_regions(tiles, regions(spark, [(-3, -2, 8, 8)]), SIZE, OVER).collect()
    other = spark.createDataFrame([t for t in cut(255 - IMAGE) if t[2:4] == (1, 1)], TILE)
    r = pixels.read_regions(tiles, regions(spark, [(20, 20, 4, 4)]), SIZE, OVER, first=other).first()
    assert (np.frombuffer(r.data, np.uint8).reshape(4, 4, 3) == 255 - IMAGE[20:24, 20:24]).all()


def test_bounds_and_levels(spark, tiles):
    rows = regions(spark, [(101, 41, 10, 6)])
    assert tuple(pixels.region_bounds(rows, {"s": 4}).first())[3:5] == (50, 20)
    assert tuple(pixels.region_bounds(rows, {"s": 4}, centre=True, at_level=True).first())[3:5] == (96, 38)
    assert tuple(pixels.level_sizes(tiles, SIZE, OVER).first()) == ("s", 3, 53, 70)
    with pytest.raises(Exception, match="gaps"):
        pixels.check_levels(tiles).collect()
    many = tiles.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1))))
    assert pixels.check_levels(many).first().levels == 2


def test_process_regions(spark, tiles):
    want = IMAGE.copy()
    want[10:40, 5:45] = 255 - want[10:40, 5:45]
    got = pixels.process_regions(tiles, regions(spark, [(5, 10, 40, 30)]), lambda p: 255 - p, SIZE, OVER).collect()
    assert (whole(got) == want[..., 0]).all()
    with pytest.raises(Exception, match="shape"):
        pixels.process_regions(tiles, regions(spark, [(5, 10, 40, 30)]), lambda p: p[:3], SIZE, OVER).collect()


def test_crop_rotate(spark, tiles):
    got = pixels.crop(tiles, "s", 3, (7, 11), (40, 60), SIZE, OVER, 8, 1).collect()
    assert (whole(got, 8, 1) == IMAGE[11:61, 7:41, 0]).all()
    square = IMAGE[:51, :51]
    frame = spark.createDataFrame(cut(square), TILE)
    for angle, want in ((0, square), (90, np.rot90(square, -1)), (180, square[::-1, ::-1])):
        assert (whole(pixels.rotate(frame, "s", 3, 51, 51, angle, SIZE, OVER).collect()) == want[..., 0]).all()
    got = whole(pixels.rotcrop(frame, "s", 3, (25, 25), (11, 9), 90, SIZE, OVER).collect())
    assert (got == np.rot90(square, -1)[21:30, 20:31, 0]).all()


def test_thumbnails_and_blanks(spark, tiles):
    t = pixels.thumbnails(tiles, pixels.level_sizes(tiles, SIZE, OVER), 70, SIZE, OVER).first()
    assert (t.w, t.h) == (53, 70) and (np.frombuffer(t.data, np.uint8).reshape(70, 53, 3) == IMAGE).all()
    assert pixels.thumbnail_level(4096, 1000, 512) == (3, (512, 125))
    grid = tiles.select("slide", "level", "col", "row", "w", "h")
    blanks = pixels.blank_tiles(grid).collect()
    assert all(len(b.data) == b.w * b.h * 3 and len(set(b.data)) == 1 for b in blanks) and len({b.data[0] for b in blanks}) > 3
