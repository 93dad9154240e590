"""Masks against pixels set by hand."""

import numpy as np

from tilewright.operators import masks
from tilewright.operators.raster import fill_polygon


def test_border_and_fill_are_inverse():
    rng = np.random.default_rng(9)
    shapes = [np.ones((1, 1)), np.ones((3, 5)), np.eye(6), np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]])]
    for _ in range(10):
        y, x = np.mgrid[:30, :30]
        shapes.append((x - rng.uniform(12, 18)) ** 2 / rng.uniform(20, 90) + (y - rng.uniform(12, 18)) ** 2 / rng.uniform(20, 90) < 1)
    for s in shapes:
        s = s.astype(bool)
        p = masks.border(s)
        assert all(s[y, x] for x, y in p)
        assert (fill_polygon(masks.straight_runs(p), s.shape).astype(bool) == s).all()


def test_contours(spark):
    mask = np.zeros((20, 30), np.uint8)
    mask[2:8, 3:10], mask[10:18, 12:25], mask[0, 29] = 1, 2, 1
    got = masks.contours(mask, {1: "a", 2: "b"}, (100, 200), 2.0)
    assert [(c["class"], c["x"], c["y"], c["w"], c["h"], len(c["points"])) for c in got] == [("a", 206.0, 404.0, 12.0, 10.0, 4), ("b", 224.0, 420.0, 24.0, 14.0, 4)]
    frame = spark.createDataFrame([("s", 7, 100, 200, 30, 20, bytearray(mask.tobytes()))], "slide string, id int, x int, y int, w int, h int, data binary")
    rows = sorted(masks.mask_contours(frame, {1: "a", 2: "b"}, 2.0).collect(), key=lambda r: r["class"])
    assert [(r.slide, r.id, r["class"], r.x, r.h) for r in rows] == [("s", 7, "a", 206.0, 10.0), ("s", 7, "b", 224.0, 14.0)]
    assert masks.mask_contours(frame.limit(0), {1: "a"}).count() == 0


def test_instances(spark):
    box = lambda x, y, w, h: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x, y + h), (x + w, y + h), (x + w, y))]
    rows = [("s", 1, "gland", box(10, 20, 30, 20)), ("s", 2, "lumen", box(15, 25, 5, 5)), ("s", 3, "other", box(0, 0, 5, 5)), ("s", 4, "lumen", box(35, 35, 50, 50))]
    items = spark.createDataFrame(rows, "slide string, id int, class string, points array<struct<x:double,y:double>>")
    children = spark.createDataFrame([("s", 1, 2), ("s", 1, 4), ("s", 1, 3)], "slide string, parent int, child int")
    got = {r.id: r for r in masks.instance_masks(items, children, {"gland": 1, "lumen": 2}).collect()}
    assert set(got) == {1, 2, 4}
    m = np.frombuffer(got[1].data, np.uint8).reshape(got[1].h, got[1].w)
    want = np.ones((21, 31), np.uint8)
    want[5:11, 5:11] = 2  # the fourth's box is larger, so it is left out
    assert (got[1].x, got[1].y) == (10, 20) and (m == want).all()


def test_small_kernels():
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    assert masks.fill_holes(ring).sum() == 25 and masks.fill_holes(~np.pad(np.ones((3, 3), bool), 3)).all()
    dot = np.zeros((9, 9), bool)
    dot[4, 4] = True
    assert not masks.opened(dot, 3).any() and masks.opened(masks.fill_holes(ring), 3).sum() == 25
    assert masks.mark_point(np.zeros((50, 50), np.uint8), 25, 25, 3).sum() == 3 * 81
    wide = np.zeros((40, 40), np.uint8)
    wide[:, :20], wide[:, 20:] = 1, 2
    assert (masks.smoothed(wide, [1, 2], 2.0)[:, [0, 10, 30, 39]] == [1, 1, 2, 2]).all()
    assert masks.painted((5, 5), [(np.array([(-9, -9), (-5, -9), (-5, -5)]), 1)]).sum() == 0
