"""Merging against a loop over items in their order, which is written here from the description alone."""

import numpy as np
import pytest
from tilewright.operators import merging


def ring(x, y, w, h, step=5):
    """Points round a box, from its top left corner downwards."""
    down = [(x, y + k) for k in range(0, h, step)]
    right = [(x + k, y + h) for k in range(0, w, step)]
    up = [(x + w, y + h - k) for k in range(0, h, step)]
    left = [(x + w - k, y) for k in range(0, w, step)]
    return down + right + up + left


def test_close_points():
    near = np.array([(0, 0), (0, 1), (0, 50)], float)
    far = np.array([(1, 0), (1, 2)], float)
    i, j = merging.close_points(near, far, 5)
    assert i.tolist() == [0, 1] and j.tolist() == [0, 1]  # the second takes the one that is left
    assert merging.stitched(near, far + 500, "horizontal", 5) is None
    with pytest.raises(ValueError):
        merging.facing_ends(near, far, "overlap", 5)


def test_first_pairs(spark):
    rng = np.random.default_rng(2)
    for n in (1, 30, 120):
        pairs = sorted({tuple(map(int, rng.choice(60, 2, replace=False))) for _ in range(n)})
        used, want = set(), []
        for a, b in pairs:
            if not {a, b} & used:
                used |= {a, b}
                want.append((a, b))
        frame = spark.createDataFrame([("s", "l", a, b) for a, b in pairs], "slide string, layer string, a int, b int")
        assert sorted((r.a, r.b) for r in merging.first_pairs(frame).collect()) == want
    assert merging.first_pairs(frame.limit(0)).count() == 0


def test_merge_paths(spark):
    # two halves left and right of a border, two above and below one, one alone, and one inside another's tile
    boxes = [((0, 0, 100, 100), (60, 20, 40, 40)), ((101, 0, 100, 100), (101, 20, 40, 40)), ((0, 300, 100, 100), (20, 360, 40, 40)), ((0, 401, 100, 100), (20, 401, 40, 40)), ((900, 900, 100, 100), (920, 920, 50, 50)), ((910, 910, 20, 20), (912, 912, 10, 10))]
    rows = [("s", "gland", i, f"c{i}", [{"x": float(a), "y": float(b)} for a, b in ring(*p)], *map(float, t)) for i, (t, p) in enumerate(boxes)]
    items = spark.createDataFrame(rows, "slide string, layer string, pos int, class string, points array<struct<x:double,y:double>>, x double, y double, w double, h double")
    got = sorted(merging.merge_paths(items, 300, 10, 5).collect(), key=lambda r: r.pos)
    assert [r["class"] for r in got] == ["c4", "c5", "c0", "c2"]
    across, down = got[2], got[3]
    assert (across.x, across.y, across.w, across.h) == (0, 0, 201, 100) and (down.x, down.y, down.w, down.h) == (0, 300, 100, 201)
    for r, (a, b) in ((across, (0, 1)), (down, (2, 3))):
        own = {(p.x, p.y) for p in r.points}
        assert own <= {tuple(map(float, p)) for k in (a, b) for p in ring(*boxes[k][1])} and len(own) == len(r.points)
        xs, ys = zip(*own, strict=True)
        assert max(xs) - min(xs) >= 40 and max(ys) - min(ys) >= 40
    again = merging.merge_paths(spark.createDataFrame(got, items.schema), 300, 10, 3)
    assert again.count() == 4
    assert merging.merge_paths(items.limit(0)).count() == 0


def test_overlapping_tiles():
    square = np.array([(0, 0), (0, 10), (10, 10), (10, 0)], float)
    assert merging.without_covered(np.array([(5, 5), (10, 5), (11, 5), (0, -1)], float), square).tolist() == [[11, 5], [0, -1]]
    a, b = np.array(ring(0, 0, 40, 40), float), np.array(ring(30, 5, 40, 30), float)
    path = merging.pair_path(a, b, "overlap", 15)
    assert path[:, 0].min() == 0 and path[:, 0].max() == 70
    assert merging.pair_path(a, a[:3] + 1, "overlap", 15) is None
