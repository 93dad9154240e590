"""Spatial joins and folds against loops, with giants, equal values and one stratum."""

import numpy as np
import pytest

from tilewright.operators import annotations, spatial


def test_rect_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [("s", i, *map(int, rng.integers(0, 3000, 2)), *map(int, rng.integers(0, 90, 2))) for i in range(300)]
    rows += [("s", 300, 0, 0, 100_000, 100_000), ("s", 301, 500, 10, 4, 90_000), ("s", 302, 64, 64, 0, 0), ("t", 303, 0, 0, 10, 10)]
    frame = spark.createDataFrame(rows, "slide string, id int, x int, y int, w int, h int")
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4] and a[3] <= b[3] + b[5] and b[3] <= a[3] + a[5]}
    got = [(r.l.id, r.r.id) for r in spatial.rect_pairs(frame, frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert spatial.rect_pairs(frame.limit(0), frame).count() == 0


def test_proximity(spark):
    rng = np.random.default_rng(6)
    rows = [("s", i, *map(float, rng.uniform(0, 2000, 2)), float(rng.uniform(0, 20))) for i in range(300)] + [("s", 300, 900.0, 900.0, 700.0)]
    m = 2 * np.mean([r[4] for r in rows])
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[4] > 1 and b[4] > 1 and np.hypot(a[2] - b[2], a[3] - b[3]) - (a[4] + b[4] - m) < 30}
    got = [(r.a, r.b) for r in spatial.proximity(spark.createDataFrame(rows, "slide string, id int, x double, y double, r double"), 30).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_interval_label(spark):
    bands = spark.createDataFrame([(0.0, 10.0, "low"), (10.5, 30.0, "high")], "lo double, hi double, label string")
    values = spark.createDataFrame([(5.0,), (5.0,), (30.0,)], "v double")
    assert sorted(r.label for r in spatial.interval_label(values, bands, strict=True).collect()) == ["high", "low", "low"]
    assert sorted(str(r.label) for r in spatial.interval_label(values, bands).collect()) == ["None", "low", "low"]
    with pytest.raises(Exception, match="no single label"):
        spatial.interval_label(spark.createDataFrame([(10.2,)], "v double"), bands, strict=True).collect()
    with pytest.raises(ValueError):
        spatial.interval_label(values, bands, most=1)


def test_kfold(spark):
    for n, k in ((10, 3), (2, 4), (100, 7)):
        got = annotations.kfold(spark.range(n).selectExpr("id * 3 AS id"), k).where("role = 'test'").collect()
        want = {i * 3: f for f, part in enumerate(np.array_split(np.arange(n), k)) for i in part.tolist()}
        assert {r.id: r.fold for r in got} == want and len(got) == n
