"""Quality control over drawn slides."""

import numpy as np
import pytest

from tilewright.operators import quality_control as qc

OPTIONS = qc.Options(patch=160)


def patch(stained):
    p = np.full((32, 32, 3), 245, np.uint8)
    if stained:
        p[2:30, 1:31] = (180, 60, 120)
        p[10:20, 10:20] = (120, 20, 90)
    return p


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, "s" if i < 6 else "t", 32 * (i % 3), 32 * (i // 3), 32, 32, 3, bytearray(patch(i % 2).tobytes())) for i in range(9)]
    frame = spark.createDataFrame(rows, "id bigint, slide string, x int, y int, w int, h int, nch int, data binary")
    return qc.label_tiles(frame, OPTIONS).cache()


def test_labels_and_coverage(labels):
    assert {r.id: r.label for r in labels.collect()} == {i: "tissue" if i % 2 else "background" for i in range(9)}
    assert {r.slide: (r.tiles, r.tissue) for r in qc.coverage(labels).collect()} == {"s": (6, 3), "t": (3, 1)}
    assert qc.nth_tissue_tile(labels, "s", 1) == (32, 0) or qc.nth_tissue_tile(labels, "s", 1)[0] >= qc.nth_tissue_tile(labels, "s", 0)[0]
    assert qc.nth_tissue_tile(labels, "s", 9) is None and OPTIONS.qc_patch == 32


def test_documents(spark, labels, tmp_path):
    path = str(tmp_path / "qc")
    qc.write_documents(labels, path, OPTIONS)
    got = {(r.slide, r.x, r.y, r.label) for r in qc.read_documents(spark, path, OPTIONS).collect()}
    assert got == {(r.slide, r.x, r.y, r.label) for r in labels.collect()}
    with pytest.raises(Exception, match="another mpp"):
        qc.read_documents(spark, path, qc.Options(mpp=0.5)).collect()
    assert qc.differing(OPTIONS, qc.Options()) == {"patch": (160, 1024)}


def test_files_and_masks(spark, tmp_path):
    tiles = spark.createDataFrame([("s", 1, 0, 0, 32, 32), ("s", 2, 32, 0, 32, 32), ("s", 3, 500, 500, 32, 32)], "slide string, id int, x int, y int, w int, h int")
    box = lambda x, y, w, h: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x, y + h), (x + w, y + h), (x + w, y))]
    items = spark.createDataFrame([("s", 1, "a", box(4, 4, 10, 10), 4, 4, 10, 10), ("s", 2, "b", box(6, 6, 3, 3), 6, 6, 3, 3), ("s", 3, "c", box(0, 0, 9, 9), 0, 0, 9, 9)], "slide string, id int, class string, points array<struct<x:double,y:double>>, x int, y int, w int, h int")
    masks = qc.tile_masks(tiles, items, {"a": 1, "b": 2}).collect()
    assert len(masks) == 1
    want = np.zeros((32, 32), np.uint8)
    want[4:15, 4:15], want[6:10, 6:10] = 1, 2
    assert (np.frombuffer(masks[0].data, np.uint8).reshape(32, 32) == want).all()
    assert qc.tile_masks(tiles, items, {"a": 1}, least=0.5).count() == 0
    p = np.zeros((4, 5, 3), np.uint8)
    p[..., 0] = 200  # blue
    frame = spark.createDataFrame([("s", 7, 9, 5, 4, 3, bytearray(p.tobytes()))], "slide string, x int, y int, w int, h int, nch int, data binary")
    f = qc.tile_files(frame, "out").first()
    assert f.path == "out/s/7_9.png"
    (tmp_path / "7_9.png").write_bytes(f.content)
    image = spark.read.format("image").load(str(tmp_path)).first().image
    assert bytes(image.data) == p.tobytes()
    many = spark.range(4000).selectExpr("'s' AS slide", "id")
    assert abs(qc.sampled(many, 1000).count() - 1000) < 150 and qc.sampled(many, 9000).count() == 4000
