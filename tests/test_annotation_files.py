"""Annotation files written, read, split and merged again."""

import json

import pytest

from tilewright import cli
from tilewright.operators import annotations as an
from tilewright.sources import annotations as source


def path_item(k):
    return {"class": f"c{k}", "type": "path", "closed": True, "segments": [{"point": {"x": float(k), "y": 1.0}}, {"point": {"x": 2.0, "y": float(k)}}]}


def write(folder, slide, layers, **more):
    folder.mkdir(exist_ok=True)
    doc = {"slide_id": slide, "project_name": "p", "layer_names": list(layers), "layers": [{"name": n, "opacity": 1.0, "items": i} for n, i in layers.items()], **more}
    (folder / f"{slide}.json").write_text(json.dumps(doc))


def read(folder):
    return {f.name: json.loads(f.read_text()) for f in sorted(folder.glob("*.json"))}


def test_round_trip(spark, tmp_path):
    circle = {"class": "dot", "type": "circle", "center": {"x": 3.0, "y": 4.0}, "radius": 2.0, "color": "red"}
    box = {"class": "box", "type": "rectangle", "x": 1.0, "y": 2.0, "width": 3.0, "height": 4.0}
    write(tmp_path / "a", "s1_raw", {"g": [path_item(1), circle], "r": [box]}, data={"tile_rect": "x"})
    write(tmp_path / "a", "s2_raw", {"g": [path_item(2)]})
    docs = source.read_documents(spark, str(tmp_path / "a"))
    names = source.write_documents(source.items(docs), str(tmp_path / "b"), "q", "done", ("_raw",))
    assert sorted(names) == ["s1_done.json", "s2_done.json"]
    again = source.items(source.read_documents(spark, str(tmp_path / "b")))
    assert sorted(map(str, again.collect())) == sorted(map(str, source.items(docs).collect()))
    made = json.loads((tmp_path / "b" / "s1_done.json").read_text())["layers"][0]["items"][1]
    assert made["center"] == {"x": 3.0, "y": 4.0} and made["radius"] == 2.0 and made["color"] == "red"
    with pytest.raises(ValueError):
        source.write_documents(source.items(docs), str(tmp_path / "c"), "q", "one", rewrite=True)
    assert [(r.slide, r.missing) for r in source.missing_metadata(docs).collect()] == [("s2_raw", ["tile_rect"])]


def test_items(spark):
    rows = spark.createDataFrame([("s", "g", 0, "a"), ("s", "g", 1, "b")], "slide string, layer string, pos int, class string")
    new = spark.createDataFrame([("s", "g", None, 1), ("s", "new", "x", 2)], "slide string, layer string, class string, rank int")
    got = {(r.layer, r.pos, r["class"]) for r in an.add_items(rows, new).collect()}
    assert got == {("g", 0, "a"), ("g", 1, "b"), ("g", 2, "g"), ("new", 0, "x")}
    layers = spark.createDataFrame([("s", 0, "g"), ("s", 1, "h"), ("s", 2, "g"), ("t", 0, "h")], "slide string, layer_idx int, layer string")
    assert an.layer_index(layers.where("slide = 's'"), "g").first().layer_idx == 0
    with pytest.raises(Exception, match="no layer g"):
        an.layer_index(layers, "g").collect()
    assert {(r.slide, r.layers, r["items"], r.empty) for r in an.contents(layers, rows).collect()} == {("s", 3, 2, False), ("t", 1, 0, True)}
    with_points = rows.withColumnsRenamed({"class": "points"})
    got = an.replace_last(with_points, spark.createDataFrame([("s", "g", "z")], "slide string, layer string, points string"))
    assert {(r.pos, r.points) for r in got.collect()} == {(0, "a"), (1, "z")}


def test_commands(spark, tmp_path):
    write(tmp_path / "a", "s1", {"g": [path_item(k) for k in range(5)]})
    write(tmp_path / "a", "s2", {"g": [path_item(9)]})
    write(tmp_path / "b", "s1", {"g": [path_item(7)], "h": [path_item(8)]})
    assert cli.main(["concatenate", str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "c")], spark) == ["s1.json"]
    doc = read(tmp_path / "c")["s1.json"]
    assert [(x["name"], [i["class"] for i in x["items"]]) for x in doc["layers"]] == [("g", ["c0", "c1", "c2", "c3", "c4", "c7"]), ("h", ["c8"])]
    cli.main(["split", str(tmp_path / "a"), str(tmp_path / "d"), "-n", "2", "-s", "s1"], spark)
    assert {n: len(d["layers"][0]["items"]) for n, d in read(tmp_path / "d").items()} == {"s1_0.json": 3, "s1_1.json": 2}
    cli.main(["merge", str(tmp_path / "d"), str(tmp_path / "e"), "--num-splits", "2"], spark)
    assert [i["class"] for i in read(tmp_path / "e")["s1.json"]["layers"][0]["items"]] == [f"c{k}" for k in range(5)]
    with pytest.raises(Exception, match="wrong number"):
        cli.main(["merge", str(tmp_path / "d"), str(tmp_path / "f"), "--num-splits", "3"], spark)
