"""Scans and sinks on files drawn here."""

import io
import json
import struct
import zipfile

import numpy as np
import pytest

from spritelake.sources import files, png, sinks


def image(w=8, h=6, seed=1):
    return np.random.default_rng(seed).integers(0, 255, (h, w, 4)).astype(np.uint8)


def test_png_round_trip():
    a = image()
    back, alpha = png.decode(png.encode(a))
    assert alpha and (back == a).all()
    back, alpha = png.decode(png.encode(a, alpha=False))
    assert not alpha and (back[:, :, :3] == a[:, :, :3]).all() and (back[:, :, 3] == 255).all()
    with pytest.raises(png.BadImage):
        png.decode(png.encode(a)[:-20])


def test_frames_in_natural_order(spark, tmp_path):
    for name in ("walk_10.png", "walk_2.png", "walk_1.png", "_draft.png", "preview.png", "hit_1.png"):
        (tmp_path / name).write_bytes(png.encode(image()))
    found = files.frames(spark, str(tmp_path), "walk").orderBy("seq").collect()
    assert [r["name"] for r in found] == ["walk_1.png", "walk_2.png", "walk_10.png"]
    decoded = files.images(files.frames(spark, str(tmp_path)))
    assert decoded.where("error IS NULL AND w = 8 AND h = 6 AND has_alpha").count() == 4
    assert files.probe(decoded).where("error = 'width'").count() == 4
    with pytest.raises(Exception, match="no frames"):
        files.frames(spark, str(tmp_path), "idle").collect()


def test_damaged_images_are_rows(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"no image")
    assert files.images(files.files(spark, str(tmp_path), "*.png")).collect()[0]["error"] == "not a PNG file"


def test_layouts(spark, tmp_path):
    for name in ("walk/frames/1.png", "walk/9.png", "hit/1.png", "idle_1.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(png.encode(image()))
    got = {(r["clip"], r["layout"], r["name"]) for r in files.layouts(spark, str(tmp_path), ["walk", "hit", "idle"]).collect()}
    assert got == {("walk", 1, "1.png"), ("hit", 2, "1.png"), ("idle", 3, "idle_1.png")}


def test_strict_json_and_texts(spark, tmp_path):
    cases = {"a": '{"x": 1}', "b": '{"x": 1, "x": 2}', "c": '{"x": NaN}', "d": "[1]", "e": '{"x": [1e999]}', "f": '{"x": "1e999", "y": 0e999}', "g": '{"x": 1} 2', "h": "\\ufeff"}
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = files.files(spark, str(tmp_path), "*.json")
    rows = files.json_objects(found).selectExpr("path", "error", "try_variant_get(value, '$.x', 'string') AS x")
    got = {r["path"][-6]: (r["error"], r["x"]) for r in rows.collect()}
    assert {k for k, (error, _) in got.items() if error} == set("cdegh") and got["b"][1] == "2" and got["f"][1] == "1e999"
    got = {r["path"][-6]: r["error"] for r in files.json_objects(found, unique=True).drop("value").collect()}
    assert {k for k, error in got.items() if error} == set("bcdegh")
    for name, data in {"f": b" hi ", "g": b"  ", "h": b"\xff\xfe"}.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    got = {r["path"][-5]: (r["text"], r["error"]) for r in files.texts(files.files(spark, str(tmp_path), "*.txt")).collect()}
    assert got["f"] == ("hi", None) and got["g"][1] == "empty" and got["h"][1] == "not UTF-8"


def test_archives(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("ok.txt", "../up.txt", "A.txt", "a.txt"):
            z.writestr(name, "x")
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    (tmp_path / "b.zip").write_bytes(b"broken")
    bad = files.unsafe_members(files.archive_members(files.files(spark, str(tmp_path), "*.zip")))
    assert {(r["name"], r["reason"]) for r in bad.collect()} == {("../up.txt", "path"), ("A.txt", "clash"), ("a.txt", "clash"), (None, "damaged")}


def tensor_file(entries, size):
    head = json.dumps(entries).encode()
    return struct.pack("<Q", len(head)) + head + bytes(size)


def test_tensor_headers(spark, tmp_path):
    entry = {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}
    (tmp_path / "a.safetensors").write_bytes(tensor_file({"u.lora_A.weight": entry, "u.lora_B.weight": entry}, 24))
    (tmp_path / "b.safetensors").write_bytes(tensor_file({"u.lora_A.weight": entry}, 8))
    rows = files.tensors(files.files(spark, str(tmp_path), "*.safetensors"))
    assert rows.where("error IS NULL").count() == 2 and rows.where("error LIKE 'bad entry%'").count() == 1
    assert {r["path"][-13]: r["paired"] for r in files.has_pairs(rows).collect()} == {"a": True, "b": False}


def test_inventory_and_versions(spark, tmp_path):
    (tmp_path / "gpus.csv").write_text("0, A40, 46068, 45000, 8.6, 580.65, u0\n1, T4, 15360, 15000, 7.5, 580.65, u1\n2, X, bad, 1, 1, 1, u2\n")
    assert [r["eligible"] for r in files.inventory(spark, str(tmp_path / "gpus.csv")).orderBy("idx").collect()] == [True, False, False]
    (tmp_path / "p/q.dist-info").mkdir(parents=True)
    (tmp_path / "p/q.dist-info/METADATA").write_text("Metadata-Version: 2.1\nName: NumPy\nVersion: 2.3.5\n")
    assert files.package_versions(spark, str(tmp_path / "p")).collect() == [("numpy", "2.3.5")]


def test_publish_replaces_and_rolls_back(tmp_path):
    def stage(text):
        (tmp_path / "stage").mkdir()
        (tmp_path / "stage/a.txt").write_text(text)
        return str(tmp_path / "stage")

    dest = tmp_path / "out"
    sinks.publish(stage("one"), str(dest))
    assert (dest / "a.txt").read_text() == "one"
    sinks.publish(stage("two"), str(dest))

    def fail():
        raise KeyError("no")

    with pytest.raises(KeyError):
        sinks.publish(stage("three"), str(dest), fail)
    assert (dest / "a.txt").read_text() == "two"
    (tmp_path / "theirs").mkdir()
    (tmp_path / "theirs/x").touch()
    with pytest.raises(sinks.PublishError):
        sinks.publish(stage("four"), str(tmp_path / "theirs"))
    with sinks.locked(str(dest)), pytest.raises(sinks.PublishError), sinks.locked(str(dest)):
        pass


def test_release_and_tampering(tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.png").write_bytes(png.encode(image()))
    manifest = sinks.release(sinks.tree_files(str(tmp_path / "f")), {"walk": {"fps": 8, "loop": True}})
    assert sinks.release_faults(manifest, str(tmp_path / "f")) == []
    (tmp_path / "f/a.png").write_bytes(png.encode(image(seed=2)))
    assert sinks.release_faults(manifest, str(tmp_path / "f")) == ["changed: a.png"]


def test_registry_and_resource(spark):
    rows = [("moa", "hd", "walk", "left", k, f"w{k}.png") for k in (2, 1)] + [("moa", "hd", "hit", "left", 1, "h1.png")]
    frames = spark.createDataFrame(rows, "character string, tier string, clip string, direction string, seq int, path string")
    assert json.loads(sinks.registry(frames).collect()[0]["json"]) == {"hd": {"hit": {"left": ["h1.png"]}, "walk": {"left": ["w1.png", "w2.png"]}}}
    clips = spark.createDataFrame([("walk", True, 8.0), ("hit", False, 12.0)], "clip string, loop boolean, fps double")
    text = {r["clip"]: r["text"] for r in sinks.sprite_resources(frames, clips).collect()}
    assert text["walk"] == """[gd_resource type="SpriteFrames" load_steps=3 format=3]

[ext_resource type="Texture2D" path="w1.png" id="1"]
[ext_resource type="Texture2D" path="w2.png" id="2"]

[resource]
animations = [{
"frames": [{"duration": 1.0, "texture": ExtResource("1")}, {"duration": 1.0, "texture": ExtResource("2")}],
"loop": true,
"name": &"walk",
"speed": 8.0
}]
"""
    assert '"loop": false,\n"name": &"hit",\n"speed": 12.0' in text["hit"]


def test_sync_plan(spark):
    new, old = (spark.createDataFrame(x, "name string, sha256 string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("b", "2"), ("c", "9"), ("d", "4")]))
    assert {tuple(r) for r in sinks.sync_plan(new, old).collect()} == {("a", "add"), ("b", "keep"), ("c", "replace"), ("d", "delete")}
