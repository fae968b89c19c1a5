"""Sheets, boards, animations, rigs and configuration documents."""

import json
import math

import numpy as np
import pytest

from spritelake.functions import columns as C
from spritelake.functions import configuration as conf
from spritelake.operators import assembly
from spritelake.operators import sequences as S


def solid(w, h, value=200):
    return np.full((h, w, 4), (value, value, value, 255), np.uint8)


def test_uneven_sheet():
    sheet = np.zeros((4, 10, 4), np.uint8)
    for x in (1, 4, 7):
        sheet[1:3, x : x + 2] = 255
    cells = assembly.cut_sheet(sheet, 3)
    assert [c.shape for c in cells] == [(4, 4, 4)] * 3 and [int((c[:, :, 3] > 0).sum()) for c in cells] == [4, 4, 4]


def test_boards_and_mosaics():
    board = assembly.board([solid(4, 4), solid(2, 2, 90)], 2, 1, 6, (1, 2, 3))
    assert board.shape == (6, 12, 4) and tuple(board[0, 0]) == (1, 2, 3, 255) and board[3, 8, 0] == 90
    with pytest.raises(ValueError, match="fit"):
        assembly.board([solid(7, 7)], 1, 1, 6, (0, 0, 0))
    assert assembly.mosaic([solid(3, 3)] * 8).shape == (6, 18, 4)


def test_guide():
    alpha = np.zeros((7, 7), np.uint8)
    alpha[2:5, 2:5] = 255
    out = assembly.guide(alpha)
    assert tuple(out[3, 3, :3]) == (70, 104, 138) and tuple(out[1, 1, :3]) == (244, 238, 192) and out[0, 0, 3] == 0


def lzw(data):
    """Codes of an image block with 8-bit symbols."""
    bits, at, width, table, out, last = "".join(format(b, "08b")[::-1] for b in data), 0, 9, {}, [], None
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == 256:
            table, last, width = {i: [i] for i in range(256)} | {256: [], 257: []}, None, 9
            continue
        if code == 257:
            return out
        entry = table[code] if code in table else table[last] + [table[last][0]]
        out += entry
        if last is not None:
            table[len(table)] = table[last] + [entry[0]]
        last = code
        if len(table) == 1 << width:
            width += 1


def test_gif_decodes():
    frame = np.random.default_rng(0).integers(0, 2, (20, 30))[:, :, None] * np.array([250, 100, 30, 0]) + np.array([0, 0, 0, 255])
    frame = frame.astype(np.uint8)
    data = assembly.gif([frame, frame], 8, True)
    at = data.index(b",\x00\x00\x00\x00") + 11
    block = b""
    while data[at]:
        block += data[at + 1 : at + 1 + data[at]]
        at += data[at] + 1
    palette = np.frombuffer(data[13 : 13 + 768], np.uint8).reshape(256, 3)
    assert (palette[lzw(block)].reshape(20, 30, 3) == frame[:, :, :3]).all() and data[:6] == b"GIF89a" and data[-1:] == b";"


def test_sample_times(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(4, True), (4, False), (1, True)], "n int, loop boolean").select(S.sample_times(F.col("n"), F.col("loop")).alias("t")).collect()
    assert rows[0]["t"] == [0, 0.25, 0.5, 0.75] and rows[2]["t"] == [0] and all(math.isclose(a, b) for a, b in zip(rows[1]["t"], [0, 1 / 3, 2 / 3, 1], strict=True))


def test_poses_follow_parents(spark):
    joints = S.skeleton(spark, [("root", None, 0.0, 0.0, 90.0), ("tip", "root", 10.0, 0.0, 0.0)])
    keys = spark.createDataFrame([("c", "root", "rotation", 0, 0.0, 0.0), ("c", "root", "rotation", 1, 1.0, 90.0)], "clip string, joint string, channel string, k int, t double, value double")
    rows = assembly.poses(joints, keys, spark.createDataFrame([("c", 3, False)], "clip string, frames int, loop boolean")).where("joint = 'tip'").orderBy("i").collect()
    assert [(round(r["x"], 6), round(r["y"], 6), r["angle"]) for r in rows] == [(0, -10, 90), (round(-10 * math.sqrt(0.5), 6), round(-10 * math.sqrt(0.5), 6), 135), (-10, 0, 180)]


def test_smooth_keys_and_jumps(spark):
    keys = spark.createDataFrame([("j", 0, 0.0, 0.0), ("j", 1, 0.5, 10.0), ("j", 2, 0.5, 20.0), ("j", 3, 1.0, 20.0)], "joint string, k int, t double, value double")
    times = spark.createDataFrame([("j", t) for t in (-1.0, 0.25, 0.5, 0.75, 2.0)], "joint string, at double")
    got = {r["at"]: r["value"] for r in S.interpolated(keys, times, ["joint"]).collect()}
    assert got == {-1.0: 0, 0.25: 5, 0.5: 10, 0.75: 20, 2.0: 20}
    assert {round(r["value"], 6) for r in S.interpolated(keys, times.where("at = 0.25"), ["joint"], smooth=True).collect()} == {5.0}


def test_scalar_functions(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(C.int_pairs(F.lit("1,2;3,4"))) == [[1, 2], [3, 4]] and value(C.int_pairs(F.lit("1,2;3"))) is None and value(C.int_list(F.lit("1,x"))) is None
    assert value(C.version(F.lit("v1.2.3-rc1"))) == [1, 2, 3] and value(C.version(F.lit("main"))) is None
    assert value(C.joined_prefix(F.lit("res://a//b/"), F.lit("/c"), F.lit("d/"))) == "res://a/b/c/d" and value(C.joined_prefix(F.lit("res://"), F.lit("c"))) == "res://c"
    assert [value(C.safe_path(F.lit(p))) for p in ("a/b.png", "../a", "/a", "a\\b", "C:/a", "", "a/..b")] == [True, False, False, False, False, False, True]
    assert value(C.overlapping_paths(F.lit("a/b"), F.lit("a"))) and not value(C.overlapping_paths(F.lit("ab"), F.lit("a")))
    names = spark.createDataFrame([(n,) for n in ("a10", "A2", "b1", "a2b", "")], "n string")
    assert [r["n"] for r in names.orderBy(C.natural_key(F.col("n")), "n").collect()] == ["", "A2", "a2b", "a10", "b1"]
    ids = spark.createDataFrame([(n,) for n in ("x", "10", "9")], "n string")
    assert [r["n"] for r in ids.orderBy(C.node_key(F.col("n"))).collect()] == ["9", "10", "x"]
    assert value(C.times_in_order(F.array(F.lit(0.0), F.lit(0.5), F.lit(0.5)))) and not value(C.times_in_order(F.array(F.lit(0.5), F.lit(0.1))))
    assert value(C.finite_pair(F.array(F.lit(1.0), F.lit(2.0)))) and not value(C.finite_pair(F.array(F.lit(1.0), F.lit(float("nan")))))


def profile_document():
    return {
        "id": "p", "kind": "character", "directions": ["left"], "tiers": {"hd": {"canvasPolicy": "fixed", "canvas": [64, 64]}},
        "animations": {"walk": {"minFrames": 4, "maxFrames": 8, "fps": 8.0, "loop": True}}, "quality": {"alphaThreshold": 20}, "export": {"engine": "web", "resourcePrefix": "/a"},
    }


def test_profiles(tmp_path):
    good = profile_document()
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text(json.dumps(good | {"more": 1}))
    (tmp_path / "x.schema.json").write_text("{}")
    assert list(conf.profiles(str(tmp_path))) == ["good"]
    with pytest.raises(conf.ConfigurationError, match=r"\$\.more: unknown"):
        conf.profile(str(tmp_path / "bad.json"))
    del good["tiers"]["hd"]["canvas"]
    (tmp_path / "good.json").write_text(json.dumps(good))
    with pytest.raises(conf.ConfigurationError, match="canvas: missing"):
        conf.profile(str(tmp_path / "good.json"))


def test_templates_and_options():
    doc = {"a": "${SEED}", "b": ["x-${NAME}", "${OTHER}"]}
    done = conf.substituted(doc, {"SEED": 7, "NAME": "n"})
    assert done == {"a": 7, "b": ["x-n", "${OTHER}"]} and conf.unresolved(done) == ["OTHER"]
    assert conf.overlaid({"a": 1.0}, {"a": 2}) == {"a": 2}
    for bad in ({"b": 1}, {"a": True}, {"a": float("inf")}):
        with pytest.raises(conf.ConfigurationError):
            conf.overlaid({"a": 1.0}, bad)
    for text in ('{"a": NaN}', '{"a": 1e999}', '{"a": 1, "a": 2}', "[1]"):
        with pytest.raises(conf.ConfigurationError):
            conf.strict_loads(text, unique=True)
    assert conf.strict_loads('{"a": 1, "a": 2}') == {"a": 2}
    assert conf.short_float(0.1 + 0.2) == "0.3"
