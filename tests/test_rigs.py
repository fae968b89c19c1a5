"""Rig documents, clip packs, the quadruped build and plan checks."""

import json

import pytest
from pyspark.sql import functions as F

from spritelake.operators import integrity as I
from spritelake.operators import rigs as B


def test_clip_packs_as_rows(spark):
    pack = {"walk": {"fps": 10, "grounded": True, "tracks": {"root": {"offset_y": [[0, 0], [0.5, -2], [1, 0]]}}}, "hit": {"fps": 14, "loop": False, "tracks": {}}}
    clips, keys = B.clip_rows(spark.createDataFrame([("biped", json.dumps(pack))], "pack string, text string"), "pack", "text")
    assert {tuple(r) for r in clips.collect()} == {("biped", "walk", 10.0, True, True), ("biped", "hit", 14.0, False, False)}
    assert sorted(tuple(r)[2:] for r in keys.collect()) == [("root", "offset_y", 0, 0.0, 0.0), ("root", "offset_y", 1, 0.5, -2.0), ("root", "offset_y", 2, 1.0, 0.0)]


def test_rig_documents_round_trip(spark):
    rigs = spark.createDataFrame([("moa", "east", "biped-side", [64, 64])], "id string, direction string, archetype string, canvas array<int>")
    parts = spark.createDataFrame([("moa", "head", "parts/head.png", [2.0, 3.0], "neck", 3, b"pixels"), ("moa", "hat", "../hat.png", [0.0, 0.0], "neck", 4, b"x"), ("moa", "arm", "parts/arm.png", [0.0, 0.0], "elbow", 4, b"x")], "id string, part string, image string, pivot array<double>, joint string, z int, rgba binary")
    joints = spark.createDataFrame([("moa", "root", None, [1.0, 2.0]), ("moa", "neck", "root", [0.0, -4.0])], "id string, joint string, parent string, offset array<double>")
    docs = B.rig_documents(rigs, parts, joints)
    doc = json.loads(docs.first()["text"])
    assert doc["skeleton"]["root"] == {"parent": None, "offset": [1.0, 2.0]} and doc["parts"]["head"] == {"image": "parts/head.png", "pivot": [2.0, 3.0], "joint": "neck", "z": 3}
    images = spark.createDataFrame([("parts/head.png", 8, 9), ("parts/arm.png", 4, 4)], "path string, w int, h int")
    assert {(r["part"], r["fault"], r["w"]) for r in B.rig_parts(docs, "text", images).collect()} == {("head", None, 8), ("hat", "path", None), ("arm", "joint", 4)}


def test_quadruped_build(spark):
    parts = [("a", "body", 100, 60), ("a", "head", 40, 40), ("a", "foreleg_f", 20, 50), ("a", "tail", 30, 20), ("b", "body", 10, 10)]
    rows = B.skeletons(spark.createDataFrame(parts, "owner string, slot string, w int, h int"), 256, "quadruped-side").collect()
    assert {r["joint"] for r in rows} == {"root", "body", "neck", "head", "tail", "foreleg_f"} and {r["owner"] for r in rows} == {"a"}
    width = round(256 * 1.28 / 2) * 2
    scale = min(width * 0.72 / (100 + 40 * 0.72 + 30 * 0.58), 256 * 0.60 / (60 * 0.75 + 50))
    body, leg = (round(100 * scale), round(60 * scale)), round(50 * scale)
    at = {r["joint"]: (r["parent"], r["ox"], r["oy"]) for r in rows}
    assert at["root"] == (None, round(width * 0.5, 3), round(256 * 0.82 - leg * 0.9 - body[1] * 0.24, 3))
    assert at["foreleg_f"] == ("body", round(body[0] * 0.30, 3), round(body[1] * 0.24, 3)) and at["head"] == ("neck", 0, 0)
    faults = B.part_faults(spark.createDataFrame([("w", s, j) for s, j, *_ in B.QUADRUPED_SLOTS] + [("q", "body", "body"), ("q", "wing_f", "wing_f")], "owner string, slot string, joint string"), "quadruped-side")
    assert {tuple(r) for r in faults.collect()} == {("w", "unsupported wing_f"), ("w", "unsupported wing_b"), ("q", "unsupported wing_f"), ("q", "missing head"), ("q", "missing forelegs"), ("q", "missing hindlegs")}
    with pytest.raises(ValueError, match="archetype"):
        B.tables("snake")


def test_plans_are_checked_again(spark):
    plan = spark.createDataFrame([("p", 3, "x"), ("q", 1, None)], "id string, updates int, hash string")
    now = plan.withColumn("updates", F.when(F.col("id") == "p", 4).otherwise(F.col("updates")))
    assert [tuple(r) for r in I.changed(plan, now, "id").collect()] == [("p", "updates", "3", "4")]
    assert I.one_of(rig=None, sheet="a") == "sheet"
    for given in ({"a": 1, "b": 2}, {"a": None}):
        with pytest.raises(ValueError, match="exactly one"):
            I.one_of(**given)
