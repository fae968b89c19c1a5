"""Ordinals, regions, palettes, layouts, rendering, reconciliation: edges and plans beside what SQL holds."""

import hashlib
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spritelake.operators import assembly, bundles, fingerprints, palettes, parts, rasters, regions, rendering, specs
from spritelake.operators.ordinals import ordinals
from spritelake.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ordinals_of_hot_groups_ties_and_nulls(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"g{i}", i // 5, i) for i in range(900)] + [("hot", 1, 7)] * 300
    df = spark.createDataFrame(rows, "g string, place int, part int")
    out = ordinals(df, ["place"], ["g"], "n", "total")
    assert out.columns == ["g", "place", "part", "n", "total"]
    got = out.collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["n"])
        assert [r["n"] for r in mine] == list(range(len(mine))) and {r["total"] for r in mine} == {len(mine)} and [r["place"] for r in mine] == sorted(r["place"] for r in mine)
    assert Counter((r["g"], r["place"], r["part"]) for r in got) == Counter(rows)
    assert ordinals(df.where("place < 0"), ["place"], name="place2").count() == 0
    whole = ordinals(df, ["part"], name="n")
    assert sorted(r["n"] for r in whole.collect()) == list(range(len(rows)))


def test_ranked_rows_meet_in_no_single_task(spark):
    for name in ("natural_order", "split_export_order", "mask_iou_consecutive"):
        text = plan(catalogue.queries()[name](spark, SF))
        before, _, after = text.partition("Window")
        assert "SinglePartition" not in before and "HashAggregate" in after, name  # windows see counts only


def picture(rows):
    return [c == "#" for r in rows for c in r]


def test_regions_across_tiles_and_corners(spark):
    image = ["##..#...", "..#.#..#", "........", "#######.", "#.....#.", "#.###.#.", "#.....#.", "#######."]
    tiles = [("a", 4, x, y, picture([r[x : x + 4] for r in image[y : y + 4]])) for x in (0, 4) for y in (0, 4)] + [("none", 4, 0, 0, [False] * 16), ("null", 4, 0, 0, None), ("some", 2, 0, 0, [None, True])]
    df = spark.createDataFrame(tiles, "image string, w int, x int, y int, mask array<boolean>")
    table = regions.runs(df, "image", left=F.col("x"), top=F.col("y"))
    for corners, want in ((True, {(0, 0): 3, (0, 4): 2, (1, 7): 1, (3, 0): 20, (5, 2): 3}), (False, {(0, 0): 2, (1, 2): 1, (0, 4): 2, (1, 7): 1, (3, 0): 20, (5, 2): 3})):
        found = regions.measured(regions.regions(table.where("image = 'a'"), corners)).collect()
        assert {(r["region"]["y"], r["region"]["x0"]): r["area"] for r in found} == want
    whole = regions.runs(spark.createDataFrame([("a", 8, picture(image))], "image string, w int, mask array<boolean>"), "image")
    one, cut = (regions.measured(regions.regions(t)) for t in (whole, table.where("image = 'a'")))
    assert one.exceptAll(cut).count() == cut.exceptAll(one).count() == 0
    assert regions.regions(table).where("image = 'some'").count() == 1 and "Exchange" not in plan(table)


@pytest.mark.parametrize("seed", range(3))
def test_long_regions(spark, seed):
    """Spirals and noise, as chains of runs are long there."""
    rng = random.Random(seed)
    n = 24
    mask = [[rng.random() < 0.55 for _ in range(n)] for _ in range(n)]
    label = {}
    for y in range(n):
        for x in range(n):
            if mask[y][x] and (y, x) not in label:
                stack = [(y, x)]
                while stack:
                    p = stack.pop()
                    if p in label or not (0 <= p[0] < n and 0 <= p[1] < n) or not mask[p[0]][p[1]]:
                        continue
                    label[p] = (y, x)
                    stack += [(p[0] + dy, p[1] + dx) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))]
    df = spark.createDataFrame([("a", n, [v for row in mask for v in row])], "image string, w int, mask array<boolean>")
    got = {(r["y"], x): tuple(r["region"]) for r in regions.regions(regions.runs(df, "image"), corners=False).collect() for x in range(r["x0"], r["x1"] + 1)}
    assert got == label


def in_jobs(spark, group, made):
    """What is made, and by how many jobs."""
    spark.sparkContext.setJobGroup(group, group)
    out = made()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, jobs


@pytest.mark.parametrize("corners", [True, False])
def test_regions_across_blocks(spark, monkeypatch, corners):
    """Small bands and blocks give the regions of one block; images within one block need no rounds of joins."""
    rng = random.Random(7)
    n = 40
    images = [(k, n, [rng.random() < 0.5 + k / 20 for _ in range(n * n)]) for k in range(4)]
    table = regions.runs(spark.createDataFrame(images, "image int, w int, mask array<boolean>"), "image")
    table = table.unionByName(table.where("image = 1").limit(5))  # runs given twice
    got = lambda: sorted(tuple(map(str, r)) for r in regions.regions(table, corners).collect())
    whole, jobs = in_jobs(spark, f"regions{corners}", got)
    assert jobs <= 6
    for band, held in ((2, 1 << 18), (16, 37), (256, 5)):
        monkeypatch.setattr(regions, "BAND", band)
        monkeypatch.setattr(regions, "HELD", held)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            assert got() == whole
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_corners_are_sorted_once_an_image(spark):
    df = spark.createDataFrame([(1, 2, 2, [5] * 3 + [90], [5] * 4, [5] * 4), (2, 2, 2, [], [], []), (3, 2, 2, None, None, None)], "image int, w int, h int, r array<int>, g array<int>, b array<int>")
    shifted = df.withColumns({c: F.transform(c, lambda x: x + 1) for c in "rgb"})
    table = regions.runs(shifted.withColumn("mask", regions.like_corners(2, 2, 42)), "image")
    assert [tuple(r) for r in table.orderBy("y").collect()] == [(1, 0, 0, 1), (1, 1, 0, 0)]
    optimized = table._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in optimized and optimized.count("array_sort") <= 6


def test_boxes_within_a_gap(spark):
    rng = random.Random(1)
    boxes = [(i % 2, i, x := rng.randrange(200), y := rng.randrange(200), x + rng.randrange(1, 60), y + rng.randrange(1, 60)) for i in range(150)] + [(0, 999, None, 1, 2, 3)]
    got = {tuple(r) for r in regions.near_boxes(spark.createDataFrame(boxes, "image int, id int, x0 int, y0 int, x1 int, y1 int"), 28).collect()}
    apart = lambda a, b: max(b[2] - a[4], a[2] - b[4]) <= 28 and max(b[3] - a[5], a[3] - b[5]) <= 28
    assert got == {(a[0], a[1], b[1]) for a in boxes[:-1] for b in boxes[:-1] if a[0] == b[0] and a[1] < b[1] and apart(a, b)}


def test_pairs_of_boxes_come_once(spark):
    """Boxes over many cells meet in many, and each pair counts in one of them, without a grouping of the pairs."""
    rng = random.Random(3)
    boxes = [(0, i, x := rng.randrange(-300, 300), y := rng.randrange(-300, 300), x + rng.randrange(1, 400), y + rng.randrange(1, 400)) for i in range(60)]
    found = regions.near_boxes(spark.createDataFrame(boxes, "image int, id int, x0 int, y0 int, x1 int, y1 int"), 3)
    apart = lambda a, b: max(b[2] - a[4], a[2] - b[4]) <= 3 and max(b[3] - a[5], a[3] - b[5]) <= 3
    assert sorted(tuple(r) for r in found.collect()) == sorted((0, a[1], b[1]) for a in boxes for b in boxes if a[1] < b[1] and apart(a, b))
    assert "Aggregate" not in plan(found)


def test_grids_are_looked_up(spark):
    found = spark.createDataFrame([(n,) for n in (None, *range(-1, 150))], "n int").select("n", rasters.grid_for(F.col("n")).alias("g"))
    for r in found.collect():
        want = min(((c * k, abs(c - k), c, k) for c in range(1, 13) for k in range(1, 13) if c * k >= r["n"]), default=None) if r["n"] is not None else None
        assert (tuple(r["g"]) if r["g"] else None) == want, r["n"]
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_reconciliation_is_dealt_by_rows(spark, monkeypatch):
    query = catalogue.queries()["split_reconciliation"]
    want = sorted(map(tuple, query(spark, SF).collect()))
    rows = spark.read.parquet(f"{SF}/orders.parquet").count()
    monkeypatch.setattr(bundles, "PER_TASK", 100)
    got = query(spark, SF)
    assert all(f"{key}, {-(-3 * rows // 100)})" in re.sub(r"#\d+L?", "", plan(got)) for key in ("(sample", "(path", "(position"))
    assert sorted(map(tuple, got.collect())) == want


def test_shared_paths_do_not_multiply(spark):
    """All entries name one path, which the folder has as often: 20,000 x 20,000 rows if they met one by one."""
    n = 20_000
    k = spark.range(1, n + 1)
    entries = k.select(F.col("id").alias("position"), F.col("id").alias("index"), F.col("id").cast("string").alias("sample"), F.lit(0).alias("prompt_index"), F.lit("t/1_in.png").alias("input"), F.lit("t/1_out.png").alias("target"), F.lit("t/1_in.txt").alias("prompt"))
    samples = k.select(F.col("id").cast("string").alias("sample"), F.lit("train").alias("split"), F.lit("c").alias("character"), F.lit("h").alias("input_hash"), F.lit("h").alias("target_hash"))
    png = lambda path, hash: k.select(F.lit(path).alias("path"), (F.col("id") % 2 + 4).cast("int").alias("w"), F.lit(4).alias("h"), hash.alias("hash"), F.lit(True).alias("regular"))
    files = png("t/1_in.png", F.lit("h")).unionByName(png("t/1_out.png", F.when(F.col("id") > 1, "h"))).unionByName(png("t/1_in.txt", F.lit("p")).withColumns({c: F.lit(None).cast("int") for c in "wh"}))
    found = Counter(r["rule"] for r in bundles.split_faults(entries, samples, files, "t", "train", 8).collect())
    assert found == {"reused": n, "number": n - 1, "missing": n, "image_sizes": 1}


def test_palettes(spark):
    rng = random.Random(2)
    px = [(c, i, rng.randrange(256), rng.randrange(256), rng.randrange(256), 255) for c in (1, 2) for i in range(400)] + [(3, i, i % 5, 0, 0, 255) for i in range(50)] + [(4, 0, 1, 1, 1, 0), (5, 0, None, 1, 1, 255)]
    df = spark.createDataFrame(px, "clip int, i int, r int, g int, b int, a int")
    palette = palettes.shared_palette(palettes.histogram(df), 8)
    assert {r["clip"]: r["n"] for r in palette.groupBy("clip").agg(F.count("*").alias("n")).collect()} == {1: 8, 2: 8}
    out = palettes.recoloured(df, palette)
    colours = {r["clip"]: r["n"] for r in out.groupBy("clip").agg(F.count_distinct(F.struct("r", "g", "b")).alias("n")).collect()}
    assert colours[1] <= 8 and colours[2] <= 8 and colours[3] == 5 and out.count() == len(px)
    entries = {c: [(r["r"], r["g"], r["b"]) for r in palette.where(f"clip = {c}").orderBy("entry").collect()] for c in (1, 2)}
    far = lambda p, q: sum((x - y) ** 2 for x, y in zip(p, q, strict=True))
    for r in out.join(df.select("clip", "i", *(F.col(c).alias(f"o{c}") for c in "rgb")), ["clip", "i"]).where("clip < 3").collect():
        own = (r["or"], r["og"], r["ob"])
        assert (r["r"], r["g"], r["b"]) == min(entries[r["clip"]], key=lambda p: far(p, own))
    with pytest.raises(ValueError):
        palettes.median_cut(palettes.histogram(df), 1)


def test_layouts_as_published(spark):
    frame = [(0, 1, 40, 40, 0, 0, 21, 21, 10, 20)]
    df = spark.createDataFrame(frame, "frame long, clip int, w int, h int, x0 int, y0 int, x1 int, y1 int, foot_x int, foot_y int")
    for padding in (3, 4):
        assert assembly.layout(df, (40, 40), (20, 37), padding).first()["scale"] == 1.0
    grown = assembly.layout(df, (80, 90), (40, 80), 3, True).first()
    assert grown["scale"] == pytest.approx(min(37 / 10, 36 / 10, 77 / 20)) and grown["target_w"] == 144 and grown["fault"] is None
    union = assembly.layout(df).first()
    assert (union["canvas_w"], union["canvas_h"], union["anchor_x"], union["anchor_y"], union["scale"]) == (44, 44, 22, 41, 1.0)
    assert assembly.layout(df, (10, 10), (2, 8), 2).first()["fault"].startswith("bounds would")
    assert assembly.layout(df.withColumn("foot_x", F.lit(40)), (90, 90), (40, 80), 2).first()["fault"].startswith("a foot")


def test_compositing_of_many_layers(spark):
    """Three hundred layers at one place, four at a time, against one after another."""
    rng = random.Random(4)
    layers = [("p", k, 0, 0, rng.randrange(256), rng.randrange(256), rng.randrange(256), rng.choice((0, 20, 60))) for k in range(300)] + [("p", 1, 3, 3, 9, 9, 9, 0), ("q", 1, 0, 0, 5, 6, 7, 255)]
    got = {(r["image"], r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in rendering.composited(spark.createDataFrame(layers, "image string, z int, x int, y int, r int, g int, b int, a int"), ["image"], ["z"], 4).collect()}
    colour, alpha = [0.0] * 3, 0.0
    for *_, r, g, b, a in sorted(x for x in layers if x[:1] == ("p",) and x[2] == 0):
        a /= 255
        colour = [u * a + d * (1 - a) for u, d in zip((r, g, b), colour, strict=True)]
        alpha = a + alpha * (1 - a)
    want = (*(int(c / alpha + 0.5) for c in colour), int(alpha * 255 + 0.5))
    assert got.pop(("q", 0, 0)) == (5, 6, 7, 255) and list(got) == [("p", 0, 0)]
    assert max(abs(x - y) for x, y in zip(got["p", 0, 0], want, strict=True)) == 0


def test_every_gate_of_rendering(spark):
    frames = spark.createDataFrame([("idle", 0), ("idle", 1), ("jump", 0), ("fall", 0), ("fall", 1)], "clip string, i int")
    px = [("idle", 0, 12, y) for y in range(10, 20)] + [("jump", 0, 12, y) for y in range(2, 6)] + [("fall", 0, x, 15) for x in (0, 30)] + [("fall", 1, 12, y) for y in range(3, 39)]
    measured = rendering.boxes(spark.createDataFrame(px, "clip string, i int, x int, y int"), frames)
    clips = spark.createDataFrame([("idle", False), ("jump", True), ("fall", True)], "clip string, grounded boolean")
    locked = rendering.grounded(measured, clips, ("idle", 0), 40)
    found = {(r["clip"], r["i"], r["rule"], r["told"]) for r in rendering.gate_faults(locked, (40, 40), (10, 10, 20, 20)).collect()}
    assert {("idle", 1, "empty", ""), ("fall", 0, "edge", ""), ("fall", 0, "overflow", "left=10px, right=11px"), ("fall", 1, "ground", "-19"), ("fall", 1, "overflow", "top=10px")} == found
    assert locked.where("clip = 'jump'").first()["shift"] == 14
    with pytest.raises(Exception, match="reference frame is empty"):
        rendering.grounded(measured, clips, ("idle", 1), 40).collect()


def test_every_rule_of_splits_bundles_and_specs_is_hit(spark):
    rules = lambda name, c="rule": {r[c] for r in catalogue.queries()[name](spark, SF).select(c).distinct().collect()}
    assert rules("split_reconciliation") == {"index", "duplicate", "unknown", "prompt_index", "parent", "reused", "names", "basenames", "number", "missing", "sizes", "input_pixels", "target_pixels", "surplus", "image_sizes"}
    assert rules("bundle_integrity") >= {"order", "repeated", "blank", "gap", "shared", "holdout_count", "image_size", "index", "character", "prompt_index", "missing", "digest", "bytes", "size", "surplus"}
    assert rules("spec_expansion") == {"id", "collision", "escapes", "count", "irregular"}
    assert rules("render_faults") >= {"empty", "edge", "ground", "overflow"}


def test_paths_and_tracks(spark):
    df = spark.createDataFrame([("a/b",), ("./a//b/../c",), ("../a",), ("a/../../b",), ("/a",), ("",)], "p string")
    assert [r[0] for r in df.select(specs.resolved(F.col("p"))).collect()] == ["a/b", "a/c", None, None, None, ""]
    tracks = spark.createDataFrame([("walk", "hip", "offset_x", 0.0, 2.0)], "clip string, joint string, channel string, t double, value double")
    joints = spark.createDataFrame([("hip",), ("hip",)], "joint string")
    assert specs.restricted_tracks(tracks, joints, ["walk", "walk"], 0.5).first()["value"] == 1.0
    with pytest.raises(Exception, match="a clip is unknown"):
        specs.restricted_tracks(tracks, joints, ["walk", "swim"], 0.5).collect()


def test_fingerprint_trees(spark):
    lines = [f"{i:05d}|{i * 7}" for i in range(50)]
    df = lambda ls: spark.createDataFrame([("g", x) for x in ls] + [("h", "one"), ("n", None)], "g string, line string")

    def root(ls, fan):
        while True:
            ls = [hashlib.sha256("\n".join(ls[k : k + fan]).encode()).hexdigest() for k in range(0, len(ls), fan)]
            if len(ls) == 1:
                return ls[0]

    shuffled = random.Random(0).sample(lines, len(lines))
    got = {r["g"]: (r["lines"], r["fingerprint"]) for r in fingerprints.fingerprint_tree(df(shuffled), ["g"], F.col("line"), 4).collect()}
    assert got == {"g": (50, root(lines, 4)), "h": (1, root(["one"], 4))}
    other = [x.replace("00033|", "00033!") for x in lines]
    a, b = (fingerprints.fingerprint_levels(df(x), ["g"], F.col("line"), 4) for x in (lines, other))
    assert [tuple(r) for r in fingerprints.changed(a, b, ["g"], 4).collect()] == [("g", 8)]
    assert fingerprints.fingerprint_tree(df([]).where("g = 'x'"), ["g"], F.col("line")).count() == 0


def test_parts_reach_to_their_pivots(spark):
    px = spark.createDataFrame([(1, "arm", x, y) for x in (4, 5) for y in (4, 5)] + [(1, "leg", 0, 9)], "frame long, part string, x int, y int")
    pivots = spark.createDataFrame([("arm", 0.5, 0.0), ("leg", 0.0, 1.0), ("none", 0.0, 0.0)], "part string, share_x double, share_y double")
    got = {r["part"]: tuple(r)[2:] for r in parts.cut_parts(px, pivots).collect()}
    assert got == {"arm": (2, 4, 6, 6, 0, 0, 4), "leg": (0, 9, 1, 10, 0, 0, 1)}
    cut = parts.cut_parts(px, pivots)
    assert parts.rest_overlap(px, px, cut).first()["iou"] == 1.0 and parts.rest_overlap(px, px, cut.where("part = 'arm'")).first()["iou"] == 0.8
    mixed = spark.createDataFrame([(1, 255, 0), (1, 255, 9), (2, 255, 0), (2, 0, 9)], "frame long, a int, clean_a int")
    assert sorted(tuple(r) for r in parts.foreground(mixed).collect()) == [(1, 255, 9), (2, 255, 0)]


def test_listed_names(spark):
    names = spark.createDataFrame([("t", 1, "a"), ("t", 2, "a"), ("t", 4, "c"), ("t", 5, "b"), ("u", 1, "b "), ("u", 2, None)], "list string, position int, name string")
    assert {tuple(r) for r in bundles.list_faults(names).collect()} == {("t/2", "repeated"), ("t/4", "gap"), ("t/5", "order"), ("u/1", "blank"), ("u/2", "blank")}
    assert bundles.disjoint_faults(names, "t", "u").count() == 0


def test_datasets_tell_what_is_missing(spark):
    from spritelake.operators import datasets

    clips = [("walk", "{direction}/{clip}_*.png", 2)]
    characters = spark.createDataFrame([("a", "/a", "{direction}/reference.png", ["east", "west"], clips)], "id string, root string, reference string, directions array<string>, clips array<struct<id:string,pattern:string,expected:int>>")
    image = (2, 2, [9] * 4, [8] * 4, [7] * 4, [255] * 4)
    files = spark.createDataFrame([("/a", p, True, *image) for p in ("east/reference.png", "east/walk_10.png", "east/walk_9.png", "west/walk_1.png", "west/walk_2.png")], "root string, path string, regular boolean, w int, h int, r array<int>, g array<int>, b array<int>, a array<int>")
    made = datasets.build(characters, files, [])
    assert [tuple(r) for r in made.faults.collect()] == [("a__west", "reference", "west/reference.png")]
    assert [r["input"] for r in made.entries.orderBy("ordinal").collect()] == ["mflux/train/0001_in.png", "mflux/train/0002_in.png"]
    assert {(r["sample"], r["kind"], r["n"]) for r in made.boards.groupBy("sample", "kind").agg(F.count("*").alias("n")).collect()} == {("a__east__walk", "input", 12), ("a__east__walk", "target", 12), ("a__west__walk", "input", 8), ("a__west__walk", "target", 8)}
    pixels, faults = datasets.delivered(spark.createDataFrame([(1, 4, 2, [5] * 8, [5] * 8, [5] * 8), (2, 3, 2, [5] * 6, [5] * 6, [5] * 6)], "board int, w int, h int, r array<int>, g array<int>, b array<int>"), 2, 1, (2, 2), (4, 4), (2, 2))
    assert pixels.count() == 0 and {tuple(r) for r in faults.collect()} == {(1, 1, "empty"), (2, None, "size")}


def test_left_tables_are_released(spark, tmp_path):
    from spritelake.sources import tables

    df = tables.written(spark.range(5).withColumn("x", F.col("id") % 2))
    other = tables.shared_dir(spark) + "-named"
    df.write.parquet(other)
    folders = [f.removeprefix("file://").rsplit("/", 1)[0] for f in df.inputFiles()[:1]] + [other.removeprefix("file://")]
    assert all(map(os.path.isdir, folders))
    assert tables.release(spark) >= 2 and not any(map(os.path.exists, folders)) and tables.release(spark) == 0
