"""Headers and directories of large files, read by byte ranges."""

import json
import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from spritelake.sources import ranges

ENTRY = {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}


def write(path, entries, size, raw=None):
    head = json.dumps(entries).encode() if raw is None else raw
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(head)) + head)
        f.truncate(8 + len(head) + size)


def test_rules_of_headers(spark, tmp_path):
    write(tmp_path / "good.safetensors", {"u": ENTRY, "odd": {**ENTRY, "dtype": "F8_E5M2"}, "__metadata__": {"a": "b"}}, 24)
    for name, entries in {"none": {}, "only_meta": {"__metadata__": {}}, "meta": {"u": ENTRY, "__metadata__": [1]}, "shape": {"u": {**ENTRY, "shape": [True]}}, "offsets": {"u": {**ENTRY, "data_offsets": [8, 4]}}, "room": {"u": {**ENTRY, "data_offsets": [0, 25]}}, "type": {"u": {**ENTRY, "dtype": ""}}, "name": {"": ENTRY}, "list": [1]}.items():
        write(tmp_path / f"{name}.safetensors", entries, 24)
    write(tmp_path / "utf8.safetensors", None, 0, b"\xff\xfe{}")
    (tmp_path / "short.safetensors").write_bytes(b"123")
    os.symlink(tmp_path / "good.safetensors", tmp_path / "link.safetensors")
    rows = ranges.tensor_headers(spark, str(tmp_path), filesPerTask="3").collect()
    assert {r["name"]: r["dtype"] for r in rows if r["error"] is None} == {"u": "F32", "odd": "F8_E5M2"}
    assert len([r for r in rows if r["error"]]) == 12
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert ranges.tensor_headers(spark, str(tmp_path)).where(F.col("name") == "odd").where("error IS NULL").count() == 1
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_file_of_four_gigabytes_costs_its_header(spark, tmp_path):
    write(tmp_path / "big.safetensors", {f"t{k}": {"dtype": "I8", "shape": [1 << 30], "data_offsets": [k << 30, k + 1 << 30]} for k in range(4)}, 4 << 30)
    assert os.path.getsize(tmp_path / "big.safetensors") > 4 << 30
    rows = ranges.tensor_headers(spark, f"file://{tmp_path}").collect()
    assert sorted(r["name"] for r in rows) == ["t0", "t1", "t2", "t3"] and max(r["end"] for r in rows) == 4 << 30


@pytest.mark.parametrize("column,value,most", [("name", "u1", 1), ("path", "b.safetensors", 5)])
def test_filters_are_pushed(tmp_path, column, value, most):
    from pyspark.sql.datasource import EqualTo

    for name in "ab":
        write(tmp_path / f"{name}.safetensors", {f"u{k}": ENTRY for k in range(5)}, 24)
    reader = ranges.TensorHeaders({"path": str(tmp_path), "pushed": "true"}).reader(None)
    wanted = EqualTo((column,), f"{tmp_path}/{value}" if column == "path" else value)
    assert list(reader.pushFilters([wanted])) == [wanted]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == (most if column == "path" else 2 * most)


def test_archives_and_empty_folders(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("A.txt", "1")
        z.writestr("d/", "")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    rows = {(r["name"], r["key"], r["folder"], r["error"] is None) for r in ranges.archive_members(spark, str(tmp_path)).collect()}
    assert rows == {("A.txt", "a.txt", False, True), ("d/", "d/", True, True), (None, None, None, False)}
    assert ranges.tensor_headers(spark, str(tmp_path)).count() == 0


def test_shards_against_their_index(spark, tmp_path):
    write(tmp_path / "m-1.safetensors", {"a": ENTRY, "b": ENTRY, "x": ENTRY}, 24)
    write(tmp_path / "m-2.safetensors", {"c": ENTRY}, 24)
    text = json.dumps({"weight_map": {"a": "m-1.safetensors", "b": "m-2.safetensors", "c": "m-2.safetensors", "d": "m-3.safetensors"}})
    index = ranges.shard_index(spark.createDataFrame([(text,)], "text string"))
    found = {tuple(r) for r in ranges.shard_faults(ranges.tensor_headers(spark, str(tmp_path)), index).collect()}
    assert found == {("b", "m-1.safetensors", "elsewhere"), ("b", "m-2.safetensors", "missing"), ("x", "m-1.safetensors", "unlisted"), ("d", "m-3.safetensors", "missing")}
