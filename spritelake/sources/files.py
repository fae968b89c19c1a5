"""Scans of files: frames, images, JSON, text, archives, tensor headers, inventories.

All go through Spark's own readers, so any file system will do; names and lengths are filtered
before contents are decoded.
"""

from __future__ import annotations

import hashlib
import io
import json
import unicodedata
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.configuration import strict_loads
from .png import BadImage, decode
from .ranges import header_of

IGNORED = ("contact.png", "preview.png")  # fixed names of overviews


def files(spark: SparkSession, path: str, pattern: str = "*", deep: bool = False) -> DataFrame:
    """path, name, length, modified and content; columns not asked for are not read."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(deep).lower()).load(path)
    return read.select("path", C.base_name(F.col("path")).alias("name"), "length", F.col("modificationTime").alias("modified"), "content")


def non_empty(df: DataFrame, message: str) -> DataFrame:
    """The rows; none at all is an error when they are read."""
    count = df.groupBy().agg(F.count(F.lit(1)).alias("_n")).select(F.when(F.col("_n") > 0, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")).alias("_ok"))
    return df.crossJoin(F.broadcast(count)).where("_ok").drop("_ok")  # one row


def frames(spark: SparkSession, path: str, clip: str | None = None) -> DataFrame:
    """PNG frames of one folder with their place in natural order; of one clip by name or prefix.  Names are
    numbered by themselves, and the files meet their numbers by path."""
    from ..operators.ordinals import ordinals

    found = files(spark, path, "*.png").where(~F.startswith("name", F.lit("_")) & ~F.col("name").isin(*IGNORED))
    if clip is not None:
        stem = C.stem(F.col("name"))
        found = found.where((stem == clip) | F.startswith(stem, F.lit(f"{clip}_")))
    numbers = ordinals(found.select("path", "name"), [C.natural_key(F.col("name")), "name"], name="seq").select("path", (F.col("seq") + 1).cast("int").alias("seq"))
    return non_empty(found, f"no frames in {path}").join(numbers, "path", "left")


def layouts(spark: SparkSession, root: str, clips: list[str]) -> DataFrame:
    """Frames of each clip from the first layout that has any: clip/frames/, clip/, or root/clip_*.png."""
    from pyspark.sql import Window

    every = files(spark, root, "*.png", deep=True)
    path, listed = F.col("path"), F.explode(F.array(*map(F.lit, clips)))
    rows = every.select("*", listed.alias("clip"))
    inner = F.regexp_replace(path, F.lit("^.*?" + root.rstrip("/").replace("file://", "") + "/"), F.lit(""))
    rows = rows.withColumn("inner", inner)
    folder = F.regexp_replace("inner", "[^/]*$", "")
    layout = (
        F.when(folder == F.concat("clip", F.lit("/frames/")), 1).when(folder == F.concat("clip", F.lit("/")), 2)
        .when((folder == "") & ((C.stem(F.col("name")) == F.col("clip")) | F.startswith("name", F.concat("clip", F.lit("_")))), 3)
    )
    rows = rows.withColumn("layout", layout).where("layout IS NOT NULL")
    return rows.withColumn("first", F.min("layout").over(Window.partitionBy("clip"))).where("layout = first").drop("first", "inner")


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                image, alpha = decode(data)
                rgb = image[:, :, :3].tobytes()
                rows.append((path, image.shape[1], image.shape[0], alpha, image.tobytes(), hashlib.sha256(rgb).hexdigest(), hashlib.sha256(data).hexdigest(), None))
            except BadImage as error:
                rows.append((path, None, None, None, None, None, hashlib.sha256(data).hexdigest(), str(error)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.string(), pa.string(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.string(), pa.string(), pa.string())], names=["path", "w", "h", "has_alpha", "rgba", "pixel_sha256", "file_sha256", "error"])


def images(found: DataFrame) -> DataFrame:
    """Decoded images: what can't be decoded has an error and no pixels, and is never an exception."""
    return found.select("path", "content").mapInArrow(_images, "path string, w int, h int, has_alpha boolean, rgba binary, pixel_sha256 string, file_sha256 string, error string")


def probe(decoded: DataFrame, least: int = 64, most: int = 4096, step: int = 16) -> DataFrame:
    """Readiness of each image: decoded, sides within bounds and in steps."""
    fits = lambda c: F.col(c).between(least, most) & (F.col(c) % step == 0)
    state = F.when(F.col("error").isNotNull(), F.col("error")).when(~fits("w"), "width").when(~fits("h"), "height")
    return decoded.select("path", "w", "h", state.alias("error"), state.isNull().alias("ready"))


def texts(found: DataFrame) -> DataFrame:
    """Stripped UTF-8 texts with the digest of their bytes; empty ones and those with NUL have an error."""
    text = F.trim(F.try_validate_utf8(F.col("content").cast("string")))
    fault = F.when(text.isNull(), "not UTF-8").when(text == "", "empty").when(F.contains(text, F.lit("\0")), "NUL")
    return found.select("path", text.alias("text"), F.sha2("content", 256).alias("sha256"), fault.alias("error"))


def strict_json(text: Column) -> Column:
    """A variant, or null for what isn't JSON with keys that occur once: repeated keys, NaN, infinities and text after it."""
    return F.try_parse_json(text)


def json_objects(found: DataFrame, unique: bool = False) -> DataFrame:
    """path, sha256, value, error of JSON files; numbers that overflow, NaN, infinities and roots that are
    no objects are errors, and with ``unique`` repeated keys too (else the last one counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for data in batch.column(1).to_pylist():
                text = error = None
                try:
                    value = strict_loads(data, unique)
                    text, error = (json.dumps(value), None) if isinstance(value, dict) else (None, "not an object")
                except (ValueError, TypeError, RecursionError) as fault:
                    error = f"not strict JSON: {fault}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "sha256", "text", "error"])

    parsed = found.select("path", "content", F.sha2("content", 256).alias("sha256")).mapInArrow(run, "path string, sha256 string, text string, error string")
    return parsed.select("path", "sha256", F.try_parse_json("text").alias("value"), "error")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in z.infolist():
                        rows.append((path, m.filename, m.file_size, (m.external_attr >> 16) & 0xFFFF, bool(m.flag_bits & 1), m.is_dir(), unicodedata.normalize("NFC", m.filename).casefold(), None))
            except zipfile.BadZipFile as error:
                rows.append((path, None, None, None, None, None, None, str(error)))
        types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["archive", "name", "size", "mode", "encrypted", "folder", "key", "error"])


def archive_members(found: DataFrame) -> DataFrame:
    """The member table of ZIP archives; ``key`` is the name as a case-blind file system sees it."""
    return found.select("path", "content").mapInArrow(_members, "archive string, name string, size long, mode int, encrypted boolean, folder boolean, key string, error string")


def unsafe_members(members: DataFrame, most: int = 4 << 30) -> DataFrame:
    """Members that must not be read, with the reason: unsafe or clashing names, links, encryption, size."""
    from pyspark.sql import Window

    link = F.shiftright("mode", 12) == 10
    clash = F.count(F.lit(1)).over(Window.partitionBy("archive", "key")) > 1
    reason = F.when(F.col("error").isNotNull(), "damaged").when(~C.safe_path(F.col("name")), "path").when(link, "link").when(F.col("encrypted"), "encrypted").when(F.col("size") > most, "size").when(clash, "clash")
    return members.select("archive", "name", reason.alias("reason")).where("reason IS NOT NULL")


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                rows += [(path, *r, None) for r in header_of(lambda at, n, d=data: d[at : at + n], len(data))]
            except ValueError as error:
                rows.append((path, None, None, None, None, None, str(error)))
        types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "name", "dtype", "shape", "begin", "end", "error"])


def tensors(found: DataFrame) -> DataFrame:
    """Headers of files that are held whole; ``ranges.tensor_headers`` reads those of large ones."""
    return found.select("path", "content").mapInArrow(_tensors, "path string, name string, dtype string, shape array<long>, begin long, end long, error string")


SUFFIXES = [(".lora_A.weight", ".lora_B.weight"), (".lora_down.weight", ".lora_up.weight"), (".lora.down.weight", ".lora.up.weight")]  # fixed pairs of names


def has_pairs(rows: DataFrame) -> DataFrame:
    """Whether a file holds both members of a pair for some stem, by one equi-join on the stem."""
    cut = None
    for k, (a, b) in enumerate(SUFFIXES):
        for side, suffix in enumerate((a, b)):
            part = rows.where(F.endswith("name", F.lit(suffix))).select("path", F.lit(k).alias("pair"), F.substr("name", F.lit(1), F.length("name") - len(suffix)).alias("stem"), F.lit(side).alias("side"))
            cut = part if cut is None else cut.unionByName(part)
    both = cut.groupBy("path", "pair", "stem").agg(F.count_distinct("side").alias("sides")).groupBy("path").agg(F.bool_or(F.col("sides") == 2).alias("paired"))
    return rows.select("path").distinct().join(both, "path", "left").select("path", F.coalesce("paired", F.lit(False)).alias("paired"))


def inventory(spark: SparkSession, path: str, memory_mb: int = 23 * 1024, capability: float = 7.5, driver: int = 580) -> DataFrame:
    """Devices of a CSV inventory with what makes them eligible."""
    schema = "idx int, name string, memory_total_mb long, memory_free_mb long, capability double, driver string, uuid string"
    rows = spark.read.csv(path, schema=schema, ignoreLeadingWhiteSpace=True)
    major = F.split("driver", r"\.")[0].try_cast("int")
    fits = (F.col("memory_total_mb") >= memory_mb) & (F.col("capability") >= capability) & (major >= driver)
    return rows.withColumn("eligible", F.coalesce(fits, F.lit(False)))


def package_versions(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (name, version) of package METADATA files."""
    text = files(spark, path, "METADATA", deep=True).select(F.col("content").cast("string").alias("t"))
    pick = lambda key: F.regexp_extract("t", rf"(?m)^{key}:[ \t]*(\S+)[ \t]*\r?$", 1)
    return text.select(F.lower(pick("Name")).alias("name"), pick("Version").alias("version")).where("name <> '' AND version <> ''").distinct()


def model_files(spark: SparkSession, path: str) -> DataFrame:
    """Kinds of the files of a model folder by name and length alone; contents are not read."""
    name = F.col("name")
    kind = F.when(F.endswith(name, F.lit(".index.json")), "index").when(F.endswith(name, F.lit(".json")), "config").when(F.endswith(name, F.lit(".safetensors")), "weights").otherwise("other")
    return files(spark, path, "*", deep=True).where(~F.contains("path", F.lit("/.cache/"))).select("path", "name", "length", kind.alias("kind"))
