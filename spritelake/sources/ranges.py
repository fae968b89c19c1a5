"""Tables of what stands at the ends of large files, read by byte ranges: tensor headers and archive directories.

    tensor_headers(spark, "s3://bucket/models").where("name LIKE 'blocks.%'")

The driver lists names and sizes, as for any file source; a task opens some of the files and reads
their header or directory only, so a file of any size costs its few kilobytes.  Equality and prefix filters on
``path`` drop files before they are opened and those on ``name`` drop rows before they are
sent (where ``spark.sql.python.filterPushdown.enabled`` is on; Spark applies all filters again).
Paths may be of any file system that Arrow knows.  A file that breaks a rule is one row with its ``error``;
symbolic links are such files.  A folder without files of the suffix has no rows.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zipfile
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

MOST_HEADER = 16 << 20  # bytes of a header, fixed by the format's rule
FILES = 64  # opened by one task


def parse_header(raw: bytes, room: int) -> list[tuple[str, str, list[int], int, int]]:
    """(name, dtype, shape, begin, end) of a tensor header whose data has ``room`` bytes.

    Any type name is legal.  No tensor at all, metadata that is no object, names or types that are empty, and
    shapes or offsets that are no lengths within the file are errors.
    """
    try:
        head = json.loads(raw.decode())
    except ValueError as error:
        raise ValueError("the header is not JSON in UTF-8") from error
    if not isinstance(head, dict) or not isinstance(head.get("__metadata__") or {}, dict):
        raise ValueError("the header or its metadata is no object")
    length = lambda n: type(n) is int and n >= 0
    out = []
    for name, entry in head.items():
        if name == "__metadata__":
            continue
        kind, shape, at = (entry.get(k) for k in ("dtype", "shape", "data_offsets")) if isinstance(entry, dict) else (None, None, None)
        if not name or not isinstance(kind, str) or not kind or not isinstance(shape, list) or not all(map(length, shape)):
            raise ValueError(f"bad entry {name}")
        if not isinstance(at, list) or len(at) != 2 or not all(map(length, at)) or not at[0] <= at[1] <= room:
            raise ValueError(f"bad entry {name}: offsets")
        out.append((name, kind, shape, at[0], at[1]))
    if not out:
        raise ValueError("no tensors")
    return out


def header_of(read: Callable[[int, int], bytes], size: int) -> list[tuple[str, str, list[int], int, int]]:
    """The entries of a tensor file of ``size`` bytes, by two reads of (from, bytes)."""
    if size < 10:
        raise ValueError("shorter than a header")
    (n,) = struct.unpack("<Q", read(0, 8))
    if not 2 <= n <= min(MOST_HEADER, size - 8):
        raise ValueError("the header is larger than allowed or than the file")
    return parse_header(read(8, n), size - 8 - n)


class _Some(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    suffix: str
    width: int  # columns but for path and error

    def __init__(self, options: dict[str, str]):
        self.root, self.per_task = options["path"], int(options.get("filesPerTask", FILES))
        self.tests: dict[str, list[Callable[[str], bool]]] = {"path": [], "name": []}

    def keeps(self, column: str, value: str | None) -> bool:
        return value is None or all(test(value) for test in self.tests[column])

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(self.root))
        found = system.get_file_info(fs.FileSelector(base, recursive=True)) if system.get_file_info(base).type == fs.FileType.Directory else [system.get_file_info(base)]
        files = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.endswith(self.suffix) and self.keeps("path", i.path))
        return [_Some(files[k : k + self.per_task]) for k in range(0, len(files), self.per_task)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else fs.LocalFileSystem()
        for path, size in partition.files if partition else ():
            try:
                if isinstance(system, fs.LocalFileSystem) and os.path.islink(path):
                    raise ValueError("a symbolic link")
                with system.open_input_file(path) as f:
                    for row in self.rows(f, size):
                        if self.keeps("name", row[0]):
                            yield (path, *row, None)
            except (ValueError, OSError, zipfile.BadZipFile) as error:
                yield (path, *[None] * self.width, str(error))


class _Pushed:
    """A reader that takes filters; Spark lets it only where its setting for that is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in self.tests:
                if isinstance(f, EqualTo):
                    self.tests[column].append(lambda x, v=f.value: x == v)
                elif isinstance(f, In):
                    self.tests[column].append(lambda x, v=set(f.value): x in v)
                elif isinstance(f, StringStartsWith):
                    self.tests[column].append(lambda x, v=f.value: x.startswith(v))
            yield f  # Spark applies it too


class _Headers(_Reader):
    suffix, width = ".safetensors", 5

    def rows(self, f, size: int) -> Iterator[tuple]:
        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        yield from header_of(read, size)


class _Members(_Reader):
    suffix, width = ".zip", 6

    def rows(self, f, size: int) -> Iterator[tuple]:
        with zipfile.ZipFile(f) as z:
            for m in z.infolist():
                yield m.filename, m.file_size, (m.external_attr >> 16) & 0xFFFF, bool(m.flag_bits & 1), m.is_dir(), unicodedata.normalize("NFC", m.filename).casefold()


class _PushedHeaders(_Pushed, _Headers):
    pass


class _PushedMembers(_Pushed, _Members):
    pass


class TensorHeaders(DataSource):
    """path, name, dtype, shape, begin, end, error: a row for each tensor of each file."""

    @classmethod
    def name(cls) -> str:
        return "tensor_headers"

    def schema(self) -> str:
        return "path string, name string, dtype string, shape array<long>, begin long, end long, error string"

    def reader(self, schema) -> DataSourceReader:
        return (_PushedHeaders if self.options.get("pushed") == "true" else _Headers)(self.options)


class ArchiveMembers(DataSource):
    """archive, name, size, mode, encrypted, folder, key, error: a row for each member of each ZIP archive."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, name string, size long, mode int, encrypted boolean, folder boolean, key string, error string"

    def reader(self, schema) -> DataSourceReader:
        return (_PushedMembers if self.options.get("pushed") == "true" else _Members)(self.options)


def _load(spark: SparkSession, source: type[DataSource], path: str, options: dict[str, str]) -> DataFrame:
    spark.dataSource.register(source)
    pushed = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    return spark.read.format(source.name()).options(pushed=pushed, **options).load(path)


def tensor_headers(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return _load(spark, TensorHeaders, path, options)


def archive_members(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return _load(spark, ArchiveMembers, path, options)


def shard_faults(headers: DataFrame, index: DataFrame) -> DataFrame:
    """name, shard, fault: where tensor headers and a shard index (name, shard) of a model folder disagree.

    missing: the shard hasn't the tensor that the index puts there (or isn't there); unlisted: a shard's tensor isn't in
    the index; elsewhere: it is listed for another shard; repeated: it is listed more than once.
    """
    own = headers.where("name IS NOT NULL").select("name", F.substring_index("path", "/", -1).alias("shard"))
    listed = index.groupBy("name").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("listed"))
    both = own.join(listed, "name", "left")
    unlisted = both.where("listed IS NULL OR listed <> shard").select("name", "shard", F.when(F.col("listed").isNull(), "unlisted").otherwise("elsewhere").alias("fault"))
    missing = index.join(own, ["name", "shard"], "left_anti").select("name", "shard", F.lit("missing").alias("fault"))
    repeated = listed.where("times > 1").select("name", F.col("listed").alias("shard"), F.lit("repeated").alias("fault"))
    return unlisted.unionByName(missing).unionByName(repeated)


def shard_index(documents: DataFrame) -> DataFrame:
    """name, shard of the ``weight_map`` of index documents (a column ``text`` of JSON each)."""
    return documents.select(F.explode(F.from_json("text", "weight_map map<string,string>")["weight_map"]).alias("name", "shard"))
