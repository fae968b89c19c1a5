"""WARC archives of captured pages, and their index by external merge.

Writing: each task writes its rows as gzip members, one record each, into an archive of its
own in the shared folder; a new one is begun at ``ARCHIVE_BYTES``.  Of records with equal
payloads (SHA-1 and length) the one with the smallest id is a ``response``; the others are
``revisit`` records that name it and carry no payload of their own.  Payloads shorter than
``least`` bytes are always responses.

Index: writing an archive also yields its capture lines (URL key, timestamp, id, archive,
offset, length, digest).  A task sorts its lines once, ``RUN_LINES`` at a time, and writes each such
run in order.  The runs are cut into ranges of URL key and timestamp by sampled keys; a range
gets its slice of every run, and a loser tree merges the slices, of each of which one block of
``BLOCK_LINES`` is unpacked at a time.  Nothing is sorted twice.  Ranges one after another are one
capture history in global order, and a line's place is its place in the range after the lines of
all ranges before.

Reading: an archive is read member by member; a revisit takes length and digest of the
payload it refers to from its own header fields.

Null payloads are empty ones, null URLs an empty target.  Ids may repeat: every row is written,
and rows that repeat the id and payload of a response are responses too.  Rows without an id
are revisits where a row with an id has their payload.  Payloads of any size go through one record at a time.  A task that is run again
writes under a new name, and only the archives named by its result are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import delete, drop, local_path, shared_dir, written
from ._tokens import U
from .kneser_ney import _save

ARCHIVE_BYTES = 256 << 20
EPOCH = 1_704_067_200  # 2024-01-01; a page's capture time is this plus its id in seconds
RUN_LINES, BLOCK_LINES = 50_000, 512
INDEX = "url_key string, captured string, id long, archive string, offset long, length long, digest string, record_type string, run string, seq long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Host labels reversed, then path and query, in lower case: ``com,example,www)/path?q``."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = "" if parts.port in (None, 80, 443) else f":{parts.port}"
    except ValueError:
        return url.lower()
    path = parts.path.rstrip("/") or "/"
    return f"{','.join(reversed(host.split('.')))}{port}){path}{'?' + parts.query if parts.query else ''}".lower()


def stamp(seconds: int) -> str:
    import datetime

    return datetime.datetime.fromtimestamp(seconds, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page: int | None, url: str, payload: bytes, sha1: str, response: int | None) -> tuple[str, bytes]:
    """(capture time, one record as a gzip member); ``response`` is the id referred to by a revisit."""
    captured = stamp(EPOCH + (page or 0) % 1_000_000_000)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if response is None else b"")
    fields = [
        ("WARC-Type", "response" if response is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", captured), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if response is not None:
        fields[4:4] = [("WARC-Refers-To", f"<urn:page:{response}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return captured, gz.compress(head.encode() + block + b"\r\n\r\n") + gz.flush()


def _lines(lines: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One run: its lines in order, numbered."""
    run = uuid.uuid4().hex
    lines.sort(key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2], x[4]))
    for at in range(0, len(lines), 10_000):
        some = lines[at : at + 10_000]
        columns = [*zip(*some, strict=True), [run] * len(some), range(at, at + len(some))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def _write(folder: str, referred: str, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        out, name, lines, responses = None, "", [], Responses(referred, parts)
        try:
            for batch in batches:
                for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload")), strict=True):
                    if out is None or out.tell() >= ARCHIVE_BYTES:
                        if out:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = open(f"{folder}/{name}", "wb")
                    sha1, offset = digest(html), out.tell()
                    response = responses.of(page, html)
                    captured, data = record(page, url, html, sha1, response)
                    out.write(data)
                    lines.append((url_key(url), captured, page, name, offset, len(data), sha1, "response" if response is None else "revisit"))
                    if len(lines) == RUN_LINES:
                        out.flush()  # before the lines that tell of the records
                        yield from _lines(lines)
                        lines = []
            if out:
                out.flush()
            if lines:
                yield from _lines(lines)
        finally:
            if out:
                out.close()

    return run


class Responses:
    """The response that a page refers to, by arrays in the shared folder of those pages that refer to one."""

    def __init__(self, folder: str, parts: int):
        self.folder, self.parts, self.open = folder, parts, {}

    @staticmethod
    def key(page: int | None, sha1: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d " % (-1 if page is None else page) + sha1, digest_size=8).digest(), "big")

    def of(self, page: int | None, html: bytes) -> int | None:
        key = self.key(page, hashlib.sha1(html).digest())
        part = key * self.parts >> 64
        if part not in self.open:
            path = f"{self.folder}/key-{part}.npy"
            self.open[part] = (np.load(path, mmap_mode="r"), np.load(path.replace("key-", "to-"), mmap_mode="r")) if os.path.exists(path) else (np.zeros(0, U), np.zeros(0, np.int64))
        keys, to = self.open[part]
        at = int(np.searchsorted(keys, U(key)))
        return int(to[at]) if at < len(keys) and keys[at] == U(key) else None


def _refer(folder: str):
    """Writes the arrays of one part of (id, sha1, response)."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        keys = np.array([Responses.key(i, bytes.fromhex(h)) for i, h in zip(table["rid"].to_pylist(), table["rsha1"].to_pylist(), strict=True)], U)
        order = np.argsort(keys)
        if (np.diff(keys[order]) == 0).any():
            raise ValueError("two pages have one key")
        _save(f"{folder}/key-{part}.npy", keys[order])
        _save(f"{folder}/to-{part}.npy", table["response"].to_numpy()[order])
        return pa.table({"part": pa.array([part], pa.int32()), "rows": pa.array([len(keys)], pa.int64())})

    return run


def _placed(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [Responses.key(i, bytes.fromhex(h)) * parts >> 64 for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], ["rid", "rsha1", "response", "part"])

    return run


SCHEMA = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("record_type", pa.string()), ("run", pa.string()), ("seq", pa.int64())])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> tuple[str, DataFrame]:
    """(folder, index lines of the archives' locally sorted runs)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary").alias("payload"))
    sums = written(rows.select("id", F.sha1("payload").alias("sha1"), F.length("payload").alias("n")))  # payloads are read to be digested and to be written, and never move
    firsts = sums.where(F.col("n") >= least).groupBy("sha1").agg(F.min("id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND response IS NOT NULL")
    again = sums.where(F.col("n") >= least).groupBy("id", "sha1").agg(F.count(F.lit(1)).alias("rows")).join(firsts, "sha1").where("id IS NULL OR id <> response").select(F.col("id").alias("rid"), F.col("sha1").alias("rsha1"), "response")
    again = written(again)
    parts = max(1, -(-again.count() // 500_000))
    referred, folder = (shared_dir(spark) for _ in range(2))
    placed = again.mapInArrow(_placed(parts), "rid long, rsha1 string, response long, part int").repartition(parts, "part")
    placed.groupBy("part").applyInArrow(_refer(local_path(referred)), "part int, rows long").agg(F.sum("rows")).first()
    lines = written(rows.mapInArrow(_write(local_path(folder), local_path(referred), parts), INDEX))
    drop(sums, again)
    delete(spark, referred)
    return folder, lines


class LoserTree:
    """Yields the items of sorted runs in order: inner nodes keep the losers of their match, so
    that the next item takes one match a level."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key = runs, key
        self.heads = [next(r, None) for r in runs]
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        self.top = -1
        for i in range(len(runs)):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None
        kx, ky = self.key(x), self.key(y)
        return kx < ky or kx == ky and a < b

    def _play(self, i: int) -> None:
        at = (i + self.k) // 2
        while at:
            other = self.losers[at]
            if other == -1:
                self.losers[at] = i
                return
            if self._less(other, i):
                self.losers[at], i = i, other
            at //= 2
        self.top = i

    def __iter__(self) -> Iterator:
        while self.top >= 0 and self.heads[self.top] is not None:
            i = self.top
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def _blocks(run: pa.Table) -> Iterator[tuple]:
    """Keys and places of a slice's lines, a block of them at a time."""
    for at in range(0, run.num_rows, BLOCK_LINES):
        some = run.slice(at, BLOCK_LINES)
        yield from zip(*(some[c].to_pylist() for c in ("url_key", "captured")), [-1 if x is None else x for x in some["id"].to_pylist()], some["archive"].to_pylist(), some["offset"].to_pylist(), some["place"].to_pylist(), strict=True)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: the slices of the runs, one after another, merged into one sequence with places from 0."""
    from pyspark import TaskContext

    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.Table.from_batches(tables).combine_chunks()
    table = table.append_column("place", pa.array(np.arange(table.num_rows)))
    runs = pc.run_end_encode(table["run"].combine_chunks()).run_ends.to_pylist()
    slices = [_blocks(table.slice(a, b - a)) for a, b in zip([0, *runs[:-1]], runs, strict=True)]
    order = np.fromiter((x[-1] for x in LoserTree(slices, lambda x: x)), np.int64, table.num_rows)
    out = table.drop_columns("place").take(pa.array(order))
    out = out.append_column("range", pa.array(np.full(len(order), TaskContext.get().partitionId()), pa.int32())).append_column("place", pa.array(np.arange(len(order))))
    yield from out.to_batches(max_chunksize=10_000)


def merge_index(lines: DataFrame, ranges: int | None = None) -> DataFrame:
    """Capture histories: the lines with range and place, which are their global order."""
    ranges = ranges or max(1, -(-lines.count() // 100_000))
    # only run and number are sorted, which puts each run's slice together again
    cut = lines.repartitionByRange(ranges, "url_key", "captured", F.coalesce("id", F.lit(-1)), "archive", "offset").sortWithinPartitions("run", "seq")
    return cut.mapInArrow(_merge, f"{INDEX}, range int, place long")


def records(data: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive, a member at a time."""
    held = b""
    while True:
        gz, out = zlib.decompressobj(31), []
        while not gz.eof:
            held = held or data.read(1 << 20)
            if not held:
                break
            out.append(gz.decompress(held))
            held = gz.unused_data
        if not out:
            return
        if not gz.eof:
            raise ValueError("the archive ends within a record")
        head, _, block = b"".join(out).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, block[: int(fields["Content-Length"])]


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with open(f"{folder}/{name}", "rb") as data:
                    for fields, block in records(data):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        kind, sha1 = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        n = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                        if kind == "response" and (len(payload) != n or digest(payload) != sha1):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        rows.append((number(fields["WARC-Record-ID"][len("<urn:page:") : -1]), n, sha1, kind, number(fields.get("WARC-Refers-To", "")[len("<urn:page:") : -1])))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], schema=READ)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], schema=READ)

    return run


READ = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(folder: str, lines: DataFrame) -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives that the index names."""
    names = lines.select("archive").distinct()
    return names.repartition(max(1, names.sparkSession.sparkContext.defaultParallelism), "archive").mapInArrow(_read(local_path(folder)), "id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", **columns: str) -> DataFrame:
    """Writes archives, merges their index, and reads them back; each row has its place in the merged history."""
    folder, lines = write_archives(pages, id_col, **columns)
    merged = written(merge_index(lines).select("id", "url_key", "range", "place"))
    counts = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # one row a range
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n")).drop("n")
    found = read_archives(folder, lines)
    order = merged.join(before, "range").groupBy("id").agg(F.min(F.col("before") + F.col("place")).alias("history_order"), F.min("url_key").alias("url_key"))
    return found.join(order, found["id"].eqNullSafe(order["id"]), "left").select(found["id"].alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_order")
