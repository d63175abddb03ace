"""WARC archives with a two-level capture index.

Archives: each task writes its rows as gzip members (one a record) of a file of its own; a failed
or repeated task leaves a file that no index names. Index: captures sorted by reversed-host URL
key, written as shards of compressed blocks; a shard ends with its sparse directory (the first
key of each block). A search goes by binary search over shards, then over one shard's directory,
and reads only the blocks and the records in range.

Files are written and read through ``pyarrow.fs`` under the shared folder, whatever its scheme.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, rows_of, stage

#: Captures of one index block; bytes after which a task begins another archive.
BLOCK, ARCHIVE_BYTES = 1000, 1 << 30
#: Equal payloads shorter than this are stored again.
REVISIT_FROM = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-page:"


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://m.Example.com:80/a?b#c`` gives ``com,example,m)/a?b``."""
    url = url or ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return re.sub(r"\s", "%20", url)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else "")
    return re.sub(r"\s", "%20", f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""))


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _header(lines: list[tuple[str, object]]) -> bytes:
    return b"".join(f"{k}: {str(v)}\r\n".encode() for k, v in lines if v is not None)


def _one_line(x: str | None) -> str | None:
    return None if x is None else re.sub(r"[\r\n]+", "%0A", x)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record: a response with its HTTP head and body, or a revisit with the head only."""
    http = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    block = http if revisit else http + payload
    own = f"<{_URN}{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}|{sha1.hex()}')}>"
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", own),
        ("WARC-Date", date),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()),
        ("WARC-Refers-To", f"<{_URN}{refers_to}>" if revisit else None),
        ("WARC-Profile", _PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return b"WARC/1.1\r\n" + _header(head) + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields and the payload of one record; of a revisit the payload is None."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record at this place")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    said = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    revisit = fields["WARC-Type"] == "revisit"

    def number(name: str) -> int | None:
        m = re.fullmatch(rf"<{_URN}(-?\d+)>", fields.get(name, ""))
        return int(m[1]) if m else None

    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if not revisit and (hashlib.sha1(body).digest() != digest or len(body) != int(said["Content-Length"])):
        raise ValueError("a payload differs from its digest or length")
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": int(said["Content-Length"]),
        "payload_digest": digest.hex(),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "payload": None if revisit else body,
    }


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` and return the captures (key, line), unsorted.

    Of equal payloads of at least ``REVISIT_FROM`` bytes the largest id is the response and the
    others revisit it; rows repeating that id and payload are responses again. Null html is an
    empty payload. A null id revisits like any other but is never revisited; a group of null ids
    only is all responses. Null urls have an empty key.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= REVISIT_FROM, F.unhex(F.sha2("payload", 256))))
    groups = rows.where("same is not null").groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("same", "first")
    typed = rows.join(groups, "same", "left").select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        out = name = None
        at = 0
        try:
            for batch in batches:
                for rows in rows_of(batch, 64):
                    keys, lines = [], []
                    for r in rows:
                        if out is None or at > ARCHIVE_BYTES:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        sha1 = hashlib.sha1(r["payload"]).digest()
                        revisit = r["first"] is not None and r["first"] != r["page_id"]
                        member = _gzip(record(r["page_id"], r["url"], r["payload"], sha1, r["first"], revisit, date))
                        out.write(member)
                        keys.append(f"{url_key(r['url'])}\t{name}\t{at:014d}")
                        lines.append(json.dumps({"file": name, "offset": at, "length": len(member), "digest": sha1.hex(), "type": "revisit" if revisit else "response"}))
                        at += len(member)
                    yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "line": pa.array(lines, pa.string())})
        finally:
            if out is not None:
                out.close()

    return typed.mapInArrow(run, "key string, line string")


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures into shards of compressed blocks; return a row per shard: (file, first, last, blocks).

    Keys end with archive and offset, so they are distinct and range partitions stay even
    however many captures one URL or host has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.cdx"
        directory: list[list] = []
        at, held, last, out = 0, [], None, None

        def flush() -> None:
            nonlocal at, held
            raw = _gzip("\n".join(f"{k} {line}" for k, line in held).encode())
            out.write(raw)
            directory.append([held[0][0], at, len(raw)])
            at += len(raw)
            held = []

        try:
            for batch in batches:
                for rows in rows_of(batch, 4096):
                    for r in rows:
                        out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                        held.append((r["key"], r["line"]))
                        last = r["key"]
                        if len(held) == BLOCK:
                            flush()
            if out is None:
                return
            if held:
                flush()
            raw = _gzip(json.dumps(directory).encode())
            out.write(raw)
            out.write(at.to_bytes(8, "big"))
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_pylist([{"file": name, "first": directory[0][0], "last": last, "blocks": len(directory)}])

    parts = captures.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = captures.repartitionByRange(int(parts), "key").sortWithinPartitions("key")
    return ranged.mapInArrow(run, "file string, first string, last string, blocks long")


class Reader:
    """Range reads from one archive folder and one index folder, with a few open files."""

    def __init__(self, archives: str, index: str):
        self.folders = {"warc": _fs(archives), "cdx": _fs(index)}
        self.open: dict[tuple[str, str], pa.NativeFile] = {}
        self.directories: dict[str, list] = {}
        self.block: tuple = (None, [])

    def read(self, kind: str, name: str, offset: int, length: int) -> bytes:
        f = self._file(kind, name)
        f.seek(offset)
        return f.read(length)

    def _file(self, kind: str, name: str) -> pa.NativeFile:
        f = self.open.get((kind, name))
        if f is None:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            fs, base = self.folders[kind]
            f = self.open[kind, name] = fs.open_input_file(f"{base}/{name}")
        return f

    def directory(self, shard: str) -> list:
        if shard not in self.directories:
            if len(self.directories) >= 8:
                self.directories.clear()
            f = self._file("cdx", shard)
            size = f.size()
            start = int.from_bytes(self.read("cdx", shard, size - 8, 8), "big")
            self.directories[shard] = json.loads(zlib.decompress(self.read("cdx", shard, start, size - 8 - start), 31))
        return self.directories[shard]

    def captures(self, shard: str, low: str, high: str) -> Iterator[dict]:
        """Index entries of one shard with low <= key < high: binary search, then block by block."""
        directory = self.directory(shard)
        i = max(0, bisect.bisect_right(directory, low, key=lambda b: b[0]) - 1)
        while i < len(directory) and directory[i][0] < high:
            if self.block[0] != (shard, i):
                lines = zlib.decompress(self.read("cdx", shard, *directory[i][1:]), 31).decode().split("\n")
                self.block = ((shard, i), [x.split(" ", 1) for x in lines])
            entries = self.block[1]
            for key, line in entries[bisect.bisect_left(entries, low, key=lambda e: e[0]) : bisect.bisect_left(entries, high, key=lambda e: e[0])]:
                yield {"key": key, **json.loads(line)}
            i += 1

    def record(self, entry: dict) -> dict:
        return parse(zlib.decompress(self.read("warc", entry["file"], entry["offset"], entry["length"]), 31))


_OUT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


class Archive:
    """Archives and their index under one folder."""

    def __init__(self, spark: SparkSession, folder: str, shards: DataFrame):
        self.spark, self.folder, self.shards = spark, folder, shards

    @classmethod
    def write(cls, pages: DataFrame, folder: str | None = None, **names: str) -> Archive:
        spark = pages.sparkSession
        folder = folder or fresh_path(spark, "warc")
        captures = stage(write_archives(pages, f"{folder}/archives", **names), "warc-captures")
        return cls(spark, folder, stage(build_index(captures, f"{folder}/index"), "warc-shards"))

    def _read(self, asks: DataFrame, with_payload: bool = False) -> DataFrame:
        archives, index = f"{self.folder}/archives", f"{self.folder}/index"
        schema = pa.schema([*_ARROW, ("payload", pa.binary())]) if with_payload else _ARROW

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(archives, index)
            for batch in batches:
                for rows in rows_of(batch):
                    out = []
                    for r in rows:
                        for entry in reader.captures(r["file"], r["low"], r["high"]):
                            out.append({k: v for k, v in reader.record(entry).items() if k in schema.names})
                            if len(out) >= 500:
                                yield pa.RecordBatch.from_pylist(out, schema=schema)
                                out = []
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)

        return asks.select("file", "low", "high").mapInArrow(run, _OUT + (", payload binary" if with_payload else ""))

    def scan(self, with_payload: bool = False) -> DataFrame:
        """All records, read back block range by block range: each range is found by binary search."""
        index = f"{self.folder}/index"
        archives = f"{self.folder}/archives"

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(archives, index)
            for batch in batches:
                for r in batch.to_pylist():
                    starts = [b[0] for b in reader.directory(r["file"])]
                    ends = [*starts[1:], r["last"] + "\x00"]
                    yield pa.RecordBatch.from_pydict({"file": pa.array([r["file"]] * len(starts), pa.string()), "low": pa.array(starts, pa.string()), "high": pa.array(ends, pa.string())})

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        asks = self.shards.mapInArrow(ranges, "file string, low string, high string").repartition(parts, "low")
        return self._read(asks, with_payload)

    def lookup(self, urls: DataFrame, url_col: str = "url", with_payload: bool = False) -> DataFrame:
        """The captures of each distinct URL in ``urls``.

        The list of shards (as many as the index job had partitions) is broadcast; a URL is sent
        to the shards whose key range holds it.
        """
        shards = sorted((r["first"], r["last"], r["file"]) for r in self.shards.toLocalIterator())
        held = self.spark.sparkContext.broadcast(shards)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lasts = [s[1] for s in held.value]
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    low, high = url_key(r["url"]) + "\t", url_key(r["url"]) + "\n"
                    i = bisect.bisect_left(lasts, low)
                    while i < len(lasts) and held.value[i][0] < high:
                        out.append({"file": held.value[i][2], "low": low, "high": high})
                        i += 1
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("low", pa.string()), ("high", pa.string())]))

        wanted = urls.select(F.col(url_col).cast("string").alias("url")).distinct()
        return self._read(wanted.mapInArrow(ask, "file string, low string, high string").distinct(), with_payload)


ORACLE_SQL = """
with p as (select page_id, url, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
g as (select html, max(page_id) as first from p where payload_bytes >= 1000 group by html)
select p.page_id, p.url, p.payload_bytes, p.payload_digest,
  case when g.first is not null and g.first is distinct from p.page_id then 'revisit' else 'response' end as record_type,
  case when g.first is not null and g.first is distinct from p.page_id then g.first end as refers_to
from p left join g on p.html = g.html and p.payload_bytes >= 1000
"""
