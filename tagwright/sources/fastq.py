"""FASTQ as a Spark data source: ``spark.read.format("fastq").load(path)``.

:func:`read_fastq` takes files from any store that Spark reads: gzip files line by line, of any
size, plain ones as bytes by ``binaryFile``, up to 2 GB each. The registered source streams paths that
executors can open, plain ones of any size too. Both give (path, ordinal, header, read_id, seq, plus,
qual), or only the columns asked for, and fail on a malformed record. A file is one partition, as
records cannot be told apart from the middle of one.
"""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, ordinal long, header string, read_id string, seq string, plus string, qual string"
_ARROW = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), *((c, pa.string()) for c in ("header", "read_id", "seq", "plus", "qual"))])


class MalformedFastq(ValueError):
    pass


def records(lines: Iterator[bytes], path: str, strict: bool = True) -> Iterator[tuple]:
    """Four-line records, checked: ``@`` and ``+`` starts and, if ``strict``, sequence and qualities of one length."""
    n = 0
    lines = iter(lines)
    for raw in lines:
        header = raw.rstrip(b"\r\n")
        if not header and n >= 0:
            rest = next(lines, None)
            if rest is None:
                return
            raise MalformedFastq(f"{path}: blank line in record {n}")
        try:
            seq, plus, qual = (next(lines).rstrip(b"\r\n") for _ in range(3))
        except (StopIteration, RuntimeError):
            raise MalformedFastq(f"{path}: record {n} is cut off") from None
        if header[:1] != b"@" or plus[:1] != b"+" or (strict and len(seq) != len(qual)):
            raise MalformedFastq(f"{path}: record {n} is malformed")
        text = header.decode("latin-1")
        yield path, n, text, text[1:].split(" ")[0].split("\t")[0], seq.decode("latin-1"), plus.decode("latin-1"), qual.decode("latin-1")
        n += 1


def batches(rows: Iterator[tuple], columns: list[str] | None = None, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`records` as batches of the asked columns; others are dropped at once."""
    schema = _ARROW if columns is None else pa.schema([_ARROW.field(c) for c in columns])
    at = [_ARROW.names.index(c) for c in schema.names]

    def told(held: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema, strict=True)], schema=schema)

    held: list[list] = [[] for _ in at]
    for row in rows:
        for column, i in zip(held, at, strict=True):
            column.append(row[i])
        if len(held[0]) == size:
            yield told(held)
            held = [[] for _ in at]
    if held[0]:
        yield told(held)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.columns = columns
        found = sorted(glob.glob(path)) if any(c in path for c in "*?[") else [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith((".fastq", ".fq", ".gz"))] if os.path.isdir(path) else [path]
        if not found:
            raise FileNotFoundError(path)
        self.paths = found

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        opener = gzip.open if partition.path.endswith(".gz") else open
        with opener(partition.path, "rb") as f:
            yield from batches(records(f, partition.path), self.columns)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file://"), schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def read_fastq(spark: SparkSession, path: str, sample: str | None = None, columns: list[str] | None = None, plain: bool = False) -> DataFrame:
    """Records of a file, folder or glob; with ``columns`` only these are made.

    ``plain`` is the lenient form: sequences in upper case and no check of qualities, as tools take
    them that look at the sequence alone.
    """
    names = list(columns or _ARROW.names)
    schema = ", ".join(f"{c} {'long' if c == 'ordinal' else 'string'}" for c in names)

    def made(lines: Iterator[bytes], where: str) -> Iterator[pa.RecordBatch]:
        rows = records(lines, where, not plain)
        yield from batches(((*r[:4], r[4].upper(), *r[5:]) for r in rows) if plain else rows, names)

    def by_line(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (x for batch in parts for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for where, group in groupby(lines, key=itemgetter(0)):
            yield from made((line for _, line in group), where)

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for where, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from made(iter(raw.as_py().splitlines()), where)

    zipped = path.endswith(".gz")
    out = None
    if zipped or not path.endswith((".fastq", ".fq")):
        text = spark.read.option("pathGlobFilter", "*.gz").text(path).select("_metadata.file_path", F.col("value").cast("binary").alias("value"))
        out = text.mapInArrow(by_line, schema)
    if not zipped:
        raw = spark.read.format("binaryFile").load(path).where("path not like '%.gz'").select("path", "content").mapInArrow(whole, schema)
        out = raw if out is None else out.union(raw)
    return out if sample is None else out.withColumn("sample", F.lit(sample))


def read_samples(spark: SparkSession, sheet: list[tuple[str, str]]) -> DataFrame:
    """Reads of all samples of a sheet, united."""
    out = None
    for name, path in sheet:
        one = read_fastq(spark, path, name)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no samples")
    return out
