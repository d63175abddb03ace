"""Base-call folders: RunInfo, sample sheet, cycle and filter files; cycle-major to reads."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_READS, MAX_CYCLES = 16, 1024
READ_SCHEMA = "tile string, cluster long, passed boolean, seq string, qual string"


def parse_run_info(xml: str) -> list[dict]:
    """Reads of a run: number, first cycle (0-based), cycles, whether an index."""
    out, at = [], 0
    for r in ET.fromstring(xml).iter("Read"):
        n = int(r.attrib["NumCycles"])
        out.append({"number": int(r.attrib["Number"]), "start": at, "cycles": n, "index": r.attrib.get("IsIndexedRead", "N").upper() == "Y"})
        at += n
    if not out or len(out) > MAX_READS or at > MAX_CYCLES:
        raise ValueError("RunInfo.xml names no reads, or too many reads or cycles")
    return out


def parse_sample_sheet(text: str) -> list[dict]:
    """Samples of [Data] or [BCLConvert_Data]: id, index, index2, lane, output (of the first row with id and lane)."""
    section, header, out = "", None, []
    seen: dict[tuple, int] = {}
    for line in text.replace("\r", "").split("\n"):
        parts = [p.strip() for p in line.split(",")]
        if parts[0].startswith("["):
            section, header = parts[0].strip("[]"), None
        elif section in ("Data", "BCLConvert_Data") and any(parts):
            if header is None:
                header = [p.lower() for p in parts]
                continue
            row = dict(zip(header, parts, strict=False))
            sid = row.get("sample_id", "")
            if not sid:
                raise ValueError("a sample has no Sample_ID")
            key = (sid, row.get("lane", ""))
            seen.setdefault(key, len(out))
            out.append({"sample_id": sid, "index": row.get("index", "").upper(), "index2": row.get("index2", "").upper(), "lane": int(row["lane"]) if row.get("lane") else None, "output": seen[key]})
    if not out:
        raise ValueError("the sample sheet names no samples")
    return out


def decode_cycle(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bases, qualities as ASCII) of one cycle file: a count, then a byte for each cluster."""
    n = int.from_bytes(raw[:4], "little")
    b = np.frombuffer(raw, np.uint8, n, 4)
    base = np.frombuffer(b"ACGT", np.uint8)[b & 3].copy()
    qual = np.minimum(b >> 2, 93) + 33
    base[b == 0], qual[b == 0] = ord("N"), ord("#")
    return base, qual.astype(np.uint8)


_PLACE = re.compile(r"C(\d+)\.1/(s_\d+_\d+)\.bcl(\.gz)?$")


def read_run(spark: SparkSession, folder: str, cycles: int) -> DataFrame:
    """Reads of all tiles: each tile's cycle files meet in one task and are transposed there.

    A tile has a bounded number of clusters; tiles are dealt over tasks. Without a filter file
    all clusters pass.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bcl*").load(folder)
    files = files.select(F.regexp_extract("path", r"(s_\d+_\d+)\.", 1).alias("tile"), F.regexp_extract("path", r"C(\d+)\.1/", 1).cast("int").alias("cycle"), F.col("path").endswith(".gz").alias("gz"), "content")
    flt = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.filter").load(folder)
    flt = flt.select(F.regexp_extract("path", r"(s_\d+_\d+)\.", 1).alias("tile"), F.lit(0).alias("cycle"), F.lit(False).alias("gz"), "content")

    def transpose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cycle")
        own = [gzip.decompress(c) if gz else c for c, gz, n in zip(pdf.content, pdf.gz, pdf.cycle, strict=True) if n > 0]
        if len(own) != cycles:
            raise ValueError(f"tile {key[0]} has {len(own)} of {cycles} cycles")
        dec = [decode_cycle(x) for x in own]
        if len({len(b) for b, _ in dec}) != 1:
            raise ValueError(f"tile {key[0]}: cycles differ in clusters")
        base, qual = (np.ascontiguousarray(np.stack(x, axis=1)) for x in zip(*dec, strict=True))
        n = len(base)
        keep = np.ones(n, bool)
        for c, cyc in zip(pdf.content, pdf.cycle, strict=True):
            if cyc == 0:
                keep = (np.frombuffer(c, np.uint8, n, len(c) - n) & 1).astype(bool)
        text = lambda m: [row.tobytes().decode("latin-1") for row in m]
        return pd.DataFrame({"tile": key[0], "cluster": np.arange(n), "passed": keep, "seq": text(base), "qual": text(qual)})

    return files.union(flt).groupBy("tile").applyInPandas(transpose, READ_SCHEMA)


def assign_samples(reads: DataFrame, samples: Sequence[dict], index1: tuple[int, int], index2: tuple[int, int] | None, k1: int = 1, k2: int = 1, lane: int = 1) -> DataFrame:
    """Passed clusters with their sample: least sum of both distances within their bounds; samples of
    different outputs at that sum leave it undetermined. The sheet is broadcast (a run has a few
    hundred samples at most)."""
    spark = reads.sparkSession
    rows = [(s["sample_id"], s["index"], s["index2"], s["output"]) for s in samples if s["lane"] in (None, lane)]
    sheet = F.broadcast(spark.createDataFrame(rows, "sample_id string, i1 string, i2 string, output int"))
    cut = lambda w: F.substr("seq", F.lit(w[0] + 1), F.lit(w[1]))
    ham = lambda a, b: F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda n, x: n + x)
    r = reads.where("passed").withColumn("o1", cut(index1)).withColumn("o2", cut(index2) if index2 else F.lit(""))
    keys = r.select("o1", "o2").distinct()
    d1 = F.when(F.length("o1") == F.length("i1"), ham(F.col("o1"), F.col("i1")))
    d2 = F.when((F.length("i2") == 0) | F.lit(index2 is None), 0).when(F.length("o2") == F.length("i2"), ham(F.col("o2"), F.col("i2")))
    near = keys.crossJoin(sheet).withColumn("d1", d1).withColumn("d2", d2).where((F.col("d1") <= k1) & (F.col("d2") <= k2)).withColumn("d", F.col("d1") + F.col("d2"))
    best = near.groupBy("o1", "o2").agg(F.min("d").alias("d"))
    won = near.join(best, ["o1", "o2", "d"]).groupBy("o1", "o2").agg(F.count_distinct("output").alias("n"), F.min("output").alias("output"), F.min_by("sample_id", "output").alias("sample_id")).where("n = 1").drop("n")
    return r.join(won, ["o1", "o2"], "left")


def demux_stats(reads: DataFrame, assigned: DataFrame) -> DataFrame:
    p = reads.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("filtered"))
    a = assigned.agg(F.count("sample_id").alias("assigned"), F.count_if(F.col("sample_id").isNull()).alias("undetermined"))
    return p.crossJoin(a)


def top_unknown(assigned: DataFrame, n: int = 100) -> DataFrame:
    return assigned.where("sample_id is null").groupBy("o1", "o2").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "o1", "o2").limit(n)


def reads_of(assigned: DataFrame, info: Sequence[dict]) -> Iterator[tuple[str, DataFrame]]:
    """Per read of the run its name (R1, I1, ...) and its part of sequences and qualities."""
    count = {"I": 0, "R": 0}
    for r in info:
        kind = "I" if r["index"] else "R"
        count[kind] += 1
        part = lambda c, r=r: F.substr(c, F.lit(r["start"] + 1), F.lit(r["cycles"]))
        yield f"{kind}{count[kind]}", assigned.withColumn("seq", part(F.col("seq"))).withColumn("qual", part(F.col("qual")))
