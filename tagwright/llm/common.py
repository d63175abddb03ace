"""Helpers that the operators share: shared storage, row keys, whole-text scans, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, where driver and executors are one process, a temporary folder stands in
    for an unset one; elsewhere it raises, as no other machine would see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="tagwright-")
        atexit.register(_remove, _OWN["dir"].removeprefix("file://"))
    return _OWN["dir"]


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back, which cuts the lineage.

    A lost executor then costs only the tasks that it ran: what is staged is read again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no live plan refers to: it does so when the driver's
    references are collected, which a small heap may not do for long."""
    gc.collect()
    spark._jvm.System.gc()


def drop_staged(*frames: DataFrame) -> None:
    """Delete the files of frames that ``stage`` made and no later step reads."""
    for df in frames:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_HELD: dict[str, dict] = {}


def held(operator: str) -> dict:
    """What this Python worker keeps for ``operator`` between tasks; what it kept for others goes.

    Spark hands the same workers from stage to stage, so tables of one operator would stay beside
    the next one's for as long as the application runs.
    """
    if any(name != operator and kept for name, kept in _HELD.items()):
        _HELD.clear()
        gc.unfreeze()
        gc.collect()
        give_back()
    return _HELD.setdefault(operator, {})


def give_back() -> None:
    """Return freed memory to the system where the C library can; an idle worker would keep it."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def rows_of(batch: pa.RecordBatch, step: int = 256) -> Iterator[list[dict]]:
    """A batch in pieces of a few rows, so that few texts are Python objects at once."""
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step).to_pylist()


def text_col(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit key of a row's id and text, the same in every plan that reads the row."""
    return F.xxhash64(F.isnull(quoted(id_col)), quoted(id_col).cast("string"), F.isnull(quoted(text_col)), quoted(text_col))


def take_rows(docs: DataFrame, keep: DataFrame, id_col: str, text_col: str, also: Column | None = None) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is in ``keep`` (rk long unique, cnt long), columns unchanged.

    ``cnt`` is how many rows have that key: of several (same id, same text) one row stays. Rows
    with ``also`` stay in any case. Null and repeated ids are rows like any other.
    """
    rk, cnt = free_name(docs, "rk"), free_name(docs, "cnt")
    keyed = docs.withColumn(rk, row_key(id_col, text_col))
    cols = [quoted(c) for c in docs.columns]
    marks = keep.select(F.col("rk").alias(rk), F.col("cnt").alias(cnt))
    if also is None:
        out = keyed.join(marks.where(quoted(cnt) == 1).select(rk), rk, "left_semi").select(*cols)
    else:
        out = keyed.join(marks.where(quoted(cnt) == 1), rk, "left").where(quoted(cnt).isNotNull() | also).select(*cols)
    if not keep.where("cnt > 1").isEmpty():
        again = keyed.join(marks.where(quoted(cnt) > 1), rk, "left_semi").dropDuplicates([rk])
        out = out.union((again if also is None else again.where(~also)).select(*cols))
    return out


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``links`` (a long, b long) as (node, component = smallest node).

    Min-label propagation with pointer jumping until nothing moves; labels only fall, so it ends.
    Each round is a partial aggregate and a join of key pairs only, and is staged, so neither plan
    nor lineage grows; a node with very many links is a skewed join key, which adaptive execution
    splits. Self links and null ends are dropped.
    """
    links = links.where("a is not null and b is not null")
    edges = stage(
        links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct(),
        f"{name}-edges",
    )
    # A first hop straight from the links: each node's smallest neighbour, itself included.
    held = stage(
        edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("next"), F.lit(None).cast("long").alias("component")),
        f"{name}-0",
    )
    turn = 0
    while True:
        turn += 1
        labels = held.select("node", F.col("next").alias("component"))
        lab = labels.select(F.col("node").alias("v"), F.col("component").alias("c"))
        near = edges.join(lab, "v").groupBy("u").agg(F.min("c").alias("m"))
        hop = labels.join(near, labels.node == near.u).select("node", "component", F.least("component", "m").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("component").alias("far"))
        new = stage(hop.join(jump, "best").select("node", F.least("best", "far").alias("next"), "component"), f"{name}-{turn}")
        moved = not new.where("next <> component").isEmpty()
        drop_staged(held)
        held = new
        if not moved:
            break
    drop_staged(edges)
    out = held.select("node", F.col("next").alias("component"))
    out._staged_at = held._staged_at
    return out
