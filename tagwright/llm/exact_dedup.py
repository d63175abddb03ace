"""Exact deduplication: 128-bit content hash, smallest id stays, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, quoted, row_key, stage, take_rows

WHITE = r"[\x20\x09-\x0D]+"


def _groups(rows: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Of (doc_id, h, norm): groups by hash and bytes, the same by hash alone, whether any hash has two texts."""
    groups = rows.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    by_hash = stage(
        groups.groupBy("h").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")),
        "exact-groups",
    )
    return groups, by_hash, not by_hash.where("texts > 1").isEmpty()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its group: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after each run of ASCII white space became one space.

    * Rows are grouped by hash and normalised bytes with map-side partial aggregation, so a
      group that holds a third of all rows leaves each task as one row.
    * A hash with more than one byte string (a collision) sends the mapping through a join on
      the bytes as well; without one, only hashes and ids are joined.

    Null text counts as empty. A null id is larger than any id (it stays only if the group has
    no other). Repeated rows with one id and text are the same document: each says ``kept``.
    An empty table gives an empty result; other columns are ignored.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("h", F.unhex(F.md5("norm")))
    groups, by_hash, collided = _groups(rows)
    out = ("doc_id", "keep_id", "group_size", "text_sha256")
    slim = rows.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    if collided:
        res = rows.withColumn("text_sha256", F.sha2("norm", 256)).join(groups, ["h", "norm"]).select(*out)
    else:
        res = slim.join(by_hash, "h").select(*out)
    return res.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns unchanged.

    The row with the smallest id stays (one with a null id only where no other is); of several
    with that id one. Rows are told apart by id and text, so rows that share an id but not a text
    are judged apart.
    """
    norm = F.regexp_replace(F.coalesce(quoted(text_col), F.lit("")), WHITE, " ")
    rows = docs.select(quoted(id_col).alias("doc_id"), row_key(id_col, text_col).alias("rk"), norm.alias("norm")).withColumn("h", F.unhex(F.md5("norm")))
    groups, by_hash, collided = _groups(rows)
    mine, by = (rows.join(groups, ["h", "norm"]), ["h", "norm"]) if collided else (rows.select("doc_id", "rk", "h").join(by_hash, "h"), ["h"])
    first = mine.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(*by, "rk").agg(F.count("*").alias("cnt"))
    keep = stage(first.groupBy(*by).agg(F.min(F.struct("rk", "cnt")).alias("kept")).select("kept.rk", "kept.cnt"), "exact-keep")
    drop_staged(by_hash)
    return take_rows(docs, keep, id_col, text_col)


ORACLE_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from n group by norm)
select n.doc_id, g.keep_id, g.group_size, n.doc_id is not distinct from g.keep_id as kept, sha256(n.norm) as text_sha256
from n join g using (norm)
"""
