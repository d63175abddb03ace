"""Why reads did not match: grouping of unmatched windows, nearest targets, reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from . import assign as A
from .offsets import offset_hints


def group_unmatched(assigned: DataFrame, quality_threshold: int | None = None, adapters: list[str] | None = None, order: str = "ordinal") -> DataFrame:
    """Windows without a match (``<invalid>`` for none at all), with counts and hints of their reads."""
    low = S.low_quality("window_qual", quality_threshold) if quality_threshold is not None and "window_qual" in assigned.columns else F.lit(False)
    adapter = S.adapter_contained("seq", F.coalesce("observed", F.lit("")), adapters or [])
    hint = F.col("offset_hint") if "offset_hint" in assigned.columns else F.lit(0)
    rows = assigned.where("status in ('none', 'invalid')").select(
        F.coalesce(F.when(F.col("status") == "none", F.col("observed")), F.lit("<invalid>")).alias("sequence"),
        F.col(order).alias("__o"), hint.alias("__h"), low.alias("__low"), adapter.alias("__ad"),
    )
    first = F.min(F.when(F.col("__h") != 0, F.struct("__o", "__h")))
    return rows.groupBy("sequence").agg(F.count("*").alias("count"), F.coalesce(first["__h"], F.lit(0)).alias("offset_hint"), F.count_if("__low").alias("low_quality_count"), F.max("__ad").alias("adapter_hint"))


def top_unmatched(groups: DataFrame, n: int) -> DataFrame:
    return groups.orderBy(F.desc("count"), "sequence").limit(n)


def explain(groups: DataFrame, targets: DataFrame, k: int, top_n: int = 20) -> DataFrame:
    """The most frequent unmatched windows, their nearest target (also of the reverse complement) and a reason."""
    top = top_unmatched(groups, top_n)
    ok = F.col("sequence") != "<invalid>"
    top = top.withColumn("observed", F.when(ok, F.col("sequence"))).withColumn("reverse_complement", F.when(ok, S.reverse_complement("sequence")))
    near = A.nearest(top.where(ok), targets)
    rc = A.nearest(top.where(ok), targets, "reverse_complement").toDF("reverse_complement", "rc_index", "revcomp_nearest_target", "revcomp_nearest_distance")
    out = top.join(near, "observed", "left").join(rc, "reverse_complement", "left")
    d, r = F.col("nearest_distance"), F.col("revcomp_nearest_distance")
    # The last rule that holds wins; so the strongest is asked first.
    reason = (
        F.when(~ok, "wrong_length")
        .when((F.col("offset_hint") == 0) & (r <= k) & (r < d), "reverse_complement_candidate")
        .when(F.col("offset_hint") != 0, "offset_shift_candidate")
        .when(F.col("adapter_hint"), "adapter_or_primer_candidate")
        .when(F.col("low_quality_count") > 0, "low_quality_candidate")
        .when(S.contains_n("sequence"), "contains_N")
        .when(d > k, "near_known_target_above_k")
        .otherwise("unknown")
    )
    return out.select("sequence", "count", F.length("sequence").alias("length"), F.col("nearest_id").alias("nearest_target"), "nearest_distance", reason.alias("possible_reason"), "reverse_complement", "revcomp_nearest_target", "revcomp_nearest_distance", "offset_hint")


def inspect_unmatched(reads: DataFrame, targets: DataFrame, start: int, length: int, k: int, top_n: int = 20, reach: int = 0, metric: str = "levenshtein", adapters: list[str] | None = None) -> DataFrame:
    out = A.assign(reads, targets, k, metric, start=start, length=length)
    if reach:
        out = offset_hints(out, targets, start, length, reach)
    if "ordinal" not in out.columns:
        out = out.withColumn("ordinal", F.col("read_id"))
    return explain(group_unmatched(out, adapters=adapters), targets, k, top_n)
