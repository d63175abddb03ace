"""Where the window starts: scoring of offsets and inference of start and length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from . import assign as A


def parse_starts(text: str) -> list[int]:
    """``A:B`` (both included) or a comma list."""
    if ":" in text:
        a, b = (int(x) for x in text.split(":", 1))
        if b < a or a < 0:
            raise ValueError(f"bad range of starts: {text}")
        return list(range(a, b + 1))
    out = [int(x) for x in text.split(",") if x.strip()]
    if not out or min(out) < 0:
        raise ValueError(f"bad list of starts: {text}")
    return out


def first_reads(reads: DataFrame, n: int, ordinal: str = "ordinal") -> DataFrame:
    """The first n reads of each sample by position: a stated prefix, not a random sample."""
    return reads.where(F.col(ordinal) < n)


def _by_window(reads: DataFrame, starts: list[int], length: int, sample: str) -> DataFrame:
    at = F.explode(F.array(*map(F.lit, starts)))
    cut = reads.select(F.col(sample).alias("sample"), "seq", at.alias("start"))
    return cut.select("sample", "start", S.window("seq", F.col("start"), length).alias("observed")).groupBy("sample", "start", "observed").agg(F.count("*").alias("n"))


def score_offsets(reads: DataFrame, targets: DataFrame, start: int, reach: int, length: int, sample: str = "sample") -> DataFrame:
    """(sample, start, score, checked): exact unique hits of each start from start-reach to start+reach."""
    starts = [s for s in range(start - reach, start + reach + 1) if s >= 0]
    w = _by_window(reads, starts, length, sample)
    hit = A.assign_windows(w, targets, 0).where("status = 'unique'").select("observed", F.lit(1).alias("hit"))
    checked = F.sum("n").alias("checked")
    return w.join(hit, "observed", "left").groupBy("sample", "start").agg(F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("score"), checked)


def select_offsets(scores: DataFrame, start: int, mode: str = "best", min_fraction: float = 0.1) -> DataFrame:
    """(sample, offsets): the best start (nearest to the stated one on ties, then the lower), or all of
    enough hits; without any hit the stated start."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.abs(F.col("start") - start).alias("d"), F.col("start").alias("o"))).alias("best")
    enough = F.array_sort(F.collect_list(F.when(F.col("score") / F.greatest(F.lit(1), F.col("checked")) + 1e-12 >= min_fraction, F.col("start")))).alias("enough")
    g = scores.groupBy("sample").agg(best, enough)
    one = F.when(F.col("best.s") < 0, F.array(F.col("best.o"))).otherwise(F.array(F.lit(start)))
    return g.select("sample", (F.when(F.size("enough") > 0, F.col("enough")).otherwise(one) if mode == "multi" else one).alias("offsets"))


def infer_windows(reads: DataFrame, targets: DataFrame, starts: list[int], lengths: list[int] | None = None, k: int = 1) -> DataFrame:
    """Every start and length with its rates; score = assigned - ambiguous - invalid, best first.

    A length is tried with the targets of that length only.
    """
    lengths = lengths or sorted(r[0] for r in targets.select(F.length("seq")).distinct().collect())
    out = None
    for n in lengths:
        own = targets.where(F.length("seq") == n)
        w = _by_window(reads.withColumn("__all", F.lit(0)), starts, n, "__all")
        res = A._filled(w.join(A.assign_windows(w, own, k), "observed", "left"), F.col("observed").isNotNull())
        cnt = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
        st = F.col("status")
        one = res.groupBy("start").agg(
            F.sum("n").alias("sampled_reads"), cnt(st == "unique").alias("unique"), cnt((st == "unique") & (F.col("best_distance") == 0)).alias("exact"),
            cnt(st == "ambiguous").alias("ambiguous"), cnt(st == "none").alias("no_match"), cnt(st == "invalid").alias("invalid"),
        ).withColumn("length", F.lit(n))
        out = one if out is None else out.union(one)
    t = F.col("sampled_reads")
    out = out.withColumn("assignment_rate", F.col("unique") / t).withColumn("exact_rate", F.col("exact") / t).withColumn("ambiguous_rate", F.col("ambiguous") / t)
    out = out.withColumn("no_match_rate", F.col("no_match") / t).withColumn("invalid_rate", F.col("invalid") / t)
    out = out.withColumn("score", F.col("assignment_rate") - F.col("ambiguous_rate") - F.col("invalid_rate"))
    return out.orderBy(F.desc("score"), F.desc("assignment_rate"), "ambiguous_rate", "start", "length")


def inference_summary(candidates: DataFrame) -> dict:
    """The best candidate, its lead over the next, and whether to trust it."""
    top = candidates.limit(2).collect()
    if not top:
        return {"status": "empty"}
    lead = top[0].score - top[1].score if len(top) > 1 else None
    warn = "no_separation" if lead is not None and lead <= 0 else "low_separation" if lead is not None and lead < 0.20 else ""
    draft = top[0].assignment_rate < 0.80 or (lead is not None and lead < 0.10)
    return {"start": top[0].start, "length": top[0].length, "score": top[0].score, "separation": lead, "warning": warn, "status": "draft" if draft else "ready"}


def offset_hints(reads: DataFrame, targets: DataFrame, start: int, length: int, reach: int, k: int = 0) -> DataFrame:
    """Each read with the nearest shift (1, -1, 2, -2, ...) at which it is unique, else 0."""
    shifts = [d for r in range(1, reach + 1) for d in (r, -r) if start + d >= 0]
    if not shifts:
        return reads.withColumn("offset_hint", F.lit(0))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(d).alias("shift")) for i, d in enumerate(shifts)]))
    cut = reads.select("read_id", "seq", at.alias("a")).select("read_id", "a.turn", "a.shift", S.window("seq", F.col("a.shift") + start, length).alias("observed"))
    ok = A.assign_windows(cut, targets, k).where("status = 'unique'").select("observed")
    hint = cut.join(ok, "observed", "left_semi").groupBy("read_id").agg(F.min(F.struct("turn", "shift")).alias("t")).select("read_id", F.col("t.shift").alias("offset_hint"))
    return reads.join(hint, "read_id", "left").fillna(0, ["offset_hint"])
