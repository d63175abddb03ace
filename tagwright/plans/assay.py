"""Assay specifications: a small document is checked, compiled to steps and run."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import assign as A
from ..operators import audit, counting, inspect, offsets
from ..sources import fastq, sinks, tables

MODES = ("count", "demux", "pair-count")


@dataclass
class Spec:
    mode: str = "count"
    targets: str = ""
    samples: list[tuple[str, str]] = field(default_factory=list)
    start: int = 0
    length: int = 0
    metric: str = "levenshtein"
    k: int = 1
    policy: str = "best"
    indel_window: int = 0
    auto_offset: int = 0
    out: str = ""
    right_targets: str = ""
    right_start: int = 0
    right_length: int = 0

    @classmethod
    def load(cls, text: str) -> Spec:
        doc = tomllib.loads(text)
        ex, asg, out, right = doc.get("extract", {}), doc.get("assignment", {}), doc.get("outputs", {}), doc.get("right", {})
        return cls(
            doc.get("mode", "count"), doc.get("targets", ""), [(s["id"], s["fastq"]) for s in doc.get("samples", [])], ex.get("start", 0), ex.get("length", 0),
            asg.get("metric", "levenshtein"), asg.get("k", 1), asg.get("policy", "best"), ex.get("indel_window", 0), ex.get("auto_offset", 0), out.get("dir", ""),
            right.get("targets", ""), right.get("start", 0), right.get("length", 0),
        )

    def problems(self) -> list[str]:
        p = []
        if self.mode not in MODES:
            p.append(f"unknown mode {self.mode}")
        if not self.targets:
            p.append("no targets")
        if not self.samples:
            p.append("no samples")
        if self.length <= 0:
            p.append("no window length")
        if self.metric not in ("hamming", "levenshtein"):
            p.append(f"unknown metric {self.metric}")
        if not 0 <= self.k <= 2:
            p.append("k must be 0, 1 or 2")
        if self.metric == "hamming" and (self.k > 1 or self.indel_window):
            p.append("hamming allows k up to 1 and no indel window")
        if self.indel_window and self.k != 1:
            p.append("an indel window needs k = 1")
        if not 0 <= self.auto_offset <= 1024:
            p.append("auto_offset is 0 to 1024")
        if self.mode == "pair-count":
            if not self.right_targets or self.right_length <= 0:
                p.append("pair-count needs right.targets and right.length")
            if self.indel_window or self.auto_offset:
                p.append("pair-count takes neither an indel window nor auto_offset")
        if self.policy not in ("best", "radius"):
            p.append(f"unknown policy {self.policy}")
        return p

    def steps(self) -> list[str]:
        """What a run does, in order."""
        if self.problems():
            raise ValueError("; ".join(self.problems()))
        return ["read", *(["offsets"] if self.auto_offset else []), "assign", {"count": "count", "demux": "demux", "pair-count": "pairs"}[self.mode], "qc", "audit", "autopsy"]


#: Bounds beyond which a run's samples are looked into: fixed values.
AUTOPSY = {"assignment_rate": 0.80, "ambiguous_rate": 0.05, "no_match_rate": 0.15, "invalid": 0.02}


def needs_autopsy(qc: DataFrame) -> bool:
    bad = f"assignment_rate < {AUTOPSY['assignment_rate']} or ambiguous_rate > {AUTOPSY['ambiguous_rate']} or no_match_rate > {AUTOPSY['no_match_rate']} or invalid_reads > {AUTOPSY['invalid']} * total_reads"
    return not qc.where(bad).isEmpty()


def _windowed(reads: DataFrame, targets: DataFrame, spec: Spec, starts: DataFrame | None) -> DataFrame:
    """Each read with its result; the window starts where its own sample's offset says, and is the merge
    of the windows up to ``indel_window`` shorter and longer if that is given."""
    reads = reads.withColumn("uid", F.concat_ws("/", "sample", F.col("ordinal").cast("string")))
    at = reads.withColumn("offset", F.lit(spec.start)) if starts is None else reads.join(starts, "sample", "left").withColumn("offset", F.coalesce("offset", F.lit(spec.start)))
    cut = at.withColumn("__from", F.substr("seq", F.col("offset") + 1))  # the window and all behind it
    if not spec.indel_window:
        res = A.assign(cut.withColumn("__seq", F.col("seq")).withColumn("seq", F.col("__from")), targets, spec.k, spec.metric, spec.policy, 0, spec.length)
        return res.withColumn("seq", F.col("__seq")).drop("__seq", "__from").withColumn("kind", F.col("edit_kind"))
    lengths = [n for n in range(spec.length - spec.indel_window, spec.length + spec.indel_window + 1) if n > 0]
    res = A.assign_multi(cut.select("uid", F.col("__from").alias("seq")), targets, spec.k, [0], lengths, spec.metric, spec.policy, "uid")
    res = cut.drop("__from").join(res, "uid").join(targets.select("target_index", "target_id", F.col("seq").alias("target_seq")), "target_index", "left")
    kind = F.when(F.col("status") == "unique", S.edit_kind("observed", "target_seq", "best_distance"))
    return res.withColumn("edit_kind", kind).withColumn("kind", kind)


def run(spark: SparkSession, spec: Spec) -> dict[str, DataFrame]:
    """The run's tables by name; written under ``spec.out`` if that is given."""
    steps = spec.steps()
    targets = tables.read_targets(spark, spec.targets)
    reads = fastq.read_samples(spark, spec.samples)
    res: dict[str, DataFrame] = {}
    if spec.mode == "pair-count":
        right = tables.read_targets(spark, spec.right_targets)
        uid = reads.withColumn("read_id", F.concat_ws("/", "sample", F.col("ordinal").cast("string")))
        pairs = counting.assign_pairs(uid, targets, right, (spec.start, spec.length), (spec.right_start, spec.right_length), spec.k, spec.metric)
        res |= {"pair_counts": counting.pair_counts(pairs), "pair_summary": counting.pair_stats(pairs), "audit_pairs": audit.all_pairs(targets, spec.k)}
        return _written(res, spec)
    starts = None
    if "offsets" in steps:
        scores = offsets.score_offsets(reads, targets, spec.start, spec.auto_offset, spec.length)
        res["offset_scores"] = scores
        starts = offsets.select_offsets(scores, spec.start).select("sample", F.element_at("offsets", 1).alias("offset"))
    if spec.indel_window or starts is not None:
        per_read = _windowed(reads, targets, spec, starts)
        assigned = per_read.groupBy("sample", "observed", "target_index", "best_distance", "status", "kind").agg(F.count("*").alias("n"))
    else:
        per_read = A.assign(reads, targets, spec.k, spec.metric, spec.policy, spec.start, spec.length)
        assigned = counting.assigned_counts(counting.window_counts(reads, spec.start, spec.length), targets, spec.k, spec.metric, spec.policy)
    samples = spark.createDataFrame([(s,) for s, _ in spec.samples], "sample string")
    long = counting.count_long(assigned, targets, samples)
    qc = counting.sample_qc(assigned, long)
    res |= {"counts_long": long, "counts": counting.count_matrix(assigned, targets, [s for s, _ in spec.samples]), "sample_qc": qc, "summary": counting.run_summary(assigned, long)}
    pairs = audit.all_pairs(targets, spec.k)
    res["audit_pairs"] = pairs
    if needs_autopsy(qc):
        res["unmatched"] = inspect.explain(inspect.group_unmatched(per_read), targets, spec.k)
        res["findings"] = counting.findings(res["summary"], audit.audit_summary(targets, pairs, audit.ambiguous_variants(targets), spec.k))
    if spec.mode == "demux" and spec.out:
        sinks.write_fastq_by_barcode(per_read, f"{spec.out}/fastq")
    return _written(res, spec)


def _written(res: dict[str, DataFrame], spec: Spec) -> dict[str, DataFrame]:
    if spec.out:
        for name, df in res.items():
            sinks.write_tsv(df.selectExpr(*[f"cast(`{c}` as string) as `{c}`" for c in df.columns]), f"{spec.out}/{name}")
    return res


def barcode_autopsy(reads: DataFrame, targets: DataFrame, starts: list[int], lengths: list[int] | None = None, k: int = 1, metric: str = "levenshtein", top: int = 20) -> dict[str, DataFrame]:
    """What is wrong with a run of unknown layout: the scan of windows, the best one's result, the library's
    audit, the most frequent unmatched windows, and findings."""
    scan = offsets.infer_windows(reads, targets, starts, lengths, 0)
    best = scan.first()
    if best is None:
        raise ValueError("no barcode windows could be scored")
    chosen = offsets.inference_summary(scan)
    own = targets.where(F.length("seq") == best.length)
    assigned = counting.assigned_counts(counting.window_counts(reads, best.start, best.length), own, k, metric)
    summary = counting.demux_summary(assigned, own)
    pairs = audit.all_pairs(targets, max(1, k))
    report = audit.audit_summary(targets, pairs, audit.ambiguous_variants(targets), max(1, k))
    return {
        "offset_scan": scan,
        "summary": summary,
        "barcode_counts": counting.count_cube(assigned).groupBy("target_index").agg(F.sum("n").alias("count")),
        "audit": report,
        "collision_graph": pairs,
        "top_unmatched": inspect.inspect_unmatched(reads, own, best.start, best.length, min(k, 1), top, metric=metric),
        "findings": counting.findings(summary, report, chosen["status"] != "ready"),
    }


def manifest(spec: Spec, res: dict[str, DataFrame]) -> str:
    return json.dumps({"mode": spec.mode, "steps": spec.steps(), "tables": sorted(res), "sample_count": len(spec.samples), "autopsy_triggered": "unmatched" in res})


TEMPLATE = """mode = "{mode}"
targets = "targets.tsv"
[[samples]]
id = "S1"
fastq = "S1.fastq.gz"
[extract]
start = 0
length = 20
[assignment]
metric = "levenshtein"
k = 1
policy = "best"
[outputs]
dir = "out"
"""


def template(mode: str = "count") -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    return TEMPLATE.format(mode=mode)
