"""Counts, quality metrics and summaries of assigned reads. Ambiguous reads are never counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import seq as S
from . import assign as A

KINDS = ("exact", "substitution", "insertion", "deletion", "other")


def window_counts(reads: DataFrame, start: int, length: int, sample: str = "sample", seq_col: str = "seq") -> DataFrame:
    """(sample, observed, n): reads by window, partially aggregated before the shuffle. Null: invalid."""
    return reads.select(F.col(sample).alias("sample"), S.window(seq_col, start, length).alias("observed")).groupBy("sample", "observed").agg(F.count("*").alias("n"))


def assigned_counts(counts: DataFrame, targets: DataFrame, k: int, metric: str = "levenshtein", policy: str = "best") -> DataFrame:
    """Window counts with each window's result; reads themselves are not needed any more."""
    table = A.assign_windows(counts, targets, k, metric, policy)
    out = A.with_targets(counts, table, targets.select("target_index", F.col("seq").alias("target_seq")))
    return out.withColumn("kind", F.when(F.col("status") == "unique", S.edit_kind("observed", "target_seq", "best_distance")))


def count_cube(assigned: DataFrame) -> DataFrame:
    """(sample, target_index, kind, n) of unique reads: sparse."""
    return assigned.where("status = 'unique'").groupBy("sample", "target_index", "kind").agg(F.sum("n").alias("n"))


def count_long(assigned: DataFrame, targets: DataFrame, samples: DataFrame) -> DataFrame:
    """A row for each sample and target, zeros too; counts by kind."""
    part = [F.coalesce(F.sum(F.when(F.col("kind") == x, F.col("n"))), F.lit(0)).alias(f"count_{x}") for x in KINDS]
    cube = count_cube(assigned).groupBy("sample", "target_index").agg(*part, F.sum("n").alias("count"))
    full = F.broadcast(samples.select("sample")).crossJoin(targets.select("target_index", "target_id", F.col("seq").alias("target_seq"), "gene"))
    return full.join(cube, ["sample", "target_index"], "left").fillna(0, [f"count_{x}" for x in KINDS] + ["count"])


def count_matrix(assigned: DataFrame, targets: DataFrame, samples: list[str], zeros: bool = True) -> DataFrame:
    """(sgRNA, Gene, a column for each sample): counts by target, in wide form."""
    wide = assigned.where("status = 'unique'").groupBy("target_index").pivot("sample", samples).agg(F.sum("n"))
    out = targets.select("target_index", F.col("target_id").alias("sgRNA"), F.col("gene").alias("Gene")).join(wide, "target_index", "left" if zeros else "inner")
    return out.fillna(0, samples).select("sgRNA", "Gene", *samples)


def count_wide(assigned: DataFrame, targets: DataFrame, samples: list[str], near: DataFrame) -> DataFrame:
    """target_id, target_seq, gene, ambiguous_nearby and for each sample its total and counts by kind."""
    cells = [F.coalesce(F.sum(F.when(F.col("kind") == x, F.col("n"))), F.lit(0)).alias(x) for x in KINDS]
    wide = assigned.where("status = 'unique'").groupBy("target_index").pivot("sample", samples).agg(F.sum("n").alias("total"), *cells)
    out = targets.join(wide, "target_index", "left").join(A.spread(near.select("target_index", "ambiguous_nearby")), "target_index")
    cols = [f"{s}_{c}" for s in samples for c in ("total", *KINDS)]
    return out.fillna(0, cols).select("target_id", F.col("seq").alias("target_seq"), "gene", "ambiguous_nearby", *cols)


def status_counts(assigned: DataFrame, *by: str) -> DataFrame:
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    st = F.col("status")
    exact = (st == "unique") & (F.col("best_distance") == 0)
    return assigned.groupBy(*by).agg(
        F.sum("n").alias("total_reads"),
        n(st == "unique").alias("assigned_reads"),
        n(exact).alias("exact_reads"),
        n((st == "unique") & (F.col("best_distance") > 0)).alias("k1_rescued_reads"),
        *(n(F.col("kind") == kind).alias(f"k1_{short}_reads") for kind, short in (("substitution", "sub"), ("insertion", "ins"), ("deletion", "del"))),
        n(st == "ambiguous").alias("ambiguous_reads"),
        n(st == "none").alias("no_match_reads"),
        n(st == "invalid").alias("invalid_reads"),
    )


def inequality(counts: DataFrame, by: str = "sample", value: str = "count", top: str = "floor") -> DataFrame:
    """Gini index and the share of the top 1 % of targets, by group; zeros must be rows.

    Equal counts are grouped first, so the ranks are sums over distinct counts (few) and no
    window holds a row for each target. ``top`` rounds 1 % of the targets down or up (at least 1).
    """
    c = counts.groupBy(by, F.col(value).alias("x")).agg(F.count("*").alias("m"))
    up = W.partitionBy(by).orderBy("x")
    c = c.withColumn("below", F.sum("m").over(up.rowsBetween(W.unboundedPreceding, -1))).withColumn("below", F.coalesce("below", F.lit(0)))
    c = c.withColumn("above", F.sum("m").over(W.partitionBy(by).orderBy(F.desc("x")).rowsBetween(W.unboundedPreceding, -1))).withColumn("above", F.coalesce("above", F.lit(0)))
    n = F.sum("m").over(W.partitionBy(by))
    share = F.floor(n * 0.01) if top == "floor" else F.ceil(n * 0.01)
    c = c.withColumn("n", n).withColumn("top_n", F.greatest(F.lit(1), share).cast("long"))
    # ranks of m equal counts: below+1 .. below+m
    weighted = F.sum(F.col("x") * (F.col("m") * F.col("below") + F.col("m") * (F.col("m") + 1) / 2))
    total = F.sum(F.col("x") * F.col("m"))
    taken = F.sum(F.col("x") * F.greatest(F.lit(0), F.least(F.col("m"), F.col("top_n") - F.col("above"))))
    g = c.groupBy(by).agg(weighted.alias("w"), total.alias("t"), F.max("n").alias("n"), taken.alias("taken"), F.sum(F.when(F.col("x") > 0, F.col("m")).otherwise(0)).alias("targets_observed"))
    gini = F.when(F.col("t") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * F.col("w") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n"))))
    return g.select(
        by, "targets_observed", (F.col("n") - F.col("targets_observed")).alias("zero_count_targets"),
        gini.alias("gini_index"), F.when(F.col("t") == 0, 0.0).otherwise(F.col("taken") / F.col("t")).alias("top_1pct_read_fraction"),
    )


def sample_qc(assigned: DataFrame, long: DataFrame) -> DataFrame:
    """Quality metrics by sample. Rates are over valid windows."""
    s = status_counts(assigned, "sample").withColumn("valid_extracted_reads", F.col("total_reads") - F.col("invalid_reads"))
    den = F.greatest(F.lit(1), F.col("valid_extracted_reads"))
    rates = {"assignment_rate": "assigned_reads", "exact_rate": "exact_reads", "rescue_rate": "k1_rescued_reads", "ambiguous_rate": "ambiguous_reads", "no_match_rate": "no_match_reads"}
    for name, of in rates.items():
        s = s.withColumn(name, F.col(of) / den)
    return s.join(inequality(long), "sample")


def run_summary(assigned: DataFrame, long: DataFrame) -> DataFrame:
    """One row for the run. Percentages are over all reads, unlike the rates by sample."""
    s = status_counts(assigned)
    den = F.greatest(F.lit(1), F.col("total_reads"))
    for name in ("assigned", "ambiguous", "no_match", "invalid"):
        s = s.withColumn(f"{name}_percent", 100 * F.col(f"{name}_reads") / den)
    per = long.groupBy("target_index", "target_id").agg(F.sum("count").alias("c"))
    t = per.agg(F.count_if(F.col("c") > 0).alias("targets_observed"), F.count_if(F.col("c") == 0).alias("zero_count_targets"), F.max(F.struct("c", -F.col("target_index"), "target_id")).alias("top"))
    return s.crossJoin(t.select("targets_observed", "zero_count_targets", F.when(F.col("top.c") > 0, F.col("top.target_id")).alias("top_target"), F.col("top.c").alias("top_count")))


def ambiguous_nearby(targets: DataFrame, k: int, metric: str = "levenshtein") -> DataFrame:
    """Targets with a flag: another target within k of its own sequence."""
    res = A.assign_windows(targets.select(F.col("seq").alias("observed")), targets, k, metric)
    return A.spread(targets).join(res.select(F.col("observed").alias("seq"), "match_count"), "seq").select(
        "target_index", "target_id", F.when(F.col("match_count") > 1, "yes").otherwise("no").alias("ambiguous_nearby")
    )


def assign_pairs(reads: DataFrame, left: DataFrame, right: DataFrame, left_window: tuple[int, int], right_window: tuple[int, int], k: int | tuple[int, int], metric: str = "levenshtein", id_col: str = "read_id") -> DataFrame:
    """Both windows' results and the pair's: invalid before ambiguous before none; unique if both are.

    ``k`` is one radius for both sides or one for each.
    """
    ks = (k, k) if isinstance(k, int) else k
    out = reads.select(id_col, *(c for c in ("sample",) if c in reads.columns), "seq")
    for side, targets, (start, length), k in (("left", left, left_window, ks[0]), ("right", right, right_window, ks[1])):
        cut = out.withColumn("observed", S.window("seq", start, length))
        res = A._filled(cut.join(A.assign_windows(cut, targets, k, metric), "observed", "left"), F.col("observed").isNotNull())
        out = res.select(*out.columns, F.col("status").alias(f"{side}_status"), F.col("target_index").alias(f"{side}_index"))
    l, r = F.col("left_status"), F.col("right_status")
    either = lambda x: (l == x) | (r == x)
    return out.withColumn("status", F.when(either("invalid"), "invalid").when(either("ambiguous"), "ambiguous").when(either("none"), "none").otherwise("unique"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.where("status = 'unique'").groupBy("left_index", "right_index").agg(F.count("*").alias("count")).orderBy("left_index", "right_index")


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Counts of the run; the sides' failures are not exclusive, and invalid reads count as nothing else."""
    ok = F.col("status") != "invalid"
    return pairs.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "unique").alias("assigned"),
        F.count_if(ok & ((F.col("left_status") == "ambiguous") | (F.col("right_status") == "ambiguous"))).alias("ambiguous"),
        F.count_if(ok & (F.col("left_status") == "none")).alias("left_unmatched"),
        F.count_if(ok & (F.col("right_status") == "none")).alias("right_unmatched"),
        F.count_if(~ok).alias("invalid"),
    )


def demux_summary(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    s = status_counts(assigned)
    per = assigned.where("status = 'unique'").groupBy("target_index").agg(F.sum("n").alias("c")).join(A.spread(targets.select("target_index", "target_id")), "target_index")
    t = per.agg(F.count("*").alias("nonempty_outputs"), F.max(F.struct("c", -F.col("target_index"), "target_id")).alias("top"))
    return s.select("total_reads", "assigned_reads", "exact_reads", "k1_rescued_reads", "ambiguous_reads", "no_match_reads", "invalid_reads").crossJoin(t.select("nonempty_outputs", F.col("top.target_id").alias("top_barcode"), F.col("top.c").alias("top_count")))


# -- count matrices ------------------------------------------------------------------------------


def melt_matrix(matrix: DataFrame, id_col: str = "sgRNA", gene: str = "Gene") -> DataFrame:
    """(sgRNA, Gene, sample, count) from a wide matrix; a negative count or empty id is an error."""
    long = matrix.unpivot([id_col, gene], [c for c in matrix.columns if c not in (id_col, gene)], "sample", "count")
    number = F.col("count").cast("double").cast("long")
    checked = F.when(F.coalesce(F.trim(id_col), F.lit("")) == "", F.raise_error(F.lit("empty guide id")).cast("long")).when(number < 0, F.raise_error(F.lit("negative count")).cast("long")).otherwise(number)
    return long.withColumn("count", checked)


def matrix_metrics(long: DataFrame) -> DataFrame:
    """By sample: total, coverage, zero fraction, Gini, share of the top 1 % (rounded up)."""
    m = long.groupBy("sample").agg(F.sum("count").alias("total_count"), F.count_if(F.col("count") > 0).alias("nonzero_guides"), F.count_if(F.col("count") == 0).alias("zero_count_guides"))
    n = F.col("nonzero_guides") + F.col("zero_count_guides")
    m = m.withColumn("coverage_fraction", F.col("nonzero_guides") / n).withColumn("zero_count_fraction", F.col("zero_count_guides") / n)
    q = inequality(long, top="ceil").select("sample", "gini_index", F.col("top_1pct_read_fraction").alias("top_1pct_fraction"))
    return m.join(q, "sample")


def _pairs_of_samples(long: DataFrame) -> DataFrame:
    a = long.select("sgRNA", F.col("sample").alias("sample_a"), F.col("count").alias("a"))
    b = long.select("sgRNA", F.col("sample").alias("sample_b"), F.col("count").alias("b"))
    return a.join(b, "sgRNA").where("sample_a < sample_b")


def _corr(x, y):
    c = F.corr(x, y)
    return F.when(F.isnan(c), None).otherwise(c)


def pearson(long: DataFrame) -> DataFrame:
    """Pearson correlation of log2(count + 1) for each two samples; null without variance."""
    return _pairs_of_samples(long).groupBy("sample_a", "sample_b").agg(_corr(F.log2(F.col("a") + 1), F.log2(F.col("b") + 1)).alias("pearson"))


def average_ranks(long: DataFrame) -> DataFrame:
    """Counts replaced by ranks within the sample, ties by their average; joined by distinct value."""
    v = long.groupBy("sample", "count").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("sample").orderBy("count").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    v = v.withColumn("rank", before + (F.col("m") + 1) / 2).drop("m")
    return long.join(v, ["sample", "count"]).select("sgRNA", "sample", F.col("rank").alias("count"))


def spearman(long: DataFrame) -> DataFrame:
    return _pairs_of_samples(average_ranks(long)).groupBy("sample_a", "sample_b").agg(_corr(F.col("a"), F.col("b")).alias("spearman"))


def table_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two long count tables (key, count): totals, differing keys, largest difference, correlations."""
    both = left.select("key", F.col("count").alias("l")).join(right.select("key", F.col("count").alias("r")), "key", "full_outer").fillna(0, ["l", "r"])
    long = both.select(F.col("key").alias("sgRNA"), F.lit("l").alias("sample"), F.col("l").alias("count")).union(both.select("key", F.lit("r"), "r"))
    rank = average_ranks(long).groupBy("sgRNA").pivot("sample", ["l", "r"]).agg(F.first("count"))
    d = F.abs(F.col("l") - F.col("r"))
    a = both.agg(F.sum("l").alias("left_total"), F.sum("r").alias("right_total"), (F.sum("l") - F.sum("r")).alias("total_delta"), F.count_if(F.col("l") != F.col("r")).alias("differing"), F.max(d).alias("max_abs_delta"), _corr(F.col("l").cast("double"), F.col("r").cast("double")).alias("pearson"))
    return a.crossJoin(rank.agg(_corr(F.col("l"), F.col("r")).alias("spearman")))


def library_report(targets: DataFrame, k: int = 1) -> DataFrame:
    """Repeated ids and sequences, other symbols than ACGT, guides by gene, pairs within one edit."""
    repeats = lambda c: targets.groupBy(c).count().where("count > 1").agg(F.count("*"))
    gene = targets.groupBy("gene").count().agg(F.min("count").alias("min_guides_per_gene"), F.percentile("count", F.lit(0.5)).alias("median_guides_per_gene"), F.max("count").alias("max_guides_per_gene"))
    base = targets.agg(F.count("*").alias("guides"), F.count_if(~F.upper("seq").rlike("^[ACGT]+$")).alias("non_acgt_sequences"))
    from .audit import close_pairs

    pairs = close_pairs(targets, min(k, 1)).agg(F.count("*").alias("one_edit_collision_pairs"))
    out = base.crossJoin(repeats("target_id").toDF("duplicate_ids")).crossJoin(repeats("seq").toDF("duplicate_sequences")).crossJoin(gene)
    return out.crossJoin(pairs)


#: Rules of a count run's review: name, metric, bound, and whether more or less than it is bad: fixed values.
CRISPR_RULES = (
    ("low_assignment_rate", "assignment_rate", 0.80, "low"),
    ("high_ambiguous_rate", "ambiguous_rate", 0.05, "high"),
    ("high_no_match_rate", "no_match_rate", 0.15, "high"),
    ("high_invalid_rate", "invalid_rate", 0.02, "high"),
    ("low_guide_coverage", "coverage_fraction", 0.90, "low"),
    ("high_zero_count_fraction", "zero_count_fraction", 0.10, "high"),
    ("high_gini_index", "gini_index", 0.50, "high"),
    ("high_top_1pct_fraction", "top_1pct_fraction", 0.30, "high"),
)
#: Least Pearson correlation of log2(count + 1) between two samples: a fixed value.
PEARSON_MIN = 0.80


def review_metrics(long: DataFrame, qc: DataFrame | None = None) -> DataFrame:
    """By sample: the count matrix's metrics and, if there is a table of read metrics, its rates."""
    m = matrix_metrics(long)
    if qc is None:
        return m
    rates = qc.select("sample", "assignment_rate", "ambiguous_rate", "no_match_rate", F.when(F.col("total_reads") > 0, F.col("invalid_reads") / F.col("total_reads")).otherwise(0.0).alias("invalid_rate"))
    return m.join(rates, "sample", "left")


def warnings(metrics: DataFrame, rules: tuple = CRISPR_RULES) -> DataFrame:
    """(sample, warnings array, qc_status) by the rules whose metric is there."""
    found = [F.when(F.col(m) < b if side == "low" else F.col(m) > b, F.lit(name)) for name, m, b, side in rules if m in metrics.columns]
    w = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
    return metrics.select("sample", w.alias("warnings")).withColumn("qc_status", F.when(F.size("warnings") > 0, "review").otherwise("pass"))


def crispr_review(long: DataFrame, qc: DataFrame | None = None, library: DataFrame | None = None, k: int = 1) -> DataFrame:
    """(scope, code) of everything that a review of a count run finds; none means that it passes."""
    spark = long.sparkSession
    if "sgRNA" not in long.columns:
        long = long.withColumnRenamed("target_id", "sgRNA")
    out = warnings(review_metrics(long, qc)).select(F.col("sample").alias("scope"), F.explode("warnings").alias("code"))
    low = pearson(long).where(F.col("pearson") < PEARSON_MIN).select(F.concat_ws(":", "sample_a", "sample_b"), F.lit("low_pairwise_sample_correlation"))
    out = out.union(low)
    said = [("inputs", "sample_qc_not_provided")] if qc is None else []
    if library is None:
        said.append(("inputs", "library_not_provided"))
    elif k > 1:
        said.append(("library", "library_collision_audit_radius"))
    if said:
        out = out.union(spark.createDataFrame(said, "scope string, code string"))
    if library is not None:
        r = library_report(library, k)
        found = F.array(F.when(F.col("one_edit_collision_pairs") > 0, F.lit("guide_collision")), F.when(F.col("non_acgt_sequences") > 0, F.lit("non_acgt_guides")))
        out = out.union(r.select(F.lit("library"), F.explode(F.filter(found, lambda x: x.isNotNull()))))
    return out


#: Findings on a demultiplexed run (name, share of all reads, bound, side): fixed values.
FINDINGS = (
    ("low_assignment_rate", "assigned_reads", 0.80, "low"),
    ("high_ambiguity_rate", "ambiguous_reads", 0.05, "high"),
    ("high_no_match_rate", "no_match_reads", 0.15, "high"),
    ("high_invalid_window_rate", "invalid_reads", 0.02, "high"),
)


def findings(summary: DataFrame, audit: DataFrame, weak_window: bool = False) -> DataFrame:
    """(finding, severity) from a run's one-row summary and its library's one-row audit."""
    t = F.col("total_reads")
    share = [F.when((t > 0) & (F.col(c) / t < b if side == "low" else F.col(c) / t > b), F.lit(name)) for name, c, b, side in FINDINGS]
    unsafe = F.when((F.col("risk_pairs") > 0) | (F.col("safe_at_k1") == "no"), F.lit("unsafe_one_edit_correction"))
    both = summary.crossJoin(audit.select("risk_pairs", "safe_at_k1"))  # a row each
    all_ = F.filter(F.array(F.lit("low_confidence_offset" if weak_window else None).cast("string"), *share, unsafe), lambda x: x.isNotNull())
    named = both.select(F.explode(F.when(F.size(all_) > 0, all_).otherwise(F.array(F.lit("no_review_findings")))).alias("finding"))
    return named.withColumn("severity", F.when(F.col("finding") == "no_review_findings", "pass").otherwise("review"))


def failure_reason(total="total_reads", assigned="assigned_reads", ambiguous="ambiguous_reads", unmatched="no_match_reads", invalid="invalid_reads"):
    """The first threshold that a sample fails, else clean or review."""
    t = F.col(total)
    return (
        F.when(t == 0, "no_reads").when(F.col(invalid) / t > 0.02, "invalid_window").when(F.col(ambiguous) / t > 0.05, "ambiguous_collision")
        .when(F.col(unmatched) / t > 0.15, "high_no_match").when(F.col(assigned) / t >= 0.80, "clean").otherwise("review")
    )
