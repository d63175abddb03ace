"""Queries over a fixture that is projected from the TPC-H-like tables, with DuckDB SQL for each.

Targets are 12-mers made from ``part``; reads are a 4-base flank, a (mutated) target and a tail,
made from ``orders``. The window is start 4, length 12.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import seq as S
from .operators import assign as A
from .operators import audit, counting, inspect, offsets, panel

START, LENGTH, K = 4, 12, 1

FX_TARGETS = """
select k as target_index, concat('P',cast(k as varchar(20))) as target_id, gene,
 case when k%50=1 then concat(substr(b,1,5),translate(substr(b,6,1),'ACGT','CGTA'),substr(b,7)) else b end as seq
from (select p_partkey as k, p_brand as gene,
  translate(substr(md5(concat('t',cast((case when p_partkey%50=1 or p_partkey%200=3 then p_partkey-1 else p_partkey end) as varchar(20)))),1,12),'0123456789abcdef','ACGTACGTACGTACGT') as b
  from {part}) z
"""
FX_READS = """
select read_id, sample, cls, seq,
 substr(translate(concat(md5(concat('q',cast(read_id as varchar(20)))),md5(concat('p',cast(read_id as varchar(20))))),'0123456789abcdef','!!!!IIIIIIIIIIII'),1,cast(length(seq) as int)) as qual
from (select read_id, sample, cls, case when cls=9 then substr(concat(lf,ins),1,9) else concat(lf,ins,rf) end as seq
 from (select o.o_orderkey as read_id, concat('S',cast(o.o_custkey%4 as varchar(20))) as sample, o.o_orderkey%10 as cls,
  translate(substr(md5(concat('l',cast(o.o_orderkey as varchar(20)))),1,4),'0123456789abcdef','ACGTACGTACGTACGT') as lf,
  translate(substr(md5(concat('x',cast(o.o_orderkey as varchar(20)))),1,8),'0123456789abcdef','ACGTACGTACGTACGT') as rf,
  case when o.o_orderkey%10 in (0,1,2,3,9) then t.seq
   when o.o_orderkey%10 in (4,5) then concat(substr(t.seq,1,2),translate(substr(t.seq,3,1),'ACGT','CGTA'),substr(t.seq,4))
   when o.o_orderkey%10=6 then concat(substr(t.seq,1,4),substr(t.seq,6))
   when o.o_orderkey%10=7 then concat(substr(t.seq,1,4),'G',substr(t.seq,5))
   when o.o_orderkey%20=8 then concat(substr(t.seq,1,3),'N',substr(t.seq,5))
   else translate(substr(md5(concat('z',cast(o.o_orderkey as varchar(20)))),1,12),'0123456789abcdef','ACGTACGTACGTACGT') end as ins
  from {orders} o join {fx_targets} t on t.target_index = (o.o_orderkey*7+cast(floor(o.o_orderkey/10) as bigint))%(select count(*) from {part})) a) b
"""


def fixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    targets = spark.sql(FX_TARGETS, part=part)
    return spark.sql(FX_READS, part=part, orders=orders, fx_targets=A.spread(targets)), targets


_CTE = "with fx_targets as (" + FX_TARGETS.format(part="part") + "),\nfx_reads as (" + FX_READS.format(part="part", orders="orders", fx_targets="fx_targets") + ")"
_W = f"case when length(seq)>={START + LENGTH} then substr(seq,{START + 1},{LENGTH}) end"

#: Windows of all reads against all targets, brute force, to one row per read.
_HIT = {
    "levenshtein": f"levenshtein(w.o,t.seq)<={K}",
    "hamming": f"case when length(w.o)=length(t.seq) then hamming(w.o,t.seq) else 99 end<={K}",
    "exact": "w.o=t.seq",
}


def _assigned_sql(kind: str, policy: str = "best") -> str:
    d = "0" if kind == "exact" else "levenshtein(w.o,t.seq)"
    many = "ties>1" if policy == "best" else "match_count>1"
    return f"""{_CTE},
r as (select *, {_W} as o from fx_reads),
h as materialized (select w.o, t.target_index, {d} as d from (select distinct o from r where o is not null) w join fx_targets t on {_HIT[kind]}),
b as (select o, min(d) as best from h group by o),
f as (select h.o, b.best, count(*) as match_count, count(*) filter (h.d=b.best) as ties, min(h.target_index) filter (h.d=b.best) as ti, min(h.d) filter (h.d>b.best) as second
  from h join b on h.o=b.o group by h.o, b.best),
a as (select r.*, coalesce(f.ti,-1) as target_index, coalesce(f.best,-1) as best_distance, coalesce(f.second,-1) as second_best_distance, coalesce(f.match_count,0) as match_count,
  case when r.o is null then 'invalid' when f.o is null then 'none' when {many} then 'ambiguous' else 'unique' end as status
  from r left join f on r.o=f.o),
k as (select a.*, case when status='unique' then case when best_distance=0 then 'exact' when length(a.o)=length(t.seq) then 'substitution' when length(a.o)>length(t.seq) then 'insertion' else 'deletion' end end as kind, t.target_id, t.seq as target_seq
  from a left join fx_targets t on a.target_index=t.target_index)
"""


_COLS = ["read_id", "target_index", "best_distance", "second_best_distance", "match_count", "status"]


def _assign(metric: str, k: int = K, policy: str = "best"):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        reads, targets = fixture(spark, sf_dir)
        return A.assign(reads, targets, k, metric, policy, START, LENGTH).select(*_COLS)

    return q


def _indel(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, targets = fixture(spark, sf_dir)
    return A.assign_multi(reads, targets, K, [START], [LENGTH - 1, LENGTH, LENGTH + 1], with_window=False).select(*_COLS)


def offset_fanout(spark, sf_dir):
    reads, targets = fixture(spark, sf_dir)
    return A.assign_multi(reads, targets, 0, [START - 1, START, START + 1], [LENGTH]).select(*_COLS, "observed")


def length_set(spark, sf_dir):
    reads, targets = fixture(spark, sf_dir)
    return A.assign_length_set(reads, targets, K, START, [LENGTH - 1, LENGTH, LENGTH + 1]).select(*_COLS)


_INDEL_SQL = f"""{_CTE},
w as (select read_id, substr(seq,{START + 1},n) as o from fx_reads, (values (11),(12),(13)) v(n) where length(seq)>={START}+n),
p as materialized (select x.o, t.target_index, levenshtein(x.o,t.seq) as d from (select distinct o from w) x join fx_targets t on abs(length(x.o)-length(t.seq))<=1 and levenshtein(x.o,t.seq)<=1),
h as (select w.read_id, p.target_index, min(p.d) as d from w join p on w.o=p.o group by 1,2),
b as (select read_id, min(d) as best from h group by 1),
f as (select h.read_id, b.best, count(*) as match_count, count(*) filter (h.d=b.best) as ties, min(target_index) filter (h.d=b.best) as ti, min(h.d) filter (h.d>b.best) as second from h join b using (read_id) group by 1,2)
select r.read_id, coalesce(ti,-1) as target_index, coalesce(best,-1) as best_distance, coalesce(second,-1) as second_best_distance, coalesce(match_count,0) as match_count,
 case when length(r.seq)<{START + 11} then 'invalid' when f.read_id is null then 'none' when ties>1 then 'ambiguous' else 'unique' end as status
from fx_reads r left join f on r.read_id=f.read_id
"""


def _counted(spark: SparkSession, sf_dir: str, metric: str = "levenshtein"):
    reads, targets = fixture(spark, sf_dir)
    counts = counting.window_counts(reads, START, LENGTH)
    return reads, targets, counting.assigned_counts(counts, targets, K, metric)


def _samples(reads: DataFrame) -> DataFrame:
    return reads.select("sample").distinct()


def _names(reads: DataFrame) -> list[str]:
    """The run's samples, for tables with a column for each."""
    return [r.sample for r in _samples(reads).orderBy("sample").collect()]


def _long(spark: SparkSession, sf_dir: str):
    reads, targets, got = _counted(spark, sf_dir)
    return targets, got, counting.count_long(got, targets, _samples(reads))


def count_long(spark, sf_dir):
    return _long(spark, sf_dir)[2].select("sample", "target_id", "gene", "count", "count_exact", "count_substitution")


def count_matrix(spark, sf_dir):
    reads, targets, got = _counted(spark, sf_dir, "hamming")
    return counting.count_matrix(got, targets, _names(reads))


def count_wide(spark, sf_dir):
    reads, targets, got = _counted(spark, sf_dir)
    out = counting.count_wide(got, targets, _names(reads), counting.ambiguous_nearby(targets, K))
    return out.select("target_id", "target_seq", "ambiguous_nearby", "S0_total", "S1_exact", "S2_substitution", "S3_total")


def sample_qc(spark, sf_dir):
    _, got, long = _long(spark, sf_dir)
    rates = ["assignment_rate", "exact_rate", "rescue_rate", "ambiguous_rate", "no_match_rate", "gini_index", "top_1pct_read_fraction"]
    qc = counting.sample_qc(got, long)
    return qc.select("sample", "total_reads", "valid_extracted_reads", "assigned_reads", "exact_reads", "k1_rescued_reads", "k1_sub_reads", "ambiguous_reads", "no_match_reads", "invalid_reads", "targets_observed", "zero_count_targets", *[F.round(c, 8).alias(c) for c in rates])


_PER = """per as (select s.sample, t.target_index, coalesce(c.n,0) as x from (select distinct sample from k) s cross join fx_targets t
 left join (select sample, target_index, count(*) as n from k where status='unique' group by 1,2) c on c.sample=s.sample and c.target_index=t.target_index),
rk as (select *, row_number() over (partition by sample order by x) as i, row_number() over (partition by sample order by x desc) as j, count(*) over (partition by sample) as n from per),
gi as (select sample, sum(case when x>0 then 1 else 0 end) as targets_observed, sum(case when x=0 then 1 else 0 end) as zero_count_targets,
 case when sum(x)=0 then 0 else greatest(0,least(1,2*sum(i*x)/(max(n)*sum(x))-(max(n)+1)/max(n))) end as gini_index,
 case when sum(x)=0 then 0 else sum(case when j<=greatest(1,floor(n*0.01)) then x else 0 end)/sum(x) end as top_1pct_read_fraction from rk group by 1)"""

_QC_SQL = (
    _assigned_sql("levenshtein")
    + f""", {_PER}, s as (select sample, count(*) as total_reads, count(*) filter (status<>'invalid') as valid_extracted_reads, count(*) filter (status='unique') as assigned_reads,
 count(*) filter (kind='exact') as exact_reads, count(*) filter (status='unique' and best_distance>0) as k1_rescued_reads, count(*) filter (kind='substitution') as k1_sub_reads,
 count(*) filter (status='ambiguous') as ambiguous_reads, count(*) filter (status='none') as no_match_reads, count(*) filter (status='invalid') as invalid_reads from k group by 1)
select s.*, cast(targets_observed as bigint) as targets_observed, cast(zero_count_targets as bigint) as zero_count_targets,
 round(assigned_reads/greatest(1,valid_extracted_reads),8) as assignment_rate, round(exact_reads/greatest(1,valid_extracted_reads),8) as exact_rate, round(k1_rescued_reads/greatest(1,valid_extracted_reads),8) as rescue_rate,
 round(ambiguous_reads/greatest(1,valid_extracted_reads),8) as ambiguous_rate, round(no_match_reads/greatest(1,valid_extracted_reads),8) as no_match_rate, round(gini_index,8) as gini_index, round(top_1pct_read_fraction,8) as top_1pct_read_fraction
from s join gi using (sample)"""
)


def run_summary(spark, sf_dir):
    _, got, long = _long(spark, sf_dir)
    s = counting.run_summary(got, long)
    return s.select("total_reads", "assigned_reads", "ambiguous_reads", "no_match_reads", "invalid_reads", F.round("assigned_percent", 6).alias("assigned_percent"), "targets_observed", "zero_count_targets", "top_target", "top_count")


def ambiguous_nearby(spark, sf_dir):
    return counting.ambiguous_nearby(fixture(spark, sf_dir)[1], K)


def _pairs(spark, sf_dir):
    reads, targets = fixture(spark, sf_dir)
    short = targets.groupBy(F.substr("seq", F.lit(1), F.lit(6)).alias("seq")).agg(F.min("target_index").alias("target_index")).withColumn("target_id", F.concat(F.lit("L"), "target_index"))
    return counting.assign_pairs(reads, targets, short, (START, LENGTH), (0, 6), (K, 0))


def pair_counts(spark, sf_dir):
    return counting.pair_counts(_pairs(spark, sf_dir))


def pair_stats(spark, sf_dir):
    return counting.pair_stats(_pairs(spark, sf_dir))


def _pair_sql() -> str:
    return _assigned_sql("levenshtein") + """, sh as (select substr(seq,1,6) as seq, min(target_index) as target_index from fx_targets group by 1),
p as (select k.status as ls, k.target_index as li, length(k.seq)<6 as r0, g.target_index as ri from k left join sh g on length(k.seq)>=6 and substr(k.seq,1,6)=g.seq)"""


def demux_summary(spark, sf_dir):
    _, targets, got = _counted(spark, sf_dir, "hamming")
    return counting.demux_summary(got, targets)


def unmatched_groups(spark, sf_dir):
    reads, targets = fixture(spark, sf_dir)
    got = A.assign(reads, targets, K, start=START, length=LENGTH).withColumn("ordinal", F.col("read_id")).withColumn("window_qual", F.substr("qual", F.lit(START + 1), F.lit(LENGTH)))
    return inspect.group_unmatched(got, quality_threshold=10, adapters=["ACGTACG"]).select("sequence", "count", "low_quality_count", "adapter_hint")


def unmatched_top(spark, sf_dir):
    reads, targets = fixture(spark, sf_dir)
    return inspect.inspect_unmatched(reads, targets, START, LENGTH, K, top_n=10).select("sequence", "count", "nearest_target", "nearest_distance", "possible_reason", "reverse_complement", "revcomp_nearest_target", "revcomp_nearest_distance")


def offset_scores(spark, sf_dir):
    reads, targets = fixture(spark, sf_dir)
    return offsets.score_offsets(reads, targets, START, 2, LENGTH)


def offset_select(spark, sf_dir):
    return offsets.select_offsets(offset_scores(spark, sf_dir), 3).select("sample", F.element_at("offsets", 1).alias("offset"))


def barcode_infer(spark, sf_dir):
    reads, targets = fixture(spark, sf_dir)
    out = offsets.infer_windows(reads, targets, [2, 3, 4, 5], None, K)
    return out.select("start", "length", "unique", "ambiguous", "no_match", "invalid", F.round("score", 8).alias("score"))


def audit_pairs(spark, sf_dir):
    return audit.all_pairs(fixture(spark, sf_dir)[1], 1)


def audit_safety(spark, sf_dir):
    t = fixture(spark, sf_dir)[1]
    return audit.safety(t, audit.all_pairs(t, 1), 2).select("target_id", "nearest_distance", "nearest_index", "safe_at_k1", "safe_at_k2", "num_nearby_k1_risk_targets")


def audit_clusters(spark, sf_dir):
    t = fixture(spark, sf_dir)[1]
    return audit.clusters(audit.all_pairs(t, 1))


def audit_variants(spark, sf_dir):
    return audit.ambiguous_variants(fixture(spark, sf_dir)[1])


def audit_summary(spark, sf_dir):
    t = fixture(spark, sf_dir)[1]
    return audit.audit_summary(t, audit.all_pairs(t, 1), audit.ambiguous_variants(t), 1).select("targets", "unique_sequences", "duplicate_pairs", "risk_pairs", "min_distance", "recommended_k", "safe_at_k1")


def sequence_functions(spark, sf_dir):
    reads, _ = fixture(spark, sf_dir)
    w = S.window("seq", START, LENGTH)
    return reads.select(
        "read_id", w.alias("observed"), S.reverse_complement("seq").alias("rc"), S.contains_n("seq").alias("has_n"), S.low_quality("qual", 10).alias("low_quality"),
        F.round(S.gc_fraction("seq"), 8).alias("gc"), S.max_homopolymer("seq").alias("homopolymer"), S.encode_2bit(F.substr("seq", F.lit(1), F.lit(8))).alias("code"), S.safe_name(F.concat("sample", F.lit("/x y"))).alias("safe"),
    )


def quality_gate(spark, sf_dir):
    reads, targets = fixture(spark, sf_dir)
    got = A.assign(reads, targets, K, "hamming", start=START, length=LENGTH).withColumn("window_qual", F.substr("qual", F.lit(START + 1), F.lit(LENGTH)))
    return A.quality_gate(got, 20).select("read_id", "status", "target_index", "quality_rejected")


def panel_content(spark, sf_dir):
    out = panel.content(fixture(spark, sf_dir)[1], panel.Constraints(forbidden_motifs=("GGGG", "ACAC")))
    return out.select("target_id", F.round("gc", 8).alias("gc"), "homopolymer_max", "forbidden_motifs", F.round("self_complement_score", 8).alias("self_complement_score"))


#: Distances that a library of random 12-mers mostly keeps.
_LOOSE = panel.Constraints(min_hamming=3, min_levenshtein=3, min_sequence_levenshtein=3)


def panel_pairwise(spark, sf_dir):
    out = panel.collision_pairs(fixture(spark, sf_dir)[1], _LOOSE)
    return out.select("barcode_id", "other_id", "hamming_distance", "levenshtein_distance", "reverse_complement_distance", "status", "warnings")


def panel_nearest(spark, sf_dir):
    return panel.nearest_neighbours(panel.pairwise(fixture(spark, sf_dir)[1]))


def panel_cycles(spark, sf_dir):
    out = panel.cycle_balance(fixture(spark, sf_dir)[1])
    return out.select("cycle", *[F.round(f"{b}_fraction", 8).alias(f"{b}_fraction") for b in "acgt"], "status")


def panel_risk(spark, sf_dir):
    return panel.assignment_risk(fixture(spark, sf_dir)[1], 1, "hamming").groupBy("source_index", "risk").agg(F.count("*").alias("n"))


def panel_compare(spark, sf_dir):
    t = fixture(spark, sf_dir)[1]
    other = t.withColumn("seq", F.when(F.col("target_index") % 3 == 0, F.reverse("seq")).otherwise(F.col("seq"))).withColumn("target_id", F.when(F.col("target_index") % 4 == 0, F.concat(F.lit("Q"), "target_index")).otherwise(F.col("target_id")))
    return panel.compare(t, other)


def _melted(spark, sf_dir):
    return counting.melt_matrix(count_matrix(spark, sf_dir))


def matrix_metrics(spark, sf_dir):
    m = counting.matrix_metrics(_melted(spark, sf_dir))
    return m.select("sample", "total_count", "nonzero_guides", "zero_count_guides", F.round("coverage_fraction", 8).alias("coverage_fraction"), F.round("gini_index", 8).alias("gini_index"), F.round("top_1pct_fraction", 8).alias("top_1pct_fraction"))


def matrix_pearson(spark, sf_dir):
    return counting.pearson(_melted(spark, sf_dir)).select("sample_a", "sample_b", F.round("pearson", 6).alias("pearson"))


def matrix_spearman(spark, sf_dir):
    return counting.spearman(_melted(spark, sf_dir)).select("sample_a", "sample_b", F.round("spearman", 6).alias("spearman"))


def table_agreement(spark, sf_dir):
    long = _melted(spark, sf_dir)
    side = lambda s: long.where(F.col("sample") == s).select(F.col("sgRNA").alias("key"), "count")
    out = counting.table_agreement(side("S0"), side("S1"))
    return out.select("left_total", "right_total", "total_delta", "differing", "max_abs_delta", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


def library_report(spark, sf_dir):
    return counting.library_report(fixture(spark, sf_dir)[1])


def qc_review(spark, sf_dir):
    _, got, long = _long(spark, sf_dir)
    qc = counting.sample_qc(got, long)
    found = counting.warnings(counting.review_metrics(long, qc))
    return qc.join(found, "sample").select("sample", F.array_join("warnings", ",").alias("warnings"), "qc_status", counting.failure_reason().alias("reason"))


def crispr_review(spark, sf_dir):
    targets, got, long = _long(spark, sf_dir)
    return counting.crispr_review(long, counting.sample_qc(got, long), targets, 2)


def findings(spark, sf_dir):
    _, targets, got = _counted(spark, sf_dir)
    report = audit.audit_summary(targets, audit.all_pairs(targets, 1), audit.ambiguous_variants(targets), 1)
    return counting.findings(counting.demux_summary(got, targets), report)


def validate(spark, sf_dir):
    reads, targets = fixture(spark, sf_dir)
    return A.validate(reads, targets, K, START, LENGTH)


def panel_safety(spark, sf_dir):
    t = fixture(spark, sf_dir)[1]
    out = panel.target_safety(t, panel.assignment_risk(t, 1, "hamming"), panel.Constraints())
    return out.select("target_id", "status", "ambiguous_variants", "silent_assignment_variants", F.round("gc", 8).alias("gc"), "homopolymer_max", "warnings")


def panel_context(spark, sf_dir):
    return panel.context_rows(fixture(spark, sf_dir)[1], panel.Constraints(left_flank="GGAA", right_flank="TTCA", context_window=4)).select("target_id", "flanked_sequence", "cross_boundary_homopolymer", "risks", "status")


def panel_overlaps(spark, sf_dir):
    """Of a panel of two lengths: the targets, and the first eleven symbols of each."""
    t = fixture(spark, sf_dir)[1].select("target_index", "target_id", "seq")
    cut = t.select((F.col("target_index") + 1_000_000_000).alias("target_index"), F.concat(F.lit("C"), "target_id").alias("target_id"), F.substr("seq", F.lit(1), F.lit(11)).alias("seq"))
    return panel.overlaps(t.union(cut), 1).where("risk = 'exact_overlap'").select("barcode_id", "other_id", "overlap_length")


def panel_reverse(spark, sf_dir):
    return panel.reverse_complements(fixture(spark, sf_dir)[1], 1).select("barcode_id", "other_id", "distance", "risk")


def offset_select_multi(spark, sf_dir):
    return offsets.select_offsets(offset_scores(spark, sf_dir), 3, "multi", 0.001).select("sample", F.concat_ws(",", "offsets").alias("offsets"))


#: The samples of the reads projected above, for the columns of the SQL.
_SAMPLES = ["S0", "S1", "S2", "S3"]
_A, _H, _X = _assigned_sql("levenshtein"), _assigned_sql("hamming"), _assigned_sql("exact")
_SEL = "select " + ", ".join(_COLS) + " from a"
_MAT = _H + ", m as (select t.target_index, t.target_id as sgRNA, s.sample, count(k.read_id) as count from fx_targets t cross join (values ('S0'),('S1'),('S2'),('S3')) s(sample) left join k on k.status='unique' and k.target_index=t.target_index and k.sample=s.sample group by 1,2,3)"
_LEV_PAIRS = "pr as materialized (select a.target_index as i, b.target_index as j, levenshtein(a.seq,b.seq) as distance from fx_targets a join fx_targets b on a.target_index<b.target_index and levenshtein(a.seq,b.seq)<=2)"
_RC = lambda x: f"reverse(translate({x},'ACGT','TGCA'))"
_RANKS = ", rk as (select sgRNA, sample, rank() over (partition by sample order by count)+(count(*) over (partition by sample, count)-1)/2 as x from m)"
_TWO = "select a.sample as sample_a, b.sample as sample_b"

_SUB = "cross join generate_series(1,12) g(p) cross join (values ('A'),('C'),('G'),('T')) q(c)"
_VARIANTS = f"""v as (select distinct target_index, variant from (
 select target_index, seq as variant from fx_targets
 union all select target_index, concat(substr(seq,1,p-1),c,substr(seq,p+1)) from fx_targets {_SUB}
 union all select target_index, concat(substr(seq,1,p-1),substr(seq,p+1)) from fx_targets cross join generate_series(1,12) g(p)
 union all select target_index, concat(substr(seq,1,p),c,substr(seq,p+1)) from fx_targets cross join generate_series(0,12) g(p) cross join (values ('A'),('C'),('G'),('T')) q(c)) z)"""

#: The review of each sample, its rules as stated for count runs.
_REVIEW = _PER + """, ex as (select sample, avg(case when x>0 then 1.0 else 0.0 end) as cov, case when sum(x)=0 then 0 else sum(case when j<=greatest(1,ceil(n*0.01)) then x else 0 end)/sum(x) end as top from rk group by 1),
s as (select sample, count(*) as t, count(*) filter (status<>'invalid') as v, count(*) filter (status='unique') as u, count(*) filter (status='ambiguous') as am, count(*) filter (status='none') as nm, count(*) filter (status='invalid') as iv from k group by 1),
w as (select s.*, concat_ws(',',case when u/v<0.80 then 'low_assignment_rate' end,case when am/v>0.05 then 'high_ambiguous_rate' end,case when nm/v>0.15 then 'high_no_match_rate' end,case when iv/t>0.02 then 'high_invalid_rate' end,case when cov<0.90 then 'low_guide_coverage' end,case when 1-cov>0.10 then 'high_zero_count_fraction' end,case when gini_index>0.50 then 'high_gini_index' end,case when top>0.30 then 'high_top_1pct_fraction' end) as warnings
 from s join gi using (sample) join ex using (sample))"""

_DINUC = "|".join(f"({a}{b}){{5}}" for a in "ACGT" for b in "ACGT")

_QUERIES: dict[str, tuple[Callable, str | None]] = {
    "assign_exact": (_assign("levenshtein", 0), f"{_X} {_SEL}"),
    "assign_hamming_k1": (_assign("hamming"), f"{_H} {_SEL}"),
    "assign_levenshtein_k1": (_assign("levenshtein"), f"{_A} {_SEL}"),
    "assign_levenshtein_k2": (_assign("levenshtein", 2), _assigned_sql("levenshtein").replace("levenshtein(w.o,t.seq)<=1", "levenshtein(w.o,t.seq)<=2") + f" {_SEL}"),
    "offset_fanout": (offset_fanout, f"""{_CTE}, w as (select read_id, s.p as p, substr(seq,cast(s.p+1 as int),12) as o from fx_reads cross join generate_series(3,5) s(p) where length(seq)>=s.p+12),
h as (select w.read_id, t.target_index, min(w.p) as p from w join fx_targets t on w.o=t.seq group by 1,2), f as (select read_id, min(target_index) as ti, count(*) as n, min(p) as p from h group by 1), v as (select read_id, min(p) as p from w group by 1)
select r.read_id, coalesce(f.ti,-1) as target_index, case when f.read_id is null then -1 else 0 end as best_distance, -1 as second_best_distance, coalesce(f.n,0) as match_count, case when v.read_id is null then 'invalid' when f.read_id is null then 'none' when f.n>1 then 'ambiguous' else 'unique' end as status,
 case when v.read_id is not null then substr(r.seq,cast(coalesce(f.p,v.p)+1 as int),12) end as observed from fx_reads r left join f on r.read_id=f.read_id left join v on r.read_id=v.read_id"""),
    "length_set": (length_set, None),
    "validate": (validate, _A + " select count(distinct o) as windows, count(distinct case when status in ('unique','ambiguous') then o end) as matched, 0::bigint as mismatches from a where o is not null"),
    "assign_levenshtein_k1_radius": (_assign("levenshtein", K, "radius"), f"{_assigned_sql('levenshtein', 'radius')} {_SEL}"),
    "assign_levenshtein_k1_indel": (_indel, _INDEL_SQL),
    "count_long": (count_long, _A + """, c as (select sample, target_index, count(*) as count, count(*) filter (kind='exact') as count_exact, count(*) filter (kind='substitution') as count_substitution from k where status='unique' group by 1,2)
select s.sample, t.target_id, t.gene, coalesce(count,0) as count, coalesce(count_exact,0) as count_exact, coalesce(count_substitution,0) as count_substitution from (values ('S0'),('S1'),('S2'),('S3')) s(sample) cross join fx_targets t left join c on c.sample=s.sample and c.target_index=t.target_index"""),
    "count_matrix": (count_matrix, _H + " select t.target_id as sgRNA, t.gene as Gene, " + ", ".join(f"count(*) filter (k.sample='{s}') as {s}" for s in _SAMPLES) + " from fx_targets t left join k on k.status='unique' and k.target_index=t.target_index group by 1,2"),
    "count_wide": (count_wide, _A + """, nb as (select t.target_index, count(*)>1 as near from fx_targets t join fx_targets u on levenshtein(t.seq,u.seq)<=1 group by 1)
select t.target_id, t.seq as target_seq, case when near then 'yes' else 'no' end as ambiguous_nearby, count(*) filter (k.sample='S0') as S0_total, count(*) filter (k.sample='S1' and kind='exact') as S1_exact, count(*) filter (k.sample='S2' and kind='substitution') as S2_substitution, count(*) filter (k.sample='S3') as S3_total
from fx_targets t join nb on nb.target_index=t.target_index left join k on k.status='unique' and k.target_index=t.target_index group by 1,2,3"""),
    "sample_qc": (sample_qc, _QC_SQL),
    "run_summary": (run_summary, _A + """, pt as (select t.target_index, t.target_id, count(k.read_id) as c from fx_targets t left join k on k.status='unique' and k.target_index=t.target_index group by 1,2),
tp as (select count(*) filter (c>0) as targets_observed, count(*) filter (c=0) as zero_count_targets, max(c) as top_count from pt)
select count(*) as total_reads, count(*) filter (status='unique') as assigned_reads, count(*) filter (status='ambiguous') as ambiguous_reads, count(*) filter (status='none') as no_match_reads, count(*) filter (status='invalid') as invalid_reads,
round(100*count(*) filter (status='unique')/count(*),6) as assigned_percent, any_value(tp.targets_observed) as targets_observed, any_value(tp.zero_count_targets) as zero_count_targets, (select arg_min(target_id,target_index) from pt where c=(select max(c) from pt)) as top_target, any_value(tp.top_count) as top_count from k, tp"""),
    "ambiguous_nearby": (ambiguous_nearby, _CTE + " select t.target_index, t.target_id, case when count(*)>1 then 'yes' else 'no' end as ambiguous_nearby from fx_targets t join fx_targets u on levenshtein(t.seq,u.seq)<=1 group by 1,2"),
    "pair_counts": (pair_counts, _pair_sql() + " select li as left_index, ri as right_index, count(*) as count from p where ls='unique' and ri is not null group by 1,2"),
    "pair_stats": (pair_stats, _pair_sql() + " select count(*) as total, count(*) filter (ls='unique' and ri is not null) as assigned, count(*) filter (ls='ambiguous' and not r0) as ambiguous, count(*) filter (ls='none' and not r0) as left_unmatched, count(*) filter (ls<>'invalid' and not r0 and ri is null) as right_unmatched, count(*) filter (ls='invalid' or r0) as invalid from p"),
    "demux_summary": (demux_summary, _H + """, pt as (select target_index, target_id, count(*) as c from k where status='unique' group by 1,2)
select count(*) as total_reads, count(*) filter (status='unique') as assigned_reads, count(*) filter (kind='exact') as exact_reads, count(*) filter (status='unique' and best_distance>0) as k1_rescued_reads, count(*) filter (status='ambiguous') as ambiguous_reads, count(*) filter (status='none') as no_match_reads, count(*) filter (status='invalid') as invalid_reads,
(select count(*) from pt) as nonempty_outputs, (select arg_min(target_id,target_index) from pt where c=(select max(c) from pt)) as top_barcode, (select max(c) from pt) as top_count from k"""),
    "unmatched_groups": (unmatched_groups, _A + """ select case when status='none' then o else '<invalid>' end as sequence, count(*) as count, count(*) filter (regexp_matches(substr(qual,5,12),'!')) as low_quality_count, bool_or(contains(seq,'ACGTACG')) as adapter_hint from k where status in ('none','invalid') group by 1"""),
    "unmatched_top": (unmatched_top, _A + f""", g as (select case when status='none' then o else '<invalid>' end as sequence, count(*) as count from k where status in ('none','invalid') group by 1 order by 2 desc, 1 limit 10),
x as (select sequence, count, case when sequence<>'<invalid>' then {_RC("regexp_replace(sequence,'[^ACGT]','N','g')")} end as rc from g),
n1 as (select sequence, min(struct_pack(d:=levenshtein(sequence,t.seq),i:=t.target_index,n:=t.target_id)) as m from x, fx_targets t where sequence<>'<invalid>' group by 1),
n2 as (select sequence, min(struct_pack(d:=levenshtein(rc,t.seq),i:=t.target_index,n:=t.target_id)) as m from x, fx_targets t where sequence<>'<invalid>' group by 1)
select x.sequence, x.count, n1.m.n as nearest_target, n1.m.d as nearest_distance, case when x.sequence='<invalid>' then 'wrong_length' when n2.m.d<=1 and n2.m.d<n1.m.d then 'reverse_complement_candidate' when contains(x.sequence,'N') then 'contains_N' when n1.m.d>1 then 'near_known_target_above_k' else 'unknown' end as possible_reason,
rc as reverse_complement, n2.m.n as revcomp_nearest_target, n2.m.d as revcomp_nearest_distance from x left join n1 on x.sequence=n1.sequence left join n2 on x.sequence=n2.sequence"""),
    "offset_scores": (offset_scores, _CTE + """, u as (select seq from fx_targets group by 1 having count(*)=1)
select r.sample, cast(s.p as int) as start, count(u.seq) as score, count(*) as checked from fx_reads r cross join generate_series(2,6) s(p) left join u on length(r.seq)>=s.p+12 and substr(r.seq,cast(s.p+1 as int),12)=u.seq group by 1,2"""),
    "offset_select": (offset_select, _CTE + """, u as (select seq from fx_targets group by 1 having count(*)=1),
sc as (select r.sample, cast(s.p as int) as start, count(u.seq) as score from fx_reads r cross join generate_series(2,6) s(p) left join u on length(r.seq)>=s.p+12 and substr(r.seq,cast(s.p+1 as int),12)=u.seq group by 1,2),
rn as (select *, row_number() over (partition by sample order by score desc, abs(start-3), start) as r, max(score) over (partition by sample) as m from sc) select sample, case when m>0 then start else 3 end as "offset" from rn where r=1"""),
    "barcode_infer": (barcode_infer, _CTE + """, c as (select cast(s.p as int) as start, case when length(r.seq)>=s.p+12 then substr(r.seq,cast(s.p+1 as int),12) end as o from fx_reads r cross join generate_series(2,5) s(p)),
h as materialized (select w.o, levenshtein(w.o,t.seq) as d from (select distinct o from c where o is not null) w join fx_targets t on levenshtein(w.o,t.seq)<=1),
b as (select o, min(d) as m from h group by 1), u as (select h.o, count(*) as n from h join b using (o) where h.d=b.m group by 1), z as (select c.start, c.o, u.n from c left join u on c.o=u.o)
select start, 12 as length, count(*) filter (n=1) as "unique", count(*) filter (n>1) as ambiguous, count(*) filter (o is not null and n is null) as no_match, count(*) filter (o is null) as invalid, round(count(*) filter (n=1)/count(*)-count(*) filter (n>1)/count(*)-count(*) filter (o is null)/count(*),8) as score from z group by 1"""),
    "audit_pairs": (audit_pairs, f"{_CTE}, {_LEV_PAIRS} select i, j, distance from pr"),
    "audit_safety": (audit_safety, f"""{_CTE}, {_LEV_PAIRS}, e as (select i as x, distance as d, j as n from pr union all select j, distance, i from pr),
m as (select x, min(struct_pack(d:=d,n:=n)) as s, count(*) as near from e group by 1) select t.target_id, m.s.d as nearest_distance, m.s.n as nearest_index, case when m.s.d is null then 'yes' else 'no' end as safe_at_k1, case when m.s.d is null then 'not_computed' else 'no' end as safe_at_k2, coalesce(near,0) as num_nearby_k1_risk_targets from fx_targets t left join m on m.x=t.target_index"""),
    "audit_clusters": (audit_clusters, f"""{_CTE.replace("with ", "with recursive ", 1)}, {_LEV_PAIRS}, e as (select i as x, j as y from pr union select j, i from pr),
c as (select x, x as y from e union select c.x, e.y from c join e on c.y=e.x) select x as target_index, min(y) as cluster from c group by 1"""),
    "audit_variants": (audit_variants, f"{_CTE}, {_VARIANTS} select variant, count(*) as targets, min(target_index) as first_index from v group by 1 having count(*)>1"),
    "audit_summary": (audit_summary, f"""{_CTE}, {_LEV_PAIRS} select (select count(*) from fx_targets) as targets, (select count(distinct seq) from fx_targets) as unique_sequences, count(*) filter (distance=0) as duplicate_pairs, count(*) as risk_pairs, min(distance) as min_distance,
case when count(*)=0 then 1 else 0 end as recommended_k, case when count(*)=0 then 'yes' else 'no' end as safe_at_k1 from pr"""),
    "sequence_functions": (sequence_functions, _CTE + f""" select read_id, {_W} as observed, {_RC("regexp_replace(seq,'[^ACGT]','N','g')")} as rc, contains(seq,'N') as has_n, contains(qual,'!') as low_quality, round(length(regexp_replace(seq,'[^GC]','','g'))/length(seq),8) as gc,
(select max(length(x)) from unnest(regexp_extract_all(seq,'A+|C+|G+|T+|N+')) u(x)) as homopolymer, case when regexp_matches(substr(seq,1,8),'^[ACGT]+$') then list_sum(list_transform(range(length(substr(seq,1,8))), lambda i: (strpos('ACGT',substr(seq,i+1,1))-1)*pow(4,length(substr(seq,1,8))-1-i)))::bigint end as code, concat(sample,'_x_y') as safe from fx_reads"""),
    "quality_gate": (quality_gate, _H + """, q as (select *, status='unique' and best_distance>0 and not regexp_matches(list_aggregate(list_transform(range(12), lambda i: case when substr(o,i+1,1)=substr(target_seq,i+1,1) then '' else substr(qual,i+5,1) end),'string_agg',''),'^!*$') as bad from k)
select read_id, case when bad then 'none' else status end as status, case when bad then -1 else target_index end as target_index, coalesce(bad,false) as quality_rejected from q"""),
    "panel_content": (panel_content, _CTE + f""" select target_id, round(length(regexp_replace(seq,'[^GC]','','g'))/length(seq),8) as gc, (select max(length(x)) from unnest(regexp_extract_all(seq,'A+|C+|G+|T+')) u(x)) as homopolymer_max,
concat_ws(',',case when contains(seq,'GGGG') then 'GGGG' end,case when contains(seq,'ACAC') then 'ACAC' end) as forbidden_motifs, round((length(seq)-hamming(seq,{_RC("seq")}))/length(seq),8) as self_complement_score from fx_targets"""),
    "panel_pairwise": (panel_pairwise, _CTE + f""", p as (select a.target_id as barcode_id, b.target_id as other_id, hamming(a.seq,b.seq) as h, levenshtein(a.seq,b.seq) as d, hamming(a.seq,{_RC("b.seq")}) as r from fx_targets a join fx_targets b on a.target_index<b.target_index and (levenshtein(a.seq,b.seq)<3 or a.seq={_RC("b.seq")})),
w as (select barcode_id, other_id, h as hamming_distance, d as levenshtein_distance, r as reverse_complement_distance, concat_ws(';',case when h=0 or d=0 then 'duplicate' end,case when h<3 then 'below_min_hamming' end,case when d<3 then 'below_min_levenshtein' end,case when d<3 then 'below_min_sequence_levenshtein' end,case when r=0 then 'reverse_complement_exact' end) as warnings from p)
select *, case when contains(warnings,'duplicate') then 'fail' else 'warn' end as status from w"""),
    "panel_nearest": (panel_nearest, _CTE + ", m as (select a.target_index, min(struct_pack(d:=hamming(a.seq,b.seq),n:=b.target_index)) as s from fx_targets a join fx_targets b on a.target_index<>b.target_index group by 1) select target_index, m.s.d as nearest_distance, m.s.n as nearest_index from m"),
    "panel_cycles": (panel_cycles, _CTE + """, c as (select cast(p as int) as cycle, substr(seq,cast(p as int),1) as b from fx_targets cross join generate_series(1,12) g(p)),
f as (select cycle, count(*) filter (b='A')/count(*) as a, count(*) filter (b='C')/count(*) as c, count(*) filter (b='G')/count(*) as g, count(*) filter (b='T')/count(*) as t from c group by 1)
select cycle, round(a,8) as a_fraction, round(c,8) as c_fraction, round(g,8) as g_fraction, round(t,8) as t_fraction, case when least(a,c,g,t)<0.15 or greatest(a,c,g,t)>0.4 then 'warn' else 'pass' end as status from f"""),
    "panel_risk": (panel_risk, _CTE + f""", pn as (select * from fx_targets),
v as (select distinct target_index, concat(substr(seq,1,cast(p-1 as int)),c,substr(seq,cast(p+1 as int))) as variant from pn {_SUB}),
h as (select v.target_index as source_index, v.variant, t.target_index, hamming(v.variant,t.seq) as d from v join pn t on hamming(v.variant,t.seq)<=1), b as (select source_index, variant, min(d) as best from h group by 1,2),
f as (select source_index, variant, count(*) as ties, min(target_index) as ti from h join b using (source_index, variant) where d=best group by 1,2)
select source_index, case when ties>1 then 'ambiguous' else 'silent_assignment' end as risk, count(*) as n from f where ties>1 or ti<>source_index group by 1,2"""),
    "panel_compare": (panel_compare, _CTE + """, a as (select * from fx_targets), b as (select case when target_index%3=0 then reverse(seq) else seq end as seq, case when target_index%4=0 then concat('Q',cast(target_index as varchar)) else target_id end as target_id from fx_targets)
select 'sequence' as kind, value, 'shared' as change from (select seq as value from a intersect select seq from b) union all select 'sequence', value, 'added' from (select seq as value from b except select seq from a) union all select 'sequence', value, 'removed' from (select seq as value from a except select seq from b)
union all select 'id', value, 'shared' from (select target_id as value from a intersect select target_id from b) union all select 'id', value, 'added' from (select target_id as value from b except select target_id from a) union all select 'id', value, 'removed' from (select target_id as value from a except select target_id from b)"""),
    "matrix_metrics": (matrix_metrics, _MAT + """, rn as (select *, row_number() over (partition by sample order by count) as i, row_number() over (partition by sample order by count desc) as j, count(*) over (partition by sample) as n from m)
select sample, cast(sum(count) as bigint) as total_count, count(*) filter (count>0) as nonzero_guides, count(*) filter (count=0) as zero_count_guides, round(count(*) filter (count>0)/count(*),8) as coverage_fraction, round(2*sum(i*count)/(max(n)*sum(count))-(max(n)+1)/max(n),8) as gini_index, round(sum(case when j<=greatest(1,ceil(n*0.01)) then count else 0 end)/sum(count),8) as top_1pct_fraction from rn group by 1"""),
    "matrix_pearson": (matrix_pearson, f"{_MAT} {_TWO}, round(corr(log2(a.count+1),log2(b.count+1)),6) as pearson from m a join m b on a.sgRNA=b.sgRNA and a.sample<b.sample group by 1,2"),
    "matrix_spearman": (matrix_spearman, f"{_MAT}{_RANKS} {_TWO}, round(corr(a.x,b.x),6) as spearman from rk a join rk b on a.sgRNA=b.sgRNA and a.sample<b.sample group by 1,2"),
    "table_agreement": (table_agreement, f"""{_MAT}{_RANKS} select cast(sum(a.count) as bigint) as left_total, cast(sum(b.count) as bigint) as right_total, cast(sum(a.count)-sum(b.count) as bigint) as total_delta, count(*) filter (a.count<>b.count) as differing, max(abs(a.count-b.count)) as max_abs_delta, round(corr(a.count,b.count),6) as pearson, round(corr(x.x,y.x),6) as spearman
from m a join m b on a.sgRNA=b.sgRNA and a.sample='S0' and b.sample='S1' join rk x on x.sgRNA=a.sgRNA and x.sample='S0' join rk y on y.sgRNA=a.sgRNA and y.sample='S1'"""),
    "library_report": (library_report, _CTE + """, g as (select gene, count(*) as c from fx_targets group by 1)
select (select count(*) from fx_targets) as guides, (select count(*) from fx_targets where not regexp_matches(seq,'^[ACGT]+$')) as non_acgt_sequences, (select count(*) from (select target_id from fx_targets group by 1 having count(*)>1) q) as duplicate_ids, (select count(*) from (select seq from fx_targets group by 1 having count(*)>1) q) as duplicate_sequences,
min(c) as min_guides_per_gene, median(c) as median_guides_per_gene, max(c) as max_guides_per_gene, (select count(*) from fx_targets a join fx_targets b on a.target_index<b.target_index and levenshtein(a.seq,b.seq)<=1) as one_edit_collision_pairs from g"""),
    "qc_review": (qc_review, _A + f""", {_REVIEW} select w.sample, w.warnings, case when w.warnings='' then 'pass' else 'review' end as qc_status, case when iv/t>0.02 then 'invalid_window' when am/t>0.05 then 'ambiguous_collision' when nm/t>0.15 then 'high_no_match' when u/t>=0.8 then 'clean' else 'review' end as reason from w"""),
    "crispr_review": (crispr_review, _A + f""", {_REVIEW}, cr as (select a.sample as x, b.sample as y, corr(log2(a.x+1),log2(b.x+1)) as r from per a join per b on a.target_index=b.target_index and a.sample<b.sample group by 1,2)
select sample as scope, unnest(string_split(warnings,',')) as code from w where warnings<>'' union all select concat(x,':',y), 'low_pairwise_sample_correlation' from cr where r<0.80
union all select 'library', 'library_collision_audit_radius' union all select 'library', 'guide_collision' where exists (select 1 from fx_targets a join fx_targets b on a.target_index<b.target_index and levenshtein(a.seq,b.seq)<=1) union all select 'library', 'non_acgt_guides' where exists (select 1 from fx_targets where not regexp_matches(seq,'^[ACGT]+$'))"""),
    "findings": (findings, _A + f""", {_LEV_PAIRS}, ff as (select count(*) as t, count(*) filter (status='unique') as u, count(*) filter (status='ambiguous') as am, count(*) filter (status='none') as nm, count(*) filter (status='invalid') as iv, (select count(*) from pr) as risk from k),
l as (select unnest([case when u/t<0.80 then 'low_assignment_rate' end, case when am/t>0.05 then 'high_ambiguity_rate' end, case when nm/t>0.15 then 'high_no_match_rate' end, case when iv/t>0.02 then 'high_invalid_window_rate' end, case when risk>0 then 'unsafe_one_edit_correction' end]) as finding from ff)
select finding, 'review' as severity from l where finding is not null union all select 'no_review_findings', 'pass' where not exists (select 1 from l where finding is not null)"""),
    "panel_safety": (panel_safety, _CTE + f""", v as (select distinct target_index, concat(substr(seq,1,cast(p-1 as int)),c,substr(seq,cast(p+1 as int))) as variant from fx_targets {_SUB}),
h as (select v.target_index as source_index, v.variant, t.target_index, hamming(v.variant,t.seq) as d from v join fx_targets t on hamming(v.variant,t.seq)<=1), b as (select source_index, variant, min(d) as best from h group by 1,2),
f as (select source_index, variant, count(*) as ties, min(target_index) as ti from h join b using (source_index, variant) where d=best group by 1,2), n as (select source_index, count(*) filter (ties>1) as am, count(*) filter (ties=1 and ti<>source_index) as si from f group by 1),
c as (select target_index, target_id, length(regexp_replace(seq,'[^GC]','','g'))/length(seq) as gc, (select max(length(x)) from unnest(regexp_extract_all(seq,'A+|C+|G+|T+')) u(x)) as run, regexp_matches(seq,'AAAA|CCCC|GGGG|TTTT|GATC|AAGCTT') as motif, hamming(seq,{_RC("seq")})<=3 as selfc, regexp_matches(seq,'{_DINUC}') as dinuc,
 length(regexp_replace(seq,substr(seq,1,1),'','g'))=0 as low from fx_targets),
q as (select c.*, concat_ws(';',case when gc<0.35 or gc>0.65 then 'gc_out_of_range' end,case when run>3 then 'homopolymer_too_long' end,case when dinuc then 'dinucleotide_repeat_too_long' end,case when motif then 'forbidden_motif' end,case when selfc then 'self_complementarity' end,case when low then 'low_complexity' end) as warnings from c)
select target_id, case when warnings<>'' or coalesce(am,0)+coalesce(si,0)>0 then 'fail' else 'pass' end as status, coalesce(am,0) as ambiguous_variants, coalesce(si,0) as silent_assignment_variants, round(gc,8) as gc, run as homopolymer_max, warnings from q left join n on n.source_index=q.target_index"""),
    "panel_context": (panel_context, _CTE + """, f as (select target_id, concat('GGAA',seq) as l, concat(seq,'TTCA') as r, concat('GGAA',seq,'TTCA') as w from fx_targets),
g as (select target_id, w, (select max(length(x)) from unnest(regexp_extract_all(w,'A+|C+|G+|T+')) u(x)) as m, (select max(length(x)) from unnest(regexp_extract_all(l,'A+|C+|G+|T+')) u(x)) as ml, (select max(length(x)) from unnest(regexp_extract_all(r,'A+|C+|G+|T+')) u(x)) as mr, l, r from f),
j as (select target_id, w as flanked_sequence, m as cross_boundary_homopolymer, array_to_string(list_sort(list_filter(list_concat([case when ml>3 then 'left_flank_homopolymer' end, case when mr>3 then 'right_flank_homopolymer' end], list_concat(list_transform(['AAAA','CCCC','GGGG','TTTT','GATC','AAGCTT'], lambda x: case when contains(l,x) then concat('left_flank_forbidden_motif:',x) end), list_transform(['AAAA','CCCC','GGGG','TTTT','GATC','AAGCTT'], lambda x: case when contains(r,x) then concat('right_flank_forbidden_motif:',x) end))), lambda x: x is not null)),';') as risks from g)
select *, case when risks='' then 'pass' else 'warn' end as status from j"""),
    "panel_overlaps": (panel_overlaps, _CTE + """, p as (select target_index, target_id, seq from fx_targets union all select target_index+1000000000, concat('C',target_id), substr(seq,1,11) from fx_targets)
select a.target_id as barcode_id, b.target_id as other_id, cast(least(length(a.seq),length(b.seq)) as int) as overlap_length from p a join p b on a.target_index<b.target_index and (starts_with(a.seq,b.seq) or starts_with(b.seq,a.seq))"""),
    "panel_reverse": (panel_reverse, _CTE + f" select a.target_id as barcode_id, b.target_id as other_id, hamming(a.seq,{_RC('b.seq')}) as distance, case when a.seq={_RC('b.seq')} then 'exact_rc_collision' else 'near_rc_collision' end as risk from fx_targets a join fx_targets b on a.target_index<b.target_index and hamming(a.seq,{_RC('b.seq')})<=1"),
    "offset_select_multi": (offset_select_multi, _CTE + """, u as (select seq from fx_targets group by 1 having count(*)=1),
sc as (select r.sample, cast(s.p as int) as start, count(u.seq) as score, count(*) as checked from fx_reads r cross join generate_series(2,6) s(p) left join u on length(r.seq)>=s.p+12 and substr(r.seq,cast(s.p+1 as int),12)=u.seq group by 1,2)
select sample, coalesce(string_agg(cast(start as varchar),',' order by start) filter (score/checked>=0.001),cast(coalesce((select start from sc z where z.sample=sc.sample and z.score>0 order by z.score desc, abs(z.start-3), z.start limit 1),3) as varchar)) as offsets from sc group by 1"""),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
