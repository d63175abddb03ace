"""Barcode panels: content rules, distances, certificates, design and simulation."""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from . import assign as A


#: Defaults of the rules: fixed values.
MOTIFS = ("AAAA", "CCCC", "GGGG", "TTTT", "GATC", "AAGCTT")


@dataclass(frozen=True)
class Constraints:
    gc_min: float = 0.35
    gc_max: float = 0.65
    max_homopolymer: int = 3
    max_dinucleotide_repeat: int = 4
    forbidden_motifs: tuple[str, ...] = MOTIFS
    avoid_self_complementarity: bool = True
    avoid_ambiguous_bases: bool = True
    avoid_reverse_complements: bool = True
    avoid_prefix_collisions: bool = True
    avoid_suffix_collisions: bool = True
    min_hamming: int = 5
    min_levenshtein: int = 4
    min_sequence_levenshtein: int = 4
    left_flank: str = ""
    right_flank: str = ""
    context_window: int = 0
    cycle_balance: bool = True
    cycle_min: float = 0.15
    cycle_max: float = 0.40


@dataclass
class Design:
    length: int = 16
    count: int = 96
    seed: int = 1
    pool: int = 100_000
    engine: str = "greedy"
    objective: str = "strict-demux"
    iterations: int = 1000
    constraints: Constraints = field(default_factory=Constraints)


#: Named designs (count, length, least Hamming, Levenshtein and sequence-Levenshtein distance, objective): fixed values.
PRESETS = {
    "strict-24x12": (24, 12, 5, 4, 4, "strict-demux"),
    "strict-96x16": (96, 16, 5, 4, 4, "strict-demux"),
    "strict-384x20": (384, 20, 5, 4, 4, "max-count"),
    "illumina-inline-96": (96, 10, 4, 3, 3, "strict-demux"),
    "illumina-inline-strict": (96, 16, 5, 4, 4, "strict-demux"),
    "illumina-dual-384": (384, 10, 4, 4, 4, "strict-demux"),
    "nanopore-indel-robust-24": (24, 18, 5, 5, 5, "nanopore-indel-robust"),
    "ont-rna004-signal-12": (12, 16, 5, 5, 5, "ont-signal-separable"),
    "feature-barcode-192": (192, 16, 5, 4, 4, "strict-demux"),
    "crispr-guide-tag-96": (96, 12, 5, 4, 4, "strict-demux"),
}
#: Weights of an objective (least Hamming, Levenshtein, sequence-Levenshtein distance, 5th percentile of distances, sphere
#: separation, cycle balance, plate, GC, context; then penalties: reverse complements, prefixes, motifs, low complexity): fixed values.
OBJECTIVES = {
    "strict-demux": (10, 8, 6, 4, 4, 3, 3, 2, 2, -6, -5, -4, -3),
    "max-count": (7, 5, 4, 3, 2, 2, 1, 2, 1, -4, -4, -4, -3),
    "nanopore-indel-robust": (6, 11, 10, 5, 5, 2, 1, 2, 4, -4, -6, -4, -3),
    "ont-signal-separable": (6, 8, 8, 3, 4, 2, 1, 2, 4, -6, -5, -4, -3),
}


def preset(name: str, **more) -> Design:
    count, length, h, lev, seqlev, objective = PRESETS[name]
    return Design(length=length, count=count, objective=objective, constraints=Constraints(min_hamming=h, min_levenshtein=lev, min_sequence_levenshtein=seqlev), **more)


def content(panel: DataFrame, c: Constraints, seq: str = "seq") -> DataFrame:
    """Content measures, warnings and pass/fail of each sequence."""
    s = F.col(seq)
    out = panel.select(
        "*", S.gc_fraction(s).alias("gc"), S.max_homopolymer(s).alias("homopolymer_max"), S.max_dinucleotide_repeat(s).alias("dinucleotide_repeat_max"),
        F.array_join(S.forbidden_motifs(s, list(c.forbidden_motifs)), ",").alias("forbidden_motifs"), S.self_complement_score(s).alias("self_complement_score"),
    )
    rules: list[tuple[Column, str]] = [
        (~s.rlike("^[ACGT]*$") if c.avoid_ambiguous_bases else F.lit(False), "ambiguous_base"),
        ((F.col("gc") < c.gc_min) | (F.col("gc") > c.gc_max), "gc_out_of_range"),
        (F.col("homopolymer_max") > c.max_homopolymer, "homopolymer_too_long"),
        (F.col("dinucleotide_repeat_max") > c.max_dinucleotide_repeat, "dinucleotide_repeat_too_long"),
        (F.col("forbidden_motifs") != "", "forbidden_motif"),
        (F.col("self_complement_score") >= 0.75 if c.avoid_self_complementarity else F.lit(False), "self_complementarity"),
        (F.size(F.array_distinct(S.chars(s))) <= 1, "low_complexity"),
    ]
    found = F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]), lambda x: x.isNotNull())
    return out.withColumn("warnings", F.array_join(found, ";")).withColumn("status", F.when(F.col("warnings") == "", "pass").otherwise("fail"))


def first_failure(checked: DataFrame) -> Column:
    """The first rule that a candidate breaks, or null."""
    return F.when(F.col("status") == "fail", F.element_at(F.split("warnings", ";"), 1))


def candidate_score(c: Constraints) -> Column:
    """Preference among candidates, on the columns of :func:`content`."""
    gc = 1 - F.abs(F.col("gc") - 0.5) * 2
    kinds = F.size(F.array_distinct(S.chars("seq"))) / 4
    runs = F.greatest(F.lit(0.0), 1 - (F.col("homopolymer_max") - 1) / max(1, c.max_homopolymer))
    n = F.when(F.col("warnings") == "", 0).otherwise(F.size(F.split("warnings", ";")))
    return gc * 4 + kinds * 3 + runs * 2 - n * 5


def context_risk(seq: Column | str, c: Constraints) -> Column:
    """Risks where a flank meets the sequence, sorted."""
    s = F.col(seq) if isinstance(seq, str) else seq
    found = []
    for joined, name in ((F.concat(F.lit(c.left_flank), s), "left_flank"), (F.concat(s, F.lit(c.right_flank)), "right_flank")):
        found.append(F.when(S.max_homopolymer(joined) > c.max_homopolymer, F.lit(f"{name}_homopolymer")))
        found += [F.when(joined.contains(m), F.lit(f"{name}_forbidden_motif:{m}")) for m in c.forbidden_motifs if m]
    return F.array_sort(F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())))


#: Blocks that a panel is cut into to meet itself: each task joins two of them.
BLOCKS = 16


def _meetings(panel: DataFrame) -> DataFrame:
    """Each two barcodes, the lower index first, by pairs of blocks."""
    cols = [F.col("target_index").alias("i"), F.col("target_id").alias("barcode_id"), F.col("seq").alias("sequence"), F.pmod(F.xxhash64("target_index"), F.lit(BLOCKS)).cast("int").alias("x")]
    one = panel.select(*cols).withColumn("y", F.explode(F.sequence(F.col("x"), F.lit(BLOCKS - 1))))
    two = panel.select(*cols).toDF("j", "other_id", "other_sequence", "y").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("y"))))
    met = one.join(two, ["x", "y"]).where("x < y or i < j")
    turned = F.col("i") > F.col("j")
    pick = lambda a, b, name: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(name)
    names = (("i", "j"), ("barcode_id", "other_id"), ("sequence", "other_sequence"))
    return met.select(*[pick(a, b, a) for a, b in names], *[pick(b, a, b) for a, b in names])


def _near(panel: DataFrame, k: int) -> DataFrame:
    """The pairs within k edits, and those of which one is the other's reverse complement."""
    from .audit import close_pairs

    rc = panel.select(F.col("target_index").alias("y"), S.reverse_complement("seq", other_to_n=False).alias("seq"))
    turned = panel.select(F.col("target_index").alias("x"), "seq").join(A.spread(rc), "seq").where("x <> y").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    found = close_pairs(panel, k).select("i", "j").union(turned).distinct()
    a = panel.select(F.col("target_index").alias("i"), F.col("target_id").alias("barcode_id"), F.col("seq").alias("sequence"))
    b = panel.select(F.col("target_index").alias("j"), F.col("target_id").alias("other_id"), F.col("seq").alias("other_sequence"))
    return found.join(A.spread(a), "i").join(A.spread(b), "j")


def _measured(pairs: DataFrame, c: Constraints) -> DataFrame:
    rc = S.reverse_complement("other_sequence", other_to_n=False)
    p = pairs.select(
        "*", S.panel_hamming("sequence", "other_sequence").alias("hamming_distance"), F.levenshtein("sequence", "other_sequence").alias("levenshtein_distance"),
        S.sequence_levenshtein("sequence", "other_sequence", c.left_flank, c.right_flank, c.context_window or None).alias("sequence_levenshtein_distance"),
        F.coalesce(S.hamming("sequence", rc), F.levenshtein("sequence", rc)).alias("reverse_complement_distance"),
    )
    h, d, q = F.col("hamming_distance"), F.col("levenshtein_distance"), F.col("sequence_levenshtein_distance")
    rules = [((h == 0) | (d == 0), "duplicate"), (h < c.min_hamming, "below_min_hamming"), (d < c.min_levenshtein, "below_min_levenshtein"), (q < c.min_sequence_levenshtein, "below_min_sequence_levenshtein"), (F.col("sequence") == rc, "reverse_complement_exact")]
    w = F.filter(F.array(*[F.when(cond, F.lit(n)) for cond, n in rules]), lambda x: x.isNotNull())
    p = p.withColumn("warnings", F.array_join(w, ";"))
    return p.withColumn("status", F.when(F.col("warnings").contains("duplicate"), "fail").when(F.col("warnings") != "", "warn").otherwise("pass"))


def pairwise(panel: DataFrame, c: Constraints | None = None) -> DataFrame:
    """Distances and warnings of each two barcodes: all pairs, which is what a certificate lists."""
    return _measured(_meetings(panel), c or Constraints())


def collision_pairs(panel: DataFrame, c: Constraints | None = None) -> DataFrame:
    """The pairs of :func:`pairwise` with a warning, by shared deletion keys instead of all pairs.

    For sequences of one length and no flanks; distances under the least ones asked for are edits too.
    """
    c = c or Constraints()
    return _measured(_near(panel, max(c.min_hamming, c.min_levenshtein, c.min_sequence_levenshtein, 1) - 1), c).where("status <> 'pass'")


def nearest_neighbours(pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("i").alias("x"), F.col("hamming_distance").alias("d"), F.col("j").alias("n")).union(pairs.select("j", "hamming_distance", "i"))
    g = ends.groupBy("x").agg(F.min(F.shiftleft(F.col("d").cast("long"), 48) + F.col("n")).alias("s"))
    return g.select(F.col("x").alias("target_index"), F.shiftright("s", 48).cast("int").alias("nearest_distance"), F.col("s").bitwiseAND(F.lit((1 << 48) - 1)).alias("nearest_index"))


def compatible(a: str, b: str, c: Constraints) -> Column:
    """Whether two barcodes may be in one panel."""
    rc = S.reverse_complement(b, other_to_n=False)
    ok = (S.panel_hamming(a, b) >= c.min_hamming) & (F.levenshtein(a, b) >= c.min_levenshtein)
    if c.min_sequence_levenshtein:
        ok &= S.sequence_levenshtein(a, b, c.left_flank, c.right_flank, c.context_window or None) >= c.min_sequence_levenshtein
    if c.avoid_reverse_complements:
        ok &= (F.col(a) != rc) & F.coalesce(S.hamming(a, rc) >= c.min_hamming, F.lit(True))
    if c.avoid_prefix_collisions:
        ok &= ~F.startswith(F.col(a), F.col(b)) & ~F.startswith(F.col(b), F.col(a))
    if c.avoid_suffix_collisions:
        ok &= ~F.endswith(F.col(a), F.col(b)) & ~F.endswith(F.col(b), F.col(a))
    return ok


def overlaps(panel: DataFrame, k: int, end: str = "prefix") -> DataFrame:
    """Pairs of which one is the other's prefix (suffix), or nearly so at unequal lengths."""
    shared = (S.shared_prefix if end == "prefix" else S.shared_suffix)("sequence", "other_sequence")
    within = F.startswith if end == "prefix" else F.endswith
    a, b = F.col("sequence"), F.col("other_sequence")
    p = _meetings(panel).withColumn("overlap_length", shared)
    whole = within(a, b) | within(b, a)
    near = (F.length(a) != F.length(b)) & (F.col("overlap_length") >= F.least(F.length(a), F.length(b)) - max(1, k))
    return p.where(whole | near).select("barcode_id", "sequence", "other_id", "other_sequence", "overlap_length", F.when(whole, "exact_overlap").otherwise("near_overlap").alias("risk"))


def reverse_complements(panel: DataFrame, k: int, metric: str = "hamming") -> DataFrame:
    """Pairs of which one is within k (one at least) of the other's reverse complement."""
    p = _meetings(panel).withColumn("reverse_complement", S.reverse_complement("other_sequence", other_to_n=False))
    d = S.panel_hamming("sequence", "reverse_complement") if metric == "hamming" else F.levenshtein("sequence", "reverse_complement")
    p = p.withColumn("distance", d).where(F.col("distance") <= max(k, 1))
    return p.select("barcode_id", "sequence", "other_id", "other_sequence", "reverse_complement", "distance", F.when(F.col("sequence") == F.col("reverse_complement"), "exact_rc_collision").otherwise("near_rc_collision").alias("risk"))


def context_rows(panel: DataFrame, c: Constraints) -> DataFrame:
    """Each barcode within its flanks: the longest run across the joints, and the joints' risks."""
    whole = F.concat(F.lit(c.left_flank), F.col("seq"), F.lit(c.right_flank))
    risks = context_risk("seq", c)
    return panel.select("target_id", "seq", whole.alias("flanked_sequence"), S.max_homopolymer(whole).alias("cross_boundary_homopolymer"), F.array_join(risks, ";").alias("risks"), F.when(F.size(risks) > 0, "warn").otherwise("pass").alias("status"))


def target_safety(panel: DataFrame, risk: DataFrame, c: Constraints) -> DataFrame:
    """Each barcode's content with the number of its variants at risk."""
    n = risk.groupBy("source_index").agg(F.count_if(F.col("risk") == "ambiguous").alias("ambiguous_variants"), F.count_if(F.col("risk") == "silent_assignment").alias("silent_assignment_variants"))
    out = content(panel, c).join(n.withColumnRenamed("source_index", "target_index"), "target_index", "left").fillna(0, ["ambiguous_variants", "silent_assignment_variants"])
    bad = (F.col("status") == "fail") | (F.col("ambiguous_variants") + F.col("silent_assignment_variants") > 0)
    return out.select("target_id", "seq", F.when(bad, "fail").otherwise("pass").alias("status"), "ambiguous_variants", "silent_assignment_variants", "gc", "homopolymer_max", "warnings")


def error_sphere(panel: DataFrame, k: int, metric: str = "levenshtein") -> DataFrame:
    """(target_index, variant): all distinct strings within k edits over ACGT."""
    out = panel.select("target_index", F.col("seq").alias("variant"), F.length("seq").alias("__n"))
    for _ in range(k):
        out = out.select("target_index", "__n", F.explode(S.one_edit_variants("variant")).alias("variant")).distinct()
        if metric == "hamming":
            out = out.where(F.length("variant") == F.col("__n"))
    return out.select("target_index", "variant")


def assignment_risk(panel: DataFrame, k: int, metric: str = "levenshtein") -> DataFrame:
    """Variants of a barcode that would be ambiguous, or silently given to another barcode."""
    v = error_sphere(panel, k, metric)
    res = A.assign_windows(v.select(F.col("variant").alias("observed")), panel, k, metric)
    out = A.spread(v).join(res, v.variant == res.observed).select(v.target_index.alias("source_index"), "variant", res.target_index, "best_distance", "status")
    risk = F.when(F.col("status") == "ambiguous", "ambiguous").when(F.col("target_index") != F.col("source_index"), "silent_assignment")
    return out.withColumn("risk", risk).where("risk is not null")


def cycle_balance(panel: DataFrame, c: Constraints | None = None) -> DataFrame:
    """Shares of the bases at each position, with a warning beyond the bounds or under 8 sequences."""
    c = c or Constraints()
    pos = panel.select(F.posexplode(S.chars("seq")).alias("p", "base"))
    g = pos.groupBy((F.col("p") + 1).alias("cycle")).agg(F.count("*").alias("n"), *[(F.count_if(F.col("base") == b) / F.count("*")).alias(f"{b.lower()}_fraction") for b in "ACGT"])
    fr = [F.col(f"{b}_fraction") for b in "acgt"]
    off = (F.least(*fr) < c.cycle_min) | (F.greatest(*fr) > c.cycle_max) | (F.col("n") < 8)
    score = F.greatest(F.lit(0.0), 1 - (F.greatest(*fr) - F.least(*fr)))
    return g.withColumn("status", F.when(off & F.lit(c.cycle_balance), "warn").otherwise("pass")).withColumn("score", score).orderBy("cycle")


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """(kind, value, change): sequences and ids that are shared, added or removed."""
    out = None
    for kind, col in (("sequence", "seq"), ("id", "target_id")):
        a, b = left.select(F.col(col).alias("value")), right.select(F.col(col).alias("value"))
        for change, df in (("shared", a.intersect(b)), ("added", b.subtract(a)), ("removed", a.subtract(b))):
            one = df.select(F.lit(kind).alias("kind"), "value", F.lit(change).alias("change"))
            out = one if out is None else out.union(one)
    return out


def false_assign_upper(wrong: Column, total: Column) -> Column:
    """Upper 95 % bound of the rate of wrong assignments."""
    p = wrong / F.greatest(F.lit(1), total)
    return F.least(F.lit(1.0), p + 1.96 * F.sqrt(p * (1 - p) / F.greatest(F.lit(1), total)))


def certificate(panel: DataFrame, k: int, metric: str = "hamming", c: Constraints | None = None, rc_mode: str = "warn") -> tuple[dict, dict[str, DataFrame]]:
    """(summary, tables) of a panel: its status, grade and counts, and the rows that they come from; k over 2 is refused."""
    if not 0 <= k <= 2:
        raise ValueError("certificates are made for k of 0 to 2")
    c = c or Constraints()
    t = {
        "collision_pairs": pairwise(panel, c),
        "prefix_collisions": overlaps(panel, k, "prefix"),
        "suffix_collisions": overlaps(panel, k, "suffix"),
        "reverse_complement_warnings": reverse_complements(panel, k, metric),
        "homopolymer_gc": content(panel, c),
        "cycle_balance": cycle_balance(panel, c),
        "flanked_sequences": context_rows(panel, c),
        "unsafe_assignment_variants": assignment_risk(panel, k, metric),
    }
    t["context_risk"] = t["flanked_sequences"].where(F.lit(bool(c.left_flank or c.right_flank)) | (F.col("risks") != ""))
    t["ambiguous_error_spheres"] = t["unsafe_assignment_variants"].where("risk = 'ambiguous'")
    t["target_safety"] = target_safety(panel, t["unsafe_assignment_variants"], c)
    low = t["collision_pairs"].agg(
        F.min("hamming_distance").alias("h"), F.min("levenshtein_distance").alias("l"), F.min("sequence_levenshtein_distance").alias("q"),
        F.count_if((F.col("hamming_distance") == 0) & (F.col("levenshtein_distance") == 0)).alias("dup"), F.count_if(F.col("status") != "pass").alias("bad"),
    ).first()
    body = t["homopolymer_gc"].agg(F.count("*").alias("n"), F.count_if(F.col("status") == "fail").alias("bad"), F.count_if(F.col("forbidden_motifs") != "").alias("motifs"), F.max("homopolymer_max").alias("run"), F.array_sort(F.collect_set(F.length("seq"))).alias("lengths")).first()
    size = {name: t[name].count() for name in ("prefix_collisions", "suffix_collisions", "reverse_complement_warnings", "context_risk")}
    risk = {r.risk: r["count"] for r in t["unsafe_assignment_variants"].groupBy("risk").count().collect()}
    cycles = t["cycle_balance"].agg(F.count_if(F.col("status") == "warn").alias("warn"), F.avg("score").alias("score")).first()
    least = {"hamming": low.h, "levenshtein": low.l, "sequence-levenshtein": low.q}
    rule = lambda m, r: least[m] is None or least[m] >= 2 * r + 1
    narrow = least[metric] is not None and least[metric] <= 2 * k + 1
    overlap = (size["prefix_collisions"] and c.avoid_prefix_collisions) or (size["suffix_collisions"] and c.avoid_suffix_collisions)
    if low.dup or risk or overlap or (size["reverse_complement_warnings"] and rc_mode == "fail") or body.bad:
        status = "fail"
    elif size["reverse_complement_warnings"] or cycles.warn or size["context_risk"] or narrow:
        status = "warn"
    else:
        status = "pass"
    if status == "fail":
        grade = "F" if risk or size["prefix_collisions"] or size["suffix_collisions"] else "D"
    elif not rule(metric, 1):
        grade = "C"
    elif status == "warn" or size["reverse_complement_warnings"]:
        grade = "B"
    else:
        roomy = low.h is not None and low.l is not None and low.h > c.min_hamming and low.l > c.min_levenshtein
        grade = "A+" if roomy else "A"
    unsafe = lambda m: not assignment_risk(panel, 1, m).isEmpty()
    summary = {
        "status": status, "panel_grade": grade, "n_barcodes": body.n, "lengths": body.lengths, "assignment_metric": metric, "configured_assignment_k": k,
        "safe_for_k0": low.dup == 0, "safe_for_k1_hamming": not unsafe("hamming"), "safe_for_k1_levenshtein": not unsafe("levenshtein"),
        "safe_for_k2_hamming": rule("hamming", 2), "safe_for_k2_levenshtein": rule("levenshtein", 2), "narrow_margin": narrow,
        "minimum_hamming_distance": low.h, "minimum_levenshtein_distance": low.l, "minimum_sequence_levenshtein_distance": low.q,
        "guaranteed_substitution_correction": max(0, ((low.h or 1) - 1) // 2), "guaranteed_substitution_detection": max(0, (low.h or 1) - 1),
        "ambiguous_error_spheres": risk.get("ambiguous", 0), "silent_assignment_risk": risk.get("silent_assignment", 0), "unsafe_configured_radius_variants": sum(risk.values()),
        "duplicate_pairs": low.dup, "collision_pairs": low.bad, "prefix_collisions": size["prefix_collisions"], "suffix_collisions": size["suffix_collisions"],
        "reverse_complement_warnings": size["reverse_complement_warnings"], "cycle_balance_warnings": cycles.warn, "cycle_balance_score": cycles.score or 0.0,
        "forbidden_motif_hits": body.motifs, "maximum_homopolymer": body.run or 0, "content_failures": body.bad,
    }
    return summary, t


def write_certificate(panel: DataFrame, k: int, out: str, metric: str = "hamming", c: Constraints | None = None) -> dict:
    """The certificate's summary and tables as files under ``out``: a table a folder, the summary as one row and as JSON."""
    from ..sources import sinks

    spark = panel.sparkSession
    summary, t = certificate(panel, k, metric, c)
    flat = {x: ",".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v) for x, v in summary.items()}
    t["panel_summary"] = spark.createDataFrame([tuple(flat.values())], ", ".join(f"{x} string" for x in flat))
    for name, df in t.items():
        sinks.write_tsv(df.selectExpr(*[f"cast(`{x}` as string) as `{x}`" for x in df.columns]), f"{out}/{name}")
    spark.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/panel_summary_json")
    return summary


def candidates(spark: SparkSession, d: Design) -> DataFrame:
    """A pool of distinct random sequences that pass the content rules, best scores first."""
    digit = lambda i: F.pmod(F.xxhash64("id", F.lit(d.seed), F.lit(i)), F.lit(4)).cast("int") + 1
    s = F.concat(*[F.element_at(F.array(*map(F.lit, "ACGT")), digit(i)) for i in range(d.length)])
    pool = spark.range(d.pool).select(s.alias("seq")).distinct()
    return _ranked(pool, d.constraints).where("status = 'pass'").where(F.size(context_risk("seq", d.constraints)) == 0).orderBy(F.desc("score"), "seq")


def _ranked(pool: DataFrame, c: Constraints) -> DataFrame:
    return content(pool, c).withColumn("score", candidate_score(c))


def design(spark: SparkSession, d: Design, pool: DataFrame | None = None) -> list[str]:
    """A panel of ``d.count`` barcodes from the pool (by default random candidates): an error if there are too few.

    ``greedy`` takes in order of score whatever fits all chosen so far; ``graph`` takes each time,
    of all that fit, the one that adds most by the objective; ``evolve`` starts from the greedy
    panel and replaces one barcode at a time where the objective gains. The choice is sequential by
    nature and a panel is small; candidates that clash with a choice are dropped by Spark in a pass
    for each block of choices, so the driver holds a block and the panel only.
    """
    from .lineage import cut

    if d.engine not in ("greedy", "graph", "evolve"):
        raise ValueError(f"unknown engine {d.engine}")
    c = d.constraints
    chosen: list[str] = []
    left = cut((candidates(spark, d) if pool is None else _ranked(pool, c)).select("seq", "score"))
    block = 64 if d.engine != "graph" else 256
    while len(chosen) < d.count:
        top = [r.seq for r in left.orderBy(F.desc("score"), "seq").limit(block).collect()]
        if not top:
            raise ValueError(f"could only choose {len(chosen)} compatible barcodes; {d.count} were asked for")
        new: list[str] = []
        while top and len(chosen) + len(new) < d.count:
            best = top[0] if d.engine != "graph" else max(top, key=lambda s: (_gain(s, chosen + new, c, d.objective), s))
            new.append(best)
            top = [s for s in top if s != best and _fits(s, best, c)]
        chosen += new
        taken = spark.createDataFrame([(t,) for t in new], "t string")  # a block
        clash = left.join(F.broadcast(taken), ~compatible("seq", "t", c) | (F.col("seq") == F.col("t"))).select("seq").distinct()
        left = cut(left.join(clash, "seq", "left_anti"))
    if d.engine == "evolve":
        rng = random.Random(d.seed)
        spare = [r.seq for r in left.orderBy(F.desc("score"), "seq").limit(d.iterations).collect()]
        score = objective(chosen, c, d.objective)
        for s in spare:  # what is left fits every barcode of the panel
            trial = list(chosen)
            trial[rng.randrange(len(trial))] = s
            if all(_fits(s, t, c) for t in trial if t != s) and (better := objective(trial, c, d.objective)) > score:
                chosen, score = trial, better
    return chosen


def optimize(panel: DataFrame, d: Design) -> list[str]:
    """The best sub-panel of given barcodes: of those that pass the content rules, if they are enough, else of all."""
    good = content(panel, d.constraints).where("status = 'pass'").select("seq").distinct()
    return design(panel.sparkSession, d, good if good.count() >= d.count else panel.select("seq").distinct())


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


def _hamming(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else max(len(a), len(b))


def _turned(s: str) -> str:
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def _flanked(s: str, c: Constraints) -> str:
    left, right = c.left_flank, c.right_flank
    if c.context_window:
        left, right = left[-c.context_window :], right[: c.context_window]
    return left + s + right


def _fits(a: str, b: str, c: Constraints) -> bool:
    if _hamming(a, b) < c.min_hamming or _distance(a, b) < c.min_levenshtein:
        return False
    if c.min_sequence_levenshtein and _distance(_flanked(a, c), _flanked(b, c)) < c.min_sequence_levenshtein:
        return False
    rc = _turned(b)
    if c.avoid_reverse_complements and (a == rc or (len(a) == len(rc) and _hamming(a, rc) < c.min_hamming)):
        return False
    if c.avoid_prefix_collisions and (a.startswith(b) or b.startswith(a)):
        return False
    return not (c.avoid_suffix_collisions and (a.endswith(b) or b.endswith(a)))


def _gain(s: str, chosen: list[str], c: Constraints, name: str) -> float:
    """What a barcode adds to the chosen ones: its least distances to them, by the objective's weights."""
    if not chosen:
        return 0.0
    w = OBJECTIVES[name]
    least = [min(d(s, t) for t in chosen) for d in (_hamming, _distance, lambda x, y: _distance(_flanked(x, c), _flanked(y, c)))]
    return sum(x * y for x, y in zip(w, least, strict=False)) + w[9] * sum(s == _turned(t) for t in chosen) + w[10] * sum(s.startswith(t) or t.startswith(s) for t in chosen)


def objective(panel: list[str], c: Constraints, name: str = "strict-demux") -> float:
    """How good a panel is: weighted distances, balance and penalties."""
    if not panel:
        return 0.0
    w = OBJECTIVES[name]
    pairs = [(a, b) for i, a in enumerate(panel) for b in panel[:i]]
    ham = sorted(_hamming(a, b) for a, b in pairs) or [len(panel[0])]
    lev = min((_distance(a, b) for a, b in pairs), default=len(panel[0]))
    seq = min((_distance(_flanked(a, c), _flanked(b, c)) for a, b in pairs), default=len(panel[0]))
    fifth = ham[min(len(ham) - 1, max(0, math.ceil(0.05 * len(ham)) - 1))]
    spread = []
    for at in range(max(map(len, panel))):
        column = [s[at] for s in panel if at < len(s)]
        share = [column.count(x) / len(column) for x in "ACGT"]
        spread.append(max(0.0, 1 - (max(share) - min(share))))
    gc = sum((s.count("G") + s.count("C")) / len(s) for s in panel) / len(panel)
    joints = [j for s in panel for j in (c.left_flank + s, s + c.right_flank)]
    risky = any(m in j for j in joints for m in c.forbidden_motifs if m) or any(x * (c.max_homopolymer + 1) in j for j in joints for x in "ACGTN")
    parts = (
        ham[0], lev, seq, fifth, max(0, ham[0] - 2), sum(spread) / len(spread), 1.0, 1 - min(1.0, abs(gc - 0.5) * 2), 0.0 if risky else 1.0,
        sum(a == _turned(b) for a, b in pairs), sum(a.startswith(b) or b.startswith(a) for a, b in pairs), sum(m in s for s in panel for m in c.forbidden_motifs if m), sum(len(set(s)) <= 2 for s in panel),
    )
    return float(sum(x * y for x, y in zip(w, parts, strict=True)))


#: Barcodes of a panel that can be simulated: what is broadcast is under this many short rows.
MAX_SIMULATED = 100_000


def simulate(panel: DataFrame, reads: int, sub_rate: float, ins_rate: float, del_rate: float, k: int, metric: str = "levenshtein", seed: int = 1) -> DataFrame:
    """Mutated reads of known barcodes, assigned again: (read_id, true_index, observed, status, target_index)."""
    known = [tuple(r) for r in panel.select("target_index", "seq").orderBy("target_index").limit(MAX_SIMULATED + 1).collect()]
    if not 0 < len(known) <= MAX_SIMULATED:
        raise ValueError(f"a panel of 1 to {MAX_SIMULATED} barcodes can be simulated")
    n = len(known)
    u = lambda tag, i: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(tag), i), F.lit(1 << 30)) / float(1 << 30))
    base = lambda tag, i: F.element_at(F.array(*map(F.lit, "ACGT")), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(tag), i), F.lit(4)).cast("int") + 1)
    ranked = panel.sparkSession.createDataFrame([(i, t, s) for i, (t, s) in enumerate(known)], "slot long, target_index long, seq string")
    src = panel.sparkSession.range(reads).withColumn("slot", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n)))).join(F.broadcast(ranked), "slot")
    mutated = F.transform(
        S.chars("seq"),
        lambda ch, i: F.concat(
            F.when(u("i", i) < ins_rate, base("ib", i)).otherwise(""),
            F.when(u("d", i) < del_rate, "").when(u("s", i) < sub_rate, base("sb", i)).otherwise(ch),
        ),
    )
    out = src.select(F.col("id").alias("read_id"), F.col("target_index").alias("true_index"), F.array_join(mutated, "").alias("seq"))
    res = A.assign(out.withColumnRenamed("seq", "__s").withColumn("seq", F.col("__s")).drop("__s"), panel, k, metric)
    return res.select("read_id", "true_index", "observed", "status", "target_index")


def examples(simulated: DataFrame, status: str, n: int = 100) -> DataFrame:
    """The first n simulated reads of a status, by read."""
    return simulated.where(F.col("status") == status).orderBy("read_id").limit(n)


def confusable_signals(signals: DataFrame, n: int = 20) -> DataFrame:
    """The n closest pairs of (target_id, signal array<double>), closest first; ties by ids."""
    met = _meetings(signals.select("target_index", "target_id", F.col("signal").alias("seq")))
    d = signal_distance(F.col("sequence"), F.col("other_sequence"))
    return met.select("barcode_id", "other_id", d.alias("signal_distance")).orderBy("signal_distance", "barcode_id", "other_id").limit(n)


def simulation_summary(simulated: DataFrame) -> DataFrame:
    """One row: reads by status, wrong assignments, their rate and its upper bound."""
    st = F.col("status")
    wrong = (st == "unique") & (F.col("target_index") != F.col("true_index"))
    out = simulated.agg(F.count("*").alias("total_reads"), *[F.count_if(st == x).alias(x) for x in ("unique", "ambiguous", "none", "invalid")], F.count_if(wrong).alias("false_assignment"))
    return out.withColumn("false_assignment_rate", F.col("false_assignment") / F.col("total_reads")).withColumn("false_assignment_upper_bound", false_assign_upper(F.col("false_assignment"), F.col("total_reads")))


def confusion(simulated: DataFrame) -> DataFrame:
    """(true_index, assigned_index, n): -1 is not assigned."""
    got = F.when(F.col("status") == "unique", F.col("target_index")).otherwise(F.lit(-1))
    return simulated.groupBy("true_index", got.alias("assigned_index")).agg(F.count("*").alias("n"))


def recall_precision(conf: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("true_index") == F.col("assigned_index"), F.col("n")).otherwise(0))
    r = conf.groupBy("true_index").agg((hit / F.sum("n")).alias("recall"), F.sum("n").alias("reads")).withColumnRenamed("true_index", "target_index")
    p = conf.where("assigned_index >= 0").groupBy("assigned_index").agg((hit / F.sum("n")).alias("precision")).withColumnRenamed("assigned_index", "target_index")
    return r.join(p, "target_index", "left")


#: Rows and columns of a plate: fixed values.
PLATES = {24: (4, 6), 96: (8, 12), 384: (16, 24)}


def layout(ids: list[str], seqs: list[str], wells: int = 96) -> list[tuple[str, str, str]]:
    """(well, id, sequence) row by row: each next barcode is the one farthest from all placed so far.

    More barcodes than wells are an error.
    """
    rows, cols = PLATES.get(wells, PLATES[96])
    if len(ids) > rows * cols:
        raise ValueError(f"{len(ids)} barcodes do not fit into {rows * cols} wells")
    rest = list(zip(ids, seqs, strict=True))
    out = rest if len(rest) <= 2 else [rest.pop(0)]
    near = [_hamming(x[1], out[0][1]) for x in rest] if len(ids) > 2 else []
    while near:
        i = max(range(len(rest)), key=lambda j: (near[j], -j))
        out.append(rest.pop(i))
        near.pop(i)
        near = [min(d, _hamming(x[1], out[-1][1])) for d, x in zip(near, rest, strict=True)]
    return [(f"{chr(65 + n // cols)}{n % cols + 1}", *x) for n, x in enumerate(out)]


def plate_neighbours(placed: list[tuple[str, str, str]]) -> list[tuple[str, str, str, str, int]]:
    """(well, neighbour's well, id, neighbour's id, Hamming distance) to the right of and below each well."""
    at = {(ord(w[0]), int(w[1:])): (w, i, s) for w, i, s in placed}
    found = [(at[r, n], at.get(to)) for r, n in at for to in ((r, n + 1), (r + 1, n))]
    return [(x[0], y[0], x[1], y[1], _hamming(x[2], y[2])) for x, y in found if y]


def dual(ids: list[str], count: int, unique: bool = True) -> list[tuple[str, str]]:
    """Index pairs: a pairing without reuse (an error if there are too few), or all combinations in order."""
    if unique:
        if count > len(ids) // 2:
            raise ValueError("unique dual indexes need two barcodes a sample")
        return [(ids[2 * i], ids[2 * i + 1]) for i in range(count)]
    return [(a, b) for a in ids for b in ids][:count]


def nearest_rank(values: Column, p: float) -> Column:
    """Nearest-rank percentile of an array: the ceil(p * n)-th smallest value."""
    s = F.array_sort(values)
    return F.element_at(s, F.greatest(F.lit(1), F.ceil(F.lit(p) * F.size(s))).cast("int"))


def signal_distance(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two arrays, as far as the shorter goes."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x)
