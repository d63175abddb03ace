"""Audit of a target library: near pairs, safety, collision clusters, ambiguous variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from .assign import spread
from .lineage import cut


def close_pairs(targets: DataFrame, k: int) -> DataFrame:
    """(i, j, distance) of targets with i < j within k edits, by shared deletion keys.

    Equal sequences are joined once: keys are made for distinct sequences, ids added afterwards.
    """
    d = targets.select("seq").distinct()
    keyed = d.withColumn("key", F.explode(S.deletion_keys("seq", k)))
    other = keyed.select(F.col("seq").alias("seq_b"), "key")
    dist = S.levenshtein_within("seq", "seq_b", k)
    near = keyed.join(spread(other), "key").where((F.col("seq") <= F.col("seq_b")) & dist.isNotNull()).select("seq", "seq_b").distinct().withColumn("distance", dist)
    a = targets.select(F.col("target_index").alias("x"), "seq")
    b = targets.select(F.col("target_index").alias("y"), F.col("seq").alias("seq_b"))
    both = near.join(spread(a), "seq").join(spread(b), "seq_b")
    same = F.col("seq") == F.col("seq_b")
    return both.where((same & (F.col("x") < F.col("y"))) | ~same).select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "distance")


def all_pairs(targets: DataFrame, k: int) -> DataFrame:
    """The pairs an audit lists: within two edits, or within 2k."""
    return close_pairs(targets, max(2, 2 * k))


#: Edits that pairs must have been searched to before one (two) edits can be called safe: fixed values.
SAFE = {"safe_at_k1": 2, "safe_at_k2": 4}


def safety(targets: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """Each target's nearest neighbour, and whether one or two edits are safe.

    ``pairs`` are all pairs within ``within`` edits. A target none of whose neighbours is that near
    has a null distance, and what the pairs cannot tell is ``not_computed``: two edits are judged
    from pairs within four (or any pair that is nearer).
    """
    ends = pairs.select(F.col("i").alias("target_index"), F.struct("distance", F.col("j").alias("n")).alias("s")).union(pairs.select("j", F.struct("distance", F.col("i").alias("n"))))
    near = ends.groupBy("target_index").agg(F.min("s").alias("s"), F.count_if(F.col("s.distance") <= 2).alias("near")).select("target_index", F.col("s.distance").alias("nearest_distance"), F.col("s.n").alias("nearest_index"), "near")
    out = targets.select("target_index", "target_id").join(near, "target_index", "left")
    d = F.col("nearest_distance")
    for name, reach in SAFE.items():
        out = out.withColumn(name, F.when(d <= reach, "no").otherwise("yes" if within >= reach else "not_computed"))
    return out.withColumn("num_nearby_k1_risk_targets", F.coalesce("near", F.lit(0)).cast("long")).drop("near")


def nearest_pairs(targets: DataFrame) -> DataFrame:
    """(target_index, nearest_distance, nearest_index) at whatever distance: the pairs within four edits
    settle nearly all targets of a dense library; each other one is held against the whole library
    with its distance bounded by the length, so this is for audits that ask for it.
    """
    near = safety(targets, close_pairs(targets, 4), 4)
    done = near.where("nearest_distance is not null").select("target_index", "nearest_distance", "nearest_index")
    far = targets.join(done, "target_index", "left_anti").select(F.col("target_index").alias("x"), F.col("seq").alias("a"))
    pairs = far.join(targets.select(F.col("target_index").alias("y"), F.col("seq").alias("b")), F.col("x") != F.col("y"))
    rest = pairs.select("x", F.struct(F.levenshtein("a", "b").alias("distance"), F.col("y").alias("n")).alias("s")).groupBy("x").agg(F.min("s").alias("s"))
    return done.union(rest.select("x", "s.distance", "s.n"))


def clusters(pairs: DataFrame, within: int = 2) -> DataFrame:
    """(target_index, cluster): components of pairs within the distance; a cluster's id is its least index.

    Least-label propagation with pointer jumping until no label moves. Each round is written to the
    checkpoint folder, so that neither plan nor lineage grows.
    """
    p = pairs.where(F.col("distance") <= within)
    edges = cut(p.select(F.col("i").alias("u"), F.col("j").alias("v")).union(p.select("j", "i")).distinct())
    state = cut(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("t"), F.least("u", "m").alias("next"), F.lit(True).alias("moved")))
    while not state.where("moved").isEmpty():
        labels = state.select("t", F.col("next").alias("c"))
        near = edges.join(labels.select(F.col("t").alias("v"), F.col("c").alias("n")), "v").groupBy("u").agg(F.min("n").alias("n"))
        hop = labels.join(near, labels.t == near.u).select("t", "c", F.least("c", "n").alias("b"))
        far = labels.select(F.col("t").alias("b"), F.col("c").alias("f"))
        state = cut(hop.join(far, "b").select("t", F.least("b", "f").alias("next"), (F.least("b", "f") != F.col("c")).alias("moved")))
    return state.select(F.col("t").alias("target_index"), F.col("next").alias("cluster"))


def ambiguous_variants(targets: DataFrame, k: int = 1) -> DataFrame:
    """Strings within one edit of a target (over ACGT) that are within one edit of several targets."""
    v = targets.select("target_index", F.explode(S.one_edit_variants("seq")).alias("variant"))
    return v.groupBy("variant").agg(F.count_distinct("target_index").alias("targets"), F.min("target_index").alias("first_index")).where("targets > 1")


def audit_summary(targets: DataFrame, pairs: DataFrame, variants: DataFrame, k: int) -> DataFrame:
    t = targets.agg(F.count("*").alias("targets"), F.count_distinct("seq").alias("unique_sequences"))
    p = pairs.agg(F.count_if(F.col("distance") == 0).alias("duplicate_pairs"), F.count_if(F.col("distance") <= 2).alias("risk_pairs"), F.min("distance").alias("min_distance"))
    out = t.crossJoin(p).crossJoin(variants.agg(F.count("*").alias("ambiguous_variants")))
    good = (F.col("duplicate_pairs") == 0) & (F.lit(k == 0) | (F.col("risk_pairs") == 0))
    return out.withColumn("recommended_k", F.when(good, k).otherwise(0)).withColumn("safe_at_k1", F.when(F.col("risk_pairs") == 0, "yes").otherwise("no"))
