"""The bounded similarity join: which targets lie within k edits of an observed window.

Every row gets one of four states. ``invalid``: no window could be cut. ``none``: no target
within k. ``ambiguous``: several at the smallest distance (or, by the radius policy, several
within k). ``unique``: one. Ties are never resolved; the lowest target index is reported.

The join is an equi-join on keys: strings within k edits share a string left by deleting at
most k symbols of each, and strings of equal length within one substitution share a masked
form. Only *distinct* observed windows are joined, so a read costs a lookup however often its
window occurs. Both sides are shuffled by key: Spark's size threshold knows the library's files, not
the keys made of them, so it is never asked whether to broadcast.

Two edits are counted by :mod:`near2` where window and target are as long as each other; keys are left
for the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from . import near2


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a join by key that shuffles both sides, whatever size Spark expects.

    It sizes a side by its files' bytes, which tell nothing of the rows exploded or computed from
    them: of a large library it would collect many times its threshold in the driver.
    """
    return df.hint("merge")


def _keys(s: str, k: int, metric: str):
    return S.masked_keys(s, k) if metric == "hamming" and k <= 1 else S.deletion_keys(s, k)


def hits(windows: DataFrame, targets: DataFrame, k: int, metric: str = "levenshtein", col: str = "observed", apart: bool = False) -> DataFrame:
    """(observed, target_index, target_seq, distance): all targets within k of each distinct window (``apart``: of other lengths only)."""
    if metric not in ("hamming", "levenshtein"):
        raise ValueError(f"unknown metric {metric}")
    left = windows.select(F.col(col).alias("observed")).where("observed is not null").distinct()
    right = targets.select("target_index", F.col("seq").alias("target_seq"))
    if k <= 0:
        return left.join(spread(right), left.observed == right.target_seq).withColumn("distance", F.lit(0))
    distance = (S.hamming_within if metric == "hamming" else S.levenshtein_within)("observed", "target_seq", k)
    # Keys travel as 64-bit hashes; what shares one is compared as text anyway.
    keyed = lambda df, c: df.withColumn("key", F.explode(_keys(c, k, metric))).withColumn("key", F.xxhash64("key"))
    pairs = keyed(left, "observed").join(spread(keyed(right, "target_seq")), "key")
    pairs = pairs.where(F.length("observed") != F.length("target_seq")) if apart else pairs
    return pairs.withColumn("distance", distance).where("distance is not null").groupBy("observed", "target_index").agg(F.min("distance").alias("distance"))


#: Distances and target indexes are compared as one number; indexes must be under 2 to this.
_BITS = 48


def _merged(found: DataFrame, by: list[str], k: int, *more) -> DataFrame:
    """One row per ``by`` from its hits, by sums and minima only, which combine before the shuffle.

    Rows without a target (null) make a row of their own, but count as no hit.
    """
    near = F.col("target_index").isNotNull()
    return found.groupBy(*by).agg(
        F.min(F.when(near, F.shiftleft(F.col("distance").cast("long"), _BITS) + F.col("target_index"))).alias("__top"),
        *[F.count_if(near & (F.col("distance") == i)).alias(f"__n{i}") for i in range(k + 1)],
        *more,
    )


def _columns(k: int, policy: str) -> dict:
    """The result columns, from those of :func:`_merged`; null where nothing was near."""
    n = [F.col(f"__n{i}") for i in range(k + 1)]
    best = F.shiftright("__top", _BITS).cast("int")
    ties, second = F.lit(None), F.lit(None)
    for i in range(k, -1, -1):
        ties, second = F.when(best == i, n[i]).otherwise(ties), F.when((n[i] > 0) & (best < i), F.lit(i)).otherwise(second)
    count = sum(n[1:], n[0])
    many = ties > 1 if policy == "best" else count > 1
    return {
        "target_index": F.col("__top").bitwiseAND(F.lit((1 << _BITS) - 1)),
        "best_distance": best,
        "second_best_distance": F.coalesce(second, F.lit(-1)),
        "match_count": count.cast("long"),
        "num_best_targets": ties.cast("long"),
        "status": F.when(F.col("__top").isNull(), None).when(many, "ambiguous").otherwise("unique"),
    }


def finalise(found: DataFrame, by: list[str], k: int, policy: str = "best") -> DataFrame:
    """One row per ``by`` from its hits: best and second distance, counts, lowest target at best."""
    return _merged(found, by, k).select(*by, *(c.alias(name) for name, c in _columns(k, policy).items()))


def _unlike(df: DataFrame, col: str, other: DataFrame, other_col: str, k: int) -> DataFrame:
    """Rows for which ``other`` has a string of another length within ``k`` of theirs."""
    lengths = other.agg(F.collect_set(F.length(other_col)).alias("__lengths"))  # one row, a few numbers
    gap = lambda n: F.abs(n - F.length(col)).between(1, k)
    return df.crossJoin(F.broadcast(lengths)).where(F.exists("__lengths", gap)).drop("__lengths")


def _merged_k2(windows: DataFrame, targets: DataFrame, length: int | None = None) -> DataFrame:
    """What :func:`_merged` makes of :func:`hits` at k = 2, without listing the hits of equal length. Target indexes must be distinct."""
    left = windows.select("observed").where("observed is not null").distinct()
    unlike = _unlike(targets, "seq", left, "observed", 2) if length is None else targets.where(F.abs(F.length("seq") - length).between(1, 2))
    found = hits(_unlike(left, "observed", targets, "seq", 2), unlike, 2, apart=True)
    both = near2.equal_length(left, targets, _BITS).unionByName(_merged(found, ["observed"], 2))
    return both.groupBy("observed").agg(F.min("__top").alias("__top"), *[F.sum(f"__n{i}").alias(f"__n{i}") for i in range(3)])


def assign_windows(windows: DataFrame, targets: DataFrame, k: int, metric: str = "levenshtein", policy: str = "best", length: int | None = None) -> DataFrame:
    """A row per distinct window that has any target within k. ``length``: that of all windows, if known."""
    if k == 2 and metric == "levenshtein":
        return _merged_k2(windows, targets, length).select("observed", *(c.alias(name) for name, c in _columns(k, policy).items()))
    return finalise(hits(windows, targets, k, metric), ["observed"], max(0, k), policy)


_NONE = {"target_index": -1, "best_distance": -1, "second_best_distance": -1, "match_count": 0, "num_best_targets": 0}


def _filled(df: DataFrame, valid) -> DataFrame:
    for name, value in _NONE.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return df.withColumn("status", F.when(~valid, "invalid").otherwise(F.coalesce("status", F.lit("none"))))


def with_targets(cut: DataFrame, table: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with the result of their window, and its target's columns of ``names``.

    Targets are joined to distinct windows: of the rows, those without a target would meet in one task.
    """
    more = [c for c in names.columns if c != "target_index"]
    out = _filled(cut.join(table.join(spread(names), "target_index", "left"), "observed", "left"), F.col("observed").isNotNull())
    return out.select("target_index", *(c for c in out.columns if c not in ("target_index", *more)), *more)


def assign(reads: DataFrame, targets: DataFrame, k: int, metric: str = "levenshtein", policy: str = "best", start: int = 0, length: int | None = None, seq_col: str = "seq") -> DataFrame:
    """Each read with its window's result. Without ``length`` the whole sequence is the window."""
    observed = F.upper(F.col(seq_col)) if length is None else S.window(seq_col, start, length)
    cut = reads.withColumn("observed", observed)
    table = assign_windows(cut, targets, k, metric, policy, length if isinstance(length, int) else None)
    out = with_targets(cut, table, targets.select("target_index", "target_id", F.col("seq").alias("target_seq")))
    return out.withColumn("edit_kind", F.when(F.col("status") == "unique", S.edit_kind("observed", "target_seq", "best_distance")))


def windows_of(reads: DataFrame, starts: list[int], lengths: list[int], seq_col: str = "seq") -> DataFrame:
    """Reads with an array of their windows at all starts and lengths (those past the end are left out)."""
    cut = [F.struct(F.lit(i).alias("turn"), S.window(seq_col, s, n).alias("observed"), F.lit(s).alias("start")) for i, (s, n) in enumerate((s, n) for s in starts for n in lengths)]
    return reads.withColumn("windows", F.filter(F.array(*cut), lambda w: w["observed"].isNotNull()))


def assign_multi(reads: DataFrame, targets: DataFrame, k: int, starts: list[int], lengths: list[int], metric: str = "levenshtein", policy: str = "best", id_col: str = "read_id", seq_col: str = "seq", match_count: str = "distinct", with_window: bool = True) -> DataFrame:
    """Several windows of a read as one: a target counts once, at its smallest distance in any window.

    ``match_count="windowed"`` adds to the distinct reported targets each window's further
    matches, as tools that merge per-window results count them. The observed window (left out
    unless ``with_window``) is the first (start, then length) that attains the best distance, else
    the first valid one. Reads are cut once and grouped in one pass: first by target, then all.
    """
    k = max(0, k)
    cut = windows_of(reads.select(id_col, seq_col), starts, lengths, seq_col)
    # A read without window or hit keeps a row, so reads need not be joined back.
    flat = cut.select(id_col, F.explode_outer("windows").alias("w")).select(id_col, "w.turn", "w.observed")
    found = flat.join(hits(flat, targets, k, metric), "observed", "left").repartition(id_col)
    at = [F.min(F.struct(F.coalesce("distance", F.lit(k + 1)).alias("d"), "turn", "observed")).alias("__at")] if with_window else []
    each = found.groupBy(id_col, "target_index").agg(F.min("distance").alias("distance"), F.min("turn").alias("__turn"), *at)
    res = _merged(each, [id_col], k, F.min("__turn").alias("__turn"), *([F.min("__at").alias("__at")] if with_window else []))
    out = res.select(id_col, "__turn", *([F.col("__at.observed").alias("observed")] if with_window else []), *(c.alias(name) for name, c in _columns(k, policy).items()))
    if match_count == "windowed":
        per = finalise(found.where("target_index is not null"), [id_col, "turn"], k, policy)
        more = per.groupBy(id_col).agg((F.count_distinct("target_index") + F.sum(F.col("match_count") - 1)).alias("__n"))
        out = out.join(more, id_col, "left").withColumn("match_count", F.col("__n")).drop("__n")
    return _filled(out, F.col("__turn").isNotNull()).drop("__turn")


def assign_length_set(reads: DataFrame, targets: DataFrame, k: int, start: int, lengths: list[int], metric: str = "levenshtein", policy: str = "best", id_col: str = "read_id", seq_col: str = "seq", indel: int = 0) -> DataFrame:
    """One window a length, in order, folded to one result: for barcodes of several lengths.

    A nearer result replaces what was found so far; one as near with another target (or ambiguous
    itself) makes it ambiguous, with the lower target and both counts; a farther one that is the
    second best so far adds its count. With ``indel`` each length's window is itself the merge of
    the windows up to that much shorter and longer.
    """
    k = max(0, k)
    if indel:
        each = [assign_multi(reads, targets, k, [start], [m for m in range(n - indel, n + indel + 1) if m > 0], metric, policy, id_col, seq_col, with_window=False).withColumn("turn", F.lit(i)) for i, n in enumerate(lengths)]
        flat = each[0]
        for x in each[1:]:
            flat = flat.unionByName(x)
    else:
        cut = reads.select(id_col, F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), S.window(seq_col, start, n).alias("observed")) for i, n in enumerate(lengths)])).alias("w")).select(id_col, "w.turn", "w.observed")
        flat = _filled(cut.join(assign_windows(cut, targets, k, metric, policy), "observed", "left"), F.col("observed").isNotNull())
    names = ["target_index", "best_distance", "second_best_distance", "match_count", "status"]
    kinds = dict(flat.dtypes)
    rows = flat.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("turn", *names))).alias("rows"))  # one a length
    none = F.struct(*[F.lit(v).cast(kinds[n]).alias(n) for n, v in zip(names, (-1, -1, -1, 0, "invalid"), strict=True)])

    def fold(b, r):
        plain = F.struct(*[r[n].alias(n) for n in names])
        first = (b["match_count"] == 0) | (r["best_distance"] < b["best_distance"])
        other = (r["target_index"] != b["target_index"]) | (r["status"] == "ambiguous") | (b["status"] == "ambiguous")
        tie = F.struct(F.least(b["target_index"], r["target_index"]).alias("target_index"), b["best_distance"].alias("best_distance"), b["second_best_distance"].alias("second_best_distance"), (b["match_count"] + r["match_count"]).alias("match_count"), F.lit("ambiguous").alias("status"))
        second = (b["second_best_distance"] < 0) | (r["best_distance"] < b["second_best_distance"])
        far = F.struct(b["target_index"].alias("target_index"), b["best_distance"].alias("best_distance"), r["best_distance"].alias("second_best_distance"), (b["match_count"] + r["match_count"]).alias("match_count"), b["status"].alias("status"))
        return (
            F.when(r["status"] == "invalid", b)
            .when(r["match_count"] == 0, F.when(b["status"] == "invalid", plain).otherwise(b))
            .when(first, plain)
            .when(r["best_distance"] == b["best_distance"], F.when(other, tie).otherwise(b))
            .otherwise(F.when(second, far).otherwise(b))
        )

    return rows.select(id_col, F.aggregate("rows", none, fold).alias("r")).select(id_col, *[F.col(f"r.{n}").alias(n) for n in names])


def validate(reads: DataFrame, targets: DataFrame, k: int, start: int, length: int, metric: str = "levenshtein", policy: str = "best") -> DataFrame:
    """One row: distinct windows of the reads, and how many of them the join and the scan of all targets
    settle differently in any of target, distances, count and status (none should). For samples of reads."""
    names = ["target_index", "best_distance", "second_best_distance", "match_count", "status"]
    cut = reads.select(S.window("seq", start, length).alias("observed")).where("observed is not null").distinct()
    fast = assign_windows(cut, targets, k, metric, policy).select("observed", F.struct(*names).alias("fast"))
    scan = assign_exhaustive(cut, targets, k, metric, policy).select("observed", F.struct(*names).alias("scan"))
    both = cut.join(fast, "observed", "left").join(scan, "observed", "left")
    return both.agg(F.count("*").alias("windows"), F.count("fast").alias("matched"), F.count_if(~F.col("fast").eqNullSafe(F.col("scan"))).alias("mismatches"))


def assign_exhaustive(reads: DataFrame, targets: DataFrame, k: int, metric: str = "levenshtein", policy: str = "best") -> DataFrame:
    """The same by comparing every window with every target: for checks on small inputs only."""
    left = reads.select(F.col("observed")).where("observed is not null").distinct()
    right = targets.select("target_index", F.col("seq").alias("target_seq"))
    d = (S.hamming_within if metric == "hamming" else S.levenshtein_within)("observed", "target_seq", k)
    return finalise(left.crossJoin(right).withColumn("distance", d).where("distance is not null"), ["observed"], k, policy)


def nearest(windows: DataFrame, targets: DataFrame, col: str = "observed") -> DataFrame:
    """The nearest target of each window whatever the distance, lowest index on ties.

    Windows must be few (a top-n report): each is compared with every target.
    """
    right = targets.select("target_index", "target_id", F.col("seq").alias("__t"))
    pairs = windows.select(F.col(col)).distinct().crossJoin(right).withColumn("d", F.levenshtein(col, "__t"))
    top = pairs.groupBy(col).agg(F.min(F.struct("d", "target_index", "target_id")).alias("t"))
    return top.select(col, F.col("t.target_index").alias("nearest_index"), F.col("t.target_id").alias("nearest_id"), F.col("t.d").alias("nearest_distance"))


def quality_gate(assigned: DataFrame, threshold: int, qual: str = "window_qual") -> DataFrame:
    """Unique rescues whose edited bases are of good quality become ``none`` (``quality_rejected``)."""
    rescue = (F.col("status") == "unique") & (F.col("best_distance") > 0)
    reject = rescue & ~S.rescue_allowed("observed", qual, "target_seq", threshold)
    out = assigned.withColumn("quality_rejected", F.coalesce(reject, F.lit(False)))
    for name, value in _NONE.items():
        out = out.withColumn(name, F.when(F.col("quality_rejected"), F.lit(value)).otherwise(F.col(name)))
    return out.withColumn("status", F.when(F.col("quality_rejected"), "none").otherwise(F.col("status")))


def assign_panel(queries: DataFrame, targets: DataFrame, k: int, metric: str = "levenshtein") -> DataFrame:
    """The panels' contract: sequences with other than ACGT are invalid, an ambiguous one has target -1
    and counts its ties only."""
    res = assign_windows(queries.select(F.col("seq").alias("observed")), targets, k, metric)
    out = _filled(queries.withColumn("observed", F.col("seq")).join(res, "observed", "left"), F.col("observed").rlike("^[ACGT]+$"))
    bad = F.col("status") == "invalid"
    out = out.withColumn("match_count", F.when(bad, 0).otherwise(F.col("num_best_targets")))
    return out.withColumn("target_index", F.when(bad | (F.col("status") == "ambiguous"), -1).otherwise(F.col("target_index")))
