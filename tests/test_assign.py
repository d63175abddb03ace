"""Golden micro-cases and properties of the similarity join."""

import random
from itertools import product

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagwright import queries
from tagwright.functions import seq as S
from tagwright.operators import assign as A
from tagwright.operators import audit, counting, inspect, near2, offsets, panel
from tagwright.sources import tables

LIB = ("ACGT", "AGGT", "ACGA", "TTTT")


def lib(spark, seqs=LIB):
    return tables.targets_from(spark, [(i, f"bc{i}", s, f"g{i % 2}") for i, s in enumerate(seqs)])


def reads(spark, seqs):
    return spark.createDataFrame([(i, "S0", s, "I" * len(s), i) for i, s in enumerate(seqs)], "read_id long, sample string, seq string, qual string, ordinal long")


def one(df):
    r = df.first()
    return r.target_index, r.best_distance, r.second_best_distance, r.match_count, r.status


@pytest.mark.parametrize(
    ("k", "read", "expect"),
    [
        (1, "ACGT", (0, 0, 1, 3, "unique")),
        (1, "TTTG", (3, 1, -1, 1, "unique")),
        (1, "GGGG", (-1, -1, -1, 0, "none")),
        (1, "ACG", (-1, -1, -1, 0, "invalid")),
        (0, "ACGT", (0, 0, -1, 1, "unique")),
        (1, "acgt", (0, 0, 1, 3, "unique")),
    ],
)
def test_library_a(spark, k, read, expect):
    assert one(A.assign(reads(spark, [read]), lib(spark), k, start=0, length=4)) == expect


def test_policies_and_metrics(spark):
    assert one(A.assign(reads(spark, ["AGGA"]), lib(spark), 1, "hamming", start=0, length=4)) == (1, 1, -1, 2, "ambiguous")
    assert one(A.assign(reads(spark, ["ACGT"]), lib(spark), 1, policy="radius", start=0, length=4)) == (0, 0, 1, 3, "ambiguous")
    assert one(A.assign(reads(spark, ["ACNT"]), lib(spark, ("ACGT", "ACCT", "TTTT", "CCCC")), 1, "hamming", start=0, length=4)) == (0, 1, -1, 2, "ambiguous")
    two = lib(spark, ("ACGT", "TGCA"))
    assert one(A.assign(reads(spark, ["ACNGT"]), two, 1))[:2] == (0, 1)
    assert one(A.assign(reads(spark, ["ANNGT"]), two, 1))[4] == "none"
    assert one(A.assign(reads(spark, ["ACGT"]), lib(spark, ("ACGT", "ACGA", "TACGT", "CGT", "AGCT", "ATGC")), 1))[3] == 4
    r = A.assign(reads(spark, ["AATT"]), lib(spark, ("ACGT",)), 2, start=0, length=4).first()
    assert (r.best_distance, r.status, r.edit_kind) == (2, "unique", "other")
    r = A.assign(reads(spark, ["ACGT"]), lib(spark, ("ACGT", "ACGT", "AGGT")), 0, start=0, length=4).first()
    assert (r.status, r.num_best_targets, r.target_index) == ("ambiguous", 2, 0)
    with pytest.raises(ValueError):
        A.hits(reads(spark, ["A"]).withColumnRenamed("seq", "observed"), lib(spark), 1, "cosine")


@pytest.mark.parametrize("k", [0, 1, 2])
@pytest.mark.parametrize("metric", ["levenshtein", "hamming"])
def test_key_join_equals_exhaustive(spark, k, metric):
    rng = random.Random(k)
    rnd = lambda: "".join(rng.choice("ACGTN") for _ in range(rng.randint(3, 8)))
    seqs, rows = [rnd() for _ in range(60)], [rnd() for _ in range(120)]
    w = spark.createDataFrame([(s,) for s in rows], "observed string")
    t = lib(spark, seqs)
    a = A.assign_windows(w, t, k, metric)
    b = A.assign_exhaustive(w, t, k, metric)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_multi_window(spark):
    t = lib(spark, ("ACGT", "GGGG"))
    got = A.assign_multi(reads(spark, ["ACGTACGT", "ACGTGGGG", "AAAA", "AC"]), t, 1, [0, 4], [4]).orderBy("read_id").collect()
    assert [r.status for r in got] == ["unique", "ambiguous", "none", "invalid"]
    assert one(A.assign_multi(reads(spark, ["ACG"]), lib(spark, ("ACGT",)), 1, [0], [3, 4, 5]))[:2] == (0, 1)
    r = A.assign_multi(reads(spark, ["ACGTTTTTT"]), lib(spark, ("ACGT", "ACGT")), 0, [0], [4], match_count="windowed").first()
    assert r.match_count == 2


def test_quality_gate(spark):
    rows = spark.createDataFrame([(0, "ACGC", "III!"), (1, "ACGC", "IIII")], "read_id long, seq string, window_qual string")
    got = A.quality_gate(A.assign(rows, lib(spark, ("ACGT",)), 1, start=0, length=4), 20).orderBy("read_id").collect()
    assert [(r.status, r.quality_rejected) for r in got] == [("unique", False), ("none", True)]


def test_functions(spark):
    df = spark.createDataFrame([("AACCCGT", "AACNCGT")], "a string, b string")
    r = df.select(
        S.reverse_complement("b").alias("rc"), S.reverse_complement("b", False).alias("rp"), S.max_homopolymer("a").alias("h"), S.max_dinucleotide_repeat(F.lit("ACACACT")).alias("d"),
        S.hamming("a", "b").alias("ham"), S.panel_hamming(F.lit("AC"), F.lit("ACGT")).alias("ph"), S.shared_prefix("a", "b").alias("p"), S.shared_suffix("a", "b").alias("s"),
        S.hamming_2bit(S.encode_2bit(F.lit("ACGT")), S.encode_2bit(F.lit("AGGA"))).alias("h2"), S.self_complement_score(F.lit("ACGT")).alias("sc"), S.one_delete_match(F.lit("ACGT"), F.lit("AGT")).alias("od"),
        S.escape_html(F.lit('<a&"b">')).alias("e"), S.levenshtein_within(F.lit("A"), F.lit("C"), -1).alias("neg"),
    ).first()
    assert (r.rc, r.rp, r.h, r.d, r.ham, r.ph, r.p, r.s, r.h2, r.sc, r.od) == ("ACGNGTT", "ACGNGTT", 3, 3, 1, 4, 3, 3, 2, 1.0, True)
    assert r.e == "&lt;a&amp;&quot;b&quot;&gt;" and r.neg is None


def test_audit(spark):
    t = lib(spark)
    pairs = audit.all_pairs(t, 1)
    variants = audit.ambiguous_variants(t)
    s = audit.audit_summary(t, pairs, variants, 1).first()
    assert (s.risk_pairs, s.ambiguous_variants, s.safe_at_k1, s.recommended_k) == (3, 14, "no", 0)
    assert {r.target_index: r.cluster for r in audit.clusters(pairs).collect()} == {0: 0, 1: 0, 2: 0}


def test_unmatched(spark):
    r = inspect.inspect_unmatched(reads(spark, ["GGGG", "GGGG", "AC"]), lib(spark), 0, 4, 1).orderBy(F.desc("count")).first()
    assert (r.sequence, r["count"], r.nearest_target, r.nearest_distance, r.possible_reason) == ("GGGG", 2, "bc1", 2, "near_known_target_above_k")
    assert (r.reverse_complement, r.revcomp_nearest_target, r.revcomp_nearest_distance) == ("CCCC", "bc0", 3)


def test_offsets(spark):
    sc = offsets.score_offsets(reads(spark, ["NNACGT", "NNTTTT"]), lib(spark), 1, 2, 4)
    assert offsets.select_offsets(sc, 1).first().offsets == [2]
    assert offsets.parse_starts("1:3") == [1, 2, 3] and offsets.parse_starts("4,2") == [4, 2]
    best = offsets.infer_windows(reads(spark, ["NNACGT", "NNTTTT"]), lib(spark), [0, 1, 2], k=0).first()
    assert (best.start, best.score) == (2, 1.0)


def test_counts(spark):
    t = lib(spark)
    got = counting.assigned_counts(counting.window_counts(reads(spark, ["ACGT", "ACGT", "TTTG", "GGGG", "A"]), 0, 4), t, 1)
    long = counting.count_long(got, t, spark.createDataFrame([("S0",)], "sample string"))
    assert {r.target_id: r["count"] for r in long.collect()} == {"bc0": 2, "bc1": 0, "bc2": 0, "bc3": 1}
    q = counting.sample_qc(got, long).first()
    assert (q.total_reads, q.valid_extracted_reads, q.assigned_reads, q.exact_reads, q.k1_sub_reads, q.no_match_reads, q.invalid_reads) == (5, 4, 3, 2, 1, 1, 1)
    assert counting.run_summary(got, long).first().top_target == "bc0"
    gini = counting.inequality(spark.createDataFrame([("a", 0), ("a", 0), ("a", 9)], "sample string, count long")).first().gini_index
    assert abs(gini - 2 / 3) < 1e-9


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_safety_knows_its_reach(spark):
    t = lib(spark, ("AAAAAAAA", "CCCAAAAA", "GGGGGGGG"))
    near = {r.target_index: (r.nearest_distance, r.safe_at_k1, r.safe_at_k2) for r in audit.safety(t, audit.all_pairs(t, 1), 2).collect()}
    assert near[0] == near[1] == (None, "yes", "not_computed")
    far = {r.target_index: (r.nearest_distance, r.safe_at_k1, r.safe_at_k2) for r in audit.safety(t, audit.all_pairs(t, 2), 4).collect()}
    assert far == {0: (3, "yes", "no"), 1: (3, "yes", "no"), 2: (None, "yes", "yes")}
    chain = lib(spark, tuple("A" * i + "C" * (40 - i) for i in range(0, 40, 2)))
    assert {r.cluster for r in audit.clusters(audit.close_pairs(chain, 2)).collect()} == {0}


def _window(targets, o, k):
    """(target, best, second, count, status) of one window by comparing it with every target."""
    if o is None:
        return -1, -1, -1, 0, "invalid"
    d = {i: e for i, t in enumerate(targets) if (e := _edits(o, t)) <= k}
    if not d:
        return -1, -1, -1, 0, "none"
    best = min(d.values())
    ties = [i for i, e in d.items() if e == best]
    return min(ties), best, min((e for e in d.values() if e > best), default=-1), len(d), "ambiguous" if len(ties) > 1 else "unique"


def test_length_set(spark):
    rng = random.Random(6)
    targets = tuple("".join(rng.choice("ACGT") for _ in range(n)) for n in (4, 4, 4, 5, 5, 6, 6) for _ in range(3))
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(3, 10))) for _ in range(120)] + [t + "ACG" for t in targets]
    lengths = sorted({len(t) for t in targets})
    got = {r.read_id: tuple(r)[1:] for r in A.assign_length_set(reads(spark, seqs), lib(spark, targets), 1, 0, lengths).collect()}
    for i, s in enumerate(seqs):
        now = (-1, -1, -1, 0, "invalid")
        for n in lengths:
            t, b, x, c, st = one_ = _window(targets, s[:n] if len(s) >= n else None, 1)
            if st == "invalid":
                continue
            if not c:
                now = one_ if now[4] == "invalid" else now
            elif not now[3] or b < now[1]:
                now = one_
            elif b == now[1]:
                if t != now[0] or "ambiguous" in (st, now[4]):
                    now = (min(t, now[0]), b, now[2], now[3] + c, "ambiguous")
            elif now[2] < 0 or b < now[2]:
                now = (now[0], now[1], b, now[3] + c, now[4])
        assert got[i] == now, (s, got[i], now)


def test_validate_and_examples(spark):
    r, t = reads(spark, ["ACGT", "ACGA", "GGGG", "ACNT", "AC"]), lib(spark)
    assert tuple(A.validate(r, t, 1, 0, 4).first()) == (4, 3, 0)


def test_panel(spark):
    p = lib(spark, ("ACGTACGT", "TGCATGCA", "GATCGATC"))
    summary, tables_ = panel.certificate(p, 1, "hamming")
    ham = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    seqs = ("ACGTACGT", "TGCATGCA", "GATCGATC")
    pairs = [(a, b) for i, a in enumerate(seqs) for b in seqs[:i]]
    # Each is its own reverse complement, so the content rules fail; no variant is at risk.
    assert (summary["status"], summary["panel_grade"], summary["content_failures"]) == ("fail", "D", 3)
    assert summary["minimum_hamming_distance"] == min(ham(*x) for x in pairs) and summary["minimum_levenshtein_distance"] == min(_edits(*x) for x in pairs)
    assert summary["safe_for_k0"] and summary["unsafe_configured_radius_variants"] == 0 and tables_["target_safety"].count() == 3
    close = panel.certificate(lib(spark, ("AACCGGTTAC", "AACCGGTTAG")), 1)[0]
    assert (close["status"], close["panel_grade"], close["minimum_hamming_distance"]) == ("fail", "F", 1) and close["ambiguous_error_spheres"] > 0
    prefix = panel.certificate(lib(spark, ("ACCTGATGCA", "ACCTGATG")), 0)[0]
    assert (prefix["panel_grade"], prefix["prefix_collisions"]) == ("F", 1)
    with pytest.raises(ValueError):
        panel.certificate(p, 3)
    rules = panel.Constraints(min_hamming=4, min_levenshtein=3, min_sequence_levenshtein=3, cycle_balance=False)
    for engine in ("greedy", "graph", "evolve"):
        got = panel.design(spark, panel.Design(length=10, count=6, pool=1500, engine=engine, iterations=20, constraints=rules))
        assert len(set(got)) == 6 and all(_edits(a, b) >= 3 and ham(a, b) >= 4 and a != panel._turned(b) for i, a in enumerate(got) for b in got[:i])
    done = panel.certificate(lib(spark, tuple(got)), 1, "hamming", rules)[0]
    assert done["status"] in ("pass", "warn") and done["panel_grade"] in ("A", "A+", "B") and done["safe_for_k1_hamming"]
    with pytest.raises(ValueError, match="could only choose"):
        panel.design(spark, panel.Design(length=6, count=500, pool=300, constraints=rules))
    assert panel.preset("illumina-inline-96").constraints.min_hamming == 4 and set(panel.optimize(lib(spark, tuple(got)), panel.Design(count=4, constraints=rules))) < set(got)
    sim = panel.simulate(p, 200, 0.02, 0.01, 0.01, 1)
    assert sim.count() == 200 and panel.recall_precision(panel.confusion(sim)).count() == 3
    s = panel.simulation_summary(sim).first()
    assert s.total_reads == 200 == s.unique + s.ambiguous + s.none + s.invalid and s.false_assignment == 0
    exact = panel.simulate(p, 50, 0.0, 0.0, 0.0, 1)
    assert panel.recall_precision(panel.confusion(exact)).where("recall < 1 or precision < 1").count() == 0
    assert panel.examples(sim, "none", 3).count() <= 3
    assert panel.dual(["a", "b", "c", "d"], 2) == [("a", "b"), ("c", "d")]
    placed = panel.layout(["a", "b", "c"], ["ACGT", "ACGA", "TTTT"], 24)
    assert [x[:2] for x in placed] == [("A1", "a"), ("A2", "c"), ("A3", "b")]
    assert panel.plate_neighbours(placed) == [("A1", "A2", "a", "c", 3), ("A2", "A3", "c", "b", 4)]
    with pytest.raises(ValueError):
        panel.layout(["x"] * 25, ["ACGT"] * 25, 24)


def test_confusable_signals(spark):
    rows = [(i, f"s{i}", [float(i), float(i * i)]) for i in range(6)]
    df = spark.createDataFrame(rows, "target_index long, target_id string, signal array<double>")
    want = sorted((abs(i - j) + abs(i * i - j * j), f"s{i}", f"s{j}") for i in range(6) for j in range(i + 1, 6))[:4]
    assert [(r.signal_distance, r.barcode_id, r.other_id) for r in panel.confusable_signals(df, 4).collect()] == want


@pytest.mark.parametrize("name", ["k0", "k1", "k2", "hamming", "assign", "assigned_counts", "ambiguous_nearby", "demux_summary", "close_pairs", "panel_near", "assignment_risk"])
def test_library_is_not_broadcast(spark, name, tmp_path):
    """A library's file is far smaller than what is joined: its keys must not go through the driver."""
    lib(spark).write.parquet(f"{tmp_path}/lib")
    reads(spark, ["ACGT", "GGGG"]).write.parquet(f"{tmp_path}/reads")
    t, r = spark.read.parquet(f"{tmp_path}/lib"), spark.read.parquet(f"{tmp_path}/reads")
    counts = counting.window_counts(r, 0, 4)
    w = r.select(F.col("seq").alias("observed"))
    made = {
        "k0": lambda: A.hits(w, t, 0), "k1": lambda: A.hits(w, t, 1), "k2": lambda: A.hits(w, t, 2), "hamming": lambda: A.hits(w, t, 1, "hamming"),
        "assign": lambda: A.assign(r, t, 1, start=0, length=4), "assigned_counts": lambda: counting.assigned_counts(counts, t, 1),
        "ambiguous_nearby": lambda: counting.ambiguous_nearby(t, 1), "demux_summary": lambda: counting.demux_summary(counting.assigned_counts(counts, t, 1), t),
        "close_pairs": lambda: audit.close_pairs(t, 1), "panel_near": lambda: panel._near(t, 1), "assignment_risk": lambda: panel.assignment_risk(t, 1),
    }[name]()
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_count_long_broadcasts_samples(spark, tmp_path):
    lib(spark).write.parquet(f"{tmp_path}/lib")
    t, r = spark.read.parquet(f"{tmp_path}/lib"), reads(spark, ["ACGT", "GGGG"])
    long = counting.count_long(counting.assigned_counts(counting.window_counts(r, 0, 4), t, 1), t, r.select("sample").distinct())
    assert "BroadcastNestedLoopJoin BuildLeft" in long._jdf.queryExecution().sparkPlan().toString()
    assert {x.target_id: x["count"] for x in long.collect()} == {"bc0": 1, "bc1": 0, "bc2": 0, "bc3": 0}


@pytest.mark.parametrize("name", ["assign_levenshtein_k1_radius", "assign_levenshtein_k2", "barcode_infer", "count_long", "count_wide", "crispr_review", "demux_summary", "length_set", "matrix_metrics", "matrix_pearson", "matrix_spearman", "pair_counts", "pair_stats", "qc_review", "quality_gate"])
def test_no_library_is_broadcast_for_its_files_size(spark, name):
    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def _words(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(10))) for _ in range(n)]


@pytest.mark.parametrize("alphabet", ["AC", "ACGTN", "Aé𝄞"])
def test_two_edits_against_the_scan(spark, alphabet):
    """Windows and targets of lengths 0 to 9, as long as each other and not."""
    t, w = lib(spark, _words(alphabet, 120, 1)), spark.createDataFrame([(s,) for s in [*_words(alphabet, 100, 2), None]], "observed string")
    scan = sorted(map(tuple, A.assign_exhaustive(w, t, 2).collect()))
    assert sorted(map(tuple, A.assign_windows(w, t, 2).collect())) == scan


def _met(windows, targets):
    """Counts by distance of each window's targets of its length, without Spark."""
    rows = pa.RecordBatch.from_pydict({"seq": windows + targets, "target_index": pa.array([None] * len(windows) + list(range(len(targets))), pa.int64())})
    dealt = pa.Table.from_batches(near2._deal(iter([rows]))).sort_by("bucket").to_batches(max_chunksize=50)
    got = {}
    for r in (r for b in near2._meet(A._BITS)(iter(dealt)) for r in b.to_pylist()):
        got[r["observed"]] = [x + r[f"__n{i}"] for i, x in enumerate(got.get(r["observed"], [0, 0, 0]))]
    return got


@pytest.mark.parametrize("alphabet", ["AC", "ACGTN"])
def test_two_edits_in_parts(monkeypatch, alphabet):
    """The same counts with buckets over the limit of rows, and keys and pairs met in parts."""
    w, t = sorted(set(_words(alphabet, 200, 3))), _words(alphabet, 200, 4)
    d = {a: [_edits(a, b) for b in t if len(a) == len(b)] for a in w}
    want = {a: [x.count(i) for i in range(3)] for a, x in d.items() if min(x, default=3) < 3}
    assert _met(w, t) == want
    for name, n in (("ROWS", 40), ("KEYS", 60), ("PAIRS", 7)):
        monkeypatch.setattr(near2, name, n)
    assert _met(w, t) == want


def test_two_edits_make_few_candidates(spark, monkeypatch):
    """Strings less two symbols are shared by pairs of up to four edits: in a dense library, many times the hits."""
    seqs = ["".join(x) for x in product("ACGT", repeat=6)]
    w, met, made = seqs[::64], [], near2._met
    monkeypatch.setattr(near2, "_met", lambda *x: (met.append(len(a)) or (a, b) for a, b in made(*x)))
    hits = sum(map(sum, _met(w, seqs).values()))
    keyed = lambda x: spark.createDataFrame([(s,) for s in x], "s string").select(F.explode(S.deletion_keys("s", 2)).alias("key"))
    assert hits == sum(_edits(a, b) <= 2 for a in w for b in seqs)
    assert sum(met) < 2 * hits < 4 * hits < keyed(w).join(keyed(seqs), "key").count()


def test_assign_of_two_edits_joins_no_keys_of_equal_lengths(spark, tmp_path):
    lib(spark, ("ACGTA", "ACGTC")).write.parquet(f"{tmp_path}/lib")
    made = A.assign(reads(spark, ["ACGTA", "AGGTC", "TTTTT"]), spark.read.parquet(f"{tmp_path}/lib"), 2, start=0, length=5)
    assert {r.read_id: (r.target_index, r.best_distance, r.match_count) for r in made.collect()} == {0: (0, 0, 2), 1: (1, 1, 2), 2: (-1, -1, 0)}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "explode(" not in plan.split("Initial Plan")[0]
