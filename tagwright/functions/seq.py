"""Column functions on short sequences. All are built-in expressions (no Python on executors).

Sequences are literal bytes: ``N`` and other codes are symbols like any other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chars(s: Column | str) -> Column:
    """The symbols of a sequence as an array; an empty one has none."""
    s = _c(s)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))


def window(seq: Column | str, start: Column | int, length: Column | int) -> Column:
    """Upper-case ``seq[start:start+length]`` (0-based), or null if the read is too short."""
    seq, start, length = _c(seq), F.lit(start) if isinstance(start, int) else start, F.lit(length) if isinstance(length, int) else length
    return F.when((start >= 0) & (F.length(seq) >= start + length), F.upper(F.substr(seq, start + 1, length)))


def levenshtein_within(a: Column | str, b: Column | str, k: int) -> Column:
    """Edit distance if at most ``k``, else null. A negative ``k`` counts as 0."""
    a, b, k = _c(a), _c(b), max(0, k)
    d = F.levenshtein(a, b, k)
    return F.when((F.abs(F.length(a) - F.length(b)) <= k) & (d >= 0), d)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of differing positions, or null for unequal lengths."""
    a, b = _c(a), _c(b)
    diff = F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda n, x: n + x)
    return F.when(F.length(a) == F.length(b), diff)


def hamming_within(a: Column | str, b: Column | str, k: int) -> Column:
    """Hamming distance if at most ``k``, else null. At equal length and k <= 1 both metrics agree."""
    a, b = _c(a), _c(b)
    if k <= 1:
        return F.when(F.length(a) == F.length(b), levenshtein_within(a, b, k))
    h = hamming(a, b)
    return F.when(h <= k, h)


def panel_hamming(a: Column | str, b: Column | str) -> Column:
    """Hamming distance as panels use it: unequal lengths are as far apart as the longer is long."""
    a, b = _c(a), _c(b)
    return F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b))).otherwise(F.coalesce(hamming_2bit(encode_2bit(a), encode_2bit(b)), hamming(a, b)))


def sequence_levenshtein(a: Column | str, b: Column | str, left: str = "", right: str = "", context: int | None = None) -> Column:
    """Edit distance of the sequences within their flanks, clipped to ``context`` symbols."""
    if context is not None:
        left, right = left[max(0, len(left) - context) :] if context else "", right[:context]
    return F.levenshtein(F.concat(F.lit(left), _c(a), F.lit(right)), F.concat(F.lit(left), _c(b), F.lit(right)))


def encode_2bit(s: Column | str) -> Column:
    """A0 C1 G2 T3 packed into a long, first symbol highest; null unless 1 to 31 symbols of ACGT."""
    s = _c(s)
    return F.when(s.rlike("^[ACGT]{1,31}$"), F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("long"))


def hamming_2bit(a: Column | str, b: Column | str) -> Column:
    """Differing positions of two packed sequences of equal length."""
    x = _c(a).bitwiseXOR(_c(b))
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def one_delete_match(longer: Column | str, shorter: Column | str) -> Column:
    """Whether dropping one symbol of ``longer`` gives ``shorter``."""
    a, b = _c(longer), _c(shorter)
    return (F.length(a) == F.length(b) + 1) & (F.levenshtein(a, b, 1) >= 0)


def edit_kind(observed: Column | str, target: Column | str, distance: Column | str) -> Column:
    """exact, substitution, insertion (the read is longer), deletion or other (two edits and more)."""
    diff = F.length(_c(observed)) - F.length(_c(target))
    d = _c(distance)
    return (
        F.when(d == 0, "exact").when(d != 1, "other").when(diff == 0, "substitution").when(diff == 1, "insertion").when(diff == -1, "deletion").otherwise("other")
    )


def reverse_complement(s: Column | str, other_to_n: bool = True) -> Column:
    """Reverse complement; symbols other than ACGT become ``N`` or, for panels, stay."""
    s = _c(s)
    if other_to_n:
        s = F.regexp_replace(F.upper(s), "[^ACGT]", "N")
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def phred33(symbol: Column | str) -> Column:
    return F.greatest(F.lit(0), F.ascii(_c(symbol)) - 33)


def low_quality(qual: Column | str, threshold: int) -> Column:
    """Whether any symbol's quality is under the threshold."""
    return F.exists(chars(qual), lambda c: phred33(c) < threshold)


def contains_n(s: Column | str) -> Column:
    return F.upper(_c(s)).contains("N")


def adapter_contained(read: Column | str, observed: Column | str, adapters: list[str]) -> Column:
    hit = F.lit(False)
    for a in adapters:
        if a:
            hit = hit | F.upper(_c(read)).contains(a.upper()) | F.upper(_c(observed)).contains(a.upper())
    return hit


def rescue_allowed(observed: Column | str, qual: Column | str, target: Column | str, threshold: int) -> Column:
    """Whether low quality at the edit allows a rescue.

    Equal lengths: every differing position is at or under the threshold. The read one longer:
    some symbol whose removal gives the target is. One shorter: always. Otherwise never.
    """
    o, q, t = _c(observed), _c(qual), _c(target)
    n, m = F.length(o), F.length(t)
    low = lambda i: phred33(F.substr(q, i + 1, F.lit(1))) <= threshold
    at = F.sequence(F.lit(0), n - 1)
    same = F.forall(at, lambda i: (F.substr(o, i + 1, F.lit(1)) == F.substr(t, i + 1, F.lit(1))) | low(i))
    drop = F.exists(at, lambda i: low(i) & (F.concat(F.substr(o, F.lit(1), i), F.substr(o, i + 2)) == t))
    return F.when(n == m, same).when(n == m + 1, drop).when(n + 1 == m, F.lit(True)).otherwise(F.lit(False))


def deletion_keys(s: Column | str, k: int) -> Column:
    """All distinct strings from deleting at most ``k`` symbols. Two strings within k edits share one."""
    s = _c(s)
    keys = F.array(s)
    for _ in range(k):
        keys = F.array_distinct(
            F.flatten(F.transform(keys, lambda x: F.concat(F.array(x), F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))).otherwise(F.array().cast("array<string>")))))
        )
    return keys


def masked_keys(s: Column | str, k: int) -> Column:
    """For Hamming distance up to 1: the string with each position masked in turn (k 0: the string)."""
    s = _c(s)
    if k == 0:
        return F.array(s)
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.lit("*"), F.substr(s, i + 1)))).otherwise(F.array(s))


def one_edit_variants(s: Column | str) -> Column:
    """The string and all distinct strings one edit away over ACGT."""
    s = _c(s)
    n = F.length(s)
    bases = F.array(*map(F.lit, "ACGT"))
    at = F.sequence(F.lit(1), n)
    sub = F.flatten(F.transform(at, lambda i: F.transform(bases, lambda b: F.concat(F.substr(s, F.lit(1), i - 1), b, F.substr(s, i + 1)))))
    dele = F.transform(at, lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
    ins = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(bases, lambda b: F.concat(F.substr(s, F.lit(1), i), b, F.substr(s, i + 1)))))
    return F.array_distinct(F.concat(F.array(s), sub, dele, ins))


def gc_fraction(s: Column | str) -> Column:
    s = _c(s)
    return F.when(F.length(s) == 0, 0.0).otherwise(F.length(F.regexp_replace(s, "[^GC]", "")) / F.length(s))


def max_homopolymer(s: Column | str) -> Column:
    """Longest run of one symbol, whatever the symbol."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(_c(s), F.lit(r"((.)\2*)"), F.lit(1)), lambda x: F.length(x))), F.lit(0))


def max_dinucleotide_repeat(s: Column | str) -> Column:
    """Most repeats in a row of any pair of symbols, from any start."""
    s = _c(s)
    runs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.length(F.regexp_extract(F.substr(s, i), r"^((..)\2*)", 1)) / 2)
    return F.when(F.length(s) < 2, 0).otherwise(F.array_max(runs)).cast("int")


def self_complement_score(s: Column | str) -> Column:
    """Share of positions that equal those of the reverse complement."""
    s = _c(s)
    rc = reverse_complement(s, other_to_n=False)
    same = F.aggregate(F.zip_with(chars(s), chars(rc), lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.when(F.length(s) == 0, 0.0).otherwise(same / F.length(s))


def forbidden_motifs(s: Column | str, motifs: list[str]) -> Column:
    found = F.array(*[F.when(_c(s).contains(m), F.lit(m)) for m in motifs if m]) if any(motifs) else F.array().cast("array<string>")
    return F.filter(found, lambda x: x.isNotNull())


def shared_prefix(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    same = F.transform(F.sequence(F.lit(1), F.least(F.length(a), F.length(b))), lambda i: F.when(F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i), i).otherwise(0))
    return F.when(F.least(F.length(a), F.length(b)) == 0, 0).otherwise(F.array_max(same))


def shared_suffix(a: Column | str, b: Column | str) -> Column:
    return shared_prefix(F.reverse(_c(a)), F.reverse(_c(b)))


def safe_name(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), "[^A-Za-z0-9_.-]", "_")


def escape_html(s: Column | str) -> Column:
    out = _c(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
