"""N-gram Jaccard join: shared-key filter, size-banded tiles with hashed bitmaps, exact verification.

Two sets of word shingles link when ``den * |A & B| >= num * |A | B|``. The class (connected
component of links) of every document is found exactly, without all pairs. Equal sets are one node.

1. *Shared keys.* Shingles are ordered by hash. Linked sets have at most ``n * (1 - num / den)``
   shingles of their own, so if each sends its first ``n * (1 - num / den) + k`` shingles, they have
   ``k`` of those in common. Each task sends one packed record a key; a document of whose keys fewer
   than ``k`` occur in another set can have no link and goes no further. No counts are kept that
   grow with the corpus, nothing is broadcast.
2. *Prefix keys.* Of what is left, keys are ordered rarest first, with exact counts. As linked
   documents share ``k`` keys, they share one of the first ``m - k + 1`` of each. Keys with equal
   least hash of their documents (the likelier the more alike these are) make one group, so that two
   documents meet in few groups and not for each key of theirs.
3. *Hubs.* A key's hub is its document with the fewest keys of its own (the likeliest original).
   Each document is compared with the best hub of its groups, so a large class costs a pair a document.
4. *Tiles.* Groups whose documents are then in several components are cut into tiles by size band;
   tiles of the same or neighbouring bands compare bitmaps, whose bit counts bound the overlap from
   above. Each component's likeliest pairs are verified first; a tile that holds pairs back says so,
   and further turns take more, until no pair across two components is left untried. A group's largest
   component, which is settled within itself, meets the tiles of the other documents only.

Candidates are verified by intersecting sorted arrays of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared_keys
from .common import components, drop_staged, quoted, release, row_key, rows_of, stage, take_rows

#: Keys that linked sets are to have in common, if their sizes allow it: sets of up to 60 shingles
#: send all they have, so that one line that many short documents share makes no candidates of them.
MIN_COMMON = 48
#: Members that a hub is compared with in one task; documents of one tile.
HUB_ROWS, TILE_ROWS = 500, 2048
#: Bytes of a tile's bitmaps; pairs that a tile holds before it drops those that cannot be among the likeliest.
TILE_BYTES, HELD_PAIRS = 1 << 24, 1 << 20
#: Pairs that a tile sends to verification for one component in the first turn; each turn takes MORE times as many.
TILE_PAIRS, MORE = 2, 16
#: Bits of the largest bitmap; smaller sets have four to eight a shingle.
MAX_BITS = 1 << 17
#: Bytes of text that are hashed at once, and the length from which a word is hashed by itself.
PIECE, LONG_WORD = 1 << 20, 512
_U = np.uint64
_M = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words:
    """Hashes of the words of many texts at once, from differences of running sums over their bytes."""

    def __init__(self) -> None:
        code = np.arange(256)
        self.space = np.isin(code, [32, 9, 10, 11, 12, 13])
        lower = np.where((code >= 65) & (code <= 90), code + 32, code)
        self.value = (_mix((np.arange(256, dtype=_U) + _U(1)) * _M) | _U(1))[lower]
        m = int(_M)
        self.up = np.cumprod(np.r_[_U(1), np.full(PIECE - 1, m, _U)])
        self.down = np.cumprod(np.r_[_U(1), np.full(PIECE - 1, pow(m, -1, 1 << 64), _U)])

    def piece(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, number of words before each edge) of at most PIECE bytes; a word ends at an edge."""
        if not len(raw):
            return np.empty(0, _U), np.zeros(len(edges), np.int64)
        gap = self.space[raw]
        before, after = np.ones(len(gap), bool), np.ones(len(gap), bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        inner = edges[(edges > 0) & (edges < len(raw))]
        before[inner] = True
        after[inner - 1] = True
        start, end = np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1
        total = np.zeros(len(raw) + 1, _U)
        np.cumsum(self.value[raw] * self.up[: len(raw)], out=total[1:])
        h = _mix((total[end] - total[start]) * self.down[start])
        for i in np.flatnonzero(end - start >= LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]].tobytes().lower())
        return h, np.searchsorted(start, edges)

    def long(self, raw: np.ndarray) -> np.ndarray:
        """Word hashes of a text of any length, PIECE bytes at a time; a word of more is hashed whole."""
        out, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + PIECE)
            if end < len(raw):
                gaps = np.flatnonzero(self.space[raw[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:  # one word fills the piece: find its end
                    while end < len(raw) and not (gaps := np.flatnonzero(self.space[raw[end : end + PIECE]])).size:
                        end = min(len(raw), end + PIECE)
                    end = min(len(raw), end + int(gaps[0])) if end < len(raw) else end
                    out.append(np.array([xxhash.xxh64_intdigest(raw[at:end].tobytes().lower())], _U))
                    at = end
                    continue
            out.append(self.piece(raw[at:end], np.array([0]))[0])
            at = end
        return np.concatenate(out) if out else np.empty(0, _U)


_WORDS: list[_Words] = []


def _sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[shared_keys.starts(x)]


def _chained(words: np.ndarray, span: int, seed: int = 0) -> np.ndarray:
    """A hash of each ``span`` neighbouring words."""
    x = np.full(len(words) - span + 1, seed, _U)
    for k in range(span):
        x *= _M
        x += words[k : len(words) - span + 1 + k]
    return _mix(x)


def _set_of(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text with these words; few words are one shingle."""
    n = len(words)
    return _sorted(_chained(words, min(width, n), n if n < width else 0)) if n else np.empty(0, _U)


def sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct 64-bit shingle hashes; none for a text that is null or has no words."""
    if not _WORDS:
        _WORDS.append(_Words())
    words = _WORDS[0]
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        if offsets[at + 1] - offsets[at] > PIECE:
            yield _set_of(words.long(data[offsets[at] : offsets[at + 1]]), width)
            at += 1
            continue
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        h, cut = words.piece(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        every = _chained(h, width) if len(h) >= width else h[:0]  # of one text where it holds them all
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield _sorted(every[x : y - width + 1]) if y - x >= width else _set_of(h[x:y], width)
        at = to


def shingles(text: str | None, width: int) -> np.ndarray:
    return next(sets_of(pa.array([text], pa.string()), width))


def bitmap(sig: np.ndarray) -> bytes:
    bits = min(MAX_BITS, max(64, 4 << (len(sig) - 1).bit_length()))
    on = np.zeros(bits, np.uint8)
    on[(sig & _U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(on, bitorder="little").tobytes()


def _own(n: int, num: int, den: int) -> int:
    """Shingles of a set of n that a linked set may lack."""
    return (den - num) * n // den


def _common(n: int, num: int, den: int) -> int:
    """Keys that sets of n shingles or more have in common when linked; n + 1 give no fewer."""
    own = _own(n, num, den)
    return max(1, min(max(own, MIN_COMMON), n - own))


def _needed(n: Column, num: int, den: int) -> Column:
    """:func:`_common` of the smallest set that may link with one of n; one less for larger ones,
    as keys are cut to 48 bits and two of one document may fall together."""
    low = F.expr(f"({num}L * n + {den - 1}) div {den}")
    own = F.floor(low * (den - num) / den)
    k = F.greatest(F.lit(1), F.least(F.greatest(own, F.lit(MIN_COMMON)), low - own))
    return F.when(k >= 8, k - 1).otherwise(k).cast("int")


def _scan(width: int, num: int, den: int, held: int, slots: int):
    """A row a document, and the first keys of each set by hash for :mod:`.shared_keys`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = shared_keys.Window(held, slots)
        for batch in batches:
            ids, rks = batch.column(0), batch.column(1)
            h1, n = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for i, (sig, null) in enumerate(zip(sets_of(batch.column(2), width), ids.is_null().to_pylist(), strict=True)):
                n[i] = len(sig)
                if not len(sig):
                    continue
                h1[i] = d = int.from_bytes(xxhash.xxh3_64_digest(sig.tobytes()), "little", signed=True)
                if null or window.has(d):  # an equal set of this task has told all
                    continue
                own = sig[: _own(len(sig), num, den) + _common(len(sig), num, den)] >> _U(16)
                yield from window.add(d, own[shared_keys.starts(own)])
            yield shared_keys.made(kind=np.zeros(len(ids), np.int8), doc_id=ids, rk=rks, h1=h1, n=n)
        yield from window.flush()

    return run


def verify(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose nodes' shingle sets reach the threshold; ``texts`` is (node, text).

    Each a's text is sent to as many tasks as it has blocks of ``HUB_ROWS`` partners, and there
    meets one partner after another.
    """
    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("parts"))
    asks = pairs.join(fan, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("node"), F.lit(1).alias("other"))
    own = fan.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"), F.lit(0).alias("other"))
    met = asks.union(own).join(texts, "node").repartition("a", "part").sortWithinPartitions("a", "part", "other")

    def run(batches):
        at, hub = None, None
        for batch in batches:
            out = []
            heads = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for (a, part, other, node), sig in zip(heads, sets_of(batch.column(4), width), strict=True):
                if not other:
                    at, hub = (a, part), sig
                elif at == (a, part) and linked(hub, sig, num, den):
                    out.append((a, node))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.select("a", "part", "other", "node", "text").mapInArrow(run, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if not len(x) or not len(y) or den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _fold(raw: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8)
    return np.bitwise_or.reduce(x.reshape(-1, size), axis=0)


def _best(comp: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Which edges are among the ``most`` of highest score of their component."""
    order = np.lexsort((-score, comp))
    c = comp[order]
    start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    place = np.arange(len(c)) - np.repeat(start, np.diff(np.r_[start, len(c)]))
    out = np.empty(len(c), bool)
    out[order] = place < most
    return out


def _compare_tiles(num: int, den: int, most: int):
    """Rows sorted by tile pair: the likeliest pairs across components that sizes and bitmaps allow."""

    def told(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, bool]:
        none = np.empty(0, np.int64)
        left, right = ([r for r in rows if r[0] in (s, 2)] for s in (0, 1))
        if not left or not right:
            return none, none, False
        same = rows[0][0] == 2
        size = min(len(r[4]) for r in rows)
        maps = [np.stack([_fold(r[4], size) for r in side]) for side in (left, right)]
        maps = [m.view(_U) for m in maps]
        node, comp, n = ([np.array([r[c] for r in side], np.int64) for side in (left, right)] for c in (1, 2, 3))
        found_i, found_j, scores, held, dropped = [], [], [], 0, False

        def likeliest() -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
            i, j, score = np.concatenate(found_i), np.concatenate(found_j), np.concatenate(scores)
            pick = _best(comp[0][i], score, most) | _best(comp[1][j], score, most)
            return i[pick], j[pick], score[pick], not pick.all()

        for i in range(len(left)):
            ok = comp[1] != comp[0][i]
            ok &= den * np.minimum(n[1], n[0][i]) >= num * np.maximum(n[1], n[0][i])
            if same:
                ok[: i + 1] = False
            js = np.flatnonzero(ok)
            if not len(js):
                continue
            here, there = maps[0][i], maps[1][js]
            only_i = np.bitwise_count(here & ~there).sum(axis=1, dtype=np.int64)
            only_j = np.bitwise_count(there & ~here).sum(axis=1, dtype=np.int64)
            both = np.minimum(n[0][i] - only_i, n[1][js] - only_j)
            union = n[0][i] + n[1][js] - both
            pick = den * both >= num * union
            if pick.any():
                found_i.append(np.full(pick.sum(), i))
                found_j.append(js[pick])
                scores.append((both / union)[pick])
                held += len(scores[-1])
                if held > HELD_PAIRS:
                    i_, j_, score_, less = likeliest()
                    found_i, found_j, scores, held, dropped = [i_], [j_], [score_], 0, dropped or less
        if not found_i:
            return none, none, False
        i, j, _, less = likeliest()
        a, b = node[0][i], node[1][j]
        return np.minimum(a, b), np.maximum(a, b), dropped or less

    def run(batches):
        at, held = None, []
        kept, left_over = [], False
        for batch in batches:
            for rows in rows_of(batch, 256):
                for r in rows:
                    now = (r["key"], r["t1"], r["t2"])
                    if now != at:
                        a, b, more = told(held) if len(held) > 1 else ([], [], False)
                        left_over |= more
                        if len(a):
                            kept.append((a, b))
                        at, held = now, []
                    held.append((r["side"], r["node"], r["comp"], r["n"], r["bits"]))
            if kept:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate([x for x, _ in kept]), "b": np.concatenate([x for _, x in kept])})
                kept = []
        a, b, more = told(held) if len(held) > 1 else ([], [], False)
        end = [None] if left_over or more else []  # a null pair says that some are left for the next turn
        yield pa.RecordBatch.from_pydict({"a": pa.array([*map(int, a), *end], pa.int64()), "b": pa.array([*map(int, b), *end], pa.int64())})

    return run


def _open_pairs(groups: DataFrame, labels: DataFrame, sizes: DataFrame, num: int, den: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs across components, from keys whose documents are in more than one; the frame to drop after."""
    lab = labels.select("node", F.col("component").alias("known"))
    members = groups.join(lab, "node", "left").select("key", "node", F.coalesce("known", "node").alias("comp"))
    sides = members.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")
    # A key's largest component: its tiles come after the others' and do not meet each other.
    full = stage(members.join(sides, "key").withColumn("main", F.col("comp") == F.col("most")).drop("most").join(sizes, "node").withColumn("band", band), "jaccard-open")
    rows = F.least(F.lit(TILE_ROWS), F.floor(F.lit(TILE_BYTES) / F.least(F.max("n"), F.lit(MAX_BITS // 8))))  # a bitmap has at most a byte a shingle
    tiles = full.groupBy("key", "band").agg(*[F.ceil(F.count_if(x) / rows).cast("int").alias(c) for c, x in (("few", ~F.col("main")), ("mains", F.col("main")))])
    first, wide = F.when(F.col("main"), F.col("few")).otherwise(0), F.when(F.col("main"), F.col("mains")).otherwise(F.col("few"))
    me = full.join(tiles, ["key", "band"]).withColumn("tile", (first + F.pmod(F.xxhash64("node"), wide)).cast("int")).drop("few", "mains")
    others = F.when(F.col("main"), F.col("few")).otherwise(F.col("few") + F.col("mains"))
    j = F.explode(F.when(others > 0, F.sequence(F.lit(0), others - 1)))
    keep = ["key", "node", "comp", "n", "bits"]
    mine = F.concat_ws(".", "band", "tile")

    def meets(step: int) -> DataFrame:
        """Each document beside every tile of its key in the band ``step`` above its own that it is to meet."""
        other = tiles.select("key", (F.col("band") - step).alias("band"), "few", "mains")
        return me.join(other, ["key", "band"]).select("*", j.alias("j"))

    in_band = meets(0).select(
        *keep,
        F.concat_ws(".", "band", F.least("tile", "j")).alias("t1"),
        F.concat_ws(".", "band", F.greatest("tile", "j")).alias("t2"),
        F.when(F.col("tile") == F.col("j"), 2).when(F.col("tile") < F.col("j"), 0).otherwise(1).alias("side"),
    )
    low = meets(1).select(*keep, mine.alias("t1"), F.concat_ws(".", F.col("band") + 1, "j").alias("t2"), F.lit(0).alias("side"))
    high = meets(-1).select(*keep, F.concat_ws(".", F.col("band") - 1, "j").alias("t1"), mine.alias("t2"), F.lit(1).alias("side"))
    dealt = in_band.union(low).union(high).repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
    return dealt.mapInArrow(_compare_tiles(num, den, most), "a long, b long").distinct(), full


def _classes(docs: DataFrame, num: int, den: int, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rk, h1, n) of every row, and (node, component) of the sets that have links."""
    spark = docs.sparkSession
    slim = docs.select(quoted(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("rk"), quoted(text_col).cast("string").alias("text"))
    run = _scan(width, num, den, shared_keys.HELD, shared_keys.SLOTS)
    scanned = stage(slim.mapInArrow(run, shared_keys.SCHEMA), "jaccard-scan")
    sets = stage(scanned.where("kind = 0").select("doc_id", "rk", "h1", "n"), "jaccard-sets")
    nodes = sets.where("n > 0 and doc_id is not null").groupBy(F.col("h1").alias("node")).agg(F.min("rk").alias("rk"), F.min("n").alias("n"))
    shared = shared_keys.shared(scanned)

    # Nodes of whose keys enough occur elsewhere; then again, elsewhere among those.
    need = _needed(F.col("n"), num, den)
    some = shared.groupBy(F.col("h1").alias("node")).agg(F.collect_set("key").alias("keys")).join(nodes, "node").where(F.size("keys") >= need)
    some = stage(some, "jaccard-some")
    release(spark)
    flat = some.select("node", F.explode("keys").alias("key"))
    often = flat.groupBy("key").agg(F.count("*").alias("freq")).where("freq > 1")
    ranked = flat.join(often, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("freq", "key"))).alias("keys"))
    ranked = ranked.join(some.select("node", "rk", "n"), "node").where(F.size("keys") >= need)
    # The share of keys that no other node has: least for the text that others were made from.
    sent = F.floor(F.col("n") * (den - num) / den) + need
    alive = stage(ranked.select("node", "rk", "n", (100 - F.floor(100 * F.size("keys") / sent)).cast("int").alias("rank"), F.slice("keys", 1, F.size("keys") - need + 1).alias("keys")), "jaccard-alive")
    release(spark)
    member = alive.select("node", "n", "rank", F.explode("keys.key").alias("key"))
    # Keys of one passage have nearly the same documents, so most of them have the same least hash.
    one = member.groupBy("key").agg(F.min(F.struct("rank", "node", "n")).alias("hub"), F.count("*").alias("m"), F.min(F.xxhash64("node")).alias("group")).where("m > 1")
    merged = member.join(one.select("key", "group"), "key").groupBy(F.col("group").alias("key"), "node").agg(F.min("n").alias("n"))
    groups = stage(merged.join(one.groupBy(F.col("group").alias("key")).agg(F.min("hub").alias("hub")), "key"), "jaccard-groups")
    texts = stage(slim.select("rk", "text").join(alive.select("rk", "node"), "rk").dropDuplicates(["rk"]).select("node", "text"), "jaccard-texts")
    drop_staged(scanned, some)
    release(spark)

    near = groups.where(f"hub.node <> node and {den} * least(n, hub.n) >= {num} * greatest(n, hub.n)").groupBy("node").agg(F.min("hub").alias("hub")).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    near = stage(near, "jaccard-near")
    links = stage(verify(near, texts, width, num, den), "jaccard-links")
    tried = [near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))]

    def sized(batches):
        for batch in batches:
            sigs = list(sets_of(batch.column(1), width))
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "n": pa.array([len(s) for s in sigs], pa.int64()), "bits": pa.array([bitmap(s) for s in sigs], pa.binary())})

    sizes = stage(texts.mapInArrow(sized, "node long, n long, bits binary"), "jaccard-sizes")
    labels = components(links, "jaccard")
    drop_staged(links)
    most = TILE_PAIRS
    while True:
        pairs, full = _open_pairs(groups, labels, sizes, num, den, most)
        for old in tried:
            pairs = pairs.join(old.select("a", "b"), ["a", "b"], "left_anti")
        fresh = stage(pairs, "jaccard-fresh")
        drop_staged(full)
        release(spark)
        new = stage(verify(fresh.where("a is not null"), texts, width, num, den), "jaccard-links")
        # A component goes on as a star: its links are no longer needed.
        grown = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new), "jaccard")
        drop_staged(labels, new)
        labels = grown
        tried.append(fresh)
        if fresh.where("a is null").isEmpty():  # no tile held any pair back
            break
        most *= MORE
    drop_staged(alive, groups, texts, sizes, near, *tried[1:])
    release(spark)
    return sets, labels


def jaccard_components(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Words are runs of other than ASCII white space, A-Z lower-cased; a text of fewer than
    ``width`` words is one shingle. Null or wordless texts have no shingles and link with
    nothing. Rows are linked by their texts, also where they share an id; the component is the
    smallest id of the class. A row whose id is null links with nothing and has a null component.
    An empty table gives an empty result; other columns are ignored. Texts may be of any length.
    Shingles, and equal sets of them, are told apart by 64-bit hashes.
    """
    sets, labels = _classes(docs, num, den, width, id_col, text_col)
    least = sets.where("n > 0 and doc_id is not null").groupBy(F.col("h1").alias("node")).agg(F.min("doc_id").alias("least"))
    named = least.join(labels, "node").groupBy("component").agg(F.min("least").alias("class"))
    classes = least.join(labels.join(named, "component"), "node", "left").select(F.col("node").alias("h1"), F.coalesce("class", "least").alias("class"))
    out = sets.join(classes, "h1", "left")
    own = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("class")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, width: int = 5) -> DataFrame:
    """``docs`` with one row of each class of linked texts; columns unchanged.

    The row with the smallest id stays; of several with that id (one text or linked texts) one.
    Rows that share an id but are unlike all stay. Rows whose id is null, or whose text is null
    or has no words, have no partner and are all kept.
    """
    sets, labels = _classes(docs, num, den, width, id_col, text_col)
    rows = sets.where("n > 0 and doc_id is not null").groupBy("h1", "doc_id", "rk").agg(F.count("*").alias("cnt"))
    classes = rows.join(labels.withColumnRenamed("node", "h1"), "h1", "left").groupBy(F.coalesce("component", "h1").alias("class")).agg(F.min(F.struct("doc_id", "rk", "cnt")).alias("kept"))
    keep = stage(classes.select("kept.rk", "kept.cnt"), "jaccard-keep")
    drop_staged(sets, labels)
    alone = quoted(id_col).isNull() | ~F.coalesce(quoted(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return take_rows(docs, keep, id_col, text_col, alone)


ORACLE_NOTE = "DuckDB's all-pairs form is too slow on whole tables; the query is tested against brute force."
