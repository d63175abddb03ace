"""Windows against targets of equal length within two edits: counts by distance, without listing pairs.

Of equal length, strings within two edits differ in at most two positions or become equal when each
loses one symbol. Both are equalities, of strings with two masked positions and of strings less a
symbol, so nearly every candidate is a hit; strings less two symbols (:func:`seq.deletion_keys`)
are also shared by pairs of up to four edits, which in a dense library outnumber the hits many times.

A string is dealt to few buckets: for masks one for each two of its quarters (two edits leave two
quarters alone), for lost symbols one for each distinct first half of what is left. Inside its
buckets, Arrow batches at a time, keys are sorted and met. Each pair is counted at one of its keys only,
so sums over buckets are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The quarters that a kind of bucket keeps; kinds from LOST on are of lost symbols, by their position in the first half.
KEPT = list(combinations(range(4), 2))
LOST = len(KEPT)
#: Rows that are met at once (a bucket stays whole), keys of lost symbols that are met at once, and candidates that are compared at once.
ROWS, KEYS, PAIRS = 400_000, 4_000_000, 1_000_000
_DEALT = "bucket long, kind int, seq string, target_index long"


@lru_cache(maxsize=64)
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(n).integers(0, 1 << 63, n + 3 + LOST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=64)
def _quarters(n: int) -> list[int]:
    """The quarter of each position (strings shorter than two are padded to two)."""
    return [sum(p >= n * q // 4 for q in (1, 2, 3)) for p in range(max(n, 2))]


@lru_cache(maxsize=64)
def _masks(n: int) -> list[list[tuple[int, int]]]:
    """Each pair of positions under the one kind of bucket that counts it."""
    at, out = _quarters(n), [[] for _ in KEPT]
    for i, j in combinations(range(max(n, 2)), 2):
        x, y = at[i], at[j]
        y = (x + 1) % 4 if x == y else y
        out[KEPT.index(tuple(q for q in range(4) if q not in (x, y)))].append((i, j))
    return out


def _symbols(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols of a column in a row, where each string starts and how many it has."""
    raw = col.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    if (data[ends[0] : ends[-1]] < 128).all():
        return data, ends[:-1], np.diff(ends)
    sizes = pc.utf8_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(col.to_pylist()).encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes, sizes


def _table(symbols: tuple, rows: np.ndarray, n: int) -> np.ndarray:
    data, starts, _ = symbols
    got = data[starts[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0), np.uint8)
    return np.pad(got, ((0, 0), (0, 2 - n))) if n < 2 else got


def _part(m: np.ndarray, q: int, factor: np.uint64) -> np.ndarray:
    """What the symbol at ``q`` adds to a key. Keys only propose: pairs are compared as symbols."""
    return factor * (m[:, q].astype(np.uint64) + np.uint64(1))


def _starts_run(m: np.ndarray, p: int) -> np.ndarray:
    """Where the symbol at ``p`` differs from the one before: losing any other of its run leaves the same."""
    return np.ones(len(m), bool) if p == 0 else m[:, p] != m[:, p - 1]


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        symbols = _symbols(batch["seq"])
        at, kinds, buckets = [], [], []
        for n in map(int, np.unique(symbols[2])):
            rows = np.flatnonzero(symbols[2] == n)
            m, f, quarter = _table(symbols, rows, n), _factors(n), np.array(_quarters(n))
            part = [_part(m, q, f[q]) for q in range(m.shape[1])]
            for t, kept in enumerate(KEPT):
                at.append(rows)
                kinds.append(np.full(len(rows), t, np.int32))
                buckets.append(sum((part[q] for q in np.flatnonzero(np.isin(quarter, kept))), np.full(len(rows), f[n + t], np.uint64)))
            if n < 3:
                continue  # two masks cover all
            half = (n - 1) // 2
            for p in range(half + 1):
                use = _starts_run(m, p) if p < half else np.any([_starts_run(m, q) for q in range(half, n)], axis=0)
                key = np.full(len(rows), f[n + LOST], np.uint64)
                for q in range(half + (p < half)):
                    key += np.uint64(0) if q == p else part[q] if q < p else _part(m, q, f[q - 1])
                at.append(rows[use])
                kinds.append(np.full(int(use.sum()), LOST + p, np.int32))
                buckets.append(key[use])
        at = pa.array(np.concatenate(at))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets).view(np.int64)), pa.array(np.concatenate(kinds)), batch["seq"].take(at), batch["target_index"].take(at)], ["bucket", "kind", "seq", "target_index"])


def _met(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of equal keys in both, about PAIRS at a time."""
    a, b = np.argsort(left), np.argsort(right)
    keys, right = left[a], right[b]
    lo = np.searchsorted(right, keys)
    n = np.searchsorted(right, keys, "right") - lo
    some = np.flatnonzero(n)
    a, lo, n = a[some], lo[some], n[some]
    ends = np.cumsum(n)
    i = 0
    while i < len(n):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        size = n[i:j]
        first = np.repeat(lo[i:j] - (ends[i:j] - size - done), size)
        yield np.repeat(a[i:j], size), b[first + np.arange(len(first))]
        i = j


class _Counts:
    """Of each row: hits by distance, and the least of distance and target as one number."""

    def __init__(self, rows: int, bits: int):
        self.n, self.top, self.bits = np.zeros((3, rows), np.int64), np.full(rows, np.iinfo(np.int64).max), bits

    def add(self, rows: np.ndarray, targets: np.ndarray, distance: np.ndarray | int) -> None:
        if len(rows):
            np.minimum.at(self.top, rows, (np.int64(distance) << self.bits) + targets)
            for d in range(3):
                np.add.at(self.n[d], rows[distance == d] if isinstance(distance, np.ndarray) else rows[: len(rows) * (distance == d)], 1)


def _masked(m: np.ndarray, n: int, t: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (of the positions ``left`` and ``right``) within two substitutions, counted under kind ``t``."""
    f, last = _factors(n), m.shape[1] - 1
    a, b = m[left], m[right]
    whole = [sum(_part(x, q, f[q]) for q in range(m.shape[1])) for x in (a, b)]
    for i, j in _masks(n)[t]:
        ai, aj, bi, bj = (np.ascontiguousarray(x[:, q]) for x in (a, b) for q in (i, j))
        for x, y in _met(*(w - _part(z, i, f[i]) - _part(z, j, f[j]) for w, z in zip(whole, (a, b), strict=True))):
            di, dj = ai[x] != bi[y], aj[x] != bj[y]
            # One differing position counts with the next one (the last with the one before), none with the first two.
            use = di & dj
            if j == i + 1:
                use |= di if j != last else di | dj
                use |= ~dj if j == 1 else False
            x, y, d = x[use], y[use], (di.astype(np.int64) + dj)[use]
            same = (a[x] != b[y]).sum(1) == d
            yield left[x[same]], right[y[same]], d[same]


def _lost(m: np.ndarray, n: int, kind: np.ndarray, is_target: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that are equal less a symbol each and differ in more than two positions."""
    half, run = (n - 1) // 2, np.zeros(m.shape, np.min_scalar_type(n))
    for p in range(n):
        run[:, p] = np.where(_starts_run(m, p), p, run[:, p - 1])
    turns = 1 + int((kind == LOST + half).sum()) * (n - half) // KEYS  # parts of the range of keys, if a bucket is large
    for turn in range(turns):
        row, pos, key = _lost_keys(m, n, kind, turn, turns)
        of_target = is_target[row]
        left, right = np.flatnonzero(~of_target), np.flatnonzero(of_target)
        for x, y in _met(key[left], key[right]):
            x, y = left[x], right[y]
            far = (m[row[x]] != m[row[y]]).sum(1) > 2
            x, y = x[far], y[far]
            use = _counts_here(m, run, row[x], row[y], pos[x], pos[y])
            yield row[x[use]], row[y[use]]


def _lost_keys(m: np.ndarray, n: int, kind: np.ndarray, turn: int, turns: int) -> tuple[np.ndarray, ...]:
    """Row, lost position (first of its run) and key of each string less a symbol, under the kind that has it."""
    f, half, made = _factors(n), (n - 1) // 2, []
    key = sum((_part(m, q, f[q - 1]) for q in range(1, n)), np.zeros(len(m), np.uint64))
    for p in range(n):
        use = _starts_run(m, p) & (kind == LOST + min(p, half))
        at = np.flatnonzero(use & (key % np.uint64(turns) == turn) if turns > 1 else use)
        made.append((at, np.full(len(at), p, np.int32), key[at]))
        if p < n - 1:
            key += _part(m, p, f[p]) - _part(m, p + 1, f[p])
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def _counts_here(m: np.ndarray, run: np.ndarray, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Whether rows ``a`` and ``b`` are equal without the given positions, and count at this key.

    The window loses its first differing symbol and the target its last, or the other way round: if both do, the former counts.
    """
    n, ma, mb = m.shape[1], m[a], m[b]
    differ, at = ma != mb, np.arange(n - 1)
    first, last = differ.argmax(1), n - 1 - differ[:, ::-1].argmax(1)
    inside = (at >= first[:, None]) & (at < last[:, None])
    one = ~((ma[:, 1:] != mb[:, :-1]) & inside).any(1)
    two = ~((ma[:, :-1] != mb[:, 1:]) & inside).any(1) & ~one
    return (one & (run[a, first] == at_a) & (run[b, last] == at_b)) | (two & (run[a, last] == at_a) & (run[b, first] == at_b))


def _count(table: pa.Table, bits: int) -> pa.RecordBatch:
    table = table.combine_chunks()
    column = lambda name: table[name].chunk(0)
    symbols, kind = _symbols(column("seq")), column("kind").to_numpy()
    is_target = column("target_index").is_valid().to_numpy(zero_copy_only=False)
    target = column("target_index").fill_null(0).to_numpy()
    counts = _Counts(len(kind), bits)
    family = np.minimum(kind, LOST)
    for n in map(int, np.unique(symbols[2])):
        for t in range(LOST + 1):
            rows = np.flatnonzero((symbols[2] == n) & (family == t))
            of_target = is_target[rows]
            if not of_target.any() or of_target.all():
                continue
            m = _table(symbols, rows, n)
            if t == LOST:
                for a, b in _lost(m, n, kind[rows], of_target):
                    counts.add(rows[a], target[rows[b]], 2)
            else:
                for a, b, d in _masked(m, n, t, np.flatnonzero(~of_target), np.flatnonzero(of_target)):
                    counts.add(rows[a], target[rows[b]], d)
    got = np.flatnonzero(counts.n.any(0))
    return pa.RecordBatch.from_arrays([column("seq").take(pa.array(got)), pa.array(counts.top[got]), *[pa.array(x[got]) for x in counts.n]], ["observed", "__top", "__n0", "__n1", "__n2"])


def _meet(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come in order of their buckets; a bucket is not cut."""
        held, rows, enough = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= enough:
                table = pa.Table.from_batches(held)
                bucket = table["bucket"].to_numpy()
                cut = int(np.searchsorted(bucket, bucket[-1]))
                if cut:
                    yield _count(table.slice(0, cut), bits)
                    held, rows, enough = table.slice(cut).to_batches(), table.num_rows - cut, ROWS
                else:
                    enough = 2 * rows
        if rows:
            yield _count(pa.Table.from_batches(held), bits)

    return run


def equal_length(windows: DataFrame, targets: DataFrame, bits: int) -> DataFrame:
    """(observed, __top, __n0, __n1, __n2), to be summed by ``observed``: distinct windows' targets of their own length within two edits.

    ``__top`` is the least of distance (above ``bits``) and target index.
    """
    rows = windows.select(F.col("observed").alias("seq"), F.lit(None).cast("long").alias("target_index")).unionByName(targets.where("target_index is not null").select("seq", F.col("target_index").cast("long").alias("target_index")))
    dealt = rows.where("seq is not null").mapInArrow(_deal, _DEALT).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_meet(bits), "observed string, __top long, __n0 long, __n1 long, __n2 long")
