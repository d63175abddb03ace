"""Removal of repeated byte strings by a run-length (r-)index.

A byte goes if some string of ``length`` bytes over it also starts in a document with a smaller
id. Equal texts are one node, with their smallest id: their other rows go whole. Equal strings have
equal *minimizers* (the least hash of the 16-byte substrings in them), so texts are cut into segments
of neighbouring strings with one minimizer, and only segments whose minimizer occurs in several
texts are looked at further:

1. Each task tells which minimizers several of its texts have, and sends one packed record of each
   other one, which tells which occur elsewhere (:mod:`.shared_keys`).
2. Texts with such minimizers emit those segments. Of equal segments of one task only the smallest
   document's travels; the others are wholly repeated.
3. Segments meet by minimizer. A minimizer with more segments than one task should hold is dealt
   out by its strings of ``length`` bytes instead, equal ones again collapsed in each task first.
   Of what meets, segments that agree with none of another document in most of a string's bytes
   around the minimizer are left out. The rest is sorted by contexts of ``length`` bytes (documents ascending within a context) into a
   run-compressed Burrows-Wheeler transform, sampled where a context's run starts. Streaming matching
   statistics, capped at ``length``, by backward search give each string's context, and so the
   smallest document that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared_keys
from .common import drop_staged, quoted, release, row_key, rows_of, stage

#: Bytes of the substrings that minimizers are chosen from.
GRAM = 16
#: Strings of one segment; bytes of text that a task collapses at once, and that one index is built from.
SEGMENT, HELD_BYTES, BLOCK_BYTES = 64, 16 << 20, 1 << 20
#: Segments of one minimizer that one task takes; more are dealt out by their strings.
HOT_ROWS = 16_384
#: Step, in bytes, of the windows around a minimizer by which segments are held against each other.
ALIGN = 7
#: Strings of a text whose minimizers are found at once.
PIECE = 1 << 19
_U = np.uint64


def _hashes(b: np.ndarray) -> np.ndarray:
    """A mixed hash of every GRAM-byte substring, by doubling."""
    h, width, m = b.astype(_U) + _U(1), 1, 0x9E3779B97F4A7C15
    while width < GRAM:
        h = h[:-width] * _U(m) + h[width:]
        m = m * m % (1 << 64) | 1
        width *= 2
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def minimizers(b: np.ndarray, length: int) -> np.ndarray:
    """For every string of ``length`` bytes the least hash of the substrings in it."""
    if len(b) < length:
        return np.empty(0, _U)
    h, want, have = _hashes(b), length - GRAM + 1, 1
    while have * 2 <= want:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < want:
        h = np.minimum(h[: len(h) - (want - have)], h[want - have :])
    return h


def runs_of(raw: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(minimizer of 48 bits, start, end) of each run of neighbouring strings, by pieces of a long text."""
    for at in range(0, len(raw) - length + 1, PIECE):
        m = minimizers(raw[at : at + PIECE + length - 1], length) >> _U(16)
        cut = np.flatnonzero(shared_keys.starts(m))
        yield m[cut], cut + at, np.append(cut[1:], len(m)) + at


def _scan(length: int, held: int, slots: int):
    """A row a document, and each text's minimizers for :mod:`.shared_keys`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = shared_keys.Window(held, slots)
        for batch in batches:
            ids = batch.column(0)
            h1, h2, n, sha = [], [], [], []
            for text, null in zip(batch.column(2), ids.is_null().to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                d = xxhash.xxh3_128_digest(raw)
                node = int.from_bytes(d[:8], "little", signed=True)
                h1.append(node)
                h2.append(int.from_bytes(d[8:], "little", signed=True))
                n.append(len(raw))
                sha.append(hashlib.sha256(raw).digest())
                if null or len(raw) < length or window.has(node):
                    continue
                keys = [k for k, _, _ in runs_of(np.frombuffer(raw, np.uint8), length)]
                own = np.sort(np.concatenate(keys))
                yield from window.add(node, own[shared_keys.starts(own)])
            yield shared_keys.made(kind=np.zeros(len(ids), np.int8), doc_id=ids, rk=batch.column(1), h1=h1, h2=h2, n=n, sha=sha)
        yield from window.flush()

    return run


#: ``seg``: a segment's bytes, at ``start`` of ``node``, whose smallest id is ``doc_id``; ``more``: its further places
#: in texts of that id, as pairs (node, start). Without ``seg``: bytes from ``start`` to ``key`` are repeated.
_SEG = "key long, salt int, doc_id long, node long, start long, seg binary, more binary"
_SEG_ARROW = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("doc_id", pa.int64()), ("node", pa.int64()), ("start", pa.int64()), ("seg", pa.binary()), ("more", pa.binary())])


class _Collapse:
    """Segments of some texts of a task: of equal ones the smallest document's stay, the others are repeated whole."""

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, raw: bytes, offset: int, doc: int, node: int, key: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> Iterator[pa.RecordBatch]:
        """Segments raw[start:end], which stand ``offset`` further on in the node's text."""
        n = len(key)
        full = lambda x: np.full(n, x, np.int64)
        self.rows.append((full(len(self.texts)), full(doc), full(node), full(offset), key.view(np.int64), start, end, full(salt) if np.isscalar(salt) else salt))
        self.texts.append(raw)
        self.size += len(raw) + 100 * n
        if self.size >= HELD_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        text, doc, node, offset, key, start, end, salt = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        texts = self.texts
        self.__init__()
        base = np.r_[0, np.cumsum([len(t) for t in texts])]
        digest = _digests(np.frombuffer(b"".join(texts), np.uint8), base[text] + start, base[text] + end)
        order = np.lexsort((start + offset, node, doc, digest))
        new = np.r_[True, np.diff(digest[order].view(np.int64)) != 0]
        group = np.cumsum(new) - 1
        least = doc[order][new][group] == doc[order]
        gone = order[~least]
        yield from _spans(node[gone], (start + offset)[gone], (end + offset)[gone])
        stay = order[least]
        head = new[least]
        firsts, count = stay[head], np.diff(np.r_[np.flatnonzero(head), len(stay)])
        after = np.r_[0, np.cumsum(count)]
        for at in range(0, len(firsts), 4096):
            part = firsts[at : at + 4096]
            segs = [texts[t][a:b] for t, a, b in zip(text[part].tolist(), start[part].tolist(), end[part].tolist(), strict=True)]
            more = [None if c == 1 else np.c_[node[x], (start + offset)[x]].tobytes() for c, x in ((count[i], stay[after[i] + 1 : after[i + 1]]) for i in range(at, at + len(part)))]
            yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(salt[part].astype(np.int32)), pa.array(doc[part]), pa.array(node[part]), pa.array((start + offset)[part]), pa.array(segs, pa.binary()), pa.array(more, pa.binary())], schema=_SEG_ARROW)


def _digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], eight bytes at a time, for many short ranges at once."""
    size = end - start
    h = size.astype(_U) * _U(0x9E3779B97F4A7C15)
    wide = np.zeros(len(raw) + 8, np.uint8)
    wide[: len(raw)] = raw
    words = np.lib.stride_tricks.as_strided(wide, (len(raw) + 1, 8), (1, 1))
    at = 0
    live = np.arange(len(size))
    while len(live):
        x = np.ascontiguousarray(words[start[live] + at]).view(_U).reshape(-1)
        left = size[live] - at
        short = left < 8
        if short.any():
            x[short] &= (_U(1) << (left[short].astype(_U) * _U(8))) - _U(1)
        y = (h[live] ^ x) * _U(0xBF58476D1CE4E5B9)
        h[live] = (y ^ (y >> _U(32))) * _U(0x94D049BB133111EB) + _U(at + 1)
        at += 8
        live = live[left > 8]
    return h ^ (h >> _U(29))


def _spans(node: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows without segment for repeated bytes, touching ones as one."""
    if not len(node):
        return
    order = np.lexsort((end, start, node))
    node, start, end = node[order], start[order], end[order]
    new = np.r_[True, node[1:] != node[:-1]]
    # Ends so far within a node: nodes are told apart by a step that no end reaches.
    step = int(end.max()) + 1
    far = np.maximum.accumulate(end + (np.cumsum(new) - 1) * step) - (np.cumsum(new) - 1) * step
    cut = np.flatnonzero(new | np.r_[True, start[1:] > far[:-1]])
    last = np.r_[cut[1:], len(node)] - 1
    for at in range(0, len(cut), 1 << 15):
        x, y = cut[at : at + (1 << 15)], last[at : at + (1 << 15)]
        none = pa.nulls(len(x), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(far[y]), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.int64()), pa.array(node[x]), pa.array(start[x]), none, none], schema=_SEG_ARROW)


def _segments(length: int):
    """Texts with their shared minimizers: the segments to compare, and spans that are known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Collapse()
        for batch in batches:
            nodes, docs, texts, keys = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                raw = texts[i].as_py().encode()
                want = np.sort(keys[i].values.to_numpy(zero_copy_only=False)).view(_U)
                node, doc = nodes[i].as_py(), docs[i].as_py()
                for m, x, y in runs_of(np.frombuffer(raw, np.uint8), length):
                    hit = np.searchsorted(want, m)
                    ok = want[np.minimum(hit, len(want) - 1)] == m
                    m, x, y = m[ok], x[ok], y[ok]
                    if not len(m):
                        continue
                    many = -(-(y - x) // SEGMENT)  # long runs of one minimizer in pieces
                    if (many > 1).any():
                        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        m, end = np.repeat(m, many), np.repeat(y, many)
                        x = np.repeat(x, many) + place * SEGMENT
                        y = np.minimum(end, x + SEGMENT)
                    yield from held.add(raw[x[0] : y[-1] + length], int(x[0]), doc, node, m, x - x[0], y - 1 + length - x[0])
        yield from held.flush()

    return run


def _strings(length: int):
    """Segments of hot minimizers as their strings of ``length`` bytes, dealt out by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Collapse()
        for batch in batches:
            for rows in rows_of(batch):
                for r in rows:
                    seg, at = r["seg"], np.arange(len(r["seg"]) - length + 1)
                    of = (_digests(np.frombuffer(seg, np.uint8), at, at + length) % _U(r["salts"])).astype(np.int64) + 1
                    places = np.r_[np.frombuffer(r["more"] or b"", np.int64).reshape(-1, 2), [[r["node"], r["start"]]]]
                    for node, start in places.tolist():
                        yield from held.add(seg, start, r["doc_id"], node, np.full(len(at), r["key"]), at, at + length, of)
        yield from held.flush()

    return run


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of segments (documents ascending), with contexts of
    ``length`` symbols; ties within a context by position, so by document. Kept are the runs of the
    transform, the starts of contexts, and a document for each of those: nothing for each position."""

    def __init__(self, segs: list[bytes], docs: list[int], length: int):
        self.length = length
        size = np.array([len(s) for s in segs])
        n = int(size.sum() + len(segs) + 1)
        text = np.zeros(n, np.int64)  # 0 separates; bytes are 1 to 256
        at = np.r_[0, np.cumsum(size + 1)]
        for i, s in enumerate(segs):
            text[at[i] : at[i] + len(s)] = np.frombuffer(s, np.uint8).astype(np.int64) + 1
        owner = np.repeat(np.array([*docs, docs[-1] if docs else 0], np.int64), np.r_[size + 1, 1])
        # Ranks by the first seven symbols at once (nine bits each), then by doubling.
        width = min(7, length // 2)
        rank = np.zeros(n, np.int64)
        for i in range(width):
            rank[: n - i] |= text[i:] << (9 * (width - 1 - i))
        rank = self._dense(rank)
        while width * 2 < length - 1:
            rank = self._pair(rank, width)
            width *= 2
        prev = self._pair(rank, length - 1 - width)
        rank = self._pair(rank, length - width)
        order = np.argsort(rank * n + np.arange(n))  # ties by position
        # The transform's rows are sampled where a context's run starts; its first row is the smallest document's.
        whole = rank[order]
        self.sample_at = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]])
        self.sample = owner[order[self.sample_at]]
        lead = prev[order]
        self.short_start = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
        self.n = n
        bwt = text[order - 1]
        self.less = np.r_[0, np.cumsum(np.bincount(text, minlength=258))]
        run = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        head, long = bwt[run], np.diff(np.r_[run, n])
        by = np.lexsort((run, head))
        self.run_key = head[by] * (n + 1) + run[by]
        self.run_at, self.run_long, self.run_head = run[by], long[by], head[by]
        total = np.cumsum(self.run_long)
        start = np.r_[0, np.flatnonzero(self.run_head[1:] != self.run_head[:-1]) + 1]
        before = np.repeat(np.r_[0, total][start], np.diff(np.r_[start, len(by)]))
        self.run_before = total - self.run_long - before
        self.runs = len(run)

    @staticmethod
    def _pair(rank: np.ndarray, shift: int) -> np.ndarray:
        other = np.zeros_like(rank)
        if shift < len(rank):
            other[:-shift] = rank[shift:] + 1
        return RunIndex._dense(rank * (int(rank.max()) + 2) + other)

    @staticmethod
    def _dense(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        sorted_ = key[order]
        out = np.empty_like(key)
        out[order] = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])
        return out

    def _rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c is among the first i of the transform, from runs only."""
        j = np.searchsorted(self.run_key, c * (self.n + 1) + i) - 1
        ok = (j >= 0) & (self.run_head[np.maximum(j, 0)] == c)
        j = np.maximum(j, 0)
        return np.where(ok, self.run_before[j] + np.minimum(self.run_long[j], i - self.run_at[j]), 0)

    def first_documents(self, segs: list[bytes]) -> list[np.ndarray]:
        """For each string of ``length`` bytes of each segment the smallest document that has it.

        Segments advance together, one byte to the left a step; when ``length`` bytes have matched,
        the context is read off and the interval widened to the first ``length - 1`` bytes.
        """
        size = np.array([len(s) for s in segs], np.int64)
        cut = np.r_[0, np.cumsum(np.maximum(0, size - self.length + 1))]
        res = self._first(segs, size, cut)
        return [res[cut[i] : cut[i + 1]] for i in range(len(segs))]

    def _first(self, segs: list[bytes], size: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The same, one segment after another: each from its ``cut``."""
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(segs), np.uint8).astype(np.int64) + 1
        ends = np.cumsum(size)[order]
        sizes = size[order]
        lo, hi = np.zeros(len(segs), np.int64), np.full(len(segs), self.n, np.int64)
        steps = int(sizes[0]) if len(sizes) else 0
        res = np.full(int(cut[-1]), np.iinfo(np.int64).max)
        ends_short = np.r_[self.short_start[1:], self.n]
        place = cut[1:][order]  # end of each segment's part
        for t in range(steps):
            live = int(np.searchsorted(-sizes, -t, side="left"))  # segments longer than t
            c = flat[ends[:live] - 1 - t]
            lo[:live] = self.less[c] + self._rank(c, lo[:live])
            hi[:live] = self.less[c] + self._rank(c, hi[:live])
            if t >= self.length - 1:
                found = hi[:live] > lo[:live]
                k = place[:live] - 1 - (t - self.length + 1)
                res[k[found]] = self.sample[np.searchsorted(self.sample_at, lo[:live][found])]
                j = np.searchsorted(self.short_start, lo[:live], side="right") - 1
                lo[:live] = self.short_start[j]
                hi[:live] = ends_short[j]
        return res


def _alike(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, group: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the segments data[lo:hi] (one after another) may share a string with another document of their
    group, and which with a smaller one.

    Around a minimizer of a string that two segments share they agree in ``length - GRAM`` further bytes, some
    number of them before it: with that rounded down to a multiple of ALIGN, in the window from there on.
    """
    h = _hashes(data) >> _U(16) if len(data) >= GRAM else np.empty(0, _U)
    row = np.repeat(np.arange(len(lo)), hi - lo)[: len(h)]
    at = np.flatnonzero(h == key.view(_U)[row])
    row = row[at]
    values, rows = [], []
    for left in range(0, length - GRAM + 1, ALIGN):
        right = GRAM + max(0, length - GRAM - left - ALIGN + 1)
        fits = (at - left >= lo[row]) & (at + right <= hi[row])
        x, y = at[fits], row[fits]
        values.append(_digests(data, x - left, x + right) + (group[y].astype(_U) * _U(length) + _U(left)) * _U(0x9E3779B97F4A7C15))
        rows.append(y)
    v, of = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((doc[of], v))
    of = of[order]
    new = np.flatnonzero(shared_keys.starts(v[order]))
    size = np.diff(np.r_[new, len(of)])
    first, last = np.repeat(doc[of[new]], size), np.repeat(doc[of[new + size - 1]], size)
    some, less = np.zeros(len(lo), bool), np.zeros(len(lo), bool)
    some[of[first < last]] = True
    less[of[doc[of] > first]] = True
    return some, less


def _judge(length: int):
    """Segments sorted by (key, salt): spans of strings that a smaller document has."""

    def told(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, salt, doc, node, start = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        new = np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
        group = np.cumsum(new) - 1
        met = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(met):
            return
        key, doc, node, start, group = (x[met] for x in (key, doc, node, start, group))
        seg, more = rows.column(5).take(pa.array(met)), rows.column(6).take(pa.array(met))
        data, (lo, hi) = _flat(seg)
        # Equal segments of several tasks: all but the smallest document's are repeated whole.
        digest = _digests(data, lo, hi)
        order = np.lexsort((doc, digest, group))
        head = np.r_[True, (digest[order][1:] != digest[order][:-1]) | (group[order][1:] != group[order][:-1])]
        least = np.empty_like(doc)
        least[order] = doc[order][head][np.cumsum(head) - 1]
        whole = np.flatnonzero(doc > least)
        nodes, starts, ends = [node[whole]], [start[whole]], [(start + hi - lo)[whole]]

        def gone(i: int, a: int, b: int) -> None:
            places = np.frombuffer(more[i].as_py(), np.int64).reshape(-1, 2)
            nodes.append(places[:, 0])
            starts.append(places[:, 1] + a)
            ends.append(places[:, 1] + b)

        several = more.is_valid().to_numpy(zero_copy_only=False)
        for i in whole[several[whole]].tolist():
            gone(i, 0, int(hi[i] - lo[i]))
        rest = np.flatnonzero(doc == least)
        data, (lo, hi) = _flat(seg.take(pa.array(rest)))
        some, less = _alike(data, lo, hi, key[rest], group[rest], doc[rest], length)
        if less.any():
            kept = np.flatnonzero(some)
            kept = kept[np.argsort(doc[rest[kept]], kind="stable")]
            asked = kept[less[kept]]
            raw = data.tobytes()
            index = RunIndex([raw[a:b] for a, b in zip(lo[kept].tolist(), hi[kept].tolist(), strict=True)], doc[rest[kept]].tolist(), length)
            size = (hi - lo)[asked]
            cut = np.r_[0, np.cumsum(size - length + 1)]
            first = index._first([raw[a:b] for a, b in zip(lo[asked].tolist(), hi[asked].tolist(), strict=True)], size, cut)
            of = np.repeat(np.arange(len(asked)), size - length + 1)
            at = np.flatnonzero(first < doc[rest[asked]][of])
            if len(at):
                open_ = np.flatnonzero(np.r_[True, (at[1:] > at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])])
                x, y = at[open_], at[np.r_[open_[1:], len(at)] - 1]
                i, x, y = rest[asked[of[x]]], x - cut[of[x]], y - cut[of[y]] + length
                nodes.append(node[i])
                starts.append(start[i] + x)
                ends.append(start[i] + y)
                for j in np.flatnonzero(several[i]).tolist():
                    gone(int(i[j]), int(x[j]), int(y[j]))
        yield from _spans(*(np.concatenate(x) for x in (nodes, starts, ends)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Several small minimizers are taken together, none being split.
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                held.append(part)
                size += _bytes(part)
                if size < BLOCK_BYTES or _place(held[0], 0) == _place(part, -1):
                    continue
                rows = pa.concat_batches(held)
                key, salt = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                cut = int(np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))[-1]) + 1
                yield from told(rows.slice(0, cut))
                held = [rows.slice(cut)]
                size = _bytes(held[0])
        if held:
            yield from told(pa.concat_batches(held))

    return run


def _flat(texts: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The bytes of an array of short texts one after another, and where each starts and ends in them."""
    size = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.r_[0, np.cumsum(size)]
    return np.frombuffer(b"".join(texts.to_pylist()), np.uint8), (at[:-1], at[1:])


def _bytes(rows: pa.RecordBatch) -> int:
    return sum(pa.compute.sum(pa.compute.binary_length(rows.column(i))).as_py() or 0 for i in (5, 6))


def _place(rows: pa.RecordBatch, i: int) -> tuple[int, int]:
    i %= rows.num_rows
    return rows.column(0)[i].as_py(), rows.column(1)[i].as_py()


def _repeats(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2, n, sha) of all rows, and (h1, text, spans) of texts with repeated bytes."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    spark = docs.sparkSession
    slim = docs.select(quoted(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("rk"), quoted(text_col).cast("string").alias("text"))
    scanned = stage(slim.mapInArrow(_scan(length, shared_keys.HELD, shared_keys.SLOTS), shared_keys.SCHEMA), "repeat-scan")
    rows = stage(scanned.where("kind = 0").select("doc_id", "rk", "h1", "h2", "n", "sha"), "repeat-rows")
    nodes = rows.where(f"doc_id is not null and n >= {length}").groupBy("h1").agg(F.min("doc_id").alias("least"), F.min("rk").alias("rk"))
    keys = shared_keys.shared(scanned).groupBy("h1").agg(F.collect_set("key").alias("keys"))
    keys = stage(keys.join(nodes, "h1"), "repeat-keys")
    drop_staged(scanned)
    release(spark)
    texts = slim.select("rk", "text").join(keys, "rk").dropDuplicates(["rk"])
    segs = stage(texts.select("h1", "least", "text", "keys").mapInArrow(_segments(length), _SEG), "repeat-segments")
    drop_staged(keys)
    release(spark)
    met, known = segs.where("seg is not null"), segs.where("seg is null")
    hot = stage(met.groupBy("key").agg(F.count("*").alias("rows")).where(f"rows > {HOT_ROWS}").select("key", F.ceil(F.col("rows") * SEGMENT / HOT_ROWS).cast("int").alias("salts")), "repeat-hot")
    if not hot.isEmpty():
        dealt = met.join(hot, "key").select("key", "salts", "doc_id", "node", "start", "seg", "more").mapInArrow(_strings(length), _SEG)
        dealt = stage(dealt, "repeat-dealt")
        met, known = met.join(hot, "key", "left_anti").select(*_SEG_ARROW.names).union(dealt.where("seg is not null")), known.union(dealt.where("seg is null"))
    judged = met.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(_judge(length), _SEG)
    spans = judged.union(known).groupBy("node").agg(F.array_sort(F.collect_set(F.struct(F.col("start"), F.col("key").alias("end")))).alias("spans"))
    spans = stage(spans.withColumnRenamed("node", "h1").join(nodes.select("h1", "rk"), "h1"), "repeat-spans")
    drop_staged(segs, hot, *([] if hot.isEmpty() else [dealt]))
    release(spark)
    return rows, slim.select("rk", "text").join(spans, "rk").dropDuplicates(["rk"])


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    Null text is empty; texts may be of any length. A null id is smaller than none and larger than
    none: such a row neither loses bytes nor causes others to. Texts that share an id do not repeat
    each other. Repeated rows get equal results. Matches never cross documents. An empty table gives
    an empty result; other columns are ignored.
    """
    rows, hit = _repeats(docs, length, id_col, text_col)
    arrow = pa.schema([("h1", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha", pa.binary()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch):
                out = []
                for r in part:
                    raw = r["text"].encode()
                    parts, done, n = [], 0, 0
                    merged: list[list[int]] = []
                    for s in r["spans"]:
                        if merged and s["start"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s["end"])
                        else:
                            merged.append([s["start"], s["end"]])
                    for a, b in merged:
                        parts.append(raw[done:a])
                        done, n = b, n + b - a
                    kept = b"".join([*parts, raw[done:]])
                    out.append({"h1": r["h1"], "n_removed": n, "n_spans": len(merged), "kept_sha": hashlib.sha256(kept).digest(), "kept": kept if with_text else None})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    done = hit.select("h1", "text", "spans").mapInArrow(run, "h1 long, n_removed long, n_spans long, kept_sha binary, kept binary")
    # The other rows of a text go whole; the two hashes together tell texts apart.
    least = rows.where(f"doc_id is not null and n >= {length}").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, ["h1", "h2"], "left").join(done, "h1", "left")
    own = F.col("doc_id").isNull() | F.col("least").isNull()
    copy = ~own & (F.col("doc_id") > F.col("least"))
    some = ~own & ~copy & F.col("n_removed").isNotNull()
    empty = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    cols = [
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).when(some, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, 1).when(some, F.col("n_spans")).otherwise(0).cast("long").alias("n_spans"),
        F.lower(F.hex(F.when(copy, empty).when(some, F.col("kept_sha")).otherwise(F.col("sha")))).alias("kept_sha256"),
    ]
    if with_text:
        # The bytes that stay where some went; null where the text is whole, empty for a copy.
        cols.append(F.when(copy, F.unhex(F.lit(""))).when(some, F.col("kept")).alias("kept"))
    return out.select(*cols)
