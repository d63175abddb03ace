"""Which of a document's keys another document has too: found without counts of the whole corpus.

Each task packs one record a key and blob, tells at once which keys several of its documents have,
and the blobs of all tasks meet by key. A key that a third of all documents have costs a record a
task. Keys are 48-bit, nodes (documents of one content) 64-bit; what a task holds is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

#: Keys that a task holds before it passes them on; blobs that it deals them to; keys of all blobs that meet.
HELD, SLOTS, SLOT_KEYS = 1_500_000, 256, 2_000_000
_U = np.uint64

#: Kind 0: a row a document, by the operator. Kind 1: (h1, key), several documents of the task have the key.
#: Kind 2: a blob of n packed keys.
SCHEMA = "kind byte, doc_id long, rk long, h1 long, h2 long, key long, n long, sha binary, slot int, blob binary"
_KINDS = [("kind", pa.int8()), ("doc_id", pa.int64()), ("rk", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("sha", pa.binary()), ("slot", pa.int32()), ("blob", pa.binary())]
_ARROW = pa.schema(_KINDS)


def starts(x: np.ndarray) -> np.ndarray:
    """Which values differ from the one before; the first one does."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def made(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in _KINDS], schema=_ARROW)


class Window:
    """The keys of some documents of a task; one of several equal documents is enough."""

    def __init__(self, held: int, slots: int):
        self.most, self.slots = held, slots
        self._clear()

    def _clear(self) -> None:
        self.keys: list[np.ndarray] = []
        self.nodes: list[int] = []
        self.seen: set[int] = set()
        self.held = 0

    def has(self, node: int) -> bool:
        return node in self.seen

    def add(self, node: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``keys``: distinct."""
        self.seen.add(node)
        self.keys.append(keys)
        self.nodes.append(node)
        self.held += len(keys)
        if self.held >= self.most or len(self.nodes) >= self.most // 8:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        k = np.concatenate(self.keys)
        node = np.repeat(np.array(self.nodes, np.int64), [len(x) for x in self.keys])
        self._clear()
        order = np.argsort(k, kind="stable")
        k, node = k[order], node[order]
        new = starts(k)
        several = ~new | np.append(~new[1:], False)
        x, y = k[several].view(np.int64), node[several]
        for at in range(0, len(x), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield made(kind=np.ones(len(x[cut]), np.int8), h1=y[cut], key=x[cut])
        k, node = k[new], node[new]
        slot = (k % _U(self.slots)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        k, node, slot = k[order], node[order], slot[order]
        cuts = np.append(np.flatnonzero(starts(slot)), len(k))
        for i in range(0, len(cuts) - 1, 16):
            part = list(zip(cuts[i : i + 16], cuts[i + 1 : i + 17], strict=False))
            yield made(kind=np.full(len(part), 2, np.int8), slot=np.array([slot[x] for x, _ in part], np.int32), n=np.array([y - x for x, y in part], np.int64), blob=[pack(k[x:y], node[x:y]) for x, y in part])


def pack(k: np.ndarray, node: np.ndarray) -> bytes:
    """Keys of 48 bits and their nodes: the distinct nodes, then each key and the place of its node."""
    names, place = np.unique(node, return_inverse=True)
    wide = place.astype(np.uint32 if len(names) > 65_535 else np.uint16)
    low = np.ascontiguousarray(k).view(np.uint8).reshape(-1, 8)[:, :6]
    return len(names).to_bytes(4, "little") + names.tobytes() + low.tobytes() + wide.tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(blob[:4], "little")
    names = np.frombuffer(blob, np.int64, size, 4)
    kind = np.dtype(np.uint32 if size > 65_535 else np.uint16)
    n = (len(blob) - 4 - 8 * size) // (6 + kind.itemsize)
    k = np.zeros((n, 8), np.uint8)
    k[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, 4 + 8 * size).reshape(n, 6)
    return k.reshape(-1).view(_U), names[np.frombuffer(blob[4 + 8 * size + 6 * n :], kind)]


def _split(slots: int, parts: int):
    """Packed rows (slot, blob) cut further by key, for corpora of many keys."""
    arrow = pa.schema([("slot", pa.int32()), ("sub", pa.int32()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, 16):
                out = []
                for r in rows:
                    k, node = unpack(r["blob"])
                    sub = (k // _U(slots) % _U(parts)).astype(np.int64)
                    for s in np.unique(sub):
                        out.append({"slot": r["slot"], "sub": int(s), "blob": pack(k[sub == s], node[sub == s])})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed records sorted by (slot, sub): (h1, key) for keys that several nodes have."""

    def told(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(blobs) < 2:
            return
        ks, ds = zip(*map(unpack, blobs), strict=True)
        k, d = np.concatenate(ks), np.concatenate(ds)
        order = np.argsort(k, kind="stable")
        k, d = k[order], d[order]
        start = np.flatnonzero(starts(k))
        runs = np.diff(np.append(start, len(k)))
        several = np.repeat(np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start), runs)
        k, d = k[several].view(np.int64), d[several]
        for at in range(0, len(k), 1 << 16):
            yield pa.RecordBatch.from_pydict({"h1": d[at : at + (1 << 16)], "key": k[at : at + (1 << 16)]})

    at, held = None, []
    for batch in batches:
        slots, subs, blobs = (batch.column(i) for i in range(3))
        for s, u, b in zip(slots.to_pylist(), subs.to_pylist(), blobs, strict=True):
            if (s, u) != at:
                yield from told(held)
                at, held = (s, u), []
            held.append(b.as_py())
    yield from told(held)


def shared(scanned: DataFrame) -> DataFrame:
    """(h1, key), perhaps repeated, for the keys of ``scanned`` (kinds 1 and 2) that several nodes have."""
    packed = scanned.where("kind = 2")
    parts = 1 + (packed.agg(F.sum("n")).first()[0] or 0) // (SLOTS * SLOT_KEYS)
    blobs = packed.select("slot", F.lit(0).alias("sub"), "blob") if parts == 1 else packed.select("slot", "blob").mapInArrow(_split(SLOTS, parts), "slot int, sub int, blob binary")
    met = blobs.repartition("slot", "sub").sortWithinPartitions("slot", "sub").mapInArrow(_meet, "h1 long, key long")
    return met.union(scanned.where("kind = 1").select("h1", "key"))
