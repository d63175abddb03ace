"""Benchmark decontamination with a generalised suffix automaton over item words.

The automaton holds every substring (in words) of all test items. A document is streamed
through it word by word; the state and matched length give the longest suffix read so far that
occurs in some item. From that, the windows that end at the word follow along suffix links.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, rows_of

#: A-Z become a-z; digits, a-z and every byte from 0x80 on belong to words; the rest separates.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the windows of each item marked."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.code: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        items = [(name, [self.code.setdefault(w, len(self.code)) for w in ws]) for name, ws in items if ws]
        for _, seq in items:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        #: state -> {window length: item names}
        self.marks: dict[int, dict[int, set[str]]] = {}
        for name, seq in items:
            m = min(window, len(seq))
            v = got = 0
            for c in seq:
                v, got = self.next[v][c], got + 1
                if got >= m:
                    u = v
                    while self.length[self.link[u]] >= m:
                        u = self.link[u]
                    self.marks.setdefault(u, {}).setdefault(m, set()).add(name)
        self._found: dict[int, tuple] = {}
        self.shortest = min((min(window, len(s)) for _, s in items), default=1 << 30)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:  # another item has this substring already
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _windows(self, state: int) -> tuple:
        """(length, names) of the windows that are suffixes of the state's longest string."""
        out = self._found.get(state)
        if out is None:
            u, got = state, []
            while u > 0:
                got += [(m, tuple(names)) for m, names in self.marks.get(u, {}).items()]
                u = self.link[u]
            out = self._found[state] = tuple(got)
        return out

    def scan(self, ws: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit words as merged [start, end) spans, and the names of the items that occur."""
        code, nxt, link, length, shortest = self.code.get, self.next, self.link, self.length, self.shortest
        spans: list[list[int]] = []
        names: set[str] = set()
        v = got = 0
        for i, w in enumerate(ws):
            c = code(w)
            if c is None:
                v = got = 0
                continue
            to = nxt[v].get(c)
            while to is None:
                v = link[v]
                if v < 0:
                    break
                got = length[v]
                to = nxt[v].get(c)
            if to is None:
                v = got = 0
                continue
            v = to
            got += 1
            if got >= shortest:
                start = i + 1
                for m, who in self._windows(v):
                    if m <= got:
                        names.update(who)
                        start = min(start, i + 1 - m)
                if start <= i:
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return spans, names


#: Bytes of item text that one automaton is built from; larger sets are taken in several passes.
ITEM_BYTES = 4 << 20

_BUILT: dict[str, SuffixAutomaton] = {}


def _automaton(held: tuple[str, int, list[tuple[str, str]]]) -> SuffixAutomaton:
    key, window, items = held
    if key not in _BUILT:
        if len(_BUILT) >= 4:
            _BUILT.clear()
        _BUILT[key] = SuffixAutomaton([(name, words(text)) for name, text in items], window)
    return _BUILT[key]


def _parts(items: DataFrame, window: int, item_id: str, item_text: str) -> Iterator[Broadcast]:
    """The items, broadcast in parts of about ``ITEM_BYTES`` (an item is not split), each read by itself."""
    sc = items.sparkSession.sparkContext
    slim = items.select(quoted(item_id).cast("string").alias("i"), F.coalesce(quoted(item_text), F.lit("")).alias("t"))
    size = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size * 5 // (4 * ITEM_BYTES)))
    for part in range(parts):
        own = slim if parts == 1 else slim.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        got = [(r.i if r.i is not None else "null", r.t) for r in own.toLocalIterator()]
        yield sc.broadcast((hashlib.md5(json.dumps([got, window]).encode()).hexdigest(), window, got))


def find_spans(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: (doc_id, text, n_words, spans array<struct<start, end>>, items array<string>).

    Spans are merged, in words. Null text has no words; null or repeated ids are no matter, as
    each row is handled by itself; empty tables give empty results. The pass is narrow. Item
    text is broadcast in parts of at most ``ITEM_BYTES`` (its size is asked first), with one
    more narrow pass for each further part, so any number of items can be held against.
    """
    out = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    schema = "doc_id long, text string, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
    for held in _parts(items, window, item_id, item_text):

        def run(batches, held=held):
            auto = _automaton(held.value)
            for batch in batches:
                for rows in rows_of(batch):
                    for r in rows:
                        ws = words(r["text"])
                        spans, names = auto.scan(ws)
                        old = [[s["start"], s["end"]] for s in r["spans"] or ()]
                        r["n_words"] = len(ws)
                        r["spans"] = [{"start": a, "end": b} for a, b in (_union(old + spans) if old else spans)]
                        r["items"] = sorted(names | set(r["items"] or ()))
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        out = out.mapInArrow(run, schema)
    return out


def _union(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def report(docs: DataFrame, items: DataFrame, window: int = 10, **names: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document."""
    found = find_spans(docs, items, window, **names)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs; columns unchanged.

    Each row is judged by its own text in one narrow pass, so null and repeated ids are no matter.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))
    for held in _parts(items, window, item_id, item_text):

        def run(batches, held=held):
            auto = _automaton(held.value)
            for batch in batches:
                texts = batch.column(at)
                clean = [not auto.scan(words(t.as_py()))[0] for t in texts]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)


def cut_words(text: str, spans: list) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    raw = text.encode()
    marks, at, inside = [], 0, False
    for i, c in enumerate(raw.translate(_WORDS)):
        if c != 32 and not inside:
            at, inside = i, True
        elif c == 32 and inside:
            marks.append((at, i))
            inside = False
    if inside:
        marks.append((at, len(raw)))
    out, done = [], 0
    for s in spans:
        out.append(raw[done : marks[s["start"]][0]])
        done = marks[s["end"] - 1][1]
    out.append(raw[done:])
    return b"".join(out).decode()


def remove_spans(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.2, **names: str) -> DataFrame:
    """(doc_id, text): matched spans cut out; a document covered by more than ``max_coverage`` goes."""
    found = find_spans(docs, items, window, **names)
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + (s["end"] - s["start"]))
    kept = found.where((F.size("spans") == 0) | (hit <= F.col("n_words") * max_coverage))
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            for rows in rows_of(batch):
                yield pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "text": cut_words(r["text"], r["spans"]) if r["spans"] else r["text"]} for r in rows], schema=arrow)

    return kept.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")
