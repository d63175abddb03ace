"""Byte-level BPE: merges compiled into a lazily determinised transducer, and a streaming decoder.

Encoding. A token sequence is the BPE encoding of its bytes exactly when each token encodes to
itself and each neighbouring pair (a, b) encodes to [a, b]. So the encodings are the paths of a
nondeterministic transducer that reads tokens byte by byte and may start token b after token a
only if the pair is stable. Each prefix of the input has exactly one such path that ends at its
end. :class:`Transducer` determinises this on the fly: a state holds the open hypotheses
(last token, place in the token trie, tokens not yet agreed on); whatever all hypotheses agree
on is emitted at once, so output lags the input by a bounded look-ahead.

Decoding. :class:`Utf8Stream` is fed token bytes in pieces and keeps at most three undecided bytes.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, rows_of

#: A vocabulary is broadcast; larger files than this are refused.
MAX_VOCAB_BYTES = 64 << 20
#: Bound on memoised pieces and on chunks; on lazily made transitions half of it. What is not held is worked out again.
CACHE = 300_000


def load_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Transducer:
    """Encodes one pre-token (bytes) at a time by left-to-right transitions."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for tok, i in ranks.items():
            node = 0
            for c in tok:
                key = node << 8 | c
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.stable: dict[int, bool] = {}
        self._halves()
        start = ((0, -1, ()),)
        self.states = [start]
        self.number = {start: 0}
        self.moves: dict[int, tuple[int, tuple]] = {}


    def _halves(self) -> None:
        """For each token the pair whose merge makes it, and the reverse table of pairs."""
        ranks = self.ranks
        self.left, self.right, self.made = {}, {}, {}
        for tok, i in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self._merged(tok, i)
            if len(parts) == 2:
                self.left[i], self.right[i] = parts
                self.made[parts[0] << 32 | parts[1]] = i

    def _merged(self, s: bytes, below: int) -> list[int]:
        """Plain merging with ranks under ``below``: lowest rank first, leftmost first."""
        parts, ranks = [s[i : i + 1] for i in range(len(s))], self.ranks
        while len(parts) > 1:
            r, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if r >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def _follows(self, a: int, b: int) -> bool:
        """Whether token b may stand right after token a (-1: at the start).

        The merges that made both tokens are undone from the last one backwards. The pair is
        unstable if, at some moment, the two parts that touched could have merged before the
        next merge beside them took place.
        """
        if a < 0:
            return b in self.left or len(self.bytes_of[b]) == 1
        key = a << 32 | b
        ok = self.stable.get(key)
        if ok is not None:
            return ok
        made, left, right, x, y, ok = self.made, self.left, self.right, a, b, True
        until = 1 << 60  # the merge across must come before this rank
        while True:
            m = made.get(x << 32 | y)
            if m is not None and m < until:
                ok = False
                break
            # Undo the later of the merges that made x and y; at equal ranks the left one came first.
            if x in right and (x > y or y not in left):
                until, x = x, right[x]
            elif y in left:
                until, y = y + 1, left[y]
            else:
                break
        if len(self.stable) >= 4 * CACHE:
            self.stable.clear()
        self.stable[key] = ok
        return ok

    def _step(self, state: int, c: int) -> tuple[int, tuple]:
        hyps, ended, child, token_at = [], None, self.child, self.token_at
        for node, last, pending in self.states[state]:
            nxt = child.get(node << 8 | c)
            if nxt is None:
                continue
            hyps.append((nxt, last, pending))
            if ended is None and (tok := token_at[nxt]) >= 0 and self._follows(last, tok):
                ended = (0, tok, (*pending, tok))
        if ended is None:
            raise ValueError("the vocabulary lacks a byte")
        hyps.append(ended)
        told = hyps[0][2]
        for h in hyps[1:]:
            if not told:
                break
            other = h[2]
            if other[: len(told)] != told:
                n = 0
                while n < len(told) and n < len(other) and told[n] == other[n]:
                    n += 1
                told = told[:n]
        if told:
            cut = len(told)
            hyps = [(n, last, p[cut:]) for n, last, p in hyps]
        key = tuple(hyps)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state << 8 | c] = (to, told)
        return move

    def _simulate(self, state: int, rest: bytes) -> list[int]:
        """The rest of a piece without making states: the open hypotheses themselves are moved."""
        child, token_at, follows = self.child, self.token_at, self._follows
        hyps = [(node, last, (None, pending)) for node, last, pending in self.states[state]]
        for c in rest:
            new, ended = [], None
            for node, last, path in hyps:
                nxt = child.get(node << 8 | c)
                if nxt is None:
                    continue
                new.append((nxt, last, path))
                if ended is None and (tok := token_at[nxt]) >= 0 and follows(last, tok):
                    ended = (0, tok, (path, (tok,)))
            if ended is None:
                raise ValueError("the vocabulary lacks a byte")
            new.append(ended)
            hyps = new
        out, path = [], hyps[-1][2]
        while path is not None:
            out += reversed(path[1])
            path = path[0]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token. Where the cache of states is full, missing moves are simulated."""
        whole = self.ranks.get(piece)  # a piece that is itself a token is that token
        if whole is not None:
            return [whole]
        out: list[int] = []
        state, moves = 0, self.moves
        for at, c in enumerate(piece):
            move = moves.get(state << 8 | c)
            if move is None:
                if len(moves) >= CACHE // 2:
                    return out + self._simulate(state, piece[at:])
                move = self._step(state, c)
            state, told = move
            if told:
                out += told
        if piece:
            out += self.states[state][-1][2]
        return out


#: Next state of the UTF-8 machine: 0 accepts; 1-7 wait for continuation bytes; -1 is an error.
#: States: 1 one more byte; 2 two more; 3 three more; 4 after E0; 5 after ED; 6 after F0; 7 after F4.
def _utf8_next(state: int, c: int) -> int:
    if state == 0:
        if c < 0x80:
            return 0
        if 0xC2 <= c <= 0xDF:
            return 1
        if 0xE0 <= c <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(c, 2)
        if 0xF0 <= c <= 0xF4:
            return {0xF0: 6, 0xF4: 7}.get(c, 3)
        return -1
    low, high, to = ((0x80, 0xBF, 0), (0x80, 0xBF, 1), (0x80, 0xBF, 2), (0xA0, 0xBF, 1), (0x80, 0x9F, 1), (0x90, 0xBF, 2), (0x80, 0x8F, 2))[state - 1]
    return to if low <= c <= high else -1


class Utf8Stream:
    """Incremental UTF-8 state machine; malformed bytes become U+FFFD, one per maximal subpart."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, piece: bytes) -> str:
        data = self.held + piece
        # The machine needs only the last character's bytes: find the lead byte, run from there.
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            c = data[-back]
            if c < 0x80:
                break
            if c >= 0xC0:
                state = 0
                for x in data[-back:]:
                    state = _utf8_next(state, x)
                    if state <= 0:
                        break
                if state > 0:
                    cut = len(data) - back
                break
        self.held = data[cut:]
        return self._text(data[:cut])

    @staticmethod
    def _text(data: bytes) -> str:
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace")

    def flush(self) -> str:
        out, self.held = self._text(self.held), b""
        return out


#: Characters that are letters or numbers in newer Unicode tables than the tokenizer's: fixed values.
NOT_YET_LETTERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    "\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_NEW = re.compile(f"[{NOT_YET_LETTERS}]")
#: Neither letter, number nor white space in any version.
_STAND_IN = "\u0378"
#: White space before a space: there a space need not start a chunk.
_RUN = re.compile(r"\s ")


class _Chunks(dict):
    """Ids (little-endian bytes) of what stands between two spaces, the space before it included.

    A piece never reaches over a change from other characters to white space, so a text may be
    cut before each space that follows no white space, and the chunks encoded separately.

    What is full becomes the older half, and chunks of that half that come again move back, so
    frequent ones stay and at most ``CACHE`` are held.
    """

    def __init__(self, codec: Codec):
        self.codec = codec
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.pop(part, None)
        if ids is None:
            ids = self.codec.chunk_le32(" " + part)
        if len(part) <= 64:
            if len(self) >= CACHE // 2:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


class Codec:
    """Whole texts to token ids and back."""

    def __init__(self, raw: bytes, pattern: str):
        self.transducer = Transducer(load_ranks(raw))
        self._findall = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.chunks = _Chunks(self)
        self.vocab = self.transducer.bytes_of

    def split(self, text: str) -> list[str]:
        if text.isascii() or not _NEW.search(text):
            return self._findall(text)
        out, at = [], 0
        for piece in self._findall(_NEW.sub(_STAND_IN, text)):
            out.append(text[at : at + len(piece)])
            at += len(piece)
        return out

    def chunk_le32(self, text: str) -> bytes:
        """As :meth:`pieces_le32`; a chunk that is one piece is kept as a chunk only."""
        pieces = self.split(text)
        if len(pieces) == 1:
            ids = self.memo.get(pieces[0])
            return _le32(self.transducer.encode(pieces[0].encode())) if ids is None else ids
        return self._joined(pieces)

    def pieces_le32(self, text: str) -> bytes:
        return self._joined(self.split(text))

    def _joined(self, pieces: list[str]) -> bytes:
        memo, out = self.memo, []
        for piece in pieces:
            ids = memo.get(piece)
            if ids is None:
                ids = _le32(self.transducer.encode(piece.encode()))
                if len(piece) <= 64:
                    if len(memo) >= CACHE:
                        memo.clear()
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode_le32(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if _RUN.search(text):
            return self.pieces_le32(text)
        first, *parts = text.split(" ")
        return self.pieces_le32(first) + b"".join(map(self.chunks.__getitem__, parts))

    def encode(self, text: str) -> list[int]:
        return list(_from_le32(self.encode_le32(text)))

    def decode_stream(self, ids: array, step: int = 4096) -> Iterator[str]:
        machine, vocab = Utf8Stream(), self.vocab
        for at in range(0, len(ids), step):
            yield machine.feed(b"".join(map(vocab.__getitem__, ids[at : at + step])))
        yield machine.flush()

    def decode(self, ids: list[int]) -> str:
        return "".join(self.decode_stream(array("I", ids)))


def _le32(ids: list[int]) -> bytes:
    import sys

    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def _from_le32(raw: bytes) -> array:
    import sys

    a = array("I")
    a.frombytes(raw)
    if sys.byteorder == "big":
        a.byteswap()
    return a


def _codec(raw: bytes, pattern: str) -> Codec:
    codecs = held("bpe")
    key = (hashlib.md5(raw).digest(), pattern)
    if key not in codecs:
        codecs[key] = Codec(raw, pattern)
        # The tables live until the worker serves another operator; the collector need not walk them again and again.
        gc.freeze()
        gc.set_threshold(200_000, 50, 1000)
    return codecs[key]


def read_vocab(path: str) -> bytes:
    import os

    if os.path.getsize(path) > MAX_VOCAB_BYTES:
        raise ValueError(f"vocabulary over {MAX_VOCAB_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null text counts as empty. Narrow: no shuffle."""
    raw = docs.sparkSession.sparkContext.broadcast(read_vocab(vocab_path))

    def run(batches):
        codec = _codec(raw.value, pattern)
        for batch in batches:
            for rows in rows_of(batch):
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()), "ids": pa.array([codec.encode(r["text"]) for r in rows], pa.list_(pa.int32()))}
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocab_path: str, pattern: str = ".") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    raw = encoded.sparkSession.sparkContext.broadcast(read_vocab(vocab_path))

    def run(batches):
        codec = _codec(raw.value, pattern)
        for batch in batches:
            for rows in rows_of(batch):
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()), "text": pa.array([codec.decode(r["ids"] or []) for r in rows], pa.string())}
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and give both digests.

    (doc_id, n_tokens, ids_sha256, decoded_sha256). Null text counts as empty (0 tokens); rows
    with a null or repeated id are encoded like any other; other columns are ignored. One narrow
    pass: memory is one text and a bounded cache, whatever the table's size.
    """
    raw = docs.sparkSession.sparkContext.broadcast(read_vocab(vocab_path))

    def run(batches):
        codec = _codec(raw.value, pattern)
        for batch in batches:
            for rows in rows_of(batch):
                n, ids_sha, dec_sha = [], [], []
                for r in rows:
                    ids = codec.encode_le32(r["text"])
                    digest = hashlib.sha256()
                    for part in codec.decode_stream(_from_le32(ids)):
                        digest.update(part.encode())
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    dec_sha.append(digest.hexdigest())
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(dec_sha, pa.string())}
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
