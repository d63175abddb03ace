"""Language ID: a linear-chain conditional random field labels the words of a text.

Each word has affix, character n-gram and lexicon features, hashed to a fixed table of weights;
learned transitions say how languages follow each other. Forward-backward gives every word's
posterior, and the letters' mean posterior names the document's language.

Labels are known for documents, not words, so the field is fitted on chains of passages from
documents of different languages (code-switched text whose labels are known).

Forward-backward runs on many documents at once: all words of a batch form one chain, in which a
document starts with a uniform transition, and the chain is cut into rows that advance in step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, held, quoted, row_key, rows_of

#: Labelled rows that the field is fitted on: of each language, and of all (but one of each language at least).
ROWS_PER_LANG, SAMPLE_ROWS = 200, 12_800
#: Passages of one such row, spread over its whole text.
PASSAGES = 64
#: Hashed features, sweeps over the sample, words of a passage.
FEATURES, SWEEPS, PASSAGE = 1 << 18, 20, 40
#: Letters of one word of the chain; longer tokens become several words.
WORD = 60
#: Distinct tokens whose emissions a worker keeps.
KNOWN = 300_000


def clean(token: str) -> str:
    """The letters of a token, and nothing that only counts as part of a word (digits, fractions, numerals)."""
    low = token.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def pieces(token: str) -> list[str]:
    """The token, or if it is long its letters in words of at most ``WORD``."""
    if len(token) <= WORD:
        return [token]
    w = clean(token)
    return [w[i : i + WORD] for i in range(0, len(w), WORD)] or [token]


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hashed feature): affixes up to four letters, bi- and trigrams, the lexicon's word and language."""
    shown = [f"^{w}$" for w in words]
    size = np.fromiter(map(len, shown), np.int64, len(shown))
    code = np.frombuffer("".join(shown).encode("utf-32-le"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(shown)), size)
    first = np.r_[0, np.cumsum(size)[:-1]]
    last = first + size
    out = []

    def add(owner: np.ndarray, value: np.ndarray, kind: int) -> None:
        x = (value + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((owner, (x >> np.uint64(40)).astype(np.int64) & (FEATURES - 1)))

    m = np.uint64(0x100000001B3)
    two = code[:-1] * m + code[1:]
    ok = own[:-1] == own[1:]
    add(own[:-1][ok], two[ok], 1)
    three = two[:-1] * m + code[2:]
    ok = own[:-2] == own[2:]
    add(own[:-2][ok], three[ok], 2)
    every = np.arange(len(shown))
    for k in (2, 3, 4, 5):
        long = every[size >= k]
        pre = np.zeros(len(long), np.uint64)
        suf = np.zeros(len(long), np.uint64)
        for i in range(k):
            pre = pre * m + code[first[long] + i]
            suf = suf * m + code[last[long] - k + i]
        add(long, pre, 10 + k)
        add(long, suf, 20 + k)
    lex = [(i, zlib.crc32(w.encode()), lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if lex:
        i, word, lang = (np.array(x) for x in zip(*lex, strict=True))
        add(i, word.astype(np.uint64), 30)
        add(i, lang.astype(np.uint64), 31)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


class Field:
    """The fitted field: languages, hashed weights (features x languages), transitions, lexicon."""

    def __init__(self, langs: list[str], lexicon: dict[str, int]):
        k = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.weights = np.zeros((FEATURES, k), np.float32)
        self.moves = np.zeros((k, k)) + 3 * np.eye(k)

    def emissions(self, words: list[str]) -> np.ndarray:
        k = len(self.langs)
        if not words:
            return np.zeros((0, k))
        owner, flat = features(words, self.lexicon)
        size = np.bincount(owner, minlength=len(words))
        total = np.stack([np.bincount(owner, self.weights[flat, j], len(words)) for j in range(k)], axis=1)
        return total / np.sqrt(size)[:, None]


def forward_backward(score: np.ndarray, start: np.ndarray, moves: np.ndarray, row: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors (n x k) of a chain, and its (forward, backward) vectors, each scaled to sum 1.

    ``start`` marks words before which the chain begins anew.
    """
    n, k = score.shape
    step = np.exp(moves - moves.max())
    rows = -(-n // row)
    b = np.ones((rows * row, k))
    b[:n] = np.exp(score - score.max(axis=1, keepdims=True))
    fresh = np.ones(rows * row, bool)
    fresh[:n] = start
    fresh[0] = True
    b, fresh = b.reshape(rows, row, k), fresh.reshape(rows, row)

    def scaled(x: np.ndarray, axes) -> np.ndarray:
        return x / np.maximum(x.max(axis=axes, keepdims=True), 1e-300)

    # Each row's product of step matrices.
    whole = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for t in range(row):
        moved = whole @ step
        f = fresh[:, t]
        if f.any():
            moved[f] = whole[f].sum(axis=2, keepdims=True)
        whole = scaled(moved * b[:, t, None, :], (1, 2))
    ahead = np.empty((rows, k))  # forward vector at each row's entry
    v = np.ones(k)
    for r in range(rows):
        ahead[r] = v
        v = v @ whole[r]
        v /= max(v.sum(), 1e-300)
    behind = np.empty((rows, k))  # backward vector at each row's exit
    v = np.ones(k)
    for r in range(rows - 1, -1, -1):
        behind[r] = v
        v = whole[r] @ v
        v /= max(v.sum(), 1e-300)
    alpha, beta = np.empty((rows, row, k)), np.empty((rows, row, k))
    v = ahead
    for t in range(row):
        moved = v @ step
        f = fresh[:, t]
        if f.any():
            moved[f] = 1.0
        v = moved * b[:, t]
        v = v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
        alpha[:, t] = v
    v = behind
    for t in range(row - 1, -1, -1):
        beta[:, t] = v
        seen = v * b[:, t]
        v = seen @ step.T
        f = fresh[:, t]
        if f.any():
            v[f] = seen[f].sum(axis=1, keepdims=True)
        v = v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
    alpha, beta = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]
    post = alpha * beta
    post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
    return post, alpha, beta


def fit(rows: list[tuple[str, str]], sweeps: int = SWEEPS, seed: int = 7) -> Field | None:
    """A field from (text, language) rows, by gradient ascent on the chains' log-likelihood."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    types: dict[str, int] = {}
    passages = []
    for text, lang in rows:
        ids = [types.setdefault(w, len(types)) for token in text.split() for part in pieces(token) if (w := clean(part))]
        passages += [(number[lang], ids[i : i + PASSAGE]) for i in range(0, len(ids), PASSAGE)]
    if not passages:
        return None
    rng = np.random.default_rng(seed)
    passages = [passages[i] for i in rng.permutation(len(passages))]
    words = np.concatenate([np.array(p, np.int64) for _, p in passages])
    label = np.repeat([k for k, _ in passages], [len(p) for _, p in passages])
    n, k, u = len(words), len(langs), len(types)
    count = np.zeros((u, k))
    np.add.at(count, (words, label), 1)
    names = list(types)
    most = count.max(axis=1)
    lexicon = {names[i]: int(count[i].argmax()) for i in np.flatnonzero((most >= 5) & (most >= 0.9 * count.sum(axis=1)))}
    field = Field(langs, lexicon)
    owner, flat = features(names, lexicon)
    norm = np.sqrt(np.bincount(owner, minlength=u))[:, None]
    start = np.zeros(n, bool)
    start[:: 16 * PASSAGE] = True
    weight = n / (k * np.maximum(np.bincount(label, minlength=k), 1))  # rare languages count as much
    seen_moves = np.zeros((k, k))
    inner = np.flatnonzero(~start)
    inner = inner[inner > 0]
    np.add.at(seen_moves, (label[inner - 1], label[inner]), 1)
    square, square_moves = np.full(field.weights.shape, 1e-4), np.full((k, k), 1e-4)
    for _ in range(sweeps):
        score = (np.stack([np.bincount(owner, field.weights[flat, j], u) for j in range(k)], axis=1) / norm)[words]
        post, alpha, beta = forward_backward(score, start, field.moves)
        miss = -post
        miss[np.arange(n), label] += 1
        miss *= weight[label][:, None]
        by_type = np.stack([np.bincount(words, miss[:, j], u) for j in range(k)], axis=1) / norm
        grad = np.stack([np.bincount(flat, by_type[owner, j], FEATURES) for j in range(k)], axis=1) / n - 1e-6 * field.weights
        square += grad**2
        field.weights += (0.5 * grad / np.sqrt(square)).astype(np.float32)
        step = np.exp(field.moves - field.moves.max())
        b = np.exp(score - score.max(axis=1, keepdims=True)) * beta
        pair = alpha[inner - 1].T @ (b[inner] / np.maximum(((alpha[inner - 1] @ step) * b[inner]).sum(axis=1, keepdims=True), 1e-300)) * step
        grad_moves = (seen_moves - pair) / n
        square_moves += grad_moves**2
        field.moves += 0.1 * grad_moves / np.sqrt(square_moves)
    return field


class Labeller:
    """Documents' languages by a fitted field; emissions of known tokens are kept."""

    def __init__(self, field: Field):
        self.field = field
        self.reset()

    def reset(self) -> None:
        k = len(self.field.langs)
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, k))
        self.letters = np.zeros(1024, np.int64)

    def _learn(self, tokens: list[str]) -> None:
        """Emissions of tokens not yet known; a token without letters has none and no weight."""
        words = [clean(t) for t in tokens]
        with_letters = [i for i, w in enumerate(words) if w]
        e = self.field.emissions([words[i] for i in with_letters])
        base, need = len(self.row), len(self.row) + len(tokens)
        while need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.table[base:need] = 0
        self.table[[base + i for i in with_letters]] = e
        self.letters[base:need] = [len(w) for w in words]
        self.row.update({t: base + i for i, t in enumerate(tokens)})

    def words(self, texts: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """Per text its tokens (long ones in pieces), their posteriors and letters."""
        split = [[p for token in t.split() for p in pieces(token)] for t in texts]
        if len(self.row) > KNOWN:
            self.reset()
        new = {tok for toks in split for tok in toks if tok not in self.row}
        if new:
            self._learn(sorted(new))
        size = np.array([len(x) for x in split])
        n = int(size.sum())
        k = len(self.field.langs)
        if not n:
            return [(x, np.zeros((0, k)), np.zeros(0, np.int64)) for x in split]
        get = self.row.__getitem__
        ids = np.fromiter((i for toks in split for i in map(get, toks)), np.int64, n)
        at = np.r_[0, np.cumsum(size)]
        start = np.zeros(n + 1, bool)
        start[at[:-1]] = True
        post, _, _ = forward_backward(self.table[ids], start[:n], self.field.moves)
        letters = self.letters[ids]
        return [(x, post[at[i] : at[i + 1]], letters[at[i] : at[i + 1]]) for i, x in enumerate(split)]

    def documents(self, texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for _, post, letters in self.words(texts):
            if not letters.sum():
                out.append(("und", 0.0))
                continue
            share = (post * letters[:, None]).sum(axis=0) / letters.sum()
            best = int(share.argmax())
            out.append((self.field.langs[best], float(min(1.0, share[best]))))
        return out


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(quoted(id_col).cast("string")) % 4 == 2, F.lit(False))


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole short texts; of a long one ``PASSAGES`` passages of ``PASSAGE`` words at even distances."""
    held("lang_id")
    for batch in batches:
        out = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = [p for token in (text.as_py() or "").split() for p in pieces(token)]
            starts = np.arange(0, len(words), PASSAGE)
            if len(starts) > PASSAGES:
                starts = starts[np.linspace(0, len(starts) - 1, PASSAGES).astype(int)]
            out += [(lang, " ".join(words[i : i + PASSAGE])) for i in starts.tolist()]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in out], pa.string()), "text": pa.array([x for _, x in out], pa.string())})


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = ROWS_PER_LANG) -> Field | None:
    """A field from a sample of the labelled rows of every language there is, chosen by a hash of the id.

    At most ``per_lang`` rows of a language and ``SAMPLE_ROWS`` in all, with passages from each
    text's whole length; a language has one row at least, whatever the number of languages. Ties
    are settled by id and text, and repeated rows count once, so the field is the same every time.
    """
    may = docs.where(quoted(lang_col).isNotNull() & quoted(id_col).isNotNull() & ~held_out(id_col))
    may = may.select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).alias("text"), quoted(id_col).alias("id"), row_key(id_col, text_col).alias("rk"))
    langs = may.select("lang").distinct().count()
    if not langs:
        return None
    each = max(1, min(per_lang, SAMPLE_ROWS // langs))
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "rk")
    chosen = may.select("lang", "id", "rk").withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("rk").distinct()
    rows = may.join(F.broadcast(chosen), "rk").dropDuplicates(["rk", "lang"]).select("lang", "text")  # SAMPLE_ROWS keys, or one a language
    got = sorted((r.lang, r.text) for r in rows.mapInArrow(_passages, "lang string, text string").collect())
    return fit([(text, lang) for lang, text in got])


def identify(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text; a narrow pass.

    ``und`` with score 0 where the text is null or has no letter, or nothing could be learned.
    Of languages with the same share the first by name is named. Null ids count as not held out;
    repeated rows are labelled alike; a text may be of any length and counts whole; an empty table
    gives an empty result; other columns are ignored.
    """
    slim = docs.select(quoted(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    if field is None:
        return slim.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, key = held("lang_id"), id(model.value)
        if key not in ready:
            ready.clear()
            ready[key] = Labeller(model.value)
        lab = ready[key]
        for batch in batches:
            for rows in rows_of(batch):
                got = lab.documents([r["text"] for r in rows])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()),
                        "held_out": pa.array([r["held_out"] for r in rows], pa.bool_()),
                        "lang_pred": pa.array([g[0] for g in got], pa.string()),
                        "score": pa.array([g[1] for g in got], pa.float64()),
                    }
                )

    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, min_score: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without rows whose text has no letter or no language of that score; columns unchanged.

    Each row is judged by its own text in one narrow pass, so null and repeated ids are no matter.
    Where no row is labelled, only those without a letter go.
    """
    field = learn(docs, id_col, text_col, lang_col)
    if field is None:
        return docs.where(quoted(text_col).rlike(r"\p{L}"))
    model = docs.sparkSession.sparkContext.broadcast(field)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("lang_id")
        lab = Labeller(model.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = lab.documents([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([g[0] != "und" and g[1] >= min_score for g in got], pa.bool_()))
        del lab
        give_back()

    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.mapInArrow(run, plain.schema).toDF(*names)
