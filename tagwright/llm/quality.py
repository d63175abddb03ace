"""Quality by co-training: a text view and a metadata view teach each other, then score together.

Each view has a logistic model of its own, fitted on labelled rows. In each round either model labels
all documents of the corpus that it is sure of, for the other one to learn from: one narrow pass sums
up their features by class and cell (a hash of language and source), and those means are further rows
of the other model's next fit. At the end both are calibrated on labelled rows kept aside, and their
evidence (log-odds over the prior) is added up for every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, rows_of

#: Labelled rows that the models are fitted on, by a hash of the id.
LABELLED = 2000
#: Rounds of exchange, least probability of a pseudo-label, weight of all pseudo-labels against the labelled rows.
ROUNDS, SURE, TRUST = 2, 0.9, 0.5
#: Cells by which pseudo-labelled documents are summed up, for each class and view.
CELLS = 8
#: Hashed words of the text view; hashed values of the metadata view.
WORDS, VALUES = 1024, 512
_SYMBOL = re.compile(r"[#$%&*|<>{}\[\]\\^~=@_]")
_memo: dict[str, int] = {}


def _bucket(word: str) -> int:
    got = _memo.get(word)
    if got is None:
        if len(_memo) >= 300_000:
            _memo.clear()
        got = _memo[word] = zlib.crc32(word.encode()) % WORDS
    return got


def text_view(text: str) -> np.ndarray:
    """Shares and rates of a whole text, and which hashed words it has."""
    out = np.zeros(14 + WORDS, np.float32)
    out[0] = 1
    if not text:
        out[1] = 1
        return out
    ws = text.split()
    n, chars = max(1, len(ws)), len(text)
    distinct = set(ws)
    lines = [x for x in text.split("\n") if x]
    out[2:14] = (
        np.log1p(n) / 8,
        chars / n / 10,
        len(distinct) / n,
        min(1.0, 10 * len(_SYMBOL.findall(text)) / chars),
        sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, 5 * (text.count(".") + text.count(",")) / n),
        len(lines) / n,
        sum(map(str.isdigit, text)) / chars if any(c in text for c in "0123456789") else 0,
        1 - len(text.encode("ascii", "ignore")) / chars,
        min(1.0, n / 20),
        (distinct.__len__() < 5) * 1.0,
    )
    ids = np.fromiter(map(_bucket, distinct), np.int64, len(distinct))
    np.add.at(out, 14 + ids, np.float32(1 / np.sqrt(max(1, len(distinct)))))
    return out


def meta_view(lang: str | None, source: str | None, chars: int | None) -> np.ndarray:
    out = np.zeros(1 + VALUES, np.float32)
    out[0] = 1
    size = -1 if chars is None or chars < 0 else int(2 * np.log2(chars + 1))
    for v in (f"lang={lang}", f"source={source}", f"size={size}", f"{lang}|{size // 4}"):
        out[1 + zlib.crc32(v.encode()) % VALUES] = 1
    return out


class Logistic:
    def __init__(self, width: int):
        self.w = np.zeros(width, np.float32)
        self.a, self.b = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 80, ridge: float = 1e-3) -> Logistic:
        self.w[:] = 0
        square = np.full(len(self.w), 1e-6, np.float32)
        weight = (weight / weight.sum()).astype(np.float32)
        back = np.ascontiguousarray(x.T)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(x @ self.w)))
            g = back @ (weight * (y - p).astype(np.float32)) - ridge * self.w
            square += g * g
            self.w += 0.3 * g / np.sqrt(square)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        f = x @ self.w
        a, b = 1.0, 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-(a * f + b)))
            w = np.maximum(p * (1 - p), 1e-4)
            grad = np.array([((y - p) * f).sum() - (a - 1), (y - p).sum()])
            hess = np.array([[(w * f * f).sum() + 1, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-3]])
            step = np.clip(np.linalg.solve(hess, grad), -1, 1)
            a, b = a + step[0], b + step[1]
        self.a, self.b = max(a, 0.0), b

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * (x @ self.w) + self.b, -12, 12)


class CoTrained:
    def __init__(self, text: Logistic, meta: Logistic, prior: float):
        self.text, self.meta, self.prior = text, meta, prior

    def score(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.odds(t), self.meta.odds(m)
        sig = lambda f: 1 / (1 + np.exp(-f))
        return sig(a), sig(b), sig(a + b - self.prior)


class Told:
    """Sums of the features of confidently labelled documents: for the view that learns, by class and cell."""

    def __init__(self, models: list[Logistic]):
        self.models = models
        self.sums = [np.zeros((2, CELLS, len(m.w))) for m in models]
        self.counts = [np.zeros((2, CELLS)) for _ in models]

    def add(self, rows: list[tuple]) -> None:
        """Rows (text, lang, source, n_chars)."""
        views = [np.stack([text_view(r[0]) for r in rows]), np.stack([meta_view(*r[1:4]) for r in rows])]
        cell = np.array([zlib.crc32(f"{r[1]}|{r[2]}".encode()) % CELLS for r in rows])
        for k in (0, 1):
            p = 1 / (1 + np.exp(-(views[k] @ self.models[k].w)))
            for side, sure in ((1, p >= SURE), (0, p <= 1 - SURE)):
                np.add.at(self.sums[1 - k][side], cell[sure], views[1 - k][sure])
                np.add.at(self.counts[1 - k][side], cell[sure], 1)

    def rows(self) -> Iterator[tuple[int, int, int, int, float]]:
        """(view, side, cell, place, value) of what is not 0; place -1 is the count."""
        for k in (0, 1):
            for side, cell in zip(*np.nonzero(self.counts[k]), strict=True):
                yield k, int(side), int(cell), -1, float(self.counts[k][side, cell])
                for i in np.flatnonzero(self.sums[k][side, cell]):
                    yield k, int(side), int(cell), int(i), float(self.sums[k][side, cell, i])

    def take(self, rows: Iterable[tuple[int, int, int, int, float]]) -> Told:
        for k, side, cell, place, value in rows:
            if place < 0:
                self.counts[k][side, cell] += value
            else:
                self.sums[k][side, cell, place] += value
        return self

    def lesson(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Means, classes and shares of the documents, for view k."""
        side, cell = np.nonzero(self.counts[k])
        n = self.counts[k][side, cell]
        return (self.sums[k][side, cell] / n[:, None]).astype(np.float32), side.astype(float), n / max(1.0, n.sum())


def co_train(labelled: list[tuple], exchange: Callable[[list[Logistic]], Told], rounds: int = ROUNDS, seed: int = 9) -> CoTrained | None:
    """From rows (text, lang, source, n_chars, quality); ``exchange`` asks the models about all documents."""
    if not labelled:
        return None
    y = np.array([float(r[4]) for r in labelled])
    views = [np.stack([text_view(r[0]) for r in labelled]), np.stack([meta_view(*r[1:4]) for r in labelled])]
    aside = np.random.default_rng(seed).random(len(y)) < 0.2
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        aside[:] = False
    learn = ~aside
    models = [Logistic(v.shape[1]).fit(v[learn], y[learn], np.ones(learn.sum())) for v in views]
    for _ in range(rounds):
        told = exchange(models)
        for k in (0, 1):
            x, side, share = told.lesson(k)
            models[k].fit(np.concatenate([views[k][learn], x]), np.r_[y[learn], side], np.r_[np.ones(learn.sum()), share * learn.sum() * TRUST])
    rows = aside if aside.any() else learn
    for k in (0, 1):
        models[k].calibrate(views[k][rows], y[rows])
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    return CoTrained(models[0], models[1], float(np.log(rate / (1 - rate))))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def learn(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> CoTrained | None:
    """Fit on at most ``LABELLED`` labelled rows, chosen by a hash of the id (ties by id and text; repeated
    rows count once, and of several labels of an id the least), and on all documents of either view's
    confident labels, whatever their number: they travel as sums, a fixed number of them a task."""
    slim = _slim(docs).withColumn("rk", row_key("doc_id", "text"))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    some = slim.select("doc_id", "rk").join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "rk").limit(LABELLED)
    got = slim.join(F.broadcast(some.select("rk", "quality")), "rk").dropDuplicates(["rk"]).collect()  # LABELLED rows
    got.sort(key=lambda r: (r.doc_id, r.rk))

    def exchange(models: list[Logistic]) -> Told:
        held = docs.sparkSession.sparkContext.broadcast(models)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told = Told(held.value)
            for batch in batches:
                for rows in rows_of(batch):
                    told.add([(r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows])
            out = list(zip(*told.rows(), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in out[:4]), pa.array(out[4], pa.float64())], ["view", "side", "cell", "place", "value"])

        sums = slim.select("text", "lang", "source", "n_chars").mapInArrow(run, "view int, side int, cell int, place int, value double")
        sums = sums.groupBy("view", "side", "cell", "place").agg(F.sum("value").alias("value"))
        return Told(models).take(tuple(r) for r in sums.collect())  # at most 4 x CELLS feature vectors

    return co_train([(r.text, r.lang, r.source, r.n_chars, r.quality) for r in got], exchange, rounds)


def score(docs: DataFrame, model: CoTrained | None, keep_from: float = 0.5) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) of every whole document; a narrow pass.

    Null text is empty text, and a text of any length counts whole; null metadata is a value of its
    own. Without labels (no model) every score is 0.5 and every document is kept. Null and repeated
    ids are scored like others, equal rows alike. An empty table gives an empty result; columns
    other than doc_id, text, lang, source and n_chars are ignored.
    """
    slim = _slim(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch):
                if held.value is None:
                    p = [np.full(len(rows), 0.5)] * 3
                else:
                    p = held.value.score(np.stack([text_view(r["text"]) for r in rows]), np.stack([meta_view(r["lang"], r["source"], r["n_chars"]) for r in rows]))
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), *(pa.array(x, pa.float64()) for x in p)], ["doc_id", "p_text", "p_meta", "score"])

    return slim.mapInArrow(run, "doc_id long, p_text double, p_meta double, score double").withColumn("keep", F.col("score") >= keep_from)
