"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds choose.

Base spans follow fixed patterns and always stay. Generators with high recall propose further,
overlapping spans (numbers without a plus sign, spelled-out addresses, IPv6, other card formats);
trees over format and context features give each a calibrated probability. Of the proposals that
reach their kind's threshold, the likelier of two that overlap is chosen.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of
from .gbt import Boosted

KINDS = ("email", "ip", "card", "phone")
#: Least calibrated probability of a proposal, by kind.
THRESHOLDS = {"email": 0.9, "ip": 0.9, "card": 0.95, "phone": 0.95}
#: Code points before and after a proposal that its features see.
CONTEXT = 32
#: Generated examples that the trees are fitted on.
EXAMPLES = 4000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits fails as the run's first does, so only run starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, in linear time: a local part always ends at its @ sign."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, leftmost and non-overlapping; matches that fail a condition are dropped."""
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


_AT = re.compile(r"\s?(?:\[at\]|\(at\)|\{at\}|@)\s?|\sat\s", re.I)
_BEFORE = re.compile(r"[A-Za-z0-9._%+-]{2,64}\Z")
_AFTER = re.compile(r"[A-Za-z0-9-]{2,63}(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\}|\sdot\s)\s?[A-Za-z]{2,20}){1,4}", re.I)
_NUMBER = re.compile(r"(?<![0-9A-Za-z.])\(?[0-9][0-9 ()./-]{5,28}[0-9](?![0-9A-Za-z])")
_V6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::|[0-9A-Fa-f]{1,4})(?::[0-9A-Fa-f]{1,4}){0,5}(?![0-9A-Za-z:])")


def proposals(text: str) -> list[tuple[str, int, int]]:
    """High-recall proposals of further spans; they may overlap."""
    out = []
    for m in _AT.finditer(text):
        b = _BEFORE.search(text[max(0, m.start() - 64) : m.start()])
        a = _AFTER.match(text, m.end())
        if a and b:
            out.append(("email", m.start() - len(b[0]), a.end()))
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            start = m.start() - (m.start() > 0 and text[m.start() - 1] == "+")
            if 7 <= n <= 15:
                out.append(("phone", start, m.end()))
            if 13 <= n <= 19:
                out.append(("card", m.start(), m.end()))
        if ":" in text:
            out += [("ip", *m.span()) for m in _V6.finditer(text)]
    return out


_CUES = {
    "email": re.compile(r"e-?mail|mailto|contact|write|reach", re.I),
    "ip": re.compile(r"\bip\b|addr|host|server|ping|login", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|\btel|call|fax|mobil|cell|dial|ruf|tél|llam", re.I),
    "other": re.compile(r"order|invoice|isbn|version|\bv\.?$|serial|\bno\.|#|ref|\bid\b|page|date|doi|art\.|part", re.I),
}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)?\d\d")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    digits = "".join(c for c in s if c.isdigit())
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups = [len(g) for g in re.findall(r"\d+", s)]
    return [
        *(float(kind == k) for k in KINDS),
        len(s),
        len(digits),
        len(digits) / len(s),
        len(groups),
        max(groups, default=0),
        groups[-1] if groups else 0,
        s.count("-") + s.count(" "),
        s.count("."),
        s.count("/"),
        float("(" in s and ")" in s),
        float(s[:1] == "+"),
        float(bool(digits) and luhn(digits)),
        len(set(digits)),
        float(groups in ([3, 3, 4], [4, 4, 4, 4], [4, 6, 5], [1, 3, 3, 4])),
        float(bool(_DATE.search(s))),
        s.count(":"),
        float("::" in s),
        len(re.findall(r"[a-fA-F]", s)),
        float("@" in s),
        float(bool(re.search(r"[\[({](?:at|dot)[\])}]", s, re.I))),
        float(bool(re.search(r"\sdot\s", s, re.I))),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        *(float(bool(cue.search(before))) for cue in _CUES.values()),
    ]


def examples(n: int = EXAMPLES, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Generated proposals in prose: personal data in many formats, and numbers that look like it."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    syll = ("an", "er", "tion", "ing", "th", "re", "on", "ed", "le", "ou", "de", "ar", "en", "sch")
    word = lambda: "".join(pick(*syll) for _ in range(rng.integers(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))

    def card(k: int) -> str:
        body = pick("4", "51", "37", "6011") + num(14)
        body = body[: k - 1]
        return next(body + c for c in "0123456789" if luhn(body + c))

    x, y = [], []
    while len(y) < n:
        cue = rng.random() < 0.7
        good = True
        match rng.integers(12):
            case 0:
                kind, s, c = "phone", pick("({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}", "1-{}-{}-{}").format(num(3), num(3), num(4)), pick("phone", "call", "tel.", "mobile:", "fax")
                good = cue or "(" in s
            case 1:
                kind, s, c = "email", f"{word()}{pick('[at]', '(at)', ' [at] ', ' (at) ')}{word()}{pick('[dot]', ' (dot) ', '.', ' [dot] ')}{pick('com', 'org', 'net', 'de')}", pick("mail", "contact", "write to")
            case 2:
                kind, s, c = "ip", ":".join(f"{v:x}" for v in rng.integers(0, 65536, 8)), pick("host", "ip", "server", "login from")
            case 3:
                raw = card(pick(15, 16))
                kind, s, c = "card", f"{raw[:4]}{pick('.', '/', ' ')}{raw[4:10]}{pick('.', '/', ' ')}{raw[10:]}", pick("card", "visa", "credit card", "amex")
                good = cue
            case 4:
                kind, s, c, good = "phone", f"{rng.integers(1950, 2030)}-{num(2)}-{num(2)}", pick("date", "on", "since"), False
            case 5:
                kind, s, c, good = "phone", num(rng.integers(7, 14)), pick("order", "invoice", "serial", "id", "ref"), False
            case 6:
                kind, s, c, good = "card", num(rng.integers(13, 20)), pick("order", "serial", "isbn", "ref", "part"), False
            case 7:
                kind, s, c, good = "ip", f"{num(2)}:{num(2)}:{num(2)}", pick("at", "from", "until"), False
            case 8:
                kind, s, c, good = "email", f"{word()} at {word()}{pick('. ', '.')}{word()}", pick("look", "was", "met"), False
            case 9:
                kind, s, c, good = "phone", f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", pick("isbn", "no.", "part"), False
            case 10:
                kind, s, c, good = "phone", " ".join(num(rng.integers(1, 5)) for _ in range(rng.integers(3, 6))), pick("page", "and", "of"), False
            case _:
                kind, s, c, good = "card", " ".join(num(3) for _ in range(5)), pick("table", "row", "of", "in"), False
        lead = f"{prose(4)} {c if cue or not good else ''} "
        text = f"{lead}{s} {prose(3)}"
        x.append(features(text, kind, len(lead), len(lead) + len(s)))
        y.append(good)
    return np.array(x, float), np.array(y)


def train() -> Boosted:
    return Boosted().fit(*examples())


def find(text: str, model: Boosted | None) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """(base spans by kind, further spans chosen by the model)."""
    base = base_spans(text)
    if model is None:
        return base, []
    open_ = [p for p in proposals(text) if not any(a < p[2] and p[1] < b for k in KINDS for a, b in base[k])]
    if not open_:
        return base, []
    prob = model.probability(np.array([features(text, *p) for p in open_], float))
    chosen: list[tuple[str, int, int]] = []
    for i in sorted(range(len(open_)), key=lambda i: (-prob[i], open_[i][1], open_[i][0])):
        kind, a, b = open_[i]
        if prob[i] >= THRESHOLDS[kind] and not any(x < b and a < y for _, x, y in chosen):
            chosen.append(open_[i])
    return base, chosen


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span (overlapping ones together) replaced by its kind in brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, model: Boosted | None = None, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans[, redacted]) of every whole text.

    Counts and digest are of the base spans; ``spans`` lists base and chosen ones as
    kind:start:end in code points. Null text counts as empty. Ids are not looked at; other
    columns are ignored. One narrow pass; the model is a few kilobytes.
    """
    held = docs.sparkSession.sparkContext.broadcast(model if model is not None else train())
    names = [f"n_{k}" for k in KINDS]
    fields = [("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base_sha256", pa.string()), ("spans", pa.string())]
    arrow = pa.schema(fields + ([("redacted", pa.string())] if redacted else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch):
                out = []
                for r in rows:
                    base, more = find(r["text"], held.value)
                    all_ = {k: base[k] + [(a, b) for kind, a, b in more if kind == k] for k in KINDS}
                    row = {"doc_id": r["doc_id"], "base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(all_)}
                    row |= {f"n_{k}": len(base[k]) for k in KINDS}
                    if redacted:
                        row["redacted"] = redact(r["text"], [(k, a, b) for k in KINDS for a, b in all_[k]])
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    schema = "doc_id long, " + "".join(f"{n} long, " for n in names) + "base_sha256 string, spans string" + (", redacted string" if redacted else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)
