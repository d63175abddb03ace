"""Main-text extraction: boosted trees over DOM nodes, decoded along the tree.

Every element gets features (text density of its subtree, link share, attribute tokens, depth,
siblings) and a calibrated probability of being main content, from trees fitted on generated
pages. Labels are then chosen for the whole tree at once: below the root, an element is *outer*
(a frame that holds both), *main* or *aside*; outer elements may hold any label, main ones main
or aside, aside ones only aside. So no choice contradicts an ancestor's.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of
from .gbt import Boosted

#: Generated pages that the trees are fitted on.
PAGES = 160
#: Log-odds that an element inside main content needs to be set aside.
SWITCH = 3.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Never text of a page: scripts, styles, head matter, form controls, embedded things.
HIDDEN = frozenset("head script style title textarea noscript iframe template svg select option button object embed canvas audio video math xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the key closes an open element of the value, up to the scope's edge.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_EDGE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "body": set()}

_TAG = re.compile(r"<(?:!--(?P<comment>)|(?P<decl>[!?])|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*))")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "depth")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0


def parse(page: str) -> Node:
    """A forgiving parse: implied ends, unclosed and stray tags, raw text, comments."""
    root = at_node = Node("#root", "", None)
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            at_node.parts.append(page[at:])
            break
        if m.start() > at:
            at_node.parts.append(page[at : m.start()])
        if m["comment"] is not None:
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if m["decl"]:
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        rest = _REST.match(page, m.end())
        close = rest.end() if rest else page.find(">", m.end()) + 1
        if not close:  # no end of the tag: what follows is not text
            break
        attrs, tag = page[m.end() : close - 1], m["name"].lower()
        at = close
        if m["end"]:
            x = at_node
            while x is not root and x.tag != tag:
                x = x.parent
            if x is not root:
                at_node = x.parent
            continue
        if tag in BLOCKS:  # a block ends an open paragraph
            at_node = _closed(at_node, {"p"}, BLOCKS - {"p"})
        if tag in _CLOSES:
            at_node = _closed(at_node, _CLOSES[tag], _EDGE[tag])
        node = Node(tag, attrs, at_node)
        at_node.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            node.parts.append(page[at:stop])
            at = stop
            if end:
                gt = page.find(">", stop)
                at = n if gt < 0 else gt + 1
        elif tag not in VOID and not attrs.endswith("/"):
            at_node = node
    return root


def _closed(node: Node, tags: set[str], edge: set[str] | frozenset[str]) -> Node:
    x = node
    while x.parent is not None:
        if x.tag in tags:
            return x.parent
        if x.tag in edge:
            return node
        x = x.parent
    return node


_ASIDE = ("nav", "menu", "header", "footer", "side", "aside", "ad", "ads", "advert", "banner", "promo", "sponsor", "cookie", "consent", "notice", "comment", "comments", "reply", "form", "search", "share", "social", "related", "breadcrumb", "popup", "modal", "subscribe", "newsletter", "login", "toolbar", "widget", "disclaimer", "copyright")
_MAIN = ("article", "content", "main", "post", "body", "entry", "story", "text", "page")
_TOKEN = re.compile(r"[a-z]+")
_GROUPS = ("article", "main", "section", "div", "p", "h1", "h2", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "td", "blockquote", "pre", "body", "figure")
_FORM = frozenset("input button select textarea label".split())


@lru_cache(4096)
def _tokens(attrs: str) -> frozenset[str]:
    if "class" not in (low := attrs.lower()) and "id" not in low and "role" not in low and "prop" not in low and "label" not in low:
        return frozenset()
    out: set[str] = set()
    for name, a, b, c in _ATTR.findall(attrs):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            out.update(_TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()))
    return frozenset(out)


def describe(root: Node) -> tuple[list[Node], np.ndarray]:
    """The block elements in document order, and their features."""
    order: list[Node] = []
    stack = [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in reversed(x.parts) if isinstance(c, Node) and c.tag not in HIDDEN]
    sums: dict[Node, list[float]] = {}
    for x in reversed(order):  # children before parents
        s = [0.0] * 7  # text, words, tags, link text, stops, own text, form controls
        for c in x.parts:
            if isinstance(c, str):
                t = c.strip()
                s[0] += len(t)
                s[1] += t.count(" ") + bool(t)
                s[4] += t.count(".") + t.count(",")
                s[5] += len(t)
            elif c in sums:
                k = sums[c]
                for i in (0, 1, 2, 3, 4, 6):
                    s[i] += k[i]
                if c.tag not in BLOCKS:
                    s[5] += k[5]
            elif c.tag in _FORM:
                s[6] += 1
        s[2] += 1
        if x.tag == "a":
            s[3] = s[0]
        if x.tag in _FORM:
            s[6] += 1
        sums[x] = s
    blocks = [x for x in order if x.tag in BLOCKS or x is root]
    whole = max(1.0, sums[root][0])
    up: dict[Node, tuple[int, int]] = {}
    feats = []
    siblings: dict[Node, tuple[int, int]] = {}
    for x in order:
        kids = [c for c in x.parts if isinstance(c, Node) and c.tag in BLOCKS]
        for i, c in enumerate(kids):
            siblings[c] = (i, len(kids))
    for x in order:
        toks = _tokens(x.attrs) if x.attrs else set()
        bad, good = len(toks.intersection(_ASIDE)), len(toks.intersection(_MAIN))
        pb, pg = up.get(x.parent, (0, 0))
        up[x] = (
            pb + bool(bad or x.tag in ("nav", "footer", "aside", "form", "header", "menu", "search", "dialog")),
            pg + bool(good or x.tag in ("article", "main")),
        )
        if x not in sums or not (x.tag in BLOCKS or x is root):
            continue
        text, words, tags, link, stops, own, form = sums[x]
        i, of = siblings.get(x, (0, 1))
        feats.append([
            *(float(x.tag == g) for g in _GROUPS),
            x.depth, bad, good, pb, pg, text / whole, np.log1p(text), np.log1p(words), text / tags, link / max(1.0, text),
            stops / max(1.0, words), own / max(1.0, text), form, i / max(1, of), of, float("©" in (x.parts[0] if x.parts and isinstance(x.parts[0], str) else "")),
        ])
    return blocks, np.array(feats, float)


MAIN, ASIDE, OUTER = 0, 1, 2


def decode(blocks: list[Node], prob: np.ndarray) -> dict[Node, int]:
    """The likeliest labels of all blocks of which none contradicts an ancestor's."""
    p = np.clip(prob, 1e-6, 1 - 1e-6)
    own = {x: (float(np.log(q)), float(np.log(1 - q)), -2.0) for x, q in zip(blocks, p, strict=True)}
    held = set(blocks)
    kids: dict[Node, list[Node]] = {x: [] for x in blocks}
    for x in blocks[1:]:
        up = x.parent
        while up not in held:
            up = up.parent
        kids[up].append(x)
    best: dict[Node, tuple[float, float, float]] = {}
    for x in reversed(blocks):
        m, a, o = own[x]
        for c in kids[x]:
            cm, ca, co = best[c]
            m += max(cm, ca - SWITCH)
            a += ca
            o += max(cm, ca, co)
        best[x] = (m, a, o)
    label = {blocks[0]: OUTER}
    for x in blocks:
        for c in kids[x]:
            cm, ca, co = best[c]
            if label[x] == ASIDE:
                label[c] = ASIDE
            elif label[x] == MAIN:
                label[c] = MAIN if cm >= ca - SWITCH else ASIDE
            else:
                label[c] = max(((cm, MAIN), (ca, ASIDE), (co, OUTER)), key=lambda t: t[0])[1]
    return label


def main_text(root: Node, label: dict[Node, int]) -> str:
    """Text of main blocks in page order; white space inside a block is one space, as is a block's edge."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            t = _WHITE.sub(" ", html.unescape("".join(held))).strip()
            if t:
                out.append(t)
            held.clear()

    stack: list[tuple[Node, int, int]] = [(root, OUTER, 0)]
    while stack:
        x, mark, i = stack.pop()
        if i == 0 and (x.tag in BLOCKS or x is root):
            flush()
            mark = label.get(x, mark)
        while i < len(x.parts):
            c = x.parts[i]
            i += 1
            if isinstance(c, str):
                if mark == MAIN:
                    held.append(c)
            elif c.tag in ("br", "hr"):
                held.append(" ")
            elif c.tag not in HIDDEN and c.tag not in VOID:
                stack += [(x, mark, i), (c, mark, 0)]
                break
        else:
            if x.tag in BLOCKS:
                flush()
    flush()
    return " ".join(out)


def extract_many(pages: list[str | None], model: Boosted) -> list[str]:
    """Main texts; the trees judge the elements of all pages at once."""
    roots = [parse(p) if p else None for p in pages]
    seen = [describe(r) if r else ([], np.zeros((0, 0))) for r in roots]
    feats = [x for _, x in seen if len(x)]
    prob = model.probability(np.concatenate(feats)) if feats else np.zeros(0)
    out, at = [], 0
    for root, (blocks, _) in zip(roots, seen, strict=True):
        out.append(main_text(root, decode(blocks, prob[at : at + len(blocks)])) if root else "")
        at += len(blocks)
    return out


def extract(page: str | None, model: Boosted) -> str:
    return extract_many([page], model)[0]


def generate(n: int = PAGES, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Generated pages of many layouts: features of their elements, and whether each is main content."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    syll = ("an", "er", "tion", "ing", "th", "re", "on", "ed", "le", "ou", "de", "ar", "en")
    word = lambda: "".join(pick(*syll) for _ in range(rng.integers(1, 4)))
    words = lambda a, b: " ".join(word() + pick("", "", "", "", ",", ".") for _ in range(rng.integers(a, b)))
    links = lambda k: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k))

    def aside() -> str:
        match rng.integers(9):
            case 0:
                s = f"<{(t := pick('nav', 'div', 'nav'))} class=\"{pick('nav', 'menu', 'main-menu', 'topnav')}\"><ul>{links(rng.integers(2, 9))}</ul></{t}>"
                return s if rng.random() < 0.5 else s.replace('<nav class="nav">', "<nav>")
            case 1:
                t = pick("footer", "div", "footer")
                return f"<{t}{pick('', ' class="footer"', ' id="site-footer"') if t == 'footer' else ' class="footer"'}>{pick('&copy; ', '')}{words(3, 25)}</{t}>"
            case 2:
                return f'<div class="{pick("ad", "ads", "advert", "promo", "ad-box sponsor", "banner")}">{words(3, 30)}</div>'
            case 3:
                return f'<{(t := pick("aside", "div"))} class="{pick("sidebar", "side", "related", "widget")}"><h2>{words(1, 4)}</h2><ul>{links(rng.integers(2, 7))}</ul><p>{words(3, 20)}</p></{t}>'
            case 4:
                return f'<div class="{pick("cookie", "notice", "consent-banner", "cookie-notice")}"><p>{words(5, 25)}</p></div>'
            case 5:
                return f'<{(t := pick("section", "div"))} {pick("id", "class")}="{pick("comments", "comment-list", "replies comments")}"><h2>{words(1, 3)}</h2>' + "".join(f'<{pick("div", "p")} class="comment">{words(4, 40)}' for _ in range(rng.integers(1, 5))) + f"</{t}>"
            case 6:
                return f'<form{pick("", " class=search")}><label>{words(1, 3)}</label><input name=q><p>{words(2, 8)}</p><button>{words(1, 2)}</button></form>'
            case 7:
                return f"<header>{pick('<h1>', '<p>')}{words(1, 5)}</header>"
            case _:
                return f'<div class="{pick("share", "social", "breadcrumb", "newsletter")}"><p>{words(2, 10)}</p><ul>{links(2)}</ul></div>'

    def body() -> str:
        parts = [f"<h1>{words(2, 10)}</h1>"]
        for _ in range(rng.integers(1, 12)):
            parts.append(pick(
                f"<p>{words(1, 90)}</p>", f"<p>{words(1, 90)}</p>", f"<p>{words(5, 60)}<br>{words(5, 60)}", f"<p><b>{words(10, 60)}<br>", f"<h2>{words(1, 8)}</h2>",
                f"<blockquote>{words(5, 40)}</blockquote>", f"<ul><li>{words(3, 20)}</li><li>{words(3, 20)}</li></ul>", f"<table><tr><td>{words(1, 5)}<td>{words(1, 9)}</table>", f"<pre>{words(4, 20)}</pre>",
                f"<p>{words(5, 30)} <a href='/x'>{words(1, 3)}</a> {words(5, 30)}</p>",
            ))
            if rng.random() < 0.1:
                parts.append(aside())
        return "".join(parts)

    xs, ys = [], []
    for _ in range(n):
        open_ = pick("<article>", "<article>", "<main>", '<div class="content">', '<div id="post-body">', '<div class="entry-content">', '<section class="story">', "<main><article>", '<article class="post">')
        close = "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", open_)))
        front = "".join(aside() for _ in range(rng.integers(0, 5)))
        back = "".join(aside() for _ in range(rng.integers(0, 5)))
        frame = pick(("", ""), ("", ""), ('<div id="wrapper">', "</div>"), ('<div class="page"><div class="row">', "</div></div>"))
        page = f"<html><head><title>{words(1, 5)}</title></head><body>{frame[0]}{front}\x01{open_}{body()}{close}\x02{back}{frame[1]}</body></html>"
        root = parse(page)
        inside, marks = False, {}
        stack: list[Node | str] = [root]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                inside = (inside or "\x01" in c) and "\x02" not in c
                continue
            marks[c] = inside
            stack += reversed(c.parts)
        blocks, x = describe(root)
        kept: dict[Node, bool] = {}
        for b in blocks:  # an aside within the main content, and all below it, is none
            up = b.parent
            while up is not None and up not in kept:
                up = up.parent
            own = marks[b] and not (_tokens(b.attrs).intersection(_ASIDE) or b.tag in ("nav", "footer", "aside", "form", "header"))
            kept[b] = own and (up is None or kept[up] or not marks[up])
        xs.append(x)
        ys += [kept[b] for b in blocks]
    return np.concatenate(xs), np.array(ys)


def train() -> Boosted:
    return Boosted(rounds=30, depth=4).fit(*generate())


def extract_pages(pages: DataFrame, model: Boosted | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every whole page; null or empty html gives an empty text.

    Rows are handled one by one: null or repeated ids and urls are passed on; other columns are
    ignored. One narrow pass.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, 64):
                text = extract_many([r["html"] for r in rows], held.value)
                yield pa.RecordBatch.from_pydict(
                    {
                        "page_id": pa.array([r["page_id"] for r in rows], pa.int64()),
                        "url": pa.array([r["url"] for r in rows], pa.string()),
                        "text": pa.array(text, pa.string()),
                        "n_chars": pa.array([len(t) for t in text], pa.int64()),
                    }
                )

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
