"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read once into blocks: text between two block-level tags (script, style, template and the
like never give text; comments are skipped; inline tags and <br> do not end a block). Each block has
features of its ancestors (tags, class and id words, landmarks) and of its text (length, link share,
end of sentence, digits, page position). A two-state chain (0 page furniture, 1 main text) scores each
block and each change between neighbours; Viterbi gives the best labels. Blocks labelled 1 are joined
by line breaks. The field is fitted by gradient ascent of the log-likelihood (forward-backward) on
labelled pages: PAGES pages made from a rule (see labelled_pages) that vary the layout, the landmark
tags, class names, the amount of text and the markup errors. Fitting is small, done once on the
driver, and the weights are broadcast.

A page is read in time linear in its length whatever its markup: a tag that is never closed is text, and
from the first place where quotes leave no end to a tag, quotes no longer hide a ">". Ancestors are a
chain of nodes; the weights of a chain are added up once a node, so deep nesting costs no more.

Null html is empty: empty text, 0 characters. Unclosed and unknown tags, stray ends and broken
references are read the way browsers do or kept as text. Repeated rows stay; other columns are
dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datelode.llm.common import slices

PAGES = 240
_MARK = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?])")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
_SAME = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_BLANK = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Za-z]+")
_SPLIT_NAME = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """A block-level element that stands open, with those around it."""

    __slots__ = ("parent", "tag", "names", "total")

    def __init__(self, parent: Node | None, tag: str, names: str) -> None:
        self.parent, self.tag, self.names, self.total = parent, tag, names, None

    def own(self) -> list[str]:
        return ["in:" + self.tag, *("name:" + w.lower() for w in _SPLIT_NAME.split(self.names) if w)]


class _Open:
    """The elements that stand open, with the places of each tag among them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Node | None]] = []
        self.at: dict[str, list[int]] = {}

    def top(self) -> Node | None:
        return self.stack[-1][1] if self.stack else None

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def push(self, tag: str, names: str) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, self.top() if tag in _INLINE else Node(self.top(), tag, names)))

    def cut(self, to: int) -> None:
        while len(self.stack) > to:
            self.at[self.stack.pop()[0]].pop()

    def count(self, tag: str) -> int:
        return len(self.at.get(tag, ()))


class _Tags:
    """Ends of the tags of one page, found in linear time."""

    def __init__(self, page: str) -> None:
        self.page, self.quotes = page, {c: page.rfind(c) for c in "\"'"}
        self.last, self.quoted = page.rfind(">"), True

    def end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at at; -1 if nothing closes it."""
        if at > self.last:
            return -1
        page, k = self.page, at
        while self.quoted:
            k = _PLAIN.match(page, k).end()
            if k == len(page):
                self.quoted = False  # happens once a page
            elif page[k] == ">":
                return k
            else:
                k = page.find(page[k], k + 1) + 1 if self.quotes[page[k]] > k else k + 1
        return page.find(">", at)


def blocks(page: str) -> list[tuple[str, Node | None, int]]:
    """(text, block-level element around it, characters inside links) of each leaf block with text."""
    out: list = []
    open_, tags = _Open(), _Tags(page)
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _BLANK.sub(" ", "".join(parts)).strip()
            if text:
                out.append((text, open_.top(), linked))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = references.unescape(raw)
            parts.append(text)
            if open_.count("a"):
                linked += len(text.strip())

    start = 0  # of the text not yet taken
    while m := _MARK.search(page, at):
        tag = (m[2] or "").lower()
        if not tag:
            comment = page.startswith("<!--", m.start())
            end = page.find("-->", m.start() + 4) + 3 if comment else page.find(">", m.end()) + 1
            add(page[start : m.start()])
            start = at = end if end > 2 * comment else len(page)
            continue
        end = tags.end(m.end())
        if end < 0:
            at = m.end()  # stays text
            continue
        add(page[start : m.start()])
        attributes = page[m.end() : end]
        start = at = end + 1
        if m[1]:
            if tag not in _INLINE:
                flush()
            if open_.count(tag):
                open_.cut(open_.last([tag]))
            continue
        if tag not in _INLINE:
            flush()
            if tag in _CLOSES_P and open_.count("p"):
                open_.cut(open_.last(["p"]))
            if tag in _ITEMS:
                same = open_.last(_SAME.get(tag, (tag,)))
                if same > open_.last(_ITEMS[tag]):
                    open_.cut(same)
        elif tag == "br":
            parts.append(" ")
        if tag in _RAW:
            found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            start = at = found.end() if found else len(page)
            continue
        if tag in _VOID or attributes.endswith("/") and tag not in _INLINE and tag not in _CLOSES_P:
            continue
        open_.push(tag, " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes)))
    add(page[start:])
    flush()
    return out


def local_features(page_blocks: list) -> list[list[str]]:
    """Names of the features of each block's own text and place."""
    out, n = [], len(page_blocks)
    heading_seen = False
    for k, (text, above, linked) in enumerate(page_blocks):
        own = above.tag if above else "none"
        size, share = len(text), linked / max(1, len(text))
        f = ["bias", "own:" + own]
        f.append("size:" + ("xs" if size < 15 else "s" if size < 40 else "m" if size < 120 else "l" if size < 400 else "xl"))
        f.append("links:" + ("0" if share == 0 else "some" if share < 0.5 else "most"))
        f.append("end:" + ("stop" if text[-1] in ".!?…\"”»" else "other"))
        if text[:1] == "©" or "©" in text[:3] or "rights reserved" in text.lower():
            f.append("copyright")
        f.append("place:" + str(min(3, 4 * k // n)))
        f.append("after-heading" if heading_seen else "before-heading")
        heading_seen |= own == "h1"
        out.append(f)
    return out


def features(page_blocks: list) -> list[list[str]]:
    """Names of all features of each block, those of every element around it included; for training."""
    out = local_features(page_blocks)
    for f, (_, node, _) in zip(out, page_blocks, strict=True):
        while node:
            f += node.own()
            node = node.parent
    return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Two-state chain: weights per feature and state, and per change of state."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, change: np.ndarray) -> None:
        self.index, self.weights, self.change = index, weights, change

    def emissions(self, found: list[list[str]]) -> np.ndarray:
        return np.array([self.weights[[self.index[x] for x in f if x in self.index]].sum(axis=0) for f in found]).reshape(-1, 2)

    def around(self, node: Node | None) -> np.ndarray:
        """Weights of the elements around a block, added up once for each."""
        chain = []
        while node and node.total is None:
            chain.append(node)
            node = node.parent
        total = node.total if node else np.zeros(2)
        for x in reversed(chain):
            total = x.total = total + self.emissions([x.own()])[0]
        return total

    def labels(self, page_blocks: list) -> list[int]:
        """Best labels of a page's blocks."""
        if not page_blocks:
            return []
        return self.best(self.emissions(local_features(page_blocks)) + np.array([self.around(x[1]) for x in page_blocks]))

    def viterbi(self, found: list[list[str]]) -> list[int]:
        return self.best(self.emissions(found)) if found else []

    def best(self, e: np.ndarray) -> list[int]:
        back = []
        best = e[0]
        for row in e[1:]:
            paths = best[:, None] + self.change
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + row
        labels = [int(best.argmax())]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return labels[::-1]


def slope(field: Field, found: list[list[int]], y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of a page's labels, given the numbers of each block's features, and its gradient by weights and changes."""
    e = np.array([field.weights[f].sum(axis=0) for f in found])
    n = len(e)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = e[0]
    for k in range(1, n):
        ahead[k] = e[k] + _log_sum(ahead[k - 1][:, None] + field.change, 0)
    for k in range(n - 2, -1, -1):
        behind[k] = _log_sum(field.change + (e[k + 1] + behind[k + 1])[None, :], 1)
    z = _log_sum(ahead[-1], 0)
    off = np.eye(2)[y] - np.exp(ahead + behind - z)  # for each block and state
    dw, dc = np.zeros(field.weights.shape), np.zeros((2, 2))
    np.add.at(dw, np.concatenate([np.asarray(f, dtype=np.int64) for f in found]), np.repeat(off, [len(f) for f in found], axis=0))  # a feature counts as often as it stands
    for k in range(1, n):
        dc -= np.exp(ahead[k - 1][:, None] + field.change + (e[k] + behind[k])[None, :] - z)
        dc[y[k - 1], y[k]] += 1
    return float(e[np.arange(n), y].sum() + field.change[y[:-1], y[1:]].sum() - z), dw, dc


def fit(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 25, rate: float = 0.15, l2: float = 1e-3, seed: int = 5) -> Field:
    """Adagrad on the conditional log-likelihood, one page a step."""
    names = sorted({x for found, _ in pages for f in found for x in f})
    field = Field({x: k for k, x in enumerate(names)}, np.zeros((len(names), 2)), np.zeros((2, 2)))
    gw, gc = np.full(field.weights.shape, 0.1), np.full((2, 2), 0.1)
    rng = random.Random(seed)
    data = [([[field.index[x] for x in f] for f in found], np.array(y)) for found, y in pages if found]
    for _ in range(epochs):
        rng.shuffle(data)
        for found, y in data:
            _, dw, dc = slope(field, found, y)
            dw -= l2 * field.weights
            gw += dw * dw
            gc += dc * dc
            field.weights += rate * dw / np.sqrt(gw)
            field.change += rate * dc / np.sqrt(gc)
    return field


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(html, main blocks in order): pages of many layouts made from a rule, as training data."""
    rng = random.Random(seed)
    syllables = "ta re no si mu la ver ent ion ald ber kin os ar et chi dor lum pre fen".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))

    def sentence(lo: int = 4, hi: int = 16) -> str:
        return " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize() + rng.choice([".", ".", ".", "!", "?"])

    prose = lambda: " ".join(sentence() for _ in range(rng.randint(1, 6)))
    some = lambda *x: rng.choice(x)
    pages = []
    for _ in range(n):
        main: list[str] = []
        out: list[str] = []

        def wrap(kind: str, names: list[str], inner: str) -> str:
            tag = some(kind, "div", "section") if kind != "div" else "div"
            name = some(*names)
            mark = f' {some("class", "id")}="{name}"' if tag != kind or rng.random() < 0.4 or kind == "div" else ""
            return f"<{tag}{mark}>{inner}</{tag}>"

        menu = lambda k: "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k)) + "</ul>"  # noqa: E731, B023
        links = lambda k: " ".join(f'<a href="/{word()}">{word()} {word()}</a>' for _ in range(k))  # noqa: E731, B023
        plain = lambda: some(sentence(2, 8), prose(), word())

        def furniture(where: str) -> str:
            kinds = {
                "top": [("nav", ["nav", "menu", "navbar", "main-menu", "breadcrumbs"], some(menu(rng.randint(3, 8)), links(4))), ("header", ["header", "masthead", "site-header", "banner", "topbar"], some(f"<p>{word()} {word()}</p>", f"<a href='/'>{word()}</a>", f"<p>{sentence()}</p>")), ("div", ["notice", "cookie-notice", "cookie-banner", "consent", "alert"], f"<p>{sentence()}</p>"), ("div", ["ad", "ads", "advert", "sponsored", "promo"], some(plain(), f"<p>{plain()}</p>")), ("form", ["search", "search-form"], f"<label>{word()}</label><input name=q><button>{word()}</button>")],
                "side": [("aside", ["sidebar", "side", "related", "widget", "recommended"], some(menu(4), f"<h3>{word()} {word()}</h3><p>{prose()}</p>", f"<p>{prose()}</p>")), ("div", ["ad", "advertisement", "promo", "sponsor"], some(plain(), f"<p>{plain()}</p>"))],
                "end": [("footer", ["footer", "site-footer", "bottom", "copyright", "legal"], some(f"&copy; {word()} &middot; {sentence()}", f"<p>&copy; 2020 {word()}. All rights reserved.</p>", menu(4) + f"<p>{sentence()}</p>")), ("section", ["comments", "comment-list", "discussion", "responses", "replies"], "".join(f'<div class="comment"><p>{some("", "<b>" + word() + "</b> ")}{prose()}</p></div>' for _ in range(rng.randint(1, 4)))), ("form", ["newsletter", "subscribe", "signup", "contact"], f"<p>{sentence()}</p><label>{word()}</label><input><button>{word()}</button>"), ("div", ["share", "social", "tags", "related", "author", "popup", "modal"], some(links(3), f"<p>{plain()}</p>"))],
            }[where]
            return wrap(*rng.choice(kinds))

        for _ in range(rng.randint(0, 3)):
            out.append(furniture("top"))
        if rng.random() < 0.3:
            out.append(furniture("side"))
        body: list[str] = []
        if rng.random() < 0.85:
            main.append(some(sentence(3, 9)[:-1], prose()[:60].strip()))
            body.append(f"<h1>{main[-1]}</h1>")
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.66:
                main.append(some(prose(), prose(), sentence(1, 3), sentence()))
                shown = main[-1]
                if rng.random() < 0.2:
                    head, _, tail = shown.partition(" ")
                    shown = f'<{(t := some("b", "em", "i"))}>{head}</{t}> <a href="/{word()}">{tail}</a>' if rng.random() < 0.3 else f"<b>{head}</b> {tail}"
                if rng.random() < 0.1:
                    body.append(f"<p><b>{shown}<br>")
                else:
                    body.append(f"<{(t := some('p', 'p', 'p', 'p', 'div', 'blockquote'))}>{shown}</{t}>")
            elif r < 0.78:
                main.append(sentence(2, 6)[:-1])
                body.append(f"<{(t := some('h2', 'h3'))}>{main[-1]}</{t}>")
            elif r < 0.88:
                items = [some(sentence(), word(), sentence(2, 5)) for _ in range(rng.randint(2, 5))]
                main += items
                body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            elif r < 0.93:
                cells = [some(word(), sentence(1, 4)) for _ in range(4)]
                main += cells
                body.append(f"<table><tr><td>{cells[0]}</td><td>{cells[1]}</td></tr><tr><td>{cells[2]}</td><td>{cells[3]}</td></tr></table>")
            elif r < 0.97:
                body.append(furniture("side"))
            else:
                main.append(word() + " " + word())
                body.append(f"<figure><img src=x><figcaption>{main[-1]}</figcaption></figure>")
        inner = "".join(body)
        names = ["content", "article", "post", "entry", "main", "story", "post-content", "article-body", "text", "page"]
        holder = rng.random()
        if holder < 0.45:
            inner = f"<article>{inner}</article>"
        elif holder < 0.6:
            inner = f"<main>{inner}</main>"
        elif holder < 0.7:
            inner = f"<main><article>{inner}</article></main>"
        elif holder < 0.95:
            inner = f'<div {some("class", "id")}="{some(*names)}">{inner}</div>'
        out.append(inner)
        for _ in range(rng.randint(0, 3)):
            out.append(furniture(some("end", "end", "side")))
        text = "".join(out)
        if rng.random() < 0.2:
            text = f'<div class="{some("wrapper", "container", "page", "row")}">{text}</div>'
        pages.append((f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{margin:0}}</style></head><body>{text}</body></html>", main))
    return pages


def labels_of(page_blocks: list, main: list[str]) -> list[int]:
    """1 for the blocks that are the main ones, met in order."""
    out, k = [], 0
    for text, _, _ in page_blocks:
        hit = k < len(main) and _BLANK.sub(" ", main[k]).strip() == text
        out.append(int(hit))
        k += hit
    return out


@cache
def trained(pages: int = PAGES) -> Field:
    data = []
    for page, main in labelled_pages(pages):
        b = blocks(page)
        data.append((features(b), labels_of(b, main)))
    return fit(data)


def main_text(page: str, field: Field) -> str:
    b = blocks(page)
    return "\n".join(x[0] for x, y in zip(b, field.labels(b), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(field or trained())
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                texts = [main_text(h, sent.value) for h in piece.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
