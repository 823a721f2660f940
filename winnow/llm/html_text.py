"""Main text of web pages by a linear-chain conditional random field (operator 3).

A page is read into the leaf blocks of its document tree. Each block has features
of its ancestors (tags, and the words of their class, id and role) and of its text
(length, share of links, punctuation, marks that boilerplate has). A linear-chain
field over the blocks, with the labels `main` and `other`, is trained on labelled
pages, and decoded by Viterbi. The labelled pages are made here, by a generator
that sets articles among menus, headers, notices, adverts, sidebars, forms,
comments and footers in many layouts. It was modelled on common site templates, and
on how pages with unclosed tags and odd punctuation look; no page that is read, nor
anything of its words, names or layout, goes in when the field is trained.

Cases: null or empty html, and pages without main blocks, give an empty text.
Broken markup is read as browsers do in the main: unknown end tags are passed
over, and paragraphs, items and cells end where the next begins. Null and repeated
page_ids pass through, one row for each input row. Time and memory are linear in a
page's length, however deep its elements lie. An empty table gives an empty result. Columns beside page_id, url and html aren't read.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from winnow.llm.shared import ship

# Fixed values of HTML: elements by how their content is read. Raw text runs to its end tag or the
# page's end; the unread are left out from start tag to end tag, and without one are read like others.
_RAW = "script|style|textarea|title"
_UNREAD = frozenset("annotation annotation-xml audio button canvas iframe noscript object select svg template video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "html head body address article aside blockquote caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What the start of an element ends, if that is open within the nearest of the elements named second.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_AREAS = frozenset("article aside figure footer form header main nav".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*+>(?<!/>).*?(?:</\1\s*>|\Z)|<[!?][^>]*+>|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][^\s/>]*+)([^>]*+)>",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    """A leaf block: its text, its tag, the tags and name words of its ancestors, the innermost
    of them that is a part of a page and the innermost names, whether any has names, and letters in links."""

    text: str
    tag: str
    tags: frozenset[str]
    names: frozenset[str]
    area: str
    near: frozenset[str]
    named: bool
    linked: int


_no_names: frozenset[str] = frozenset()


def _names(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return _no_names
    return frozenset(w.lower() for m in _ATTRIBUTE.finditer(attributes) for w in _PART.findall(m[2] or m[3] or m[4] or "") if len(w) > 1)


def _unread(tokens: list[re.Match[str]]) -> dict[int, int]:
    """Where the unread elements that have an end tag start and end, as positions in the page."""
    starts: dict[str, list[int]] = {}
    out: dict[int, int] = {}
    for m in tokens:
        name = (m[3] or m[6] or "").lower()
        if name not in _UNREAD:
            continue
        if not (m[2] or m[5]):
            if not (m[4] or m[7] or "").endswith("/"):
                starts.setdefault(name, []).append(m.start())
        elif starts.get(name):
            out[starts[name].pop()] = m.end()
    return out


class _Open:
    """The elements that are open, and where each tag and the blocks among them are, so
    that nothing looks through the whole of a deep page."""

    def __init__(self) -> None:
        self.path: list[tuple[str, frozenset[str], frozenset[str], str, frozenset[str], bool]] = [("", _no_names, _no_names, "", _no_names, False)]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, own: frozenset[str], known: frozenset[str] | None) -> None:
        _, tags, names, area, near, named = self.path[-1]
        self.at.setdefault(name, []).append(len(self.path))
        if name in _BLOCKS:
            self.blocks.append(len(self.path))
        named = named or bool(own)
        kept = own if known is None else own & known
        # sets are shared by all elements that add nothing to them
        tags = tags if name in tags or name not in _TAGS else tags | {name}
        self.path.append((name, tags, names if kept <= names else names | kept, name if name in _AREAS else area, kept if own else near, named))

    def pop(self, to: int) -> None:
        for name, *_ in self.path[to:]:
            self.at[name].pop()
        del self.path[to:]
        while self.blocks and self.blocks[-1] >= to:
            self.blocks.pop()

    def last(self, names: Iterable[str]) -> int:
        """Where the innermost of the open elements with these names is, 0 if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page, in order; those without text are left out.

    Of the names of ancestors only the known ones are kept, if those are given: what a
    block has is then bounded, however deep the page is.
    """
    out: list[Block] = []
    open_ = _Open()
    text: list[str] = []
    linked = at = 0

    def close() -> None:
        nonlocal linked
        if text:
            joined = " ".join(_html.unescape("".join(text)).split())
            if joined:
                tag = open_.path[open_.blocks[-1]][0] if open_.blocks else ""
                out.append(Block(joined, tag, *open_.path[-1][1:], linked))
            text.clear()
        linked = 0

    tokens = list(_TOKEN.finditer(page))
    unread = _unread(tokens)
    for m in tokens:
        if m.start() < at:
            continue
        if m.start() > at:
            text.append(page[at : m.start()])
            if open_.at.get("a"):
                linked += m.start() - at
        at = unread.get(m.start(), m.end())
        if at > m.end():
            text.append(" ")
            continue
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1]:
                text.append(" ")
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _BLOCKS:
            close()
        if m[2] or m[5]:
            found = open_.last((name,))
            if found:
                open_.pop(found)
            continue
        if name in _VOID:
            continue
        if name in _ENDS:
            ends, within = _ENDS[name]
            found = open_.last(ends)
            if found > open_.last(within):
                open_.pop(found)
        elif name in _BLOCKS and open_.blocks and open_.path[open_.blocks[-1]][0] == "p":
            open_.pop(open_.blocks[-1])
        attributes = m[4] or m[7] or ""
        if attributes.endswith("/"):
            continue
        open_.push(name, _names(attributes), known)
    if at < len(page):
        text.append(page[at:])
    close()
    return out


_TAGS = frozenset("article main nav header footer aside form section ul ol li table figure figcaption blockquote pre h1 h2 h3 h4 h5 h6 p dl fieldset label details dialog address small".split())
_MARK = re.compile(r"[©®›»·•]|\ball rights\b|\bcopyright\b", re.I)


def features(page: list[Block]) -> list[list[str]]:
    """The features of each block of a page."""
    return list(each_features(page))


def each_features(page: list[Block]) -> Iterator[list[str]]:
    """The features of one block after another, so that a long page need not have them all at once."""
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        share = b.linked / len(b.text)
        f = ["bias", f"tag:{b.tag}", f"words:{min(words.bit_length(), 7)}", f"links:{0 if share < 0.05 else 1 if share < 0.5 else 2}"]
        f += [f"in:{t}" for t in b.tags]
        f += [f"name:{n}" for n in b.names]
        f += [f"near:{n}" for n in b.near]
        f += [f"area:{b.area}", f"area:{b.area}:{b.tag}"]
        f.append(f"end:{b.text[-1] if b.text[-1] in '.!?:…' else '-'}")
        f.append(f"commas:{min(b.text.count(','), 3)}")
        if _MARK.search(b.text):
            f.append("mark")
        if not b.named and not (b.tags & {"article", "main", "nav", "header", "footer", "aside", "form"}):
            f.append("plain")
            f.append(f"plain:{min(words.bit_length(), 7)}")
        f += ["first"] * (i == 0) + ["last"] * (i == len(page) - 1)
        yield f


@dataclass
class Field:
    """A linear-chain field with labels 0 (other) and 1 (main): weights of features for
    label 1, and of pairs of labels in a row."""

    weights: dict[str, float] = field(default_factory=dict)
    pairs: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    @cached_property
    def names(self) -> frozenset[str]:
        """The name words that have a weight."""
        return frozenset(f.split(":", 1)[1] for f in self.weights if f.startswith(("name:", "near:")))

    def decode(self, rows: Iterable[list[str]]) -> list[int]:
        """The most probable labels, by Viterbi."""
        (p00, p01), (p10, p11) = self.pairs
        get, back = self.weights.get, []
        zero = one = None
        for f in rows:
            own = sum([get(x, 0.0) for x in f])
            if zero is None:
                zero, one = 0.0, own
                continue
            b0, b1 = zero + p00 < one + p10, zero + p01 < one + p11
            back.append((b0, b1))
            zero, one = (one + p10 if b0 else zero + p00), (one + p11 if b1 else zero + p01) + own
        if zero is None:
            return []
        label = int(one > zero)
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 40, rate: float = 0.4, keep: float = 1e-4, batch: int = 32, seed: int = 1) -> Field:
    """Fits a field to labelled pages: adaptive gradient steps on the likelihood of their
    labels, a batch of pages of like length at a time."""
    ids = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for r in rows for f in r}))}
    data = sorted(([([ids[f] for f in r], label) for r, label in zip(rows, labels, strict=True)] for rows, labels in pages if rows), key=len)
    batches = [_Batch(data[i : i + batch]) for i in range(0, len(data), batch)]
    w, pairs = np.zeros(len(ids)), np.zeros((2, 2))
    gw, gp = np.full(len(ids), 1e-6), np.full((2, 2), 1e-6)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(batches)
        for b in batches:
            step, g = b.gradient(w, pairs)
            step += keep * len(b.lengths) * w
            gw += step**2
            gp += g**2
            w -= rate * step / np.sqrt(gw)
            pairs -= rate * g / np.sqrt(gp)
    return Field({f: float(w[i]) for f, i in ids.items()}, tuple(tuple(map(float, r)) for r in pairs))


class _Batch:
    """Labelled pages side by side, padded to the longest."""

    def __init__(self, pages: list[list[tuple[list[int], int]]]):
        self.lengths = np.array([len(p) for p in pages])
        t = int(self.lengths.max())
        self.there = np.arange(t)[None, :] < self.lengths[:, None]
        self.labels = np.zeros(self.there.shape, dtype=np.int64)
        self.labels[self.there] = [label for p in pages for _, label in p]
        self.features = np.array([f for p in pages for r, _ in p for f in r])
        self.counts = np.array([len(r) for p in pages for r, _ in p])
        self.starts = np.cumsum(self.counts) - self.counts
        both = self.there[:, 1:]
        self.seen = np.zeros((2, 2))
        np.add.at(self.seen, (self.labels[:, :-1][both], self.labels[:, 1:][both]), 1)

    def gradient(self, w: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the negative log likelihood, by weights of features and of pairs; by forward and backward sums."""
        n, t = self.there.shape
        own = np.zeros((n, t, 2))
        own[self.there, 1] = np.add.reduceat(w[self.features], self.starts)
        a, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        a[:, 0] = own[:, 0]
        for i in range(1, t):
            a[:, i] = own[:, i] + np.logaddexp(a[:, i - 1, :1] + pairs[0], a[:, i - 1, 1:] + pairs[1])
        for i in range(t - 2, -1, -1):
            x = own[:, i + 1] + b[:, i + 1]
            b[:, i] = np.where(self.there[:, i + 1, None], np.logaddexp(pairs[:, 0] + x[:, :1], pairs[:, 1] + x[:, 1:]), 0)
        z = np.logaddexp(*a[np.arange(n), self.lengths - 1].T)
        d = (np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]) - self.labels)[self.there]
        x = a[:, :-1, :, None] + pairs + (own + b)[:, 1:, None, :] - z[:, None, None, None]
        g = np.exp(x[self.there[:, 1:]]).sum(axis=0) - self.seen
        return np.bincount(self.features, weights=np.repeat(d, self.counts), minlength=len(w)), g


# ---- labelled pages -------------------------------------------------------

#: Names that parts of pages have, by part.
_PARTS = {
    "menu": "nav navbar navigation menu main-menu topnav breadcrumb breadcrumbs pagination pager tabs toc",
    "header": "header site-header masthead topbar banner-top branding logo search hero-bar",
    "footer": "footer site-footer bottom colophon copyright legal credits foot",
    "sidebar": "sidebar side widget widgets related recommended rail popular trending archive tags categories",
    "notice": "cookie cookies consent notice alert message gdpr popup modal toast banner announcement disclaimer paywall",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted banner-ad dfp teaser",
    "form": "form signup subscribe newsletter login search-form contact-form survey",
    "comments": "comment comments comment-list discussion replies reply disqus respond feedback reviews",
    "share": "share sharing social follow likes byline-links meta-links",
    "main": "content main article post entry story body text page-content post-body article-body entry-content main-content story-text prose",
}
_PART_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "notice": "aside", "advert": "aside", "form": "form", "comments": "section", "share": "ul"}


class _Maker:
    """Makes one labelled page: main text is marked by letters that no other text has."""

    MAIN = "\ue000"
    SUFFIXES = ("", "", " box", " clearfix", " wrapper", "-inner")

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.style = self.r.choice([" | ", "!! ", "### ", " ", " - ", ", "]) if self.r.random() < 0.25 else ""

    def words(self, low: int, high: int, comma: bool = True) -> str:
        r = self.r
        out = ["".join(r.choice("bcdfghlmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        if comma and len(out) > 6:
            out[len(out) // 2] += ","
        return " ".join(out).capitalize()

    def sentences(self, low: int, high: int) -> str:
        if self.style:  # text of an odd make, all through the page
            words = [self.words(1, 2, False) for _ in range(self.r.randint(low, 8 * high))]
            return self.style.join(words) + self.r.choice([".", self.style.rstrip(), ""])
        return " ".join(self.words(1, 18) + self.r.choice(["."] * 8 + ["!", "?"]) for _ in range(self.r.randint(low, high)))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.words(low, high)}</a>'

    def named(self, part: str, inner: str, tagged: float = 0.5) -> str:
        """inner in an element of the part: by tag, by name, or both."""
        r = self.r
        tag = _PART_TAGS[part] if r.random() < tagged else "div"
        if tag == "ul":
            inner = f"<li>{inner}</li>"
        name = r.choice(_PARTS[part].split())
        named = tag in ("div", "section", "ul") or r.random() < 0.4
        attribute = f' {r.choice(["class", "class", "class", "id"])}="{name}{r.choice(self.SUFFIXES)}"' if named else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def other(self, part: str) -> str:
        r = self.r
        if part in ("menu", "share"):
            items = [self.link() for _ in range(r.randint(2, 8))]
            return self.named(part, r.choice([f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>", " | ".join(items), " ".join(items)]))
        if part == "header":
            return self.named(part, r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(1, 6)}</p>", self.link(), self.link() + f"<p>{self.words(2, 8)}</p>"]))
        if part == "footer":
            mark = r.choice(["&copy; ", "&copy; 2020 ", "Copyright ", ""])
            return self.named(part, r.choice([f"{mark}{self.words(1, 4)}", f"<p>{mark}{self.words(1, 6)} &middot; {self.sentences(1, 2)}</p>", f"{mark}{self.words(1, 3)}<ul>{''.join(f'<li>{self.link()}</li>' for _ in range(3))}</ul>"]), 0.7)
        if part == "sidebar":
            items = "".join(f"<li>{self.link(2, 7)}</li>" for _ in range(r.randint(2, 6)))
            return self.named(part, f"<h3>{self.words(1, 3)}</h3><ul>{items}</ul>" + (f"<p>{self.sentences(1, 4)}</p>" if r.random() < 0.5 else ""))
        if part == "form":
            inner = f'<label>{self.words(1, 3)}</label><input name="q"><p>{self.sentences(1, 2)}</p><button>{self.words(1, 2)}</button>'
            return self.named(part, inner, 0.8)
        if part == "comments":
            each = [f'<div class="{r.choice(["comment", "reply", "comment-body"])}"><p>{self.words(1, 2)}</p><p>{self.sentences(1, 6)}</p></div>' for _ in range(r.randint(1, 4))]
            return self.named(part, f"<h3>{self.words(1, 3)}</h3>" + "".join(each))
        return self.named(part, r.choice([self.sentences(1, 5), f"<p>{self.sentences(1, 5)}</p>", f"<p>{self.words(2, 6)} {self.link()}</p>"]), 0.2)

    def main_block(self) -> str:
        r, m = self.r, self.MAIN
        kind = r.random()
        if kind < 0.66:
            inner = self.sentences(1, r.choice([1, 3, 8, 20]))
            if r.random() < 0.2:
                inner += " " + self.link(1, 4) + " " + self.words(1, 8) + "."
            if r.random() < 0.15:
                return f"<p>{m}<b>{inner}<br>"
            if r.random() < 0.1:
                inner = self.words(1, 2) + "."
            return f"<p>{m}{inner}" + r.choice(["</p>", "</p>", ""])
        if kind < 0.78:
            return f"<h{r.choice('2234')}>{m}{self.words(1, 9)}</h2>"
        if kind < 0.87:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>{''.join(f'<li>{m}{self.words(1, 14)}</li>' for _ in range(r.randint(2, 5)))}</{tag}>"
        if kind < 0.92:
            return f"<blockquote><p>{m}{self.sentences(1, 3)}</p></blockquote>"
        if kind < 0.95:
            return f"<pre>{m}{self.words(2, 20, False)}</pre>"
        rows = "".join(f"<tr><td>{m}{self.words(1, 2)}</td><td>{m}{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 3)))
        return f"<table>{rows}</table>"

    def page(self) -> str:
        r, m = self.r, self.MAIN
        inner = []
        if r.random() < 0.85:
            title = f"<h1>{m}{self.words(2, 12)}</h1>"
            inner.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        for _ in range(r.choice([0, 1, 2, 4, 8, 16])):
            inner.append(self.main_block())
            if r.random() < 0.07:
                inner.append(self.other(r.choice(["advert", "share", "form", "sidebar", "notice"])))
        if r.random() < 0.12:
            inner.append(self.other(r.choice(["comments", "share", "footer"])))
        body, kind = "".join(inner), r.random()
        name = r.choice(_PARTS["main"].split()) + r.choice(self.SUFFIXES)
        if kind < 0.45:
            body = f"<article>{body}</article>"
        elif kind < 0.6:
            body = f'<article class="{name}">{body}</article>'
        elif kind < 0.7:
            body = f"<main>{body}</main>"
        elif kind < 0.93:
            body = f'<div class="{name}">{body}</div>'
        if r.random() < 0.2:
            body = f"<main>{body}</main>"
        before = [self.other(p) for p in ("header", "menu", "notice", "advert", "menu", "form") if r.random() < 0.4]
        after = [self.other(p) for p in ("share", "comments", "sidebar", "advert", "form", "notice") if r.random() < 0.25]
        if r.random() < 0.9:
            after.append(self.other("footer"))
        r.shuffle(before)
        return f"<html><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def labelled_pages(count: int, seed: int = 0) -> list[tuple[str, list[int]]]:
    """Pages and, for each of their blocks, whether it is main text."""
    out = []
    for i in range(count):
        marked = _Maker(seed * 1_000_003 + i).page()
        labels = [int(_Maker.MAIN in b.text) for b in blocks(marked)]
        out.append((marked.replace(_Maker.MAIN, ""), labels))
    return out


#: Pages that the field is trained on.
TRAINING_PAGES = 700
_field: Field | None = None


def trained_field() -> Field:
    """The field, trained once in a process."""
    global _field
    if _field is None:
        _field = train([(features(blocks(p)), labels) for p, labels in labelled_pages(TRAINING_PAGES)])
    return _field


def main_text(page: str | None, model: Field) -> str:
    """The main blocks of a page, joined by newlines."""
    found = blocks(page or "", model.names)
    return "\n".join(b.text for b, label in zip(found, model.decode(each_features(found)), strict=True) if label)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""
    ship(pages.sparkSession)
    model = model or trained_field()
    id_kind, url_kind = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x.as_py(), model) for x in part.column(2)]
                sizes = pa.array(list(map(len, texts)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {id_kind}, url {url_kind}, text string, n_chars long")
