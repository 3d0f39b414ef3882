"""Main text of web pages: boosted trees over DOM-node features, then hierarchical decoding.

Each block element is a node with features of its tag, its class and id words, its place, its siblings and its
subtree's text, links and forms. Gradient-boosted trees, trained here on generated pages whose main text is known,
give each node's log-odds. A tree recursion then picks the best labelling in which content may only stand below
undecided or content nodes and nothing below a discarded node is content, so no choice contradicts an ancestor's.

Scripts, styles and other raw elements go with what they hold, as markup.tokens() has it. Vector graphics, templates,
selections and noscript are parsed and dropped: they end with their end tag, with their parent, or, for graphics, when
they close themselves or a block starts in them.

Null html counts as empty; a page without a content node has an empty text. Pages may be of any length. Repeated rows
are each extracted; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_slices, map_arrow, table
from .markup import END, HELD, RAW, TEXT, tokens

_ATTR = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements that are parsed, and dropped with all that they hold.
_DROPPED = frozenset("noscript template select svg".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("b i em strong span u s small big sub sup code kbd samp var mark q cite abbr time font tt ins del dfn bdi bdo label wbr img input source track area".split())
#: Tags that end an open element of the listed tags when they start.
_CLOSES = {t: ("p",) for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()} | {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Tags that can't stand in vector graphics and so end them.
_BREAKS = frozenset([*_CLOSES, "body"]) - {"option"}
_SCOPES = frozenset("ul ol dl table body html article aside section div nav main header footer form td".split())
TAGS = "body article main section div p h1 h2 h3 ul ol li a nav header footer aside form table tr td blockquote pre figure figcaption dl".split()
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
#: Words in class, id and role that speak for or against content.
WORDS = {
    "content": "content article post entry story body text main articlebody hentry".split(),
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs tabs toolbar pagination pager skip".split(),
    "head": "header masthead banner top logo branding".split(),
    "foot": "footer foot copyright bottom colophon legal".split(),
    "side": "sidebar aside side widget related recommended popular trending more complementary rail".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup".split(),
    "talk": "comment comments reply replies respond disqus discussion reader reviews".split(),
    "share": "share social sharing meta byline tags author login search".split(),
}
_KINDS = [(k, frozenset(v)) for k, v in WORDS.items()]
FEATURES = len(TAGS) + 1 + 2 * len(WORDS) + 14


class Page:
    """Nodes in page order, and the text pieces with the node each belongs to."""

    def __init__(self, source: str) -> None:
        self.tags, self.parent, self.attrs, self.depth = ["html"], [-1], [""], [0]
        self.pieces: list[tuple[int, str]] = []
        stack, names, open_ = [0], ["html"], Counter()

        def close(at: int) -> None:
            """Ends the open elements from this place on; a node of -1 is dropped."""
            open_.subtract(names[at:])
            del names[at:], stack[at:]

        for kind, name, rest in tokens(source):
            node = stack[-1]
            if kind == TEXT:
                if node >= 0:
                    self.pieces.append((node, rest))
                continue
            if kind == HELD or name in RAW or name in _INLINE:
                continue
            if kind == END:
                if open_[name] > 0:
                    at = len(names) - 1
                    while names[at] != name:
                        at -= 1
                    close(at)
                if stack[-1] >= 0:
                    self.pieces.append((stack[-1], " "))
                continue
            if name == "html" or name == "body" and open_[name] > 0:
                continue
            if name in _BREAKS and open_["svg"] > 0 and not open_["foreignobject"] > 0:
                close(names.index("svg"))
            for other in _CLOSES.get(name, ()):
                if open_[other] <= 0:
                    continue
                for i in range(len(names) - 1, 0, -1):
                    if names[i] == other:
                        close(i)
                        break
                    if names[i] in _SCOPES or names[i] in _DROPPED:
                        break
            node = stack[-1]
            if name in ("br", "hr"):
                if node >= 0:
                    self.pieces.append((node, " "))
                continue
            if name in _VOID:
                continue
            if node < 0 or name in _DROPPED:
                if not (rest.endswith("/") and (name == "svg" or open_["svg"] > 0)):
                    stack.append(-1)
                    names.append(name)
                    open_[name] += 1
                continue
            if name != "a":
                self.pieces.append((node, " "))
            self.tags.append(name)
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
            self.attrs.append(" ".join(_ATTR.findall(rest)).lower() if rest else "")
            stack.append(len(self.tags) - 1)
            names.append(name)
            open_[name] += 1

    def features(self) -> np.ndarray:
        n = len(self.tags)
        own, commas, inputs, first = [0] * n, [0] * n, [0] * n, [-1] * n
        seen = 0
        for k, t in self.pieces:
            size = len(t)
            if size > 1 or t != " ":
                own[k] += size
                commas[k] += t.count(",") + t.count(".")
                if first[k] < 0:
                    first[k] = seen
                seen += size
        size, links, nodes, paragraphs, marks, kids = own[:], [o if t == "a" else 0 for o, t in zip(own, self.tags, strict=True)], [1] * n, [t == "p" for t in self.tags], commas[:], [0] * n
        nth, anchors = [0] * n, [t == "a" for t in self.tags]
        for k in range(1, n):
            p = self.parent[k]
            nth[k] = kids[p]
            kids[p] += 1
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            for x in (size, links, nodes, paragraphs, marks, anchors):
                x[p] += x[k]
            if first[k] >= 0 and (first[p] < 0 or first[k] < first[p]):
                first[p] = first[k]
        x = np.zeros((n, FEATURES), np.float32)
        kinds, above = len(TAGS) + 1, len(TAGS) + 1 + len(WORDS)
        hold = {"nav": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "notice", "article": "content", "main": "content"}
        names = list(WORDS)
        for k in range(n):
            x[k, _TAG_AT.get(self.tags[k], len(TAGS))] = 1
            if self.attrs[k]:
                have = set(_WORD.findall(self.attrs[k]))
                for i, (_, ws) in enumerate(_KINDS):
                    if not ws.isdisjoint(have):
                        x[k, kinds + i] = 1
            if k:
                p = self.parent[k]
                x[k, above : above + len(WORDS)] = np.maximum(x[p, above : above + len(WORDS)], x[p, kinds : kinds + len(WORDS)])
                if self.tags[p] in hold:
                    x[k, above + names.index(hold[self.tags[p]])] = 1
        total = max(1, size[0])
        s, par = np.array(size, np.float32), np.maximum(self.parent, 0)
        nodes_a, kids_a, nth_a = np.array(nodes, np.float32), np.array(kids, np.float32), np.array(nth, np.float32)
        rest = [np.log1p(s), np.log1p(np.array(own, np.float32)), s / total, np.array(links, np.float32) / np.maximum(s, 1), s / nodes_a, np.array(paragraphs, np.float32), np.array(anchors, np.float32) / nodes_a, np.array(marks, np.float32) / np.maximum(s, 1), np.array(self.depth, np.float32), nth_a, kids_a[par] - nth_a, kids_a[par], np.maximum(np.array(first, np.float32), 0) / total, s / np.maximum(s[par], 1)]
        x[:, above + len(WORDS) :] = np.stack(rest, 1)
        self.size = size
        return x

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """Nodes labelled content, by the best consistent labelling: open (0), content (1) or discarded (2)."""
        n = len(self.tags)
        weight = 1 + np.log1p(np.array(self.size, np.float64))
        yes = (odds * weight).tolist()
        best = [[0.0, y, 0.0] for y in yes]
        for k in range(n - 1, 0, -1):
            p, (a, b, c) = best[self.parent[k]], best[k]
            p[0] += max(a, b, c)
            p[1] += max(b, c)
            p[2] += c
        label = [0] * n
        for k in range(n):
            a, b, c = best[k]
            above = label[self.parent[k]] if k else 0
            label[k] = 2 if above == 2 else (1 if b > c else 2) if above == 1 else (1 if b > max(a, c) else 0 if a > c else 2)
        return np.array(label) == 1

    def text(self, content: np.ndarray) -> str:
        keep = content.tolist()
        return " ".join(entities.unescape("".join(t if keep[k] else " " for k, t in self.pieces)).split())


class Trees:
    """Gradient-boosted trees with logistic loss, grown level by level on binned features."""

    def __init__(self, rounds: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32) -> None:
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int32)
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(e, x[:, j], "right")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(np.unique(x[:, j])) > self.bins else np.unique(x[:, j])[1:] for j in range(x.shape[1])]
        b, f = self._binned(x), np.zeros(len(y))
        width = max(len(e) for e in self.edges) + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = (y - p) * weight, p * (1 - p) * weight
            at = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth, np.int64), np.full(2**self.depth, width, np.int64)
            for level in range(self.depth):
                k = 2**level
                most, lam = np.full(k, 1e-6), 1.0
                for j in range(x.shape[1]):
                    i = (at - (k - 1)) * width + b[:, j]
                    gs, hs = (np.cumsum(np.bincount(i, v, k * width).reshape(k, width), 1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + lam) + (gt - gs) ** 2 / (ht - hs + lam) - gt**2 / (ht + lam)
                    c = gain.argmax(1)
                    v = gain[np.arange(k), c]
                    better = v > most
                    most[better] = v[better]
                    feature[k - 1 : 2 * k - 1][better] = j
                    cut[k - 1 : 2 * k - 1][better] = c[better]
                at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1.0)
            self.trees.append((feature, cut, value))
            f += value[leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, f, rows = self._binned(x), np.zeros(len(x)), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            f += value[at - (2**self.depth - 1)]
        return f


class Generator:
    """Pages with known main text; content nodes carry the attribute that training reads and extraction never sees."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        style = r.random()
        tail = "***" if style < 0.05 else " |" if style < 0.1 else "!!" if style < 0.13 else ""
        ws = ["".join(r.choice(("ta", "ne", "ri", "so", "the", "an", "lu", "mi", "ko", "ing", "é", "sch")) for _ in range(r.randint(1, 4))) + tail for _ in range(r.randint(lo, hi))]
        for i in range(len(ws)):
            if r.random() < 0.1:
                ws[i] += r.choice((".", ",", ".", "&amp;"))
        return " ".join(ws).capitalize()

    def links(self, lo: int, hi: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{self.words(1, 3)}</a></li>' for _ in range(self.r.randint(lo, hi))) + "</ul>"

    def paragraphs(self, lo: int, hi: int) -> str:
        r, out = self.r, ""
        for _ in range(r.randint(lo, hi)):
            t = self.words(1, 12) if r.random() < 0.2 else self.words(8, 80)
            if r.random() < 0.15:
                t = t.replace(" ", ' <a href="/y">', 1) + "</a>"
            out += r.choice((f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>"))
        return out

    def article(self) -> str:
        r = self.r
        body = ("" if r.random() < 0.15 else f"<h1>{self.words(1, 9)}</h1>") + self.paragraphs(1, r.choice((2, 6, 14)))
        for _ in range(r.randint(0, 2)):
            body += r.choice((lambda: f"<h2>{self.words(1, 6)}</h2>" + self.paragraphs(1, 4), lambda: "<ul>" + "".join(f"<li>{self.words(2, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>", lambda: f"<blockquote>{self.words(5, 30)}</blockquote>", lambda: f"<pre>{self.words(4, 20)}</pre>", lambda: "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"))()
        extra = [f'<div class="{r.choice(("share", "social-links"))}">{self.links(2, 4)}</div>', f'<div class="{r.choice(("ad", "advert", "sponsored"))}">{self.words(3, 25)}</div>', f'<aside class="related">{self.links(2, 5)}</aside>']
        junk = "".join(x for x in extra if r.random() < 0.15)
        return r.choice((f"<article>{body}@{junk}</article>", f"<article>{body}@{junk}</article>", f'<article class="post">{body}@{junk}</article>', f'<div class="{r.choice(("content", "post-body", "entry-content", "article-text"))}">{body}@{junk}</div>', f"<main>{body}@{junk}</main>", f'<main><article>{body}@{junk}</article></main>', f'<div id="main-content">{body}@{junk}</div>'))

    def page(self) -> tuple[str, str]:
        """The page, with the article between two control characters that mark it for training."""
        r = self.r
        pick = lambda p, f: f() if r.random() < p else ""
        talk = lambda: "".join(f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.words(3, 40)}</p></div>' for _ in range(r.randint(1, 6)))
        before = [
            pick(0.3, lambda: r.choice((f"<header><a href='/'>{self.words(1, 3)}</a><p>{self.words(2, 9)}</p></header>", f'<div class="header"><h1>{self.words(1, 3)}</h1></div>', f'<div id="masthead">{self.words(1, 6)}</div>'))),
            pick(0.7, lambda: r.choice((f"<nav>{self.links(3, 9)}</nav>", f'<div class="{r.choice(("menu", "navbar", "nav-main"))}">{self.links(3, 9)}</div>', f'<nav><a href="/">{self.words(1, 2)}</a> <a href="/a">{self.words(1, 2)}</a></nav>'))),
            pick(0.3, lambda: f'<div class="{r.choice(("cookie-notice", "consent", "notice", "gdpr-banner"))}"><p>{self.words(5, 30)}</p><button>{self.words(1, 2)}</button></div>'),
            pick(0.5, lambda: f'<div class="{r.choice(("ad", "ads", "advert", "sponsor", "promo"))}">{self.words(3, 40)}</div>'),
            pick(0.1, lambda: f'<form action="/s"><label>{self.words(1, 2)}</label><input name="q"></form>'),
            pick(0.1, lambda: f'<div class="breadcrumbs">{self.links(2, 4)}</div>'),
        ]
        r.shuffle(before)
        after = [
            pick(0.35, lambda: r.choice((f"<aside><h3>{self.words(1, 3)}</h3>{self.links(2, 7)}<p>{self.words(3, 30)}</p></aside>", f'<div class="sidebar"><h3>{self.words(1, 3)}</h3><p>{self.words(4, 30)}</p>{self.links(1, 5)}</div>'))),
            pick(0.35, lambda: r.choice((f'<section id="comments"><h2>{self.words(1, 2)}</h2>{talk()}</section>', f'<div class="comments">{talk()}</div>', f'<section class="comment-list"><ol>' + "".join(f"<li><p>{self.words(3, 40)}</p></li>" for _ in range(3)) + "</ol></section>"))),
            pick(0.25, lambda: f'<form class="{r.choice(("newsletter", "signup", "search"))}"><p>{self.words(2, 20)}</p><input name="m"></form>'),
            pick(0.2, lambda: f'<div class="ad">{self.words(3, 40)}</div>'),
            pick(0.2, lambda: f'<div class="related-posts"><h3>{self.words(1, 3)}</h3>{self.links(2, 6)}</div>'),
        ]
        r.shuffle(after)
        foot = pick(0.85, lambda: r.choice((f"<footer>&copy; {self.words(2, 30)}</footer>", f'<div class="footer"><p>{self.words(3, 25)}</p>{self.links(1, 4)}</div>', f"<footer><p>{self.words(3, 20)}</p>{self.links(1, 3)}</footer>")))
        a, _, z = self.article().partition("@")
        whole = f"{''.join(before)}\x01{a}\x02{z}{''.join(after)}{foot}"
        if r.random() < 0.2:
            whole = f'<div id="{r.choice(("wrapper", "page", "container"))}">{whole}</div>'
        return f"<!DOCTYPE html><html><head><title>t</title></head><body>{whole}</body></html>"


def labelled(source: str) -> tuple[Page, np.ndarray]:
    """A generated page without its control characters, and whether each node is mostly main text."""
    page = Page(source)
    n, inside, main, size, pieces = len(page.tags), False, [0] * len(page.tags), [0] * len(page.tags), []
    for k, t in page.pieces:
        clean = ""
        for part in re.split("([\x01\x02])", t):
            if part in ("\x01", "\x02"):
                inside = part == "\x01"
            else:
                clean += part
                got = len(part.strip())
                main[k] += got * inside
                size[k] += got
        pieces.append((k, clean))
    page.pieces = [(k, t) for k, t in pieces if t]
    for k in range(n - 1, 0, -1):
        main[page.parent[k]] += main[k]
        size[page.parent[k]] += size[k]
    # a node that holds other things beside the article is no content itself
    return page, np.array([s > 0 and m >= 0.5 * s and (t not in ("body", "html") and m >= 0.97 * s or t in ("article", "main") or m >= 0.9 * s and t not in ("body", "html")) for m, s, t in zip(main, size, page.tags, strict=True)], np.float64)


_MODEL: list[Trees] = []


def model(pages: int = 700, seed: int = 7) -> Trees:
    """Trained once in a process, from the seed."""
    if not _MODEL:
        g = Generator(seed)
        made = [labelled(g.page()) for _ in range(pages)]
        x = np.concatenate([p.features() for p, _ in made])
        weight = np.concatenate([1 + np.log1p(np.array(p.size)) for p, _ in made])
        _MODEL.append(Trees().fit(x, np.concatenate([y for _, y in made]), weight))
    return _MODEL[0]


def main_texts(sources: list[str], trees: Trees) -> list[str]:
    pages = [Page(s) for s in sources]
    x = [p.features() for p in pages]
    odds = trees.log_odds(np.concatenate(x)) if x else np.empty(0)
    at = np.cumsum([len(v) for v in x])
    return [p.text(p.decode(o)) for p, o in zip(pages, np.split(odds, at[:-1]), strict=True)] if x else []


def _extract(shared):
    def rows(batch: pa.RecordBatch) -> dict:
        html, out = [h or "" for h in batch.column(2).to_pylist()], []
        for a, b in byte_slices([len(h) for h in html], 2 << 20):
            out += main_texts(html[a:b], shared.value)
        return {"page_id": batch.column(0), "url": batch.column(1), "text": out, "n_chars": [len(t) for t in out]}

    return rows


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model())
    return map_arrow(pages.select("page_id", "url", "html"), _extract(shared), f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
