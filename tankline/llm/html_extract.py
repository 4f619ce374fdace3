"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page, decoded by Viterbi."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# How HTML's elements behave.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("noscript template svg object canvas select math".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article aside nav div section main header footer form body td th blockquote figure".split())

#: Pages of the labelled sample at most, passes over it, and the size of the hashed feature space.
SAMPLE_PAGES, PASSES, SPACE = 200, 150, 1 << 13
#: Pages of up to so many characters are taken for the sample before longer ones.
SHORT_PAGE = 60_000
#: How many of the elements above a block give it features, the nearest ones.
NEAREST = 32
#: Blocks, counted with padding, that forward-backward takes at once.
CELLS = 200_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
_TAG_TO_NEXT = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
_TAG_START = re.compile(r"</?[A-Za-z]|<[!?]")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_P = frozenset("p")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_NAME = re.compile(r"[A-Za-z]+")
_LONG_REFERENCE = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9A-Fa-f]{7,}));?")


@dataclass
class Block:
    """A leaf block: its text, the tags and the class and id words above it, its own tag, and how much of it is links."""

    text: str
    path: tuple[str, ...]
    linked: int


def unescaped(text: str) -> str:
    """Character references decoded; a number that no character has becomes U+FFFD, however long it is."""

    def short(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0") or "0"
        return "\ufffd" if len(digits) > 7 else f"&#{'' if m[1] else 'x'}{digits};"

    return html.unescape(_LONG_REFERENCE.sub(short, text) if "&#" in text else text)


class _Open:
    """The elements that are open at a place of a page, with the places of each tag, so that none need be searched for."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, names))

    def last(self, tags: frozenset[str] | set[str]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def pop(self, tags: frozenset[str] | set[str], scope: frozenset[str]) -> None:
        """Close the innermost element of tags with all in it, unless one of scope is further in."""
        at = self.last(tags)
        if at >= 0 and at >= self.last(scope):
            for tag, _ in self.stack[at:]:
                self.places[tag].pop()
            del self.stack[at:]


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order: runs of text between the borders of block elements, references decoded and
    white space made one blank. Scripts, styles, titles, comments and other content that isn't shown are left out; of
    these, scripts and other raw text go on to the end of the page where they aren't closed, and the rest is then read as
    if they weren't there. Elements left open end where HTML ends them: p at the next block, li at the next li, the rest
    with their parent."""
    page = page or ""
    out: list[Block] = []
    open_ = _Open()
    parts: list[str] = []
    never: set[str] = set()
    linked = at = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", unescaped("".join(parts))).strip(" ")
            if text:
                out.append(Block(text, tuple(x for tag, names in open_.stack[-NEAREST:] for x in (tag, *names)), linked))
            parts.clear()
            linked = 0

    def close(name: str) -> int:
        """Where the content of an element ends that isn't read, or -1."""
        found = None if name in never else re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I).search(page, at)
        if not found:
            never.add(name)
        return found.end() if found else -1

    tag, last_close = _TAG, page.rfind(">")

    def next_tag() -> re.Match | None:
        """The next tag. Once a tag's quotes leave it open to the end of the page, it and all later ones end at the next >."""
        nonlocal tag
        start = page.find("<", at)
        while start >= 0:
            m = tag.match(page, start)
            if not m and tag is _TAG and _TAG_START.match(page, start):
                tag = _TAG_TO_NEXT
                m = tag.match(page, start)
            if m:
                return m
            if start > last_close:
                return None
            start = page.find("<", start + 1)
        return None

    while True:
        m = next_tag()
        chunk = page[at : m.start()] if m else page[at:]
        if chunk:
            parts.append(chunk)
            if open_.places.get("a"):
                linked += len(chunk)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name not in INLINE and name not in UNSEEN:
                end_block()
            open_.pop({name}, frozenset() if name in SCOPES else SCOPES)
            continue
        if name in RAW or name in UNSEEN:
            if name not in ("noscript", "svg", "math", "object", "iframe") and (name in RAW or name not in never):
                end_block()
            if not m[3].endswith("/") or name in RAW:
                end = close(name)
                at = end if end >= 0 else len(page) if name in RAW else at
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            end_block()
            open_.pop(_P, SCOPES)
            if name in CLOSES:
                open_.pop(CLOSES[name], SCOPES - {"td", "th"} if name == "tr" else SCOPES)
        if name not in VOID:
            open_.push(name, tuple("." + w.lower() for a in _ATTR.findall(m[3]) for w in _NAME.findall(" ".join(a))) if m[3] else ())
    end_block()
    return out


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SPACE


def _size(n: float, steps: tuple) -> int:
    return sum(n >= s for s in steps)


_slots: dict[tuple[str, ...], list[int]] = {}


def features(page: list[Block]) -> list[list[int]]:
    """The slots of each block's features: tags and names above it, the nearest block tag, and what its text is like."""
    out = []
    for i, b in enumerate(page):
        if (known := _slots.get(b.path)) is None:
            tags = [x for x in b.path if x[0] != "." and x not in INLINE]
            own = tags[-1] if tags else "none"
            known = [_slot("bias"), _slot(f"own={own}"), *{_slot(f"above={x}") for x in tags[:-1]}, *{_slot(f"name={x}") for x in b.path if x[0] == "."}, *{_slot(f"stem={x[:5]}") for x in b.path if x[0] == "."}]
            if len(_slots) > 50_000:
                _slots.clear()
            _slots[b.path] = known
        n = len(b.text)
        words = b.text.count(" ") + 1
        about = (
            f"long={_size(n, (12, 25, 50, 100, 200, 400))}",
            f"links={_size(b.linked / (n + 1), (0.05, 0.3, 0.7))}",
            f"ends={b.text[-1] if b.text[-1] in '.!?:;,|»' else 'other'}",
            f"marks={_size(sum(map(b.text.count, '.,;')) / words, (0.02, 0.08, 0.3))}",
            f"sign={b.text[0] if b.text[0] in '©®|' else ''}",
            f"first={i == 0}", f"last={i == len(page) - 1}",
        )
        out.append(known + [_slot(x) for x in about])
    return out


class Chain:
    """The field: a weight for each (feature, label), and for each pair of neighbouring labels. Label 1 is the article."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest sequence of labels (Viterbi); of equal ones label 0."""
        if not rows:
            return []
        (aa, ab), (ba, bb) = self.moves.tolist()
        scores = np.array([self.weights[r].sum(axis=0) for r in rows]).tolist()
        x, y = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            p, q = x + aa >= y + ba, x + ab >= y + bb
            back.append((0 if p else 1, 0 if q else 1))
            x, y = (x + aa if p else y + ba) + s0, (x + ab if q else y + bb) + s1
        labels = [0 if x >= y else 1]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class _Padded:
    """Labelled pages of about one length, padded to the longest, and the slopes of their likelihood."""

    def __init__(self, pages: list[tuple[list[list[int]], list[int]]], used: np.ndarray):
        sizes = np.array([len(p[1]) for p in pages])
        self.n, self.longest, self.blocks, self.features = len(pages), int(sizes.max()), int(sizes.sum()), len(used)
        self.inside = np.arange(self.longest) < sizes[:, None]
        self.local = np.searchsorted(used, [s for rows, _ in pages for r in rows for s in r])
        self.block = np.repeat(np.arange(self.blocks), [len(r) for rows, _ in pages for r in rows])
        gold = np.zeros((self.n, self.longest), int)
        gold[self.inside] = [y for _, ys in pages for y in ys]
        self.told = np.eye(2)[gold]
        self.both = self.inside[:, 1:]
        self.gold_moves = np.einsum("nta,ntb,nt->ab", self.told[:, :-1], self.told[:, 1:], self.both.astype(float))

    def slopes(self, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = np.zeros((self.n, self.longest, 2))
        score[self.inside] = np.stack([np.bincount(self.block, weights[self.local, y], minlength=self.blocks) for y in (0, 1)], axis=1)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, self.longest):
            go = _logsum(ahead[:, t - 1, :, None] + moves, 1) + score[:, t]
            ahead[:, t] = np.where(self.inside[:, t, None], go, ahead[:, t - 1])
        for t in range(self.longest - 2, -1, -1):
            go = _logsum(moves + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(self.inside[:, t + 1, None], go, 0.0)
        total = _logsum(ahead[:, -1], 1)
        belief = np.exp(ahead + behind - total[:, None, None]) * self.inside[..., None]
        pair = np.exp(ahead[:, :-1, :, None] + moves + (score + behind)[:, 1:, None, :] - total[:, None, None, None]) * self.both[..., None, None]
        error = (belief - self.told * self.inside[..., None])[self.inside]
        own = np.stack([np.bincount(self.local, error[self.block, y], minlength=self.features) for y in (0, 1)], axis=1)
        return own, pair.sum(axis=(0, 1)) - self.gold_moves


def fit(pages: list[tuple[list[list[int]], list[int]]], passes: int = PASSES, rate: float = 0.1, decay: float = 1e-3) -> Chain:
    """The field of greatest likelihood on labelled pages (feature slots and labels of each block), by Adam on the exact
    gradient from forward-backward; pages of about one length go through together."""
    pages = [p for p in pages if p[1]]
    chain = Chain(np.zeros((SPACE, 2)), np.zeros((2, 2)))
    if not pages:
        return chain
    pages = sorted(pages, key=lambda p: len(p[1]))
    groups, first = [], 0
    for i in range(len(pages)):
        if i + 1 == len(pages) or (i + 2 - first) * len(pages[i + 1][1]) > CELLS:
            groups.append(pages[first : i + 1])
            first = i + 1
    used = np.unique([s for rows, _ in pages for r in rows for s in r])
    groups = [_Padded(g, used) for g in groups]
    params = [np.zeros((len(used), 2)), np.zeros((2, 2))]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, passes + 1):
        slopes = [sum(x) / len(pages) for x in zip(*(g.slopes(*params) for g in groups))]
        for i, g in enumerate(slopes):
            g = g + decay * params[i]
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            params[i] = params[i] - rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    chain.weights[used], chain.moves = params
    return chain


# What sites call the parts of a page, the elements they use for them, and how they wrap an article.
PARTS = {
    "header": ("header div", "header masthead site-header topbar branding logo page-header banner"),
    "menu": ("nav ul div", "nav menu navbar navigation main-navigation breadcrumb topnav links site-nav"),
    "footer": ("footer div", "footer site-footer bottom copyright colophon site-info contentinfo legal"),
    "side": ("aside div section", "sidebar aside widget widget-area secondary rail related recommended recent-posts popular more"),
    "advert": ("div aside section", "ad ads advert advertisement adsbygoogle ad-slot sponsor sponsored promo promotion banner"),
    "notice": ("div section", "cookie cookie-notice cookie-consent gdpr privacy-notice alert notice popup modal newsletter subscribe signup paywall"),
    "comments": ("section div ol", "comments comment-list commentlist reader-comments replies respond discussion disqus responses feedback"),
    "form": ("form form div", "search search-form login contact-form form newsletter-form poll"),
    "share": ("div ul p", "share social sharing tags post-meta byline author breadcrumbs toolbar"),
}
WRAPS = ("article", "main", "section", "div", "article post", "div content", "div post", "div entry", "section story", "div text", "div main", "div article", "main primary", "div main-content", "div entry-content", "div post-body", "td text", "div page", "section", "div")


def labelled(texts: list[list[str]], each: int = 3) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages: each text (a title and paragraphs) in some layouts, put together from the parts above by a seeded
    draw. The other parts' sentences come from other texts, so that it is the place, not the words, that tells them."""
    pages = []
    for i in range(each * len(texts)):
        draw = random.Random(i)
        own, other = texts[i // each], draw.choice(texts)
        rest = [w for p in other for w in re.split(r"(?<=[.!?])\s", p)] or ["More"]
        short = lambda: html.escape(" ".join(draw.choice(rest).split()[: draw.randrange(1, 6)]) or "More")
        sentence = lambda: html.escape(draw.choice(rest))
        links = lambda n: "".join(f'<li><a href="/{k}">{short()}</a></li>' if draw.random() < 0.7 else f'<a href="/{k}">{short()}</a> ' for k in range(n))

        def inner(kind: str) -> str:
            if kind in ("menu", "share"):
                return links(draw.randrange(2, 8))
            if kind == "header":
                return draw.choice((f"<h1>{short()}</h1>", f"<p>{short()}</p>", short())) + draw.choice(("", f"<nav>{links(4)}</nav>"))
            if kind == "footer":
                return draw.choice((f"&copy; {short()} &middot; {sentence()}", f"<p>{short()}</p>", f"<p>{sentence()}</p>", links(4)))
            if kind == "side":
                return f"<h3>{short()}</h3>" + draw.choice((f"<ul>{links(5)}</ul>", f"<p>{sentence()}</p>", f"<ul>{links(3)}</ul><p>{sentence()}</p>"))
            if kind == "comments":
                made = "".join(draw.choice(("<div class=\"comment\"><p>{0} {1}</p></div>", "<p>{0} {1}</p>", "<li><b>{2}</b> <p>{0}</p><p>{1}</p></li>", "<div>{0}</div>")).format(sentence(), sentence(), short()) for _ in range(draw.randrange(1, 6)))
                return draw.choice(("", f"<h3>{short()}</h3>")) + made + draw.choice(("", f"<form><label>{short()}</label><input><button>{short()}</button></form>"))
            if kind == "form":
                return f"<label>{short()}</label><input>" + draw.choice((f"<button>{short()}</button>", f"<p>{sentence()}</p>"))
            return draw.choice((f"<p>{sentence()}</p>", sentence(), f"<p>{sentence()} {sentence()}</p><button>{short()}</button>", f"<h4>{short()}</h4><p>{sentence()}</p>"))

        def part(kind: str, chance: float = 1.0) -> str:
            if draw.random() >= chance:
                return ""
            tags, names = (x.split() for x in PARTS[kind])
            tag = draw.choice(tags)
            plain = tag in ("nav", "header", "footer", "aside", "form") and draw.random() < 0.5
            name = "" if plain else f' {draw.choice(("class", "class", "id", "role"))}="{draw.choice(names)}"'
            return f"<{tag}{name}>{inner(kind)}</{tag}>"

        kept = lambda content: f"<x-keep>{content}</x-keep>"
        body = [html.escape(p) for p in own[1:] or own]
        wrap = draw.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}<br><p>", "<div>{}</div>", "<p><b>{}</b></p>"))
        made = [wrap.format(b) for b in body]
        for k in range(2, len(made), 3):
            made[k] = draw.choice((f"<h2>{body[k][:60]}</h2>{made[k]}", f"<ul><li>{body[k][:90]}</li><li>{body[k - 1][:70]}</li></ul>", f"<blockquote><p>{body[k]}</p></blockquote>", made[k]))
        cut = draw.randrange(len(made) + 1)
        title = draw.choice(("<h1>{}</h1>", "<h1 class=\"title\">{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>", "<header class=\"entry-header\"><h1>{}</h1></header>")).format(html.escape(own[0]))
        tag, *names = draw.choice(WRAPS).split()
        inside = draw.random() < 0.35
        content = kept(title) + part("share", 0.25) + kept("".join(made[:cut])) + part("advert", 0.15) + kept("".join(made[cut:])) + part("share", 0.2) + (part("side", 0.4) + part("comments", 0.6) if inside else "")
        name = f' class="{names[0]}"' if names else ""
        article = f"<{tag}{name}>{content}</{tag}>"
        if tag == "td":
            article = f'<table><tr><td class="menu"><ul>{links(4)}</ul></td>{article}</tr></table>'
        for outer in draw.choice(((), (), ("main",), ("div",), ("div", "main"), ("div",))):
            article = f"<{outer}>{article}{part('side', 0.3)}</{outer}>"
        page = part("notice", 0.3) + part("header", 0.6) + part("menu", 0.8) + part("form", 0.2) + part("advert", 0.35) + article + part("comments", 0.35) + part("side", 0.5) + part("form", 0.2) + part("advert", 0.2) + part("footer", 0.9) + part("notice", 0.25)
        found = blocks(f"<html><body>{page}</body></html>")
        labels = [int("x-keep" in b.path) for b in found]
        for b in found:
            b.path = tuple(x for x in b.path if x != "x-keep")
        pages.append((found, labels))
    return pages


def train(pages: DataFrame, column: str = "html", rows: int = SAMPLE_PAGES, short: int = SHORT_PAGE) -> Chain:
    """A field from at most rows pages, whole and different ones: the blocks of a page that say they are its article label that
    page, and their text fills the labelled layouts. The sample is of the least hashes among pages of up to short characters,
    and of longer ones only where there is no shorter one, as the time for training follows the sample's length. Hashes are
    picked first and only their pages fetched, so the driver gets that many pages and no more, however many there are, and
    however often one is repeated. Without such pages, a few fixed sentences fill the layouts."""
    whole = pages.filter(F.col(column).contains("<article")).select(F.xxhash64(column).alias("h"), (F.length(column) > short).alias("long"), F.col(column).alias("page"))
    least = whole.select("long", "h").distinct().orderBy("long", "h").limit(rows).collect()
    picked = [r["h"] for r in least if r["long"] == least[0]["long"]]
    few = pages.sparkSession.createDataFrame([(h,) for h in picked], "h long")
    sample = whole.join(F.broadcast(few), "h").groupBy("h").agg(F.min("page").alias("page")).orderBy("h").collect()
    told, texts = [], []
    for r in sample:
        found = blocks(r["page"])
        out = {"nav", "aside", "form", "footer", ".comments", ".comment", ".ad", ".advert"}
        labels = [int("article" in b.path and not out & set(b.path)) for b in found]
        own = [b.text for b, y in zip(found, labels) if y]
        if own:
            told.append((found, labels))
            texts.append(own)
    texts = texts or [["A quiet morning", "The river was low, and the boats lay on the sand. Nobody came.", "Later it rained."], ["On bread", "Flour, water and salt are enough; time does the rest of the work.", "Bake it hot."]]
    return fit([(features(b), y) for b, y in told + labelled(texts)])


def extract_text(page: str | None, chain: Chain) -> str:
    """The article of one page: its blocks in page order, two line breaks between them; empty if there are none."""
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, chain.decode(features(found))) if keep)


def extract(pages: DataFrame, chain: Chain, column: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of the whole html in out; a column of that name is replaced, others come back as they are.

    Null, empty and textless pages give an empty text; very long pages are read whole, in time that follows their length.
    Each row is judged by itself, so repeated rows get the same; of equally likely labels a block is not the article.
    """
    spark = pages.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(chain)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: extract_text(page, held.value)) if len(batch) else batch

    return pages.withColumn(out, main_text(F.col(column)))
