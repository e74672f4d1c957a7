"""A page's element tree as flat arrays, and features of its nodes.

A forgiving reader of tags: raw-text elements, void elements, implied ends of
paragraphs, list items and table cells, end tags without a start. Nothing is
recursive, so depth is bounded by memory alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np

# Element groups of the HTML standard.
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
                  "track", "wbr"))
BLOCK = frozenset((
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul", "br", "option", "select", "button", "label", "legend"))
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
          "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
          "option": ("option", ("select",))}
ENDS_P = BLOCK - {"br", "option", "select", "button", "label", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-label)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Nodes in page order: tag, parent, attribute words; ``texts`` are (node,
    text) in page order, ``breaks`` the places in it where a block begins or ends."""

    tags: list = field(default_factory=lambda: ["#page"])
    parents: list = field(default_factory=lambda: [-1])
    words: list = field(default_factory=lambda: [()])
    texts: list = field(default_factory=list)
    breaks: set = field(default_factory=set)


def _attribute_words(a: re.Match) -> list[str]:
    """The words of an attribute; a role is also kept as one word of its own."""
    name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
    words = ["hidden"] if name == "hidden" else _WORD.findall(value)
    return [*words, f"role:{value}"] if name == "role" else words


def parse(html: str) -> Page:
    page = Page()
    stack = [0]
    tags, parents, words, texts, breaks = page.tags, page.parents, page.words, page.texts, page.breaks
    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        raw = html[at: m.start() if m else size]
        if raw:
            texts.append((stack[-1], unescape(raw)))
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if name in BLOCK:
            breaks.add(len(texts))
        if m[1]:
            if name in VOID:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == name:
                    del stack[k:]
                    break
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                t = tags[stack[k]]
                if t == "p":
                    del stack[k:]
                    break
                if t in BLOCK:
                    break
        if name in CLOSES:
            same, until = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                t = tags[stack[k]]
                if t in until:
                    break
                if t in same.split():
                    del stack[k:]
                    break
        attrs = m[3]
        got: tuple = ()
        if attrs and "=" in attrs or "hidden" in attrs:
            got = tuple(w for a in _ATTR.finditer(attrs) for w in _attribute_words(a))
        node = len(tags)
        tags.append(name)
        parents.append(stack[-1])
        words.append(got)
        if name in VOID or attrs.endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        stack.append(node)
    return page


# Words that class names and ids commonly say a block's part in the page with.
ATTRIBUTE_GROUPS = (
    ("article", "content", "post", "entry", "story", "main", "body", "text", "prose", "page"),
    ("ad", "ads", "advert", "advertisement", "promo", "promoted", "sponsor", "sponsored", "banner"),
    ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "links"),
    ("side", "sidebar", "aside", "related", "widget", "rail", "recommended", "trending", "tags", "share", "social"),
    ("cookie", "cookies", "consent", "notice", "alert", "gdpr", "modal", "popup", "newsletter", "subscribe",
     "overlay", "warning", "toast", "paywall", "hidden", "none"),
    ("comment", "comments", "reply", "replies", "discussion", "respond", "thread", "disqus", "feedback", "review"),
    ("header", "masthead", "topbar", "top", "logo", "brand", "site"),
    ("footer", "foot", "bottom", "copyright", "legal", "colophon"),
    ("form", "search", "login", "signup", "contact", "field", "input"))
TAG_GROUPS = (
    ("article", "main"), ("nav", "menu"), ("header", "hgroup"), ("footer",), ("aside", "dialog"),
    ("form", "fieldset", "label", "button", "select", "option", "input", "legend"), ("p", "blockquote", "pre"),
    ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "li", "dl", "dt", "dd"), ("a",), ("div", "section"),
    ("table", "tbody", "tr", "td", "th"), ("head", "link", "meta", "title", "script", "style"), ("html", "body", "#page"))

_WORD_BITS = {w: 1 << k for k, g in enumerate(ATTRIBUTE_GROUPS) for w in g}
_TAG_BITS = {t: 1 << k for k, g in enumerate(TAG_GROUPS) for t in g}
N_WORDS, N_TAGS = len(ATTRIBUTE_GROUPS), len(TAG_GROUPS)
FEATURES = 2 * N_WORDS + 2 * N_TAGS + 14


def features(page: Page) -> np.ndarray:
    """One row a node: groups of its own tag and attribute words and of its
    ancestors', depth, lengths and densities of its subtree, place among siblings."""
    n = len(page.tags)
    parent = np.array(page.parents)
    own_w, own_t, up_w, up_t, depth = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n):
        w = 0
        for x in page.words[i]:
            w |= _WORD_BITS.get(x, 0)
        own_w[i], own_t[i] = w, _TAG_BITS.get(page.tags[i], 0)
        p = page.parents[i]
        if p >= 0:
            up_w[i], up_t[i], depth[i] = up_w[p] | own_w[p], up_t[p] | own_t[p], depth[p] + 1
    own = [0] * n
    marks = [0] * n
    first = [-1] * n
    seen = 0
    for node, text in page.texts:
        k = len(text) - text.count(" ") if text else 0
        if first[node] < 0:
            first[node] = seen
        own[node] += k
        marks[node] += text.count(".") + text.count(",")
        seen += k
    sub, link, sub_marks, nodes, paras = own[:], [0] * n, marks[:], [1] * n, [0] * n
    children, rank, same = [0] * n, [0] * n, [0] * n
    counts: dict = {}
    for i in range(1, n):
        p = page.parents[i]
        rank[i] = children[p]
        children[p] += 1
        counts[p, page.tags[i]] = counts.get((p, page.tags[i]), 0) + 1
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        if page.tags[i] == "a":
            link[i] = sub[i]
        if page.tags[i] == "p":
            paras[i] += 1
        sub[p] += sub[i]
        link[p] += link[i]
        sub_marks[p] += sub_marks[i]
        nodes[p] += nodes[i]
        paras[p] += paras[i]
        same[i] = counts[p, page.tags[i]]
    sub_a, link_a, nodes_a = np.array(sub, float), np.array(link, float), np.array(nodes, float)
    safe = np.maximum(parent, 0)
    bits = [np.array(b)[:, None] >> np.arange(k) & 1
            for b, k in ((own_w, N_WORDS), (up_w, N_WORDS), (own_t, N_TAGS), (up_t, N_TAGS))]
    kids = np.maximum(np.array(children), 1)
    more = np.stack([
        np.array(depth), np.log1p(own), np.log1p(sub_a), link_a / np.maximum(sub_a, 1), sub_a / nodes_a,
        np.log1p(nodes_a), np.log1p(paras), sub_a / max(sub[0], 1), np.array(sub_marks) / np.maximum(sub_a, 1),
        np.log1p(children), np.array(rank) / kids[safe], np.array(same) / kids[safe],
        sub_a[safe] / kids[safe] / np.maximum(sub_a, 1), (link_a / np.maximum(sub_a, 1))[safe]], axis=1)
    return np.concatenate([*bits, more], axis=1).astype(np.float32)


def kept_text(page: Page, keep: np.ndarray) -> str:
    """The kept nodes' own texts in page order: blocks apart by one space, white
    space within them one space, none at the ends."""
    out = []
    for k, (node, text) in enumerate(page.texts):
        if k in page.breaks:
            out.append(" ")
        if keep[node]:
            out.append(text)
    return " ".join("".join(out).split())
