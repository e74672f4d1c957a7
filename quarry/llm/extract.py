"""Operator 10, main text of web pages: gradient-boosted trees over DOM nodes.

A boosted ensemble of small histogram trees (trained here, in numpy) scores
each element from its own and its ancestors' tags and attribute words, the
density of text and links in its subtree, depth, and its place among its
siblings. Decoding is hierarchical: an element is outside, inside or off the
main text; outside may hold any, inside only inside or off, off only off. The
cheapest consistent choice for the whole tree is found in two passes, so an
ancestor and a descendant never contradict each other.

Training uses up to ``PAGES`` pages of the table, picked by hashes of the id, of
at most ``CHARS`` characters together (both bounds are parameters; a page that
doesn't fit in what is left is passed over, and where none fits, the shortest of
the draw is taken, so that any page with text makes a model): their own trees, and variants in which the same texts are
laid out in other ways, with unnamed containers and with menus, sidebars,
notices, forms and reader comments, so that the trees don't lean on one
template. A page's main part is its article elements; where it has none, its
main element, role or microdata; else a guess, the part that holds the most
text outside links. Guessed pages teach only where fewer than ``KNOWN_SHARE``
of the sample name their main part.

Defined results: a null or empty page, and one without main text, give the
empty text. Broken markup is read as far as it goes. Pages of any length are
read whole; null ids and addresses are passed on. Repeated rows give
repeated results; an empty table gives an empty result. ``extract`` keeps all
columns; ``main_text`` replaces one of that name.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarry.llm.common import read
from quarry.llm.dom import ATTRIBUTE_GROUPS, BLOCK, Page, features, kept_text, parse

PAGES = 240
CHARS = 7_200_000
VARIANTS = 4
TREES = 60
TREE_DEPTH = 4
BINS = 32
RATE = 0.2
KNOWN_SHARE = 0.5  # of the sampled pages: from here on only those that name their main part teach

# What a main part without an article element doesn't extend to.
OFF_TAGS = frozenset(("nav", "aside", "footer", "header", "form", "button", "select", "label", "dialog", "menu", "script",
                      "style", "noscript", "template", "head", "iframe", "svg"))
OFF_WORDS = frozenset(w for g in ATTRIBUTE_GROUPS[1:6] + ATTRIBUTE_GROUPS[7:] for w in g) - {"top", "bottom", "none", "tags", "review"}


@dataclass
class Boosted:
    """Complete binary trees: per level-order slot a feature and a threshold, leaf values at the end."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row."""
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(TREE_DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> Boosted:
    """Second-order boosting of the logistic loss on binned features."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    slots = (1 << TREE_DEPTH) - 1
    feature, threshold, leaf = [], [], []
    offsets = np.arange(k) * BINS
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        f, t, node = np.zeros(slots, np.int64), np.full(slots, np.inf, np.float32), np.zeros(n, np.int64)
        for level in range(TREE_DEPTH):
            first, width = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * (k * BINS) + offsets + binned).ravel()
            sums = [np.bincount(cell, np.repeat(w, k), width * k * BINS).reshape(width, k, BINS) for w in (g, h)]
            left = [np.cumsum(s, axis=2) for s in sums]
            total = [s[:, :, -1:] for s in left]
            gain = (left[0] ** 2 / (left[1] + 1) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + 1)
                    - total[0] ** 2 / (total[1] + 1))
            best = gain.reshape(width, -1).argmax(axis=1)
            for s in range(width):
                j, b = divmod(int(best[s]), BINS)
                if gain[s, j, b] > 1e-6 and b < len(cuts[j]):
                    f[first + s], t[first + s] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        at = node - slots
        leaves = 1 << TREE_DEPTH
        v = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + 1)
        score += v[at]
        feature.append(f)
        threshold.append(t)
        leaf.append(v)
    return Boosted(np.array(feature), np.array(threshold), np.array(leaf), base)


def decode(parents: list[int], score: np.ndarray) -> np.ndarray:
    """Which nodes are inside, by the cheapest consistent choice of states."""
    n = len(parents)
    cost_in, cost_off = np.logaddexp(0, -score).tolist(), np.logaddexp(0, score).tolist()
    inside, off, outside = cost_in[:], cost_off[:], cost_off[:]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        inside[p] += min(inside[i], off[i])
        off[p] += off[i]
        outside[p] += min(outside[i], inside[i])
    state = np.zeros(n, np.int8)  # 0 off, 1 inside, 2 outside
    state[0] = 1 if inside[0] < outside[0] else 2
    for i in range(1, n):
        up = state[parents[i]]
        if up == 1:
            state[i] = 1 if inside[i] < off[i] else 0
        elif up == 2:
            state[i] = 1 if inside[i] < outside[i] else 2
    return state == 1


def _off(page: Page) -> np.ndarray:
    """Nodes of elements, or of attribute words, that don't belong to a main text, and all below them."""
    out = np.zeros(len(page.tags), bool)
    for i in range(1, len(out)):
        out[i] = out[page.parents[i]] or page.tags[i] in OFF_TAGS or not OFF_WORDS.isdisjoint(page.words[i])
    return out


def _densest(page: Page, off: np.ndarray) -> list[int]:
    """The node that holds the most text: every text outside links counts fully
    for the parent of its block and half for the grandparent."""
    own = np.zeros(len(page.tags))
    for node, text in page.texts:
        own[node] += 0 if off[node] else len("".join(text.split()))
    for i in range(len(own) - 1, 0, -1):  # texts of inline elements are their block's
        if page.tags[i] not in BLOCK:
            own[page.parents[i]] += 0 if page.tags[i] == "a" else own[i]
            own[i] = 0
    held = np.zeros(len(own))
    for i in range(1, len(own)):
        p = page.parents[i]
        held[p] += own[i]
        held[max(page.parents[p], 0)] += own[i] / 2
    held[0] = 0
    return [int(held.argmax())] if held.max() > 0 else []


def main_roots(page: Page) -> tuple[list[int], str]:
    """Where the main text of a page is, and how that is known: a variant's mark,
    article elements, main elements, roles or microdata, or (a guess) the
    densest part."""
    nodes = range(1, len(page.tags))
    for how, is_root in (
            ("mark", lambda i: "xxmain" in page.words[i]),
            ("article", lambda i: page.tags[i] == "article" and "xxother" not in page.words[i]),
            ("main", lambda i: page.tags[i] == "main" or "articlebody" in page.words[i]
             or "role:main" in page.words[i] or "role:article" in page.words[i])):
        found = [i for i in nodes if is_root(i)]
        if found:
            return found, how
    return _densest(page, _off(page)), "densest"


def labels(page: Page) -> np.ndarray:
    """1 for the nodes of the main part. Inside an article or a variant's main
    part all of it counts but what is marked as off; inside the others also
    not what its elements or attribute words say is something else."""
    out = np.zeros(len(page.tags))
    roots, how = main_roots(page)
    roots, off = set(roots), _off(page) if how in ("main", "densest") else None
    for i in range(1, len(out)):
        p = page.parents[i]
        if "xxoff" in page.words[i] or (off is not None and off[i]):
            continue
        out[i] = 1 if i in roots else (out[p] if "xxoff" not in page.words[p] else 0)
    return out


def variant(page: Page, keep: np.ndarray, r: random.Random) -> str:
    """Another layout of a page's own texts. Marker words (dropped before the
    features are made) tell the main part and what lies off it inside it."""
    main, rest = [], []
    for k, (node, text) in enumerate(page.texts):
        if text.strip():
            (main if keep[node] else rest).append(text.replace("&", "&amp;").replace("<", "&lt;"))
    if not main:
        main = ["-"]
    if r.random() < 0.25:  # very short articles
        main = [" ".join(t.split(" ")[: r.randint(1, 8)]) for t in main[: r.randint(1, 3)]]
    pool = [w for t in main + rest for w in t.split()] or ["-"]

    def some(a: int, b: int) -> str:
        at = r.randrange(len(pool))
        return " ".join(pool[at: at + r.randint(a, b)])

    def named(words: str) -> str:
        w = r.choice(words.split())
        return r.choice([f' class="{w}"', f' id="{w}"', f' class="box {w}"', f' class="{w} wide"'])

    def menu() -> str:
        items = "".join(f'<li><a href="/x">{some(1, 3)}</a></li>' for _ in range(r.randint(2, 9)))
        return r.choice([f"<nav><ul>{items}</ul></nav>", f'<div{named("menu nav navbar links")}><ul>{items}</ul></div>',
                         f'<ul{named("breadcrumb menu pagination")}>{items}</ul>'])

    def side() -> str:
        inner = f"<h3>{some(1, 4)}</h3>" + "".join(
            r.choice([f"<p>{some(3, 30)}</p>", f'<a href="/y">{some(2, 8)}</a>']) for _ in range(r.randint(1, 5)))
        return r.choice([f"<aside>{inner}</aside>", f'<div{named("sidebar related widget rail share")}>{inner}</div>',
                         f'<section{named("sidebar related trending")}>{inner}</section>'])

    def notice() -> str:
        return f'<div{named("cookie notice consent alert newsletter popup gdpr")}>' + r.choice(
            [f"<p>{some(4, 30)}</p><button>{some(1, 2)}</button>", some(4, 30), f"<p>{some(5, 40)}</p>"]) + "</div>"

    def advert() -> str:
        return f'<div{named("ad ads advert sponsored promo banner")}>' + r.choice(
            [some(4, 30), f"<p>{some(5, 30)}</p>", f'<a href="/z">{some(3, 12)}</a>']) + "</div>"

    def form() -> str:
        return (f'<form{r.choice(["", named("search login contact signup")])}><label>{some(1, 3)}</label><input name="q">'
                f'{r.choice(["", f"<p>{some(3, 15)}</p>"])}<button>{some(1, 2)}</button></form>')

    def comments() -> str:
        one = "".join(f'<div{named("comment reply")}><b>{some(1, 2)}</b><p>{some(4, 60)}</p></div>'
                      for _ in range(r.randint(1, 5)))
        return r.choice([f'<section{named("comments discussion")}><h3>{some(1, 2)}</h3>{one}</section>',
                         f'<div{named("comments replies thread")}>{one}</div>'])

    def head() -> str:
        return r.choice([f"<header><h1>{some(1, 5)}</h1></header>", f"<header><p>{some(2, 10)}</p>{menu()}</header>",
                         f'<div{named("header masthead topbar")}>{some(1, 8)}</div>'])

    def foot() -> str:
        return r.choice([f"<footer>{some(2, 20)}</footer>", f"<footer><p>{some(2, 25)}</p>{menu()}</footer>",
                         f'<div{named("footer copyright legal")}><p>{some(3, 20)}</p></div>'])

    def off(block: str) -> str:
        i = block.index("<") + 1
        j = i + len(block[i:].split(">")[0].split(" ")[0])
        return f'{block[:j]} role="xxoff"{block[j:]}'

    body = []
    for k, t in enumerate(main):
        body.append(r.choice([f"<p>{t}</p>"] * 6 + [f"<p>{t}", f"<div>{t}</div>", f"<blockquote>{t}</blockquote>",
                                                    f"<h2>{t[:60]}</h2><p>{t}</p>", f"<ul><li>{t}</li></ul>",
                                                    f'<p>{t} <a href="/i">{some(1, 4)}</a></p>']))
        if r.random() < 0.04:
            body.append(off(r.choice([advert, side, form, notice])()))
    if r.random() < 0.75:
        body.insert(0, r.choice([f"<h1>{main[0][:60]}</h1>", f"<h1>{some(1, 7)}</h1>", f"<h2>{some(1, 7)}</h2>"]))
    if r.random() < 0.2:
        body.append(off(r.choice([comments, side])()))
    tag = r.choice(["article", "article", "main", "div", "div", "section"])
    if r.random() < 0.3:  # a column around the article and what goes with it
        inside = r.choice(["main", "div"])
    else:
        inside = ""
    names = r.choice(["content post entry story article-body main text", "x wrap box", ""])
    core = f'<{tag} role="xxmain"{named(names) if names else ""}>{"".join(body)}</{tag}>'
    before = [b() for b in (head, menu, notice, advert, form, side) if r.random() < 0.5]
    if inside:
        core = f"<{inside}>{core}{r.choice([comments, side, advert, form])()}</{inside}>"
    after = [b() for b in (side, comments, advert, form, notice, menu) if r.random() < 0.45] + [foot()]
    r.shuffle(before)
    inner = "".join(before) + core + "".join(after)
    for _ in range(r.randint(0, 2)):
        inner = f'<div{named("wrap container page site row")}>{inner}</div>'
    return f"<!DOCTYPE html><html><head><title>{some(1, 6)}</title></head><body>{inner}</body></html>"


def examples(pages: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of pages and of their variants."""
    r = random.Random(seed)
    xs, ys = [], []

    def add(page: Page) -> np.ndarray:
        y = labels(page)
        page.words = [tuple(w for w in ws if not w.startswith("xx")) for ws in page.words]
        xs.append(features(page))
        ys.append(y)
        return y

    parsed = [parse(html) for html in pages]
    known = [main_roots(p)[1] != "densest" for p in parsed]
    if sum(known) >= KNOWN_SHARE * len(parsed):  # guesses are only for tables that say little themselves
        parsed = [p for p, k in zip(parsed, known) if k]
    for page in parsed:
        keep = add(page) > 0
        if keep.any():
            for _ in range(VARIANTS):
                add(parse(variant(page, keep, r)))
    return np.concatenate(xs), np.concatenate(ys)


def sample(df: DataFrame, pages: int = PAGES, chars: int = CHARS) -> list[str]:
    """Pages of ``df`` (page_id, html) to train on: in the order of the hashes of
    their ids, as many as fit, and one at least where any isn't empty."""
    text_id = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    full = df.filter(F.length("html") > 0).select(text_id.alias("id"), "html")
    # On a large table a share of the ids, by their checksum, comes first: else every
    # task would hash and sort all of its pages.
    share = min(1.0, 4.0 * pages / max(full.count(), 1))
    few = F.crc32(F.col("id").cast("binary")) <= int(share * (1 << 32))
    # (lengths first: the texts of long pages must not all come to the driver)
    key = ["id", F.md5(F.col("html").cast("binary")).alias("digest")]
    for rows in (full.filter(few), full):  # all of them where few ids repeat and none is drawn
        drawn = (rows.select(*key, F.length("html").alias("n")).orderBy(F.md5(F.col("id").cast("binary")), "digest")
                 .limit(pages).collect())
        if drawn:
            break
    chosen, left = [], chars
    for r in drawn:
        if r.n <= left:
            chosen.append((r.id, r.digest))
            left -= r.n
    if drawn and not chosen:
        r = min(drawn, key=lambda r: r.n)
        chosen.append((r.id, r.digest))
    if not chosen:
        return []
    ids, digests = ([*{c[k] for c in chosen}] for k in (0, 1))
    got = full.filter(F.col("id").isin(ids)).select(*key, "html").filter(F.col("digest").isin(digests))
    html = {(r.id, r.digest): r.html for r in got.dropDuplicates(["id", "digest"]).collect()}
    return [html[c] for c in chosen]


def train(df: DataFrame, pages: int = PAGES, chars: int = CHARS) -> Boosted | None:
    """Trees fitted on the bounded sample of ``df`` (page_id, html)."""
    rows = sample(df, pages, chars)
    return fit(*examples(rows)) if rows else None


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    """Main texts of some pages, scored together."""
    trees = [parse(h or "") for h in pages]
    score = model.score(np.concatenate([features(t) for t in trees]))
    out, at = [], 0
    for t in trees:
        n = len(t.tags)
        out.append(kept_text(t, decode(t.parents, score[at: at + n])))
        at += n
    return out


def extract(df: DataFrame, model: Boosted | None, html: str = "html") -> DataFrame:
    """``df`` with ``main_text`` in place of the page."""
    import pyarrow as pa

    keep = [f for f in df.schema.fields if f.name not in (html, "main_text")]
    names = [f.name for f in keep]
    if model is None:
        return df.select(*[F.col(f"`{n}`") for n in names], F.lit("").alias("main_text"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                got = main_texts(part.column(part.schema.get_field_index(html)).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(n)) for n in names], pa.array(got, pa.string())],
                    names=[*names, "main_text"])

    return df.mapInArrow(run, StructType([*keep, StructField("main_text", StringType())]))


def op10_dom_boosted_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    d = extract(pages, train(pages))
    return d.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
