"""Main text of web pages: gradient-boosted trees over DOM-node features and a choice of nodes without contradictions.

Nodes are elements and text leaves (:mod:`faultline.llm.dom`). A node is positive if main text is in it. Its features are figures of its subtree
(characters, words, link share, characters per element, marks, length of words, share of the page and of the parent), depth, place
among its siblings and in the page, its neighbours' figures, and learned log-odds of its tag and of the words of its class, id and
role, also the least and greatest of its ancestors. The trees give log-odds for every node.

Hierarchical decoding. Main text in a node means main text in all its ancestors, and a node that is out takes its descendants along. Among
all choices that keep this, the one of the greatest sum of log-odds is taken: from the leaves up, a node is worth its log-odds
and what its children are worth above zero; from the root down, a node is in if its parent is and its worth is above zero.

Learning. The table has no labels. The classifier is fitted on at most ``most_pages`` pages of at most ``most_characters`` characters
(the least hashes), in two ways: pages with exactly one ``article`` or ``main`` element are labelled by it (less what is in ``nav``, ``aside``,
``footer`` or ``form``), and texts harvested from the sample are set into ``layouts`` pages of known structure, drawn from the
conventional names of page parts below. Without any sample text a few fixed words are used. Extraction reads every whole page.

Output: the columns of the table but the html, with ``text`` and ``n_chars`` (code points); columns of these names are replaced.
White space inside a block becomes one space, blocks are joined by one space. Null and empty pages and pages without main
text have an empty text. Repeated rows give repeated rows.
"""

import random
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import boosting
from faultline.llm.common import fresh_name
from faultline.llm.dom import Page, words_of
from faultline.llm.textbatch import WINDOW

# Conventional names of the parts of a page, as they stand in class, id and role.
MAIN_NAMES = [
    "article", "article-body", "articleBody", "content", "entry", "entry-content", "hentry", "main", "main-content", "page-content",
    "post", "post-body", "post-content", "story", "story-body", "text", "markdown-body", "mw-body", "document", "prose", "reading",
]
NEUTRAL_NAMES = [
    "container", "wrapper", "wrap", "page", "site", "row", "col", "column", "layout", "inner", "outer", "grid", "body", "section", "app",
    "root", "block", "box", "clearfix", "group",
]
PART_NAMES = {
    "menu": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "toolbar", "tabs", "pagination", "pager", "toc", "skip-links"],
    "header": ["header", "masthead", "banner", "site-header", "branding", "logo", "hero", "top"],
    "footer": ["footer", "site-footer", "copyright", "colophon", "bottom", "credits", "legal", "imprint", "contentinfo"],
    "sidebar": ["sidebar", "aside", "widget", "widgets", "related", "recommended", "trending", "popular", "archive", "tags", "rail", "more-stories", "complementary", "teaser"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "outbrain", "affiliate", "adsbygoogle", "commercial"],
    "notice": ["notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "disclaimer", "paywall", "message"],
    "form": ["form", "newsletter", "subscribe", "subscription", "signup", "login", "search", "search-form", "contact-form"],
    "comments": ["comments", "comment", "comment-list", "respond", "reply", "replies", "discussion", "disqus", "feedback", "reviews", "user-comments"],
    "social": ["share", "sharing", "social", "follow", "like", "tools", "buttons", "print"],
}
_OUT_TAGS = frozenset("nav aside footer form".split())
_WORDS = "this page tells of many things that people do each day and why they do them in that way".split()
#: Marks main text in pages for learning (a character of private use).
_MARK = "\ue000"

#: How often the conventional names count as seen.
_PRIOR = 30

_LATER = ["chars", "words", "links", "elements", "paragraphs", "stops", "commas", "digits", "capitals"]


class Nodes(NamedTuple):
    """The nodes of several pages one after the other."""

    page: np.ndarray
    parent: np.ndarray  #: place of the parent, -1 for roots
    depth: np.ndarray
    names: list[tuple[str, ...]]  #: tag and words of the attributes
    sums: np.ndarray  #: figures of the subtrees, in the order of ``_LATER``
    before: np.ndarray  #: characters of the page before the node
    main: np.ndarray  #: whether marked text is in the node


def nodes_of(pages: list[Page]) -> Nodes:
    page, parent, depth, names, rows, main = [], [], [], [], [], []
    for number, one in enumerate(pages):
        base = len(parent)
        for node in one.nodes:
            page.append(number)
            parent.append(node.parent + base if node.parent >= 0 else -1)
            depth.append(node.depth)
            names.append((f"<{node.tag}>", *node.names))
            rows.append([0, 0, 0, node.tag != "#text", node.tag == "p", 0, 0, 0, 0])
            main.append(False)
        for run in one.runs:
            at, text = run.leaf + base, run.text
            if _MARK in text:
                main[at], text = True, text.replace(_MARK, "")
            parts = text.split()
            size = sum(map(len, parts))
            row = rows[at]
            row[0] += size
            row[1] += len(parts)
            row[2] += size * run.link
            row[5] += sum(map(text.count, ".!?:"))
            row[6] += text.count(",")
            row[7] += sum(map(str.isdigit, text)) if size < 200 else 0
            row[8] += sum(map(str.isupper, text)) if size < 200 else 0
    parent, depth = np.array(parent, np.int64), np.array(depth, np.int64)
    sums, main = np.array(rows, np.float64).reshape(-1, len(_LATER)), np.array(main, bool)
    own = sums[:, 0].copy()
    before = np.cumsum(own) - own
    by_depth = np.argsort(depth, kind="stable")
    levels = np.searchsorted(depth[by_depth], np.arange(depth.max(initial=0) + 2))
    for d in range(len(levels) - 2, 0, -1):
        here = by_depth[levels[d] : levels[d + 1]]
        np.add.at(sums, parent[here], sums[here])
        np.logical_or.at(main, parent[here], main[here])
    page = np.array(page, np.int64)
    roots = np.flatnonzero(parent < 0)
    return Nodes(page, parent, depth, names, sums, before - before[roots][page], main)


class Model(NamedTuple):
    odds: dict[str, float]  #: log-odds of tags and attribute words
    trees: boosting.Trees


def _known(word: str, odds: dict[str, float]) -> float:
    """Log-odds of a word, or else of the longest known word of four letters or more in it."""
    if word in odds or word[0] == "<":
        return odds.get(word, 0.0)
    inside = [k for k in odds if len(k) > 3 and k[0] != "<" and k in word]
    return odds[max(inside, key=lambda k: (len(k), k))] if inside else 0.0


def features(nodes: Nodes, odds: dict[str, float], seen: dict[str, float]) -> np.ndarray:
    """One row per node. ``seen`` keeps the log-odds of words met before."""
    tag, name = np.empty(len(nodes.names)), np.zeros(len(nodes.names))
    for i, (first, *rest) in enumerate(nodes.names):
        for word in (first, *rest):
            if word not in seen:
                seen[word] = _known(word, odds)
        tag[i] = seen[first]
        name[i] = max(-6.0, min(6.0, sum(seen[word] for word in rest)))
    parent, depth = nodes.parent, nodes.depth
    up = np.maximum(parent, 0)
    low_tag, high_tag, low_name, high_name = tag.copy(), tag.copy(), name.copy(), name.copy()
    by_depth = np.argsort(depth, kind="stable")
    levels = np.searchsorted(depth[by_depth], np.arange(depth.max(initial=0) + 2))
    for d in range(1, len(levels) - 1):
        here = by_depth[levels[d] : levels[d + 1]]
        above = parent[here]
        for held, best in ((low_tag, np.minimum), (high_tag, np.maximum), (low_name, np.minimum), (high_name, np.maximum)):
            held[here] = best(held[here], held[above])
    chars, words, links, elements, paragraphs, stops, commas, digits, capitals = nodes.sums.T
    some, all_chars = np.maximum(chars, 1), np.maximum(chars[np.flatnonzero(parent < 0)][nodes.page], 1)
    # Siblings stand in the order of the page; a stable sort by parent puts them side by side.
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], parent)
    many = np.searchsorted(parent[order], parent, "right") - first
    place = np.empty(len(parent), np.int64)
    place[order] = np.arange(len(parent))
    has_before, has_after = (place > first) & (parent >= 0), (place < first + many - 1) & (parent >= 0)
    earlier, later = order[np.maximum(place - 1, 0)], order[np.minimum(place + 1, len(parent) - 1)]
    share = links / some
    children = np.bincount(up[parent >= 0], minlength=len(parent))
    return np.stack([
        np.log1p(chars), np.log1p(words), share, np.log1p(chars / (1 + elements)), stops / np.maximum(words, 1),
        commas / np.maximum(words, 1), chars / np.maximum(words, 1), chars / all_chars, np.minimum(depth, 40), np.log1p(elements),
        np.log1p(paragraphs), nodes.before / all_chars, (place - first) / np.maximum(many, 1), np.log1p(many), chars / np.maximum(chars[up], 1),
        np.where(has_before, np.log1p(chars[earlier]), -1), np.where(has_before, share[earlier], -1),
        np.where(has_after, np.log1p(chars[later]), -1), np.where(has_after, share[later], -1),
        digits / some, capitals / some, np.log1p(children), tag, name, low_tag, high_tag, low_name, high_name, name[up], tag[up],
    ], 1)


def chosen(nodes: Nodes, scores: np.ndarray) -> np.ndarray:
    """Nodes that are in: the choice of the greatest sum of scores in which a node's parent is always in. Nodes without text are out."""
    worth = np.where(nodes.sums[:, 0] > 0, scores, -np.inf)
    by_depth = np.argsort(nodes.depth, kind="stable")
    levels = np.searchsorted(nodes.depth[by_depth], np.arange(nodes.depth.max(initial=0) + 2))
    for d in range(len(levels) - 2, 0, -1):
        here = by_depth[levels[d] : levels[d + 1]]
        np.add.at(worth, nodes.parent[here], np.maximum(worth[here], 0))
    taken = worth > 0
    for d in range(1, len(levels) - 1):
        here = by_depth[levels[d] : levels[d + 1]]
        taken[here] &= taken[nodes.parent[here]]
    return taken


def text_of(page: Page, taken: np.ndarray) -> str:
    """The text of the leaves that are in."""
    blocks, block = [], None
    for run in page.runs:
        if taken[run.leaf]:
            if run.block != block:
                blocks.append([])
                block = run.block
            blocks[-1].append(run.text)
    return " ".join(" ".join("".join(block).split()) for block in blocks if "".join(block).strip())


# --- learning


def _labelled(text: str) -> Page | None:
    """The page with marks in the leaves of its one article or main element, if it has exactly one with text."""
    page = Page(text.replace(_MARK, ""))
    for tag in ("article", "main"):
        found = [i for i, node in enumerate(page.nodes) if node.tag == tag]
        if len(found) == 1:
            inside = np.zeros(len(page.nodes), bool)
            for i, node in enumerate(page.nodes):
                inside[i] = i == found[0] or node.parent >= 0 and inside[node.parent] and node.tag not in _OUT_TAGS
            page.runs = [run._replace(text=_MARK + run.text) if inside[run.leaf] else run for run in page.runs]
            return page if any(_MARK in run.text and run.text.strip(_MARK).strip() for run in page.runs) else None
    return None


def layout(rng: random.Random, long: list[str], short: list[str]) -> str:
    """A page of a drawn structure; its main text bears marks."""

    def sentence() -> str:
        text = rng.choice(long)
        at = rng.randint(0, max(0, len(text) - 200))
        return text[at : at + rng.choice([40, 90, 200, 600])]

    def names(kinds: list[str], share: float = 0.9) -> str:
        if rng.random() > share:
            return ""
        said = rng.choice(kinds) + (f" {rng.choice(NEUTRAL_NAMES)}" if rng.random() < 0.2 else "")
        return f' {rng.choice(["class", "class", "id"])}="{said}"'

    def links(n: int) -> str:
        form = rng.choice(["<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> | ", "<p><a href='/x'>{}</a></p>", "<a href='/x'>{}</a> "])
        listed = "".join(form.format(rng.choice(short)) for _ in range(n))
        return f"<ul>{listed}</ul>" if form.startswith("<li") else listed

    def paragraphs(n: int, mark: str) -> str:
        shape = rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "{}<br><br>", "<p class='par'>{}</p>"])
        out = []
        for _ in range(n):
            text = rng.choice([sentence(), sentence(), rng.choice(long)])
            if rng.random() < 0.3:
                text = f"{text[: len(text) // 2]}<a href='/y'>{rng.choice(short)}</a>{text[len(text) // 2 :]}"
            kind = rng.random()
            if kind < 0.08:
                out.append(f"<h2>{mark}{rng.choice(short)}</h2>")
            elif kind < 0.14:
                out.append("<ul>" + "".join(f"<li>{mark}{rng.choice([sentence(), rng.choice(short)])}</li>" for _ in range(rng.randint(1, 6))) + "</ul>")
            elif kind < 0.18:
                out.append(f"<blockquote>{mark}{text}</blockquote>")
            elif kind < 0.2:
                out.append("<table>" + "".join(f"<tr><td>{mark}{rng.choice(short)}<td>{mark}{rng.choice(short)}" for _ in range(rng.randint(1, 5))) + "</table>")
            marked = mark + text.replace("<a href='/y'>", f"<a href='/y'>{mark}").replace("</a>", f"</a>{mark}")
            out.append(shape.format(marked))
        return "".join(out)

    def part(kind: str) -> str:
        tags = {"menu": ["nav", "div", "ul", "nav"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "form": ["form", "div"]}
        tag = rng.choice(tags.get(kind, ["div", "section", "div", "aside"]))
        # A part shows what it is by its tag or by its names.
        named = names(PART_NAMES[kind], 0.4 if tag in ("nav", "header", "footer", "aside", "form") else 1.0)
        if kind == "menu":
            inner = links(rng.randint(2, 15))
        elif kind == "comments":
            each = rng.choice(["<div class='comment'>{}</div>", "<li>{}</li>", "<article>{}</article>", "<div>{}</div>"])
            inner = "<h3>Comments</h3>" + "".join(each.format(rng.choice(["<b>Ann</b> ", ""]) + paragraphs(rng.randint(1, 2), "")) for _ in range(rng.randint(1, 8)))
        elif kind == "form":
            inner = f"<p>{sentence()}</p><label>{rng.choice(short)}</label><input name='q'><button>Go</button>"
        elif kind in ("footer", "header"):
            inner = rng.choice([f"&copy; {rng.choice(short)} &middot; {sentence()}", links(rng.randint(1, 9)), f"<p>{sentence()}</p>", f"<h1>{rng.choice(short)}</h1>"])
        elif kind == "social":
            inner = links(rng.randint(1, 5))
        else:
            inner = rng.choice([sentence(), f"<p>{sentence()}</p>", f"<h3>{rng.choice(short)}</h3>{links(rng.randint(1, 8))}", paragraphs(rng.randint(1, 3), "")])
        return f"<{tag}{named}>{inner}</{tag}>"

    def some(kinds: list[str], share: float) -> list[str]:
        return [part(kind) for kind in kinds if rng.random() < share]

    text = ""
    if rng.random() < 0.8:
        text += f"<h1{names(['title', 'headline', 'entry-title'], 0.3)}>{_MARK}{rng.choice([rng.choice(short), sentence()[:60]])}</h1>"
    pieces = [paragraphs(rng.randint(1, 5), _MARK) for _ in range(rng.randint(1, 4))]
    for extra in some(["advert", "social", "sidebar", "form", "notice", "menu"], 0.12):
        pieces.insert(rng.randint(0, len(pieces)), extra)
    text += "".join(pieces) + "".join(some(["comments", "social", "sidebar"], 0.15))
    tag = rng.choice(["article", "main", "div", "div", "section", "td"])
    # One in ten main parts has neither a telling tag nor a name.
    named = names(MAIN_NAMES, 0.4 if tag in ("article", "main") else 0.85)
    text = f"<table><tr><td>{part('menu')}<td{named}>{text}</table>" if tag == "td" else f"<{tag}{named}>{text}</{tag}>"
    for _ in range(rng.randint(0, 3)):
        around = rng.choice(["div", "section", "div", "main"]) if rng.random() < 0.9 else "article"
        beside = "".join(some(["sidebar", "advert", "comments", "social", "notice"], 0.15))
        text = f"<{around}{names(NEUTRAL_NAMES, 0.8)}>{text}{beside}</{around}>" if rng.random() < 0.7 else f"<{around}>{beside}{text}</{around}>"
    above = "".join(some(["notice", "header", "menu", "advert", "form"], 0.5))
    below = "".join(some(["comments", "sidebar", "form", "footer", "notice", "advert"], 0.4))
    return f"<html><head><title>{rng.choice(short)}</title></head><body>{above}{text}{below}"


def fit(samples: list[str], layouts: int = 1200, seed: int = 13) -> Model:
    """The classifier from sample pages; the pages of known structure carry their texts."""
    rng = random.Random(seed)
    parsed = [Page(text.replace(_MARK, "")) for text in samples]
    long, short = [], []
    for page in parsed:
        held: dict[int, list[str]] = {}
        for run in page.runs:
            held.setdefault(run.leaf, []).append(run.text)
        for runs in held.values():
            text = " ".join("".join(runs).split()).replace("&", "&amp;").replace("<", "&lt;")
            (long if len(text) > 80 else short).append(text)
    rng.shuffle(long)
    rng.shuffle(short)
    long = [text[:4000] for text in long[:4000]] or [" ".join(rng.choice(_WORDS) for _ in range(60)) + "." for _ in range(20)]
    short = [text for text in short[:4000] if text] or _WORDS
    pages = [page for page in map(_labelled, samples) if page]
    own = len(pages)
    pages += [Page(layout(rng, long, short)) for _ in range(layouts)]
    nodes = nodes_of(pages)
    used = nodes.sums[:, 0] > 0
    # Log-odds of names: of nodes that bear them, how many have main text, set against all nodes.
    # The conventional names count as if they had been seen before, so that the rare ones are known too.
    count: dict[str, list[float]] = {}
    for side, known in enumerate(([n for part in PART_NAMES.values() for n in part], MAIN_NAMES)):
        for word in {words_of(name)[-1] for name in known}:
            count.setdefault(word, [0, 0])[side] += _PRIOR
    for i in np.flatnonzero(used):
        for word in set(nodes.names[i]):
            count.setdefault(word, [0, 0])[int(nodes.main[i])] += 1
    yes, no = nodes.main[used].sum(), (~nodes.main[used]).sum()
    odds = {w: float(np.log((b + 1) / (yes + 2)) - np.log((a + 1) / (no + 2))) for w, (a, b) in count.items() if a + b >= 3}
    rows = features(nodes, odds, {})
    # The pages at hand count as much as the drawn ones; within a page, so does every node.
    size = np.maximum(np.bincount(nodes.page[used], minlength=len(pages)), 1)
    weight = np.where(nodes.page < own, (layouts / max(own, 1)), 1.0) / size[nodes.page]
    weight = weight[used] / weight[used].mean()
    return Model(odds, boosting.fit(rows[used], nodes.main[used].astype(float), weight, part=0.5))


def learn(pages: DataFrame, html: str = "html", most_pages: int = 300, most_characters: int = 1 << 16, layouts: int = 1200) -> Model:
    """The classifier from a bounded sample: ``most_pages`` pages of at most ``most_characters`` characters."""
    text = F.col(f"`{html}`").cast("string")
    rows = pages.select(text.alias("text"), F.monotonically_increasing_id().alias("uid"))
    # Only hashes are sorted; the texts of the chosen rows are then read.
    first = rows.filter(F.length("text") <= most_characters).select(F.xxhash64("text").alias("h"), "uid")
    uids = [(r.uid,) for r in first.orderBy("h", "uid").limit(most_pages).collect()]
    chosen = rows.join(F.broadcast(pages.sparkSession.createDataFrame(uids, "uid long")), "uid", "left_semi")
    return fit(sorted(r.text for r in chosen.collect()), layouts)


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """The columns of ``pages`` but ``html``, with ``text`` and ``n_chars``."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    source = fresh_name("html")
    held = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").cast("string").alias(source))
    schema = T.StructType([*held.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extracted(batches):
        odds, trees = shared.value
        seen: dict[str, float] = {}
        for batch in batches:
            column = batch.column(len(kept))
            first = 0
            while first < batch.num_rows:
                texts, size = [], 0
                while first + len(texts) < batch.num_rows and size < 4 * WINDOW:
                    texts.append(column[first + len(texts)].as_py())
                    size += len(texts[-1] or "")
                found = main_texts(texts, odds, trees, seen)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, len(texts)) for i in range(len(kept))), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                    names=schema.names,
                )
                first += len(texts)

    return held.mapInArrow(extracted, schema)


def main_texts(texts: list[str | None], odds: dict[str, float], trees: boosting.Trees, seen: dict[str, float]) -> list[str]:
    pages = [Page(text) for text in texts]
    nodes = nodes_of(pages)
    if len(seen) > 1 << 18:
        seen.clear()
    taken = chosen(nodes, trees.scores(features(nodes, odds, seen)))
    cuts = np.searchsorted(nodes.page, np.arange(len(pages) + 1))
    return [text_of(page, taken[a:b]) for page, a, b in zip(pages, cuts[:-1], cuts[1:], strict=True)]
