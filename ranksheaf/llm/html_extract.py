"""HTML extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block elements with their own text. Each node has features: text and link density of
its subtree, tags a text byte, attribute tokens known from menus or from articles, depth, place among its
siblings and what its neighbours hold. Spark's gradient-boosted trees, trained here, give the chance that a
node's own text is main text. The decoding then finds, in one pass up and one down the tree, the most likely
assignment of the states "around", "main" and "left out" in which main text may hold left-out parts, but
nothing below a left-out node is main text again: an ancestor's and a descendant's choice never contradict.

Training rows come from a sample of at most SAMPLE of the pages that lend rows, by hash of the page's id. Their labels follow from
the elements whose meaning the standard fixes (article and main against nav, footer, aside, form and the like)
and from what was done to the page: each sampled page is also used in VARIANTS forms in which article and menu
become plain or named div elements, boilerplate blocks under other names stand inside the article, and main text has
names that sound like boilerplate, so that the trees must weigh density, names and ancestors against each other. A page without such elements lends no rows.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty
ones go, and the rest is joined in page order by an empty line. Scripts, styles, comments, the head, titles, text
fields and what browsers never show (templates, the source inside an iframe) are never text; formulas, drawings'
labels and the fallback of objects, canvases and noscript are. Pages run through Arrow batches with no shuffle; a batch's nodes are scored together.

Defined cases: null or empty html gives the empty text; text outside any element is a block of the body;
unclosed, stray and cut-off tags are repaired as browsers do in the main; with no page to train on, elements
decide by their names alone; repeated rows give a row each; no rows give no rows; columns beside page_id, url and
html are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

SAMPLE, VARIANTS = 400, 6
#: Elements and names of attributes by what they mean.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul button label""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())
#: What may stand in the head.
IN_HEAD = frozenset("base basefont bgsound link meta template head html noframes script style title noscript".split())
REPEATED = frozenset("li dd dt tr td th option".split())
CLOSES_P = BLOCKS - frozenset("body html button label option".split())
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav footer aside form header menu select button fieldset dialog".split())
BAD_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent
    notice notices alert gdpr nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget widgets rail footer foot header masthead
    topbar toolbar comment comments reply replies respond disqus discussion related recommended share sharing social follow subscribe newsletter signup
    login search form tags pagination pager skip copyright legal disclaimer complementary contentinfo""".split())
GOOD_NAMES = frozenset("article content main post entry story body text maincontent".split())
#: First parts of class names that only say what a text is filed under, last parts that say what state it is in.
FILED_UNDER = frozenset("category tag post page author format type status term has is with no id lang archive".split())
STATES = frozenset("open closed enabled disabled allowed on off hidden visible active inactive count".split())
#: Elements that hold text rather than other blocks: of their names only whole ones count.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figure figcaption caption hr address".split())
NAMES = ["is_good_tag", "is_bad_tag", "good_name", "bad_name", "under_good", "under_bad", "bad_below_good", "text", "text_below", "links", "tags_per_byte", "depth", "siblings", "place", "same_tag", "paragraphs_near", "stops", "heading", "item"]
_tag = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_loose = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_named = re.compile(r"""\b(id|class|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_gold = re.compile(r'\bdata-gold="([01])"')
_word = re.compile(r"[a-z0-9]+")


def named_parts(tag: str, kind: str, value: str) -> list[str]:
    """What an attribute's names say about an element: each name as a whole and, of compound ones, the parts that name a place.

    ``category-social`` files a text under social matters and ``comments-open`` is a state: neither is a social bar or
    a list of comments. An id often repeats a heading, so only its last part counts, and of the names of a paragraph or
    another element of text none but whole ones.
    """
    found = []
    for name in value.strip("\"'").lower().split():
        parts = _word.findall(name)
        if len(parts) < 2:
            found += parts
        elif tag in TEXT_TAGS or parts[0] in FILED_UNDER or parts[-1] in STATES:
            found.append("-".join(parts))
        else:
            found += parts[-1:] if kind == "id" else parts
    return found


class Node:
    __slots__ = ("at", "below", "depth", "gold", "kids", "links", "names", "parent", "parts", "tag", "tags", "text")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.kids, self.parts = tag, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.names = frozenset(w for kind, value in _named.findall(attributes) for w in named_parts(tag, kind.lower(), value)) if attributes else frozenset()
        self.gold = m[1] if "data-gold" in attributes and (m := _gold.search(attributes)) else None
        self.text = self.below = self.links = self.tags = self.at = 0


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block elements in page order, and the blocks of text with the node that owns each."""
    root = Node("body", None)
    nodes, blocks, run = [root], [], []
    here, link, at, in_head = root, 0, 0, False
    # how often inline elements are open, and the elements within a template, itself included
    inline: Counter[str] = Counter()
    inner: list[str] = []
    within: Counter[str] = Counter()

    def flush() -> None:
        if run:
            text = " ".join(unescape("".join(run)).split())
            run.clear()
            if text:
                blocks.append((here, text))
                here.text += len(text)

    def is_open(tag: str) -> bool:
        up = here
        while up.parent and up.tag != tag:
            up = up.parent
        return up.parent is not None or inline[tag] > 0 or tag in ("body", "html") or (in_head and tag == "head")

    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            lt = len(html)
        if lt > at:
            if in_head and not inner and not html[at:lt].isspace():
                in_head = False
            if not inner and not in_head:
                run.append(html[at:lt])
                if link:
                    here.links += lt - at
            at = lt
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(html)
            continue
        after = html[at + 1 : at + 2]
        if after in ("!", "?"):
            end = html.find(">", at)
            at = end + 1 if end >= 0 else len(html)
            continue
        if not (after.isascii() and after.isalpha()) and not (after == "/" and html[at + 2 : at + 3].isalpha()):
            in_head = in_head and bool(inner)
            if not inner:
                run.append("<" if after != "/" else "")
            at += 1 if after != "/" else 2
            continue
        if after == "/" and not html[at + 2].isascii():
            end = html.find(">", at)
            at = end + 1 if end >= 0 else len(html)
            continue
        m = _tag.match(html, at) or _loose.match(html, at)
        if not m:
            break  # the page breaks off inside a tag
        at, closing, tag = m.end(), m[1], m[2].lower()
        empty = m[3].endswith("/")
        if in_head and not inner and ((tag in ("body", "html", "br")) if closing else tag not in IN_HEAD):
            in_head = False
        if not closing and tag in RAW:
            if empty and (inline["svg"] or inline["math"]):
                continue
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if inner:
            if closing and within[tag]:
                while (last := inner.pop()) != tag:
                    within[last] -= 1
                within[tag] -= 1
                continue
            # an unclosed template ends with an element around it, or with the head
            if not (is_open(tag) if closing else in_head and tag == "body"):
                if not closing and tag not in VOID and not empty:
                    inner.append(tag)
                    within[tag] += 1
                continue
            inner.clear()
            within.clear()
            in_head = in_head and tag not in ("body", "html")
        if not closing and tag == "head":
            in_head = True
            continue
        if not closing and tag == "template":
            inner.append(tag)
            within[tag] += 1
            continue
        if in_head:
            in_head = not (closing and tag == "head")
            continue
        here.tags += not closing
        if tag == "br":
            run.append(" ")
        elif tag == "a":
            link = 0 if closing else 1
            inline[tag] = link
        elif tag in BLOCKS and tag not in ("html", "body"):
            flush()
            link = 0
            if closing:
                up = here
                while up.parent and up.tag != tag:
                    up = up.parent
                if up.parent:
                    here = up.parent
            elif tag != "hr":
                if tag in CLOSES_P and here.tag == "p":
                    here = here.parent
                if tag in REPEATED and here.tag == tag:
                    here = here.parent
                here = Node(tag, here, m[3])
                here.parent.kids.append(here)
                nodes.append(here)
        elif not closing:
            inline[tag] += tag not in VOID and not empty
        elif inline[tag]:
            inline[tag] -= 1
    flush()
    return nodes, blocks


def is_bad(n: Node) -> bool:
    """By its element or names no main text; an outermost article or main element is never so by its names."""
    if n.tag in BAD_TAGS:
        return True
    if n.names.isdisjoint(BAD_NAMES):
        return False
    up = n.parent
    while n.tag in GOOD_TAGS and up is not None and up.tag not in GOOD_TAGS:
        up = up.parent
    return n.tag not in GOOD_TAGS or up is not None


def node_features(nodes: list[Node], blocks: list[tuple[Node, str]]) -> list[list[float]]:
    for i, n in enumerate(nodes):
        n.at, n.below = i, n.text
    stops, links, tags = [0] * len(nodes), [n.links for n in nodes], [n.tags + 1 for n in nodes]
    for n, text in blocks:
        stops[n.at] += text.count(".") + text.count(",")
    for n in reversed(nodes):
        if n.parent:
            n.parent.below += n.below
            links[n.parent.at] += links[n.at]
            tags[n.parent.at] += tags[n.at]
    good, bad, after = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    # what a node's children have in common, once for all of them
    tags_of = [Counter(k.tag for k in n.kids) for n in nodes]
    paragraphs = [sum(k.text for k in n.kids if k.tag == "p") for n in nodes]
    rows = []
    for i, n in enumerate(nodes):
        p = n.parent
        own_good, own_bad = n.tag in GOOD_TAGS or not n.names.isdisjoint(GOOD_NAMES), is_bad(n)
        good[i] = int(own_good or (p is not None and good[p.at]))
        bad[i] = int(own_bad or (p is not None and bad[p.at]))
        after[i] = int((own_bad and good[i]) or (p is not None and after[p.at]))
        kids, same, near = (len(p.kids), tags_of[p.at][n.tag], paragraphs[p.at]) if p else (1, 1, 0)
        rows.append([
            float(n.tag in GOOD_TAGS), float(n.tag in BAD_TAGS), float(not n.names.isdisjoint(GOOD_NAMES)), float(own_bad and n.tag not in BAD_TAGS),
            float(good[i]), float(bad[i]), float(after[i]), math.log1p(n.text), math.log1p(n.below), min(links[i] / max(n.below, 1), 1.0), tags[i] / max(n.below, 1),
            float(min(n.depth, 12)), math.log1p(kids), i / len(nodes), same / kids, math.log1p(near), stops[i] / max(n.text, 1),
            float(n.tag[0] == "h" and n.tag[1:].isdigit()), float(n.tag in ("li", "option", "td")),
        ])
    return rows


def gold(nodes: list[Node]) -> list[int | None]:
    """What the meaning of the elements says about each node: 1 main, 0 not, None unknown."""
    out: list[int | None] = []
    for n in nodes:
        up = out[n.parent.at] if n.parent else None
        if n.gold:
            out.append(int(n.gold))
        elif up == 0 or is_bad(n):
            out.append(0)
        elif n.tag in GOOD_TAGS:
            out.append(1)
        else:
            out.append(up)
    return out


def variants(html: str, seed: int) -> list[str]:
    """The page, and forms of it with other names whose truth is marked."""
    out, pick = [html], np.random.default_rng(seed)
    main = re.search(r"(?is)<(article|main)\b[^>]*>(.*?)</\1>", html)
    if not main:
        return out
    bad = re.findall(r"(?is)<(?:nav|footer|aside)\b[^>]*>(.*?)</(?:nav|footer|aside)>", html) or ["<ul><li><a href='/'>Home</a></li></ul>"]
    paragraphs = re.findall(r"(?is)<p[^>]*>(.*?)(?=<p\b|</p>|$)", main[2]) or ["One more word, it says."]
    bad_names, good_names = sorted(BAD_NAMES), sorted(GOOD_NAMES)
    for k in range(VARIANTS):
        inner = main[2]
        for _ in range(2):
            name = bad_names[pick.integers(len(bad_names))]
            words = paragraphs[pick.integers(len(paragraphs))] if pick.random() < 0.6 else bad[pick.integers(len(bad))]
            tag = ("div", "section", "ul")[pick.integers(3)]
            head = f"<h3>{name.title()}</h3>" if pick.random() < 0.5 else ""
            body = f"<li>{words}</li>" if tag == "ul" else f"<p>{words}</p>"
            block = f'<{tag} class="{name}" data-gold="0">{head}{body}</{tag}>'
            cuts = [m.start() for m in re.finditer(r"(?i)<p\b", inner)] + [len(inner)]
            cut = cuts[pick.integers(len(cuts))]
            inner = inner[:cut] + block + inner[cut:]
        name = good_names[pick.integers(len(good_names))]
        if k % 3 == 2:  # names that sound like boilerplate and mean none
            sound = [bad_names[pick.integers(len(bad_names))] for _ in range(3)]
            name = f"{name} category-{sound[0]} tag-{sound[1]} comments-open"
            inner = inner.replace("<p>", f'<p id="{sound[2]}-law" data-gold="1">', 1)
        opened = (f'<article class="{name}" data-gold="1">{inner}</article>', f'<div class="{name}" data-gold="1">{inner}</div>', f'<div data-gold="1">{inner}</div>', f'<section id="{name}" data-gold="1">{inner}</section>')[k % 4]
        page = html[: main.start()] + opened + html[main.end() :]
        if k >= 4:  # a layout without any name
            page = re.sub(r"(?i)<(/?)(nav|footer|aside|header)\b[^>]*", lambda m: '<div data-gold="0"' if not m[1] else "</div", page)
        elif k % 2:
            page = re.sub(r"(?i)<(/?)(nav|footer|aside)\b", lambda m: f'<{m[1]}div class="{m[2].lower()}"' if not m[1] else "</div", page)
        out.append(page)
    return out


class Trees:
    """Spark's boosted trees as arrays, to score many nodes at a time inside a task."""

    def __init__(self, model) -> None:
        self.trees = []
        for weight, tree in zip(model.treeWeights, model.trees, strict=True):
            rows: list[list[float]] = []

            def add(node, rows=rows) -> int:
                i = len(rows)
                rows.append([0, 0.0, i, i, float(node.prediction())])
                if node.subtreeDepth() > 0:
                    split = node.split()
                    rows[i][:2] = [split.featureIndex(), split.threshold()]
                    rows[i][2], rows[i][3] = add(node.leftChild()), add(node.rightChild())
                return i

            add(tree._call_java("rootNode"))
            a = np.array(rows)
            self.trees.append((weight, tree.depth, a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))

    def chance(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.zeros(len(x)), np.arange(len(x))
        for weight, depth, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(depth):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


class Names:
    """Stands in where nothing could be learned: main text is what has a good and no bad name above it."""

    def chance(self, x: np.ndarray) -> np.ndarray:
        return np.where((x[:, 4] > 0) & (x[:, 5] == 0), 0.9, 0.1)


def decode(nodes: list[Node], chance: np.ndarray) -> list[bool]:
    """Which nodes' own text is main text, so that nothing below a left-out node is."""
    weight = np.sqrt([n.text for n in nodes])
    c = np.clip(chance, 1e-6, 1 - 1e-6)
    yes, no = weight * np.log(c), weight * np.log(1 - c)
    around, main, out = no.copy(), yes.copy(), no.copy()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent.at
        around[p] += max(around[i], main[i], out[i])
        main[p] += max(main[i], out[i])
        out[p] += out[i]
    state = [0] * len(nodes)
    state[0] = int(main[0] > around[0])
    for i in range(1, len(nodes)):
        up = state[nodes[i].parent.at]
        if up == 0:
            state[i] = max((0, 2, 1), key=lambda s: (around[i], main[i], out[i])[s])
        elif up == 1:
            state[i] = 1 if main[i] >= out[i] else 2
        else:
            state[i] = 2
    return [s == 1 for s in state]


def main_text(nodes: list[Node], blocks: list[tuple[Node, str]], chance: np.ndarray) -> str:
    keep = decode(nodes, chance)
    return "\n\n".join(t for n, t in blocks if keep[n.at])


def train(pages: DataFrame, sample: int = SAMPLE) -> Trees | Names:
    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            rows = []
            for html in batch.column("html").to_pylist():
                for page in variants(html or "", len(html or "")):
                    nodes, blocks = parse(page)
                    values = node_features(nodes, blocks)
                    marks = gold(nodes)
                    if 1 in marks:
                        rows += [(v, float(bool(g))) for n, v, g in zip(nodes, values, marks, strict=True) if n.text]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.float64())], names=["features", "label"])

    def lending(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            yield batch.filter(pa.array([1 in gold(parse(html)[0]) for html in batch.column("html").to_pylist()], pa.bool_()))

    def first(rows: DataFrame) -> DataFrame:
        # the last key is found without the pages, so that no task gets the first pages of every partition
        last = rows.select("key").orderBy("key").limit(sample).agg(F.max("key")).first()[0]
        return rows.where(F.col("key") <= F.lit(last)).orderBy("key").limit(sample)

    key = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    named = pages.where(F.col("html").rlike(r'(?i)<(article|main)\b|data-gold="1"')).select(key.alias("key"), "html")
    some = durable(first(named).mapInArrow(lending, "key string, html string"))
    if some.count() < sample < named.count():
        # not all of the first pages lend rows, so the others are looked at as well
        some = durable(first(named.mapInArrow(lending, "key string, html string")))
    some = some.select("html")
    rows = durable(some.mapInArrow(work, "features array<double>, label double"))
    if rows.select("label").distinct().count() < 2:
        return Names()
    vectors = rows.select(array_to_vector("features").alias("features"), "label")
    return Trees(GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.3, seed=1).fit(vectors))


def extract(pages: DataFrame, model: Trees | Names | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    model = model or train(pages.select("page_id", F.col("html").cast("string").alias("html")))

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            texts: list[str] = []
            for begin in range(0, batch.num_rows, 64):
                parsed = [parse(h.as_py() or "") for h in batch.column("html").slice(begin, 64)]
                values = [node_features(*p) for p in parsed]
                chances = model.chance(np.array([v for page in values for v in page]))
                at = 0
                for (nodes, blocks), v in zip(parsed, values, strict=True):
                    texts.append(main_text(nodes, blocks, chances[at : at + len(v)]))
                    at += len(v)
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
