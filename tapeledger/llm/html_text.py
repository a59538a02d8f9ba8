"""Main text of web pages: flat text blocks, classified by a decision tree."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.llm.common import quoted, read

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
HEAD_END = re.compile(r"</head(?=[\s>/])|<body(?=[\s>/])", re.I)
HAS_ARTICLE = re.compile(r"<article(?=[\s>/])", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Elements whose content is not text of the page.
SKIPPED = set("script style noscript template svg math iframe object canvas title textarea select option button audio video head".split())
# Elements that begin and end a block; all others are part of the text around them.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements that are followed until their end because what they hold may not be the article.
TRACKED = set("article main nav aside header footer form menu dialog search div section ul ol table td figure span p details dl".split())
ALWAYS_BOILERPLATE = set("nav aside footer form menu dialog search".split())
# Names that elements other than the article go by, whatever they hold.
SURE_NAMES = set(
    "ad ads advert advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup signin login register sidebar comment comments reply replies respond disqus breadcrumb breadcrumbs menu nav navbar navigation footer "
    "masthead copyright pagination pager toolbar".split()
)
# Names that parts of an article go by as well: length, links and neighbours decide.
HINTS = set("notice notices alert widget widgets related recommended recommendations share sharing social discussion legal search skip side aside".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

BOILERPLATE, HINTED, NO_ZONE, ARTICLE = 0, 1, 2, 3
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "zone")

# The labelled table the tree is trained on: features as named above, then 1 for main text.
LABELLED = [
    # inside an article: all but links among links
    (1, 0.0, 40, 0.0, 55, 0.0, ARTICLE, 1), (3, 0.0, 0, 0.0, 30, 0.0, ARTICLE, 1), (9, 0.0, 8, 1.0, 60, 0.0, ARTICLE, 1), (60, 0.0, 9, 0.0, 2, 0.0, ARTICLE, 1),
    (120, 0.05, 60, 0.0, 4, 1.0, ARTICLE, 1), (2, 0.0, 120, 0.0, 3, 0.5, ARTICLE, 1), (35, 0.4, 50, 0.0, 20, 0.0, ARTICLE, 1), (12, 0.8, 30, 0.1, 40, 0.0, ARTICLE, 1),
    (5, 1.0, 45, 0.0, 50, 0.0, ARTICLE, 1), (250, 0.0, 250, 0.0, 0, 0.0, ARTICLE, 1), (1, 1.0, 20, 0.0, 25, 0.2, ARTICLE, 1), (18, 0.0, 1, 1.0, 1, 1.0, ARTICLE, 1),
    (2, 0.0, 1, 1.0, 8, 0.0, ARTICLE, 1), (4, 0.0, 6, 0.0, 5, 0.0, ARTICLE, 1), (7, 1.0, 12, 0.0, 3, 1.0, ARTICLE, 1), (1, 0.0, 2, 1.0, 2, 1.0, ARTICLE, 1),
    (2, 1.0, 1, 1.0, 3, 1.0, ARTICLE, 0), (1, 1.0, 2, 1.0, 1, 1.0, ARTICLE, 0), (4, 1.0, 3, 1.0, 2, 1.0, ARTICLE, 0), (6, 1.0, 5, 1.0, 7, 1.0, ARTICLE, 0),
    # inside menus, adverts, forms, notices, footers, comments
    (1, 1.0, 0, 0.0, 1, 1.0, BOILERPLATE, 0), (2, 1.0, 1, 1.0, 2, 1.0, BOILERPLATE, 0), (9, 0.0, 1, 1.0, 8, 0.0, BOILERPLATE, 0), (80, 0.0, 60, 0.0, 70, 0.0, BOILERPLATE, 0),
    (7, 0.2, 120, 0.0, 0, 0.0, BOILERPLATE, 0), (30, 0.0, 12, 0.0, 90, 0.0, BOILERPLATE, 0), (4, 0.0, 40, 0.0, 3, 1.0, BOILERPLATE, 0), (150, 0.1, 3, 0.0, 2, 0.0, BOILERPLATE, 0),
    (15, 0.6, 9, 0.0, 10, 1.0, BOILERPLATE, 0), (45, 0.0, 200, 0.0, 180, 0.0, BOILERPLATE, 0), (1, 0.0, 25, 0.0, 60, 0.0, BOILERPLATE, 0), (22, 1.0, 8, 0.5, 20, 1.0, BOILERPLATE, 0),
    # in an element with a name that says little: long texts with few links stay, and what stands between such
    (50, 0.0, 0, 0.0, 0, 0.0, HINTED, 1), (45, 0.1, 60, 0.0, 9, 0.0, HINTED, 1), (90, 0.0, 5, 1.0, 6, 1.0, HINTED, 1), (160, 0.05, 40, 0.0, 70, 0.0, HINTED, 1),
    (30, 0.0, 55, 0.0, 60, 0.0, HINTED, 1), (35, 0.2, 80, 0.0, 45, 0.1, HINTED, 1), (70, 0.1, 0, 0.0, 3, 1.0, HINTED, 1), (28, 0.0, 45, 0.0, 2, 0.0, HINTED, 1),
    (3, 0.0, 40, 0.0, 50, 0.0, HINTED, 0), (8, 0.0, 90, 0.0, 3, 1.0, HINTED, 0), (12, 0.3, 10, 0.0, 9, 0.0, HINTED, 0), (5, 1.0, 6, 1.0, 4, 1.0, HINTED, 0),
    (15, 0.0, 3, 0.0, 2, 0.0, HINTED, 0), (40, 0.8, 30, 0.9, 25, 1.0, HINTED, 0), (60, 0.7, 50, 0.0, 9, 0.0, HINTED, 0), (10, 0.0, 60, 0.0, 80, 0.0, HINTED, 0),
    # no element that says what it is: length, links and neighbours decide
    (60, 0.0, 5, 0.0, 70, 0.0, NO_ZONE, 1), (45, 0.1, 80, 0.0, 60, 0.1, NO_ZONE, 1), (120, 0.05, 0, 0.0, 3, 1.0, NO_ZONE, 1), (30, 0.0, 90, 0.0, 2, 1.0, NO_ZONE, 1),
    (20, 0.0, 40, 0.0, 50, 0.0, NO_ZONE, 1), (6, 0.0, 60, 0.0, 75, 0.0, NO_ZONE, 1), (3, 0.0, 50, 0.0, 45, 0.0, NO_ZONE, 1), (8, 0.0, 2, 1.0, 90, 0.0, NO_ZONE, 1),
    (10, 0.2, 35, 0.1, 55, 0.0, NO_ZONE, 1), (25, 0.3, 60, 0.0, 40, 0.0, NO_ZONE, 1), (200, 0.25, 10, 1.0, 12, 1.0, NO_ZONE, 1), (18, 0.0, 70, 0.0, 16, 0.0, NO_ZONE, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, NO_ZONE, 0), (3, 1.0, 2, 1.0, 4, 1.0, NO_ZONE, 0), (12, 0.9, 3, 1.0, 50, 0.0, NO_ZONE, 0), (40, 0.7, 30, 0.0, 35, 0.8, NO_ZONE, 0),
    (2, 0.0, 1, 1.0, 2, 1.0, NO_ZONE, 0), (5, 0.0, 3, 0.0, 4, 0.0, NO_ZONE, 0), (9, 0.0, 2, 1.0, 3, 0.5, NO_ZONE, 0), (7, 0.4, 60, 0.0, 0, 0.0, NO_ZONE, 0),
    (4, 0.0, 5, 1.0, 0, 0.0, NO_ZONE, 0), (8, 0.6, 9, 0.7, 10, 0.9, NO_ZONE, 0), (10, 0.0, 4, 0.0, 3, 1.0, NO_ZONE, 0), (25, 0.8, 5, 1.0, 80, 0.0, NO_ZONE, 0),
]


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    label: int = 0


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> Node:
    """A binary tree by Gini impurity; a node with one label, or at the depth, is a leaf."""
    node = Node(label=int(labels.mean() >= 0.5))
    if depth == 0 or labels.min() == labels.max():
        return node
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] < cut
            impurity = sum(s.sum() * labels[s].mean() * (1 - labels[s].mean()) for s in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None:
        return node
    _, node.feature, node.cut, low = best
    node.low, node.high = grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)
    return node


def judge(node: Node, row: tuple) -> int:
    while node.low is not None:
        node = node.low if row[node.feature] < node.cut else node.high
    return node.label


def trained() -> Node:
    table = np.array(LABELLED, dtype=float)
    return grow(table[:, :-1], table[:, -1].astype(int))


@dataclass
class Block:
    text: str
    words: int
    linked: int
    zone: int

    @property
    def link_density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _zone(tag: str, attributes: str, outer: int, has_article: bool) -> int | None:
    """What an element makes of its content; None if nothing in it is shown."""
    values = {}
    if attributes:
        for name, double, single, bare in ATTRIBUTE.findall(attributes):
            values.setdefault(name.lower(), double or single or bare)
    if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower():
        return None
    names = {p.lower() for key in ("class", "id") if key in values for p in NAME_PART.findall(values[key])}
    role = values.get("role", "").lower()
    if outer == BOILERPLATE or tag in ALWAYS_BOILERPLATE or role in BOILERPLATE_ROLES or names & SURE_NAMES:
        return BOILERPLATE
    if names & HINTS:
        return HINTED
    if outer != ARTICLE and (tag == "header" or "header" in names):
        return BOILERPLATE
    if tag == "article" or role == "article" or (not has_article and (tag == "main" or role == "main")):
        return ARTICLE
    return outer


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, lower-case name, whether it closes, and attributes of every tag; comments and declarations have no name.

    Goes forward only. A ``>`` in quotes does not end a tag; once a tag is found that so has no end, the
    rest of the page is read without regard to quotes. The caller may send the place to go on from.
    """
    at, quotes, last = 0, True, html.rfind(">")
    while True:
        start = html.find("<", at)
        if start < 0:
            return
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            end = len(html) if end < 0 else end + 3
            at = (yield start, end, "", False, "") or end
            continue
        if start > last:
            return
        if html[start + 1 : start + 2] in ("!", "?"):
            end = html.find(">", start) + 1
            at = (yield start, end, "", False, "") or end
            continue
        name = NAME.match(html, start + 1)
        if name is None:
            at = start + 1
            continue
        end = _tag_end(html, name.end(), last) if quotes else -1
        if end < 0:
            quotes = False
            end = html.find(">", name.end())
            if end < 0:
                return
        word = name[0].lower()
        at = (yield start, end + 1, word.lstrip("/"), word[0] == "/", html[name.end() : end]) or end + 1


def _tag_end(html: str, at: int, last: int) -> int:
    """The ``>`` that ends a tag, or -1."""
    while at <= last:
        stop = STOP.search(html, at)
        if stop is None:
            return -1
        if stop[0] == ">":
            return stop.start()
        at = html.find(stop[0], stop.end()) + 1
        if not at:
            return -1
    return -1


def blocks(html: str) -> Iterator[Block]:
    """The text blocks of a page in order, with their words, words in links and zone."""
    stack: list[tuple[str, int]] = []
    held: Counter = Counter()  # elements on the stack by name
    has_article = HAS_ARTICLE.search(html) is not None
    zone, link, at, pieces, linked = NO_ZONE, 0, 0, [], []

    def flush() -> Iterator[Block]:
        text = SPACES.sub(" ", unescape("".join(pieces))).strip(" ")
        if text:
            inside = SPACES.sub(" ", unescape(" ".join(linked))).strip(" ")
            words = text.count(" ") + 1
            yield Block(text, words, min(words, inside.count(" ") + 1) if inside else 0, zone)
        pieces.clear()
        linked.clear()

    def add(text: str) -> None:
        pieces.append(text)
        if link:
            linked.append(text)

    found, headless = tags(html), False
    step = next(found, None)
    while step is not None:
        start, end, tag, closing, attributes = step
        if start > at:
            add(html[at:start])
        at, resume = end, None
        if tag in BLOCKS:
            yield from flush()
        if tag == "br":
            add(" ")
        elif tag and closing:
            if tag == "a":
                link = 0
            elif held[tag]:
                place = len(stack) - 1
                while stack[place][0] != tag:
                    place -= 1
                if tag not in BLOCKS and zone != stack[place][1]:
                    yield from flush()
                zone = stack[place][1]
                for name, _ in stack[place:]:
                    held[name] -= 1
                del stack[place:]
        elif tag:
            hides, whole = False, tag in EMPTY or attributes.endswith("/")
            if tag in TRACKED:
                inner = _zone(tag, attributes, zone, has_article)
                hides = inner is None
                if not hides and not whole:
                    if tag == "p" and stack and stack[-1][0] == "p":
                        held["p"] -= 1
                        zone = stack.pop()[1]  # a paragraph ends where the next begins
                        inner = _zone(tag, attributes, zone, has_article)
                    if tag not in BLOCKS and inner != zone:
                        yield from flush()
                    stack.append((tag, zone))
                    held[tag] += 1
                    zone = inner
            if tag == "a":
                link = 1
            if (tag in SKIPPED or hides) and not whole and not (tag == "head" and headless):
                resume = _end_of(html, tag, at) if hides else _raw_end(html, tag, at)
                headless = headless or (tag == "head" and resume == at)  # looked for once
                at = resume
        step = next(found, None) if resume is None else _sent(found, resume)
    add(html[at:])
    yield from flush()


def _sent(found, at: int):
    """The next tag from ``at`` on."""
    try:
        return found.send(at)
    except StopIteration:
        return None


def _raw_end(html: str, tag: str, at: int) -> int:
    """After the end tag that closes an element whose content is not parsed; the end of the page if it has none."""
    if tag == "head":  # its end may be left out; then the body begins it
        found = HEAD_END.search(html, at)
        return found.start() if found else at
    found = re.compile(rf"</{re.escape(tag)}(?=[\s>/])[^>]*>?", re.I).search(html, at)
    return found.end() if found else len(html)


def _end_of(html: str, tag: str, at: int) -> int:
    """After the end tag that closes a hidden element, elements of its kind in it included."""
    depth = 1
    for found in re.compile(rf"<(/?){re.escape(tag)}(?=[\s>/])[^>]*>", re.I).finditer(html, at):
        depth += -1 if found[1] else 1
        if not depth:
            return found.end()
    return len(html)


def main_text(html: str | None, tree: Node) -> str:
    """The blocks that the tree takes for main text, in order, two line breaks between them."""
    found = list(blocks(html or ""))
    shape = [(0, 0.0), *((b.words, b.link_density) for b in found), (0, 0.0)]
    kept = [b.text for i, b in enumerate(found) if judge(tree, (*shape[i + 1], *shape[i], *shape[i + 2], b.zone))]
    return "\n\n".join(kept)


def extract_text(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` without its html, with ``text`` and ``n_chars``.

    Every page is split into flat blocks at block elements; scripts, styles and hidden elements are
    left out, character references decoded once and white space within a block joined. A decision
    tree trained on a small labelled table classes a block by its words and link density, those of
    the blocks before and after it, and where it stands: in an article, in a menu, form, advert or the like (by tag, role or a name of
    ``SURE_NAMES``), in an element with a name that parts of articles have as well (``HINTS``), or
    none of these. A null page, and one without main text, has an empty text. Broken markup is read
    to the end, in time that grows with its length: a tag without an end is text. Columns named as ours are
    replaced. One pass over the rows; nothing is shuffled and no page is cut.
    """
    columns = [c for c in df.columns if c != html_col and c.lower() not in ("text", "n_chars")]
    chosen, place = [df.columns.index(c) for c in columns], df.columns.index(html_col)
    schema = df.select(*[quoted(c) for c in columns]).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        tree = trained()
        for batch in batches:
            texts = [main_text(page.as_py(), tree) for page in batch.column(place)]
            arrays = [*(batch.column(i) for i in chosen), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(batch.schema.names[i] for i in chosen), "text", "n_chars"])

    return df.mapInArrow(run, schema)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages").select("page_id", "url", F.col("html"))).select("page_id", "url", "text", "n_chars")


QUERIES = {"op5_html": (op5_html, None)}
