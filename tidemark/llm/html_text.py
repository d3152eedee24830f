"""Main text of web pages: flat text blocks, classified by a decision tree.

Markup is cut at block-level tags into a flat list of text blocks. Each block is described by its word count
and link density, those of its neighbours, and by what it stands in (article, page furniture, list). A small
decision tree, grown on the labelled table below, tells main text from the rest. Blocks kept are joined by an
empty line, in page order.

Furniture is known by its element, by `hidden`, or by words in class, id and role. On headings, paragraphs and other
elements of running text, and in ids anywhere, a word counts only if the whole token is made of such words and of words
for parts and places (`sidebar-left`, not `widget-note`). An id names an anchor: on elements of running text it
says nothing. A class that says that furniture
is there or not (`has-sidebar`), or that heads a text (`entry-header`), marks none, nor do classes of html, body,
article and main. A form or a wrapper by class is neutral if it contains the page's article, or most of its text
where there is no article or within it (comments, related texts and advertisements excepted, which may be longer).

White space inside a block, `<br>` included, becomes one space; character references are decoded. Scripts,
styles and comments are no text. Null and empty pages, and pages without main text, give an empty string.
Unclosed and unmatched tags are tolerated. Rows are independent; repeated rows and null ids stay; extra
columns are left alone, `text` and `n_chars` are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, table

#: Tags that end a block (fixed by HTML).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "search section select summary table tbody td template tfoot th thead title tr ul iframe noscript textarea".split())
#: Elements whose content is raw text and never shown as such.
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that hold page furniture.
FURNITURE_TAGS = frozenset(
    "nav header footer aside form menu dialog head noscript template select button fieldset svg math object search".split())
#: Elements without content.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id and role that mark furniture.
FURNITURE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alert|pop-?up|modal|overlay|"
    r"newsletter|subscri\w*|side-?bar|widget|nav|navbar|navigation|menu|breadcrumbs?|page-?header|site-?header|header|"
    r"masthead|footer|comments?|disqus|respond|repl(?:y|ies)|share|sharing|social|related|recommend\w*|sign-?up|log-?in|"
    r"toolbar|paginat\w*|pager|contentinfo|complementary|search|dialog|hidden)(?=$|[\s_-])", re.I)
#: Parts of a class token that make it a statement about the page, and those that make a header one of the text.
STATEMENTS = frozenset("no not non has have with without free enabled disabled".split())
TEXT_PARTS = frozenset("entry article post story content section headline title news blog".split())
#: Elements of running text: a class names furniture by its whole token only, an id never.
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre figure figcaption td th caption span a b i em strong "
                      "code mark small time summary details address".split())
#: Parts of a token that name a part or a place and leave its meaning to the others.
PLACES = frozenset("left right top bottom site page main global primary secondary inner outer upper lower sticky fixed "
                   "bar box container wrapper wrap area section list block panel links link buttons button icons icon "
                   "items item form field slot unit label group row column col thread text message policy posts".split())
#: What stands beside the text and may be longer than it, so their share of the page says nothing.
_BESIDE = re.compile(r"comments?|disqus|respond|repl(?:y|ies)|related|recommend\w*|ads?|advert\w*|promo\w*|sponsor\w*|"
                     r"cookies?|consent|gdpr|newsletter|subscri\w*", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                   r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "in_article", "in_furniture", "in_list")
#: Labelled blocks: the features in the order above, then 1 for main text.
LABELLED = [
    # paragraphs of an article: long, short, first, last, beside furniture
    (80, 0.0, 12, 0.0, 95, 0.0, 1, 0, 0, 1), (3, 0.0, 80, 0.0, 60, 0.0, 1, 0, 0, 1), (1, 0.0, 40, 0.0, 2, 0.0, 1, 0, 0, 1),
    (9, 0.0, 5, 1.0, 70, 0.0, 1, 0, 0, 1), (150, 0.02, 90, 0.0, 9, 0.2, 1, 0, 0, 1), (60, 0.3, 30, 0.1, 45, 0.0, 1, 0, 0, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (25, 0.0, 11, 0.0, 8, 0.4, 1, 0, 0, 1), (12, 0.5, 60, 0.0, 70, 0.0, 1, 0, 0, 1),
    (400, 0.0, 6, 0.0, 10, 0.1, 1, 0, 0, 1), (1, 1.0, 50, 0.0, 45, 0.0, 1, 0, 0, 1), (5, 1.0, 60, 0.0, 55, 0.0, 1, 0, 0, 1),
    # headlines right after furniture, of an article or of a page without one
    (4, 0.0, 1, 1.0, 51, 0.0, 1, 0, 0, 1), (7, 0.0, 2, 1.0, 90, 0.0, 1, 0, 0, 1), (3, 0.0, 0, 0.0, 45, 0.0, 1, 0, 0, 1),
    (4, 0.0, 1, 1.0, 51, 0.0, 0, 0, 0, 1), (7, 0.0, 2, 1.0, 90, 0.0, 0, 0, 0, 1), (4, 0.0, 0, 0.0, 51, 0.0, 0, 0, 0, 1),
    # short paragraphs of an article before and between links
    (9, 0.0, 40, 0.0, 1, 1.0, 1, 0, 0, 1), (5, 0.0, 60, 0.0, 2, 1.0, 1, 0, 0, 1), (12, 0.0, 3, 1.0, 2, 1.0, 1, 0, 0, 1),
    (2, 0.0, 3, 1.0, 2, 1.0, 1, 0, 0, 1), (3, 0.0, 4, 0.9, 1, 0.6, 1, 0, 0, 1), (1, 0.0, 70, 0.0, 5, 0.9, 1, 0, 1, 1),
    (6, 0.0, 80, 0.0, 3, 1.0, 0, 0, 0, 1), (9, 0.0, 60, 0.0, 1, 1.0, 0, 0, 0, 1),
    # lists within an article: items of text, and lists of links
    (14, 0.0, 16, 0.0, 11, 0.0, 1, 0, 1, 1), (4, 0.0, 5, 0.0, 3, 0.0, 1, 0, 1, 1), (22, 0.1, 40, 0.0, 18, 0.0, 1, 0, 1, 1),
    (3, 1.0, 4, 1.0, 2, 1.0, 1, 0, 1, 0), (6, 1.0, 5, 1.0, 30, 0.0, 1, 0, 1, 0), (8, 0.9, 7, 1.0, 9, 0.9, 1, 0, 1, 0),
    (3, 1.0, 3, 0.0, 4, 1.0, 1, 0, 1, 0), (5, 1.0, 2, 0.0, 3, 1.0, 1, 0, 1, 0), (7, 0.8, 9, 0.0, 6, 0.9, 1, 0, 1, 0),
    # furniture, inside an article or not
    (40, 0.0, 80, 0.0, 60, 0.0, 1, 1, 0, 0), (6, 0.5, 50, 0.0, 0, 0.0, 1, 1, 0, 0), (18, 0.0, 22, 0.0, 30, 0.0, 1, 1, 1, 0),
    (120, 0.0, 70, 0.0, 80, 0.0, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1, 0), (2, 1.0, 1, 1.0, 20, 0.0, 0, 1, 1, 0),
    (9, 0.1, 75, 0.0, 0, 0.0, 0, 1, 0, 0), (35, 0.0, 3, 1.0, 60, 0.0, 0, 1, 0, 0), (10, 0.0, 1, 1.0, 10, 0.0, 0, 1, 0, 0),
    (65, 0.0, 12, 0.0, 70, 0.0, 1, 1, 0, 0), (28, 0.05, 0, 0.0, 31, 0.0, 0, 1, 1, 0), (4, 0.0, 90, 0.0, 5, 0.0, 1, 1, 0, 0),
    # pages without an article element: text among text, and what surrounds it
    (70, 0.0, 55, 0.0, 80, 0.0, 0, 0, 0, 1), (45, 0.1, 6, 0.0, 60, 0.0, 0, 0, 0, 1), (90, 0.05, 70, 0.0, 3, 0.9, 0, 0, 0, 1),
    (8, 0.0, 60, 0.0, 75, 0.0, 0, 0, 0, 1), (6, 0.0, 3, 0.8, 85, 0.0, 0, 0, 0, 1), (20, 0.0, 18, 0.0, 0, 0.0, 0, 0, 0, 1),
    (16, 0.0, 25, 0.0, 22, 0.0, 0, 0, 1, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (30, 0.2, 40, 0.1, 5, 0.3, 0, 0, 0, 1),
    # text of such a page right after links
    (40, 0.0, 1, 1.0, 40, 0.0, 0, 0, 0, 1), (70, 0.0, 2, 1.0, 55, 0.0, 0, 0, 0, 1), (25, 0.05, 5, 0.9, 0, 0.0, 0, 0, 0, 1),
    (19, 0.0, 3, 1.0, 30, 0.1, 0, 0, 0, 1), (12, 0.0, 2, 0.8, 2, 1.0, 0, 0, 0, 1), (150, 0.02, 1, 1.0, 3, 0.9, 0, 0, 0, 1),
    # the only text of a page, with a long link
    (30, 0.5, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (20, 0.65, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (12, 0.75, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (60, 0.7, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (6, 0.6, 4, 0.9, 5, 1.0, 0, 0, 0, 0), (3, 0.67, 2, 1.0, 3, 0.67, 0, 0, 0, 0),
    (10, 0.7, 8, 0.8, 40, 0.0, 0, 0, 0, 0), (20, 0.6, 30, 0.9, 22, 0.7, 0, 0, 1, 0), (5, 0.6, 0, 0.0, 60, 0.0, 0, 0, 0, 0),
    # links at the end of a page or of an article, and furniture that is all links
    (8, 1.0, 60, 0.0, 0, 0.0, 0, 1, 0, 0), (12, 0.9, 3, 0.2, 0, 0.0, 0, 1, 0, 0), (20, 0.8, 0, 0.0, 0, 0.0, 0, 1, 0, 0),
    (9, 1.0, 70, 0.0, 0, 0.0, 0, 0, 0, 0), (14, 0.8, 30, 0.1, 0, 0.0, 0, 0, 0, 0), (30, 0.9, 1, 1.0, 0, 0.0, 0, 0, 0, 0),
    (18, 0.7, 5, 0.9, 0, 0.0, 0, 0, 0, 0), (10, 1.0, 50, 0.0, 40, 0.0, 1, 1, 0, 0), (6, 0.9, 80, 0.0, 0, 0.0, 1, 1, 0, 0),
    (25, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0), (8, 0.95, 0, 0.0, 0, 0.0, 0, 0, 0, 0),
    (60, 1.0, 20, 0.0, 0, 0.0, 0, 1, 1, 0), (90, 0.9, 0, 0.0, 80, 0.0, 0, 1, 0, 0), (30, 0.7, 0, 0.0, 0, 0.0, 0, 1, 0, 0),
    (12, 0.6, 60, 0.0, 0, 0.0, 0, 1, 0, 0), (20, 0.65, 50, 0.0, 70, 0.0, 1, 1, 0, 0), (55, 0.8, 3, 1.0, 60, 0.0, 0, 1, 0, 0),
    (15, 0.7, 0, 0.0, 60, 0.0, 0, 1, 0, 0), (70, 0.7, 80, 0.0, 0, 0.0, 1, 1, 0, 0), (70, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0),
    (80, 0.9, 60, 0.0, 0, 0.0, 0, 0, 0, 0), (65, 1.0, 50, 0.0, 4, 1.0, 0, 0, 1, 0), (16, 0.7, 0, 0.0, 25, 0.6, 0, 1, 0, 0),
    (2, 0.6, 0, 0.0, 0, 0.0, 0, 1, 0, 0), (9, 0.7, 70, 0.0, 50, 0.0, 0, 1, 0, 0), (45, 0.75, 0, 0.0, 0, 0.0, 0, 1, 0, 0),
    (5, 1.0, 4, 1.0, 6, 1.0, 0, 0, 1, 0), (3, 0.9, 2, 1.0, 70, 0.0, 0, 0, 0, 0), (4, 0.8, 80, 0.0, 2, 1.0, 0, 0, 0, 0),
    (12, 0.9, 10, 0.8, 14, 1.0, 0, 0, 0, 0), (25, 0.7, 20, 0.9, 22, 0.8, 0, 0, 1, 0), (2, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 1, 0), (1, 1.0, 1, 1.0, 40, 0.0, 0, 0, 1, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0),
    (2, 1.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0), (1, 1.0, 70, 0.0, 0, 0.0, 0, 0, 0, 0), (4, 0.9, 40, 0.1, 70, 0.0, 0, 0, 0, 0),
    (2, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (3, 0.0, 4, 0.9, 1, 0.6, 0, 0, 0, 0), (40, 0.6, 35, 0.7, 30, 0.9, 0, 0, 0, 0),
]


def grow(rows: np.ndarray, labels: np.ndarray) -> tuple | int:
    """A decision tree by Gini impurity until its leaves are pure: (feature, cut, left, right) or a label."""
    if labels.min() == labels.max():
        return int(labels[0])
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for cut in (values[1:] + values[:-1]) / 2:
            left = rows[:, feature] <= cut
            impurity = sum(part.size * 2 * part.mean() * (1 - part.mean()) for part in (labels[left], labels[~left]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, float(cut))
    if best is None:
        return int(labels.mean() >= 0.5)
    left = rows[:, best[1]] <= best[2]
    return best[1], best[2], grow(rows[left], labels[left]), grow(rows[~left], labels[~left])


def default_tree() -> tuple | int:
    data = np.array(LABELLED, float)
    return grow(data[:, :-1], data[:, -1])


def classify(tree: tuple | int, row: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _marks_furniture(token: str, whole: bool) -> str | None:
    """The furniture word of a class, id or role token, if it has one and names furniture by it.

    If `whole`, every part of the token must be a furniture word, a number, or the name of a part or place.
    """
    found = [m[0].strip("-_").lower() for m in FURNITURE_WORDS.finditer(token)]
    if not found:
        return None
    parts = set(re.split("[-_]+", token.lower()))
    if parts & STATEMENTS or set(found) == {"header"} and parts & TEXT_PARTS:
        return None
    if whole and not FURNITURE_WORDS.fullmatch(token) and not all(
            part in PLACES or part.isdigit() or FURNITURE_WORDS.fullmatch(part) for part in parts if part):
        return None
    return found[0]


#: How an element stands to furniture: none; by its class or as a form; the same, beside the text; for certain.
NONE, WEAK, BESIDE, CERTAIN = range(4)


def _furniture(tag: str, attributes: str, in_article: bool) -> int:
    if tag in ("html", "body"):
        return NONE
    if tag in FURNITURE_TAGS and tag != "form" and not (tag == "header" and in_article):
        return CERTAIN
    kind = WEAK if tag == "form" else NONE
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "style" and _HIDDEN_STYLE.search(value):
            return CERTAIN
        if name in ("class", "id", "role") and tag not in ("article", "main") and (name != "id" or tag not in TEXT_TAGS):
            for token in value.split():
                word = _marks_furniture(token, name == "id" or tag in TEXT_TAGS)
                if word:
                    kind = max(kind, BESIDE if _BESIDE.fullmatch(word) else WEAK)
    return kind


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, words within links, in article, in furniture, in list) of every text block, in order."""
    out: list[tuple] = []
    pieces: list[str] = []
    linked = 0
    # tag, then article, furniture, list, link counts outside it, and the innermost wrapper and article there
    open_tags: list[tuple[str, int, int, int, int, int, int]] = []
    open_count: Counter = Counter()  # open tags by name: an end tag without its element costs nothing
    article = furniture = in_list = link = 0
    wrapper = inner = -1
    wrappers: list[list[int]] = []  # elements of WEAK or BESIDE kind: the one around it, kind, words, innermost article around it
    articles: list[list[int]] = []  # the wrapper around it, words of which it is the innermost article

    def text_of(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if link:
                linked += len(piece.split())

    def end_block() -> None:
        nonlocal linked
        if pieces:
            found = "".join(pieces).split()
            if found:
                out.append((" ".join(found), len(found), min(linked, len(found)), int(article > 0),
                            int(furniture > 0), int(in_list > 0), wrapper))
                if not furniture:
                    if wrapper >= 0:
                        wrappers[wrapper][2] += len(found)
                    if inner >= 0:
                        articles[inner][1] += len(found)
            pieces.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal article, furniture, in_list, link, wrapper, inner
        _, article, furniture, in_list, link, wrapper, inner = open_tags[upto]
        open_count.subtract(entry[0] for entry in open_tags[upto:])
        del open_tags[upto:]

    at, n = 0, len(page)
    while at < n:
        m = _MARK.search(page, at)
        if not m:
            text_of(page[at:])
            break
        text_of(page[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK_TAGS or tag in RAW_TAGS and tag not in ("script", "style"):
            end_block()
        if closing:
            for i in range(len(open_tags) - 1 if open_count[tag] else -1, -1, -1):
                if open_tags[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in RAW_TAGS:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = stop.start() if stop else n
            continue
        if tag in VOID_TAGS:
            continue
        if tag == "body":
            for i, entry in enumerate(open_tags):
                if entry[0] == "head":
                    close(i)
                    break
        elif tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option"):  # a new one ends an open one
            for i in range(len(open_tags) - 1 if open_count[tag] else -1, -1, -1):
                if open_tags[i][0] == tag:
                    close(i)
                    break
                if open_tags[i][0] in BLOCK_TAGS and open_tags[i][0] != "p":
                    break
        open_count[tag] += 1
        open_tags.append((tag, article, furniture, in_list, link, wrapper, inner))
        kind = _furniture(tag, attributes, article > 0)
        furniture += kind == CERTAIN
        if kind in (WEAK, BESIDE):
            wrappers.append([wrapper, kind, 0, inner])
            wrapper = len(wrappers) - 1
        if tag in ("article", "main"):
            article += 1
            articles.append([wrapper, 0])
            inner = len(articles) - 1
        in_list += tag in ("ul", "ol", "dl")
        link += tag == "a"
    end_block()
    left_out = _left_out(wrappers, articles, sum(b[1] for b in out if not b[4]))
    return [(*b[:4], int(b[4] or b[6] >= 0 and left_out[b[6]]), b[5]) for b in out]


def _left_out(wrappers: list[list[int]], articles: list[list[int]], total: int) -> list[bool]:
    """Which wrappers are furniture, or stand in one that is: not those around the longest article or most of the text."""
    for around, _, words, _ in reversed(wrappers):  # a wrapper stands before those within it
        if around >= 0:
            wrappers[around][2] += words
    longest = max(range(len(articles)), key=lambda i: articles[i][1], default=-1)
    if longest >= 0 and not articles[longest][1]:
        longest = -1
    holds, at = set(), articles[longest][0] if longest >= 0 else -1
    while at >= 0:
        holds.add(at)
        at = wrappers[at][0]
    out: list[bool] = []
    for i, (around, kind, words, article) in enumerate(wrappers):
        neutral = i in holds or kind == WEAK and 2 * words > total and article == longest
        out.append(not neutral or around >= 0 and out[around])
    return out


def main_text(page: str | None, tree: tuple | int) -> str:
    found = blocks(page) if page else []
    kept = []
    for i, (text, words, linked, article, furniture, in_list) in enumerate(found):
        before = found[i - 1] if i else ("", 0, 0)
        after = found[i + 1] if i + 1 < len(found) else ("", 0, 0)
        row = (words, linked / words, before[1], before[2] / max(before[1], 1), after[1], after[2] / max(after[1], 1),
               article, furniture, in_list)
        if classify(tree, row):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, tree: tuple | int | None = None) -> DataFrame:
    """`pages` with the main `text` of `html` and its length in code points."""
    tree = default_tree() if tree is None else tree

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page, tree) for page in batch], dtype=object)

    texts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    out = bound_batches(pages).withColumn("text", F.pandas_udf(texts, "string")("html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", "n_chars")
