"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags.  A block is described by its words and its
share of linked words, by those of the blocks before and after it, and by what its
containers say (article or main; menu, footer, form, advert and the like).  A decision
tree, grown here on a small labelled table of such descriptions, picks the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: names of HTML elements and common class words
SKIP = "script style noscript template svg title iframe object select textarea button canvas".split()
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
LOOSE = set("p li dt dd td th tr option".split())  # often left open
CONTENT = {"article", "main"}
BOILER = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
CONTENT_ROLES = {"main", "article"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu"}
BOILER_WORDS = set(
    "nav navbar navigation menu header footer sidebar aside ad ads advert advertisement adverts banner promo promotion sponsor sponsored cookie cookies consent notice notices "
    "popup modal overlay newsletter subscribe signup login search comment comments respond reply replies disqus share sharing social breadcrumb breadcrumbs related pagination "
    "pager widget toolbar masthead copyright legal disclaimer".split()
)

_NAME = re.compile(r"</?([a-zA-Z][^\s/<>]*)")
_REST = re.compile(r"(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+>")
_ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in SKIP}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")


class Container:
    """An element: its mark ('c' main text, 'b' something else, '' nothing), whether that is only a hint, and what it holds."""

    __slots__ = ("tag", "mark", "hint", "outer", "words", "holds", "boiler", "content")

    def __init__(self, tag: str, mark: str, hint: bool, outer: Container | None):
        self.tag, self.mark, self.hint, self.outer = tag, mark, hint, outer
        self.words, self.holds, self.boiler = 0, False, False
        self.content = mark == "c" or (outer is not None and outer.content)


class Block:
    __slots__ = ("text", "words", "linked", "inside")

    def __init__(self, text: str, linked: int, inside: Container):
        self.text, self.words, self.linked, self.inside = text, text.count(" ") + 1, linked, inside


def _mark(tag: str, attributes: str, in_content: bool) -> tuple[str, bool]:
    """What a container says about its inside, and whether that is a hint by a name or a form, which a wrapper of the whole page may have too."""
    for name, a, b, c in _ATTR.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() == "role":
            if value in BOILER_ROLES:
                return "b", False
            if value in CONTENT_ROLES:
                return "c", False
        elif tag in CONTENT:
            if BOILER_WORDS & set(value.split()):
                return "b", True
        elif tag not in ("body", "html") and BOILER_WORDS & set(_WORD.findall(value)):
            return "b", True
    if tag in CONTENT:
        return "c", False
    if tag in BOILER and not (tag == "header" and in_content):  # an article's own header is part of it
        return "b", tag == "form"
    return "", False


def tags(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """('', text, False, '') and (tag, '', is end tag, attributes) in page order, in time linear in the page.

    A tag that isn't closed ends at the next ``<``.  Comments, markup declarations and elements of ``SKIP`` with
    what they hold are left out.
    """
    at, size, close, ended = 0, len(page), 0, set()
    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            yield "", page[at:start], False, ""
        at = start
        if at == size:
            return
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            yield "", page[at + 9 : size if end < 0 else end], False, ""
            at = size if end < 0 else end + 3
            continue
        name = _NAME.match(page, at)
        if close <= at and close >= 0:  # the next end of a tag is looked for once
            close = page.find(">", at)
        if not name:
            if page.startswith(("<!", "<?", "</"), at) and close >= 0:
                at = close + 1
            else:
                yield "", "<", False, ""
                at += 1
            continue
        tag, is_end = name[1].lower(), page[at + 1] == "/"
        rest = _REST.match(page, name.end())
        if rest:
            attributes, at = page[name.end() : rest.end() - 1], rest.end()
        else:
            following = page.find("<", name.end())
            following = size if following < 0 else following
            if 0 <= close < following:
                attributes, at = page[name.end() : close], close + 1
            elif close >= 0 and any(q in page[name.end() : following] for q in "\"'"):
                attributes, at = "", close + 1  # a quoted <
            else:
                attributes, at = page[name.end() : following], following
        if tag in _ENDS:
            if not is_end and not attributes.endswith("/") and tag not in ended:
                end = _ENDS[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style", "textarea"):
                    return
                else:
                    ended.add(tag)
            continue
        yield tag, "", is_end, attributes


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order; tags that are left open or closed twice are put up with.

    A container's name or a form is a hint that doesn't count if it holds over half of the page's words
    along with an article or a main heading: such a container wraps the page.
    """
    found: list[Block] = []
    stack = [Container("", "", False, None)]
    every, is_open = list(stack), Counter()
    parts: list[str] = []
    links: list[str] = []
    in_link = False

    def flush():
        text = " ".join("".join(parts).split())
        linked = len("".join(links).split())
        parts.clear()
        links.clear()
        if text:
            found.append(Block(text, linked, stack[-1]))
            stack[-1].words += found[-1].words

    def leave():
        is_open[stack[-1].tag] -= 1
        return stack.pop().tag

    for tag, raw, is_end, attributes in tags(page):
        if not tag:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                links.append(text)
        elif tag == "a":
            in_link = not is_end
            if links:
                links.append(" ")
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            if is_end:
                if is_open[tag]:
                    while leave() != tag:
                        pass
                in_link = False
            elif tag not in VOID and not attributes.endswith("/"):
                while stack[-1].tag in LOOSE and (tag == stack[-1].tag or stack[-1].tag == "p"):
                    leave()
                mark, hint = _mark(tag, attributes, stack[-1].content)
                stack[-1].holds |= tag == "h1" or (tag in CONTENT and mark == "c")
                stack.append(Container(tag, mark, hint, stack[-1]))
                every.append(stack[-1])
                is_open[tag] += 1
    flush()
    for c in reversed(every[1:]):  # inner ones first
        c.outer.words += c.words
        c.outer.holds |= c.holds
    for c in every[1:]:
        wraps = c.hint and c.holds and 2 * c.words > every[0].words
        c.boiler = c.outer.boiler or (c.mark == "b" and not wraps)
    return found


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "boiler container", "content container")

#: The labelled table: FEATURES of blocks of made-up pages of usual layouts, and whether they are main text.
LABELLED = np.array(
    [
        # articles in an article or main element: titles, paragraphs long and short, lists, captions, linked passages
        (8, 0.0, 0, 0.0, 60, 0.0, 0, 1, 1), (3, 0.0, 5, 1.0, 45, 0.1, 0, 1, 1), (60, 0.0, 8, 0.0, 80, 0.0, 0, 1, 1), (80, 0.05, 60, 0.0, 1, 0.0, 0, 1, 1),
        (1, 0.0, 80, 0.05, 30, 0.2, 0, 1, 1), (30, 0.2, 1, 0.0, 12, 0.0, 0, 1, 1), (12, 0.0, 30, 0.2, 4, 1.0, 0, 1, 1), (5, 0.4, 12, 0.0, 50, 0.0, 0, 1, 1),
        (4, 1.0, 12, 0.0, 50, 0.0, 0, 1, 1), (150, 0.02, 5, 0.4, 9, 0.0, 0, 1, 1), (9, 0.0, 150, 0.02, 10, 0.0, 0, 1, 1), (2, 0.0, 9, 0.0, 2, 0.0, 0, 1, 1),
        (2, 0.0, 2, 0.0, 40, 0.0, 0, 1, 1), (400, 0.0, 2, 0.0, 0, 0.0, 0, 1, 1), (6, 0.0, 1, 1.0, 1, 0.0, 0, 1, 1), (20, 0.5, 70, 0.0, 6, 0.0, 0, 1, 1),
        (3, 0.0, 2, 1.0, 45, 0.0, 0, 1, 1), (2, 0.0, 1, 1.0, 30, 0.0, 0, 1, 1), (1, 0.0, 4, 1.0, 1, 0.0, 0, 1, 1), (4, 0.0, 3, 1.0, 12, 0.0, 0, 1, 1), (1, 0.0, 1, 1.0, 0, 0.0, 0, 1, 1),
        # things inside an article or main element that are not its text: share rows, adverts, comments, forms
        (4, 1.0, 90, 0.0, 4, 1.0, 1, 1, 0), (12, 0.0, 90, 0.0, 70, 0.0, 1, 1, 0), (55, 0.0, 30, 0.0, 40, 0.0, 1, 1, 0), (140, 0.0, 55, 0.0, 30, 0.1, 1, 1, 0),
        (3, 0.0, 20, 0.0, 1, 0.0, 1, 1, 0), (7, 0.6, 1, 0.0, 3, 1.0, 1, 1, 0), (25, 0.0, 200, 0.0, 25, 0.0, 1, 1, 0),
        # menus, page headers, footers, sidebars, notices, adverts outside
        (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (2, 1.0, 1, 1.0, 3, 1.0, 1, 0, 0), (5, 1.0, 3, 1.0, 8, 0.0, 1, 0, 0), (9, 0.0, 5, 1.0, 60, 0.0, 1, 0, 0),
        (14, 0.1, 80, 0.0, 0, 0.0, 1, 0, 0), (40, 0.0, 5, 1.0, 70, 0.0, 1, 0, 0), (120, 0.0, 60, 0.0, 20, 0.3, 1, 0, 0), (20, 0.3, 120, 0.0, 4, 1.0, 1, 0, 0),
        (3, 0.0, 4, 1.0, 2, 1.0, 1, 0, 0), (75, 0.1, 20, 0.0, 60, 0.0, 1, 0, 0), (30, 0.0, 1, 1.0, 6, 0.0, 1, 0, 0),
        # pages without such elements: long or little-linked blocks beside others of their kind are text
        (9, 0.0, 4, 1.0, 70, 0.0, 0, 0, 1), (70, 0.0, 9, 0.0, 60, 0.05, 0, 0, 1), (60, 0.05, 70, 0.0, 15, 0.0, 0, 0, 1), (15, 0.0, 60, 0.05, 45, 0.0, 0, 0, 1),
        (45, 0.0, 15, 0.0, 3, 1.0, 0, 0, 1), (35, 0.2, 50, 0.0, 40, 0.0, 0, 0, 1), (4, 0.0, 50, 0.0, 45, 0.0, 0, 0, 1), (25, 0.1, 0, 0.0, 0, 0.0, 0, 0, 1),
        (12, 0.0, 30, 0.0, 20, 0.0, 0, 0, 1), (90, 0.1, 2, 1.0, 6, 0.9, 0, 0, 1), (18, 0.0, 0, 0.0, 22, 0.0, 0, 0, 1), (2, 0.0, 35, 0.0, 60, 0.0, 0, 0, 1),
        (3, 0.0, 4, 1.0, 14, 0.0, 0, 0, 1), (4, 0.0, 2, 1.0, 40, 0.0, 0, 0, 1), (2, 0.0, 6, 1.0, 80, 0.0, 0, 0, 1), (5, 0.0, 2, 1.0, 25, 0.05, 0, 0, 1),
        # last paragraphs
        (13, 0.1, 14, 0.0, 0, 0.0, 0, 0, 1), (14, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1), (12, 0.0, 20, 0.1, 3, 1.0, 0, 0, 1), (11, 0.0, 45, 0.0, 4, 0.0, 0, 0, 1),
        # and short or linked blocks beside others of their kind are not
        (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (3, 1.0, 2, 1.0, 5, 1.0, 0, 0, 0), (4, 1.0, 5, 1.0, 60, 0.0, 0, 0, 0), (2, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0),
        (6, 0.9, 45, 0.0, 3, 1.0, 0, 0, 0), (3, 0.0, 4, 1.0, 2, 0.0, 0, 0, 0), (20, 0.8, 3, 1.0, 15, 0.9, 0, 0, 0), (30, 0.9, 20, 0.8, 10, 1.0, 0, 0, 0),
        (5, 0.0, 6, 1.0, 0, 0.0, 0, 0, 0), (4, 0.5, 2, 1.0, 3, 0.7, 0, 0, 0), (8, 1.0, 70, 0.0, 60, 0.0, 0, 0, 0), (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0),
    ]
)


def grow_tree(x: np.ndarray, y: np.ndarray, least: int = 2, depth: int = 8):
    """A binary tree by Gini impurity: (feature, cut, lower branch, upper branch) or a share of ones."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            n = int(low.sum())
            if least <= n <= len(y) - least:
                p, q = y[low].mean(), y[~low].mean()
                impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut))
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return share
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, grow_tree(x[low], y[low], least, depth - 1), grow_tree(x[~low], y[~low], least, depth - 1)


def tree_value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def block_rows(found: list[Block]) -> list[tuple]:
    size = [0, *(b.words for b in found), 0]
    density = [0.0, *(min(1.0, b.linked / b.words) for b in found), 0.0]
    return [(size[i + 1], density[i + 1], size[i], density[i], size[i + 2], density[i + 2], int(b.inside.boiler), int(b.inside.content)) for i, b in enumerate(found)]


def main_text(page: str | None, tree) -> str:
    """Blocks that the tree takes for main text, one on each line; empty for a null or empty page."""
    found = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, block_rows(found)) if tree_value(tree, row) >= 0.5)


def extract_main_text(pages: DataFrame, html_col: str = "html", labelled: np.ndarray = LABELLED) -> DataFrame:
    """``pages`` without the html but with text and n_chars (code points); other columns pass unchanged.

    Null and empty pages give empty text.  Whole pages are read, however long; repeated rows each give a row.  Columns of
    ``pages`` called text or n_chars are replaced.  Each row stands alone: no shuffle.
    """
    tree = grow_tree(labelled[:, :-1], labelled[:, -1])
    rest = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]

    def run(batches):
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    schema = pages.select(*rest).schema.add("text", "string").add("n_chars", "long")
    return pages.select(*rest, F.col(html_col).cast("string").alias(html_col)).mapInArrow(run, schema)
