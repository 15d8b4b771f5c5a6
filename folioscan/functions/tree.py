"""The element tree of a page as arrays, for rules that nesting decides.

Elements are numbered in document order. An element's descendants are the numbers after its own up to where it closes, and
its text is a stretch of the page's visible texts, so children, leaves and insides are tests on intervals and reading a page
takes time in proportion to it. Nothing is implied: an end tag closes the nearest open element of its name and all inside it,
one without an open element closes none, and what is left open ends with the page.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed as K

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>"']*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_TITLED = re.compile(rf"(?:^|[\s_\-.])(?:{K.TITLE_TOKENS})(?:$|[\s_\-.])", re.I)
_RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_ROOT = ""


@dataclass
class Tree:
    """One entry per element; number 0 is the page itself."""

    names: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    # How many nodes of the parent come before: elements, texts (blank ones too) and comments.
    places: list[int] = field(default_factory=list)
    # The number after the last descendant.
    ends: list[int] = field(default_factory=list)
    text_from: list[int] = field(default_factory=list)
    text_to: list[int] = field(default_factory=list)
    # Visible texts, trimmed and decoded, without blank ones.
    texts: list[str] = field(default_factory=list)

    def text(self, i: int) -> str:
        return " ".join(self.texts[self.text_from[i]:self.text_to[i]])

    def inside(self, i: int, names: frozenset[str]) -> list[int]:
        """Descendants with one of the names, in document order."""
        return [j for j in range(i + 1, self.ends[i]) if self.names[j] in names]

    def first(self, name: str, default: int | None = None) -> int | None:
        try:
            return self.names.index(name, 1)
        except ValueError:
            return default


def read_tree(page: str) -> Tree:
    """Read a page once, from start to end."""
    tree = Tree()
    stack: list[int] = []
    nodes: list[int] = []
    still_open: dict[str, int] = {}
    muted = 0

    def enter(name: str, attributes: str) -> None:
        tree.names.append(name)
        tree.attributes.append(attributes)
        tree.parents.append(stack[-1] if stack else -1)
        tree.places.append(nodes[-1] if nodes else 0)
        tree.ends.append(0)
        tree.text_from.append(len(tree.texts))
        tree.text_to.append(0)
        if nodes:
            nodes[-1] += 1
        stack.append(len(tree.names) - 1)
        nodes.append(0)
        still_open[name] = still_open.get(name, 0) + 1

    def leave() -> str:
        i = stack.pop()
        nodes.pop()
        tree.ends[i], tree.text_to[i] = len(tree.names), len(tree.texts)
        still_open[tree.names[i]] -= 1
        return tree.names[i]

    def write(start: int, end: int) -> None:
        if start < end:
            nodes[-1] += 1
            shown = "" if muted else html.unescape(page[start:end]).strip(K.WS_CHARS)
            if shown:
                tree.texts.append(shown)

    enter(_ROOT, "")
    at = 0
    while token := _TOKEN.search(page, at):
        write(at, token.start())
        at = token.end()
        if token[2] is None:
            nodes[-1] += 1
            continue
        name, rest = token[2].lower(), token[3]
        if token[1]:
            # Each element is left once, so all this takes time in proportion to the elements.
            while still_open.get(name):
                left = leave()
                muted -= left == "template"
                if left == name:
                    break
            continue
        enter(name, rest)
        if rest.endswith("/") or name in K.VOID_ELEMENTS:
            leave()
        elif name in _RAW_ENDS:
            end = _RAW_ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            leave()
        else:
            muted += name == "template"
    write(at, len(page))
    while stack:
        leave()
    return tree


def _speaks_of_title(attributes: str) -> bool:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        # The last of repeated attributes stands.
        found[name.lower()] = html.unescape("".join(values))
    if "class" not in found and "id" not in found:
        return False
    return bool(_TITLED.search(f"{' '.join(found.get('class', '').split())} {found.get('id', '')}"))


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "header"))
_EMPHASIS = frozenset(("strong", "b", "em"))
_LINES = frozenset(("p", "div", "span"))
_BLOCKS = frozenset(("p", "div"))


def _leaf_texts(tree: Tree, body: int, names: frozenset[str], limit: int) -> list[str]:
    """Texts of the first ``limit`` named elements in the body, without those that hold a line element or no text."""
    early = islice((j for j in range(body + 1, tree.ends[body]) if tree.names[j] in names), limit)
    leaves = (i for i in early
              if not any(tree.names[j] in _LINES for j in range(i + 1, tree.ends[i])))
    return [t for t in map(tree.text, leaves) if t]


def title_parts(page: str) -> dict[str, object]:
    """What a title may be taken from, in order of trust; once a sure one is found the others stay empty.

    ``heading``: the first heading in the body, else the page's title. ``named``: the first element with text whose class or
    id speaks of a title. ``emphasis``: short emphasised texts within the first ten nodes of the body. ``lines`` and
    ``blocks``: leaves among the first ten lines and the first five blocks.
    """
    parts: dict[str, object] = {"heading": None, "named": None, "emphasis": [], "lines": [], "blocks": []}
    tree = read_tree(page)
    body = tree.first("body", 0)
    heading = next((j for j in range(body + 1, tree.ends[body]) if tree.names[j] in _HEADINGS), None)
    title = tree.first("title")
    for i in (heading, title):
        if i is not None and tree.text(i):
            return parts | {"heading": tree.text(i)}
    for i in range(1, len(tree.names)):
        if tree.text_from[i] < tree.text_to[i] and _speaks_of_title(tree.attributes[i]):
            return parts | {"named": tree.text(i)}
    # Lengths of all texts before each, so that a long stretch is told without being joined.
    before = [0]
    for t in tree.texts:
        before.append(before[-1] + len(t) + 1)
    emphasis: list[str] = []
    child = body + 1
    while child < tree.ends[body] and tree.places[child] < K.TITLE_EARLY_NODES:
        for i in tree.inside(child, _EMPHASIS):
            size = before[tree.text_to[i]] - before[tree.text_from[i]] - 1
            if 0 < size < K.TITLE_EMPHASIS_CHARS:
                emphasis.append(tree.text(i))
        child = tree.ends[child]
    return parts | {"emphasis": emphasis,
                    "lines": _leaf_texts(tree, body, _LINES, K.TITLE_EARLY_LINES),
                    "blocks": _leaf_texts(tree, body, _BLOCKS, K.TITLE_EARLY_BLOCKS)}


_TEXTS = ("heading", "named")
_LISTS = ("emphasis", "lines", "blocks")
_PARTS = T.StructType([*(T.StructField(n, T.StringType()) for n in _TEXTS),
                       *(T.StructField(n, T.ArrayType(T.StringType())) for n in _LISTS)])


@F.arrow_udf(_PARTS)
def _title_parts(pages: pa.Array) -> pa.Array:
    return pa.array([title_parts(p.as_py()) if p.is_valid else None for p in pages], pa.struct(
        [(n, pa.string()) for n in _TEXTS] + [(n, pa.list_(pa.string())) for n in _LISTS]))


def title_sources(page: Column) -> Column:
    """``title_parts`` of every page; null where there is no page."""
    return _title_parts(page)
