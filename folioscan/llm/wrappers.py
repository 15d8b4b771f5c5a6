"""Main text of pages by wrapper induction: pages of one host are aligned, what is constant is template.

A page becomes a tree of elements in which neighbouring siblings of one kind are folded into a repeated node. Two trees are
aligned by simple tree matching: roots of one kind match, and the best order-preserving match of their children is found
by dynamic programming over subtree scores. Aligning all pages of a host gives its wrapper, a tree of slots. Wrappers align
and merge like pages do; tasks merge their own pages first, and a host's partial wrappers are merged one after the other.
Then every page is aligned with the whole wrapper, and Spark counts exactly on how many pages a node holds a text; a node is
a slot, and also a path of kinds, since equal elements may align in more than one way. A text on at least six tenths of the
pages that hold text at its node is template. Pages whose texts are all the same are copies and count as one.

Extraction leaves out template texts and what is never article: scripts, styles, forms, and elements whose names say that they
are adverts or comments, which vary from page to page as articles do, so that counts cannot tell them apart. Other names and
tags (navigation, aside, footer, sidebar, share and the like) are a prior: such a part is left out unless its text varies and
outweighs the rest of the page on six tenths of the host's pages that have it. What a host does not tell, the page does, for
parts named by a class only. A name is the last word of a class or id but for words of form (``site-footer-inner``); remarks
such as ``no-sidebar`` or ``has-banner`` name nothing. The varying slots are the content, in page order, one line a block. An article or main element is a hint: where it holds varying text, a part of the page outside it is content only if
it holds more text than the hint on six tenths of the host's pages that have the part. It is none if it holds less on as
many; if the host tells neither, the page itself decides in the same way.

Defined cases: null and empty html give an empty text; a null or odd url belongs to the host "" and is kept as it is; nodes
that fewer than five different pages hold have no template; a page of template alone has an empty text; cut-off pages are read as far as they go; what is nested deeper than 200 elements is read as if it stood there without further tags; repeated rows and null ids stay rows of their own; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import html as markup
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section "
                  "summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset(("html", "body", "caption", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li"))
# Which open element a start tag ends, and where to stop looking for it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
NEVER = frozenset("script style noscript template head form button select textarea iframe object svg canvas audio video "
                  "dialog input title".split())
LIKELY = frozenset("nav aside footer menu".split())
NEVER_NAMES = re.compile(r"ads?|advert\w*|comments?|consent|cookies?|disqus|newsletter|popup|sponsor\w*|subscribe").fullmatch
LIKELY_NAMES = re.compile(r"banner|breadcrumbs?|footer|menu|nav|navbar|navigation|notices?|pagination|promo\w*|related|share|"
                          r"sharing|sidebar|social").fullmatch
# Words after a name that leave it what it is, and words before a name that only remark on it.
FORMS = frozenset("area aside author bar bars block body bottom box button buttons col column container content cell form frame "
                  "group holder icon icons image inner item items label left link links list main media meta nav news outer "
                  "panel policy post posts reply respond right row section side signup slot space stories text this thread "
                  "title top unit widget widgets wrap wrapper zone".split())
REMARKS = frozenset("no not non has have with without is hide show under above".split())
NEVER_ROLES = frozenset("search alert dialog form menu menubar".split())
LIKELY_ROLES = frozenset("navigation banner contentinfo complementary".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""").finditer
_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")

DEEPEST = 200
KEEP_TEXTS = 64
LEAST_PAGES, SHARE = 5, 0.6
# Children of nodes up to this width are matched in the best order, those of wider ones within a band of it.
WIDE = 64
MERGES = 32
# Elements that are a part of the page by themselves; other neighbours of a marked element go together.
PARTS = frozenset("address center details div fieldset section table tbody td tr".split())


@dataclass
class Node:
    tag: str
    names: str = ""
    role: str = ""
    hidden: bool = False
    children: list["Node | str"] = field(default_factory=list)

    @property
    def kind(self) -> str:
        return f"{self.tag}.{self.names.split()[0]}" if self.names else self.tag


def parse(html: str) -> Node:
    """The element tree; text nodes are decoded strings. Linear in the page, whatever it holds."""
    root = Node("#")
    stack, at, n = [root], 0, len(html)

    def text(a: int, b: int) -> None:
        if b > a:
            piece = html[a:b]
            stack[-1].children.append(markup.unescape(piece) if "&" in piece else piece)

    def pop_to(tags: set[str], stop: set[str] | frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(at, n)
            break
        follow = html[lt + 1: lt + 2]
        if follow == "!" or follow == "?":
            text(at, lt)
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = follow == "/"
        name = _NAME.match(html, lt + 1 + closing)
        if not name:
            # A lone sign is text.
            text(at, lt + 1)
            at = lt + 1
            continue
        text(at, lt)
        end = _TAG_END.match(html, name.end())
        if not end:
            # An open quote does not swallow the page, a cut-off tag does.
            plain = html.find(">", name.end())
            if plain < 0:
                break
            stop = plain + 1
        else:
            stop = end.end()
        tag, inside, at = name[0].lower(), html[name.end(): stop - 1], stop
        if closing:
            pop_to({tag}, frozenset())
            continue
        if tag in ENDS_P:
            pop_to({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if tag in CLOSES:
            pop_to(*CLOSES[tag])
        node = Node(tag)
        if inside.strip(" \t\r\n/"):
            attributes = {}
            for a in _ATTRIBUTE(inside):
                attributes.setdefault(a[1].lower(), (a[2] or "").strip("\"'"))
            node.names = " ".join(attributes.get(k, "") for k in ("class", "id")).strip()
            node.role = attributes.get("role", "").lower()
            node.hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true"
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            stop = close.start() if close else n
            if tag in ("title", "textarea"):
                node.children.append(markup.unescape(html[at:stop]))
            at = stop
            if close:
                gt = html.find(">", stop)
                at = n if gt < 0 else gt + 1
            continue
        if len(stack) < DEEPEST:
            stack.append(node)
    return root


KEPT, DROPPED, BY_TAG, BY_NAME = range(4)


@lru_cache(100_000)
def named(names: str) -> int:
    """What classes and ids say: the last word of each that is no word of form."""
    found = KEPT
    for token in names.lower().split():
        words = [w for w in re.split(r"[_-]+", token) if w]
        if not words or words[0] in REMARKS:
            continue
        while len(words) > 1 and (words[-1] in FORMS or words[-1][0].isdigit()):
            words.pop()
        if NEVER_NAMES(words[-1]):
            return DROPPED
        if LIKELY_NAMES(words[-1]) or words[0] in ("widget", "widgets"):
            found = BY_NAME
    return found


def prior(node: Node, inside: bool) -> int:
    """Whether a part is article before the host is asked: kept, never, or unlikely by its tag or by its name."""
    if node.tag in NEVER or node.hidden or node.role in NEVER_ROLES:
        return DROPPED
    by_name = named(node.names) if node.names and node.tag not in ("body", "html", "article", "main") else KEPT
    if by_name == DROPPED:
        return DROPPED
    if node.tag in LIKELY or node.role in LIKELY_ROLES or (node.tag == "header" and not inside and not titles(node)):
        return BY_TAG
    return by_name


def titles(header: Node) -> bool:
    """A header that holds a heading, and nothing to go on to or to fill in, is the head of its text."""
    heading, stack = False, [header]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, Node):
                if c.tag in ("nav", "form", "ul", "ol", "menu", "input") or c.role in LIKELY_ROLES:
                    return False
                heading = heading or c.tag in ("h1", "h2")
                stack.append(c)
    return heading


@dataclass
class Slot:
    """A node of a wrapper: how many pages hold it, and texts that recur there."""

    kind: str
    pages: int = 1
    texts: dict[int, int] = field(default_factory=dict)
    children: list["Slot"] = field(default_factory=list)
    number: int = 0


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(text.split())) >> 1


def add_texts(into: dict[int, int], more: dict[int, int]) -> None:
    """Merge Misra-Gries summaries."""
    for k, n in more.items():
        into[k] = into.get(k, 0) + n
    if len(into) > KEEP_TEXTS:
        cut = sorted(into.values(), reverse=True)[KEEP_TEXTS]
        for k in list(into):
            into[k] -= cut
            if into[k] <= 0:
                del into[k]


def slot(node: Node, texts: bool = True) -> Slot:
    """A page's wrapper: runs of one kind of children are folded. Alignment needs no texts."""
    out = Slot(node.kind)
    own = [c for c in node.children if isinstance(c, str) and not c.isspace()] if texts else []
    if own:
        out.texts = {text_hash(" ".join(own)): 1}
    for child in node.children:
        if isinstance(child, str) or child.tag in ("script", "style"):
            continue
        made = slot(child, texts)
        if out.children and out.children[-1].kind == made.kind:
            fold(out.children[-1], made)
        else:
            out.children.append(made)
    return out


def shape(s: Slot) -> tuple:
    return s.kind, *map(shape, s.children)


def fold(one: Slot, two: Slot) -> None:
    """Siblings of one kind on one page: the page counts once."""
    pages = one.pages
    if not two.children and not two.texts:
        return
    merge(one, two)
    for s in walk(one):
        s.pages = min(s.pages, pages)
        s.texts = {k: min(n, pages) for k, n in s.texts.items()}


def walk(s: Slot) -> Iterator[Slot]:
    yield s
    for c in s.children:
        yield from walk(c)


def match(one: Slot, two: Slot) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: matched nodes at most, and the children matched at the top."""
    if one.kind != two.kind:
        return 0, []
    a, b = one.children, two.children
    if not a or not b:
        return 1, []
    if len(a) * len(b) > WIDE * WIDE:
        pairs = beside(a, b)
        return 1 + sum(match(a[i], b[j])[0] for i, j in pairs), pairs
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    score = [[0] * len(b) for _ in a]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            score[i][j] = match(x, y)[0] if x.kind == y.kind else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + score[i][j])
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if score[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + score[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1] + 1, pairs[::-1]


def beside(a: list[Slot], b: list[Slot]) -> list[tuple[int, int]]:
    """Match the children of wide nodes in a time that follows their number: equal ends, then the next of a kind in a band."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i].kind != b[i].kind), n)
    tail = next((i for i in range(n - head) if a[-1 - i].kind != b[-1 - i].kind), n - head)
    pairs, j, last = [(i, i) for i in range(head)], head, len(b) - tail
    for i in range(head, len(a) - tail):
        k = next((k for k in range(j, min(j + WIDE, last)) if b[k].kind == a[i].kind), None)
        if k is not None:
            pairs.append((i, k))
            j = k + 1
    return pairs + [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]


def merge(one: Slot, two: Slot) -> None:
    """Align ``two`` with ``one`` and add it; children without a partner keep their place between those with one."""
    one.pages += two.pages
    add_texts(one.texts, two.texts)
    _, pairs = match(one, two)
    for i, j in pairs:
        merge(one.children[i], two.children[j])
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(one.children), len(two.children))]:
        out += one.children[i:x] + two.children[j:y]
        if x < len(one.children):
            out.append(one.children[x])
        i, j = x + 1, y + 1
    one.children = out


def dump(s: Slot) -> list:
    return [s.kind, s.pages, [[k, n] for k, n in s.texts.items()], [dump(c) for c in s.children]]


def load(data: list) -> Slot:
    return Slot(data[0], data[1], dict(map(tuple, data[2])), [load(c) for c in data[3]])


def pack(s: Slot) -> bytes:
    return zlib.compress(json.dumps(dump(s), separators=(",", ":")).encode())


def unpack(data: bytes) -> Slot:
    return load(json.loads(zlib.decompress(data)))


def key(path: str, text: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}|{text}") >> 1


def template(s: Slot) -> list[int]:
    """Keys of the texts that are constant."""
    if s.pages < LEAST_PAGES:
        return []
    found, pages = [], s.pages

    def visit(node: Slot, path: str) -> None:
        path = f"{path}/{node.kind}"
        found.extend(key(path, t) for t, n in node.texts.items() if n >= SHARE * pages)
        for c in node.children:
            visit(c, path)

    visit(s, "")
    return sorted(set(found))


def content(root: Node) -> list[Node]:
    """The outermost article or main elements, whether they hold text or not."""
    found: list[Node] = []

    def visit(node: Node, inside: bool) -> None:
        for c in node.children:
            if isinstance(c, str):
                continue
            if c.tag in ("article", "main") and not c.hidden:
                found.append(c)
            elif prior(c, inside) == KEPT:
                visit(c, inside)

    visit(root, False)
    return found


def number(s: Slot) -> Slot:
    """Give the slots of a whole wrapper their numbers."""
    for i, one in enumerate(walk(s)):
        one.number = i
    return s


def place(wrapper: Slot, root: Node) -> dict[int, int]:
    """Align a page with its host's wrapper: the number of each element's slot."""
    found: dict[int, int] = {}

    def visit(w: Slot, node: Node) -> None:
        found[id(node)] = w.number
        runs: list[list[Node]] = []
        for c in node.children:
            if isinstance(c, str) or c.tag in ("script", "style"):
                continue
            if runs and runs[-1][0].kind == c.kind:
                runs[-1].append(c)
            else:
                runs.append([c])
        if not runs:
            return
        if [r[0].kind for r in runs] == [c.kind for c in w.children]:
            pairs = [(i, i) for i in range(len(runs))]
        else:
            pairs = match(w, slot(node, False))[1]
        for i, j in pairs:
            for c in runs[j]:
                visit(w.children[i], c)

    visit(wrapper, root)
    return found


@dataclass
class Block:
    """A line of a page: the nodes and hashes of its texts, whether a mark holds it, and else the part it belongs to.

    ``unlikely`` is the prior of the part, ``number`` tells such parts of a page apart; ``linked`` characters are in links.
    """

    line: str
    texts: list[tuple[tuple[str, ...], int]]
    marked: bool
    part: str
    unlikely: int = KEPT
    number: int = 0
    linked: int = 0


def read(html: str, wrapper: Slot | None = None) -> list[Block]:
    """All lines of a page that may be article. A node is known by its path of kinds and by its slot."""
    root = parse(html)
    slots = place(wrapper, root) if wrapper else {}
    marks = {id(n) for n in content(root)}
    around: set[int] = set()

    def holds(node: Node) -> bool:
        found = [id(c) in marks or holds(c) for c in node.children if not isinstance(c, str)]
        if any(found):
            around.add(id(node))
        return any(found)

    if marks:
        holds(root)
    blocks: list[Block] = []
    held: list[str] = []
    texts: list[tuple[tuple[str, ...], int]] = []

    def close(inside: bool, part: str) -> None:
        nonlocal linked
        line = " ".join("".join(held).split())
        if line:
            blocks.append(Block(line, [] if apart else texts.copy(), inside, part, apart, number, min(linked, len(line))))
        linked = 0
        held.clear()
        texts.clear()

    def unlikely(c: Node, path: str, kind: int) -> None:
        """The lines of a part that is left out unless the host overrules; what stands around an inline one is one line."""
        nonlocal held, texts, apart, number, linked
        before = held, texts, linked
        held, texts, apart, linked = [], [], kind, 0
        number += 1
        part = f"{path}/{c.kind} unlikely"
        above.append((False, part))
        visit(c, path, False, part)
        close(False, part)
        above.pop()
        apart = KEPT
        held, texts, linked = before

    def visit(node: Node, path: str, inside: bool, part: str) -> None:
        nonlocal linked
        path = f"{path}/{node.kind}"
        names = (path, f"#{slots[id(node)]}") if id(node) in slots else (path,)
        inside = inside or (not apart and id(node) in marks)
        if apart:
            pass
        elif id(node) in around:
            part = names[-1] + " flow"
        elif part.endswith(" flow") and node.tag in PARTS:
            part = names[-1]
        own = [c for c in node.children if isinstance(c, str) and not c.isspace()]
        mark = (names, text_hash(" ".join(own))) if own and not apart else None
        block = node.tag in BLOCK
        if block:
            close(*above[-1])
        above.append((inside, part))
        before = len(held)
        for c in node.children:
            if isinstance(c, str):
                held.append(c)
                if mark and not c.isspace() and (not texts or texts[-1] is not mark):
                    texts.append(mark)
                continue
            if c.tag == "br" or c.tag == "hr":
                held.append(" ")
                continue
            kind = prior(c, bool(marks) and inside)
            if kind == KEPT or (apart and kind != DROPPED):
                visit(c, path, inside, part)
                continue
            if c.tag in BLOCK:
                close(inside, part)
            if kind != DROPPED:
                unlikely(c, path, kind)
        if node.tag == "a":
            linked += sum(map(len, held[before:]))
        above.pop()
        if block:
            close(inside, part)

    apart, number, linked = KEPT, 0, 0
    above = [(False, " flow")]
    visit(root, "", False, " flow")
    close(False, " flow")
    return blocks


NODE, WON, LOST, PART = -1, -2, -3, -4


def evidence(blocks: list[Block]) -> set[tuple[int, int]]:
    """What a page says about its host: (node, key) for every text at its nodes, (node, node) for the nodes themselves.

    A part outside the marked elements counts as won or lost by whether it holds more text than they do.
    """
    found = set()
    whole = sum(len(b.line) for b in blocks)
    for part, (_, size, _, text) in unlikely_parts(blocks).items():
        node = key(part[0], PART)
        found |= {(node, node), (node, key(part[0], WON if 2 * size > whole else LOST)),
                  (node, key(part[0], text))}
    blocks = [b for b in blocks if not b.unlikely]
    for b in blocks:
        for names, text in b.texts:
            for name in names:
                node = key(name, NODE)
                found.add((node, node))
                found.add((node, key(name, text)))
    marked = sum(len(b.line) for b in blocks if b.marked)
    if marked:
        sizes: dict[str, int] = {}
        for b in blocks:
            if not b.marked:
                sizes[b.part] = sizes.get(b.part, 0) + len(b.line)
        for part, n in sizes.items():
            node = key(part, PART)
            found.add((node, node))
            found.add((node, key(part, WON if n > marked else LOST)))
    return found


def unlikely_parts(blocks: list[Block]) -> dict[tuple[str, int], tuple[int, int, int, int]]:
    """Prior, size, characters in links and hash of the text of each part that the prior leaves out."""
    lines: dict[tuple[str, int], list[Block]] = {}
    for b in blocks:
        if b.unlikely:
            lines.setdefault((b.part, b.number), []).append(b)
    return {part: (some[0].unlikely, sum(len(b.line) for b in some), sum(b.linked for b in some),
                   text_hash("\n".join(b.line for b in some))) for part, some in lines.items()}


def overruled(blocks: list[Block], constant: frozenset[int] | set[int]) -> set[tuple[str, int]]:
    """Parts that are article against their prior."""
    whole, found = sum(len(b.line) for b in blocks), set()
    for part, (kind, size, linked, text) in unlikely_parts(blocks).items():
        if key(part[0], text) in constant:
            continue
        own = kind == BY_NAME and 2 * size > whole and 2 * linked < size and key(part[0], LOST) not in constant
        if own or (key(part[0], WON) in constant and 2 * linked < size):
            found.add(part)
    return found


def extract(html: str, constant: frozenset[int] | set[int], wrapper: Slot | None = None) -> str:
    """The page's main text: its varying blocks.

    Where marked elements hold some of them, another part counts only if it outweighs the mark on most pages of the host; what
    the host does not tell, the page does.
    """
    blocks = read(html, wrapper)
    given = overruled(blocks, constant)
    left = [b for b in blocks if ((b.part, b.number) in given if b.unlikely else not constant or not all(
        any(key(name, text) in constant for name in names) for names, text in b.texts))]
    marked = sum(len(b.line) for b in left if b.marked)
    if marked:
        sizes: dict[str, int] = {}
        for b in left:
            if not b.marked and not b.unlikely:
                sizes[b.part] = sizes.get(b.part, 0) + len(b.line)
        good = {p for p, n in sizes.items()
                if key(p, WON) in constant or (n > marked and key(p, LOST) not in constant)}
        left = [b for b in left if b.marked or b.unlikely or b.part in good]
    return "\n".join(b.line for b in left)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame, most_hosts: int = 2_000) -> DataFrame:
    """host, its wrapper and the keys of what is constant there. ``pages``: host, html."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Slot] = {}
        seen: set[tuple[str, bytes]] = set()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([
                pa.array(list(held), pa.string()), pa.array([pack(s) for s in held.values()], pa.binary())], ["host", "wrapper"])
            held.clear()
            seen.clear()
            return out

        for batch in batches:
            for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                made = slot(parse(html or ""), False)
                # A page built like one before it adds no slot.
                built = (name, xxhash.xxh3_128_digest(repr(shape(made))))
                if built in seen:
                    continue
                if len(seen) < 100_000:
                    seen.add(built)
                if name in held:
                    merge(held[name], made)
                else:
                    held[name] = made
                if len(held) >= most_hosts:
                    yield rows()
        if held:
            yield rows()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def rows() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([pack(held)], pa.binary())], ["host", "wrapper"])

        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns)):
                if name != at:
                    yield from rows()
                    at, held = name, unpack(data)
                else:
                    merge(held, unpack(data))
        yield from rows()

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            for part in text_slices(batch, "html", 4 << 20):
                out: list[tuple[int, int, int, int]] = []
                for site, html, data in zip(*(part.column(c).to_pylist() for c in ("site", "html", "wrapper"))):
                    blocks = read(html or "", known(data))
                    payload = xxhash.xxh3_64_intdigest("\n".join(
                        b.line for b in blocks if not b.unlikely) or "\n".join(b.line for b in blocks)) >> 1
                    out += [(site, node, k, payload) for node, k in evidence(blocks)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * 4)], ["site", "node", "key", "payload"])

    parts = pages.select("host", "html").mapInArrow(partial, "host string, wrapper binary")
    site = F.xxhash64("host").alias("site")
    # Partial wrappers of a host merge in many tasks first, so the last one merges few, whatever the number of tasks.
    deal = F.pmod(F.xxhash64("wrapper"), F.lit(MERGES)).cast("int")
    some = parts.repartition("host", deal).sortWithinPartitions("host", "wrapper").mapInArrow(
        whole, "host string, wrapper binary")
    built = stored(some.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(
        whole, "host string, wrapper binary"), "wrappers")
    # Pages that say the same are one. Rows are dealt by all columns first, so no host or node gathers in one task.
    rows = pages.join(built, "host").select(site, "html", "wrapper").mapInArrow(
        said, "site long, node long, key long, payload long").distinct()
    counts = stored(rows.groupBy("site", "node", "key").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= SHARE * LEAST_PAGES), "counts")
    nodes = counts.filter((F.col("key") == F.col("node")) & (F.col("n") >= LEAST_PAGES)).select(
        "site", "node", F.col("n").alias("pages"))
    keys = counts.filter(F.col("key") != F.col("node")).join(nodes, ["site", "node"]).filter(
        F.col("n") >= SHARE * F.col("pages")).groupBy("site").agg(F.collect_set("key").alias("keys"))
    return stored(built.withColumn("site", F.xxhash64("host")).join(keys, "site", "left").select("host", "wrapper", "keys"),
                  "templates")


class Known:
    """Wrappers read from their bytes, the last few hundred kept."""

    def __init__(self) -> None:
        self.held: dict[bytes, Slot] = {}

    def __call__(self, data: bytes | None) -> Slot | None:
        if data is None:
            return None
        if data not in self.held:
            if len(self.held) >= 200:
                self.held.clear()
            self.held[data] = number(unpack(data))
        return self.held[data]


def main_text(table: DataFrame, key_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and text of every page."""
    pages = table.select(F.col(key_column).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"),
                         host(F.col(url)).alias("host"))
    # Template keys are few; where their table is small it is broadcast by its measured size, else hosts are dealt out.
    found = pages.join(wrappers(pages), "host", "left").select("page_id", "url", "html", "wrapper", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            for part in text_slices(batch, "html", 4 << 20):
                texts = [extract(h, frozenset(k or ()), known(w)) if h else "" for h, k, w in zip(
                    *(part.column(c).to_pylist() for c in ("html", "keys", "wrapper")))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return found.mapInArrow(run, kinds + ", text string")
