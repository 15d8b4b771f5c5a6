"""Column expressions over chapter HTML: visible text, links, titles, page kinds.

Tags and character references ("&eacute;", "&#8212;") are handled by expressions inside the JVM.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K
from .text import let, squeeze, strip, word_count
from .tree import title_sources

# What is left open hides the rest of the page.
HIDDEN = (r"(?is)<!--.*?(?:-->|\z)|<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|\z)"
          r"|<[!?][^>]*>")
# A letter follows the sign, and quoted values may hold ">". Anything else is text.
TAG = r"""</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
GAP = "<x>"


def _table(entries: dict) -> Column:
    """A lookup table as one constant."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _misused_codes() -> dict[str, str]:
    """Numbers that stand for another character: null, and the Windows-1252 block."""
    table = {"0": "\ufffd", "13": "\r"}
    for code in range(0x80, 0xA0):
        try:
            table[str(code)] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            table[str(code)] = chr(code)
    return table


def _numbered(name: Column) -> Column:
    """Text of a numeric reference (``#65;`` or ``#x41;``) and whatever follows its digits."""
    form = r"^#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?"
    hexadecimal, decimal = (F.regexp_extract(name, form, i) for i in (1, 2))
    code = F.when(hexadecimal != "", F.conv(F.right(hexadecimal, F.lit(8)), 16, 10)).otherwise(
        F.right(decimal, F.lit(18))).try_cast("bigint")
    huge = (F.length(F.ltrim(hexadecimal, F.lit("0"))) > 8) | (
        F.length(F.ltrim(decimal, F.lit("0"))) > 18) | (code > 0x10FFFF)
    no_text = (code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
               | code.between(0xFDD0, 0xFDEF) | ((code % 0x10000) >= 0xFFFE))
    char = (F.when(huge | code.between(0xD800, 0xDFFF), "\ufffd")
            .when(F.map_contains_key(_table(_misused_codes()), code.cast("string")),
                  F.try_element_at(_table(_misused_codes()), code.cast("string")))
            .when(no_text, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
    return F.concat(char, F.regexp_replace(name, form, ""))


def _named(name: Column) -> Column:
    """Text of a named reference; an unknown name may still begin with a known short one."""
    known = _table(html5)
    sizes = F.sequence(F.length(name), F.lit(1), F.lit(-1))
    hits = F.filter(sizes, lambda k: F.map_contains_key(known, F.left(name, k)))
    longest = F.try_element_at(hits, F.lit(1))
    return F.concat(F.try_element_at(known, F.left(name, longest)),
                    F.substring(name, longest + 1, F.length(name)))


def decode_references(c: Column) -> Column:
    """Replace HTML character references by the characters they stand for."""
    def decoded(token: Column) -> Column:
        name = F.substring(token, F.lit(2), F.length(token))
        value = F.coalesce(F.when(name.rlike(r"^#[xX]?[0-9a-fA-F]"), _numbered(name)),
                           F.when(~name.startswith("#"), _named(name)), token)
        # Longest first, and those that yield "&" last, so no replacement feeds another one.
        return let(value, lambda v: F.struct(
            v.contains("&").alias("late"), (-F.length(token)).alias("size"),
            token.alias("token"), v.alias("value")))

    def replaced(text: Column) -> Column:
        tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&[#\w]+;?"), F.lit(0)))
        table = F.filter(F.transform(tokens, decoded), lambda e: e["token"] != e["value"])
        return F.aggregate(F.array_sort(table), text,
                           lambda t, e: F.replace(t, e["token"], e["value"]))

    return let(c, lambda text: F.when(text.contains("&"), replaced(text)).otherwise(text))


def _nodes(c: Column) -> Column:
    """Trimmed, non-empty text nodes in document order."""
    return F.filter(F.transform(F.split(c, TAG), strip), lambda t: F.length(t) > 0)


def visible_text(c: Column) -> Column:
    """All visible text nodes joined by single spaces."""
    return F.array_join(_nodes(decode_markup(F.regexp_replace(c, HIDDEN, GAP))), " ")


def decode_markup(c: Column) -> Column:
    """Decode references but keep a decoded "<" or ">" from looking like a tag."""
    guarded = F.translate(c, "\u0001\u0002", "")
    guarded = F.regexp_replace(guarded, r"&(?:lt|LT|#60|#x3[cC]);?", "\u0001")
    guarded = F.regexp_replace(guarded, r"&(?:gt|GT|#62|#x3[eE]);?", "\u0002")
    return decode_references(guarded)


def unguard(c: Column) -> Column:
    return F.translate(c, "\u0001\u0002", "<>")


def page_text(c: Column) -> Column:
    """Visible text with every character reference decoded."""
    return unguard(visible_text(c))


def without_scripts(c: Column) -> Column:
    """Second extraction rung: the body without scripts and styles, other text as it stands."""
    return strip(tagless(body_of(c)))


def tagless(c: Column) -> Column:
    """Text nodes run together, references decoded."""
    bare = F.regexp_replace(c, HIDDEN, "")
    return decode_references(F.regexp_replace(bare, TAG, ""))


def without_tags(c: Column) -> Column:
    """Last extraction rung: every tag of the body becomes a space, white space squeezed."""
    return squeeze(F.regexp_replace(body_of(c), "<[^>]+>", " "))


def body_of(c: Column) -> Column:
    """Inner HTML of the body, or the whole text when there is no body tag."""
    inner = F.regexp_extract(c, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    return F.when(c.rlike(r"(?i)<body\b"), inner).otherwise(c)


def body_element(c: Column) -> Column:
    """The body element itself with its tags; the whole text when there is none."""
    whole = F.regexp_extract(c, r"(?is)(<body\b[^>]*>.*?(?:</body\s*>|\z))", 1)
    return F.when(c.rlike(r"(?i)<body\b"), whole).otherwise(c)


# --- links and page kinds -------------------------------------------------------------------

ANY_HREF = r"""(?i)<a\b[^>]*\bhref\s*=\s*(?:"[^"]+"|'[^']+')"""
INSIDE_HREF = r"""(?i)<a\b[^>]*\bhref\s*=\s*(?:"[^"]*#[^"]*"|'[^']*#[^']*')"""


def link_stats(c: Column) -> dict[str, Column]:
    """Counts of links, list items, links inside the document and to other documents."""
    hrefs = F.regexp_count(c, F.lit(ANY_HREF))
    inside = F.regexp_count(c, F.lit(INSIDE_HREF))
    return {
        "links": F.regexp_count(c, F.lit(r"(?i)<a\b")).cast("bigint"),
        "list_items": F.regexp_count(c, F.lit(r"(?i)<(?:li|dt|dd)\b")).cast("bigint"),
        "inside_links": inside.cast("bigint"),
        "outside_links": (hrefs - inside).cast("bigint"),
    }


def count_present(c: Column, needles: tuple[str, ...]) -> Column:
    """How many of ``needles`` occur in the text."""
    return sum((F.contains(c, F.lit(n)).cast("bigint") for n in needles), F.lit(0).cast("bigint"))


def _epub_type(c: Column, tag: str) -> Column:
    attr = rf"""(?is)\A.*?<{tag}\b[^>]*?\bepub:type\s*=\s*["']([^"']*)["']"""
    first_tag = F.regexp_extract(c, rf"(?is)(<{tag}\b[^>]*>)", 1)
    return F.lower(F.regexp_extract(first_tag, attr, 1))


def declared_kind(c: Column) -> Column:
    """True for a declared table of contents, false for declared content, null when undeclared."""
    known = K.TOC_TYPES + K.CONTENT_TYPES

    def first_known(value: Column) -> Column:
        hit = F.filter(F.split(value, f"[{K.WS}]+"), lambda t: t.isin(*known))
        return F.when(F.size(hit) > 0, F.element_at(hit, 1).isin(*K.TOC_TYPES))

    return F.coalesce(first_known(_epub_type(c, "body")), first_known(_epub_type(c, "section")))


def looks_like_toc(html: Column, lower_text: Column) -> Column:
    """Is the page a list of links to other documents rather than prose?"""
    n = link_stats(html)

    def guess(low: Column) -> Column:
        hints = count_present(low, K.TOC_INDICATORS)
        return (
            F.when((n["links"] == 0) & (n["list_items"] == 0), False)
            .when((n["outside_links"] > 5) & (n["outside_links"] > n["inside_links"]), hints > 1)
            .when((n["inside_links"] > n["outside_links"]) & (F.length(low) > 5000), False)
            .otherwise(((n["links"] > 5) | (n["list_items"] > 5)) & (hints > 1)))

    return F.coalesce(declared_kind(html), let(lower_text, guess))


def looks_like_copyright(lower_text: Column) -> Column:
    return let(lower_text, lambda low: count_present(low, K.COPYRIGHT_INDICATORS) > 2)


def cjk_headings(c: Column) -> Column:
    return F.regexp_count(c, F.lit(K.CJK_CHAPTER)).cast("bigint")


def link_text_length(c: Column) -> Column:
    """Characters of text that sit inside links."""
    labels = F.regexp_extract_all(c, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1))
    sizes = F.transform(labels, lambda a: F.aggregate(
        _nodes(decode_markup(a)), F.lit(0), lambda n, t: n + F.length(t)))
    return F.aggregate(sizes, F.lit(0), lambda n, k: n + k).cast("bigint")


def valid_chapter(html: Column, text: Column) -> Column:
    """Enough prose to be a chapter; ``text`` is the page's visible text."""
    def prose(low: Column) -> Column:
        listing = looks_like_toc(html, low) & (link_text_length(html) >= F.length(text) * 0.6)
        n_words = word_count(low)
        cjk_listing = (n_words > 0) & (
            cjk_headings(low) > F.greatest(F.lit(3), F.floor(n_words / 50)))
        rights_page = (F.length(text) < 300) & looks_like_copyright(low)
        return ~listing & ~cjk_listing & ~rights_page

    return (
        F.when(F.length(strip(html)) < 100, False)
        .when(F.length(text) < 60, False)
        .otherwise(let(F.lower(text), prose)))


def skip_by_name(name: Column) -> Column:
    """Front and back matter, told by its file name."""
    return F.lower(name).rlike("|".join(K.SKIP_NAME_TOKENS))


def toc_name(href: Column) -> Column:
    """Link target as a spine item name: no fragment, no leading dots and slashes, lower case."""
    return F.lower(F.ltrim(F.split_part(href, F.lit("#"), F.lit(1)), F.lit("./")))


# --- titles ---------------------------------------------------------------------------------

def heading_class(c: Column) -> Column:
    """Which heading form a line has, or ``none``."""
    kinds = None
    for name, pattern in K.HEADING_PATTERNS.items():
        case = "i" if name in K.CASELESS_HEADINGS else ""
        hit = c.rlike(rf"(?{case}sU)\A(?:{pattern})")
        kinds = F.when(hit, name) if kinds is None else kinds.when(hit, name)
    return kinds.otherwise("none")


def _first(texts: Column, keep) -> Column:
    return F.get(F.filter(texts, keep), F.lit(0))


def title_strategies(html: Column) -> dict[str, Column]:
    """Title found by each strategy, in order of trust; null where a strategy finds none or a surer one has."""
    parts = title_sources(html)
    return {
        "heading": parts["heading"],
        "attribute": parts["named"],
        "emphasis": _first(parts["emphasis"], lambda t: ~t.endswith(".") & (heading_class(t) != "none")),
        "pattern": _first(parts["lines"], lambda t: heading_class(t) != "none"),
        "short_line": _first(parts["blocks"], lambda t: (
            (F.length(t) < K.TITLE_LINE_CHARS) & ~t.rlike(r"[.!?,;:]\z")
            & (word_count(t) <= K.TITLE_LINE_WORDS))),
    }


def infer_title(html: Column) -> tuple[Column, Column]:
    """(title, strategy): the first strategy that finds something, else ``Unknown``."""
    found = title_strategies(html)
    strategy = None
    for name, col in found.items():
        strategy = F.when(col.isNotNull(), name) if strategy is None \
            else strategy.when(col.isNotNull(), name)
    return F.coalesce(*found.values(), F.lit("Unknown")), strategy.otherwise("none")


def metadata(given: Column, declared: Column, wanted: Column, detected: Column
             ) -> tuple[Column, Column, Column]:
    """(title, language, error) with the usual fallbacks; no language at all is an error."""
    blank = F.lit("")
    language = F.coalesce(F.nullif(wanted, blank), F.nullif(detected, blank))
    error = F.when(language.isNull(), F.lit(K.NO_LANGUAGE))
    return (F.coalesce(F.nullif(given, blank), F.nullif(declared, blank), F.lit("missing title")),
            language, error)
