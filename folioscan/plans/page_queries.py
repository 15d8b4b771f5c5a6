"""From spine items to chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import html as H
from ..functions import text as X
from ..operators import contents as C
from ..operators import extraction as E
from ..sources import tables as V
from ..sources.files import decode_bytes
from . import sql as S
from .registry import query

_PATH = "regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1)"
SPINE = (f"SELECT page_id // 10 AS book_id, page_id AS ordinal, lower({_PATH}) AS item_name, html "
         "FROM pages")
TOC = (f"SELECT page_id // 10 AS book_id, './' || {_PATH} || '#start' AS href FROM pages "
       "WHERE page_id % 3 = 0")
NAMES = ("SELECT DISTINCT book_id, lower(ltrim(split_part(href, '#', 1), './')) AS item_name "
         f"FROM ({TOC}) WHERE length(ltrim(split_part(href, '#', 1), './')) > 0")
SKIPPED = "regexp_matches({}, '" + "|".join(K.SKIP_NAME_TOKENS) + "')"


def _nodes(x: str) -> str:
    return (f"array_to_string(list_filter(list_transform(string_split_regex({x}, '{S.TAG}'), "
            f"lambda n: {S.strip('n')}), lambda n: length(n) > 0), ' ')")


def visible(x: str) -> str:
    return _nodes(S.entities(f"regexp_replace({x}, '{S.HIDDEN}', '<x>', 'g')"))


def inner_body(x: str) -> str:
    found = rf"regexp_extract({x}, '(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)', 1)"
    return rf"CASE WHEN regexp_matches({x}, '(?i)<body\b') THEN {found} ELSE {x} END"


def rung2(x: str) -> str:
    return S.strip(S.tagless(f"({inner_body(x)})"))


def rung3(x: str) -> str:
    return S.squeeze(f"regexp_replace({inner_body(x)}, '<[^>]+>', ' ', 'g')")


def _per_page(name: str, column, sql: str, out: str = "text"):
    @query(name, f"SELECT ordinal, {sql} AS {out} FROM ({SPINE})")
    def run(spark, d):
        return V.spine_items(spark, d).select("ordinal", column(F.col("html")).alias(out))


_per_page("html_visible_text", H.page_text, visible("html"))
_per_page("html_strip_scripts", H.without_scripts, rung2("html"))
_per_page("html_strip_tags", H.without_tags, rung3("html"))


@query("extract_ladder", f"""
    WITH r AS (SELECT ordinal, {visible('html')} AS r1, {rung2('html')} AS r2,
                 {rung3('html')} AS r3 FROM ({SPINE})),
    q AS (SELECT *, {S.reason('r1')} AS q1, {S.reason('r2')} AS q2 FROM r)
    SELECT ordinal, CASE WHEN q1 = 'clean' THEN 1 WHEN q2 = 'clean' THEN 2 ELSE 3 END AS rung,
      CASE WHEN q1 = 'clean' THEN r1 WHEN q2 = 'clean' THEN r2 ELSE r3 END AS text FROM q""")
def extract_ladder(spark, d):
    return E.extract_ladder(V.spine_items(spark, d)).select("ordinal", "rung", "text")


_LINK = r"(?is)<a\b[^>]*\bhref\s*=\s*\"([^\"]*)\""


@query("skip_front_matter", f"""
    WITH l AS (SELECT ordinal, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS name
               FROM ({SPINE}))
    SELECT ordinal, name, {SKIPPED.format('lower(name)')} AS skipped FROM l""")
def skip_front_matter(spark, d):
    links = F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))
    return V.spine_items(spark, d).select("ordinal", F.explode(links).alias("name")).withColumn(
        "skipped", H.skip_by_name(F.col("name")))


# Every fifth page declares itself a table of contents, every other fifth a chapter.
_DECLARED = ("CASE ordinal % 5 WHEN 0 THEN replace(html, '<body', '<body epub:type=\"x toc\"') "
             "WHEN 1 THEN replace(html, '<body', '<body epub:type=\"bodymatter\"') "
             "ELSE html END")


def _declared(page):
    """Every fifth page declares itself a list of links, every fifth a chapter."""
    kind = F.col("ordinal") % 5
    return F.when(kind == 0, F.replace(page, F.lit("<body"), F.lit('<body epub:type="x toc"'))).when(
        kind == 1, F.replace(page, F.lit("<body"), F.lit('<body epub:type="bodymatter"'))).otherwise(page)


def _count(pattern: str, x: str = "html") -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


_HINTS = " + ".join(f"CAST(contains(low, '{t}') AS INT)" for t in K.TOC_INDICATORS)
_RIGHTS = " + ".join(f"CAST(contains(low, '{t}') AS INT)" for t in K.COPYRIGHT_INDICATORS)
_STATS = rf"""
    v AS (SELECT book_id, ordinal, item_name, html, visible, lower(visible) AS low FROM (
        SELECT *, {visible('html')} AS visible FROM items)),
    n AS (SELECT *, {_count('(?i)<a' + chr(92) + 'b')} AS links,
        {_count('(?i)<(?:li|dt|dd)' + chr(92) + 'b')} AS lis,
        {_count(r'(?i)<a\b[^>]*\bhref\s*=\s*"[^"]+"')} AS hrefs,
        {_count(r'(?i)<a\b[^>]*\bhref\s*=\s*"[^"]*#[^"]*"')} AS inside,
        {_HINTS} AS hints, {_RIGHTS} AS rights,
        regexp_extract(html, '(?is)<body\b[^>]*epub:type="([^"]*)"', 1) AS kind,
        {_count('第[一二三四五六七八九十' + chr(92) + 'd]+章', 'low')} AS cjk,
        list_sum(list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*>(.*?)</a\s*>', 1),
          lambda a: length(replace({_nodes(S.entities('a'))}, '  ', ' ')))) AS link_text FROM v),
    t AS (SELECT *, CASE WHEN kind = 'x toc' THEN true WHEN kind = 'bodymatter' THEN false
        WHEN links = 0 AND lis = 0 THEN false
        WHEN hrefs - inside > 5 AND hrefs - inside > inside THEN hints > 1
        WHEN inside > hrefs - inside AND length(low) > 5000 THEN false
        ELSE (links > 5 OR lis > 5) AND hints > 1 END AS is_toc FROM n)"""


@query("looks_like_toc", f"""
    WITH items AS (SELECT book_id, ordinal, item_name, {_DECLARED} AS html FROM ({SPINE})), {_STATS}
    SELECT ordinal, is_toc, CAST(links AS BIGINT) AS links, CAST(lis AS BIGINT) AS list_items,
      CAST(inside AS BIGINT) AS inside_links, CAST(hrefs - inside AS BIGINT) AS outside_links
    FROM t""")
def looks_like_toc(spark, d):
    pages = E.with_visible(V.spine_items(spark, d).withColumn("html", _declared(F.col("html"))))
    stats = H.link_stats(F.col("html"))
    return pages.select(
        "ordinal", H.looks_like_toc(F.col("html"), F.lower("visible")).alias("is_toc"),
        *[c.alias(n) for n, c in stats.items()])


# Notices a rights page carries, added to every fourth page's text.
_NOTICE = "Copyright © ISBN 1. All rights reserved."


@query("looks_like_copyright", f"""
    WITH v AS (SELECT ordinal, lower({visible('html')} ||
        CASE WHEN ordinal % 4 = 0 THEN ' {_NOTICE}' ELSE '' END) AS low FROM ({SPINE}))
    SELECT ordinal, {_RIGHTS} > 2 AS is_copyright FROM v""")
def looks_like_copyright(spark, d):
    notice = F.when(F.col("ordinal") % 4 == 0, F.lit(f" {_NOTICE}")).otherwise("")
    low = F.lower(F.concat("visible", notice))
    return E.with_visible(V.spine_items(spark, d)).select(
        "ordinal", H.looks_like_copyright(low).alias("is_copyright"))


_VALID = f"""CASE WHEN length({S.strip('html')}) < 100 THEN false
    WHEN length(visible) < 60 THEN false
    ELSE NOT (is_toc AND coalesce(link_text, 0) >= length(visible) * 0.6)
      AND NOT (len({S.words('low')}) > 0 AND cjk > greatest(3, len({S.words('low')}) // 50))
      AND NOT (rights > 2 AND length(visible) < 300) END"""


@query("valid_chapters", f"""
    WITH items AS (SELECT book_id, ordinal, item_name, {_DECLARED} AS html FROM ({SPINE})), {_STATS}
    SELECT ordinal, {_VALID} AS valid FROM t""")
def valid_chapters(spark, d):
    pages = E.with_visible(V.spine_items(spark, d).withColumn("html", _declared(F.col("html"))))
    return pages.select("ordinal", H.valid_chapter(F.col("html"), F.col("visible")).alias("valid"))


@query("filter_with_fallback", f"""
    WITH items AS (SELECT book_id, ordinal, item_name, {_DECLARED} AS html FROM ({SPINE})
                   WHERE NOT {SKIPPED.format('item_name')}), {_STATS},
    f AS (SELECT book_id, ordinal, length({S.strip('html')}) >= 100 AND length(visible) >= 80
        AND NOT is_toc AND cjk <= 2 AND rights <= 2 AS strict, length(visible) >= 20 AS loose
        FROM t),
    g AS (SELECT *, bool_or(strict) OVER (PARTITION BY book_id) AS has_strict FROM f)
    SELECT book_id, ordinal, has_strict FROM g
    WHERE CASE WHEN has_strict THEN strict ELSE loose END""")
def filter_with_fallback(spark, d):
    return E.filter_with_fallback(V.spine_items(spark, d).withColumn("html", _declared(F.col("html")))).select(
        "book_id", "ordinal", "has_strict")


@query("toc_names", NAMES)
def toc_names(spark, d):
    return E.toc_names(V.toc(spark, d))


@query("toc_boundary", f"""
    SELECT s.book_id, s.ordinal, n.item_name IS NOT NULL AS boundary FROM ({SPINE}) s
    LEFT JOIN ({NAMES}) n ON s.book_id = n.book_id AND s.item_name = n.item_name""")
def toc_boundary(spark, d):
    items = V.spine_items(spark, d).select("book_id", "ordinal", "item_name")
    return E.mark_boundaries(items, V.toc(spark, d)).select("book_id", "ordinal", "boundary")


_WALKED = f"""
    e AS (SELECT page_id // 10 AS book_id, page_id AS entry_no, page_id % 10 * 7 % 10 AS place,
        'Part ' || (page_id % 10) AS title, page_id - page_id % 10 + CASE page_id % 10 WHEN 1 THEN 0 WHEN 4 THEN 0
          WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 6 THEN 5 WHEN 8 THEN 5 WHEN 7 THEN 6 END AS parent_no,
        CASE WHEN page_id % 10 NOT IN (0, 6) THEN './' || {_PATH} || '#part' END AS href FROM pages),
    w AS (
      SELECT book_id, entry_no, href, 1::BIGINT AS depth, [place, entry_no] AS key, title AS path
        FROM e WHERE parent_no IS NULL
      UNION ALL SELECT e.book_id, e.entry_no, e.href, w.depth + 1, list_concat(w.key, [e.place, e.entry_no]),
        w.path || ' / ' || e.title FROM e JOIN w ON e.book_id = w.book_id AND e.parent_no = w.entry_no),
    walked AS (SELECT book_id, entry_no, row_number() OVER (PARTITION BY book_id ORDER BY key) AS position, depth, path,
        href FROM w)"""


@query("nested_contents", f"WITH RECURSIVE {_WALKED} SELECT * FROM walked")
def nested_contents(spark, d):
    return C.walk(V.nested_toc(spark, d))


@query("nested_boundary", f"""
    WITH RECURSIVE {_WALKED},
    n AS (SELECT DISTINCT book_id, lower(ltrim(split_part(href, '#', 1), './')) AS item_name FROM walked
          WHERE length(ltrim(split_part(href, '#', 1), './')) > 0)
    SELECT s.book_id, s.ordinal, n.item_name IS NOT NULL AS boundary FROM ({SPINE}) s
    LEFT JOIN n ON s.book_id = n.book_id AND s.item_name = n.item_name""")
def nested_boundary(spark, d):
    items = V.spine_items(spark, d).select("book_id", "ordinal", "item_name")
    return E.mark_boundaries(items, C.walk(V.nested_toc(spark, d))).select("book_id", "ordinal", "boundary")


_GROUPS = f"""
    m AS (SELECT s.*, n.item_name IS NOT NULL AS boundary FROM ({SPINE}) s LEFT JOIN ({NAMES}) n
          ON s.book_id = n.book_id AND s.item_name = n.item_name
          WHERE NOT {SKIPPED.format('s.item_name')}),
    g AS (SELECT *, CAST(sum(CAST(boundary AS INT)) OVER (PARTITION BY book_id ORDER BY ordinal)
          AS BIGINT) AS group_no FROM m)"""
_BODY = r"regexp_extract(html, '(?is)(<body\b[^>]*>.*?(?:</body\s*>|\z))', 1)"
_MERGED = f"""{_GROUPS},
    merged AS (SELECT book_id, group_no, count(*) AS n_items, CASE WHEN count(*) = 1
        THEN any_value(html) ELSE '<html><body>' ||
        array_to_string(list({_BODY} ORDER BY ordinal), chr(10)) || '</body></html>' END AS html
        FROM g GROUP BY book_id, group_no)"""


@query("merge_items", f"""
    WITH {_MERGED} SELECT book_id, group_no, html, n_items
    FROM merged""")
def merge_items(spark, d):
    items = V.spine_items(spark, d)
    return E.merge_items(items, E.group_items(items, V.toc(spark, d)))


@query("toc_grouping", f"""
    WITH {_MERGED},
    items AS (SELECT book_id, group_no AS ordinal, '' AS item_name, html FROM merged), {_STATS},
    c AS (SELECT book_id, count(*) FILTER (WHERE {_VALID}) AS n_chapters FROM t GROUP BY book_id),
    h AS (SELECT book_id, count(*) FILTER (WHERE boundary) AS matches, count(*) AS n_items
          FROM g GROUP BY book_id),
    z AS (SELECT book_id, count(*) AS toc_size FROM ({NAMES}) GROUP BY book_id)
    SELECT book_id, matches, n_items, coalesce(toc_size, 0) AS toc_size,
      coalesce(n_chapters, 0) AS n_chapters,
      CASE WHEN coalesce(toc_size, 0) = 0 THEN 'items'
        WHEN matches < least(3, toc_size) THEN 'items'
        WHEN coalesce(n_chapters, 0) <= 1 AND toc_size > 2 THEN 'items' ELSE 'toc' END AS method
    FROM h LEFT JOIN z USING (book_id) LEFT JOIN c USING (book_id)""")
def toc_grouping(spark, d):
    items, toc = V.spine_items(spark, d), V.toc(spark, d)
    groups = E.group_items(items, toc)
    merged = E.with_visible(E.merge_items(items, groups)).withColumn(
        "valid", H.valid_chapter(F.col("html"), F.col("visible")))
    return E.grouping_outcome(groups, toc, merged)


# Books whose table of contents fits, is missing, or points elsewhere; every sixth book declares all
# its pages lists of links.
_BOOK_TOC = ("CASE book_id % 3 WHEN 0 THEN href WHEN 2 THEN 'elsewhere/' || href END")
_BOOK_PAGES = ("CASE WHEN book_id % 6 = 1 THEN replace(html, '<body', '<body epub:type=\"x toc\"') "
               f"ELSE {_DECLARED} END")
_BOOK_NAMES = NAMES.replace(TOC, f"SELECT book_id, {_BOOK_TOC} AS href FROM ({TOC})")
_BOOK_SPINE = f"SELECT book_id, ordinal, item_name, {_BOOK_PAGES} AS html FROM ({SPINE})"


@query("book_chapters", f"""
    WITH {_MERGED.replace(NAMES, _BOOK_NAMES).replace(SPINE, _BOOK_SPINE)},
    c AS (WITH items AS (SELECT book_id, group_no AS ordinal, '' AS item_name, html FROM merged),
        {_STATS} SELECT book_id, ordinal, html, {_VALID} AS valid FROM t),
    h AS (SELECT book_id, count(*) FILTER (WHERE boundary) AS matches FROM g GROUP BY book_id),
    z AS (SELECT book_id, count(*) AS toc_size FROM ({_BOOK_NAMES}) GROUP BY book_id),
    o AS (SELECT h.book_id, CASE WHEN coalesce(toc_size, 0) = 0 THEN 'items'
        WHEN matches < least(3, toc_size) THEN 'items'
        WHEN (SELECT count(*) FROM c WHERE valid AND c.book_id = h.book_id) <= 1 AND toc_size > 2
          THEN 'items' ELSE 'toc' END AS method FROM h LEFT JOIN z USING (book_id)),
    f AS (WITH items AS (SELECT * FROM ({_BOOK_SPINE}) WHERE NOT {SKIPPED.format('item_name')}),
        {_STATS} SELECT book_id, ordinal, html, length({S.strip('html')}) >= 100
          AND length(visible) >= 80 AND NOT is_toc AND cjk <= 2 AND rights <= 2 AS strict,
          length(visible) >= 20 AS loose FROM t),
    s AS (SELECT *, bool_or(strict) OVER (PARTITION BY book_id) AS has_strict FROM f),
    r AS (SELECT book_id, ordinal, html, method FROM c JOIN o USING (book_id)
            WHERE valid AND method = 'toc'
          UNION ALL SELECT book_id, ordinal, html, method FROM s JOIN o USING (book_id)
            WHERE method = 'items' AND CASE WHEN has_strict THEN strict ELSE loose END),
    k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ordinal) AS number FROM r)
    SELECT book_id, number, number - 1 AS index, method, html, coalesce(
      {_nodes(S.entities("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)"))}, 'Unknown') AS title,
      'heading' AS strategy FROM k""")
def book_chapters(spark, d):
    book = F.col("book_id")
    pages = V.spine_items(spark, d)
    listed = F.replace("html", F.lit("<body"), F.lit('<body epub:type="x toc"'))
    items = pages.withColumn("html", F.when(book % 6 == 1, listed).otherwise(_declared(F.col("html"))))
    # Books whose entries point nowhere have rows without a link.
    toc = V.toc(spark, d).withColumn("href", F.when(book % 3 == 0, F.col("href")).when(
        book % 3 == 2, F.concat(F.lit("elsewhere/"), "href")))
    return E.book_chapters(items, toc)


@query("realign_reextract", f"""
    WITH {_GROUPS}
    SELECT book_id, group_no, count(*) AS n_pieces,
      array_to_string(list({rung3('html')} ORDER BY ordinal), chr(10) || chr(10)) AS text
    FROM g GROUP BY book_id, group_no""")
def realign_reextract(spark, d):
    items = V.spine_items(spark, d)
    texts = items.select("book_id", "ordinal", H.without_tags(F.col("html")).alias("text"))
    return E.realign(items, texts, V.toc(spark, d))


# Pages whose heading became a titled block with an element of its kind inside, an emphasised chapter
# line, a plain chapter line, or a short line: one strategy each, by page number.
_H1 = "<h1>(.*?)</h1>"
_NO_TITLE = "regexp_replace({}, '<title>.*?</title>', '')"
_RETITLED = rf"""CASE ordinal % 5 WHEN 0 THEN html
    WHEN 1 THEN {_NO_TITLE.format(f"regexp_replace(html, '{_H1}', '<div class=~big chapter-title~>"
                                  + "\\1 <div>in</div> on</div>')").replace('~', '"')}
    WHEN 2 THEN {_NO_TITLE.format(f"regexp_replace(html, '{_H1}', '<p><b>Chapter ' || ordinal || "
                                  + "': \\1</b> began.</p>')")}
    WHEN 3 THEN {_NO_TITLE.format(f"regexp_replace(html, '{_H1}', '<p>Chapter ' || ordinal || "
                                  + "': \\1</p>')")}
    ELSE {_NO_TITLE.format(f"regexp_replace(html, '{_H1}', '<p>A quiet house</p>')")} END"""


def _fragment(pattern: str, x: str = "html") -> str:
    found = f"regexp_extract({x}, '{pattern}', 1)"
    return f"nullif({_nodes(S.entities(found))}, '')"


@query("infer_title", rf"""
    WITH p AS (SELECT ordinal, {_RETITLED} AS html FROM ({SPINE})),
    f AS (SELECT ordinal, coalesce({_fragment('(?is)<h1>(.*?)</h1>')},
            {_fragment('(?is)<title>(.*?)</title>')}) AS s1,
          {_fragment('(?is)<div class="big chapter-title">(.*? on)</div>')} AS s2,
          {_fragment('(?is)<p><b>(Chapter [0-9]+: [^<]*)</b> began.</p>')} AS bold,
          {_fragment('(?is)(<p><b>Chapter [0-9]+: [^<]*</b> began.</p>)')} AS line,
          {_fragment('(?is)<p>(Chapter [0-9]+: [^<]*)</p>')} AS s4,
          {_fragment('(?is)<p>(A quiet house)</p>')} AS s5 FROM p),
    g AS (SELECT *, CASE WHEN length(bold) < 150 AND NOT ends_with(bold, '.') THEN bold END AS s3
          FROM f)
    SELECT ordinal, coalesce(s1, s2, s3, line, s4, s5, 'Unknown') AS title,
      CASE WHEN s1 IS NOT NULL THEN 'heading' WHEN s2 IS NOT NULL THEN 'attribute'
        WHEN s3 IS NOT NULL THEN 'emphasis' WHEN coalesce(line, s4) IS NOT NULL THEN 'pattern'
        WHEN s5 IS NOT NULL THEN 'short_line' ELSE 'none' END AS strategy FROM g""")
def infer_title(spark, d):
    def instead(heading):
        return F.regexp_replace(F.regexp_replace("html", F.lit(_H1), heading),
                                "<title>.*?</title>", "")

    number = F.col("ordinal").cast("string")
    case = F.col("ordinal") % 5
    pages = V.spine_items(spark, d).withColumn("html", F.when(case == 0, F.col("html")).when(
        case == 1, instead(F.lit('<div class="big chapter-title">$1 <div>in</div> on</div>'))).when(
        case == 2, instead(F.concat(F.lit("<p><b>Chapter "), number, F.lit(": $1</b> began.</p>")))
    ).when(case == 3, instead(F.concat(F.lit("<p>Chapter "), number, F.lit(": $1</p>")))).otherwise(
        instead(F.lit("<p>A quiet house</p>"))))
    title, strategy = H.infer_title(F.col("html"))
    return pages.select("ordinal", title.alias("title"), strategy.alias("strategy"))


@query("metadata_fallback", rf"""
    WITH p AS (SELECT ordinal, CASE WHEN ordinal % 4 = 0 THEN '' ELSE
        {S.strip("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} END AS given,
        CASE WHEN ordinal % 8 = 0 THEN '' ELSE
        {S.strip("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")} END AS dc,
        regexp_extract(html, '(?i)<html lang="([^"]*)"', 1) AS detected,
        CASE WHEN ordinal % 6 = 0 THEN 'en' ELSE '' END AS wanted FROM ({SPINE}))
    SELECT ordinal, coalesce(nullif(given, ''), nullif(dc, ''), 'missing title') AS title,
      coalesce(nullif(wanted, ''), nullif(nullif(detected, ''), 'es')) AS language,
      CASE WHEN coalesce(nullif(wanted, ''), nullif(nullif(detected, ''), 'es')) IS NULL
        THEN 'Language must be provided or detectable from the file metadata.' END AS error
    FROM p""")
def metadata_fallback(spark, d):
    blank = F.lit("")
    n = F.col("ordinal")
    given = F.when(n % 4 == 0, blank).otherwise(
        X.strip(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)))
    dc = F.when(n % 8 == 0, blank).otherwise(
        X.strip(F.regexp_extract("html", "(?is)<h1>(.*?)</h1>", 1)))
    # Spanish stands for a language the file does not declare.
    detected = F.nullif(F.nullif(F.regexp_extract("html", '(?i)<html lang="([^"]*)"', 1), blank),
                        F.lit("es"))
    title, language, error = H.metadata(given, dc, F.when(n % 6 == 0, "en").otherwise(""),
                                        detected)
    return V.spine_items(spark, d).select(
        "ordinal", title.alias("title"), language.alias("language"), error.alias("error"))


_LATIN1 = r"[\x{80}-\x{FF}]"


@query("decode_utf8_replace", rf"""
    SELECT ordinal, CAST(len(regexp_extract_all(html, '{_LATIN1}')) AS BIGINT) AS replaced,
      regexp_replace(html, '{_LATIN1}', chr(65533), 'g') AS text FROM ({SPINE})""")
def decode_utf8_replace(spark, d):
    # Pages saved as Latin-1 and read as UTF-8.
    text, replaced = decode_bytes(F.encode("html", "ISO-8859-1"))
    return V.spine_items(spark, d).select(
        "ordinal", replaced.alias("replaced"), text.alias("text"))
