import html
import html.parser
import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from folioscan.functions import html as H
from folioscan.functions.citations import clean_citations
from folioscan.operators import extraction as E
from folioscan.operators.quality import text_quality

PROSE = "<p>" + "Plain words of a story go on and on here. " * 5 + "</p>"


def test_visible_text(many):
    pages = [
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head>"
        "<body><!-- no --><h1> A &amp; B </h1><p>x&nbsp;<b>y</b></p></body></html>",
        "&lt;b&gt; stays &amp;lt; and &#8212; &eacute;&unknown;", "plain", "",
    ]
    assert many(H.page_text, pages) == [
        "T A & B x y", "<b> stays &lt; and — é&unknown;", "plain", ""]


def test_only_tags_are_tags(many):
    pages = ["<p>if x < 5 and y > 3 then</p>", '<a title="a > b" href="x">go</a>',
             "<p>a</p><script>var t = 1;", "a\u0001b<!-- open", "<p>a <3 b</p>", "x<?pi?>y<!doctype z>w"]
    assert many(H.page_text, pages) == [
        "if x < 5 and y > 3 then", "go", "a", "ab", "a <3 b", "x y w"]


class Reader(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.parts.append("\0")
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.parts.append("\0")
        self.hidden -= tag in ("script", "style")

    def handle_comment(self, data):
        self.parts.append("\0")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_random_pages_as_a_parser_reads_them(many):
    rnd = random.Random(5)
    bits = ["word", " ", "a < b", "5 > 3", "&amp;", "&lt;i&gt;", "&eacute;", "<p>", "</p>", "<b class='x>y'>",
            "</b>", '<a href="q?a=1&b=2" title="1 > 0">', "</a>", "<br/>", "<!-- n > m -->", "\n",
            "<script>if (a < b) x('<p>');</script>", "<style>p > b {}</style>", "<h1>", "</h1>", "é"]
    pages = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))) for _ in range(400)]

    def read(page):
        reader = Reader()
        reader.feed(page)
        reader.close()
        return " ".join(t for t in (p.strip() for p in "".join(reader.parts).split("\0")) if t)

    assert many(H.page_text, pages) == [read(p) for p in pages]


def test_markup_around_citations(one):
    got = one(clean_citations, t="Tom &amp; Jerry <b>run</b> <!-- a > b --> end")
    assert got == "Tom & Jerry run end"
    assert one(clean_citations, t="no tags &amp; so on") == "no tags &amp; so on"


def test_lower_rungs_read_the_body(one):
    page = ("<html><head><title>T</title><style>x</style></head><body class='c'><p>a &amp; b</p>"
            "<script>no()</script></body></html>")
    assert one(H.without_scripts, h=page) == "a & b"
    assert one(H.without_tags, h=page) == "a &amp; b no()"


def test_references_as_the_standard_has_them(many):
    rnd = random.Random(2)
    names = rnd.sample(sorted(html5), 300)
    samples = [f"a &{n} b" for n in names] + [f"&{n}x1;" for n in names[:60]] + [
        f"&#{c};&#x{c:x}; &#{c}z" for c in (0, 1, 9, 10, 13, 65, 128, 150, 129, 0xD800, 0xFDD0,
                                            0xFFFF, 0x1F600, 0x110000, 10 ** 30)] + [
        "&&amp;&amp;lt; & &; &#; &#x; &notit; &copy2026 &AMP", "no reference"]
    assert many(H.decode_references, samples) == [html.unescape(t) for t in samples]


def test_other_rungs(one):
    page = "<style>x</style><p>a&amp;b</p><script>no</script><p>c</p>"
    assert one(H.without_scripts, h=page) == "a&bc"
    assert one(H.without_tags, h="<p>a</p>\n<p>b</p>") == "a b"


@pytest.mark.parametrize("page, title, how", [
    ("<body><h2>The <i>Road</i></h2><h1>Later</h1></body>", "The Road", "heading"),
    ("<head><title>Head</title></head><body><p>x.</p></body>", "Head", "heading"),
    ('<body><p class="x chapter-title">Named</p></body>', "Named", "attribute"),
    ('<body><div class="chapter"><div class="title">T &amp; U</div><p>x</p></div>y</body>',
     "T & U x", "attribute"),
    ('<body><p class="chapter"> </p><p id="title">Named</p></body>', "Named", "attribute"),
    ("<h1>A &amp; B</h1>", "A & B", "heading"),
    ('<body><p class="section-content">This is prose, long enough to end with a stop.</p>'
     "<p><b>Chapter 4: Night</b> began.</p></body>", "Chapter 4: Night", "emphasis"),
    ("<body><p>It was late and he said so.</p><p>XIV. The Storm</p></body>",
     "XIV. The Storm", "pattern"),
    ("<body><p>It was late and he said so.</p><p>A quiet house</p></body>",
     "A quiet house", "short_line"),
    ("<body><p>It was late and he said so.</p></body>", "Unknown", "none"),
])
def test_title(one, page, title, how):
    assert one(lambda h: F.struct(*H.infer_title(h)), h=page)[:] == (title, how)


def test_title_after_very_many_inline_tags(one):
    page = "<body><p>" + "x<br>" * 50_000 + ".</p><p>A quiet house</p></body>"
    assert one(lambda h: H.infer_title(h)[0], h=page) == "A quiet house"


def test_headings(many):
    lines = ["Chapter One: x", "ch. 7", "PART iv", "I wore a hat", "IV. The Storm", "12 - Twelve",
             "Prologue", "The end", "12"]
    assert many(H.heading_class, lines) == [
        "chapter", "chapter", "part", "none", "roman", "number", "named", "none", "none"]


def test_toc_pages(many):
    links = "".join(f'<li><a href="c{i}.xhtml">Chapter {i}</a></li>' for i in range(9))
    notes = "".join(f'<a href="#fn{i}">{i}</a>' for i in range(9))
    pages = [f"<body><h1>Table of contents</h1>{links}</body>",
             f"<body><p>chapter part section {'word ' * 1200}</p>{notes}</body>",
             '<body epub:type="toc"><p>x</p></body>',
             f'<body epub:type="bodymatter chapter">{links} contents</body>',
             f'<body><section epub:type="table-of-contents">{PROSE}</section></body>', PROSE]
    verdict = lambda h: H.looks_like_toc(h, F.lower(H.page_text(h)))
    assert many(verdict, pages) == [True, False, True, False, True, False]
    valid = many(lambda h: H.valid_chapter(h, H.page_text(h)), pages)
    assert valid == [False, True, False, True, True, True]


def test_copyright_and_names(many):
    assert many(H.looks_like_copyright, ["copyright © isbn 1", "copyright isbn"]) == [True, False]
    assert many(H.skip_by_name, ["OEBPS/Cover.xhtml", "text/ch01.xhtml", "índice.html"]) == [
        True, False, True]
    assert many(H.toc_name, ["./Text/C1.xhtml#a", "c2.xhtml", "#x"]) == [
        "text/c1.xhtml", "c2.xhtml", ""]


def test_grouping(spark):
    names = ["a", "b", "c", "d", "cover", "e"]
    items = spark.createDataFrame(
        [(1, i, n, f"<html><body>{PROSE}{n}</body></html>") for i, n in enumerate(names)],
        "book_id long, ordinal long, item_name string, html string")
    toc = spark.createDataFrame([(1, "a#x"), (1, "./C"), (1, "e")], "book_id long, href string")
    groups = E.group_items(items, toc)
    assert [r.group_no for r in sorted(groups.collect(), key=lambda r: r.ordinal)] == [
        1, 1, 2, 2, 3]
    merged = E.merge_items(items, groups)
    rows = sorted(merged.collect(), key=lambda r: r.group_no)
    assert [r.n_items for r in rows] == [2, 2, 1]
    assert rows[0].html == (f"<html><body><body>{PROSE}a</body>\n<body>{PROSE}b</body>"
                            "</body></html>")
    assert rows[2].html == f"<html><body>{PROSE}e</body></html>"
    checked = E.with_visible(merged).withColumn(
        "valid", H.valid_chapter(F.col("html"), F.col("visible")))
    assert E.grouping_outcome(groups, toc, checked).first().method == "toc"
    few = toc.filter("href = 'e'").union(spark.createDataFrame([(1, "zz"), (1, "yy")], toc.schema))
    assert E.grouping_outcome(E.group_items(items, few), few, checked).first().method == "items"


def test_fallback(spark):
    rows = [(1, 1, "x", "<p>" + "z " * 20 + "</p>"), (1, 2, "y", "<p>no</p>"),
            (2, 3, "x", PROSE), (2, 4, "y", "<p>" + "z " * 20 + "</p>")]
    items = spark.createDataFrame(rows, "book_id long, ordinal long, item_name string, html string")
    assert {r.ordinal for r in E.filter_with_fallback(items).collect()} == {1, 3}


def test_ladder(spark):
    rows = [(1, PROSE), (2, "<p>" + "%%% " * 50 + "</p>")]
    out = {r.i: r for r in E.extract_ladder(spark.createDataFrame(rows, "i int, html string")).collect()}
    assert out[1].rung == 1 and out[2].rung == 3


def test_text_quality_columns(spark):
    df = spark.createDataFrame([("",)], "text string")
    assert text_quality(df).first()[1:] == ("empty", "garbage")


# --- nested contents ---------------------------------------------------------------------------

def walked(entries):
    """Depth first, by recursion."""
    known = {(b, e) for b, e, *_ in entries}
    out = []

    def below(book, parent, depth, way):
        rows = [r for r in entries if r[0] == book and (
            r[2] == parent if parent is not None else r[2] is None or (book, r[2]) not in known)]
        for _, entry, _, _, title, href in sorted(rows, key=lambda r: (r[3] or 0, r[1])):
            path = [*way, title or ""]
            out.append((book, entry, depth, " / ".join(path), href))
            below(book, entry, depth + 1, path)

    for book in sorted({b for b, *_ in entries}):
        below(book, None, 1, [])
    return out


def test_nested_contents(spark):
    from folioscan.operators.contents import walk
    rnd = random.Random(3)
    entries = []
    for book in range(6):
        for e in range(40):
            parent = rnd.choice([None, *range(e)]) if book else (e - 1 if e else None)
            entries.append((book, e, parent, rnd.randrange(4), f"t{e}" if e % 7 else None,
                            f"./ch{e}.html#x" if e % 3 else None))
    # Parents that are not there, and entries that go round in circles.
    entries += [(7, 1, 99, 0, "orphan", "a"), (7, 2, 1, None, "child", "b")]
    circle = [(8, 1, 2, 0, "x", "x"), (8, 2, 1, 0, "y", "y"), (8, 3, 3, 0, "z", "z"), (None, 1, None, 0, "n", "n"), entries[5]]
    schema = "book_id long, entry_no int, parent_no int, place int, title string, href string"
    got = walk(spark.createDataFrame(entries + circle, schema).repartition(5)).collect()
    got = sorted((r.book_id, r.position, r.entry_no, r.depth, r.path, r.href) for r in got)
    assert [(b, *rest) for b, _, *rest in got] == walked(entries)
    assert max(r[3] for r in got) == 40
    for book in range(6):
        assert [r[1] for r in got if r[0] == book] == list(range(1, 41))
    assert walk(spark.createDataFrame([], schema)).count() == 0
