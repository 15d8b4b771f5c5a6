"""The element tree, and titles that nesting decides."""

import html
import html.parser
import random
import time

import pytest
from pyspark.sql import functions as F

from folioscan.functions import fixed as K
from folioscan.functions import html as H
from folioscan.functions.tree import read_tree, title_parts


class Plain(html.parser.HTMLParser):
    """The same tree by the standard library's parser, one object per element."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open = [{"name": "", "place": 0, "nodes": 0, "texts": [], "inside": []}]
        self.all = list(self.open)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        top = self.open[-1]
        node = {"name": tag, "place": top["nodes"], "nodes": 0, "texts": [], "inside": []}
        top["nodes"] += 1
        for e in self.open:
            e["inside"].append(len(self.all))
        self.all.append(node)
        self.open.append(node)
        if tag in K.VOID_ELEMENTS:
            self.open.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in K.VOID_ELEMENTS:
            self.open.pop()

    def handle_endtag(self, tag):
        if any(e["name"] == tag for e in self.open[1:]):
            while self.open.pop()["name"] != tag:
                pass

    def handle_data(self, data):
        self.open[-1]["nodes"] += 1
        if data.strip(K.WS_CHARS):
            for e in self.open:
                e["texts"].append(data.strip(K.WS_CHARS))

    def handle_comment(self, data):
        self.open[-1]["nodes"] += 1


def test_tree_as_a_plain_parser_has_it():
    rnd = random.Random(5)
    pieces = ["<p>", "</p>", "<div class='a'>", "</div>", "<b>", "</b>", "<br>", "<hr/>", "<span/>", "</br>", " ", "\n",
              "x", "a &amp; b", "&nbsp;", "<!-- c > d -->", '<a title="1 > 0">', "</a>", "</body>", "<body>", "<SECTION>",
              "</Section >"]
    for _ in range(400):
        # Two texts in a row are one node here and there.
        page = "".join(rnd.choices(pieces, k=rnd.randint(0, 40)))
        tree, plain = read_tree(page), Plain(page).all
        assert tree.names == [e["name"] for e in plain], page
        for i, e in enumerate(plain):
            assert list(range(i + 1, tree.ends[i])) == e["inside"], page
            assert tree.texts[tree.text_from[i]:tree.text_to[i]] == e["texts"], page
            assert tree.places[i] == e["place"], page


def test_hidden_text_belongs_to_no_element():
    tree = read_tree("<p>a<script>if (x < y) '</p>'</script>b<style>p</style><template><b>t</b></template>c</p>d")
    assert tree.text(0) == "a b c d" and tree.text(tree.first("p")) == "a b c"
    assert tree.text(tree.first("b")) == ""
    assert read_tree("").names == [""] and read_tree("<p>a<script>b").text(0) == "a"


PROSE = "<p>It was late and he said so.</p>"


@pytest.mark.parametrize("page, title, how", [
    # Emphasis counts inside the first ten nodes of the body, texts and blanks among them, at any depth.
    (f"<body><section><div>{PROSE}<ul><li><em>Chapter 2</em></li></ul></div></section></body>", "Chapter 2", "emphasis"),
    ("<body>" + PROSE * 9 + "<div><div><b>Chapter 3</b> began.</div></div></body>", "Chapter 3", "emphasis"),
    ("<body>" + PROSE * 10 + "<div><b>Chapter 3</b> began.</div></body>", "Unknown", "none"),
    ("<body>" + (PROSE + "\n") * 5 + "<ul><li><b>Chapter 3</b></li></ul></body>", "Unknown", "none"),
    # An emphasised node of the body itself is inside none of them.
    (f"<body><b>Chapter 3</b>{PROSE}</body>", "Unknown", "none"),
    (f"<body><ul><li><b>Chapter 3</b></li></ul>{PROSE}</body>", "Chapter 3", "emphasis"),
    # Leaves hold no line element; a wrapper counts among the first ten all the same.
    ("<body><div><div><p>XIV. The Storm</p></div></div></body>", "XIV. The Storm", "pattern"),
    ("<body>" + "<div>" * 9 + "<p>XIV. The Storm</p>" + "</div>" * 9 + "</body>", "XIV. The Storm", "pattern"),
    ("<body>" + "<div>" * 10 + "<p>XIV. The Storm</p>" + "</div>" * 10 + "</body>", "Unknown", "none"),
    ("<body><p>A house <span>by the sea.</span></p></body>", "Unknown", "none"),
    ("<body>" + "<div>" * 4 + "<p>A quiet house</p>" + "</div>" * 4 + "</body>", "A quiet house", "short_line"),
    ("<body>" + "<div>" * 5 + "<p>A quiet house</p>" + "</div>" * 5 + "</body>", "Unknown", "none"),
    # Headings that nest, hold no text or stand outside the body.
    ("<body><header><header>In</header>Out</header></body>", "In Out", "heading"),
    ("<head><title>T</title></head><body><h1> </h1><h2>Two</h2></body>", "T", "heading"),
    ("<h1>Before</h1><body><p id='title'>Named</p></body>", "Named", "attribute"),
    ('<body><p data-id="title" class="x">Go on.</p><p CLASS=chapter>Named</p></body>', "Named", "attribute"),
    ('<body><p class="my-title\n">Named', "Named", "attribute"),
    ('<body><p class="subtitle titled">Go on.</p></body>', "Unknown", "none"),
    ("<!-- <h1>No</h1> --><body><script>'<h1>No</h1>'</script><p>Go on.</p></body>", "Unknown", "none"),
    ("", "Unknown", "none"),
    (None, "Unknown", "none"),
])
def test_titles_by_nesting(spark, page, title, how):
    row = spark.createDataFrame([(page,)], "h string").select(
        *[c.alias(n) for n, c in zip(("title", "how"), H.infer_title(F.col("h")))]).first()
    assert row[:] == (title, how)


def test_time_follows_the_page():
    def seconds(n):
        pages = ("<div class='x'>" * n + "a" + "</div>" * n, "<body><div>" + "<b>x y</b>" * n + "</div>",
                 "<p>" * n, "</p>" * n, "<body>" + "<p>x<br>y" * n)
        start = time.perf_counter()
        for p in pages:
            title_parts(p)
        return time.perf_counter() - start

    seconds(1_000)
    assert seconds(80_000) < 16 * max(seconds(10_000), 0.02)
