"""Personal data, toxicity, pages, archives and the pipeline."""

import hashlib
import io
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from folioscan.llm import pii, queries, toxicity, warc, wrappers
from tests.llm.test_groups import near

SF = "/root/testdata/sf0.001"


def plain_spans(text):
    """The patterns as they are written down."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@given(st.text(alphabet="019. -+()@ab\n5", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text)[0] == plain_spans(text)


def test_base_spans_literal():
    card = "4111 1111-1111 1111"
    text = f"é a.b@x.org, c@d@e.com {card} +1 (269) 555-3296; 1.2.3.4 256.1.1.1 001.2.3.255"
    assert pii.base_spans(text)[0] == plain_spans(text) and len(plain_spans(text)) == 6
    assert pii.base_spans("")[0] == [] and pii.base_spans("9" * 200_000)[0] == []
    assert pii.base_spans("a" * 200_000 + "@" + "b" * 200_000 + ".c")[0] == [(0, 0, 400_003)]


def people(seed, n):
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    texts = []
    for _ in range(n):
        phone = f"+1 ({digits(3)}) 555-{digits(4)}"
        kinds = [f"{rnd.choice('abcdef')}{digits(2)}@mail{digits(1)}.org", phone, "4111111111111111",
                 f"10.{rnd.randrange(255)}.2.{rnd.randrange(255)}", f"in {rnd.randrange(1900, 2100)}", f"{rnd.randrange(99)} men"]
        texts.append(f"word {rnd.choice(kinds)} and {rnd.choice(kinds)} more words.")
    return texts


def test_the_field_finds_what_patterns_miss():
    texts = people(1, 400)
    s = pii.Settings()
    found = [pii.tokens(t) for t in texts]
    y = np.array([x for t, f in zip(texts, found) for x in pii.labels(f, *pii.base_spans(t))])
    field = pii.fit_graph(pii.graph(texts, found, s.buckets), y, s)

    def added(text):
        return [(text[a:b], pii.KINDS[k]) for a, k, b in
                pii.added_spans([text], [pii.base_spans(text)[0]], field, s)[0]]

    # A number that another one follows fails both patterns.
    assert ("+1 (269) 555-3296", "phone") in added("at +1 (269) 555-3296 4111111111111111 now")
    assert added("it was 1984 and 7 men in 2001") == []
    assert added("nothing here") == [] and added("") == []
    for t in texts[:50]:
        base = pii.base_spans(t)[0]
        for a, _, b in pii.added_spans([t], [base], field, s)[0]:
            assert all(b <= x or a >= z for x, _, z in base)


def test_skip_edges_carry_a_label():
    texts = people(2, 400) + ["x +1 (269) 555-3296 then 555-3296 y +1 (269) 555-3296 z"] * 30
    s = pii.Settings()
    found = [pii.tokens(t) for t in texts]
    g = pii.graph(texts, found, s.buckets)
    assert len(g.skip) and (g.skip[:, 0] < g.skip[:, 1]).all()
    field = pii.Field(np.zeros((s.buckets, pii.LABELS)), np.where(pii.allowed(), 0.0, pii.FAR),
                      3 * np.eye(pii.LABELS))
    one = pii.graph(["7777777 a 7777777 b 8888888"], [pii.tokens("7777777 a 7777777 b 8888888")], s.buckets)
    field.emission[one.features[0, 4]] += 4 * np.eye(pii.LABELS)[pii.begin(2)]
    p = field.marginals(one, 10)
    assert p[1].argmax() == pii.begin(2) or p[0].argmax() == pii.begin(2)
    lonely = pii.Field(field.emission, field.chain, np.zeros((pii.LABELS, pii.LABELS))).marginals(one, 10)
    assert p[1, pii.begin(2)] >= lonely[1, pii.begin(2)]


def test_one_sure_mention_reaches_hundreds_of_bare_ones():
    s = pii.Settings()
    field = pii.Field(np.zeros((s.buckets, pii.LABELS)), np.where(pii.allowed(), 0.0, pii.FAR), 6 * np.eye(pii.LABELS))
    field.emission[zlib.crc32(b"bias") % s.buckets, 0] = s.outside
    field.emission[zlib.crc32(b"s+d7") % s.buckets, pii.begin(3)] = 12
    for n in (1, 40, 600):
        for text in ("+5553296 a" + " 5553296 b" * n, "5553296 b " * n + "+5553296", "5553296 b " * n + "+5553296" + " c 5553296" * n):
            # Other documents beside it change nothing.
            many = [text, "1 2 3 4 1 2 3 4", "it was 5553296"]
            found = pii.added_spans(many, [[]] * 3, field, s)
            assert len(found[0]) == text.count("5553296") and {k for _, k, _ in found[0]} == {3}
            assert found[1] == found[2] == [] and pii.added_spans([text], [[]], field, s)[0] == found[0]


def test_messages_settle_where_they_should():
    """A chain has no loop: its marginals are those of all labellings."""
    rnd = np.random.default_rng(5)
    text = "1 2 3 4"
    g = pii.graph([text], [pii.tokens(text)], 64)
    field = pii.Field(rnd.normal(size=(64, pii.LABELS)), np.where(pii.allowed(), rnd.normal(size=(pii.LABELS,) * 2), pii.FAR),
                      np.zeros((pii.LABELS,) * 2))
    e, t = np.exp(field.scores(g)), np.exp(field.chain)
    p = np.einsum("a,ab,b,bc,c,cd,d->abcd", e[0], t, e[1], t, e[2], t, e[3])
    want = [p.sum(axis=tuple(j for j in range(4) if j != i)) / p.sum() for i in range(4)]
    assert np.allclose(field.marginals(g, 12), want, atol=1e-3)


def test_op2_and_odd_rows(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op2(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base = plain_spans(docs[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))
    rows = [(1, None, "x"), (1, "", "x"), (None, "a@b.c", None), (2, "a@b.c", None), (2, "a@b.c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    field = pii.fit(df)
    found = pii.find(df, field).collect()
    assert sorted(len(r.base) for r in found) == [0, 0, 1, 1, 1]
    assert sorted(str(r.text) for r in pii.masked(df, field).collect()) == ["", "None", *["[EMAIL]"] * 3][:0] + sorted(
        ["", "None", "[EMAIL]", "[EMAIL]", "[EMAIL]"])
    assert pii.find(df.limit(0), pii.fit(df.limit(0))).count() == 0


# --- toxicity -------------------------------------------------------------------------------------

def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int, quality int")
    return docs, labels


def sentences(seed, n):
    """Toxic rows hold an insult; most of them also name a group that clean rows rarely name."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(20, 60))]
        toxic = rnd.random() < 0.4
        if toxic:
            words += rnd.choices(["idiot", "scum", "moron"], k=3)
        if rnd.random() < (0.9 if toxic else 0.1):
            words.append("muslim")
        rnd.shuffle(words)
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_scores_separate_and_neutral_mentions_stay_clean(spark):
    docs, labels = labelled(spark, sentences(1, 600))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).collect()
    assert [c for c in scored[0].__fields__] == ["doc_id", "text", "score"]
    truth = dict(labels.select("doc_id", "toxic").collect())
    out = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in out]) > 0.97
    free = toxicity.fit(docs, labels, toxicity.Settings(swap=0.0))
    term = zlib.crc32(b"wmuslim")
    assert abs(model.weights.get(term, 0)) < 0.5 * free.weights[term]
    probe = pa.array(["a muslim man said w1 w2 w3", "you idiot scum moron w1 w2", "", "x"])
    score = toxicity.Scorer(model)(probe)
    assert score[0] < 0.5 < score[1] and score[2] == score[3] < 0.5


def plain_score(model, text):
    """The worst window, word by word."""
    words, scores = text.split(), []
    for start in range(0, max(1, len(words) - 200), 200):
        held = {}
        for w in words[start:start + 400]:
            for f in toxicity.word_features(w):
                held[f] = held.get(f, 0) + 1
        scores.append(model.bias + sum(model.weights[f] * np.log1p(n) for f, n in held.items() if f in model.weights))
    return 1 / (1 + np.exp(-max(scores)))


def test_scorer_equals_the_plain_sum():
    model = toxicity.Model(-1.0, {f: x for w, x in (("bad", 0.3), ("badly", 0.3), ("worse", 0.2), ("good", -0.4))
                                  for f in toxicity.word_features(w)})
    rnd = random.Random(3)
    texts = ["bad Bad, badly", "good", "worse " * 900, "", "!!!", " bad ", "good " * 700]
    for n in (1, 199, 200, 201, 399, 400, 401, 600, 601, 999, 5000):
        texts.append(" ".join(rnd.choice(["bad", "badly", "worse", "good", "x", "y", "-"]) for _ in range(n)))
        texts.append("\n " + " ".join(rnd.choices(["bad", "x"], [1, 60], k=n)) + "  ")
    for text, got in zip(texts, toxicity.Scorer(model)(pa.array(texts))):
        assert got == pytest.approx(plain_score(model, text))
    assert [len(toxicity.windows("x " * n)) for n in (0, 1, 400, 401, 600, 601)] == [1, 1, 1, 2, 2, 3]


def test_length_hides_no_insult():
    """A short insult scores the same alone and anywhere in a long clean text."""
    model = toxicity.Model(-1.0, {zlib.crc32(b"wscum"): 4.0})
    insult = ["scum", "scum", "scum"]
    clean = [f"w{i}" for i in range(20_000)]
    texts = [" ".join(insult)] + [" ".join(clean[:at] + insult + clean[at:]) for at in (0, 398, 10_000, 19_999, 20_000)]
    alone, *long = toxicity.Scorer(model)(pa.array(texts))
    assert alone > 0.98 and all(abs(x - alone) < 0.05 for x in long)


def test_long_documents_are_learnt_by_their_worst_window(spark):
    """Toxic texts of thousands of words with one insulting line: learnt, found, and clean long texts left alone."""
    rnd = random.Random(8)
    rows = []
    for i in range(500):
        words = [f"w{rnd.randrange(2000)}" for _ in range(rnd.choice([30, 300, 3000]))]
        if i % 3 == 0:
            at = rnd.randrange(len(words))
            words[at:at] = rnd.choices(["idiot", "scum", "moron"], k=3)
        rows.append((" ".join(words), int(i % 3 == 0)))
    docs, labels = labelled(spark, rows)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    out = [i for i in scored if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((scored[i] >= 0.5) == rows[i][1] for i in out) and len(out) > 60


TEMPLATES = ("{} said that the weather is fine", "der Verein für {} lädt ein", "une réunion avec des {} hier", "los {} del barrio")


def test_every_term_of_a_set_is_swapped(spark):
    """Scores of template sentences hardly change from term to term; without the penalty they do."""
    docs, labels = labelled(spark, sentences(2, 600))
    faiths = next(s for s in toxicity.IDENTITY if "muslim" in s)

    def gap(swap):
        scorer = toxicity.Scorer(toxicity.fit(docs, labels, toxicity.Settings(swap=swap)))
        scores = scorer(pa.array([t.format(f) for t in TEMPLATES for f in faiths])).reshape(len(TEMPLATES), -1)
        odds = np.log(scores / (1 - scores))
        return (odds.max(axis=1) - odds.min(axis=1)).max()

    assert gap(1.0) < 0.1 * gap(0.0)
    copies = toxicity.swaps([("a", "b", "c"), ("x", "y")])
    assert copies == [{"a": "b", "b": "c", "c": "a", "x": "y", "y": "x"}, {"a": "c", "b": "a", "c": "b"}]


def test_op9_on_held_out_documents(spark):
    """Precision and recall on documents that gave no label."""
    folder = "/root/testdata/sf0.01"
    truth = dict(queries.table(spark, folder, "labels").select("doc_id", "toxic").collect())
    rows = [r for r in queries.QUERIES["op9_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in truth]
    caught = sum(r.predicted and truth[r.doc_id] for r in rows)
    assert caught >= 0.8 * sum(truth[r.doc_id] for r in rows) and caught >= 0.8 * sum(r.predicted for r in rows)
    assert len(rows) > 50


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, [("a", 0), (None, None), ("", 0), ("x " * 50_000, 0)])
    for known in (labels, labels.limit(0)):
        got = toxicity.score(docs, toxicity.fit(docs, known)).collect()
        assert len(got) == 4 and all(0 <= r.score < 0.5 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.Model(0.0)).count() == 0


def test_op9(spark):
    got = queries.op9(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)


# --- pages ----------------------------------------------------------------------------------------

PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad big'>Buy</div>"
        "<article><header><h1>Title &amp; more</h1></header><p>One  <b>bold\n text</b>&nbsp;x.<br>On<p>Two &lt;i&gt; &am"
        "<div class='user-comments'><p>first!</p></div><aside>side</aside><form><p>f</p></form></article>"
        "<footer>&copy; me</footer><!-- x --></body></html>")


def test_extract():
    assert wrappers.extract(PAGE, frozenset()) == "Title & more\nOne bold text x. On\nTwo <i> &am"
    assert wrappers.extract("", frozenset()) == ""
    assert wrappers.extract("just <b>text</b> 1 < 2", frozenset()) == "just text 1 < 2"
    assert wrappers.extract("<body><p>a</p><div id='sidebar'>b</div><p>c<!-- ", frozenset()) == "a\nc"
    assert wrappers.extract("<article><p>cut off <a href='x", frozenset()) == "cut off"
    deep = "<div>" * 50_000 + "in" + "</div>" * 50_000
    assert wrappers.extract(deep, frozenset()) == "in"
    assert wrappers.extract("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul>", frozenset()) == "a\nb\nc\nd\ne"


def tree(kind, *children):
    return wrappers.Slot(kind, children=list(children))


def test_simple_tree_matching_by_definition():
    rnd = random.Random(9)

    def grow(depth):
        return tree(rnd.choice("abc"), *(grow(depth - 1) for _ in range(rnd.randrange(4)) if depth))

    def best(a, b):
        if a.kind != b.kind:
            return 0

        def pairs(i, j):
            if i == len(a.children) or j == len(b.children):
                return 0
            return max(pairs(i + 1, j), pairs(i, j + 1), best(a.children[i], b.children[j]) + pairs(i + 1, j + 1))

        return 1 + pairs(0, 0)

    for _ in range(60):
        a, b = grow(3), grow(3)
        assert wrappers.match(a, b)[0] == best(a, b) == wrappers.match(b, a)[0]


def test_wrappers_take_constant_texts_out(spark):
    def page(i):
        return (f"<body><div class='top'>Welcome to our site</div><div class='main'><p>Story {i} has its own words {i * 7}."
                f"</p><p>Read our rules before you post.</p><p>Then more about thing {i}, and {i + 1}.</p></div></body>")

    rows = [(i, "http://a.org/x", page(i)) for i in range(12)] + [(50, "http://b.org/", page(3)), (51, None, page(4)),
            (52, "odd url", None), (53, "http://a.org/y", "")] + [(60 + i, "http://c.org/", page(1)) for i in range(6)]
    df = spark.createDataFrame([(a, b, c, "k") for a, b, c in rows],
                               "page_id long, url string, html string, host string").repartition(5)
    got = {r.page_id: r.text for r in wrappers.main_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i] == f"Story {i} has its own words {i * 7}.\nThen more about thing {i}, and {i + 1}."
    # One page alone has no template; pages that are all alike keep their text.
    assert got[50].startswith("Welcome") and got[60].startswith("Welcome") and got[52] == got[53] == ""
    assert wrappers.main_text(df.limit(0)).count() == 0


def texts_of(spark, pages, url="http://a.org/"):
    df = spark.createDataFrame([(i, url, p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    return [r.text for r in sorted(wrappers.main_text(df).collect(), key=lambda r: r.page_id)]


def test_a_mark_without_the_article_does_not_hide_it(spark):
    body = [f"<div class='story'><h2>Part {i}</h2><p>{f'The long story number {i} goes on. ' * 5}</p></div>" for i in range(10)]
    want = [f"Part {i}\n" + " ".join([f"The long story number {i} goes on."] * 5) for i in range(10)]
    for mark in ("<article><script>var a</script></article>", "<main> </main>", "<article><p>Read also our news</p></article>"):
        assert texts_of(spark, [f"<body>{mark}{b}</body>" for b in body]) == want
    # A teaser that differs from page to page, also on one page of a host whose articles are marked.
    got = texts_of(spark, [f"<body><article><p>Related {i}</p></article>{b}</body>" for i, b in enumerate(body)])
    assert all(w in g for w, g in zip(want, got))
    recent = "<div class='recent'><p>Seen lately: {0}, and {0} again</p></div>"
    long = [f"<body><article><p>{f'Text {i} of its own. ' * 20}</p></article>{recent.format(i)}</body>" for i in range(9)]
    got = texts_of(spark, [*long, f"<body><article><p>Teaser</p></article>{body[3]}</body>",
                           f"<body><article><p>Short.</p></article>{recent.format(77)}</body>"])
    assert want[3] in got[9] and got[10] == "Short." and not any("lately" in g for g in got)


@pytest.mark.parametrize("long", [40, 100])
def test_a_notice_on_long_pages_is_template(spark, long):
    def page(i):
        lines = [f"<p>Line {i} {k} of the story.</p>" for k in range(long)]
        lines.insert((7 * i) % long, "<p>Read our rules before you post.</p>")
        return f"<body><div class='x'>{''.join(lines)}</div></body>"

    got = texts_of(spark, [page(i) for i in range(30)])
    assert got == ["\n".join(f"Line {i} {k} of the story." for k in range(long)) for i in range(30)]


def test_template_is_counted_where_its_node_is_and_never_given_back(spark):
    menu = "<div class='top'>Home, sport, weather and all the other pages of this site</div>"
    pages = [f"<body>{menu}<article><p>Short {i}.</p></article></body>" for i in range(8)]
    pages += [f"<body>{menu}<article></article></body>", f"<body>{menu}</body>"]
    assert texts_of(spark, pages) == [f"Short {i}." for i in range(8)] + ["", ""]
    two = [f"<body><div class='a'>Welcome to A</div><p>Own {i} text</p></body>" for i in range(6)]
    two += [f"<body><table class='b'><tr><td>Welcome to B</td></tr></table><p>Other {i} text</p></body>" for i in range(6)]
    assert texts_of(spark, two, None) == [f"Own {i} text" for i in range(6)] + [f"Other {i} text" for i in range(6)]
    # Copies are one page, whatever their scripts say.
    copies = [f"<body><script>track({i})</script><p>All alike</p><p>on every page</p></body>" for i in range(9)]
    assert texts_of(spark, copies) == ["All alike\non every page"] * 9


def test_merging_does_not_depend_on_who_starts():
    slots = [wrappers.slot(wrappers.parse(PAGE.replace("One", f"One {i}"))) for i in range(6)]
    whole = wrappers.slot(wrappers.parse(PAGE))
    for s in slots[1:]:
        wrappers.merge(slots[0], s)
    back = wrappers.unpack(wrappers.pack(slots[0]))
    wrappers.merge(whole, back)
    assert whole.pages == 7 and len(wrappers.template(whole)) > 3


def test_op3(spark):
    got = queries.op3(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and r.text for r in got)
    assert not any("  " in r.text or "<p>" in r.text or "track(" in r.text for r in got)


# --- archives -------------------------------------------------------------------------------------

def archive(records):
    return b"".join(warc.compress(records))


def test_archive_round_trip_and_damage():
    made = [warc.record(i, f"http://x/{i} \r\n", b"payload %d " % i * 40, None) for i in range(30)]
    made.append(warc.record(31, None, b"payload 3 " * 40, 3))
    data = archive(made)
    assert data[:4] == struct.pack("<I", warc.SKIPPABLE)
    back = [warc.parse(r) for r in warc.frames(io.BytesIO(data), chunk=7)]
    assert [r["page_id"] for r in back] == [*range(30), 31]
    assert back[31 - 1]["refers_to"] == 3 and back[31 - 1]["payload"] is None
    assert back[4]["payload"] == b"payload 4 " * 40 and back[4]["url"] == "http://x/4%20%0D%0A"
    for broken in (data[:-3], data[:6], b"junk" + data, data[:-200] + b"\0" * 200, data + b"xx"):
        with pytest.raises(warc.ArchiveError):
            [warc.parse(r) for r in warc.frames(io.BytesIO(broken))]
    # An archive whose dictionary is not compressed is read as well.
    raw = zstandard.ZstdCompressionDict(b"payload header text " * 20, zstandard.DICT_TYPE_RAWCONTENT)
    plain = struct.pack("<II", warc.SKIPPABLE, len(raw.as_bytes())) + raw.as_bytes() + b"".join(
        zstandard.ZstdCompressor(dict_data=raw).compress(r) for r in made)
    assert list(warc.frames(io.BytesIO(plain))) == made


@pytest.mark.parametrize("old, new", [
    (b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 83", b"Content-Length: 84"), (b"WARC-Type: response", b"WARC-Type: other"),
    (b"hello", b"jello"), (b"WARC-Date", b"WARC-Late"), (b"\r\n\r\n", b"\r\n"), (b"sha1:", b"md5::")])
def test_records_are_checked(old, new):
    good = warc.record(1, "u", b"hello", None)
    assert old in good and warc.parse(good)["payload"] == b"hello"
    with pytest.raises(warc.ArchiveError):
        warc.parse(good.replace(old, new, 1) if old != b"sha1:" else good.replace(old, new))


def test_pages_through_archives(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>") for i in range(40)] + [
        (90, None, None), (80, "u", ""), (3, "twice", "<p>3</p>"), (None, "n", "<p>3</p>"), (70, "big", "x" * 200_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, refers_to string").repartition(4)
    got = warc.read(warc.write(df)).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 10 ** 9), i)
    want = sorted(((i, len(h or ""), warc.digest((h or "").encode()), None if i == first[h or ""] else first[h or ""])
                   for i, _, h in rows), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in got), key=str) == want
    assert all((r.record_type == "revisit") == (r.refers_to is not None) == (r.payload is None) for r in got)
    short = warc.read(warc.write(df, least=4)).filter("payload_bytes < 4").collect()
    assert len(short) == 2 and all(r.refers_to is None for r in short)
    assert warc.read(warc.write(df.limit(0))).count() == 0


# --- pipeline -------------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        at[name] = (docs, spark.read.parquet(path))
        docs = at[name][1]
    names = [n for n, _ in corpus_pipeline.STAGES]
    before, after = at[names[0]]
    assert after.columns == before.columns
    predicted = {r.doc_id: r.predicted for r in queries.op9(spark, SF).collect()}
    assert {r.doc_id for r in after.collect()} == {d for d, p in predicted.items() if not p}
    before, after = at[names[1]]
    texts = {r.doc_id: r.text for r in before.collect()}
    roots, _ = near(texts, 5)
    assert {r.doc_id for r in after.collect()} == set(roots.values()) and after.columns == before.columns
    before, after = at[names[2]]
    assert after.count() == before.count() and after.schema == before.schema
    for r in after.collect():
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        if not plain_spans(texts[r.doc_id]) and "[" not in r.text:
            assert r.text == texts[r.doc_id]
    packed = at[names[3]][1]
    total = {r.doc_id: r.doc_tokens for r in packed.collect()}
    assert packed.groupBy().sum("length").first()[0] == sum(total.values())
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_pipeline_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (None, "a b c d e f", "en", "s", 11, None),
            (2, "a b c d e f", "en", "s", 11, None), (3, "a b c d e f", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for start in (docs, docs.limit(0)):
        left = start
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}{start is docs}")
            stage(spark, left, SF).write.parquet(path)
            left = spark.read.parquet(path)
        assert left.select("doc_id").distinct().count() == (3 if start is docs else 0)


ARTICLE = "The harbour was quiet that morning, and nobody saw the boat come in. " * 8


@pytest.mark.parametrize("names", [
    "elementor-widget elementor-widget-theme-post-content", "content-area no-sidebar", "entry no-comments", "post has-banner",
    "share-price-report", "with-ad wide", "layout right-sidebar"])
@pytest.mark.parametrize("around", ["{}", "<article>{}</article>"])
def test_names_that_only_remark_keep_the_article(names, around):
    inner = around.format(f'<div class="{names}"><p>{ARTICLE}</p></div>')
    page = f'<body><nav><a href="/">Home</a></nav>{inner}<div class="site-footer-inner">Imprint</div></body>'
    assert wrappers.extract(page, frozenset()) == ARTICLE.strip()


@pytest.mark.parametrize("names", [
    "ad", "ad-slot-300x250", "post-comments-list", "sidebar-left", "site-footer-inner", "share-buttons", "cookie-notice",
    "related-posts", "widget_recent_entries", "main-navigation"])
def test_names_of_other_parts_leave_them_out(names):
    page = f'<body><div class="post"><p>{ARTICLE}</p></div><div class="{names}"><p>Something else.</p></div></body>'
    assert wrappers.extract(page, frozenset()) == ARTICLE.strip()
    assert wrappers.extract(f'<p>one <span class="{names}">two</span> three</p>', frozenset()) == "one three"


def test_header_of_a_post_is_its_own():
    assert wrappers.extract('<div class="post"><header><h1>The title</h1></header><p>x</p></div>', frozenset()) == "The title\nx"
    site = '<body><header><h1>Site</h1><ul><li><a href="/a">A</a></ul></header><p>x</p>'
    assert wrappers.extract(site, frozenset()) == "x"


def test_the_host_overrules_a_prior_but_not_for_template(spark):
    rows = []
    for i in range(12):
        story = f"<p>{ARTICLE}{i}</p>"
        rows.append((i, "http://a.example/x", f"<body><p>Teaser {i}</p><aside>{story}</aside></body>"))
        rows.append((100 + i, "http://b.example/x", f"<body><p>Text {i}</p><aside><p>{ARTICLE}</p></aside></body>"))
        rows.append((200 + i, "http://c.example/x", f'<body><p>Text {i}</p><div class="comments">{story}</div></body>'))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = [r.text for r in sorted(wrappers.main_text(df).collect(), key=lambda r: r.page_id)]
    assert got[:12] == [f"Teaser {i}\n{ARTICLE}{i}" for i in range(12)]
    assert got[12:24] == got[24:] == [f"Text {i}" for i in range(12)]


def test_wide_pages_align_in_linear_time():
    def page(n, every):
        return wrappers.slot(wrappers.parse("<dl>" + "".join(
            f"<dt>{i}<dd>{i}" + ("<hr>" if i % every == 0 else "") for i in range(n)) + "</dl>"), False)

    one, two = page(10_000, 7), page(9_900, 11)
    start = time.perf_counter()
    wrappers.merge(one, two)
    assert time.perf_counter() - start < 5
    a, b = [[wrappers.Slot(k) for k in "xy" * 50 + m + "xy" * 50] for m in ("abcz", "azc")]
    pairs = wrappers.beside(a, b)
    assert len(pairs) == 202 and all(a[i].kind == b[j].kind for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
