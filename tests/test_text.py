import pytest

from folioscan.functions import text as X
from folioscan.functions.citations import clean_citations


def test_clean_speech(one):
    raw = " This is a test text.  With  multiple spaces, tabs\t, and newlines\n."
    assert one(X.clean_speech, t=raw) == (
        "This is a test text. With multiple spaces, tabs, and newlines.")
    assert one(X.clean_speech, t="a@b <<quote>> <b>x</b> wait...!? ok") == (
        'aab "quote" x wait? ok')


def test_clean_speech_long_punctuation_run(one):
    assert one(X.clean_speech, t="a" + "." * 200_000 + "!") == "a!"


def test_slug(one):
    assert one(X.slug, t="This is a Test Title!") == "this_is_a_test_title"
    assert one(X.slug, t="__Élan  Çà_et  là__") == "elan_ca_et_la"


@pytest.mark.parametrize("raw, words", [
    ("Don't stop, now!", ["don't", "stop", "now"]),
    ("'quoted' words", ["quoted", "words"]),
    ("''' --- ''", []),
    ("O'Neill's snake_case 42", ["o'neill's", "snake_case", "42"]),
])
def test_spoken_words(one, raw, words):
    assert one(X.spoken_words, t=raw) == words


def test_words_see_every_kind_of_space(many):
    texts = ["a b c\x1cd　e f", "   ", "", " x\x85"]
    assert many(X.words, texts) == [t.split() for t in texts]
    assert many(X.word_count, texts) == [len(t.split()) for t in texts]
    assert many(X.strip, texts) == [t.strip() for t in texts]


def test_citations(one):
    raw = ("Body [1] text [2,3] more [4-6].\nFigure 1: a caption\nSmith et al. (2020) say so "
           "(Jones, 1999, p. 3) at https://x.org/a?b=1 and doi:10.1/x (pp. 1-9).")
    out = one(clean_citations, t=raw)
    for gone in ("[1]", "[2,3]", "[4-6]", "caption", "2020", "1999", "http", "doi", "pp."):
        assert gone not in out
    assert out.startswith("Body text more")
    listed = one(clean_citations, t="Text.\nReferences:\n[A] one\n[B] two\n\nAfter")
    assert "[Reference section starts here]" in listed and "After" in listed


def test_citation_list_of_many_notes(one):
    notes = "[" + ",".join(map(str, range(20_000))) + "]"
    assert one(clean_citations, t=f"a {notes} b [1,,2]") == "a b [1,,2]"


def test_quality(many):
    texts = ["", "   short ", "Hello � World �", "a" * 300,
             ">>>>>>..,,,,,;;;;;!!!!!%%%%%#####",
             "> > > . . , , ; ; ! ! % % # # a b c d", "A normal sentence with plain words."]
    assert many(X.quality_reason, texts) == [
        "empty", "empty", "mojibake", "whitespace", "whitespace", "nonword", "clean"]


def test_quality_threshold_falls_back(one):
    text = "ab � cd ef gh ij kl mn"
    assert one(lambda t: X.quality_reason(t, "0.01"), t=text) == "mojibake"
    assert one(lambda t: X.quality_reason(t, "not a number"), t=text) == "clean"


def test_reasoning(one):
    assert one(X.after_reasoning, t="<think>hm</think> Said  this .") == "Said this."
    assert one(X.without_reasoning, t="a<think>x\ny</think>b") == "ab"


def test_titles(one):
    assert one(X.short_title, t="x" * 50) == "x" * 50
    assert one(X.short_title, t="x" * 51) == "x" * 47 + "..."
    assert one(X.marker_title, t="a\r\nb") == "a b"
    assert one(X.first_sentence_title, t="  One\ntwo. Three") == "One two."


def test_rounding(many):
    from pyspark.sql import functions as F
    got = many(lambda t: F.concat_ws(" ", X.fixed_digits(t.cast("double"))),
               ["0.125", "0.3", "12", "0.005"])
    assert got == ["0.13", "0.30", "12.00", "0.01"]
