"""Every registered query against its SQL, and the two without SQL against brute force."""

import pytest

import __spark_entry__ as entry
from folioscan import plans
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    said = compare(got, con.execute(entry.oracle_sql()[name]).df())
    assert not said or said.startswith("(types"), said


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) - set(plans.ORACLES) == {"split_oversized_bytes", "wer_documents"}


def test_split_oversized_bytes(spark):
    from tests.test_segment import cut_sentence
    rows = entry.queries()["split_oversized_bytes"](spark, SF).collect()
    chars = entry.queries()["split_sentences"](spark, SF).collect()
    want = {(s.doc_id, s.pos, i + 1): p for s in chars
            for i, p in enumerate(cut_sentence(s.piece, 12, "bytes"))}
    assert {(r.doc_id, r.sentence_no, r.pos): r.piece for r in rows} == want


def test_wer_documents(spark):
    """Brute force over every document short enough for it."""
    from folioscan.functions.text import spoken_words
    from folioscan.sources.tables import read
    from tests.test_words import distance
    got = {r.doc_id: r.wer for r in entry.queries()["wer_documents"](spark, SF).collect()}
    docs = read(spark, SF, "documents")
    assert len(got) == docs.count()
    checked = 0
    for r in docs.select("doc_id", "text", spoken_words("text").alias("w")).collect():
        if not 0 < len(r.w) <= 120:
            continue
        raw = r.text.split()
        heard = [w for i, w in enumerate(raw[:(len(raw) + 1) // 2]) if (i + 1) % 7]
        hyp = spark.createDataFrame([(" ".join(heard),)], "t string").select(
            spoken_words("t")).first()[0]
        ref = r.w[:len(hyp)]
        want = min(distance(tuple(ref), tuple(hyp)) / len(ref), 1.0) if ref else float(bool(hyp))
        assert got[r.doc_id] == pytest.approx(want)
        checked += 1
    assert checked > 20
