"""Packing against brute force on random texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from folioscan.functions import segment as G


def texts(seed, n=60, alphabet="abcé .!?;,\n"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 400)))
            for _ in range(n)]


def greedy(items, fits):
    """Groups of consecutive items; ``fits(group + [item])`` says whether the item may join."""
    groups = []
    for item in items:
        if groups and fits(groups[-1] + [item]):
            groups[-1].append(item)
        else:
            groups.append([item])
    return groups


def size(text, unit):
    return len(text.encode()) if unit == "bytes" else len(text)


def cut_word(word, limit, unit):
    return ["".join(g) for g in greedy(word, lambda g: size("".join(g), unit) <= limit)]


def cut_sentence(sentence, limit, unit):
    out, line = [], []
    for word in sentence.split():
        if size(" ".join(line + [word]), unit) <= limit:
            line.append(word)
            continue
        out += [" ".join(line)] if line else []
        giant = size(word, unit) > limit
        out += cut_word(word, limit, unit) if giant else []
        line = [] if giant else [word]
    return out + ([" ".join(line)] if line else [])


def cut_batches(sentences, limit, unit):
    out, line = [], None
    for s in sentences:
        if size(s, unit) > limit:
            out += [line] if line is not None else []
            out += cut_sentence(s, limit, unit)
            line = None
        elif line is not None and size(line + " " + s, unit) <= limit:
            line = line + " " + s
        else:
            out += [line] if line is not None else []
            line = s
    return out + ([line] if line is not None else [])


def test_sentences(many):
    assert many(G.sentences, ["One. Two?Three;  four", " . x", "", "  \n "]) == [
        ["One.", "Two?", "Three;", "four"], [" .", "x"], [], []]


def test_merge_short(one):
    from pyspark.sql import functions as F
    parts = ["This is a test.", "Short.", "Another test sentence."]
    merged = one(lambda t: G.merge_short(F.split(t, "#"), 10), t="#".join(parts))
    assert merged == ["This is a test. Short.", "Another test sentence."]
    lead = one(lambda t: G.merge_short(F.split(t, "#"), 10), t="Hi.#" + parts[0])
    assert lead == [parts[0]]
    kept = one(lambda t: G.merge_short(F.split(t, "#"), 10, True), t="Hi.#Yo.#" + parts[0])
    assert kept == ["Hi. Yo.", parts[0]]


def test_split_long(many):
    long = "This is a very long sentence that needs to be broken into smaller parts."
    assert many(lambda t: G.split_at_words(t, 50), [long]) == [
        ["This is a very long sentence that needs to be", "broken into smaller parts."]]
    for text, got in zip(texts(1), many(lambda t: G.split_at_words(t, 20), texts(1))):
        assert " ".join(got).split() == text.split()
        assert all(len(p) <= 20 or " " not in p for p in got)


def cut_chars(text, limit):
    out, look = [], limit // 5
    while len(text) > limit:
        stops = [i for i in range(limit - look, limit) if text[i] in "。！？；：.!?;:¿¡"]
        end = max(stops) + 1 if stops else limit
        out.append(text[:end].strip())
        text = text[end:]
    return out + ([text.strip()] if text else [])


def test_split_cjk(many):
    samples = texts(2, alphabet="中文字。！国語 ")
    assert many(lambda t: G.split_at_chars(t, 30), samples) == [cut_chars(t, 30) for t in samples]
    assert many(G.unspaced_cjk, ["中文", "abc", "a b c 中"]) == [True, False, False]


def test_pipeline(many):
    assert many(lambda t: G.sentence_pipeline(t, 50, 10),
                ["This is a test. This is another test sentence."]) == [
        ["This is a test.", "This is another test sentence."]]


@pytest.mark.parametrize("unit", ["chars", "bytes"])
def test_batches(many, unit):
    from pyspark.sql import functions as F
    cases = {"aaaa#bbbb#cccc": (10, ["aaaa bbbb", "cccc"]), "aaaa#bbbb": (8, ["aaaa", "bbbb"])}
    for joined, (limit, want) in cases.items():
        assert many(lambda t, k=limit: G.batches(F.split(t, "#"), k, unit), [joined]) == [want]
    assert many(lambda t: G.batches(F.split(t, "#"), 9, unit), ["aaaa#bbbb"]) == [["aaaa bbbb"]]
    samples = texts(3, alphabet="abcdé# ")
    got = many(lambda t: G.batches(F.split(t, "#"), 12, unit), samples)
    assert got == [cut_batches(t.split("#"), 12, unit) for t in samples]


def test_batches_in_bytes(many):
    from pyspark.sql import functions as F
    assert many(lambda t: G.batches(F.split(t, "#"), 7, "bytes"), ["ração#ração"]) == [
        ["ração", "ração"]]


@pytest.mark.parametrize("unit", ["chars", "bytes"])
def test_split_oversized(many, unit):
    samples = ["abcdefghij", "ééééééé", *texts(4)]
    got = many(lambda t: G.split_oversized(t, 5, unit), samples)
    assert got == [cut_sentence(t, 5, unit) for t in samples]


def test_segments(many):
    samples = texts(5, alphabet="abcdefg   .")
    got = many(lambda t: G.segments(t, 40), samples)
    spoken = many(G.sentence_pipeline, samples)
    want = [[" ".join(g) for g in greedy(s, lambda g: len(" ".join(g)) <= 40)] for s in spoken]
    assert got == want


def test_chunks(many):
    two = " ".join(["w"] * 80) + "\n\n" + " ".join(["v"] * 80)
    fits = "one  two\n\nthree"
    huge = " ".join(map(str, range(250)))
    got = many(lambda t: G.chunk_paragraphs(t, 100), [two, fits, huge, fits + "\n\n" + huge])
    assert got[0] == two.split("\n\n")
    assert got[1] == [fits]
    assert [len(c.split()) for c in got[2]] == [100, 100, 50]
    assert [len(c.split()) for c in got[3]] == [3, 100, 100, 50]
    assert many(lambda t: G.chunk_fixed(t, 100), [huge, ""]) == [
        [" ".join(huge.split()[i:i + 100]) for i in (0, 100, 200)], []]


def test_shrink(one):
    assert [one(lambda a: G.shrink(4000, a), a=i) for i in (1, 2, 3, 30)] == [
        2000, 1333, 1000, 200]


def test_batch_totals_are_those_of_the_batches(spark):
    rnd = random.Random(8)
    rows = [(i, ["ç" * rnd.randint(0, 9) + " x" * rnd.randint(0, 14) for _ in range(rnd.randint(0, 12))])
            for i in range(60)]
    df = spark.createDataFrame(rows, "i int, s array<string>")
    for limit, unit in ((12, "chars"), (12, "bytes"), (300, "chars")):
        both = df.select(G.batches(F.col("s"), limit, unit).alias("b"),
                         G.batch_totals(F.col("s"), limit, unit).alias("t")).collect()
        assert [(r.t.requests, r.t.chars) for r in both] == [
            (len(r.b), sum(map(len, r.b))) for r in both]


# U+FFFF separates items; texts that hold it, and private characters, are cut alike.
ODD = "ab￿\U000F0000\U0010FFFD# ."


def test_separators_in_the_text(many):
    samples = texts(9, alphabet=ODD)
    split = lambda t: F.split(t, "#")
    for unit in ("chars", "bytes"):
        assert many(lambda t, u=unit: G.batches(split(t), 12, u), samples) == [
            cut_batches(t.split("#"), 12, unit) for t in samples]
    merged = [[" ".join(g) for g in greedy(t.split("#"), lambda g: len(g[-1]) < 5)] for t in samples]
    assert many(lambda t: G.merge_short(split(t), 5, True), samples) == merged
    packed = [["#".join(g).replace("#", " ") for g in greedy(
        [x for x in t.split("#") if x], lambda g: len(" ".join(g)) <= 9)] for t in samples]
    assert many(lambda t: G.pack(F.array_remove(split(t), ""), 9), samples) == packed


def test_limits_from_a_column(spark):
    rows = [(i, t, 3 + i % 9, ("chars", "bytes")[i % 2]) for i, t in enumerate(texts(11, alphabet="abé# "))]
    df = spark.createDataFrame(rows, "i int, t string, k int, u string").repartition(3)
    got = {r.i: r.b for r in df.select("i", G.batches(F.split("t", "#"), F.col("k"), F.col("u")).alias("b")).collect()}
    assert got == {i: cut_batches(t.split("#"), k, u) for i, t, k, u in rows}


def cut_paragraphs(text, n):
    out, line = [], []
    for words in (p.split() for p in text.split("\n\n") if p.strip()):
        if len(words) > n or len(line) + len(words) > n:
            out += [line] if line else []
            line = []
        if len(words) > n:
            out += [words[i:i + n] for i in range(0, len(words), n)]
        else:
            line = line + words
    chunks = [" ".join(x) for x in out + ([line] if line else [])]
    return [text] if len(text.split()) <= n else chunks


def test_chunks_brute_force(many):
    rnd = random.Random(12)
    samples = ["".join(rnd.choice(["w", "é", " ", "\n\n", "Pw "]) for _ in range(rnd.randrange(150))) for _ in range(80)]
    assert many(lambda t: G.chunk_paragraphs(t, 7), samples) == [cut_paragraphs(t, 7) for t in samples]


@pytest.mark.parametrize("name, cut", [
    ("segments", G.segments), ("batches", lambda t: G.batches(G.sentences(t), 300)),
    ("bytes", lambda t: G.batches(G.sentences(t), 300, "bytes")),
    ("chunks", lambda t: G.chunk_paragraphs(t, 2500, ". ")), ("oversized", lambda t: G.split_oversized(t, 50)),
    ("characters", lambda t: G.split_at_chars(F.replace(t, F.lit(" "), F.lit("")), 60))])
def test_time_grows_with_the_text(spark, name, cut):
    """Four times the sentences, up to a text of 10 MB, take far from sixteen times as long."""
    def seconds(n):
        df = spark.createDataFrame([("This is a sentence of some forty letters. " * n,)], "t string")
        start = time.time()
        assert df.select(F.size(cut(F.col("t"))).alias("n")).first().n > n // 1000
        return time.time() - start

    seconds(1000)
    small = seconds(60_000)
    assert seconds(240_000) < 8 * small + 2
