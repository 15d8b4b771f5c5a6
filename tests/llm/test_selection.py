"""Hard negatives, importance resampling and line dedup against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import hard_negatives, line_dedup, resampling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# Hard negatives

def mined(rows, anchors, s):
    """anchor, positive, rank, negative and both scores, by comparing all rows."""
    whole = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x * s.scale) for x in v):
            continue
        whole[(i, label, tuple(math.floor(s.scale * x) for x in v))] = None
    out = []
    for a in sorted({i for i, _, _ in whole if i in anchors}):
        _, label, vector = min(k for k in whole if k[0] == a)
        scored = defaultdict(set)
        for i, other, v in whole:
            if len(v) == len(vector):
                scored[other == label].add((-sum(x * y for x, y in zip(v, vector)), i))
        for p, i in sorted(x for x in scored[True] if x[1] != a)[:s.positives]:
            near = [x for x in sorted(scored[False]) if s.low * -p <= 100 * -x[0] <= s.high * -p][:s.negatives]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(near)]
    return sorted(out)


def vectors(seed, n, d=4):
    rnd = random.Random(seed)
    rows = [(i - 20, rnd.randrange(3), [round(rnd.uniform(-0.4, 1), 1) for _ in range(d)]) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(500, 1, None), (501, None, [1.0] * d), (None, 1, [1.0] * d), (502, 1, [1.0, None, 0.0, 0.0]),
             (503, 0, [nan] * d), (504, 0, [1.0, inf, 0.0, 0.0]), (505, 2, []), (510, 2, []), (515, 0, []), (520, 1, [0.0] * d),
             (525, 1, [0.0] * d), (526, 2, [0.0] * d), (530, 0, [1.0, 2.0]), (535, 0, [1.5, 2.0]), (536, 1, [1.0, 1.5])]
    # A row repeated many times, one id with several vectors, and equal vectors under several ids.
    rows += [(600, 0, [0.9, 0.9, 0.8, 0.1])] * 150 + [(601, k % 2, [0.1 * k, 0.9, 0.5, 0.2]) for k in range(12)]
    rows += [(700 + k, k % 3, [0.7, 0.7, 0.7, 0.7]) for k in range(30)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk, shard, block", [(8192, 16384, 16384), (7, 40, 9)])
def test_mined_equals_brute_force(spark, chunk, shard, block):
    s = hard_negatives.Settings(chunk=chunk, shard=shard, block=block, strip=5)
    rows = vectors(chunk, 160)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    df = df.withColumns({"score": F.lit("x"), "shard": F.lit(1), "anchor_id": F.lit(None).cast("int")})
    got = hard_negatives.mine(df, F.col("vec_id") % 5 == 0, s)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows, {i for i, _, _ in rows if i is not None and i % 5 == 0}, s)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_large_components_stay_exact(spark):
    rows = [(k, k % 2, [float(2 ** 21 + k), float(3 * k)]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    s = hard_negatives.Settings(low=0, high=100)
    got = hard_negatives.mine(df, F.col("vec_id") == 10, s)
    assert sorted(map(tuple, got.collect())) == mined(rows, {10}, s)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(df, F.lit(True)).count() == 0


def test_keys_sort_like_their_values():
    rnd = random.Random(2)
    big = (1 << 61) - 1
    rows = [(rnd.choice([-5, 0, 3, big]), rnd.choice([-big, -1, 0, 7, big]), rnd.choice([-9, 0, 12])) for _ in range(300)]
    keys = hard_negatives.pack_keys(*(np.array(c) for c in list(zip(*rows))[:2]), 1, np.array([r[2] for r in rows]))
    anchors, scores, kinds, ids = hard_negatives.unpack_keys(keys)
    assert list(zip(anchors, scores, ids)) == rows and set(kinds) == {1}
    order = sorted(range(300), key=lambda i: (rows[i][0], -rows[i][1], rows[i][2]))
    assert [rows[i] for i in order] == [rows[i] for i in sorted(range(300), key=lambda i: (keys[i].as_py(), i))]


# Importance resampling

def features(text, width=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]


def resampled(docs, target, s):
    def count(texts):
        out = defaultdict(int)
        for t in texts:
            for f in features(t, s.width)[1]:
                out[crc32(f.encode()) % s.buckets] += 1
        return out, sum(out.values())

    (source, S), (aim, T) = count(t for _, t in docs), count(target)
    gain = [math.floor(s.scale * math.log((aim[b] + 1) * (S + s.buckets) / ((source[b] + 1) * (T + s.buckets))))
            for b in range(s.buckets)]
    rows, able = [], []
    for i, t in docs:
        words, fs = features(t, s.width)
        weight = sum(gain[crc32(f.encode()) % s.buckets] for f in fs) // len(fs) if fs else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{s.seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-s.scale * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words) >= s.least_words:
                able.append((-score, i))
        rows.append((i, len(fs), weight, score))
    drawn = sorted(able)[: len(able) * s.percent // 100]
    return rows, drawn


def texts(seed, n):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "İx", "ÄÖ", "42", "c-d", "e\x00f", "g'h", "日本", "zulu", "QUEBEC"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(60)))) for i in range(n)]
    docs += [(900, ""), (901, None), (902, " .,! \n"), (903, "Word " * 20_000), (-4, "beta " * 30), (None, "beta " * 30),
             (None, None)]
    return docs, [None, "", "beta alpha", "日本 zulu " * 9]


@pytest.mark.parametrize("s", [
    resampling.Settings(), resampling.Settings(buckets=50, least_words=5, percent=60, width=3),
    resampling.Settings(scale=1, buckets=3, least_words=1, percent=37)])
def test_resample_equals_brute_force(spark, s):
    docs, target = texts(s.buckets, 400)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    df = df.withColumns({"score": F.lit("x"), "buckets": F.lit(1), "rank": F.lit(None).cast("string")})
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), s).collect()
    rows, drawn = resampled(docs, target, s)
    plain = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted([tuple(r)[:4] for r in got], key=plain) == sorted(rows, key=plain)
    assert {(r.rank, -r.score, r.doc_id) for r in got if r.rank is not None} == {
        (k + 1, *d) for k, d in enumerate(drawn)} and len(drawn) > 50


def test_alike_rows_are_drawn_one_by_one(spark):
    """All rows tie in score and id: a share of them is drawn, with ranks of their own."""
    df = spark.createDataFrame([(5, "w " * 25)] * 90, "doc_id long, text string").repartition(4)
    got = resampling.resample(df, spark.createDataFrame([("w",)], "text string")).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 23)) and len(got) == 90


def test_cutoff(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([-2 ** 62, -7, 0, 3, 2 ** 62]), rnd.randrange(-50, 50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for wanted in (1, 7, 250, 499, 500):
        values = resampling.cutoff(df, wanted, ["a", "b", "c"])
        taken = df.filter(resampling.up_to(["a", "b", "c"], values)).collect()
        assert sorted(map(tuple, taken)) == sorted(rows)[:wanted]


def test_resample_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none.select("text")).count() == 0
    some = spark.createDataFrame([(1, "a b " * 20)] , "doc_id long, text string")
    row = resampling.resample(some, none.select("text"), resampling.Settings(percent=100)).first()
    assert row["n_features"] == 79 and row["rank"] == 1


# Line dedup

def deduplicated(docs, s):
    held = defaultdict(set)
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(blank).translate(LOWER)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= s.least_chars:
                held[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = [i is not None and len(held[key(x)]) >= s.least_docs and i != max(held[key(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def paragraphs(seed, n):
    rnd = random.Random(seed)
    common = [f"line number {k:03d} of the common stock" for k in range(25)] + [
        "ÄRGER ÜBER GROSSE BUCHSTABEN", "ärger über grosse buchstaben", "short", "exactly twenty chars", "nineteen characters",
        "İstanbul'da bir satır daha", ""]

    def line():
        x = rnd.choice(common) if rnd.random() < 0.6 else f"a line of its own, {rnd.randrange(10 ** 9)}"
        x = rnd.choice([str, str.upper, str.title])(x) if x.isascii() else x
        return rnd.choice(["", " ", "\t\x0b"]) + x + rnd.choice(["", "\r", " \x0c", " "])

    docs = [(i - 5, "\n".join(line() for _ in range(rnd.randrange(30)))) for i in range(n)]
    hot = "this very line stands in every document"
    docs += [(1000 + i, f"{hot}\n{i}\n{hot}\n") for i in range(300)]
    docs += [(2000, None), (2001, ""), (2002, "\n\n"), (None, hot), (None, None), (2003, "x" * 300_000 + "\n" + hot)]
    # One id with several texts, rows repeated whole, and one document that repeats a line very often.
    docs += [(2004, hot + "\nsecond"), (2004, "first\n" + hot), (3, hot)] + [(7, f"{hot}\nagain\n{hot}")] * 40
    docs += [(2010, "\n".join(["many times in a single document"] * 3000)), (8, "many times in a single document")]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("s", [line_dedup.Settings(), line_dedup.Settings(least_chars=4, least_docs=2)])
def test_line_dedup_equals_brute_force(spark, s):
    docs = paragraphs(s.least_docs, 120)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    df = df.withColumns({c: F.lit("x") for c in ("text_key", "pos", "keep", "n_lines", "top", "block")})
    bitmaps = line_dedup.keep_bitmaps(df, s)
    got = line_dedup.apply(df, bitmaps, out="kept")
    plain = lambda r: tuple((x is not None, str(x)) for x in r)
    assert set(df.columns) | {"kept", "n_dropped"} == set(got.columns)
    rows = [tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept").collect()]
    want = deduplicated(docs, s)
    assert sorted(rows, key=plain) == sorted(want, key=plain)
    # Only documents that lose lines have a bitmap, and its runs are apart.
    for r in bitmaps.collect():
        assert r.n_dropped > 0 and sum(x.length for x in r.keep) == r.n_lines - r.n_dropped
        assert all(a.start + a.length < b.start for a, b in zip(r.keep, r.keep[1:]))


def test_line_dedup_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.apply(df, line_dedup.keep_bitmaps(df)).count() == 0


def test_line_dedup_is_native(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    plan = line_dedup.apply(df, line_dedup.keep_bitmaps(df))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
