import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.functions import words as W
from folioscan.functions.text import spoken_words


def distance(a, b):
    """Shortest edit path, by memoised recursion."""
    from functools import cache

    @cache
    def d(i, j):
        if not i or not j:
            return i + j
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1,
                   d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    return d(len(a), len(b))


@pytest.mark.parametrize("ref, hyp, want", [
    ("a b c", "a x c", 1 / 3), ("a b c d", "a b c", 1 / 4), ("", "", 0.0),
    ("", "spurious words", 1.0), ("alpha beta gamma", "", 1.0), ("a", "a b c d e f g", 1.0),
])
def test_error_rate(one, ref, hyp, want):
    assert one(W.text_error_rate, r=ref, h=hyp) == pytest.approx(want)


def edits(a, b):
    """Least distance, and the numbers of substitutions that the ways of that length have."""
    table = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [(0, {0})] if not i and not j else []
            if i and j:
                other = a[i - 1] != b[j - 1]
                d, swaps = table[i - 1, j - 1]
                ways.append((d + other, {s + other for s in swaps}))
            if i:
                ways.append((table[i - 1, j][0] + 1, table[i - 1, j][1]))
            if j:
                ways.append((table[i, j - 1][0] + 1, table[i, j - 1][1]))
            least = min(d for d, _ in ways)
            table[i, j] = least, set().union(*(s for d, s in ways if d == least))
    return table[len(a), len(b)]


def test_errors_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(150):
        vocab = [f"w{k}" for k in range(rnd.choice([1, 2, 10, 300]))]
        rows.append((i, [rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))],
                     [rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))]))
    df = spark.createDataFrame(rows + [(-1, None, ["a"]), (-2, ["a"], None)], "i int, r array<string>, h array<string>")
    got = {r.i: r for r in df.select("i", W.word_errors(F.col("r"), F.col("h")).alias("e")).select("i", "e.*").collect()}
    assert got[-1].distance is None and got[-2].distance is None
    for i, r, h in rows:
        e, (least, swaps) = got[i], edits(r, h)
        assert e.distance == least == distance(tuple(r), tuple(h)) and e.substitutions in swaps
        assert e.substitutions + e.insertions + e.deletions == least and min(e.insertions, e.deletions) >= 0
        assert e.insertions - e.deletions == len(h) - len(r)


def damaged(n, vocabulary, rate, seed=5):
    """Word ids, and the same with errors of all kinds."""
    rnd = np.random.default_rng(seed)
    ids = rnd.integers(0, vocabulary, n)
    kind = rnd.choice(4, n, p=[1 - rate, rate / 3, rate / 3, rate / 3])
    out = np.where(kind == 1, -5, ids)
    keep = np.where(kind == 2, 0, np.where(kind == 3, 2, 1))
    return ids, np.repeat(out, keep), kind


def test_many_pairs_count_as_each_alone():
    """Pairs that share bands give the counts of each alone, ties included, in a fraction of the time."""
    rnd = np.random.default_rng(3)
    pairs = [damaged(rnd.integers(0, 150), rnd.choice([1, 3, 50, 1000]), rnd.choice([0, .1, .5]), k)[:2] for k in range(600)]
    pairs += [(a, pairs[k - 1][1]) for k, (a, _) in enumerate(pairs[:200])]
    pairs += [(np.arange(6000), np.delete(np.arange(6000), [5, 3000])), (np.arange(0), np.arange(3)), (np.arange(3), np.arange(0))]
    started = time.perf_counter()
    got = W.many_edit_counts(pairs)
    middle = time.perf_counter()
    want = [W.edit_counts(a, b) for a, b in pairs]
    ended = time.perf_counter()
    assert [tuple(r) for r in got.tolist()] == want
    assert middle - started < (ended - middle) / 2


def test_long_texts():
    """The band follows the errors: 100,000 words with 5 % of them wrong take a second or so."""
    ref, hyp, kind = damaged(100_000, 20_000, 0.05)
    start = time.time()
    d, swaps, added, dropped = W.edit_counts(ref, hyp)
    assert time.time() - start < 5
    assert 0.97 * (kind > 0).sum() < d <= (kind > 0).sum()
    assert swaps + added + dropped == d and added - dropped == len(hyp) - len(ref)
    alike = np.zeros(300_000, int)
    assert W.edit_counts(alike, alike[:200_000]) == (100_000, 0, 0, 100_000)


def test_millions_of_distinct_words(spark):
    """One pair with over two million distinct words, in Arrow and exact."""
    n = 2_100_000
    words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string"))
    heard = F.filter(words, lambda w: ~w.isin("17", "1500000"))
    e = spark.range(1).select(W.word_errors(words, F.concat(heard, F.array(F.lit("end")))).alias("e")).first().e
    assert (e.distance, e.deletions, e.insertions) == (3, 2, 1)


def test_both_ways_agree(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, [f"w{rnd.randrange(9)}" for _ in range(rnd.randrange(40))],
             [f"w{rnd.randrange(9)}" for _ in range(rnd.randrange(40))]) for i in range(80)] + [(-1, None, [])]
    df = spark.createDataFrame(rows, "i int, r array<string>, h array<string>")
    got = []
    for cells in (0, 200, 1 << 20):
        monkeypatch.setattr(W, "SHORT_CELLS", cells)
        got.append({r.i: r.d for r in df.select("i", W.word_distance(F.col("r"), F.col("h")).alias("d")).collect()})
    assert got[0] == got[1] == got[2] == {i: distance(tuple(r), tuple(h)) if r is not None else None for i, r, h in rows}


def test_boundary(one):
    script = "one two three four five six"
    for hyp, side, want in (("ONE two!", "head", "one two"), ("five six", "tail", "five six"),
                            ("", "tail", ""), ("x " * 9, "tail", script)):
        got = one(lambda s, h, k=side: F.array_join(W.boundary_words(
            spoken_words(s), spoken_words(h), k), " "), s=script, h=hyp)
        assert got == want


def test_truncated_tail(spark):
    from folioscan.operators.fidelity import window_errors
    df = spark.createDataFrame([(1, "the chapter ends with these final closing words", "ends with these")],
                               "i int, s string, h string")
    row = window_errors(df, F.col("s"), F.col("h"), "tail", "i").first()
    assert row.wer > 0.3 and (row.ref_words, row.hyp_words) == (3, 3)


def test_fidelity(spark):
    from folioscan.operators.fidelity import fidelity_check
    text = "a b c d e f g h"
    rows = [(1, text, "a b", "g h", 60.0), (2, text, "a b", "x y", 60.0),
            (3, text, "", "g h", 60.0), (4, text, "a b", "g h", 0.0), (5, text, "a b", "g h", 6.0)]
    out = {r.id: r for r in fidelity_check(spark.createDataFrame(
        rows, "id int, script string, head_hyp string, tail_hyp string, duration_s double")
    ).collect()}
    assert (out[1].suspect, out[1].reason) == (False, "below thresholds")
    assert out[2].reason == "tail WER 1.00"
    assert (out[3].suspect, out[3].empty_transcript) == (False, True)
    assert out[4].reason == "head WER 1.00, tail WER 1.00, duration ratio 0.00"
    assert out[5].reason == "duration ratio 0.10"


def test_fidelity_ledger(spark):
    """Three retries, the best recording restored; a pass after a retry is resolved once."""
    from folioscan.operators.fidelity import fidelity_ledger
    text = "a b c d e f g h i j"
    heard = {0.0: "a b c d e", 0.4: "a b c x y", 0.6: "a b x y z", 1.0: "v w x y z"}

    def chapter(no, rates):
        return [(no, i, text, heard[w], "h i j", 60.0) for i, w in enumerate(rates)]

    rows = chapter(1, [0.6, 0.4, 1.0, 0.4, 1.0]) + chapter(2, [0.4, 0.0, 0.4, 0.0]) + chapter(3, [0.0])
    df = spark.createDataFrame(rows, "c int, n int, script string, head_hyp string, tail_hyp string, duration_s double")
    got = {}
    for r in sorted(fidelity_ledger(df, ["c"], ["n"]).collect(), key=lambda r: (r.c, r.n)):
        got.setdefault(r.c, []).append((r.action, r.remaining, r.kept_n, r.flag))
    assert got[1] == [("retry", 2, None, None), ("retry", 1, None, None), ("retry", 0, None, None),
                      ("exhausted", 0, 1, "WER 0.40 exceeds 0.30 after 3 attempts"), ("beyond_budget", 0, 1, None)]
    assert got[2] == [("retry", 2, None, None), ("resolved", 2, 1, "WER 0.00 within 0.30 after re-chunk"),
                      ("retry", 1, None, None), ("pass", 1, 3, None)]
    assert got[3] == [("pass", 3, 0, None)]
