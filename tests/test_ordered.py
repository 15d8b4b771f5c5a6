"""Running values and packing when one group holds most rows and spans many blocks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscan.operators.assemble import assemble
from folioscan.operators.ordered import BLOCK, Running, numbered, ordered
from folioscan.operators.packing import pack_parts
from folioscan.operators.skew import lookup


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(200)}", i, rnd.randrange(-50, 50))
            for i in range(4000)]
    return spark.createDataFrame(rows, "k string, n int, v int").repartition(6)


def test_hot_group_spans_blocks(skewed):
    sheet = ordered(skewed, ["k"], ["n"])
    assert {r.k for r in sheet.blocks.select("k").distinct().collect()} == {"hot"}
    assert sheet.plain.filter("k = 'hot'").isEmpty() and not sheet.plain.isEmpty()
    sizes = [r["count"] for r in sheet.blocks.groupBy(BLOCK).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1200


@pytest.mark.parametrize("before", [False, True])
def test_running_equals_window(skewed, before):
    values = [Running("c", "count", before=before),
              Running("s", "sum", F.col("v"), before),
              Running("hi", "max", F.when(F.col("v") > 40, F.col("v")), before),
              Running("lo", "min", F.col("v"), before)]
    got = ordered(skewed, ["k"], [F.col("n").desc()]).running(*values).result()
    w = Window.partitionBy("k").orderBy(F.col("n").desc()).rowsBetween(
        Window.unboundedPreceding, -1 if before else 0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    want = skewed.select(
        "*", F.count(F.lit(1)).over(w).alias("c"), zero(F.sum("v").over(w)).alias("s"),
        F.max(F.when(F.col("v") > 40, F.col("v"))).over(w).alias("hi"),
        F.min("v").over(w).alias("lo"))
    assert sorted(got.collect(), key=lambda r: r.n) == sorted(
        want.select(got.columns).collect(), key=lambda r: r.n)


def test_running_can_follow_running(skewed):
    run = ordered(skewed, ["k"], ["n"]).running(Running("pos", "count")).running(
        Running("last", "max", F.when(F.col("v") > 0, F.col("pos")), before=True)).result()
    by_key = {}
    for r in sorted(run.collect(), key=lambda r: r.n):
        rows = by_key.setdefault(r.k, [])
        assert r.pos == len(rows) + 1
        assert r["last"] == max((i + 1 for i, v in enumerate(rows) if v > 0), default=None)
        rows.append(r.v)


def test_numbering_over_all_rows(skewed):
    got = numbered(skewed, [], [F.col("v").desc(), "n"], "rank", start=0).collect()
    want = sorted(got, key=lambda r: (-r.v, r.n))
    assert [r.rank for r in want] == list(range(4000))


def test_null_group(spark):
    rows = [(None, i) for i in range(300)] + [("a", i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, n int")
    got = numbered(df, ["k"], ["n"], "pos").collect()
    assert all(r.pos == r.n + 1 for r in got)


def parts_of(durations, limit):
    parts, used = [], None
    for d in durations:
        ms = int(max(d or 0, 0) * 1000)
        if used is None or used + ms > limit * 3_600_000:
            parts.append([])
            used = 0
        used += ms
        parts[-1].append(d)
    return [len(p) for p in parts]


@pytest.mark.parametrize("name, hours", [("mixed", 14.0), ("tiny", 14.0), ("large", 1.0),
                                         ("edge", 2.0)])
def test_pack_hot_book(spark, name, hours):
    rnd = random.Random(name)
    draw = {"mixed": lambda: rnd.choice([None, 0.0, rnd.uniform(1, 9000), 90_000.0]),
            "tiny": lambda: rnd.uniform(0, 3),
            "large": lambda: rnd.uniform(3000, 9000),
            "edge": lambda: rnd.choice([1800.0, 3600.0, 7200.0, 0.0])}[name]
    books = {"hot": 1500, "b": 200, "c": 1}
    rows = [(b, i, draw()) for b, n in books.items() for i in range(n)]
    df = spark.createDataFrame(rows, "book string, n int, d double").repartition(5)
    got = pack_parts(df, ["book"], ["n"], "d", hours).collect()
    assert len(got) == len(rows)
    for book in books:
        mine = sorted((r for r in got if r.book == book), key=lambda r: r.n)
        numbers = [r.part_no for r in mine]
        assert numbers == sorted(numbers) and numbers[0] == 1
        sizes = [numbers.count(p) for p in dict.fromkeys(numbers)]
        assert list(dict.fromkeys(numbers)) == list(range(1, len(sizes) + 1))
        assert sizes == parts_of([r.d for r in mine], hours)


def test_pack_literal(spark):
    hour = 3600.0
    for hours, limit, want in (([2, 2, 2], 5, [2, 1]), ([20], 15, [1]), ([1, None, 1], 2, [3])):
        rows = [("b", i, None if h is None else h * hour) for i, h in enumerate(hours)]
        df = spark.createDataFrame(rows, "book string, n int, d double")
        got = sorted(pack_parts(df, ["book"], ["n"], "d", limit).collect(), key=lambda r: r.n)
        numbers = [r.part_no for r in got]
        assert [numbers.count(p) for p in sorted(set(numbers))] == want


def test_assemble_has_one_shape_at_every_size(spark):
    rows = [("big", i, f"piece{i:05d}") for i in range(20_000)] + [("small", 1, "b"), ("small", 0, "a")]
    df = spark.createDataFrame(rows, "k string, n int, t string").repartition(4)
    got = {r.k: r for r in assemble(df, ["k"], ["n"], "t", "-").collect()}
    assert len(got) == 2 and got["small"].t == "a-b" and got["small"].n_pieces == 2
    assert got["big"].t == "-".join(f"piece{i:05d}" for i in range(20_000))


def test_lookup_takes_hot_keys_aside(spark):
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(6000)] + [(None, -1)]
    left = spark.createDataFrame(rows, "k string, n int").repartition(4)
    right = spark.createDataFrame([(k, k + "!") for k in ["hot", "k0", "k3", "zz"]],
                                  "k string, v string")
    split = lookup(left, right, ["k"], plain_rows=0)
    assert sorted(split.collect(), key=lambda r: r.n) == sorted(
        left.join(right, "k", "left").collect(), key=lambda r: r.n)
    assert "Union" in split._jdf.queryExecution().optimizedPlan().toString()
