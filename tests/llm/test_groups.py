"""Near-duplicates, metric join, search and components against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import hamming_search, metric_join, queries, setsketch
from folioscan.llm.components import components

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def roots_of(vertices, edges):
    parent = {v: v for v in vertices}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {v: root(v) for v in vertices}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)] + [(300, 301)],
    [(random.Random(3).randrange(90), i) for i in range(60)] + [(7, 3), (3, 7)]])
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long").repartition(3)
    got = {r.v: r.root for r in components(df).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == roots_of({v for e in real for v in e}, real)


def shingles(text, k):
    w = WORDS((text or "").translate(LOWER))
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(docs, k, percent=80):
    """component of each doc_id, and set sizes, by comparing all pairs."""
    sets = {d: shingles(t, k) for d, t in docs.items()}
    items = [(d, s) for d, s in sets.items() if s]
    edges = [(a, b) for i, (a, x) in enumerate(items) for b, y in items[:i]
             if 100 * len(x & y) >= percent * len(x | y)]
    return roots_of(docs, edges), {d: len(s) for d, s in sets.items()}


def copies(seed, n):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(150)]
    texts = ["", None, " \n\t ", "one", "ONE", "one two", "one two", "é É", " ".join(base), " ".join(base).upper()]
    for i in range(n):
        words = list(base)
        for _ in range(rnd.randrange(14)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10_000)}"
        texts.append(rnd.choice([" ", "\n", "\x0b "]).join(words))
    texts += [" ".join(f"u{i}_{j}" for j in range(30)) for i in range(20)]
    return dict(enumerate(texts))


@pytest.mark.parametrize("width, block", [(2, 256), (2, 7), (5, 256)])
def test_groups_equal_brute_force(spark, width, block):
    docs = copies(width, 70)
    made = [(d, t, 1, "z", "b") for d, t in docs.items()]
    df = spark.createDataFrame(made, "doc_id long, text string, component_id int, bands string, band string").repartition(4)
    settings = setsketch.Settings(width=width, block=block)
    got = {r.doc_id: r for r in setsketch.groups(df, settings).collect()}
    roots, sizes = near(docs, width)
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {
        d: (sizes[d], roots[d], roots[d] == d) for d in docs}


def test_groups_odd_rows(spark):
    text = "a b c d e f"
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in setsketch.groups(df).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (5, 5, True), (5, 5, True), (9, 5, False)], key=str)
    assert setsketch.groups(df.limit(0)).count() == 0


def test_op6_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    roots, sizes = near(docs, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op6(spark, SF).collect()}
    assert got == {d: (sizes[d], roots[d], roots[d] == d) for d in docs}


def test_sketches_merge_and_estimate():
    settings = setsketch.Settings()
    sketch = setsketch.Sketcher(settings)
    rng = np.random.default_rng(2)
    one = np.unique(rng.integers(0, 2 ** 63, 3000).astype(np.uint64))
    two = np.unique(np.concatenate([one[:2400], rng.integers(0, 2 ** 63, 600).astype(np.uint64)]))
    a, b, both = sketch([one, two, np.union1d(one, two)])
    assert (setsketch.merge(a, b) == both).all()
    true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
    j = setsketch.likely_jaccard(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([float(len(one))]),
                                 np.array([float(len(two))]), settings.registers, settings.base)
    assert abs(j[0] - true) < settings.margin


def cosines(vectors):
    x = np.array(vectors, float)
    n = np.linalg.norm(x, axis=1)
    return (x @ x.T) / (n[:, None] * n[None, :])


def clustered(seed, n, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    rows = [(centres[i % 8] + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.5])).astype(np.float32) for i in range(n)]
    return rows + [rows[0]] * 5 + [rows[1] * np.float32(3)]


ODD = [None, [], [0.0] * 12, [1.0, None] + [0.0] * 10, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [1.0, 2.0]]


@pytest.mark.parametrize("block", [8192, 23])
def test_metric_join_equals_brute_force(spark, block):
    vectors = clustered(1, 220)
    made = [(i * 3, v.tolist(), "x") for i, v in enumerate(vectors)] + [(1000 + i, v, "y") for i, v in enumerate(ODD)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>, n string").repartition(5)
    got = {r.vec_id: r for r in metric_join.range_join(df, 0.9, block=block).collect()}
    hit = cosines(vectors) >= 0.9
    np.fill_diagonal(hit, False)
    ids = [i * 3 for i in range(len(vectors))]
    roots = roots_of(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit))])
    for i, v in enumerate(ids):
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (hit[i].sum(), roots[v], roots[v] == v)
    for i in range(len(ODD)):
        r = got[1000 + i]
        assert (r.n_links, r.component_id, r.kept) == (0, 1000 + i, True)
    assert len(got) == len(made)
    assert metric_join.range_join(df.limit(0)).count() == 0


def test_visits_keep_every_link():
    rng = np.random.default_rng(4)
    x = np.array(clustered(7, 400), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = x[rng.choice(len(x), 9, replace=False)]
    home, near_cells = metric_join.visits(x, points, np.sqrt(0.2))
    for a, b in zip(*np.nonzero(x @ x.T >= 0.9)):
        low, high = (a, b) if home[a] <= home[b] else (b, a)
        assert home[low] == home[high] or near_cells[high, home[low]]


def test_op5_equals_brute_force(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(rows)
    hit = cosines([rows[i] for i in ids]) >= 0.9
    np.fill_diagonal(hit, False)
    got = {r.vec_id: r.n_links for r in queries.op5(spark, SF).collect()}
    assert got == {v: hit[i].sum() for i, v in enumerate(ids)}


def exact(ids, x, queries_, k):
    out = {}
    for q in queries_:
        i = ids.index(q)
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[q] = [(ids[j], score[j]) for j in order]
    return out


def test_search_ranks_as_brute_force_when_it_reranks_all(spark):
    vectors = clustered(3, 90)
    made = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(500 + i, v) for i, v in enumerate(ODD)] + [(None, [1.0] * 12)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>").repartition(3)
    settings = hamming_search.Settings(wanted=1000, shard=30, queries=4, sample=50)
    got = hamming_search.search(df, F.col("vec_id") % 10 == 0, settings).collect()
    want = exact(list(range(len(vectors))), np.array(vectors, float), range(0, len(vectors), 10), 20)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == want.keys()
    for q in want:
        assert [v for v, _ in found[q]] == [v for v, _ in want[q]]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)
    few = hamming_search.search(df.filter("vec_id < 5"), F.lit(True)).collect()
    assert len(few) == 5 * 4
    assert hamming_search.search(df.limit(0), F.lit(True)).count() == 0


def test_every_code_within_the_radius():
    codes = np.random.default_rng(5).integers(0, 256, (500, 6)).astype(np.uint8)
    codes[:40] = codes[0] ^ np.array([1, 0, 0, 2, 0, 0], np.uint8)
    index = hamming_search.MultiIndex(codes)
    for wanted in (1, 30, 120, 499, 500, 900):
        rows = index.within(codes[3], wanted)
        far = index.distances(codes[3])
        assert len(rows) >= min(wanted, 500) and len(set(rows.tolist())) == len(rows)
        assert set(np.flatnonzero(far < far[rows].max())) <= set(rows.tolist())


def test_op8_recall(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(rows)
    want = exact(ids, np.array([rows[i] for i in ids], float), [i for i in ids if i % 20 == 0], 20)
    got = queries.op8(spark, SF).collect()
    hit = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got)
    assert len(got) == 20 * len(want) and hit >= 0.9 * len(got)


def test_clustered_queries_are_answered_by_probing(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 32))
    vectors = np.concatenate([c + 0.06 * rng.normal(size=(250, 32)) for c in centres])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.concatenate([vectors, rng.normal(size=(20, 32)) * 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    asked = range(0, len(vectors), 20)
    want = exact(list(range(len(vectors))), vectors, asked, 20)
    # Small units, so that the buckets of the clusters are split.
    for settings in (hamming_search.Settings(), hamming_search.Settings(unit=64, pairs=1000)):
        got = hamming_search.search(df, F.col("vec_id") % 20 == 0, settings).collect()
        assert len(got) == len({(r.query_id, r.vec_id) for r in got}) == 20 * len(asked)
        assert len({r.query_id for r in got if r.probed}) >= 0.9 * len(asked)
        assert sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got) >= 0.9 * len(got)
        scores = {q: dict(v) for q, v in want.items()}
        assert all(r.score == pytest.approx(scores[r.query_id][r.vec_id], abs=1e-12) for r in got if r.vec_id in scores[r.query_id])


def test_wide_probes_find_every_code_within_the_radius():
    rng = np.random.default_rng(9)
    settings = hamming_search.Settings(k=1000, pairs=50)
    code = rng.integers(0, 256, (300, 3)).astype(np.int32)
    code[100:] = code[:200] ^ (1 << rng.integers(0, 8, (200, 3))) * rng.integers(0, 2, (200, 3))
    code = code.astype(np.int32)
    ids, vector = np.arange(300), rng.normal(size=(300, 4))
    masks = [0, *(1 << b for b in range(8))]
    found, counts = [], np.zeros(300, int)
    for part in range(3):
        rows = {"value": code[:, part], "id": ids, "code": code, "vector": vector}
        asked = {k: np.repeat(v, 9, axis=0) for k, v in rows.items()}
        asked["value"] = asked["value"] ^ np.tile(masks, 300)
        for query, near_id, _, codes in hamming_search.meet(part, rows, asked, 5, settings):
            found += list(zip(query.tolist(), near_id.tolist()))
            np.add.at(counts, query, codes)
    apart = np.bitwise_count(code[:, None] ^ code[None]).sum(axis=2)
    want = {(a, b) for a, b in np.argwhere(apart <= 5).tolist() if a != b}
    assert len(found) == len(set(found)) and set(found) == want and counts.sum() == len(want)


def test_doubles_keep_their_digits_and_range(spark):
    # Cosine just above the threshold in doubles, just below it as floats; equal vectors too large for floats.
    c = 0.9 + 2.4e-10
    rows = [(1, [1.0, 0.0]), (2, [c, float(np.sqrt(1 - c * c))]), (3, [0.0, -1e39]), (4, [0.0, -1e39]), (5, [0.0, -1e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.range_join(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3)}
    top = hamming_search.search(df.filter("vec_id > 1"), F.col("vec_id") == 3).collect()
    assert [(r.rank, r.vec_id) for r in sorted(top, key=lambda r: r.rank)][:1] == [(1, 4)]
    assert [metric_join.how_many(n, 8192) for n in (1, 2000, 50_000, 10 ** 6, 10 ** 9)] == [1, 7, 15, 123, 4096]
