import itertools
import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators import ledger as L
from folioscan.operators import reconcile as R
from folioscan.operators import runs as U


def frames(spark, source, audio, book="b"):
    s = spark.createDataFrame([(book, i + 1, t) for i, t in enumerate(source)],
                              "book_id string, number long, title string")
    a = spark.createDataFrame([(book, i, t) for i, t in enumerate(audio)],
                              "book_id string, position long, title string")
    return s, a


def test_missing_and_extra(spark):
    s, a = frames(spark, ["One", "Two", "Three"], ["One", "three", "Credits"])
    aligned = R.align(s, a)
    assert [(r.number, r.title, r.expected_position) for r in R.missing(aligned).collect()] == [
        (2, "Two", 1)]
    assert [(r.number, r.title, r.position) for r in R.extra(aligned).collect()] == [
        (3, "credits", 2)]


def test_duplicate_titles(spark):
    titles = ["INTRODUCTION", "Introduction", "One", "Two", "Three", "Four"]
    s, a = frames(spark, titles, titles)
    row = R.verify_report(s, a).first()
    assert (row.matched, row.total_source, row.match_pct, row.missing) == (5, 6, 83.3, 0)


def test_order_violations_brute_force(spark):
    rnd = random.Random(11)
    source, audio, want = [], [], set()
    for b in range(30):
        order = rnd.sample(range(12), 12)
        source += [(f"b{b}", i + 1, f"t{i}") for i in range(12)]
        audio += [(f"b{b}", p, f"t{i}") for p, i in enumerate(order)]
        place = {i: p for p, i in enumerate(order)}
        want |= {(f"b{b}", j + 1) for i, j in itertools.combinations(range(12), 2)
                 if place[i] > place[j]}
    s = spark.createDataFrame(source, "book_id string, number long, title string")
    a = spark.createDataFrame(audio, "book_id string, position long, title string")
    got = {(r.book_id, r.number) for r in R.order_violations(R.align(s, a)).collect()}
    assert got == want


def test_grades(many):
    assert many(lambda t: R.grade(t.cast("double")), ["100", "95", "75", "50", "10"]) == [
        "PERFECT", "GOOD", "FAIR", "POOR", "CRITICAL"]
    assert many(lambda t: R.status_line(t.cast("double")), ["100", "90", "89.9"]) == [
        "PASS", "NEAR MISS", "FAIL"]
    assert many(lambda t: R.duration_class(t.cast("double")), ["0.4", "0.8", "1", "1.2", "2"]) == [
        "much_shorter", "shorter", "as_expected", "longer", "much_longer"]


def test_published_duration_ratio(spark):
    words = spark.createDataFrame([("b", 14538)], "book_id string, n_words long")
    audio = spark.createDataFrame(
        [("b", d) for d in (71.0, 72.0, 1252.0, 608.0, 576.0, 2486.6)],
        "book_id string, duration_s double")
    row = R.duration_hints(words, audio).first()
    assert row.expected_s == pytest.approx(11630.4)
    assert round(row.ratio, 2) == 0.44


def test_offsets(spark):
    df = spark.createDataFrame([("b", 1, 1.5), ("b", 2, 0.0), ("b", 3, 2.0)],
                               "book_id string, n int, duration_s double")
    got = sorted(R.offsets(df, ["n"]).collect(), key=lambda r: r.n)
    assert [(r.n, r.start_ms, r.end_ms) for r in got] == [(1, 0, 1500), (3, 1500, 3500)]


# --- retries ------------------------------------------------------------------------------------

def attempts(spark, cycles):
    rows = [(1, ch, cyc, i, i, bad, 0.9 - i / 100)
            for (ch, cyc), bads in cycles.items() for i, bad in enumerate(bads)]
    return spark.createDataFrame(rows, "book_id long, chapter_id long, cycle string, ts int, "
                                       "event_id int, failed boolean, wer double")


def test_retry_ledger(spark):
    first, _, third = L.K.CYCLES
    F_, T_ = True, False
    df = attempts(spark, {
        (1, third): [T_, T_], (2, third): [F_, F_, T_, T_, F_, T_],
        (3, third): [F_] * 5 + [T_], (4, first): [F_, T_, T_]})
    rows = sorted(L.retry_ledger(df).collect(), key=lambda r: (r.chapter_id, r.attempt_no))
    told = {k: [r.action for r in g] for k, g in itertools.groupby(
        rows, lambda r: r.chapter_id)}
    assert told == {
        1: ["pass", "pass"],
        2: ["retry", "retry", "resolved", "pass", "retry", "pass"],
        3: ["retry", "retry", "retry", "exhausted", "beyond_budget", "pass"],
        4: ["retry", "resolved", "resolved"]}
    assert [r.remaining for r in rows if r.chapter_id == 3] == [2, 1, 0, 0, 0, 0]
    verdicts = {r.chapter_id: r for r in L.chapter_verdicts(
        L.cycle_summary(L.retry_ledger(df))).collect()}
    assert {k: v.verdict for k, v in verdicts.items()} == {
        1: "clean", 2: "flagged", 3: "unrecoverable", 4: "flagged"}
    assert verdicts[4].best_wer is None and verdicts[1].best_wer == pytest.approx(0.89)


def test_quality_report(spark):
    import json
    df = attempts(spark, {(1, L.K.CYCLES[0]): [True, False], (1, L.K.CYCLES[2]): [True] * 4,
                          (2, L.K.CYCLES[1]): [False]})
    ledger = L.retry_ledger(df)
    chapters = L.per_chapter(L.cycle_summary(ledger), L.flag_entries(ledger))
    report = L.quality_report(chapters, F.concat(F.lit("T"), "chapter_id"), F.col("chapter_id") == 1)
    docs = {r.entry: json.loads(r.report) for r in report.collect()}
    assert docs["summary"] == {
        "pipeline_status": "partial", "episodes_synthesised": 1, "chapters_expected": 2,
        "verdict_counts": {"clean": 1, "flagged": 0, "unrecoverable": 1}}
    first, second = docs["chapter_1"], docs["chapter_2"]
    assert list(first) == ["title", "verdict", "attempts_used", "best_wer", "flags"]
    assert list(first["attempts_used"].items()) == [(L.K.CYCLES[0], 1), (L.K.CYCLES[2], 3)]
    assert [(f["exhausted"], f["reason"][:4]) for f in first["flags"]] == [(False, "verd"), (True, "WER ")]
    assert second["flags"] == [] and second["attempts_used"] == {} and second["best_wer"] is None
    whole = json.loads(L.report_documents(report).first().report)
    assert whole == {**docs["summary"], "chapters": {"chapter_1": first, "chapter_2": second}}
    told = {r.chapter_id: r.x for r in chapters.select("chapter_id", L.flag_details(
        F.col("flags"), F.col("cycles"), F.col("best_wer")).alias("x")).collect()}
    assert told[2] == "" and told[1].startswith(f"{L.K.CYCLES[0]} (resolved) — verdict clean; ")
    assert "3/3 attempts exhausted, best WER 0." in told[1]


def test_long_reports_come_in_ordered_parts(spark):
    import json
    df = attempts(spark, {(1, L.K.CYCLES[0]): [True, *[False] * 90], (1, L.K.CYCLES[1]): [True, *[False] * 7],
                          (2, L.K.CYCLES[1]): [False], **{(c, L.K.CYCLES[0]): [True, False] for c in range(3, 30)}})

    def made():
        ledger = L.retry_ledger(df)
        chapters = L.per_chapter(L.cycle_summary(ledger), L.flag_entries(ledger))
        report = L.quality_report(chapters, F.concat(F.lit("T"), "chapter_id"), F.lit(True))
        return chapters.collect(), [r.report for r in L.report_documents(report).collect()]

    whole, documents = made()
    assert len(whole) == 29 and len(documents) == 1
    spark.conf.set("spark.folioscan.partRows", "10")
    spark.conf.set("spark.folioscan.partChars", "1000")
    try:
        rows, parts = made()
    finally:
        spark.conf.unset("spark.folioscan.partRows")
        spark.conf.unset("spark.folioscan.partChars")
    one = sorted((r for r in rows if r.chapter_id == 1), key=lambda r: r.part)
    assert [len(r.flags) for r in one] == [10] * 9 + [7] and len(rows) == 38
    assert [f for r in one for f in r.flags] == next(r.flags for r in whole if r.chapter_id == 1)
    # Documents are whole, bounded and numbered; together they say what the long one says.
    read = sorted((json.loads(p) for p in parts), key=lambda d: d.get("part", 1))
    assert [d.get("part", 1) for d in read] == list(range(1, len(parts) + 1)) and max(map(len, parts)) < 2500
    full = json.loads(documents[0])
    got = {k: v for d in read for k, v in d["chapters"].items()}
    flags = [f for k, v in got.items() if k == "chapter_1" or k.startswith("chapter_1_part_") for f in v["flags"]]
    assert flags == full["chapters"]["chapter_1"]["flags"] and len(flags) == 97
    assert {k: v for k, v in read[0].items() if k != "chapters"} == {k: v for k, v in full.items() if k != "chapters"}
    assert all(got[f"chapter_{c}"] == full["chapters"][f"chapter_{c}"] for c in range(2, 30))


def test_failure_streaks(spark):
    bad = [True] * 6 + [False] + [True] * 11
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate(bad)], "k int, n int, failed boolean")
    got = sorted(L.failure_streaks(df, ["k"], ["n"]).collect(), key=lambda r: r.n)
    assert [r.n for r in got if r.pauses] == [5, 12, 17]


@pytest.mark.parametrize("reply, verdict, reason", [
    ('{"verdict": "reroute", "reason": "summary"}', "reroute", "summary"),
    ('```json\n{"verdict": "borderline"}\n```', "borderline", ""),
    ('{"verdict": "maybe", "reason": "x"}', "pass", "x"), ("not json", "pass", ""),
    ("```", "pass", ""), ('["verdict"]', "pass", ""), ("", "pass", "")])
def test_judge(one, reply, verdict, reason):
    assert one(lambda r: L.judge_verdict(r)[0], r=reply) == verdict
    assert one(lambda r: L.judge_verdict(r)[1], r=reply) == reason


def test_status_and_decisions(one):
    status = lambda e, p: L.pipeline_status(e, p)
    assert [one(status, e=e, p=p) for e, p in ((0, 0), (3, 3), (3, 0), (3, 1))] == [
        "no_chapters", "complete", "failed", "partial"]
    assert [one(L.script_decision, n=n, v=v, r=r) for n, v, r in (
        (250, "reroute", 3), (10, "borderline", 3), (10, "reroute", 1), (10, "reroute", 0))] == [
        "pass", "borderline", "pending", "exhausted"]
    assert one(L.error_class, s="Error: API key issue. x") == "api_key"
    assert one(L.error_class, s="Error: odd") == "other"
    assert one(L.error_class, s="An Error: no") is None


# --- runs ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("alphabet, longest", [("abA", 7), ("ab", 14), ("é\U0001F600?a", 9)])
def test_fuzzy_brute_force(spark, alphabet, longest):
    rnd = random.Random(longest)
    word = lambda: "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, longest)))
    mine, other = [word() for _ in range(60)], [word() for _ in range(40)]
    # Long names around and inside others, and a name that many repeat.
    mine += ["x".join(other[:20]), *[o + "tail" for o in other[20:]], "the same name"] + ["The Same Name"] * 30
    other += ["head" + m for m in mine[:20]] + ["the same name, volume two"] * 30
    names = spark.createDataFrame([(n,) for n in [*mine, None]], "name string").repartition(4)
    got = {r.name: r.pos for r in U.fuzzy_match(names, spark.createDataFrame(
        [(n, i) for i, n in enumerate([*other, None])], "name string, pos int").repartition(3)).collect()}
    want = {}
    for m in {m.lower() for m in mine if m}:
        hits = [i for i, o in enumerate(o.lower() for o in other) if o and (o in m or m in o)]
        if hits:
            want[m] = hits[0]
    assert got == want and len(want) > 20


def test_fuzzy_looks_in_one_place(spark):
    """Long names: the pairs looked at are those that match, not those that share something."""
    rnd = random.Random(6)
    tale = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(200))
    other = ["a story of " + tale() for _ in range(400)]
    mine = [o[20:150] for o in other[:300]] + ["a story of " + tale() for _ in range(300)]
    pairs = U.contained(spark.createDataFrame([(m,) for m in mine], "needle string"),
                        spark.createDataFrame([(o,) for o in other], "hay string"))
    assert {tuple(r) for r in pairs.collect()} == {(m, o) for m, o in zip(mine, other[:300])}


def test_fuzzy_without_names(spark):
    none = spark.createDataFrame([], "name string, pos int")
    some = spark.createDataFrame([("a", 1)], "name string, pos int")
    for left, right in ((none, some), (some, none), (none, none)):
        assert U.fuzzy_match(left.select("name"), right).count() == 0


def test_compare(spark):
    cols = "source string, pos int, status string, ratio double, matched long, issues_count long"
    base = spark.createDataFrame([("a.epub", 1, "OK", 0.4, 5, 2), ("b", 2, "OK", 0.0, 1, 0),
                                  ("c", 3, "ERROR", 0.5, 1, 1), ("d", 4, "OK", None, 1, 1)], cols)
    new = spark.createDataFrame([("A.EPUB", 1, "OK", 0.5, 6, 1), ("xbx", 2, "OK", 0.3, 1, 0)], cols)
    rows = U.compare_runs(base, new)
    got = {r.source: r for r in rows.collect()}
    assert set(got) == {"a.epub", "b"}
    assert got["a.epub"].ratio_improvement_percent == 25.0
    assert (got["a.epub"].chapter_improvement, got["a.epub"].issue_improvement) == (1, 1)
    assert got["b"].ratio_improvement_percent == 0.0
    total = U.compare_summary(rows).first()
    assert (total.books_improved, total.books_same, total.best_improvement_book) == (1, 1, "a.epub")


def test_priorities(one):
    assert [one(U.audio_priority, n=n) for n in (
        "audiobook.m4b", "AUDIOBOOK.mp3", "x.m4b", "x.mp3", "x.wav")] == [0, 1, 2, 3, None]
    assert [one(U.source_priority, n=n, b="moby") for n in (
        "moby.epub", "moby.pdf", "moby.txt", "y.epub", "y.pdf", "y.txt")] == [0, 1, 2, 3, 4, None]


def test_first_pairs(spark):
    from folioscan.operators.routing import first_pairs
    left = spark.createDataFrame([("b",), ("a",)], "x string")
    right = spark.createDataFrame([("2",), ("1",), ("3",)], "y string")
    got = [(r.left_item, r.right_item) for r in first_pairs(left, right, 4).orderBy("pair_no").collect()]
    assert got == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1")]
    assert first_pairs(left, right, 99).count() == 6


def test_limits_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("book_id"), "id")
    plan = R.limit_per_book(df, ["id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
