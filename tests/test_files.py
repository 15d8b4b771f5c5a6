import json

import pytest
from pyspark.sql import functions as F

from folioscan.functions import fixed as K
from folioscan.operators import ledger as L
from folioscan.operators import routing as R
from folioscan.plans import QUERIES
from folioscan.sources import files as FS
from folioscan.sources import tables as V
from folioscan.streaming.retries import ledger_stream

SF = "/root/testdata/sf0.001"


def test_list_inputs(spark, tmp_path):
    for name in ("b.PDF", "a_first-one.epub", "notes.docx", "c.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.txt").write_text("x")
    got = sorted(FS.list_inputs(spark, str(tmp_path)).collect(), key=lambda r: r.position)
    assert [(r.name, r.title) for r in got] == [
        ("a_first-one.epub", "a first one"), ("b.PDF", "b"), ("c.txt", "c")]


def test_scripts(spark, tmp_path):
    (tmp_path / "episode_002_script.txt").write_text("two\nlines\n")
    (tmp_path / "episode_x_script.txt").write_text("bad name")
    got = FS.read_scripts(FS.read_texts(spark, str(tmp_path), "*_script.txt")).collect()
    assert [(r.episode_no, r.text) for r in got] == [(2, "two\nlines\n")]


def test_saved_texts(spark, tmp_path, monkeypatch):
    """Each name is one file with its rows as lines, and many files lie in one folder."""
    monkeypatch.setattr(FS, "SHELF_FILES", 40)
    rows = [(f"book1_episode_{n:03d}_script.txt", f"té\n{n}") for n in range(200)]
    odd = [("twice.txt", "a"), ("twice.txt", "a"), ("null.txt", None), ("empty.txt", "")]
    folder = tmp_path / "texts"
    FS.write_texts(spark.createDataFrame(rows + odd, "name string, text string").repartition(8), folder.as_uri())
    got = {r.path.rsplit("/", 1)[1]: r.text for r in FS.read_texts(spark, folder.as_uri()).collect()}
    want = {n: f"{t}\n" for n, t in rows} | {"twice.txt": "a\na\n", "null.txt": "\n", "empty.txt": "\n"}
    assert got == want
    files = [p for p in folder.rglob("*") if p.is_file()]
    assert len(files) == len(want) and len({p.parent for p in files}) <= 6


def test_texts_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver held every file's name and a split for it, and failed with a million of them."""
    monkeypatch.setattr(FS, "TASK_FILES", 20, raising=False)
    monkeypatch.setattr(FS, "BATCH_FILES", 7, raising=False)
    for n in range(300):
        place = tmp_path / f"texts/{n % 30}" / ("deep" if n % 2 else "")
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{n}.txt").write_text(f"text {n}\n")
    got = FS.read_texts(spark, str(tmp_path / "texts"))
    assert len(got.inputFiles()) < 30
    assert sorted(r.text for r in got.collect()) == sorted(f"text {n}\n" for n in range(300))


@pytest.mark.parametrize("query, role", [("scan_scripts", "assistant"), ("scan_text_files", None)])
def test_saved_texts_are_not_the_drivers(spark, tmp_path, query, role):
    """Every text is read again, and the plan holds no list of the files."""
    turns = spark.range(400).selectExpr("id div 8 as conv_id", "id % 8 as turn", "if(id % 2 = 0, 'user', 'assistant') as role",
                                        "concat('line\\n', id, if(id % 3 = 0, '\\n', '')) as text")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES[query](spark, str(tmp_path))
    assert len(got.inputFiles()) < 50
    want = V.turns(spark, str(tmp_path), role).select("conv_id", "text")
    assert sorted(got.select("book_id", "text").collect()) == sorted(want.collect())


def test_texts_as_sparks_own_reader_gives_them(spark, tmp_path):
    """Odd names and contents, hidden and packed files: what tasks read is what Spark's reader gave."""
    import bz2
    import gzip
    import zlib

    folder = tmp_path / "odd texts"
    files = {
        "a b.txt": b"x", "empty.txt": b"", "p%20q.txt": b"1", "h#?&+=.txt": b"2", "é\u00a0ü\u3000.txt": "é\r\n".encode(),
        "[x]{y}.txt": b"3", "q'\"<>|^`\\.txt": b"4", "m~!@$*(),;.txt": b"5", "bom.txt": b"\xef\xbb\xbfz", "bad.txt": b"\xff\xfea\0",
        "_hidden.txt": b"6", ".hidden.txt": b"6", "_k=1.txt": b"7", "c._COPYING_": b"6", "_hidden/z.txt": b"6", ".hidden/z.txt": b"6",
        "_k=2/z.txt": b"8", "sub é/deep/z.txt": b"9", "g.txt.gz": gzip.compress(b"one\n") + gzip.compress(b"two\n"),
        "g.bz2": bz2.compress(b"b"), "own/g.deflate": zlib.compress(b"d")}
    for name, content in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)
    (folder / "none").mkdir()

    def rows(texts):
        return sorted((r.path, bytes(r.text)) for r in texts.select("path", F.col("text").cast("binary")).collect())

    for place, glob in ((folder, "*"), (folder, "*.{txt,gz}"), (folder, "[a-c]*"), (folder, "nothing*"), (folder / "none", "*"),
                        (folder / "a b.txt", "*"), (folder, "[!g]*"), (folder, "*[!e]")):
        own = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(
            str(place), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        assert rows(FS.read_texts(spark, str(place), glob)) == rows(own)
    with pytest.raises(FileNotFoundError):
        FS.read_texts(spark, str(tmp_path / "missing"))


def test_script_store_has_few_folders(spark):
    """A folder for every file took seconds a thousand files, most of it one by one in the driver."""
    from pathlib import Path
    from urllib.parse import urlparse

    from folioscan.plans.file_queries import _script_store
    folder = Path(urlparse(_script_store(spark, SF)).path)
    assert len([p for p in folder.rglob("*") if p.is_dir()]) <= 1 + V.turns(spark, SF).count() // FS.SHELF_FILES


@pytest.mark.parametrize("saved, titles", [
    ('["a", "b"]', ["a", "b"]), ("[1, 2]", []), ('{"a": 1}', []), ('["a"', []), ("[]", []),
    ('["a", null]', []), ('["a", 1]', []), ("", [])])
def test_load_titles(one, saved, titles):
    assert one(FS.load_titles, v=saved) == titles


def test_markers(one):
    two = "[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=5\ntitle=One\n[CHAPTER]\nSTART=5\ntitle=Two"
    assert one(FS.parse_markers, b=two) == ["One", "Two"]
    assert one(FS.parse_markers, b="[CHAPTER]\n  TITLE=Indented\n") == ["Indented"]
    assert one(FS.parse_markers, b="no block") == []
    assert one(FS.parse_markers, b="[CHAPTER]\nSTART=0\n") == ["Chapter 1"]


def test_written_markers_parse_back(spark, tmp_path):
    rows = spark.createDataFrame([("b", n, n * 10, n * 10 + 10) for n in range(1, 40)],
                                 "book_id string, episode_no int, start_ms long, end_ms long")
    path = str(tmp_path / "markers")
    FS.write_markers(FS.marker_rows(rows, F.concat(F.lit("Part "), "episode_no")), path)
    files = sorted((tmp_path / "markers" / "book_id=b").glob("part-*.txt"))
    body = "".join(f.read_text() for f in files)
    assert body.startswith(K.MARKER_HEADER)
    titles = spark.createDataFrame([(body,)], "b string").select(
        FS.parse_markers(F.col("b")).alias("t")).first().t
    assert titles == [f"Part {n}" for n in range(1, 40)]


def test_run_reports(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps([{"source": "a", "ratio": 0.5, "extra": 1}, {"source": "b"}]))
    got = FS.read_reports(spark, str(path), multi_line=True).orderBy("source").collect()
    assert [(r.source, r.ratio, r.status) for r in got] == [("a", 0.5, None), ("b", None, None)]


def test_decode(one):
    raw = bytearray("aé".encode("latin-1") + "é".encode() + b"\xff")
    text, bad = one(lambda b: F.struct(*FS.decode_bytes(b)), b=raw)
    assert (text, bad) == ("a�é�", 2)


def test_multipart(spark):
    names = ["Book_part10.m4b", "book_PART2.m4b", "book.m4b", "Book_part1.mp3"]
    df = spark.createDataFrame([("d", n) for n in names], "dir string, name string")
    got = {r.name: (r.grp, r.part_no, r.part_index) for r in FS.multipart_files(df).collect()}
    assert got == {"book_PART2.m4b": ("book.m4b", 2, 1), "Book_part10.m4b": ("book.m4b", 10, 2),
                   "book.m4b": ("book.m4b", 0, 1), "Book_part1.mp3": ("book.mp3", 1, 1)}


def test_task_routing(spark):
    asked = spark.createDataFrame(
        [(1, "podcast", None), (2, "podcast", "mine"), (3, "odd", None), (4, "odd", "mine"),
         (5, "direct", None), (6, "podcast", "  ")], "i int, task string, prompt_file string")
    got = {r.i: (r.resolved_prompt, r.error) for r in R.route_tasks(asked, V.tasks(spark)).collect()}
    assert got == {1: ("builtin:podcast", None), 2: ("mine", None), 3: (None, "unknown task"),
                   4: ("mine", None), 5: ("", None), 6: ("builtin:podcast", "empty prompt file")}


def test_model_hook(spark):
    asked = spark.createDataFrame([(1, "hi", "fr"), (2, "hi", "fr"), (3, "hi", "en")],
                                  "i int, prompt string, language string")
    calls = R.distinct_calls(asked)

    def answer(batches):
        for pdf in batches:
            yield pdf.assign(answer=pdf["prompt"].str.upper())[["prompt", "language", "answer"]]

    answers = R.call_model(calls, answer, "prompt string, language string, answer string")
    assert answers.count() == 1
    got = {r.i: r.translated for r in R.answer_calls(asked, answers).collect()}
    assert got == {1: "HI", 2: "HI", 3: "hi"}


def test_stream_audits_each_document_once(spark, tmp_path):
    from folioscan.streaming import audit as A
    docs = V.read(spark, SF, "documents")
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in range(2):
        docs.filter(F.col("doc_id") % 2 == part).write.mode("append").parquet(folder)
        A.audit_stream(A.stream_documents(spark, folder, docs.schema, 2), out, state).awaitTermination()
    got = A.current(spark, out)
    assert got.count() == docs.count() == got.select("doc_id").distinct().count() == A.versions(spark, out).count()
    batch = QUERIES["text_quality_rows"](spark, SF)
    assert got.select("doc_id", "reason", "verdict").exceptAll(batch).isEmpty()


def test_stream_knows_content(spark, tmp_path):
    """Renamed files, re-delivered rows, changed and restored texts, and a batch that runs twice."""
    from folioscan.streaming import audit as A
    schema = "doc_id long, lang string, source string, text string"
    good, bad = "Plain words of a story go on and on here.", "#$%^&*()!@#$%^&*()!@#$%^&*() x"
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def deliver(rows):
        spark.createDataFrame([(i, "en", "s", t) for i, t in rows], schema).coalesce(1).write.mode("append").parquet(folder)
        A.audit_stream(A.stream_documents(spark, folder, schema), out, state).awaitTermination()
        return {r.doc_id: r.verdict for r in A.current(spark, out).collect()}, A.versions(spark, out).count()

    verdicts, n = deliver([(1, good), (2, bad), (2, bad), (3, None), (None, good), (None, bad)])
    assert (verdicts[1], verdicts[2], verdicts[3], n) == ("clean", "garbage", "garbage", 5)
    rows = A.current(spark, out)
    assert rows.count() == 5 and rows.filter("doc_id is null").count() == 2
    # The same rows in another file.
    assert deliver([(2, bad), (1, good), (None, good)])[1] == 5
    verdicts, n = deliver([(1, bad), (4, good)])
    assert (verdicts[1], verdicts[4], n) == ("garbage", "clean", 7)
    verdicts, n = deliver([(1, good)])
    assert (verdicts[1], n) == ("clean", 8)
    # The last batch again, and one that broke off before the manifest.
    again = spark.createDataFrame([(1, "en", "s", good)], schema).withColumn(A.ARRIVED, F.current_timestamp())
    A.save_batch(again, 3, out)
    assert A.versions(spark, out).count() == 8
    A.versions(spark, out).drop("batch").limit(2).write.parquet(f"{out}/versions/batch=9")
    assert A.versions(spark, out).count() == 8 and A.current(spark, out).count() == 6


def test_stream_ledger_equals_batch(spark, tmp_path):
    # Some attempts have no rate.
    attempts = V.attempts(spark, SF).withColumn(
        "wer", F.when(F.col("event_id") % 3 > 0, F.col("wer")))
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for low in range(0, 1000, 250):
        attempts.filter((F.col("event_id") >= low) & (F.col("event_id") < low + 250)).write.mode(
            "append").parquet(folder)
        ledger_stream(spark.readStream.schema(attempts.schema).parquet(folder), out,
                      state).awaitTermination()
    batch = L.retry_ledger(attempts)
    got = spark.read.parquet(out).select(batch.columns)
    assert got.count() == batch.count()
    assert got.exceptAll(batch).isEmpty()


def test_stream_ledger_batch_again(spark, tmp_path):
    """Missing keys, outcomes, times and rates; a batch that runs twice; a chapter hot in one batch."""
    from folioscan.streaming.retries import OUTPUT, STATE, save_batch
    out, schema = str(tmp_path / "out"), "book_id long, chapter_id long, cycle string, ts timestamp, event_id long, failed boolean, wer double"
    spark.createDataFrame([], STATE).write.parquet(f"{out}/_state/batch=-1")
    rows = [(1, 10, K.CYCLES[2], n, n, n in (2, 5, 31, 44, 47), None if n % 4 else 1 / (n + 1)) for n in range(50)]
    rows += [(None, None, c, n, n, n % 3 == 0 if n else None, None) for c in (None, K.CYCLES[0]) for n in range(4)]
    events = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
    parts = [events.filter("event_id < 3"), events.filter("event_id >= 3 and event_id < 30"), events.filter("event_id >= 30")]
    for number, part in enumerate(parts):
        save_batch(part, number, out)
    save_batch(parts[2], 2, out)
    known = events.withColumn("failed", F.coalesce("failed", F.lit(False)))
    batch = L.retry_ledger(known).select(spark.createDataFrame([], OUTPUT).columns)
    got = spark.read.parquet(out).select(batch.columns)
    assert got.count() == batch.count() == len(rows)
    assert got.exceptAll(batch).isEmpty()
    state = spark.read.parquet(f"{out}/_state/batch=2").filter("book_id = 1").collect()
    assert [(r.attempts, r.failures, r.best) for r in state] == [(50, 5, 1 / 49)]


def test_stream_ledger_has_no_call_for_each_chapter(spark, tmp_path):
    """A Python call for each chapter and run took most of the time."""
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    V.attempts(spark, SF).limit(50).write.parquet(folder)
    stream = ledger_stream(spark.readStream.schema(V.attempts(spark, SF).schema).parquet(folder), out, state)
    stream.awaitTermination()
    assert not stream.lastProgress["stateOperators"] and spark.read.parquet(out).count() == 50
