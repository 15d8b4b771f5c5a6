"""File scans and sinks. Files are first written from the given tables to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as K
from ..session import fresh_path
from ..sources import files as FS
from ..sources import tables as V
from ..streaming.audit import audit_stream, current, stream_documents
from ..streaming.retries import ledger_stream, time_slices
from . import sql as S
from .attempt_queries import LEDGER_COLUMNS, LEDGER_SQL
from .book_queries import FULL, reports
from .registry import query

_INPUT = ("source || CASE WHEN length(source) % 2 = 0 THEN '_Vol-1' ELSE '' END || "
          "list_extract(['.epub', '.PDF', '.txt', '.docx'], CAST(length(lang) + "
          "CAST(substr(source, 4) AS INT) AS INT) % 4 + 1)")


@query("scan_inputs", f"""
    WITH f AS (SELECT DISTINCT {_INPUT} AS name FROM documents),
    k AS (SELECT name FROM f WHERE regexp_matches(lower(name), '\\.(epub|pdf|txt|md)$'))
    SELECT name, replace(replace(regexp_replace(name, '\\.[^.]+$', ''), '_', ' '), '-', ' ')
      AS title, row_number() OVER (ORDER BY name) AS position FROM k""")
def scan_inputs(spark, d):
    """One folder entry per book; the listing reads names, never content."""
    ext = F.element_at(
        F.array(*map(F.lit, (".epub", ".PDF", ".txt", ".docx"))),
        ((F.length("lang") + F.substring("source", 4, 9).cast("int")) % 4 + 1).cast("int"))
    name = F.concat("source", F.when(F.length("source") % 2 == 0, "_Vol-1").otherwise(""), ext)
    path = fresh_path(spark, "inputs")
    V.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("value"),
                                         name.alias("file")).write.partitionBy("file").text(path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "part-*").load(path).select("path", "length")
    entries = listed.withColumn("path", F.regexp_extract("path", r"file=([^/]*)/", 1)).groupBy(
        "path").agg(F.sum("length").alias("length"))
    return FS.number_inputs(entries).select("name", "title", "position")


def _script_store(spark, d) -> str:
    """Turns as saved files, one each; only what the assistant said is saved under a script's name."""
    number = F.lpad(F.col("turn").cast("string"), 3, "0")
    name = F.when(F.col("role") == "assistant", F.concat(
        F.lit("episode_"), number, F.lit("_script.txt"))).otherwise(
        F.concat(F.lit("notes_"), number, F.lit(".txt")))
    path = fresh_path(spark, "scripts")
    FS.write_texts(V.turns(spark, d).select(F.coalesce(
        F.concat(F.lit("book"), "conv_id", F.lit("_"), name), F.lit("unnamed")).alias("name"), "text"), path)
    return path


def _saved(spark, d):
    texts = FS.read_texts(spark, _script_store(spark, d))
    return texts.select(
        F.regexp_extract("path", r"/book(\d+)_[^/]*$", 1).cast("bigint").alias("book_id"),
        F.regexp_extract("path", r"/book\d+_([^/]*)$", 1).alias("name"),
        "path", F.regexp_replace("text", r"\n\z", "").alias("text"))


@query("scan_text_files", """
    SELECT conv_id AS book_id, CASE WHEN role = 'assistant' THEN 'episode_' ||
      lpad(CAST(turn AS VARCHAR), 3, '0') || '_script.txt'
      ELSE 'notes_' || lpad(CAST(turn AS VARCHAR), 3, '0') || '.txt' END AS name, text
    FROM conversations""")
def scan_text_files(spark, d):
    return _saved(spark, d).select(
        "book_id", "name", "text")


@query("scan_scripts", """
    SELECT conv_id AS book_id, turn AS episode_no, text FROM conversations
    WHERE role = 'assistant'""")
def scan_scripts(spark, d):
    return FS.read_scripts(_saved(spark, d)).select("book_id", "episode_no", "text")


@query("chapter_titles_json", """
    WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ts FROM documents)
    SELECT doc_id, CAST(generate_subscripts(ts, 1) AS BIGINT) AS pos, unnest(ts) AS title
    FROM t""")
def chapter_titles_json(spark, d):
    # Every document's list of titles, and damaged ones of each beside it, which give nothing.
    whole = F.to_json(F.split("text", "\n"))
    saved = F.array(whole, F.concat(F.lit('{"title": '), whole, F.lit("}")), F.concat(F.lit("["), whole),
                    F.lit('["open'), F.lit("[1, 2]"))
    docs = V.chapters(spark, d).select("doc_id", F.explode(saved).alias("titles"))
    return docs.select("doc_id", F.posexplode(FS.load_titles(F.col("titles"))).alias(
        "i", "title")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("pos"), "title")


@query("save_chapter_titles", """
    SELECT doc_id, CAST(to_json(string_split(text, chr(10))) AS VARCHAR) AS titles
    FROM documents""")
def save_chapter_titles(spark, d):
    lines = V.chapters(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias(
        "pos", "title"))
    return FS.save_titles(lines, "doc_id", "pos", "title")


@query("parse_chapter_markers", f"""
    WITH t AS (SELECT doc_id, string_split(text || chr(10), chr(10)) AS ts FROM documents),
    u AS (SELECT doc_id, CAST(generate_subscripts(ts, 1) AS BIGINT) AS number,
        {S.strip('unnest(ts)')} AS title FROM t)
    SELECT doc_id, number, CASE WHEN title = '' THEN 'Chapter ' || number ELSE title END AS title
    FROM u""")
def parse_chapter_markers(spark, d):
    # Marker files whose chapter titles are the lines of a document; the last title is blank.
    block = lambda t, i: FS.marker_block(t, i * 1000, (i + 1) * 1000)
    lines = F.split(F.concat("text", F.lit("\n")), "\n")
    body = F.concat(F.lit(K.MARKER_HEADER), F.array_join(F.transform(lines, block), ""))
    docs = V.chapters(spark, d).select("doc_id", body.alias("body"))
    return docs.select("doc_id", F.posexplode(FS.parse_markers(F.col("body"))).alias(
        "i", "title")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("number"), "title")


@query("scan_run_reports", f"""
    WITH {FULL} SELECT book_id AS source, CASE WHEN issues_count = 0 THEN 'OK' ELSE 'ISSUES' END
      AS status, ratio, matched, total_source, CAST(issues_count AS BIGINT) AS issues_count
    FROM rep""")
def scan_run_reports(spark, d):
    path = fresh_path(spark, "reports")
    FS.write_reports(reports(spark, d).select(
        F.col("book_id").alias("source"), "status", "ratio", "matched", "total_source",
        "issues_count"), path)
    return FS.read_reports(spark, path)


# --- streams ------------------------------------------------------------------------------------

@query("stream_text_quality", f"""
    SELECT doc_id, lang, source, {S.reason('text')} AS reason,
      CASE WHEN {S.reason('text')} = 'clean' THEN 'clean' ELSE 'garbage' END AS verdict
    FROM documents""")
def stream_text_quality(spark, d):
    docs = V.read(spark, d, "documents")
    out, state = fresh_path(spark, "audit"), fresh_path(spark, "audit-state")
    stream = stream_documents(spark, f"{d}/documents.parquet", docs.schema)
    audit_stream(stream, out, state).awaitTermination()
    return current(spark, out).select("doc_id", "lang", "source", "reason", "verdict")


@query("stream_retry_ledger", LEDGER_SQL)
def stream_retry_ledger(spark, d):
    """Attempts arrive slice by slice; each run of the stream takes the new slice."""
    folder, out = fresh_path(spark, "attempts"), fresh_path(spark, "ledger")
    state = fresh_path(spark, "ledger-state")
    attempts = V.attempts(spark, d)
    for part in time_slices(attempts, "ts"):
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(attempts.schema).parquet(folder)
        ledger_stream(stream, out, state).awaitTermination()
    return spark.read.parquet(out).select(*LEDGER_COLUMNS)
