"""Repeated lines across documents, in DataFrame functions only: which lines of each document stay.

A line's key is the line trimmed of ASCII white space with A-Z in lower case. Hashes of long enough keys (128 bits) are
range-partitioned with document and position as secondary order, so a key held by a third of all documents spreads over
as many blocks as its rows fill. Inside a block rows stream in order of document, largest first: the first document met is
the one that keeps the line, and running ranks count the documents. A key that goes on in the next block is the last key of
one block and the first of another, so there are fewer of them than blocks; their blocks are joined by a table of that size.

What comes back is no text but one run-length coded bitmap for each document that loses lines: (start, length) of every
stretch of kept lines. ``apply`` cuts texts with it; documents without a bitmap keep all lines.

Defined cases: a null or empty text is one empty line. Rows that share an id are one document and lose their lines together;
rows repeated whole get the same answer. Rows without an id keep everything and count for no key. Other columns are not read,
``apply`` carries them through. An empty table gives no bitmaps.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

BLANK = " \t\n\x0b\x0c\r"
TEXT_KEY = "text_key"


@dataclass(frozen=True)
class Settings:
    """Keys of ``least_chars`` code points or more that ``least_docs`` documents hold stay in one document only."""

    least_chars: int = 20
    least_docs: int = 3


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case. Text of single bytes takes the quick built-in, which changes nothing else there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, ascii_uppercase, ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_key(text: Column) -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _hashed(docs: DataFrame, settings: Settings, key: str, text: str) -> DataFrame:
    """One narrow row for each line that could repeat."""
    lines = docs.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("doc"), text_key(F.col(text)).alias(TEXT_KEY), lines_of(F.col(text)).alias("lines"))
    lines = lines.select("doc", TEXT_KEY, F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    bare = lines.withColumn("line", F.btrim("line", F.lit(BLANK))).filter(
        F.char_length("line") >= settings.least_chars)
    return bare.withColumn("line", lower_ascii(F.col("line"))).select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc", TEXT_KEY, "pos", "n_lines")


def _spanning(blocks: DataFrame) -> DataFrame:
    """h1, h2, top, n_docs of the keys that lie in several blocks: fewer rows than blocks."""
    line_key = F.struct("h1", "h2")
    edges = blocks.groupBy("block").agg(F.min(line_key).alias("low"), F.max(line_key).alias("high"))
    over = edges.select("block", F.explode(F.array_distinct(F.array("low", "high"))).alias("k")).groupBy(
        "k.h1", "k.h2").count().filter("count > 1").select("h1", "h2")
    parts = blocks.join(F.broadcast(over), ["h1", "h2"]).groupBy("h1", "h2", "block", "doc").count().groupBy(
        "h1", "h2", "block").agg(F.max("doc").alias("top"), F.min("doc").alias("low"), F.count("*").alias("n"))
    # A document whose lines lie on both sides of a border was counted on both.
    before = F.lag("low").over(Window.partitionBy("h1", "h2").orderBy("block"))
    return parts.withColumn("twice", F.coalesce((before == F.col("top")).cast("int"), F.lit(0))).groupBy("h1", "h2").agg(
        F.max("top").alias("top"), F.sum(F.col("n") - F.col("twice")).alias("n_docs"))


def keep_bitmaps(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, text_key, n_lines, n_dropped, keep (runs of kept lines) of each document that loses lines."""
    order = ["h1", "h2", F.desc("doc"), TEXT_KEY, "pos"]
    # Stored twice: sampling for the ranges should not hash all texts again, and a lost task must find the same blocks.
    hashed = stored(_hashed(docs, settings, key, text), "lines")
    blocks = stored(hashed.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), "line-blocks")
    group = Window.partitionBy("block", "h1", "h2")
    in_order = group.orderBy(F.desc("doc"))
    rows = blocks.withColumn("first", F.first("doc").over(in_order)).withColumn(
        "nth", F.dense_rank().over(in_order)).withColumn("n_here", F.max("nth").over(group))
    spanning = stored(_spanning(blocks), "line-spans")
    rows = rows.join(F.broadcast(spanning), ["h1", "h2"], "left").filter(
        (F.col("doc") != F.coalesce("top", "first"))
        & (F.coalesce("n_docs", F.col("n_here").cast("long")) >= settings.least_docs))
    lost = rows.groupBy("doc", TEXT_KEY).agg(F.max("n_lines").alias("n_lines"),
                                             F.sort_array(F.collect_set("pos")).alias("lost"))
    return lost.select(F.col("doc").alias(key), TEXT_KEY, "n_lines", F.size("lost").alias("n_dropped"),
                       _runs(F.col("lost"), F.col("n_lines")).alias("keep"))


def _runs(lost: Column, n: Column) -> Column:
    """Stretches between lost positions."""
    starts = F.concat(F.array(F.lit(0)), F.transform(lost, lambda p: p + 1))
    runs = F.zip_with(starts, F.concat(lost, F.array(n)), lambda a, b: F.struct(
        a.alias("start"), (b - a).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def apply(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text", out: str = "kept_text",
          n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with the text that stays and two counts; columns of these names are replaced.

    The bitmaps of a task's rows are hashed and the texts stream past them, so texts are shuffled once and not sorted.
    """
    mine = bitmaps.select(F.col(key).alias("_doc"), F.col(TEXT_KEY).alias("_text"), F.col("keep").alias("_keep"),
                          F.col("n_dropped").alias("_lost")).hint("shuffle_hash")
    rows = docs.join(mine, (docs[key] == F.col("_doc")) & (text_key(docs[text]) == F.col("_text")), "left")
    lines = lines_of(docs[text])
    kept = F.array_join(F.flatten(F.transform("_keep", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    rows = rows.withColumns({
        "_kept": F.when(F.col("_keep").isNull(), F.coalesce(docs[text], F.lit(""))).otherwise(kept),
        "_n": F.size(lines).cast("long"), "_gone": F.coalesce(F.col("_lost").cast("long"), F.lit(0).cast("long"))})
    others = [docs[c] for c in docs.columns if c not in (out, n_lines, n_dropped)]
    return rows.select(*others, F.col("_kept").alias(out), F.col("_n").alias(n_lines), F.col("_gone").alias(n_dropped))
