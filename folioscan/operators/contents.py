"""Nested tables of contents: entries below entries, walked in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .ordered import numbered

SEPARATOR = " / "


def walk(entries: DataFrame) -> DataFrame:
    """book_id, entry_no, position, depth, path, href of every entry, an entry before those below it.

    ``entries``: book_id, entry_no, parent_no (null at the top), place among its siblings, title, href (null for a section
    that is no page). All books go down one level at a time, so there are as many joins as levels, whatever the number of
    entries; a level joins only the rows of the one above. Ties in place go to the smaller entry number. An entry whose parent
    is not there stands at the top. Of rows that share book and number the one closest to the top counts. Entries that are
    their own ancestors have no place in the reading order and are left out. A null title is an empty one.
    """
    node = F.struct(F.col("parent_no").isNotNull().alias("below"), "parent_no", "place",
                    F.coalesce("title", F.lit("")).alias("title"), "href")
    nodes = durable(entries.filter(F.col("book_id").isNotNull() & F.col("entry_no").isNotNull()).groupBy(
        "book_id", "entry_no").agg(F.min(node).alias("n")).select("book_id", "entry_no", "n.*"))
    here = F.array(F.coalesce("place", F.lit(0)).cast("bigint"), F.col("entry_no").cast("bigint"))
    known = nodes.select("book_id", F.col("entry_no").alias("parent_no"))
    top = nodes.filter(~F.col("below")).unionAll(nodes.filter("below").join(known, ["book_id", "parent_no"], "left_anti").select(
        *nodes.columns))
    level = durable(top.select("book_id", "entry_no", "href", F.lit(1).cast("bigint").alias("depth"), here.alias("key"),
                               F.col("title").alias("path")))
    found = level
    while not level.isEmpty():
        above = level.select("book_id", F.col("entry_no").alias("parent_no"), F.col("depth").alias("up"),
                             F.col("key").alias("before"), F.col("path").alias("way"))
        level = durable(nodes.join(above, ["book_id", "parent_no"]).select(
            "book_id", "entry_no", "href", (F.col("up") + 1).alias("depth"), F.concat("before", here).alias("key"),
            F.concat("way", F.lit(SEPARATOR), "title").alias("path")))
        found = found.unionAll(level)
    return numbered(found, ["book_id"], ["key"], "position").select(
        "book_id", "entry_no", "position", "depth", "path", "href")
