"""From spine items to chapters: filters, grouping along the table of contents, re-extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import html as H
from ..functions import text as X
from ..session import durable, stored
from .assemble import assemble
from .ordered import Running, numbered, ordered


def toc_names(toc: DataFrame) -> DataFrame:
    """Distinct item names a book's table of contents points to."""
    name = H.toc_name(F.col("href"))
    return toc.select("book_id", name.alias("item_name")).filter(
        F.length("item_name") > 0).distinct()


def mark_boundaries(items: DataFrame, toc: DataFrame) -> DataFrame:
    """Add ``boundary``: does the table of contents point to this item?"""
    names = toc_names(toc).withColumn("_hit", F.lit(True))
    return items.join(names, ["book_id", "item_name"], "left").withColumn(
        "boundary", F.coalesce("_hit", F.lit(False))).drop("_hit")


def group_items(items: DataFrame, toc: DataFrame) -> DataFrame:
    """Narrow rows (book, ordinal, boundary, group): a group starts at every boundary."""
    body = items.filter(~H.skip_by_name(F.col("item_name"))).select(
        "book_id", "ordinal", "item_name")
    marked = durable(mark_boundaries(body, toc).select("book_id", "ordinal", "boundary"))
    return ordered(marked, ["book_id"], ["ordinal"]).running(
        Running("group_no", "sum", F.col("boundary").cast("int"))).result().withColumn(
        "group_no", F.col("group_no").cast("bigint"))


def merge_items(items: DataFrame, groups: DataFrame) -> DataFrame:
    """One chapter per group: the bodies of its items in reading order; a lone item as it is."""
    keys = ["book_id", "group_no"]
    counted = groups.join(groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys).select(
        "book_id", "ordinal", "group_no", "_n")
    pages = items.select("book_id", "ordinal", "html")
    bodies = pages.join(counted, ["book_id", "ordinal"]).withColumn("html", F.when(
        F.col("_n") > 1, H.body_element(F.col("html"))).otherwise(F.col("html")))
    merged = assemble(bodies, keys, ["ordinal"], "html", "\n")
    return merged.withColumnRenamed("n_pieces", "n_items").withColumn(
        "html", F.when(F.col("n_items") > 1, F.concat(
            F.lit("<html><body>"), "html", F.lit("</body></html>"))).otherwise(F.col("html")))


def grouping_outcome(groups: DataFrame, toc: DataFrame, chapters: DataFrame) -> DataFrame:
    """Per book: did the table of contents fit the spine, or must single items be used?"""
    hits = groups.groupBy("book_id").agg(
        F.count_if("boundary").alias("matches"), F.count(F.lit(1)).alias("n_items"))
    size = toc_names(toc).groupBy("book_id").agg(F.count(F.lit(1)).alias("toc_size"))
    good = chapters.groupBy("book_id").agg(F.count_if("valid").alias("n_chapters"))
    out = hits.join(size, "book_id", "left").join(good, "book_id", "left").withColumns({
        "toc_size": F.coalesce("toc_size", F.lit(0)).cast("bigint"),
        "n_chapters": F.coalesce("n_chapters", F.lit(0)).cast("bigint")})
    return out.withColumn("method", F.when(F.col("toc_size") == 0, "items")
        .when(F.col("matches") < F.least(F.lit(K.MIN_TOC_MATCHES), F.col("toc_size")), "items")
        .when((F.col("n_chapters") <= 1) & (F.col("toc_size") > 2), "items")
        .otherwise("toc"))


def book_chapters(items: DataFrame, toc: DataFrame) -> DataFrame:
    """The chapters of each book, numbered and titled.

    Items grouped along the table of contents where it fits the spine, without groups that are no
    chapter; else the single items that pass the content filter. Columns: book_id, number, index,
    method, title, strategy, html.
    """
    groups = durable(group_items(items, toc))
    # Read for the outcome and for the chapters: written once.
    merged = stored(with_visible(merge_items(items, groups)).withColumn(
        "valid", H.valid_chapter(F.col("html"), F.col("visible"))), "merged")
    method = durable(grouping_outcome(groups, toc, merged).select("book_id", "method"))
    grouped = merged.filter("valid").select("book_id", F.col("group_no").alias("place"), "html").join(
        method.filter("method = 'toc'"), "book_id")
    single = items.join(method.filter("method = 'items'"), "book_id")
    single = filter_with_fallback(single).select("book_id", F.col("ordinal").alias("place"), "html", "method")
    found = stored(grouped.unionByName(single), "chapters")
    places = numbered(found.select("book_id", "place"), ["book_id"], ["place"], "number")
    title, strategy = H.infer_title(F.col("html"))
    return found.join(places, ["book_id", "place"]).select(
        "book_id", "number", (F.col("number") - 1).alias("index"), "method", title.alias("title"),
        strategy.alias("strategy"), "html")


def with_visible(items: DataFrame) -> DataFrame:
    return items.withColumn("visible", H.page_text(F.col("html")))


def filter_with_fallback(items: DataFrame) -> DataFrame:
    """Strict content filter; a book that would keep nothing keeps all items of some length.

    Only a flag per book is shuffled, not the pages.
    """
    strict = (F.length(X.strip(F.col("html"))) >= 100) & (F.length("visible") >= 80) & X.let(
        F.lower("visible"), lambda low: ~H.looks_like_toc(F.col("html"), low)
        & (H.cjk_headings(low) <= 2) & ~H.looks_like_copyright(low))
    named = with_visible(items.filter(~H.skip_by_name(F.col("item_name")))).withColumns(
        {"strict": strict, "loose": F.length("visible") >= 20})
    any_strict = named.groupBy("book_id").agg(F.bool_or("strict").alias("has_strict"))
    return named.join(any_strict, "book_id").filter(
        F.when(F.col("has_strict"), F.col("strict")).otherwise(F.col("loose")))


def extract_ladder(items: DataFrame) -> DataFrame:
    """Text of the first extraction rung that passes the quality check, else the last rung."""
    rungs = [H.page_text(F.col("html")), H.without_scripts(F.col("html")),
             H.without_tags(F.col("html"))]
    out = items.withColumn("r1", rungs[0])
    good1 = X.quality_reason(F.col("r1")) == "clean"
    out = out.withColumn("r2", F.when(~good1, rungs[1]))
    good2 = X.quality_reason(F.col("r2")) == "clean"
    rung = F.when(F.col("r2").isNull(), 1).when(good2, 2).otherwise(3)
    return out.withColumn("rung", rung).withColumn(
        "text", F.when(F.col("rung") == 1, F.col("r1")).when(F.col("rung") == 2, F.col("r2"))
        .otherwise(rungs[2])).drop("r1", "r2")


def realign(items: DataFrame, extracted: DataFrame, toc: DataFrame) -> DataFrame:
    """Re-extracted texts back on the spine by (book, ordinal), joined to chapters."""
    groups = group_items(items, toc).select("book_id", "ordinal", "group_no")
    texts = groups.join(extracted, ["book_id", "ordinal"])
    return assemble(texts, ["book_id", "group_no"], ["ordinal"], "text", "\n\n")
