"""Whole-library work: resuming, comparing runs, ranking and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_up, slug
from ..session import stored

# Long enough to be rare, short enough that few names are shorter.
GRAM = 5


def remaining(sources: DataFrame, finished: DataFrame, on: str) -> DataFrame:
    """Sources without a finished product."""
    return sources.join(finished.select(on).distinct(), on, "left_anti")


def merge_results(old: DataFrame, new: DataFrame, on: str) -> DataFrame:
    """Earlier results, plus new ones for names they do not have."""
    return old.unionByName(new.join(old.select(on), on, "left_anti"))


def pair_by_slug(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """Sources (``name``) and output folders (``dir``) by slug, unmatched ones on both sides."""
    left = sources.withColumn("slug", slug(F.col("name")))
    right = outputs.select(F.col("dir").alias("slug")).distinct().withColumn(
        "_has", F.lit(True))
    out = left.join(right, "slug", "full")
    return out.withColumn("status", F.when(F.col("name").isNull(), "NO SOURCE")
                          .when(F.col("_has").isNull(), "NO OUTPUT").otherwise("PAIRED")
                          ).drop("_has")


def pick_by_priority(files: DataFrame, priority: Column) -> DataFrame:
    """Best file per folder: lowest priority number, then name; files without one never win."""
    ranked = files.withColumn("priority", priority).filter("priority is not null")
    return ranked.groupBy("dir").agg(F.min(F.struct("priority", "name")).alias("best")).select(
        "dir", F.col("best.name").alias("name"), F.col("best.priority").alias("priority"))


def audio_priority(name: Column) -> Column:
    low = F.lower(name)
    return (F.when(low == "audiobook.m4b", 0).when(low == "audiobook.mp3", 1)
            .when(low.endswith(".m4b"), 2).when(low.endswith(".mp3"), 3)).cast("bigint")


def source_priority(name: Column, book: Column) -> Column:
    """The book's own file by extension, else any ebook in the folder."""
    low = F.lower(name)
    return (F.when(low == F.concat(book, F.lit(".epub")), 0)
            .when(low == F.concat(book, F.lit(".pdf")), 1)
            .when(low == F.concat(book, F.lit(".txt")), 2)
            .when(low.endswith(".epub"), 3).when(low.endswith(".pdf"), 4)).cast("bigint")


def _grams(c: Column, size: int) -> Column:
    """Hashes of the distinct stretches of ``size`` characters."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))
    return F.transform(found, lambda gram: F.xxhash64(gram))


def contained(needles: DataFrame, hays: DataFrame, size: int = GRAM) -> DataFrame:
    """Pairs (needle, hay) of distinct texts where the first stands in the second.

    An index lists the grams of every hay. A needle looks in one place only: under its gram that the fewest hays have, or
    under itself if it is shorter than a gram. What it finds is verified. Narrow rows, one for each character of the texts,
    are all that is shuffled besides the pairs to verify.
    """
    length = F.least(F.char_length("needle"), F.lit(size))
    needles = needles.withColumn("n_id", F.xxhash64("needle"))
    hays = hays.withColumn("h_id", F.xxhash64("hay"))
    # At most ``size`` values.
    sizes = sorted(r["k"] for r in needles.select(length.alias("k")).distinct().collect())
    grams = F.flatten(F.array(*[_grams(F.col("hay"), k) for k in sizes or [size]]))
    index = hays.select("h_id", F.explode(F.array_distinct(grams)).alias("gram"))
    looked = needles.select("n_id", F.explode(F.when(length < size, F.array(F.xxhash64("needle"))).otherwise(
        _grams(F.col("needle"), size))).alias("gram"))
    # A gram that no hay has rules its needle out.
    rarest = looked.join(index.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").groupBy("n_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0").select(
        "n_id", "r.gram")
    pairs = rarest.join(index, "gram").join(needles, "n_id").join(hays, "h_id")
    return pairs.filter(F.contains("hay", "needle")).select("needle", "hay")


def fuzzy_match(names: DataFrame, others: DataFrame) -> DataFrame:
    """First entry of ``others`` (name, pos) whose name contains, or is contained in, each name, ignoring case."""
    mine = stored(names.select(F.lower("name").alias("name")).filter("name <> ''").distinct(), "names")
    first = stored(others.select(F.lower("name").alias("other"), "pos").filter(
        "other <> ''").groupBy("other").agg(F.min("pos").alias("pos")), "others")
    left, right = mine.select(F.col("name").alias("needle")), first.select(F.col("other").alias("hay"))
    inside = contained(left, right).select(F.col("needle").alias("name"), F.col("hay").alias("other"))
    around = contained(right.withColumnRenamed("hay", "needle"), left.withColumnRenamed("needle", "hay")).select(
        F.col("hay").alias("name"), F.col("needle").alias("other"))
    return inside.unionAll(around).join(first, "other").groupBy("name").agg(F.min("pos").alias("pos"))


def compare_runs(baseline: DataFrame, improved: DataFrame) -> DataFrame:
    """Ratio, chapter and issue changes of each baseline book against its match.

    Both sides: source, pos, status, ratio, matched, issues_count; ``pos`` is the input order.
    """
    base = baseline.filter("status <> 'ERROR'")
    hit = fuzzy_match(base.select(F.col("source").alias("name")),
                      improved.select(F.col("source").alias("name"), "pos"))
    other = improved.select(
        F.col("pos").alias("other_pos"), F.coalesce("ratio", F.lit(0.0)).alias("new_ratio"),
        F.col("matched").alias("new_matched"), F.col("issues_count").alias("new_issues"))
    rows = base.join(hit.select(F.col("name").alias("_n"), F.col("pos").alias("other_pos")),
                     F.lower("source") == F.col("_n")).join(other, "other_pos")
    old = F.coalesce("ratio", F.lit(0.0))
    change = F.when(old > 0, (F.col("new_ratio") - old) / old * 100).otherwise(0.0)
    return rows.select(
        "source", "pos", half_up(old, 3).alias("baseline_ratio"),
        half_up(F.col("new_ratio"), 3).alias("improved_ratio"),
        half_up(change, 1).alias("ratio_improvement_percent"),
        F.col("matched").alias("baseline_chapters"),
        F.col("new_matched").alias("improved_chapters"),
        (F.col("new_matched") - F.col("matched")).alias("chapter_improvement"),
        F.col("issues_count").alias("baseline_issues"),
        F.col("new_issues").alias("improved_issues"),
        (F.col("issues_count") - F.col("new_issues")).alias("issue_improvement"))


def compare_summary(rows: DataFrame) -> DataFrame:
    """One row over all comparisons; the first book in input order wins ties."""
    r = F.col("ratio_improvement_percent")
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("total_books"),
        half_up(F.avg(F.floor(r * 10 + 0.5)) / 10, 1).alias("avg_ratio_improvement_percent"),
        half_up(F.avg("chapter_improvement"), 2).alias("avg_chapter_improvement"),
        half_up(F.avg("issue_improvement"), 2).alias("avg_issue_improvement"),
        F.count_if(r > 0).alias("books_improved"), F.count_if(r < 0).alias("books_regressed"),
        F.count_if(r == 0).alias("books_same"),
        half_up(F.count_if(r > 0) / n * 100, 1).alias("improvement_rate"),
        F.min(F.struct((-r).alias("k"), "pos", "source", r.alias("v"))).alias("best"),
        F.min(F.struct(r.alias("k"), "pos", "source", r.alias("v"))).alias("worst"),
    ).select("*", F.col("best.v").alias("best_improvement_percent"),
             F.col("best.source").alias("best_improvement_book"),
             F.col("worst.v").alias("worst_regression_percent"),
             F.col("worst.source").alias("worst_regression_book")).drop("best", "worst")


def library_summary(reports: DataFrame) -> DataFrame:
    """One row over the library: books by status, ratio range, counts of the lists below."""
    r = F.col("ratio")
    return reports.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "OK").alias("ok"),
        F.count_if(F.col("status") == "ISSUES").alias("with_issues"),
        F.count_if(F.col("status") == "ERROR").alias("errors"),
        half_up(F.avg(r), 3).alias("avg_ratio"),
        F.min(r).alias("min_ratio"), F.max(r).alias("max_ratio"),
        F.count_if(r < 0.60).alias("short_books"),
        F.count_if(F.col("matched") < F.col("total_source")).alias("incomplete_books"))


def short_books(reports: DataFrame) -> DataFrame:
    """Books of under 60 % of the expected length, shortest first."""
    return reports.filter(F.col("ratio") < 0.60).select("book_id", "ratio").orderBy("ratio", "book_id")


def incomplete_books(reports: DataFrame) -> DataFrame:
    """Books that miss chapters, with how many they have."""
    return reports.filter(F.col("matched") < F.col("total_source")).select(
        "book_id", "matched", "total_source")


def ratio_band(ratio: Column) -> Column:
    return (F.when(ratio < 0.25, "CRITICAL").when(ratio < 0.45, "POOR")
            .when(ratio < 0.60, "ACCEPTABLE").otherwise("GOOD"))


def match_summary(reports: DataFrame, *by: str) -> DataFrame:
    """Average match and perfect / good / poor counts per group and over all books."""
    pct = F.col("match_pct")
    return reports.rollup(*by).agg(
        F.count(F.lit(1)).alias("n_books"),
        F.avg(F.floor(pct * 10 + 0.5)).alias("_avg"),
        F.count_if(pct >= 100).alias("perfect"),
        F.count_if((pct >= 90) & (pct < 100)).alias("good"),
        F.count_if(pct < 90).alias("poor"),
    ).withColumn("avg_match", half_up(F.col("_avg") / 10, 1)).drop("_avg")


def worst(reports: DataFrame, n: int = 5) -> DataFrame:
    return reports.filter("ratio is not null").orderBy("ratio", "book_id").limit(n)



def select_books(df: DataFrame, languages: tuple[str, ...], name_part: str, name: str
                 ) -> DataFrame:
    """Books of some languages whose name contains a text, ignoring case."""
    return df.filter(F.col("lang").isin(*languages)).filter(
        F.lower(name).contains(name_part.lower()))
