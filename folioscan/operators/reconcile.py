"""Compare the chapters of a source with those of the product made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.text import half_up
from ..functions.words import expected_seconds
from ..session import durable
from .ordered import Running, ordered


def titles(side: DataFrame) -> DataFrame:
    """Distinct titles of a side, ignoring case; a title's copies are merged before the shuffle."""
    return side.select("book_id", F.lower("title").alias("key")).distinct()


def last_source(source: DataFrame) -> DataFrame:
    """One row per (book, title ignoring case); of equal titles the last one stands."""
    last = F.max(F.struct("number", "title"))
    return source.groupBy("book_id", F.lower("title").alias("key")).agg(last.alias("s")).select(
        "book_id", "key", "s.number", "s.title")


def last_audio(audio: DataFrame) -> DataFrame:
    return audio.groupBy("book_id", F.lower("title").alias("key")).agg(
        F.max("position").alias("position"))


def align(source: DataFrame, audio: DataFrame) -> DataFrame:
    """Both sides by title: ``number`` is null for extra titles, ``position`` for missing ones."""
    return last_source(source).join(last_audio(audio), ["book_id", "key"], "full")


def missing(aligned: DataFrame) -> DataFrame:
    return aligned.filter("position is null").select(
        "book_id", "number", "title", (F.col("number") - 1).alias("expected_position"))


def extra(aligned: DataFrame) -> DataFrame:
    return aligned.filter("number is null").select(
        "book_id", (F.col("position") + 1).alias("number"), F.col("key").alias("title"),
        "position")


def matched(aligned: DataFrame) -> DataFrame:
    return aligned.filter("number is not null and position is not null").select(
        "book_id", "key", "number", "position")


def order_violations(aligned: DataFrame) -> DataFrame:
    """Matched chapters with an earlier-numbered one placed after them in the product."""
    run = ordered(matched(aligned), ["book_id"], ["number"]).running(
        Running("furthest", "max", F.col("position"), before=True)).result()
    return run.filter(F.col("furthest") > F.col("position")).select(
        "book_id", "number", F.col("key").alias("title"),
        (F.col("number") - 1).alias("expected_order"),
        F.col("position").alias("actual_position"))


def match_percent(matched: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(
        half_up(matched / F.greatest(total, F.lit(1)) * 100, 1))


def verify_report(source: DataFrame, audio: DataFrame) -> DataFrame:
    """Counts and match percentage per book; all partial sums happen before the shuffle."""
    aligned = durable(align(source, audio))
    found = aligned.groupBy("book_id").agg(
        F.count_if(F.col("number").isNotNull() & F.col("position").isNotNull()).alias("matched"),
        F.count_if(F.col("position").isNull()).alias("missing"),
        F.count_if(F.col("number").isNull()).alias("extra"))
    sides = source.select("book_id", F.lit(1).alias("s"), F.lit(0).alias("a")).unionAll(
        audio.select("book_id", F.lit(0).alias("s"), F.lit(1).alias("a")))
    counts = sides.groupBy("book_id").agg(
        F.sum("s").alias("total_source"), F.sum("a").alias("total_audio"))
    late = order_violations(aligned).groupBy("book_id").agg(
        F.count(F.lit(1)).alias("order_violations"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return counts.join(found, "book_id", "left").join(late, "book_id", "left").select(
        "book_id", "total_source", "total_audio", zero("matched"), zero("missing"),
        zero("extra"), zero("order_violations")).withColumns({
            "matched_in_order": F.col("matched") - F.col("order_violations"),
            "match_pct": match_percent(F.col("matched"), F.col("total_source"))})


def duration_hints(words: DataFrame, durations: DataFrame, least_minutes: float = 1.0
                   ) -> DataFrame:
    """Expected against actual narration time per book; a book without audio has 0 seconds."""
    spoken = durations.groupBy("book_id").agg(
        F.sum(F.coalesce("duration_s", F.lit(0.0))).alias("actual_s"))
    told = words.groupBy("book_id").agg(F.sum("n_words").alias("word_count"))
    out = told.join(spoken, "book_id", "left").withColumns({
        "actual_s": F.coalesce("actual_s", F.lit(0.0)),
        "expected_s": expected_seconds(F.col("word_count"), least_minutes)})
    return out.withColumn("ratio", F.col("actual_s") / F.col("expected_s"))


def duration_class(ratio: Column) -> Column:
    return (F.when(ratio < 0.5, "much_shorter").when(ratio < 0.9, "shorter")
            .when(ratio > 1.5, "much_longer").when(ratio > 1.1, "longer")
            .otherwise("as_expected"))


def duration_message(ratio: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.DURATION_CLASSES.items() for x in kv])
    return F.element_at(table, duration_class(ratio))


def status_line(match_pct: Column) -> Column:
    return F.when(match_pct == 100, "PASS").when(match_pct >= 90, "NEAR MISS").otherwise("FAIL")


def grade(match_pct: Column) -> Column:
    return (F.when(match_pct >= 100, "PERFECT").when(match_pct >= 90, "GOOD")
            .when(match_pct >= 70, "FAIR").when(match_pct >= 50, "POOR")
            .otherwise("CRITICAL"))


def issues(report: DataFrame) -> DataFrame:
    """Issue list and pass mark per book: missing, extra, order and duration problems."""
    found = F.array_compact(F.array(
        F.when(F.col("missing") > 0, F.concat(F.lit("Missing chapters: "), "missing")),
        F.when(F.col("extra") > 0, F.concat(F.lit("Extra chapters: "), "extra")),
        F.when(F.col("order_violations") > 0,
               F.concat(F.lit("Order violations: "), "order_violations")),
        F.when(F.col("ratio") < K.BOOK_RATIO_MIN, F.lit("Audio shorter than expected"))))
    return report.withColumn("issues", found).withColumns({
        "issues_count": F.size("issues").cast("bigint"), "passed": F.size("issues") == 0})


def chapter_duration_check(df: DataFrame, words: str, actual: str) -> DataFrame:
    """Per-chapter duration ratio with a half-minute floor."""
    expected = expected_seconds(F.col(words), 0.5)
    return df.withColumn("expected_s", expected).withColumn(
        "ratio", F.col(actual) / F.col("expected_s")).withColumn(
        "is_ok", F.col("ratio") >= K.CHAPTER_RATIO_MIN)


def offsets(episodes: DataFrame, order: list[str]) -> DataFrame:
    """Start and end of each episode in milliseconds; those without a duration are left out."""
    ms = F.floor(F.col("duration_s") * 1000).cast("bigint")
    rows = episodes.filter("duration_s > 0").withColumn("ms", ms)
    run = ordered(rows, ["book_id"], order).running(
        Running("episode_no", "count"), Running("end_ms", "sum", F.col("ms"))).result()
    return run.withColumn("start_ms", F.col("end_ms") - F.col("ms"))


def titles_by_ordinal(episodes: DataFrame, titles: DataFrame) -> DataFrame:
    """Title by number within the book, ``Episode n`` where there is none."""
    out = episodes.join(titles, ["book_id", "number"], "left")
    fallback = F.concat(F.lit("Episode "), "number")
    return out.select("book_id", "number", F.coalesce(
        F.nullif("title", F.lit("")), fallback).alias("title"))


def limit_per_book(chapters: DataFrame, order: list[str], n: int) -> DataFrame:
    """First ``n`` chapters of each book. Tasks cut to ``n`` per book before the shuffle."""
    w = Window.partitionBy("book_id").orderBy(*order)
    return chapters.withColumn("number", F.row_number().over(w)).filter(
        F.col("number") <= n).withColumn("number", F.col("number").cast("bigint"))


def first_per_book(rows: DataFrame, order: list[str], n: int, text: str) -> DataFrame:
    """The first ``n`` texts of each book on one line; only those leave a task."""
    top = limit_per_book(rows, order, n)
    listed = F.array_sort(F.collect_list(F.struct("number", text)))
    return top.groupBy("book_id").agg(F.array_join(
        F.transform(listed, lambda r: r[text]), ", ").alias(f"{text}s"))


def checkable(wanted: DataFrame, scripts: DataFrame, audio: DataFrame) -> DataFrame:
    """Episodes that have both a script (by number) and audio (by document)."""
    return wanted.join(scripts, ["book_id", "number"], "left_semi").join(
        audio, "doc_id", "left_semi")
