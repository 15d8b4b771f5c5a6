"""Bounded retries: budgets, flags, verdicts and the reports built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.text import fixed_digits, half_up, let, strip
from ..session import durable, stored
from .ordered import Running, numbered, ordered

ATTEMPT_KEYS = ("book_id", "chapter_id", "cycle")
ATTEMPT_ORDER = ("ts", "event_id")
# Flags in one row and characters in one document, unless spark.folioscan.partRows and partChars say otherwise.
PART_ROWS, PART_CHARS = 200_000, 64_000_000


def retry_ledger(attempts: DataFrame, keys: Sequence[str] = ATTEMPT_KEYS,
                 order: Sequence[str] = ATTEMPT_ORDER, budget: int = K.BUDGET) -> DataFrame:
    """What every attempt did to its chapter's budget and flags.

    ``retry`` spends one try, ``exhausted`` is the first failure beyond the budget, ``resolved``
    a pass after a retry: in the last cycle once, and only while no flag stands; in the first
    two cycles at every such pass.
    """
    failed, before = F.col("failed"), F.col("failed_before")
    place = F.struct(*order)
    run = ordered(attempts, keys, order).running(
        Running("attempt_no", "count"),
        Running("failed_before", "sum", failed.cast("int"), before=True),
        Running("best_wer", "min", F.col("wer")),
        Running("first_failure", "min", F.when(failed, place)),
        Running("last_pass", "max", F.when(~failed, place), before=True),
    ).result()
    # No pass yet since the first failure.
    first_return = F.coalesce(F.col("last_pass") < F.col("first_failure"), F.lit(True))
    once = F.col("cycle") == K.CYCLES[2]
    resolved = ~failed & (before > 0) & (~once | ((before <= budget) & first_return))
    action = (
        F.when(failed & (before < budget), "retry")
        .when(failed & (before == budget), "exhausted")
        .when(failed, "beyond_budget")
        .when(resolved, "resolved")
        .otherwise("pass"))
    used = F.least(before + failed.cast("int"), F.lit(budget))
    return run.select(
        *keys, *order, F.col("attempt_no").cast("bigint"), "failed", "wer",
        used.cast("bigint").alias("attempts_used"),
        (F.lit(budget) - used).cast("bigint").alias("remaining"),
        action.alias("action"), "best_wer")


def cycle_summary(ledger: DataFrame) -> DataFrame:
    """One row per chapter and cycle that ran: tries used, flags raised, best word error rate."""
    return ledger.groupBy("book_id", "chapter_id", "cycle").agg(
        F.max("attempts_used").alias("attempts_used"),
        F.count_if(F.col("action") == "exhausted").alias("exhausted"),
        F.count_if(F.col("action") == "resolved").alias("resolved"),
        F.min("best_wer").alias("best_wer"))


def fired(cycles: DataFrame) -> DataFrame:
    """Cycles that left a trace: a spent budget or a flag."""
    keys = ["book_id", "chapter_id", "cycle"]
    spent = cycles.filter("attempts_used > 0").select(*keys)
    flagged = cycles.filter("exhausted > 0 or resolved > 0").select(*keys)
    return spent.union(flagged).distinct()


def verdict(n_flags: Column, n_exhausted: Column) -> Column:
    return F.when(n_exhausted > 0, "unrecoverable").when(n_flags > 0, "flagged").otherwise("clean")


def chapter_verdicts(cycles: DataFrame) -> DataFrame:
    """Verdict per chapter from its flags; the best rate counts only where the last cycle ran."""
    n_flags = F.sum(F.col("exhausted") + F.col("resolved"))
    last = F.when(F.col("cycle") == K.CYCLES[2], F.col("best_wer"))
    return cycles.groupBy("book_id", "chapter_id").agg(
        n_flags.cast("bigint").alias("n_flags"),
        F.sum("exhausted").cast("bigint").alias("n_exhausted"),
        F.min(last).alias("best_wer"),
        verdict(n_flags, F.sum("exhausted")).alias("verdict"))


def verdict_counts(verdicts: DataFrame, *by: str) -> DataFrame:
    return verdicts.groupBy(*by).agg(
        *[F.count_if(F.col("verdict") == v).alias(v)
          for v in ("clean", "flagged", "unrecoverable")])


def pipeline_status(expected: Column, produced: Column) -> Column:
    return (F.when(expected == 0, "no_chapters").when(produced == expected, "complete")
            .when(produced == 0, "failed").otherwise("partial"))


def flag_entries(ledger: DataFrame) -> DataFrame:
    """One row per flag: the attempt that raised it, why, and whether the budget was spent."""
    exhausted = F.col("action") == "exhausted"
    rate = F.concat(F.lit("WER "), fixed_digits(F.col("wer")))
    reason = F.when(F.col("cycle") == K.CYCLES[2], rate).when(
        exhausted, "verdict garbage").otherwise("verdict clean")
    return ledger.filter(F.col("action").isin("exhausted", "resolved")).select(
        *ATTEMPT_KEYS, *ATTEMPT_ORDER, reason.alias("reason"), exhausted.alias("exhausted"))


def per_chapter(cycles: DataFrame, flags: DataFrame) -> DataFrame:
    """Chapter rows with tries per cycle and flags as ordered arrays.

    A chapter may have any number of flags: each row holds a bounded ``part`` of them, in order from 1.
    """
    keys = ["book_id", "chapter_id"]
    size = int(flags.sparkSession.conf.get("spark.folioscan.partRows", str(PART_ROWS)))
    rank = F.array_position(F.array(*map(F.lit, K.CYCLES)), F.col("cycle"))
    tries = F.struct(rank.alias("rank"), "cycle", "attempts_used")
    used = cycles.filter("attempts_used > 0 or exhausted > 0 or resolved > 0").groupBy(*keys).agg(
        F.array_sort(F.collect_list(tries)).alias("cycles"))
    placed = numbered(durable(flags.withColumn("rank", rank)), keys, ["rank", *ATTEMPT_ORDER], "place")
    part = F.floor((F.col("place") - 1) / size) + 1
    raised = F.struct("place", "rank", *ATTEMPT_ORDER, "cycle", "reason", "exhausted")
    listed = placed.withColumn("part", part.cast("int")).groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list(raised)).alias("flags"))
    # As many rows as a chapter has parts, so the parts of a hot one are joined in many tasks.
    chapters = chapter_verdicts(cycles)
    last = F.greatest(F.lit(1), F.ceil(F.col("n_flags") / size).cast("int"))
    return chapters.join(used, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(1), last))).join(
        listed, [*keys, "part"], "left").withColumns({
            "cycles": F.coalesce("cycles", F.array().cast(used.schema["cycles"].dataType)),
            "flags": F.coalesce("flags", F.array().cast(listed.schema["flags"].dataType))})


def _used(cycles: Column) -> Column:
    return F.map_from_entries(F.transform(
        cycles, lambda e: F.struct(e["cycle"], e["attempts_used"])))


def flag_details(flags: Column, cycles: Column, best_wer: Column) -> Column:
    """Readable summary of a chapter's flags, one after the other."""
    def line(used: Column):
        def text(e: Column) -> Column:
            tries = F.coalesce(F.try_element_at(used, e["cycle"]), F.lit(0)).cast("string")
            tail = F.when(e["exhausted"], F.concat(
                tries, F.lit(f"/{K.BUDGET} attempts exhausted"))).otherwise("resolved")
            best = F.when(e["cycle"] == K.CYCLES[2], F.concat(
                F.lit(", best WER "), fixed_digits(best_wer)))
            return F.concat(e["cycle"], F.lit(" ("), tail, F.coalesce(best, F.lit("")), F.lit(")"),
                            F.coalesce(F.concat(F.lit(" — "), e["reason"]), F.lit("")))
        return text

    return let(_used(cycles), lambda used: F.array_join(F.transform(flags, line(used)), "; "))


def quality_report(chapters: DataFrame, title: Column, synthesised: Column) -> DataFrame:
    """Report rows per book: entry ``chapter_n`` for each chapter and one ``summary``.

    A book's report is a set of rows, so a book may have any number of chapters. Further flags of a
    chapter in parts are entries ``chapter_n_part_k``. ``synthesised`` says which chapters have an episode.
    """
    best = half_up(F.col("best_wer"), 4).cast("decimal(6,4)")
    flags = F.transform("flags", lambda f: F.struct(f["cycle"], f["reason"], f["exhausted"]))
    keep_nulls = {"ignoreNullFields": "false"}
    more = F.when(F.col("part") > 1, F.concat(F.lit("_part_"), "part"))
    chapter_rows = chapters.select("book_id", "chapter_id", "part", F.concat(
        F.lit("chapter_"), "chapter_id", F.coalesce(more, F.lit(""))).alias("entry"), F.when(
        F.col("part") > 1, F.to_json(F.struct(flags.alias("flags")), keep_nulls)).otherwise(F.to_json(F.struct(
            title.alias("title"), "verdict", _used(F.col("cycles")).alias("attempts_used"),
            best.alias("best_wer"), flags.alias("flags")), keep_nulls)).alias("report"))
    chapters = chapters.filter("part = 1")
    expected, produced = F.col("chapters_expected"), F.col("episodes_synthesised")
    book_rows = verdict_counts(chapters, "book_id").join(chapters.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("chapters_expected"),
        F.count_if(synthesised).alias("episodes_synthesised")), "book_id").select(
        "book_id", F.lit(None).cast("bigint").alias("chapter_id"), F.lit(1).alias("part"), F.lit("summary").alias("entry"),
        F.to_json(F.struct(
            pipeline_status(expected, produced).alias("pipeline_status"), "episodes_synthesised",
            "chapters_expected", F.struct("clean", "flagged", "unrecoverable").alias(
                "verdict_counts"))).alias("report"))
    return chapter_rows.unionByName(book_rows)


def report_documents(rows: DataFrame) -> DataFrame:
    """JSON documents per book from its report rows: one, or several where the report is long.

    The first document holds the summary, each further one its number as ``part``; every document is
    whole JSON with the entries that follow those of the one before.
    """
    size = int(rows.sparkSession.conf.get("spark.folioscan.partChars", str(PART_CHARS)))
    rows = stored(rows, "report")
    keys = ["book_id", "chapter_id", "part"]
    narrow = rows.filter("entry <> 'summary'").select(*keys, F.length("report").cast("bigint").alias("chars"))
    placed = ordered(narrow, ["book_id"], ["chapter_id", "part"]).running(
        Running("before", "sum", F.col("chars"), before=True)).result().select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], (F.floor(F.col("before") / size) + 1).cast("int").alias("document"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    piece = F.struct("chapter_id", "part", F.concat(F.lit('"'), "entry", F.lit('":'), "report").alias("json"))
    chapter = F.when(F.col("entry") != "summary", piece)
    chapters = F.array_join(F.transform(
        F.array_sort(F.collect_list(chapter)), lambda e: e["json"]), ",")
    summary = F.max(F.when(F.col("entry") == "summary", F.col("report")))
    # The summary is an object; its closing brace gives way to the chapters.
    head = F.when(F.col("document") == 1, F.substring(summary, F.lit(1), F.length(summary) - 1)).otherwise(
        F.concat(F.lit('{"part":'), F.col("document")))
    return rows.join(placed, on, "left").withColumn("document", F.coalesce("document", F.lit(1))).groupBy(
        "book_id", "document").agg(F.concat(head, F.lit(',"chapters":{'), chapters, F.lit("}}")).alias("report")
        ).drop("document")


def failure_gate(attempts: DataFrame, *by: str) -> DataFrame:
    """Share of failed attempts and whether it stops the run."""
    return attempts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if("failed").alias("failed_count")
    ).withColumn("failure_rate", F.col("failed_count") / F.col("attempted")).withColumn(
        "aborts", F.col("failure_rate") > K.FAILURE_RATE_MAX)


def failure_streaks(attempts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Failures in a row before each attempt; every fifth one pauses for recovery."""
    run = ordered(attempts, keys, order).running(Running("attempt_no", "count")).running(
        Running("last_pass", "max", F.when(~F.col("failed"), F.col("attempt_no")), before=True)
    ).result()
    streak = F.col("attempt_no") - 1 - F.coalesce("last_pass", F.lit(0))
    return run.withColumn("streak_before", streak.cast("bigint")).withColumn(
        "pauses", (F.col("streak_before") > 0)
        & (F.col("streak_before") % K.MAX_CONSECUTIVE_FAILURES == 0))


def best_attempt(attempts: DataFrame, *by: str) -> DataFrame:
    """Lowest word error rate per group; the earliest attempt wins a tie."""
    return attempts.groupBy(*by).agg(
        F.min(F.struct("wer", "ts", "event_id")).alias("b")).select(
        *by, F.col("b.wer").alias("best_wer"), F.col("b.event_id").alias("best_event"))


def judge_verdict(reply: Column) -> tuple[Column, Column]:
    """(verdict, reason) of a judge's JSON reply; whatever cannot be read passes."""
    bare = strip(reply)
    fenced = F.regexp_extract(bare, r"(?s)\A```[^\n]*\n(.*)```", 1)
    body = F.when(bare.startswith("```"), fenced).otherwise(bare)
    doc = F.try_parse_json(strip(body))
    said = F.try_variant_get(doc, "$.verdict", "string")
    reason = F.coalesce(F.try_variant_get(doc, "$.reason", "string"), F.lit(""))
    return F.when(said.isin("reroute", "borderline"), said).otherwise("pass"), reason


def judge_prompt(source: Column, script: Column) -> Column:
    """Request text for the judge: the leading part of source and script, as the judge reads it."""
    head, middle, end = map(F.lit, K.JUDGE_FORMAT)
    return F.concat(head, F.left(source, F.lit(K.JUDGE_SOURCE_CHARS)), middle,
                    F.left(script, F.lit(K.JUDGE_SCRIPT_CHARS)), end)


def script_decision(n_words: Column, verdict: Column, remaining: Column) -> Column:
    """Long scripts pass unjudged; a reroute is pending while tries remain."""
    return (F.when(n_words >= K.SHORT_SCRIPT_WORDS, "pass")
            .when(verdict != "reroute", verdict)
            .when(remaining > 0, "pending").otherwise("exhausted"))


def error_class(script: Column) -> Column:
    """Kind of model error a script carries instead of text; null for real scripts."""
    kind = F.lit("other")
    for name, mark in reversed(K.ERROR_MARKS.items()):
        kind = F.when(script.contains(mark), name).otherwise(kind)
    return F.when(script.startswith(K.ERROR_PREFIX), kind)


def short_scripts(df: DataFrame) -> DataFrame:
    """Status by word count: scripts under the limit are suspiciously short."""
    return df.withColumn("status", F.when(
        F.col("n_words") < K.SHORT_SCRIPT_WORDS, "SHORT").otherwise("OK"))
