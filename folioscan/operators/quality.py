"""Row-wise text checks. None of them shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X
from ..functions.citations import clean_citations


def text_quality(df: DataFrame, text: str = "text", mojibake_max=None, nonword_max=None
                 ) -> DataFrame:
    """Add ``reason`` (first failing rule or ``clean``) and ``verdict``."""
    return df.withColumn("reason", X.quality_reason(F.col(text), mojibake_max, nonword_max)
                         ).withColumn("verdict", X.verdict_of(F.col("reason")))


def quality_summary(df: DataFrame, *by: str) -> DataFrame:
    """Verdict reasons counted per group."""
    return text_quality(df).groupBy(*by, "reason").agg(
        F.count(F.lit(1)).alias("n_chapters"), F.sum(F.length("text")).alias("n_chars"))


def script_route(df: DataFrame, requires_llm: str, text: str = "text") -> DataFrame:
    """How a chapter becomes a script: fixed sentence, its own text, one call, or many.

    ``script`` is the finished script of the first two kinds; the others wait for their calls.
    """
    cleaned = df.withColumn("_clean", clean_citations(F.col(text))).withColumn(
        "clean_words", X.word_count(F.col("_clean")))
    route = (
        F.when(F.length(X.strip(F.col(text))) == 0, "fixed_sentence")
        .when(~F.col(requires_llm), "no_model")
        .when(F.col("clean_words") < K.SHORT_SCRIPT_WORDS, "too_short")
        .when(F.col("clean_words") <= K.CHUNK_WORDS, "one_call")
        .otherwise("chunked"))
    return cleaned.withColumn("route", route).withColumn(
        "script", F.when(F.col("route") == "fixed_sentence", K.EMPTY_CHAPTER_SCRIPT)
        .when(F.col("route").isin("no_model", "too_short"), F.col("_clean"))).drop("_clean")


def preservation(pairs: DataFrame, *by: str) -> DataFrame:
    """Share of source words a script keeps: average per group and how many fall short."""
    ratio = F.when(F.col("source_words") > 0, F.col("script_words") / F.col("source_words"))
    return pairs.withColumn("kept", ratio).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_scripts"),
        F.sum("script_words").alias("script_words"), F.sum("source_words").alias("source_words"),
        F.count_if(F.col("kept") < K.PRESERVATION_MIN).alias("n_short")
    ).withColumn("kept", F.when(
        F.col("source_words") > 0, F.col("script_words") / F.col("source_words")))
