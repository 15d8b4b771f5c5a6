"""Which task, provider and call a piece of text goes to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.segment import batch_totals, sentence_pipeline
from ..functions.text import strip
from .ordered import numbered
from .skew import lookup


def source_type(path: Column) -> Column:
    """Kind of input by extension; null when it is not supported."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext.isin(*K.INPUT_EXTENSIONS), F.substring(ext, 2, 10))


def route_tasks(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Resolve the prompt: a prompt file wins, else the task's own; unknown tasks are errors.

    ``tasks`` is the literal task dimension (a handful of rows), hence the broadcast.
    """
    out = requests.join(F.broadcast(tasks), "task", "left")
    own = F.nullif(strip(F.col("prompt_file")), F.lit(""))
    return out.withColumns({
        "resolved_prompt": F.coalesce(own, F.col("prompt")),
        "error": F.when(F.col("prompt_file").isNotNull() & own.isNull(), "empty prompt file")
        .when(own.isNull() & F.col("requires_llm").isNull(), "unknown task")})


def validate_prompt(prompt: Column) -> tuple[Column, Column]:
    n = F.length(strip(F.coalesce(prompt, F.lit(""))))
    message = F.when(n == 0, K.PROMPT_EMPTY).when(
        n < K.MIN_PROMPT_CHARS, K.PROMPT_SHORT).otherwise(K.PROMPT_OK)
    return n >= K.MIN_PROMPT_CHARS, message


def language_names(df: DataFrame, languages: DataFrame, code: str) -> DataFrame:
    """Language name per code; an unknown code stays. The dimension has a fixed 17 rows."""
    names = F.broadcast(languages.withColumnRenamed("code", code).withColumnRenamed(
        "name", "_name"))
    return df.join(names, code, "left").withColumn(
        "language", F.coalesce("_name", F.col(code))).drop("_name")


def distinct_calls(requests: DataFrame) -> DataFrame:
    """One row per (prompt, language) that needs a translation, with how often it is used."""
    return requests.filter("language <> 'en'").groupBy("prompt", "language").agg(
        F.count(F.lit(1)).alias("uses"))


def answer_calls(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers back on every request; the prompt itself where none is needed or none came."""
    out = lookup(requests, answers, ["prompt", "language"])
    return out.withColumn("translated", F.coalesce(
        F.nullif(F.col("answer"), F.lit("")), F.col("prompt"))).drop("answer")


def call_model(calls: DataFrame, answer: Callable, schema: str) -> DataFrame:
    """Hook for an external model: ``answer`` maps batches of distinct calls to replies."""
    return calls.mapInPandas(answer, schema)


def request_counts(docs: DataFrame, text: str, providers=K.PROVIDERS) -> DataFrame:
    """Requests and sent characters per provider.

    Sentences are cut once per document; each provider then packs them under its own limit.
    """
    parts = docs.select(sentence_pipeline(F.col(text)).alias("s"))
    plans = F.array(*[F.struct(
        F.lit(name).alias("provider"), batch_totals(F.col("s"), limit, unit).alias("t"))
        for name, limit, unit in providers])
    return parts.select(F.explode(plans).alias("p")).groupBy("p.provider").agg(
        F.sum("p.t.requests").cast("bigint").alias("requests"),
        F.sum("p.t.chars").cast("bigint").alias("chars"))


def first_pairs(left: DataFrame, right: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` (left, right) combinations in order, without building the others.

    The i-th pair takes left item ``i div n`` and right item ``i mod n``; both sides are numbered
    and joined on those numbers.
    """
    lnum = numbered(left.toDF("left_item"), [], ["left_item"], "l", 0)
    rnum = numbered(right.toDF("right_item"), [], ["right_item"], "r", 0)
    n = F.lit(max(rnum.count(), 1))
    wanted = left.sparkSession.range(limit).select(
        (F.col("id") + 1).alias("pair_no"),
        F.floor(F.col("id") / n).cast("bigint").alias("l"), (F.col("id") % n).alias("r"))
    return wanted.join(lnum, "l").join(rnum, "r").select("pair_no", "left_item", "right_item")
